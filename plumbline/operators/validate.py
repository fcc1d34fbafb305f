"""Row-wise validation rules as Column expressions: one projection, no shuffle, no Python.

The texts of errors are fixed values.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.identity import imo_digit_sum


@dataclass(frozen=True)
class Rule:
    """A rule is an error text: null where the value passes. Subclass or build one to add a check."""

    rule_id: str
    severity: str
    field_name: str
    error: Column


def imo_error(imo: Column) -> Column:
    """Null for a valid IMO number, else what is wrong; the first failing check counts."""
    n = imo.try_cast("double")
    i = imo.try_cast("long")
    expected = F.pmod(imo_digit_sum(F.when(i.between(1_000_000, 9_999_999), i)), F.lit(10))
    return (
        F.when(imo.isNull(), "IMO number is missing").when(n.isNull(), F.concat(F.lit("IMO must be numeric, got: "), imo.cast("string"))).when(i == 0, "IMO number cannot be 0")
        .when(~i.between(1_000_000, 9_999_999), F.concat(F.lit("IMO must be 7 digits (1000000-9999999), got: "), i.cast("string")))
        .when(expected != F.pmod(i, F.lit(10)), F.concat(F.lit("IMO checksum failed. Expected check digit: "), expected.cast("long").cast("string"), F.lit(", got: "), F.pmod(i, F.lit(10)).cast("string")))
    )


def mmsi_error(mmsi: Column, mid_max: int = 800, exempt_00: bool = False) -> Column:
    """Null for nine digits whose first three are from 200 to ``mid_max``; ``exempt_00`` passes texts that start with 00."""
    i = mmsi.try_cast("long")
    mid = F.floor(i / 1_000_000)
    error = (
        F.when(mmsi.isNull(), "MMSI is missing").when(i.isNull(), F.concat(F.lit("MMSI must be numeric, got: "), mmsi.cast("string")))
        .when(F.length(i.cast("string")) != 9, F.concat(F.lit("MMSI must be 9 digits, got "), F.length(i.cast("string")).cast("string"), F.lit(" digits")))
        .when((mid < 200) | (mid > mid_max), F.concat(F.lit("Invalid MID (Maritime Identification Digits): "), mid.cast("string")))
    )
    return F.when(~F.coalesce(mmsi.cast("string").startswith("00"), F.lit(False)), error) if exempt_00 else error


def coordinate_error(value: Column, limit: int, lat: Column, lon: Column) -> Column:
    """Null for a null coordinate or one in range that is not on the null island."""
    name = "Latitude" if limit == 90 else "Longitude"
    out = F.concat(F.lit(f"{name} must be between -{limit} and {limit}, got: "), value.cast("string"))
    return F.when(value.isNull(), F.lit(None)).when(~value.between(-limit, limit), out).when((lat == 0) & (lon == 0), "Coordinates (0,0) detected - possible data quality issue")


def timestamp_error(value: Column, as_of: dt.datetime, max_age_days: int = 365) -> Column:
    """Null for a null time or one from ``max_age_days`` before ``as_of`` to 24 hours after it; text is parsed first."""
    ts = value.cast("string").try_cast("timestamp_ntz")
    now = F.lit(as_of).cast("timestamp_ntz")
    late, old = now + F.expr("interval 24 hours"), now - F.expr(f"interval {max_age_days} days")
    text = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return (
        F.when(value.isNull(), F.lit(None)).when(ts.isNull(), F.concat(F.lit("Invalid timestamp format: "), value.cast("string")))
        .when(ts > late, F.concat(F.lit("Future timestamp detected: "), text)).when(ts < old, F.concat(F.lit("Timestamp too old: "), text, F.lit(f" (older than {max_age_days} days)")))
    )


def standard_rules(as_of: dt.datetime) -> list[Rule]:
    """The nine rules, in order. The last three always pass; what they announce is checked across records instead."""
    c = F.col
    lat, lon = c("last_position_latitude"), c("last_position_longitude")
    rules = [
        Rule("RULE_IMO_001", "high", "imo", imo_error(c("imo"))),
        Rule("RULE_MMSI_001", "high", "mmsi", mmsi_error(c("mmsi"))),
        Rule("RULE_GEO_LAST_POSITION_LATITUDE", "medium", "last_position_latitude", coordinate_error(lat, 90, lat, lon)),
        Rule("RULE_GEO_LAST_POSITION_LONGITUDE", "medium", "last_position_longitude", coordinate_error(lon, 180, lat, lon)),
    ]
    rules += [Rule(f"RULE_TS_{f.upper()}", "medium", f, timestamp_error(c(f), as_of)) for f in ("last_position_updateTimestamp", "staticData_updateTimestamp")]
    rules += [Rule(f"RULE_CONSIST_{f.upper()}", "medium", f, F.lit(None).cast("string")) for f in ("grossTonnage", "length", "builtYear")]
    return rules


def long_results(records: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """A row for each record and rule: (key, rule_id, field_name, is_valid, error_message, severity, value, imo, mmsi)."""
    checks = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.field_name).alias("field_name"), r.error.isNull().alias("is_valid"), r.error.alias("error_message"), F.lit(r.severity).alias("severity"), F.col(r.field_name).cast("string").alias("value")) for r in rules])
    return records.select(key, "imo", "mmsi", F.explode(checks).alias("r")).select(key, "r.*", "imo", "mmsi")


def with_status(records: DataFrame, rules: list[Rule]) -> DataFrame:
    """``records`` with ``validation_status`` (valid or invalid) and ``validation_errors`` (JSON list in rule order)."""
    errors = F.array_compact(F.array(*[r.error for r in rules]))
    return records.withColumn("_errors", errors).withColumns({"validation_status": F.when(F.size("_errors") == 0, "valid").otherwise("invalid"), "validation_errors": F.to_json("_errors")}).drop("_errors")


def summary_by_rule(results: DataFrame) -> DataFrame:
    """(rule_id, total, passed, failed) with a last row ALL."""
    return results.rollup("rule_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_valid").alias("passed"), F.count_if(~F.col("is_valid")).alias("failed")).withColumn("rule_id", F.coalesce("rule_id", F.lit("ALL")))


def summary_by_severity(results: DataFrame) -> DataFrame:
    return results.groupBy("severity").agg(F.count_if(~F.col("is_valid")).alias("failed"))


def anomaly_score(records: DataFrame) -> DataFrame:
    """``records`` with ``anomaly_score`` (0 to 1) and ``anomaly_flags`` by identifier, name and position of one row."""
    imo, name, lat, lon = F.col("imo"), F.col("name"), F.col("last_position_latitude"), F.col("last_position_longitude")
    odd = F.length(F.regexp_replace(name, r"[\p{L}\p{N} ]", "")) / F.length(name)
    parts = [
        ("zero_imo", imo == 0, 0.3), ("invalid_imo", (imo != 0) & (imo < 1_000_000), 0.4), ("garbled_name", (F.length(name) > 0) & (odd > 0.3), 0.3),
        ("null_island", (lat == 0) & (lon == 0), 0.2), ("invalid_latitude", ~lat.between(-90, 90), 0.3), ("invalid_longitude", ~lon.between(-180, 180), 0.3),
    ]
    total = sum((F.when(cond, F.lit(w)).otherwise(F.lit(0.0)) for _, cond, w in parts[1:]), F.when(parts[0][1], F.lit(parts[0][2])).otherwise(F.lit(0.0)))
    return records.withColumns({"anomaly_score": F.round(F.least(F.lit(1.0), total), 4), "anomaly_flags": F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond, _ in parts]))})


def coordinates_check(lat: Column, lon: Column) -> Column:
    """STRUCT<valid, warnings>: out of range is invalid, the null island only a warning."""
    valid = lat.between(-90, 90) & lon.between(-180, 180)
    return F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), F.array_compact(F.array(F.when((lat == 0) & (lon == 0), F.lit("null island")))).alias("warnings"))


def check_record(records: DataFrame) -> DataFrame:
    """``records`` with ``id_check`` and ``anomaly``: identifiers and anomaly score of each record in one projection."""
    scored = anomaly_score(records)
    ids = F.struct(imo_error(F.col("imo")).alias("imo_error"), mmsi_error(F.col("mmsi"), 775, True).alias("mmsi_error"), coordinates_check(F.col("last_position_latitude"), F.col("last_position_longitude")).alias("position"))
    return scored.withColumns({"id_check": ids, "anomaly": F.struct("anomaly_score", "anomaly_flags")}).drop("anomaly_score", "anomaly_flags")
