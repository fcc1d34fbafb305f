"""Queries of the record, graph, time and query operators over the vessel records, with their SQL twins."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import ontology
from plumbline.functions.text import char_jaccard, name_similarity, tidy_name
from plumbline.operators import alerts, graph, profile, quality, resolve, temporal, validate
from plumbline.plans import cypher as cy
from plumbline.plans import language
from plumbline.plans import query as q
from plumbline.session import shared_folder
from plumbline.sources import vessels as source
from plumbline.sources.tables import table

#: The moment from which ages of timestamps are measured.
AS_OF = dt.datetime(2025, 2, 23)
ATTRIBUTES = {"mmsi": "mmsi", "flag": "flag", "name": "name"}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "vessel_records")


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Lists as texts, so that results compare in any engine."""
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in columns})


_SUM = "(((imo//1000000)%10)*7+((imo//100000)%10)*6+((imo//10000)%10)*5+((imo//1000)%10)*4+((imo//100)%10)*3+((imo//10)%10)*2)%10"
_IMO_ERROR = f"""case when imo is null then 'IMO number is missing' when imo = 0 then 'IMO number cannot be 0'
 when imo not between 1000000 and 9999999 then 'IMO must be 7 digits (1000000-9999999), got: ' || imo
 when {_SUM} <> imo % 10 then 'IMO checksum failed. Expected check digit: ' || {_SUM} || ', got: ' || imo % 10 end"""
_MMSI_ERROR = """case when mmsi is null then 'MMSI is missing' when length(cast(mmsi as varchar)) <> 9 then 'MMSI must be 9 digits, got ' || length(cast(mmsi as varchar)) || ' digits'
 when mmsi // 1000000 < 200 or mmsi // 1000000 > 800 then 'Invalid MID (Maritime Identification Digits): ' || mmsi // 1000000 end"""
_LAT_BAD = "(last_position_latitude is not null and (last_position_latitude not between -90 and 90 or (last_position_latitude = 0 and last_position_longitude = 0)))"
_LON_BAD = "(last_position_longitude is not null and (last_position_longitude not between -180 and 180 or (last_position_latitude = 0 and last_position_longitude = 0)))"
_TS_BAD = "({0} is not null and ({0} > timestamp '2025-02-24 00:00:00' or {0} < timestamp '2024-02-24 00:00:00'))"
_CHECKS = f"""checks as (select record_id, {_IMO_ERROR} is not null i, {_MMSI_ERROR} is not null m, {_LAT_BAD} la, coalesce({_LON_BAD}, false) lo, {_TS_BAD.format('last_position_updateTimestamp')} t1, {_TS_BAD.format('staticData_updateTimestamp')} t2 from vessel_records),
 long as (select record_id, unnest(['RULE_IMO_001','RULE_MMSI_001','RULE_GEO_LAST_POSITION_LATITUDE','RULE_GEO_LAST_POSITION_LONGITUDE','RULE_TS_LAST_POSITION_UPDATETIMESTAMP','RULE_TS_STATICDATA_UPDATETIMESTAMP','RULE_CONSIST_GROSSTONNAGE','RULE_CONSIST_LENGTH','RULE_CONSIST_BUILTYEAR']) rule_id,
 unnest(['high','high','medium','medium','medium','medium','medium','medium','medium']) severity, unnest([not i, not m, not coalesce(la,false), not lo, not t1, not t2, true, true, true]) is_valid from checks)"""
_KEY = "case when imo > 0 then 'vessel_imo_' || imo when mmsi is not null and mmsi <> 0 then 'vessel_mmsi_' || mmsi end"


# --- validation -------------------------------------------------------------------------------------------------------


def _long(spark, folder):
    return validate.long_results(records(spark, folder), validate.standard_rules(AS_OF), "record_id")


@query(f"select record_id, {_IMO_ERROR} error_message from vessel_records")
def v_imo_rule(spark, folder):
    return records(spark, folder).select("record_id", validate.imo_error(F.col("imo")).alias("error_message"))


@query(f"select record_id, {_MMSI_ERROR} error_message from vessel_records")
def v_mmsi_rule(spark, folder):
    return records(spark, folder).select("record_id", validate.mmsi_error(F.col("mmsi")).alias("error_message"))


def _coordinate_sql(name: str, limit: int) -> str:
    c = f"last_position_{name.lower()}"
    return f"case when {c} is null then null when {c} not between -{limit} and {limit} then '{name} must be between -{limit} and {limit}, got: ' || cast({c} as varchar) when last_position_latitude = 0 and last_position_longitude = 0 then 'Coordinates (0,0) detected - possible data quality issue' end"


def _time_sql(c: str) -> str:
    t = f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
    return f"case when {c} > timestamp '2025-02-24 00:00:00' then 'Future timestamp detected: ' || {t} when {c} < timestamp '2024-02-24 00:00:00' - interval 1 day + interval 1 day then 'Timestamp too old: ' || {t} || ' (older than 365 days)' end"


_RULES_SQL = f"""rules as (select record_id, imo, mmsi, unnest(['RULE_IMO_001','RULE_MMSI_001','RULE_GEO_LAST_POSITION_LATITUDE','RULE_GEO_LAST_POSITION_LONGITUDE','RULE_TS_LAST_POSITION_UPDATETIMESTAMP','RULE_TS_STATICDATA_UPDATETIMESTAMP','RULE_CONSIST_GROSSTONNAGE','RULE_CONSIST_LENGTH','RULE_CONSIST_BUILTYEAR']) rule_id,
 unnest(['imo','mmsi','last_position_latitude','last_position_longitude','last_position_updateTimestamp','staticData_updateTimestamp','grossTonnage','length','builtYear']) field_name,
 unnest(['high','high','medium','medium','medium','medium','medium','medium','medium']) severity,
 unnest([{_IMO_ERROR}, {_MMSI_ERROR}, {_coordinate_sql("Latitude", 90)}, {_coordinate_sql("Longitude", 180)}, {_time_sql("last_position_updateTimestamp")}, {_time_sql("staticData_updateTimestamp")}, null, null, null]) error_message from vessel_records)"""


@query(f"with {_RULES_SQL} select record_id, rule_id, field_name, error_message is null is_valid, error_message, severity, imo, mmsi from rules")
def v_rules_long(spark, folder):
    return _long(spark, folder).select("record_id", "rule_id", "field_name", "is_valid", "error_message", "severity", "imo", "mmsi")


@query(f"with {_CHECKS} select coalesce(rule_id, 'ALL') rule_id, count(*) total, count_if(is_valid) passed, count_if(not is_valid) failed from long group by rollup (rule_id)")
def v_summary_by_rule(spark, folder):
    return validate.summary_by_rule(_long(spark, folder))


@query(f"with {_CHECKS} select severity, count_if(not is_valid) failed from long group by 1")
def v_summary_by_severity(spark, folder):
    return validate.summary_by_severity(_long(spark, folder))


@query(f"with {_CHECKS} select record_id, case when bool_and(is_valid) then 'valid' else 'invalid' end validation_status, case when bool_and(is_valid) then '#2ecc71' else '#e74c3c' end color from long group by 1")
def v_record_status(spark, folder):
    done = validate.with_status(records(spark, folder), validate.standard_rules(AS_OF))
    return done.select("record_id", "validation_status", F.when(F.col("validation_status") == "invalid", "#e74c3c").otherwise("#2ecc71").alias("color"))


@query(f"""with {_RULES_SQL}, o as (select record_id, error_message, list_position(['RULE_IMO_001','RULE_MMSI_001','RULE_GEO_LAST_POSITION_LATITUDE','RULE_GEO_LAST_POSITION_LONGITUDE','RULE_TS_LAST_POSITION_UPDATETIMESTAMP','RULE_TS_STATICDATA_UPDATETIMESTAMP','RULE_CONSIST_GROSSTONNAGE','RULE_CONSIST_LENGTH','RULE_CONSIST_BUILTYEAR'], rule_id) k from rules)
select record_id, '[' || coalesce(string_agg('"' || error_message || '"', ',' order by k), '') || ']' validation_errors from o group by 1""")
def v_record_errors(spark, folder):
    return validate.with_status(records(spark, folder), validate.standard_rules(AS_OF)).select("record_id", "validation_errors")


@query("""
select record_id, round(least(1.0, (case when imo = 0 then 0.3 when imo < 1000000 then 0.4 else 0.0 end)::double
 + (case when length(name) > 0 and length(regexp_replace(name, '[\\p{L}\\p{N} ]', '', 'g')) / length(name) > 0.3 then 0.3 else 0.0 end)::double
 + (case when last_position_latitude = 0 and last_position_longitude = 0 then 0.2 else 0.0 end)::double + (case when last_position_latitude not between -90 and 90 then 0.3 else 0.0 end)::double
 + (case when last_position_longitude not between -180 and 180 then 0.3 else 0.0 end)::double), 4)::double anomaly_score,
 array_to_string(list_filter([case when imo = 0 then 'zero_imo' end, case when imo <> 0 and imo < 1000000 then 'invalid_imo' end, case when length(name) > 0 and length(regexp_replace(name, '[\\p{L}\\p{N} ]', '', 'g')) / length(name) > 0.3 then 'garbled_name' end,
  case when last_position_latitude = 0 and last_position_longitude = 0 then 'null_island' end, case when last_position_latitude not between -90 and 90 then 'invalid_latitude' end, case when last_position_longitude not between -180 and 180 then 'invalid_longitude' end], lambda x: x is not null), ',') anomaly_flags from vessel_records""")
def v_anomaly_score(spark, folder):
    return joined(validate.anomaly_score(records(spark, folder)).select("record_id", "anomaly_score", "anomaly_flags"), "anomaly_flags")


_ID_ERROR = "case when starts_with(cast(mmsi as varchar), '00') then null else (" + _MMSI_ERROR.replace("> 800", "> 775") + ") end"


@query(f"select record_id, {_IMO_ERROR} imo_error, {_ID_ERROR} mmsi_error, coalesce(last_position_latitude between -90 and 90 and last_position_longitude between -180 and 180, false) position_ok, case when last_position_latitude = 0 and last_position_longitude = 0 then 'null island' else '' end warnings from vessel_records")
def v_tool_checks(spark, folder):
    c = F.col("id_check")
    return joined(validate.check_record(records(spark, folder)).select("record_id", c["imo_error"].alias("imo_error"), c["mmsi_error"].alias("mmsi_error"), c["position"]["valid"].alias("position_ok"), c["position"]["warnings"].alias("warnings")), "warnings")


@query(f"with {_CHECKS}, f as (select *, row_number() over (partition by rule_id order by record_id) k from long where not is_valid) select rule_id alert_type, severity, count(*) affected, array_to_string(list_sort(list(record_id) filter (where k <= 100)), ',') sample from f group by 1, 2")
def v_rule_alerts(spark, folder):
    return joined(alerts.rule_alerts(_long(spark, folder), "record_id"), "sample")


@query(f"with {_CHECKS}, a as (select rule_id alert_type, severity from long where not is_valid group by 1, 2) select case when grouping(severity) = 0 then 'severity' when grouping(alert_type) = 0 then 'alert_type' else 'total' end as by, coalesce(severity, alert_type, 'all') as name, count(*) n from a group by grouping sets ((severity), (alert_type), ())")
def v_alert_summary(spark, folder):
    return alerts.summary(alerts.rule_alerts(_long(spark, folder), "record_id"))


# --- profiles and cross-record findings -------------------------------------------------------------------------------

#: All columns of vessel_records.
_COLUMNS = {
    "number": ["group_id", "imo", "mmsi", "length", "width", "deadweight", "grossTonnage", "netTonnage", "builtYear", "launchYear", "deadYear", "draught", "airDraught", "depth", "lengthOverall", "beamMoulded", "berthCount", "mainEngineCount", "propellerCount", "last_position_latitude", "last_position_longitude", "last_position_speed", "last_position_course", "last_position_heading", "matchedPort_latitude", "matchedPort_longitude"],
    "text": ["record_id", "source", "name", "aisClass", "callsign", "vessel_type", "flag", "shipBuilder", "hullNumber", "mainEngineDesigner", "propulsionType", "engineDesignation", "propellerType", "destination", "matchedPort_name", "matchedPort_unlocode"],
    "time": ["last_position_updateTimestamp", "eta", "staticData_updateTimestamp", "InsertDate", "UpdateDate"],
}


def _profile_sql(columns: list[str]) -> str:
    return " union all ".join(f"select '{c}' column_name, count({c}) non_null, count(*) - count({c}) n_null, round_even((count(*) - count({c})) * 100.0 / count(*), 2)::double null_pct, count(distinct {c}) n_distinct from vessel_records" for c in columns)


_PROFILE_SQL = _profile_sql([c for columns in _COLUMNS.values() for c in columns])


def _shares(facts: DataFrame) -> DataFrame:
    pct = F.coalesce(F.bround(F.try_divide(F.col("n_null") * 100.0, F.col("n_rows")), 2), F.lit(0.0))
    return facts.withColumns({"non_null": F.col("n_rows") - F.col("n_null"), "null_pct": pct})


@query(_PROFILE_SQL)
def a_column_profile(spark, folder):
    """By footers and single chunks, so that no row is copied once a column as by distinct counts in one aggregation."""
    path = f"{folder}/vessel_records.parquet"
    whole = profile.profile(spark, path, spark.read.parquet(path).columns)
    return _shares(whole).select("column_name", "non_null", "n_null", "null_pct", "n_distinct")


@query(f"select column_name, n_null, null_pct, non_null from ({_PROFILE_SQL})")
def a_missing_report(spark, folder):
    path = f"{folder}/vessel_records.parquet"
    return _shares(profile.facts(spark, path, None, spark.read.parquet(path).columns)).select("column_name", "n_null", "null_pct", "non_null").orderBy(F.col("null_pct").desc(), "column_name")


@query("select coalesce(sum(n - 1), 0)::bigint duplicate_rows from (select * exclude (raw_id), count(*) n from raw_feed group by all)")
def a_exact_duplicates(spark, folder):
    return quality.exact_duplicates(table(spark, folder, "raw_feed").drop("raw_id"))


@query("""
with k as (select 'imo' key_name, cast(imo as varchar) k from vessel_records where imo > 0 union all select 'mmsi', cast(mmsi as varchar) from vessel_records where mmsi is not null union all select 'name', upper(trim(name)) from vessel_records where trim(name) <> ''),
g as (select key_name, k, count(*) n from k group by 1, 2 having count(*) > 1) select key_name, count(*) duplicated_keys, sum(n)::bigint affected_rows from g group by 1""")
def a_duplicate_keys(spark, folder):
    return quality.duplicate_key_report(records(spark, folder))


@query("select upper(trim(name)) as key, count(*) n from vessel_records where trim(name) <> '' group by 1 having count(*) > 1 order by n desc, key limit 10")
def a_top_duplicate_names(spark, folder):
    name = tidy_name(F.col("name"))
    return quality.top_duplicates(records(spark, folder), F.when(name != "", name))


def _variation_sql(key: str, columns: list[str], limit: int, first: bool) -> str:
    positive = " and imo > 0" if key == "imo" else ""
    shown = lambda c: "cast(grossTonnage as decimal(18, 2))" if c == "grossTonnage" else c
    listed = "".join(f" array_to_string(list_sort(list(distinct {shown(c)}) filter (where {c} is not null)), ',') {c}_values," for c in columns)
    early = " arg_min(name, record_id) filter (where name is not null) first_name," if first else ""
    return f"select {key}, count(distinct {columns[0]}) n_distinct,{listed}{early} count(*) n_rows from vessel_records where {key} is not null{positive} group by 1 having count(distinct {columns[0]}) > 1 order by {key} limit {limit}"


def _variation(name: str, key: str, columns: list[str], limit: int, first: bool = False) -> None:
    def f(spark, folder):
        found = quality.variation(records(spark, folder), key, columns, limit, first=("name", "record_id") if first else None)
        if "grossTonnage" in columns:
            found = found.withColumn("grossTonnage_values", F.transform("grossTonnage_values", lambda x: x.cast("decimal(18, 2)")))
        return joined(found, *[f"{c}_values" for c in columns])

    f.__name__ = name
    query(_variation_sql(key, columns, limit, first))(f)


_variation("a_multi_mmsi_per_imo", "imo", ["mmsi", "name"], 20)
_variation("a_multi_imo_per_mmsi", "mmsi", ["imo", "name"], 20)
_variation("a_name_changes", "imo", ["name"], 20)
_variation("a_flag_changes", "imo", ["flag"], 20, True)
_variation("a_type_changes", "imo", ["vessel_type"], 10, True)
_variation("a_length_variation", "imo", ["length"], 5)
_variation("a_width_variation", "imo", ["width"], 5)
_variation("a_tonnage_variation", "imo", ["grossTonnage"], 5)


@query(" union all ".join(f"select '{c}' column_name, count(*) n_keys from (select imo from vessel_records where imo > 0 group by 1 having count(distinct {c}) > 1)" for c in ("length", "width", "grossTonnage")))
def a_varying_dimensions(spark, folder):
    return quality.varying_keys(records(spark, folder), "imo", ["length", "width", "grossTonnage"])


@query("""
with r as (select * from vessel_records where imo > 0 and mmsi is not null)
select 'imo_to_mmsi' direction, imo as key, array_to_string(list_sort(list(distinct mmsi)), ',') conflicting, count(distinct mmsi) n_values, count(*) n_rows from r group by 2 having count(distinct mmsi) > 1
union all select 'mmsi_to_imo', mmsi, array_to_string(list_sort(list(distinct imo)), ','), count(distinct imo), count(*) from r group by 2 having count(distinct imo) > 1""")
def a_identifier_conflicts(spark, folder):
    return joined(quality.identifier_conflicts(records(spark, folder)), "conflicting")


@query("select imo, array_to_string(list_sort(list(distinct mmsi)), ',') found_values, count(distinct mmsi)::int n_values, round_even(least(1.0, count(distinct mmsi) / 5.0), 4)::double confidence from vessel_records where imo > 0 and mmsi is not null group by 1 having count(distinct mmsi) > 2")
def a_mmsi_switching(spark, folder):
    return joined(quality.identifier_switching(records(spark, folder), "imo", "mmsi", 2, 5), "found_values")


@query("select mmsi, array_to_string(list_sort(list(distinct imo)), ',') found_values, count(distinct imo)::int n_values, round_even(least(1.0, count(distinct imo) / 3.0), 4)::double confidence from vessel_records where imo > 0 and mmsi is not null group by 1 having count(distinct imo) > 1")
def a_mmsi_reuse(spark, folder):
    return joined(quality.identifier_switching(records(spark, folder), "mmsi", "imo", 1, 3), "found_values")


@query("""
with l as (select imo, 'grossTonnage' attribute, grossTonnage number, cast(grossTonnage as varchar) kind from vessel_records union all select imo, 'length', length, cast(length as varchar) from vessel_records union all select imo, 'width', width, cast(width as varchar) from vessel_records
 union all select imo, 'builtYear', null, cast(builtYear as varchar) from vessel_records union all select imo, 'shipBuilder', null, shipBuilder from vessel_records),
g as (select imo, attribute, max(number) hi, min(number) lo, count(distinct kind) n_values from l where imo > 0 and kind is not null group by 1, 2),
c as (select *, case when hi > 0 then (hi - lo) / hi end change, attribute in ('grossTonnage', 'length', 'width') num from g)
select imo, attribute, case when num then round_even(change * 100, 2) end variation_pct, n_values, case when num then round_even(least(1.0, change), 4) else 0.7::double end confidence from c where (num and change > 0.1) or (not num and n_values > 1)""")
def a_stable_attributes(spark, folder):
    return quality.inconsistent_attributes(records(spark, folder), ["grossTonnage", "length", "width"], ["builtYear", "shipBuilder"])


_CHARS = "list_distinct(list_filter(string_split({0}, ''), lambda c: c <> ''))"
_JACCARD = "len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::double"


def _jaccard(a: str, b: str) -> str:
    return _JACCARD.format(a=_CHARS.format(a), b=_CHARS.format(b))


@query(f"""
with n as (select distinct imo, upper(trim(name)) n from vessel_records where imo > 0 and trim(name) <> ''), p as (select a.imo, a.n name_a, b.n name_b from n a join n b on a.imo = b.imo and a.n < b.n),
s as (select *, round_even({_jaccard('name_a', 'name_b')}, 4) similarity from p) select * from s where similarity < 0.3""")
def a_suspicious_names(spark, folder):
    return quality.suspicious_name_changes(records(spark, folder))


@query("select flag as value, count(*) n from vessel_records where flag is not null group by 1 order by n desc, value limit 20")
def a_top_flags(spark, folder):
    return quality.value_distribution(records(spark, folder), "flag")


@query("select vessel_type as value, count(*) n from vessel_records where vessel_type is not null group by 1")
def a_types(spark, folder):
    return quality.value_distribution(records(spark, folder), "vessel_type", None)


@query(r"select distinct name from vessel_records where regexp_matches(name, '^[\W\d\s]+$|[^\x00-\x7F]|[<>{}|\\`]')")
def a_garbled_names(spark, folder):
    return quality.garbled_names(records(spark, folder))


@query("select round_even(count_if(last_position_latitude is not null and last_position_longitude is not null) * 100.0 / count(*), 2)::double coverage_pct, count_if(last_position_latitude not between -90 and 90 or last_position_longitude not between -180 and 180) invalid_coordinates from position_reports")
def a_position_coverage(spark, folder):
    return quality.position_coverage(table(spark, folder, "position_reports"))


@query("select count_if(imo = 0) imo_zero, count_if(imo is null) imo_null, count_if(mmsi is null) mmsi_null from vessel_records")
def a_id_quality(spark, folder):
    return quality.id_quality(records(spark, folder))


@query("select count(*) n_rows, count(distinct imo) unique_imo, count(distinct mmsi) unique_mmsi, count(distinct flag) unique_flag, count(distinct vessel_type) unique_vessel_type from vessel_records")
def a_statistics(spark, folder):
    return quality.dataset_statistics(records(spark, folder))


@query(f"""
with n as (select distinct imo, upper(trim(name)) n from vessel_records where imo > 0 and trim(name) <> ''), p as (select a.imo, a.n name_a, b.n name_b from n a join n b on a.imo = b.imo and a.n < b.n),
l as (select imo, 'grossTonnage' attribute, grossTonnage number, cast(grossTonnage as varchar) kind from vessel_records union all select imo, 'length', length, cast(length as varchar) from vessel_records union all select imo, 'width', width, cast(width as varchar) from vessel_records
 union all select imo, 'builtYear', null, cast(builtYear as varchar) from vessel_records union all select imo, 'shipBuilder', null, shipBuilder from vessel_records),
g as (select imo, attribute, max(number) hi, min(number) lo, count(distinct kind) n_values from l where imo > 0 and kind is not null group by 1, 2),
f as (select 'suspicious_name_change' anomaly_type, imo from p where round_even({_jaccard('name_a', 'name_b')}, 4) < 0.3 union all select 'mmsi_switching', imo from vessel_records where imo > 0 and mmsi is not null group by imo having count(distinct mmsi) > 2
 union all select 'mmsi_reuse', min(imo) from vessel_records where imo > 0 and mmsi is not null group by mmsi having count(distinct imo) > 1 union all select 'attribute_inconsistency', imo from g where case when attribute in ('grossTonnage', 'length', 'width') then hi > 0 and (hi - lo) / hi > 0.1 else n_values > 1 end
 union all select 'unrealistic_speed', imo from vessel_records where last_position_speed > 50)
select anomaly_type alert_type, case when anomaly_type = 'mmsi_reuse' then 'high' else 'medium' end severity, count(*) affected, 0.85::double confidence, array_to_string(list_sort(list(distinct imo) filter (where imo is not null))[1:50], ',') sample from f group by 1""")
def a_anomaly_alerts(spark, folder):
    return joined(alerts.anomaly_alerts(quality.anomalies(records(spark, folder)), {"mmsi_reuse": "high"}), "sample")


@query(" union all ".join(
    f"select '{c}' column_name, count(*) as rows, count({c}) non_null, min({c})::double low, max({c})::double high, round_even(avg({c}), 4) mean, null::bigint kinds, null::varchar sample from vessel_records" if kind == "number" else
    f"select '{c}' column_name, count(*) as rows, count({c}) non_null, null::double low, null::double high, null::double mean, count(distinct {c}) kinds, case when count(distinct {c}) between 1 and 20 then array_to_string(list_sort(list(distinct cast({c} as varchar)) filter (where {c} is not null)), ',') end sample from vessel_records"
    for kind, columns in _COLUMNS.items() for c in columns
))
def s_inspect(spark, folder):
    """Every column of the records with extremes and mean, or kinds and values."""
    return joined(source.inspect(records(spark, folder)), "sample").withColumn("mean", F.bround("mean", 4))


_DOMAIN_ROWS = ", ".join(f"('{n}', '{d}')" for d, columns in source.DOMAINS.items() for n, _ in columns)


@query(f"select column_name, case column_type when 'VARCHAR' then 'string' when 'INTEGER' then 'int' when 'TIMESTAMP' then 'timestamp_ntz' else lower(column_type) end data_type, coalesce(domain, 'other') as domain from (describe select * from vessel_records) left join (values {_DOMAIN_ROWS}) d(n, domain) on column_name = n")
def s_column_domains(spark, folder):
    return source.column_domains(records(spark, folder))


@query("select cast(json_extract(props, '$.k') as bigint) k, count(*) n from events group by 1")
def s_json_props(spark, folder):
    return table(spark, folder, "events", "props").groupBy(F.from_json("props", "k bigint")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


# --- filters, order, limits -------------------------------------------------------------------------------------------


def _filter(name: str, f: q.Filter, where: str) -> None:
    def run(spark, folder):
        return q.run(records(spark, folder), q.Query(filters=(f,), columns=("record_id",)))

    run.__name__ = name
    query(f"select record_id from vessel_records where {where}")(run)


_filter("f_eq", q.Filter("flag", "eq", "LR"), "flag = 'LR'")
_filter("f_neq", q.Filter("flag", "neq", "LR"), "flag is distinct from 'LR'")
_filter("f_gt", q.Filter("length", "gt", 150.0), "length > 150")
_filter("f_lt", q.Filter("length", "lt", 150.0), "length < 150")
_filter("f_gte", q.Filter("builtYear", "gte", 2010), "builtYear >= 2010")
_filter("f_lte", q.Filter("builtYear", "lte", 2010), "builtYear <= 2010")
_filter("f_between", q.Filter("length", "between", (100.0, 200.0)), "length between 100 and 200")
_filter("f_in", q.Filter("flag", "in", ("LR", "PA", "NO")), "flag in ('LR', 'PA', 'NO')")
_filter("f_contains", q.Filter("name", "contains", "dawn"), "contains(lower(name), 'dawn')")
_filter("f_matches", q.Filter("name", "matches", "^golden .*n$"), "regexp_matches(name, '(?i)^golden .*n$')")


@query("select record_id from vessel_records where UpdateDate >= timestamp '2023-01-01' and UpdateDate <= timestamp '2023-12-31'")
def f_temporal_range(spark, folder):
    return q.run(records(spark, folder), q.Query("temporal", since=dt.datetime(2023, 1, 1), until=dt.datetime(2023, 12, 31), columns=("record_id",)))


@query("select report_id, last_position_speed, 0.8::double confidence from position_reports where last_position_speed > 50")
def f_unrealistic_speed(spark, folder):
    return table(spark, folder, "position_reports", "report_id", "last_position_speed").where("last_position_speed > 50").withColumn("confidence", F.lit(0.8))


@query("select record_id, length from vessel_records where length > (select quantile_cont(length, 0.99) from vessel_records) order by record_id limit 10")
def f_outlier_p99(spark, folder):
    return quality.above_percentile(records(spark, folder).select("record_id", "length"), "length", 0.99, "record_id").select("record_id", "length")


@query("select record_id from vessel_records where name ilike '%star%' or callsign ilike '%star%' order by record_id limit 20")
def f_free_text(spark, folder):
    return q.free_text(records(spark, folder).orderBy("record_id"), "star").select("record_id")


@query("select record_id, name from vessel_records where contains(lower(name), 'ocean') and length >= 100 order by name nulls last, record_id limit 100")
def f_search(spark, folder):
    return q.run(records(spark, folder), q.search(name="ocean", longer=100.0)).select("record_id", "name")


@query("select record_id, grossTonnage from vessel_records order by grossTonnage desc nulls last, record_id limit 25")
def l_sort_limit(spark, folder):
    return q.run(records(spark, folder), q.Query(sort_by="grossTonnage", ascending=False, limit=25, columns=("record_id", "grossTonnage")))


@query("select record_id, builtYear from vessel_records order by builtYear asc nulls last, record_id limit 20 offset 15")
def l_offset(spark, folder):
    return q.run(records(spark, folder), q.Query(sort_by="builtYear", limit=20, offset=15, columns=("record_id", "builtYear")))


@query("select flag, count(*) n from vessel_records where vessel_type = 'Container' and flag is not null group by 1 order by 1")
def q_count_by(spark, folder):
    return q.run(records(spark, folder), q.Query("aggregate", (q.Filter("vessel_type", "eq", "Container"),), group_by="flag"))


# --- predefined analytics and Cypher ----------------------------------------------------------------------------------


def _topic(name: str, message: str, sql: str) -> None:
    def run(spark, folder):
        return cy.predefined(records(spark, folder), message)

    run.__name__ = name
    query(sql)(run)


_TYPED = "vessel_type is not null and vessel_type <> ''"
_topic("q_tankers", "strategic tanker fleet", f"select name, flag, grossTonnage tonnage, vessel_type as type, record_id from vessel_records where {_TYPED} and contains(lower(vessel_type), 'tanker') and grossTonnage > 20000 order by grossTonnage desc, name nulls last, flag nulls last, type, record_id limit 50")
_topic("q_flag_types", "flag distribution", f"select flag, vessel_type as type, count(*) count from vessel_records where {_TYPED} group by 1, 2 order by count desc, flag nulls last, type nulls last limit 50")
_topic("q_oldest", "aging vessels", "select name, builtYear as year, grossTonnage tonnage, record_id from vessel_records where builtYear > 0 and builtYear < 2010 order by builtYear, name nulls last, tonnage nulls last, record_id limit 50")
_topic("q_largest", "mega vessels", f"select name, grossTonnage tonnage, flag, vessel_type as type, record_id from vessel_records where {_TYPED} and grossTonnage > 50000 order by grossTonnage desc, name nulls last, flag nulls last, type, record_id limit 50")
_topic("q_fleet", "fleet overview", "select count(*) total_vessels, round_even(avg(grossTonnage), 2) avg_tonnage, round_even(avg(builtYear), 2) avg_year from vessel_records")


def _statement(name: str, statement: str, sql: str) -> None:
    def run(spark, folder):
        return cy.cypher(records(spark, folder), statement)

    run.__name__ = name
    query(sql)(run)


_statement("q_modern", "MATCH (v:Vessel) WHERE v.built_year >= 2015 RETURN v.record_id AS record_id, v.built_year AS year", "select record_id, builtYear as year from vessel_records where builtYear >= 2015")
_statement("q_type_statistics", "MATCH (v:Vessel)-[:IS_TYPE]->(vt:VesselType) RETURN vt.name AS type, COUNT(*) AS n, AVG(v.length) AS avg_length, MAX(v.gross_tonnage) AS top ORDER BY n DESC", f"select vessel_type as type, count(*) n, round_even(avg(length), 2) avg_length, max(grossTonnage) top from vessel_records where {_TYPED} group by 1")
_statement("q_asia_pacific", "MATCH (v:Vessel) WHERE v.latitude >= -50 AND v.latitude <= 60 AND (v.longitude >= 90 OR v.longitude <= -150) RETURN v.record_id AS record_id", "select record_id from vessel_records where last_position_latitude between -50 and 60 and (last_position_longitude >= 90 or last_position_longitude <= -150)")
_statement("q_missing_attributes", "MATCH (v:Vessel) WHERE v.gross_tonnage IS NULL AND v.built_year IS NULL AND NOT (v.flag IS NULL OR v.name IS NULL) RETURN DISTINCT v.flag AS flag, v.name AS name", "select distinct flag, name from vessel_records where grossTonnage is null and builtYear is null and flag is not null and name is not null")
_statement("q_niche_types", "MATCH (v:Vessel)-[:IS_TYPE]->(vt:VesselType) WHERE vt.name IN ['Tug', 'Research Vessel', 'Dredger'] RETURN vt.name AS type, COUNT(DISTINCT v.imo) AS n", "select vessel_type as type, count(distinct imo) n from vessel_records where vessel_type in ('Tug', 'Research Vessel', 'Dredger') group by 1")


@query("select record_id from vessel_records where flag = 'LR'")
def q_language_flag(spark, folder):
    return q.run(records(spark, folder), language.parse("show vessels under flag LR")).select("record_id")


@query("select record_id from vessel_records where contains(lower(vessel_type), 'tanker')")
def q_language_type(spark, folder):
    return q.run(records(spark, folder), language.parse("all tanker vessels")).select("record_id")


@query("""select record_id, concat_ws(chr(10), 'Name: ' || name, 'IMO: ' || imo, 'MMSI: ' || mmsi, 'Flag: ' || flag, 'Type: ' || vessel_type, 'Gross tonnage: ' || format('{:,.0f}', grossTonnage) || ' GT', 'Deadweight: ' || format('{:,.0f}', deadweight) || ' t', 'Built: ' || builtYear,
 'Position: ' || cast(cast(last_position_latitude as decimal(10, 5)) as decimal(9, 4)) || ', ' || cast(cast(last_position_longitude as decimal(10, 5)) as decimal(9, 4))) details from vessel_records""")
def q_vessel_details(spark, folder):
    return language.details(records(spark, folder)).select("record_id", "details")


# --- ontology and graph -----------------------------------------------------------------------------------------------


_TREE = "(values " + ", ".join(f"('{t}', '{c}')" for c, types in ontology.CATEGORIES.items() for t in types) + ") t(type, category)"


@query(f"select coalesce(vessel_type, '') vessel_type, case when trim(coalesce(vessel_type, '')) = '' then '' else coalesce(category, 'Other') end category, count(*) n from vessel_records left join {_TREE} on vessel_type = t.type group by all")
def o_category(spark, folder):
    return records(spark, folder).groupBy(F.coalesce("vessel_type", F.lit("")).alias("vessel_type"), ontology.category_of(F.col("vessel_type")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select t.category, t.type, count(v.vessel_type) n from {_TREE} left join vessel_records v on v.vessel_type = t.type group by grouping sets ((t.category, t.type), (t.category))")
def o_tree_counts(spark, folder):
    """The ontology tree with its counts, zero rows and the totals of categories (type null)."""
    return graph.tree_counts(records(spark, folder))


_NODES_SQL = f"""values_ as (select 'imo_' || imo node_id, 'IMO' as label, cast(imo as varchar) as value from k where imo > 0 union select 'mmsi_' || mmsi, 'MMSI', cast(mmsi as varchar) from k where mmsi is not null union select 'flag_' || flag, 'Flag', flag from k where flag <> ''
 union select 'builder_' || md5(shipBuilder)[1:12], 'ShipBuilder', shipBuilder from k where shipBuilder <> '' union select case when coalesce(matchedPort_unlocode, '') <> '' then 'port_' || matchedPort_unlocode else 'port_' || md5(matchedPort_name)[1:12] end, 'Port', coalesce(matchedPort_unlocode, matchedPort_name) from k where coalesce(matchedPort_unlocode, matchedPort_name) <> ''
 union select 'type_' || md5(vessel_type)[1:12], 'VesselType', vessel_type from k where vessel_type <> '')"""
_K = f"k as (select *, {_KEY} entity from vessel_records where {_KEY} is not null)"


@query(f"with {_K}, {_NODES_SQL} select * from values_")
def g_value_nodes(spark, folder):
    return graph.value_nodes(records(spark, folder))


@query(f"""with {_K} select entity node_id, arg_min_null(imo, record_id) imo, arg_max(name, record_id) filter (where name <> '') as name, arg_max(length, record_id) filter (where length <> 0) as length, arg_max(flag, record_id) filter (where flag <> '') flag, arg_max(grossTonnage, record_id) filter (where grossTonnage <> 0) gross_tonnage,
 arg_max(builtYear, record_id) filter (where builtYear <> 0) built_year, count(*) records from k group by 1""")
def g_vessel_nodes(spark, folder):
    return graph.vessel_nodes(records(spark, folder), "record_id").select("node_id", "imo", "name", "length", "flag", "gross_tonnage", "built_year", "records")


_EDGES_SQL = """timed as (select distinct entity src, 'imo_' || imo dst, 'HAS_IMO' rel_type, UpdateDate ts from k where imo > 0 union select entity, 'mmsi_' || mmsi, 'USES_MMSI', UpdateDate from k where mmsi is not null union select entity, 'flag_' || flag, 'REGISTERED_UNDER', UpdateDate from k where flag <> ''
 union select entity, 'port_' || matchedPort_unlocode, 'VISITED', UpdateDate from k where matchedPort_unlocode <> '' and matchedPort_name <> ''),
 lasting as (select src, f.d dst, rel_type, f.t ts from (select entity src, 'IS_TYPE' rel_type, arg_min({'d': 'type_' || md5(vessel_type)[1:12], 't': UpdateDate}, record_id) f from k where vessel_type <> '' group by 1 union all select entity, 'BUILT_BY', arg_min({'d': 'builder_' || md5(shipBuilder)[1:12], 't': UpdateDate}, record_id) from k where shipBuilder <> '' group by 1)),
 edges_ as (select * from timed union all select * from lasting)"""


@query(f"with {_K}, {_EDGES_SQL} select src, dst, rel_type, ts from edges_")
def g_edges(spark, folder):
    return graph.edges(records(spark, folder), "UpdateDate", "record_id")


@query(f"with {_K}, {_EDGES_SQL} select src, ts from edges_ where rel_type = 'REGISTERED_UNDER' and dst = 'flag_LR'")
def g_vessels_by_flag(spark, folder):
    return graph.reached_by(graph.edges(records(spark, folder), "UpdateDate", "record_id"), "REGISTERED_UNDER", "flag_LR")


@query(f"with {_K}, {_EDGES_SQL} select src, ts from edges_ where rel_type = 'VISITED' and dst = (select min(dst) from edges_ where rel_type = 'VISITED')")
def g_vessels_by_port(spark, folder):
    visits = graph.edges(records(spark, folder), "UpdateDate", "record_id").where("rel_type = 'VISITED'")
    first = visits.agg(F.min("dst").alias("dst"))  # one row
    return visits.join(F.broadcast(first), "dst").select("src", "ts")


@query(f"with {_K}, {_EDGES_SQL} select src, count(distinct dst) n from edges_ where rel_type = 'VISITED' group by 1 having count(distinct dst) > 5")
def g_many_ports(spark, folder):
    return graph.many_targets(graph.edges(records(spark, folder), "UpdateDate", "record_id"), "VISITED", 5)


@query(f"with {_K}, {_EDGES_SQL} select v.node_id, l.dst type_id, 'category_' || md5(t.category)[1:12] category_id from (select distinct entity node_id from k) v left join (select src, dst from lasting where rel_type = 'IS_TYPE') l on v.node_id = l.src left join {_TREE} on l.dst = 'type_' || md5(t.type)[1:12]")
def g_typed_vessels(spark, folder):
    rows = records(spark, folder)
    return graph.with_type(graph.vessel_nodes(rows, "record_id"), graph.edges(rows, "UpdateDate", "record_id"), limit=None)


@query(f"""with e as (select record_id, {_KEY} entity_id, UpdateDate ts, unnest(['HAS_IMO', 'USES_MMSI', 'REGISTERED_UNDER', 'BUILT_BY', 'IS_TYPE']) rel_type,
 unnest([case when imo > 0 then 'imo_' || imo end, 'mmsi_' || mmsi, case when flag <> '' then 'flag_' || flag end, case when shipBuilder <> '' then 'builder_' || md5(shipBuilder)[1:12] end, case when vessel_type <> '' then 'type_' || md5(vessel_type)[1:12] end]) dst from vessel_records) select * from e where dst is not null""")
def g_record_entities(spark, folder):
    nested = graph.entities_of(records(spark, folder), "record_id", "UpdateDate")
    return nested.select("record_id", "entities.entity_id", "entities.ts", F.explode("entities.relations").alias("r")).select("record_id", "entity_id", "ts", "r.*")


@query(f"with {_K}, {_EDGES_SQL}, {_NODES_SQL} select distinct e.src, e.rel_type, e.dst, n.label, n.value from edges_ e join values_ n on e.dst = n.node_id where e.src in (select entity from k where flag = 'NO')")
def g_neighbourhood(spark, folder):
    rows = records(spark, folder)
    some = rows.where("flag = 'NO'").select(graph.entity_key().alias("node_id")).where("node_id is not null").distinct()
    return graph.neighbourhood(graph.edges(rows, "UpdateDate", "record_id"), graph.value_nodes(rows), some)


@query(f"with {_K}, {_EDGES_SQL}, {_NODES_SQL} select 'node' kind, label as name, count(*) n from values_ group by 2 union all select 'edge', rel_type, count(*) from edges_ group by 2")
def g_statistics(spark, folder):
    rows = records(spark, folder)
    return graph.statistics(graph.value_nodes(rows), graph.edges(rows, "UpdateDate", "record_id"))


def _faceted(spark, folder):
    rows = validate.with_status(records(spark, folder), validate.standard_rules(AS_OF))
    return rows.withColumn("category", ontology.category_of(F.col("vessel_type")))


_FACET_SQL = f"""with {_CHECKS}, st as (select record_id, case when bool_and(is_valid) then 'valid' else 'invalid' end validation_status from long group by 1),
 v as (select v.*, st.validation_status, case when trim(coalesce(vessel_type, '')) = '' then '' else coalesce(t.category, 'Other') end category from vessel_records v join st using (record_id) left join {_TREE} on v.vessel_type = t.type),
 e as (select unnest(['category', 'vessel_type', 'flag', 'validation_status', 'vessel_name']) facet, unnest([category, vessel_type, flag, validation_status, name]) choice, category from v)
select distinct facet, choice from e where choice <> ''"""


@query(_FACET_SQL)
def g_facets(spark, folder):
    return graph.facets(_faceted(spark, folder))


@query(_FACET_SQL + " and category = 'Tanker Vessels'")
def g_cascading_facets(spark, folder):
    return graph.facets(_faceted(spark, folder), category="Tanker Vessels")


@query("select node_id, count(*) n from (select record_id node_id from vessel_records) group by 1 having count(*) > 1")
def g_unique_records(spark, folder):
    return graph.broken_keys(records(spark, folder).select(F.col("record_id").alias("node_id")), "node_id").withColumnRenamed("count", "n")


# --- time -------------------------------------------------------------------------------------------------------------

_OBS = f"""obs as (select * from (select {_KEY} entity_id, unnest(['mmsi', 'flag', 'name']) attribute, unnest([cast(mmsi as varchar), flag, name]) as value, UpdateDate ts, record_id seq from vessel_records) where entity_id is not null and value is not null and ts is not null)"""
_W = "(partition by entity_id, attribute order by ts, seq)"
_RUNS = f"""marked as (select *, case when value is not distinct from lag(value) over {_W} then 0 else 1 end c from obs), numbered as (select *, sum(c) over (partition by entity_id, attribute order by ts, seq rows unbounded preceding) run from marked),
runs as (select entity_id, attribute, run, any_value(value) as value, min(ts) start_date, count(*) n from numbered group by 1, 2, 3), spans as (select *, lead(start_date) over (partition by entity_id, attribute order by run) end_date from runs)"""


def _obs(spark, folder):
    return temporal.observations(records(spark, folder), ATTRIBUTES, "UpdateDate", "record_id")


@query(f"with {_OBS} select entity_id, attribute, value, seq, ts valid_from, lead(ts) over {_W} valid_to from obs")
def t_intervals(spark, folder):
    return temporal.intervals(_obs(spark, folder))


@query(f"with {_OBS} select entity_id, attribute, ts, seq, lag(value) over {_W} old_value, value from obs")
def t_timeline(spark, folder):
    return temporal.timeline(_obs(spark, folder))


@query(f"with {_OBS}, {_RUNS}, placed as (select entity_id, attribute, run, min(place) place from (select *, row_number() over {_W} place from numbered) group by 1, 2, 3) select entity_id, attribute, value, start_date, end_date, n, place as run, lag(value) over (partition by entity_id, attribute order by run) old_value from spans join placed using (entity_id, attribute, run)")
def t_islands(spark, folder):
    return temporal.islands(_obs(spark, folder))


@query(f"with {_OBS}, i as (select *, lead(ts) over {_W} valid_to from obs) select entity_id, attribute, arg_min(value, seq) as value from i where ts <= timestamp '2024-01-01' and (valid_to is null or timestamp '2024-01-01' < valid_to) group by 1, 2")
def t_state_at(spark, folder):
    return temporal.state_at(temporal.intervals(_obs(spark, folder)), dt.datetime(2024, 1, 1))


@query(f"with {_OBS}, {_RUNS} select entity_id, attribute, arg_max(value, run) as value, round(least(1.0, 0.8::double + 0.05::double * (arg_max(n, run) - 1)), 4)::double confidence, arg_max(start_date, run) since from runs group by 1, 2")
def t_canonical(spark, folder):
    return temporal.canonical(temporal.islands(_obs(spark, folder)))


@query(f"with {_OBS}, {_RUNS}, f as (select entity_id, lag(value) over (partition by entity_id order by run) old_value, value, start_date changed_at from runs where attribute = 'flag') select * from f where old_value is not null")
def t_flag_changes(spark, folder):
    return temporal.changes(temporal.islands(_obs(spark, folder)), "flag")


@query(f"with {_OBS}, i as (select *, ts valid_from, lead(ts) over {_W} valid_to from obs), p as (select distinct {_KEY} entity_id, InsertDate probe_ts from vessel_records where {_KEY} is not null and InsertDate is not null) select p.entity_id, p.probe_ts, i.attribute, i.value, i.seq from p join i on p.entity_id = i.entity_id and i.valid_from <= p.probe_ts and (i.valid_to is null or p.probe_ts < i.valid_to)")
def t_states_for(spark, folder):
    probes = records(spark, folder).select(graph.entity_key().alias("entity_id"), F.col("InsertDate").alias("probe_ts")).where("entity_id is not null and probe_ts is not null").distinct()
    return temporal.states_for(temporal.intervals(_obs(spark, folder)), probes).select("entity_id", "probe_ts", "attribute", "value", "seq")


# --- resolution -------------------------------------------------------------------------------------------------------


def _pairs(spark, folder):
    tidy = lambda c: F.upper(F.trim(c))
    pairs = table(spark, folder, "entity_matches", "record_a_id", "record_b_id").select(F.least(tidy("record_a_id"), tidy("record_b_id")).alias("a"), F.greatest(tidy("record_a_id"), tidy("record_b_id")).alias("b"), F.col("record_a_id").isNotNull() & F.col("record_b_id").isNotNull()).toDF("a", "b", "ok").where("ok and a < b").select("a", "b").distinct()
    return resolve.side_by_side(pairs, records(spark, folder), "record_id")


def _scored(spark, folder):
    return resolve.classified(resolve.scored(_pairs(spark, folder)))


def _name_sql(a: str, b: str) -> str:
    x, y = f"upper(trim({a}))", f"upper(trim({b}))"
    words = lambda t: f"list_distinct(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> ''))"
    chars = _JACCARD.format(a=_CHARS.format(f"replace({x}, ' ', '')"), b=_CHARS.format(f"replace({y}, ' ', '')"))
    return f"case when {x} = {y} then 1.0 else round_even(0.4::double * ({chars}) + 0.4::double * ({_JACCARD.format(a=words(x), b=words(y))}) + 0.2::double * (case when contains({x}, {y}) or contains({y}, {x}) then 1 else 0 end), 4) end"


_PAIRS_SQL = """p as (select distinct least(upper(trim(record_a_id)), upper(trim(record_b_id))) a, greatest(upper(trim(record_a_id)), upper(trim(record_b_id))) b from entity_matches where record_a_id is not null and record_b_id is not null and upper(trim(record_a_id)) <> upper(trim(record_b_id))),
 j as (select p.a, p.b, x.imo ai, y.imo bi, x.name an, y.name bn, x.mmsi am, y.mmsi bm, x.length al, y.length bl, x.width aw, y.width bw, x.grossTonnage ag, y.grossTonnage bg, x.builtYear ay, y.builtYear by_, x.shipBuilder ab, y.shipBuilder bb from p join vessel_records x on p.a = x.record_id join vessel_records y on p.b = y.record_id)"""


def _scores(weights: dict[str, float], tolerance: float, names: str) -> str:
    near = lambda c: f"case when a{c} > 0 and b{c} > 0 then greatest(0.0, 1 - abs(a{c} - b{c}) / greatest(a{c}, b{c}) / {tolerance}::double) end"
    packed = lambda c: f"replace(upper({c}), ' ', '')"
    name = _name_sql if names == "full" else lambda x, y: f"round_even({_jaccard(packed(x), packed(y))}, 4)"
    s = {"imo": "case when ai > 0 and bi > 0 then (ai = bi)::int::double end", "name": f"case when an <> '' and bn <> '' then {name('an', 'bn')} end", "mmsi": "case when am <> 0 and bm <> 0 then (am = bm)::int::double end", "length": near("l"), "width": near("w"), "gross_tonnage": near("g"), "built_year": "case when ay <> 0 and by_ <> 0 then (ay = by_)::int::double end", "builder": f"case when ab <> '' and bb <> '' then {name('ab', 'bb')} end"}
    columns = ", ".join(f"{e} s{k}" for k, e in enumerate(s.values(), 1))
    of = {n: f"s{k}" for k, n in enumerate(s, 1)}
    top = " + ".join(f"coalesce({of[n]} * {w}::double, 0)" for n, w in weights.items())
    weight = " + ".join(f"(case when {of[n]} is null then 0::double else {w}::double end)" for n, w in weights.items())
    seen = " + ".join(f"({of[n]} is not null)::int" for n in weights)
    return f"""s as (select *, {columns} from j), w as (select *, {top} top, {weight} weight, {seen} seen, coalesce(ai > 0 and ai = bi, false) exact from s),
 o as (select *, case when exact then 1.0::double else round(cast(case when weight > 0 then top / weight else 0::double end as decimal(18, 10)), 4)::double end overall, case when exact then 1.0::double else round(cast((case when weight > 0 then top / weight else 0::double end) * seen / {len(weights)} as decimal(18, 10)), 4)::double end confidence from w)"""


_SCORES_SQL = _scores(resolve.WEIGHTS, 0.05, "full")


@query(f"with {_PAIRS_SQL} select a, b, {_name_sql('an', 'bn')} similarity from j where an <> '' and bn <> ''")
def r_name_similarity(spark, folder):
    return _pairs(spark, folder).where("a_name <> '' and b_name <> ''").select("a", "b", name_similarity(F.col("a_name"), F.col("b_name")).alias("similarity"))


@query(f"with {_PAIRS_SQL} select a, b, round_even({_jaccard('upper(an)', 'upper(bn)')}, 4) similarity from j where an <> '' and bn <> ''")
def r_char_similarity(spark, folder):
    return _pairs(spark, folder).where("a_name <> '' and b_name <> ''").select("a", "b", F.bround(char_jaccard(F.upper("a_name"), F.upper("b_name")), 4).alias("similarity"))


@query(f"with {_PAIRS_SQL}, {_SCORES_SQL} select a, b, overall, confidence from o")
def r_pair_scores(spark, folder):
    return _scored(spark, folder).select("a", "b", "overall", "confidence")


@query(f"with {_PAIRS_SQL}, {_scores(resolve.TOOL_WEIGHTS, 0.10, 'chars')} select a, b, overall, confidence from o")
def r_tool_scores(spark, folder):
    return resolve.scored(_pairs(spark, folder), resolve.TOOL_WEIGHTS, 0.10, "chars").select("a", "b", "overall", "confidence")


@query(f"with {_PAIRS_SQL}, {_scores(resolve.BASIC_WEIGHTS, 0.10, 'chars')} select a, b, overall, confidence from o")
def r_basic_scores(spark, folder):
    return resolve.scored(_pairs(spark, folder), resolve.BASIC_WEIGHTS, 0.10, "chars", conflict=0.5).select("a", "b", "overall", "confidence")


@query(f"""with {_PAIRS_SQL}, {_SCORES_SQL}, m as (select *, case when exact then 'exact_imo_match' when overall >= 0.9 then 'high_confidence' when overall >= 0.6 then 'probable_match' when overall >= 0.3 then 'uncertain' else 'no_match' end match_type from o)
select a, b, match_type, exact or overall >= 0.6 same_entity, not exact and (match_type in ('probable_match', 'uncertain') or (coalesce(ai > 0 and bi > 0 and ai <> bi, false) and am is not distinct from bm)) needs_review from m""")
def r_match_classes(spark, folder):
    return _scored(spark, folder).select("a", "b", "match_type", "same_entity", "needs_review")


@query("select record_id, imo class_id, count(*) over (partition by imo) - 1 n_links from vessel_records where imo > 0")
def r_exact_links(spark, folder):
    rows = records(spark, folder).where("imo > 0").select("record_id", F.col("imo").alias("class_id"))
    return rows.join(rows.groupBy("class_id").agg((F.count(F.lit(1)) - 1).alias("n_links")), "class_id")


_REPS_SQL = "reps as (select min(record_id) record_id, imo, name, mmsi, length, width, grossTonnage, builtYear, shipBuilder, vessel_type from vessel_records group by all)"
_DUPLICATES_SQL = f"""{_REPS_SQL}, blocks as (select record_id, unnest(list_concat([case when imo > 0 then 'i:' || imo end, 'm:' || mmsi, 't:' || vessel_type || ':' || builtYear], list_transform(list_distinct(list_filter(regexp_split_to_array(upper(trim(coalesce(name, ''))), '\\s+'), lambda w: length(w) >= 3)), lambda w: 'n:' || w))) block from reps),
 p as (select distinct x.record_id a, y.record_id b from blocks x join blocks y on x.block = y.block and x.record_id < y.record_id),
 j as (select p.a, p.b, x.imo ai, y.imo bi, x.name an, y.name bn, x.mmsi am, y.mmsi bm, x.length al, y.length bl, x.width aw, y.width bw, x.grossTonnage ag, y.grossTonnage bg, x.builtYear ay, y.builtYear by_, x.shipBuilder ab, y.shipBuilder bb from p join reps x on p.a = x.record_id join reps y on p.b = y.record_id)"""


@query(f"with {_DUPLICATES_SQL}, {_SCORES_SQL} select a, b, overall, confidence from o where overall > {resolve.DUPLICATE}::double")
def r_duplicates(spark, folder):
    """Duplicates among all records, not only the listed pairs; equal records are one here, r_equal_records has them."""
    found, _ = resolve.distinct_records(source.sanitised(records(spark, folder)), "record_id")
    return resolve.duplicates(found, "record_id").select("a", "b", "overall", "confidence")


@query(f"with {_REPS_SQL} select v.record_id as member, r.record_id representative from vessel_records v join reps r on " + " and ".join(f"v.{c} is not distinct from r.{c}" for c in (*resolve.COLUMNS, "vessel_type")))
def r_equal_records(spark, folder):
    return resolve.distinct_records(source.sanitised(records(spark, folder)), "record_id")[1]


@query(f"with {_PAIRS_SQL}, {_SCORES_SQL} select floor(overall * 10) / 10.0::double bin, count(*) total, count_if(coalesce(am = bm, false)) same, count_if(not coalesce(am = bm, false)) different from o group by 1")
def h_score_bins(spark, folder):
    return resolve.score_bins(_scored(spark, folder), "overall", F.coalesce(F.col("a_mmsi") == F.col("b_mmsi"), F.lit(False)))


@query(f"with {_PAIRS_SQL}, {_SCORES_SQL}, d as (select overall, coalesce(am = bm, false) same from o), r as (select overall, row_number() over (order by overall) - 1 k, count(*) over () n from d where same) select (select min(overall) from r where k = floor(0.1 * n)) high, ((select min(overall) from d where same) + (select max(overall) from d where not same)) / 2 review")
def h_learned_thresholds(spark, folder):
    return resolve.learned_thresholds(_scored(spark, folder), "overall", F.coalesce(F.col("a_mmsi") == F.col("b_mmsi"), F.lit(False)))


@query(f"""with {_PAIRS_SQL}, {_SCORES_SQL}, d as (select coalesce(am = bm, false) same, unnest(['imo', 'name', 'mmsi', 'length', 'width', 'gross_tonnage', 'built_year', 'builder']) attribute, unnest([s1, s2, s3, s4, s5, s6, s7, s8]) x from o),
g as (select attribute, abs(avg(x) filter (where same) - avg(x) filter (where not same)) gap from d where x is not null group by 1 having gap is not null) select attribute, round_even(gap / sum(gap) over (), 4) weight from g""")
def h_learned_weights(spark, folder):
    return resolve.learned_weights(_scored(spark, folder), "scores", F.coalesce(F.col("a_mmsi") == F.col("b_mmsi"), F.lit(False)))


@query(f"""with {_CHECKS}, {_PAIRS_SQL}, {_SCORES_SQL}, st as (select case when bool_and(is_valid) then 'records_valid' else 'records_invalid' end measure from long group by record_id), al as (select distinct rule_id, severity from long where not is_valid)
select measure, count(*) n from st group by 1 union all select 'sure_matches', count_if(overall >= 0.9) from o union all select 'alerts_' || severity, count(*) from al group by severity""")
def z_report(spark, folder):
    rows = validate.with_status(records(spark, folder), validate.standard_rules(AS_OF))
    return alerts.report(rows, _scored(spark, folder), alerts.rule_alerts(_long(spark, folder), "record_id"))


# --- further record queries -------------------------------------------------------------------------------------------


@query("select record_id, coalesce(cast(nullif(imo, 0) as varchar), cast(mmsi as varchar), record_id) record_key from vessel_records")
def r_record_key(spark, folder):
    return records(spark, folder).select("record_id", resolve.record_key("record_id").alias("record_key"))


@query(f"""with {_PAIRS_SQL}, {_SCORES_SQL}, m as (select *, case when exact then 'exact_imo_match' when overall >= 0.9 then 'high_confidence' when overall >= 0.6 then 'probable_match' when overall >= 0.3 then 'uncertain' else 'no_match' end match_type from o),
 l as (select *, list_filter([case when s1 > 0.9 then 'imo' end, case when s2 > 0.9 then 'name' end, case when s3 > 0.9 then 'mmsi' end, case when s4 > 0.9 then 'length' end, case when s5 > 0.9 then 'width' end, case when s6 > 0.9 then 'gross_tonnage' end, case when s7 > 0.9 then 'built_year' end, case when s8 > 0.9 then 'builder' end], lambda x: x is not null) good,
  list_filter([case when s1 < 0.3 then 'imo' end, case when s2 < 0.3 then 'name' end, case when s3 < 0.3 then 'mmsi' end, case when s4 < 0.3 then 'length' end, case when s5 < 0.3 then 'width' end, case when s6 < 0.3 then 'gross_tonnage' end, case when s7 < 0.3 then 'built_year' end, case when s8 < 0.3 then 'builder' end], lambda x: x is not null) bad from m)
select a, b, array_to_string(good, ',') matching, array_to_string(bad, ',') conflicting, 'Resolution type: ' || match_type || '|' || printf('Overall similarity: %.2f%%', overall * 100) || '|' || printf('Confidence: %.2f%%', confidence * 100) || case when exact then '|IMO match: ' || ai else '' end
 || case when len(good) > 0 then '|Matching attributes: ' || array_to_string(good, ', ') else '' end || case when len(bad) > 0 then '|Conflicting attributes: ' || array_to_string(bad, ', ') else '' end evidence from l""")
def r_evidence(spark, folder):
    return joined(_scored(spark, folder).select("a", "b", "matching", "conflicting", F.array_join("evidence", "|").alias("evidence")), "matching", "conflicting")


@query(f"""with {_PAIRS_SQL}, {_SCORES_SQL}, m as (select *, not exact and overall >= 0.3 and overall < 0.9 or (not exact and coalesce(ai > 0 and bi > 0 and ai <> bi, false) and am is not distinct from bm) needs, round_even(least(1.0::double, 0.5::double + case when not exact and overall >= 0.3 and overall < 0.6 then 0.2::double else 0.0::double end + case when coalesce(ai > 0 and bi > 0, false) then 0.15::double else 0.0::double end + case when coalesce(ai <> bi, false) and am is not distinct from bm then 0.25::double else 0.0::double end), 4)::double priority from o)
select a, b, priority from m where needs order by priority desc, a, b limit 10""")
def h_most_pressing(spark, folder):
    """The ten pairs that most need a reviewer."""
    return _scored(spark, folder).where("needs_review").select("a", "b", resolve.review_priority().alias("priority")).orderBy(F.col("priority").desc(), "a", "b").limit(10)


_DECIDED_SQL = "q as (select match_id, confidence_score s from entity_matches where requires_review and confidence_score is not null), d as (select match_id decision_id, match_type decision, confidence_score s from entity_matches where not requires_review and confidence_score is not null order by match_id desc limit 100), n as (select q.match_id id, d.decision_id, d.decision, d.s, row_number() over (partition by q.match_id order by d.s desc, d.decision_id) as rank from q join d on abs(q.s - d.s) < 0.1), k as (select * from n where rank <= 5)"


def _similar(spark, folder):
    matches = table(spark, folder, "entity_matches").where("confidence_score is not null")
    queue = matches.where("requires_review").select(F.col("match_id").alias("id"), F.col("confidence_score").alias("score"))
    decided = matches.where("not requires_review").select(F.col("match_id").alias("decision_id"), F.col("match_type").alias("decision"), F.col("confidence_score").alias("score"), F.col("confidence_score").alias("confidence"), F.col("match_id").alias("decided_at"))
    return resolve.similar_decisions(queue, decided)


@query(f"with {_DECIDED_SQL} select id, decision_id, decision, rank::int as rank from k")
def h_similar_decisions(spark, folder):
    return _similar(spark, folder).select("id", "decision_id", "decision", "rank")


@query(f"with {_DECIDED_SQL}, c as (select id, decision, count(*) n from k group by 1, 2), r as (select *, round_even(n / sum(n) over (partition by id)::double, 4) share, row_number() over (partition by id order by n desc, decision) p from c) select id, decision, share from r where p = 1")
def h_suggested_decisions(spark, folder):
    return resolve.suggested_decision(_similar(spark, folder))


@query(f"select 'type_' || md5(type)[1:12] src, 'category_' || md5(category)[1:12] dst, 'BELONGS_TO_CATEGORY' rel_type from {_TREE}")
def g_category_edges(spark, folder):
    return graph.category_edges(spark).drop("ts")


_NODE_SQL = ", ".join(f"{c} as {n}" for n, c in graph.PROPERTIES.items())


@query(f"with {_CHECKS}, st as (select record_id, case when bool_and(is_valid) then 'valid' else 'invalid' end validation_status from long group by 1) select v.record_id, {_KEY} node_id, {_NODE_SQL}, validation_status from vessel_records v join st using (record_id) where {_KEY} is not null")
def g_vessel_properties(spark, folder):
    """Errors are compared by v_record_errors."""
    return graph.vessel_properties(validate.with_status(records(spark, folder), validate.standard_rules(AS_OF)), "record_id").drop("validation_errors")


@query(f"""with {_CHECKS}, st as (select record_id, case when bool_and(is_valid) then 'valid' else 'invalid' end validation_status from long group by 1), k as (select v.*, {_KEY} node_id, validation_status from vessel_records v join st using (record_id) where {_KEY} is not null),
 l as (select node_id, arg_max(validation_status, record_id) status, arg_max(vessel_type, record_id) filter (where vessel_type <> '') as type from k group by 1)
select 'vessels' kind, 'total' as name, count(*) n from l union all select 'status', status, count(*) from l group by 2 union all select 'type', type, count(*) from l where type is not null group by 2""")
def g_vessel_statistics(spark, folder):
    return graph.vessel_statistics(validate.with_status(records(spark, folder), validate.standard_rules(AS_OF)), "record_id")


@query(f"with {_K}, {_NODES_SQL} select * from values_")
def g_merged_nodes(spark, folder):
    """The value nodes of records without source, written as a graph and read again, with those of all others merged in."""
    rows = records(spark, folder)
    place = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    graph.write_graph(graph.value_nodes(rows.where("source is null")), graph.edges(rows, "UpdateDate", "record_id"), place)
    written = spark.read.schema("node_id string, value string, label string").parquet(f"{place}/nodes")
    return graph.merged_nodes(written, graph.value_nodes(rows.where("source is not null")))


_POSITION_SQL = f"p as (select {_KEY} entity_id, cast(last_position_latitude as decimal(10, 5)) || ' ' || cast(last_position_longitude as decimal(10, 5)) as value, UpdateDate ts, record_id seq from vessel_records), obs as (select * from p where entity_id is not null and value is not null and ts is not null)"


@query(f"with {_POSITION_SQL} select entity_id, 'position' attribute, value, seq, ts valid_from, lead(ts) over (partition by entity_id order by ts, seq) valid_to from obs")
def t_positions(spark, folder):
    """Positions as a state over time."""
    five = lambda c: F.col(c).cast("decimal(10, 5)").cast("string")
    rows = records(spark, folder).withColumn("position", F.concat(five("last_position_latitude"), F.lit(" "), five("last_position_longitude")))
    return temporal.intervals(temporal.observations(rows, {"position": "position"}, "UpdateDate", "record_id"))


@query(f"with {_OBS}, {_RUNS}, l as (select entity_id, attribute, arg_max(value, run) as value, count(*) n from runs group by 1, 2) select entity_id, string_agg(attribute || '=' || value, '|' order by attribute) as current, sum(n)::bigint n_runs from l group by 1")
def t_entities(spark, folder):
    nested = temporal.canonical_entities(temporal.islands(_obs(spark, folder)))
    return nested.select("entity_id", F.array_join(F.transform(F.array_sort(F.map_entries("current")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("current"), "n_runs")


_lookups = {"f_by_imo": (q.by_imo(9528574), "imo = 9528574"), "f_by_mmsi": (q.by_mmsi(200000000), "mmsi = 200000000"), "f_by_name": (q.by_name("star"), "contains(lower(name), 'star')"), "f_by_flag": (q.by_flag("lr"), "flag = 'LR'")}
for _name, (_query, _where) in _lookups.items():

    def _lookup(spark, folder, wanted=_query):
        return q.run(records(spark, folder), wanted).select("record_id")

    _lookup.__name__ = _name
    query(f"select record_id from vessel_records where {_where}")(_lookup)


@query(f"with {_OBS.replace('from vessel_records', chr(39).join(['from vessel_records where flag = ', 'LR', '']))}, {_RUNS} select entity_id, attribute, value, start_date, end_date from spans")
def q_history(spark, folder):
    """History of the vessels' records under one flag."""
    return q.run(records(spark, folder), q.Query("history", (q.Filter("flag", "eq", "LR"),)))


@query("select record_id, builtYear, (select count(*) from vessel_records where builtYear >= 2000) total_count from vessel_records where builtYear >= 2000 order by builtYear, record_id limit 25")
def l_page(spark, folder):
    return q.page(records(spark, folder), q.Query(filters=(q.Filter("builtYear", "gte", 2000),), sort_by="builtYear", limit=25, columns=("record_id", "builtYear")))


@query("select imo, mmsi, nullif(trim(name), '') as name, nullif(trim(callsign), '') callsign, length, builtYear, nullif(trim(flag), '') flag, last_position_latitude, last_position_updateTimestamp, eta, UpdateDate, nullif(trim(aisClass), '') aisClass from vessel_records")
def s_csv_round_trip(spark, folder):
    """The records written as CSV and read again by the explicit schema."""
    place = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    source.write_csv(records(spark, folder), place)
    return source.read_csv(spark, place).select("imo", "mmsi", "name", "callsign", "length", "builtYear", "flag", "last_position_latitude", "last_position_updateTimestamp", "eta", "UpdateDate", "aisClass")
