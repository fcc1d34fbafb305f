"""Dataset profiles and cross-record findings, each in as few passes as it takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.text import char_jaccard, tidy_name

#: Names without letters, with signs beyond ASCII or with brackets and bars (fixed pattern).
GARBLED = r"^[\W\d\s]+$|[^\x00-\x7F]|[<>{}|\\`]"


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, non_null, n_null, null_pct, n_distinct) of ``columns``; one aggregation, then turned to rows."""
    rows = df.agg(F.count(F.lit(1)).alias("_n"), *[F.struct(F.count(c).alias("a"), F.count_distinct(c).alias("d")).alias(c) for c in columns])
    long = rows.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}.a").alias("non_null"), F.col(f"{c}.d").alias("n_distinct")) for c in columns])).alias("e"))
    missing = F.col("_n") - F.col("e.non_null")
    return long.select("e.column_name", "e.non_null", missing.alias("n_null"), F.coalesce(F.bround(F.try_divide(missing * 100.0, F.col("_n")), 2), F.lit(0.0)).alias("null_pct"), "e.n_distinct")


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_null, null_pct, non_null), most missing first."""
    return column_profile(df, columns).select("column_name", "n_null", "null_pct", "non_null").orderBy(F.col("null_pct").desc(), "column_name")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one in all columns; nulls equal each other."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def duplicate_keys(df: DataFrame, key: Column, name: str) -> DataFrame:
    """(key_name, duplicated_keys, affected_rows) of a key that is null for rows to be left out."""
    many = df.select(key.alias("k")).where("k is not null").groupBy("k").count().where("count > 1")
    return many.agg(F.lit(name).alias("key_name"), F.count(F.lit(1)).alias("duplicated_keys"), F.coalesce(F.sum("count"), F.lit(0)).alias("affected_rows"))


def duplicate_key_report(df: DataFrame) -> DataFrame:
    """Duplicated IMO numbers above 0, MMSI numbers and tidy names."""
    name = tidy_name(F.col("name"))
    keys = {"imo": F.when(F.col("imo") > 0, F.col("imo")), "mmsi": F.col("mmsi"), "name": F.when(name != "", name)}
    out = None
    for n, k in keys.items():
        one = duplicate_keys(df, k, n)
        out = one if out is None else out.unionByName(one)
    return out


def top_duplicates(df: DataFrame, key: Column, limit: int = 10) -> DataFrame:
    """(key, n): the most repeated keys, ties by key."""
    return df.select(key.alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.col("n").desc(), "key").limit(limit)


#: Values that a report lists of one key, the least first; the number of all stands beside them.
LISTED = 50


def _listed(rows: DataFrame, key: str, column: str, most: int = LISTED) -> DataFrame:
    """(key, <column>_values, <column>_n): the first ``most`` distinct values of each key and how many there are.

    Values become distinct before anything is listed, and the rank's limit is applied before the shuffle as well, so no
    key, however frequent, has a long list in any task.
    """
    each = rows.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count(F.lit(1)).alias("_c"))
    counts = each.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias(f"{column}_n"))
    first = each.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(column))).where(F.col("_rank") <= most)
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list(column)).alias(f"{column}_values"))
    return lists.join(counts, F.col(key) == F.col("_key")).drop("_key")


def variation(df: DataFrame, key: str, columns: list[str], limit: int | None = 20, more_than: int = 1, first: tuple[str, str] | None = None) -> DataFrame:
    """(key, n_distinct, <c>_values..., n_rows): keys whose first column of ``columns`` has more than ``more_than`` values.

    ``limit`` keeps the lowest keys (it is the report's feature); None keeps all. Each list has ``LISTED`` values at most.
    ``first`` (column, order) adds first_<column>: its value in the earliest row that has one.
    """
    head = columns[0]
    rows = df.where(F.col(key).isNotNull() & ((F.col(key) > 0) if key == "imo" else F.lit(True)))
    early = [F.min_by(first[0], F.when(F.col(first[0]).isNotNull(), F.col(first[1]))).alias(f"first_{first[0]}")] if first else []
    found = rows.groupBy(key).agg(F.count_distinct(head).alias("n_distinct"), F.count(F.lit(1)).alias("n_rows"), *early).where(F.col("n_distinct") > more_than)
    found = found.orderBy(key).limit(limit) if limit else found
    for c in columns:
        of = _listed(rows.join(found.select(key), key, "left_semi"), key, c).drop(f"{c}_n")
        found = found.join(of, key, "left")
    return found


def varying_keys(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column_name, n_keys): for each column the number of keys that have more than one value of it."""
    rows = df.where(F.col(key).isNotNull() & ((F.col(key) > 0) if key == "imo" else F.lit(True)))
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    long = rows.select(key, F.explode(each).alias("e")).select(key, "e.*").where("value is not null").distinct()
    many = long.groupBy("column_name", key).count()
    return many.groupBy("column_name").agg(F.count_if(F.col("count") > 1).alias("n_keys"))


def identifier_conflicts(df: DataFrame) -> DataFrame:
    """(direction, key, conflicting, n_values, n_rows): IMO numbers with several MMSI numbers and the reverse; the first
    ``LISTED`` values of each."""
    rows = df.where((F.col("imo") > 0) & F.col("mmsi").isNotNull())
    out = None
    for direction, key, other in (("imo_to_mmsi", "imo", "mmsi"), ("mmsi_to_imo", "mmsi", "imo")):
        n = rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
        many = _listed(rows, key, other).where(F.col(f"{other}_n") > 1)
        one = many.join(n, F.col(key) == F.col("key")).select(F.lit(direction).alias("direction"), "key", F.col(f"{other}_values").alias("conflicting"), F.col(f"{other}_n").alias("n_values"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def identifier_switching(df: DataFrame, key: str, other: str, more_than: int, scale: int) -> DataFrame:
    """(key, found_values, n_values, confidence): keys with more than ``more_than`` values of ``other``; confidence grows
    to 1. The first ``LISTED`` values are listed."""
    rows = df.where((F.col("imo") > 0) & F.col("mmsi").isNotNull())
    n = F.col(f"{other}_n")
    return _listed(rows, key, other).where(n > more_than).select(key, F.col(f"{other}_values").alias("found_values"), n.cast("int").alias("n_values"), F.bround(F.least(F.lit(1.0), n / F.lit(float(scale))), 4).alias("confidence"))


def inconsistent_attributes(df: DataFrame, numbers: list[str], kinds: list[str], tolerance: float = 0.1) -> DataFrame:
    """(imo, attribute, variation_pct, n_values, confidence): attributes that should be stable but are not.

    Numbers vary by (max - min) / max above ``tolerance``; others by having several values. All attributes go through
    one aggregation of long rows.
    """
    fields = [F.struct(F.lit(c).alias("attribute"), F.col(c).cast("double").alias("number"), F.col(c).cast("string").alias("kind")) for c in numbers]
    fields += [F.struct(F.lit(c).alias("attribute"), F.lit(None).cast("double").alias("number"), F.col(c).cast("string").alias("kind")) for c in kinds]
    long = df.where(F.col("imo") > 0).select("imo", F.explode(F.array(*fields)).alias("f")).select("imo", "f.*").where("kind is not null")
    agg = long.groupBy("imo", "attribute").agg(F.max("number").alias("hi"), F.min("number").alias("lo"), F.count_distinct("kind").alias("n_values"))
    change = F.try_divide(F.col("hi") - F.col("lo"), F.when(F.col("hi") > 0, F.col("hi")))
    number = F.col("attribute").isin(numbers)
    out = agg.where((number & (change > tolerance)) | (~number & (F.col("n_values") > 1)))
    return out.select("imo", "attribute", F.when(number, F.bround(change * 100, 2)).alias("variation_pct"), "n_values", F.when(number, F.bround(F.least(F.lit(1.0), change), 4)).otherwise(F.lit(0.7)).alias("confidence"))


def suspicious_name_changes(df: DataFrame, below: float = 0.3) -> DataFrame:
    """(imo, name_a, name_b, similarity): different names of one IMO number that share too few characters.

    Pairs are made of distinct names within an IMO number, never of rows; names are ordered, so each pair stands once.
    """
    names = df.where((F.col("imo") > 0) & (tidy_name(F.col("name")) != "")).select("imo", tidy_name(F.col("name")).alias("n")).distinct()
    pairs = names.select("imo", F.col("n").alias("name_a")).join(names.select("imo", F.col("n").alias("name_b")), "imo").where("name_a < name_b")
    return pairs.withColumn("similarity", F.bround(char_jaccard(F.col("name_a"), F.col("name_b")), 4)).where(F.col("similarity") < below)


def value_distribution(df: DataFrame, column: str, limit: int | None = 20) -> DataFrame:
    """(value, n) of a column, most frequent first, ties by value; nulls don't count."""
    out = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.col("n").desc(), "value").limit(limit) if limit else out


def garbled_names(df: DataFrame) -> DataFrame:
    """Distinct names that look garbled."""
    return df.where(F.col("name").isNotNull()).select("name").distinct().where(F.col("name").rlike(GARBLED))


def position_coverage(df: DataFrame) -> DataFrame:
    """(coverage_pct, invalid_coordinates): share of rows with both coordinates, and rows with one out of range."""
    lat, lon = F.col("last_position_latitude"), F.col("last_position_longitude")
    both = lat.isNotNull() & lon.isNotNull()
    return df.agg(F.bround(F.try_divide(F.count_if(both) * 100.0, F.count(F.lit(1))), 2).alias("coverage_pct"), F.count_if(~lat.between(-90, 90) | ~lon.between(-180, 180)).alias("invalid_coordinates"))


def id_quality(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("imo") == 0).alias("imo_zero"), F.count_if(F.col("imo").isNull()).alias("imo_null"), F.count_if(F.col("mmsi").isNull()).alias("mmsi_null"))


def dataset_statistics(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(f"unique_{c}") for c in ("imo", "mmsi", "flag", "vessel_type")])


def above_percentile(df: DataFrame, column: str, q: float, key: str, limit: int = 10) -> DataFrame:
    """The first ``limit`` rows by key whose value is above the exact ``q`` percentile; a value that one row holds is joined."""
    cut = df.agg(F.percentile(column, q).alias("cutoff"))
    return df.join(F.broadcast(cut), F.col(column) > F.col("cutoff")).orderBy(key).limit(limit)


def anomalies(df: DataFrame) -> DataFrame:
    """(anomaly_type, imo, confidence) of all detectors together."""
    names = suspicious_name_changes(df).select(F.lit("suspicious_name_change").alias("anomaly_type"), "imo", (1 - F.col("similarity")).alias("confidence"))
    switching = identifier_switching(df, "imo", "mmsi", 2, 5).select(F.lit("mmsi_switching"), "imo", "confidence")
    reuse = identifier_switching(df, "mmsi", "imo", 1, 3).select(F.lit("mmsi_reuse"), F.get("found_values", F.lit(0)), "confidence")
    stable = inconsistent_attributes(df, ["grossTonnage", "length", "width"], ["builtYear", "shipBuilder"]).select(F.lit("attribute_inconsistency"), "imo", "confidence")
    speed = df.where(F.col("last_position_speed") > 50).select(F.lit("unrealistic_speed"), "imo", F.lit(0.8))
    return names.union(switching).union(reuse).union(stable).union(speed)
