"""Column profiles from Parquet: footers where they settle the matter, data pages of single chunks for the rest.

The unit is the column chunk of one row group. What its footer proves (rows, nulls, extremes, one value throughout) is
taken from there; only chunks whose footer is not enough are read, each by itself, texts as dictionary codes. If facts
are wanted by group (a load), a row group counts as settled only where its footer proves one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_CHUNK = "file string, row_group int, column_name string, rows long, nulls long, low double, high double, low_text string, high_text string, one string, alone boolean, of string"
_FACT = "of string, column_name string, rows long, nulls long, low double, high double, low_text string, high_text string"
_COUNT = "of string, column_name string, value string, n long"
#: Rows of a chunk that are decoded at once.
ROWS_AT_ONCE = 1 << 18


def _arrow(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _open(uri: str, dictionary: list[str] | None = None):
    """A Parquet file named by Spark, on any file system that Arrow knows."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if uri.startswith("file:"):
        return pq.ParquetFile("/" + uri.removeprefix("file:").lstrip("/"), read_dictionary=dictionary)
    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return pq.ParquetFile(path, filesystem=system, read_dictionary=dictionary)


def _proved(chunk) -> dict:
    """What a chunk's footer proves. Extremes of texts only up to 16 bytes, as writers may shorten longer ones."""
    import datetime as dt
    import math

    s = chunk.statistics
    out = {"nulls": s.null_count if s is not None and s.has_null_count else None}
    if s is None or not s.has_min_max:
        return out
    low, high = s.min, s.max
    if isinstance(low, bool):
        return out
    if isinstance(low, (int, float)):
        if not (math.isnan(low) or math.isnan(high)):
            out |= {"low": float(low), "high": float(high)}
        # Floating chunks may hold NaN that no footer tells, so only whole numbers prove one value.
        one = str(low) if isinstance(low, int) and low == high else None
    elif isinstance(low, dt.datetime):
        low, high = (x.isoformat(" ", "microseconds")[:26] for x in (low, high))
        out |= {"low_text": low, "high_text": high}
        one = low if low == high else None
    elif isinstance(low, str) and len(low.encode()) <= 16 and len(high.encode()) <= 16:
        out |= {"low_text": low, "high_text": high}
        one = low if low == high else None
    else:
        return out
    return out | {"one": one if out["nulls"] == 0 else None}


def chunks(spark: SparkSession, path: str, group: str | None, columns: list[str]) -> DataFrame:
    """One row for each column chunk, read from the footers by tasks; what a footer doesn't prove is null.

    Extremes of numbers are in low and high, those of texts and times (with microseconds) in low_text and high_text.
    ``one`` is the value, as text, that the chunk holds throughout; ``alone`` tells that the row group holds one group,
    ``of``, or that no group is asked for. A column that a file lacks is a chunk of nulls.
    """
    # A scan of names alone: no content is read, and tasks grow in number with the bytes of the files.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    names = [c.split()[0] for c in _CHUNK.split(", ")]

    schema = _arrow(_CHUNK)

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                meta = _open(uri).metadata
                for g in range(meta.num_row_groups):
                    row_group = meta.row_group(g)
                    proved = {row_group.column(k).path_in_schema: _proved(row_group.column(k)) for k in range(row_group.num_columns)}
                    of = proved.get(group, {}).get("one") if group else None
                    for c in columns:
                        known = proved.get(c, {"nulls": row_group.num_rows})
                        out.append({"file": uri, "row_group": g, "column_name": c, "rows": row_group.num_rows, **known, "alone": group is None or of is not None, "of": of})
            yield pa.RecordBatch.from_pylist(out, schema).select(names)

    # Chunks are spread before any is read: the files of a small table may all lie in a few of the scan's tasks.
    tasks = max(spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions())
    return files.mapInArrow(read, _CHUNK).repartition(tasks, "file", "row_group", "column_name")


def _from_chunks(found: DataFrame, group: str | None, wide: bool) -> DataFrame:
    """The facts (``wide``) or value counts of chunks: from the footer where it settles them, else from the chunk's pages.

    A chunk is decoded ``ROWS_AT_ONCE`` rows at a time, so counts and facts come in parts that the caller adds up.
    """
    schema = _arrow(_FACT if wide else _COUNT)

    def settled(r: dict) -> bool:
        if not r["alone"] or r["nulls"] is None:
            return False
        empty = r["nulls"] == r["rows"]
        return empty or (r["low"] is not None or r["low_text"] is not None if wide else r["one"] is not None)

    def text(a):
        import pyarrow as pa

        return (a.cast(pa.timestamp("us")) if pa.types.is_timestamp(a.type) else a).cast(pa.string())

    def read(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for r in batch.to_pylist():
                c = r["column_name"]
                if settled(r):
                    done = {"of": r["of"], "column_name": c, "rows": r["rows"], "n": r["rows"], "value": r["one"], **{k: r[k] for k in ("nulls", "low", "high", "low_text", "high_text")}}
                    yield pa.RecordBatch.from_pylist([{k: done[k] for k in schema.names}], schema)
                    continue
                keyed = not r["alone"]
                for part in _open(r["file"], [c]).iter_batches(ROWS_AT_ONCE, [r["row_group"]], [group, c] if keyed else [c]):
                    v = part.column(part.schema.get_field_index(c))
                    words = None
                    if pa.types.is_dictionary(v.type) and not wide:
                        words, v = v.dictionary, v.indices
                    elif pa.types.is_dictionary(v.type):
                        v = v.dictionary_decode()
                    if pa.types.is_floating(v.type):
                        v = pc.add(v, pa.scalar(0.0, v.type))  # one zero
                    of = part.column(part.schema.get_field_index(group)) if keyed else pa.nulls(len(v), pa.int8())
                    t = pa.table({"of": of, "v": v})
                    if wide:
                        good = pc.if_else(pc.is_nan(v), None, v) if pa.types.is_floating(v.type) else v
                        got = t.append_column("g", good).group_by("of").aggregate([("v", "count"), ("g", "min"), ("g", "max"), ([], "count_all")])
                        number = pa.types.is_floating(v.type) or pa.types.is_integer(v.type) or pa.types.is_decimal(v.type)
                        ends = [got["g_min"], got["g_max"]]
                        none = pa.nulls(len(got))
                        cols = {"rows": got["count_all"], "nulls": pc.subtract(got["count_all"], got["v_count"])}
                        cols |= dict(zip(("low", "high"), [e.cast(pa.float64()) for e in ends] if number else [none, none], strict=True))
                        cols |= dict(zip(("low_text", "high_text"), [none, none] if number else [text(e) for e in ends], strict=True))
                    else:
                        got = t.group_by(["of", "v"]).aggregate([([], "count_all")])
                        value = got["v"].combine_chunks()
                        cols = {"value": words.take(value).cast(pa.string()) if words is not None else text(value), "n": got["count_all"]}
                    name = pa.array([c] * len(got), pa.string())
                    whose = text(got["of"].combine_chunks()) if keyed else pa.array([r["of"]] * len(got), pa.string())
                    made = pa.table({"of": whose, "column_name": name, **cols}).select(schema.names).cast(schema)
                    yield from made.combine_chunks().to_batches()

    return found.mapInArrow(read, _FACT if wide else _COUNT)


def value_counts(spark: SparkSession, path: str, group: str | None, columns: list[str]) -> DataFrame:
    """(group, column_name, value, n): how often each value (as text; null for null) stands in each group's rows.

    Without ``group`` the whole table is one. Rows of a null group have a null group.
    """
    counts = _from_chunks(chunks(spark, path, group, columns), group, False)
    by = [F.col("of").cast(dict(spark.read.parquet(path).dtypes)[group]).alias(group)] if group else []
    return counts.groupBy(*by, "column_name", "value").agg(F.sum("n").alias("n"))


def facts(spark: SparkSession, path: str, group: str | None, columns: list[str]) -> DataFrame:
    """(group, column_name, n_rows, n_null, low, high, low_text, high_text) of ``columns``: rows, nulls and extremes.

    Extremes of numbers are in low and high, NaN left out; those of texts and times in low_text and high_text.
    """
    found = _from_chunks(chunks(spark, path, group, columns), group, True)
    by = [F.col("of").cast(dict(spark.read.parquet(path).dtypes)[group]).alias(group)] if group else []
    ends = [f(c).alias(c) for c, f in (("low", F.min), ("high", F.max), ("low_text", F.min), ("high_text", F.max))]
    return found.groupBy(*by, "column_name").agg(F.sum("rows").alias("n_rows"), F.sum("nulls").alias("n_null"), *ends)


def profile(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``facts`` of the whole table with ``n_distinct``, the number of distinct non-null values of each column."""
    kinds = value_counts(spark, path, None, columns).groupBy("column_name").agg(F.count("value").alias("n_distinct"))
    return facts(spark, path, None, columns).join(kinds, "column_name")


def shares(counts: DataFrame, group: str, blank: Column, good: Column) -> DataFrame:
    """(group, column_name, null_share, bad_share, distinct_share, least) from value counts; shares of nothing are null.

    ``blank`` tells values that count as null, ``good`` well-formed ones; null counts as blank. ``least`` is the least
    value as text.
    """
    kind = F.when(F.coalesce(F.col("value").isNull() | blank, F.lit(True)), 0).when(F.coalesce(good, F.lit(False)), 1).otherwise(2)
    # What a value is gets settled before the sums, once a value.
    seen = counts.select(group, "column_name", "value", "n", kind.alias("kind"))
    n, k = F.col("n"), F.col("kind")
    sums = seen.groupBy(group, "column_name", "kind").agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("values"), F.min("value").alias("least"))
    of = lambda c, *kinds: F.sum(F.when(k.isin(*kinds), F.col(c)).otherwise(0))
    there = of("n", 1, 2)
    return sums.groupBy(group, "column_name").agg(
        F.try_divide(of("n", 0), F.sum(n)).alias("null_share"), F.try_divide(of("n", 2), there).alias("bad_share"), F.try_divide(of("values", 1, 2), there).alias("distinct_share"), F.min("least").alias("least"),
    )


def quantiles(counts: DataFrame, group: str, fractions: dict[str, float], steps: int = 4096) -> DataFrame:
    """(group, and one column a fraction): linearly interpolated quantiles of ``value`` (double, no nulls or NaN) with
    multiplicity ``n``.

    Values fall into buckets, ``steps`` for each doubling of their size, so no outlier spoils the width of others'.
    Running totals over buckets find those that hold a wanted rank, and only their values are put in order: no task
    orders a whole group.
    """
    v = F.col("value")
    size = F.floor(F.log2(F.abs(v)) * steps).cast("long") + 1100 * steps
    bucket = F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)
    placed = counts.select(group, v, "n", bucket.alias("bucket"))
    totals = placed.groupBy(group, "bucket").agg(F.sum("n").alias("held"))
    own = W.partitionBy(group)
    upto = F.sum("held").over(own.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    totals = totals.withColumns({"before": upto - F.col("held"), "all": F.sum("held").over(own)})
    at = {name: F.lit(q) * (F.col("all") - 1) for name, q in fractions.items()}
    wanted = [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), f(x).cast("long").alias("rank"), x.alias("at")) for name, x in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    inside = F.filter(F.array(*wanted), lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("held")))
    hits = totals.withColumn("wanted", inside).where(F.size("wanted") > 0).select(F.col(group).alias("_g"), F.col("bucket").alias("_b"), "before", "wanted")
    near = placed.join(hits, F.col(group).eqNullSafe(F.col("_g")) & (F.col("bucket") == F.col("_b")))
    upto = F.col("before") + F.sum("n").over(W.partitionBy(group, "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    near = near.withColumn("upto", upto)
    met = near.withColumn("w", F.explode(F.filter("wanted", lambda w: (w["rank"] < F.col("upto")) & (w["rank"] >= F.col("upto") - F.col("n")))))
    side = lambda name, s: F.min(F.when((F.col("w.name") == name) & (F.col("w.side") == s), F.col("value")))
    part = lambda name: F.min(F.when(F.col("w.name") == name, F.col("w.at") - F.floor("w.at")))
    return met.groupBy(group).agg(*[(side(n, "lo") + (side(n, "hi") - side(n, "lo")) * part(n)).alias(n) for n in fractions])
