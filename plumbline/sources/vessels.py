"""The vessel dataset: explicit schema, readers, writers and schema inspection."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG, _INT, _DOUBLE, _TEXT, _TIME = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()
#: Columns of the vessel CSV by domain; a column that two domains name belongs to the first.
DOMAINS: dict[str, list[tuple[str, T.DataType]]] = {
    "identifier": [("imo", _LONG), ("mmsi", _LONG), ("callsign", _TEXT)],
    "static": [("name", _TEXT), ("length", _DOUBLE), ("width", _DOUBLE), ("vessel_type", _TEXT), ("flag", _TEXT), ("deadweight", _DOUBLE), ("grossTonnage", _DOUBLE), ("builtYear", _INT), ("netTonnage", _DOUBLE), ("draught", _DOUBLE), ("lengthOverall", _DOUBLE), ("airDraught", _DOUBLE), ("depth", _DOUBLE), ("beamMoulded", _DOUBLE), ("berthCount", _INT), ("deadYear", _INT)],
    "builder": [("shipBuilder", _TEXT), ("hullNumber", _TEXT), ("launchYear", _INT)],
    "engine": [("mainEngineCount", _INT), ("mainEngineDesigner", _TEXT), ("propulsionType", _TEXT), ("engineDesignation", _TEXT), ("propellerCount", _INT), ("propellerType", _TEXT)],
    "ais": [("last_position_accuracy", _TEXT), ("last_position_course", _DOUBLE), ("last_position_heading", _DOUBLE), ("last_position_latitude", _DOUBLE), ("last_position_longitude", _DOUBLE), ("last_position_maneuver", _TEXT), ("last_position_rot", _DOUBLE), ("last_position_speed", _DOUBLE), ("last_position_updateTimestamp", _TIME)],
    "voyage": [("destination", _TEXT), ("eta", _TIME), ("matchedPort_latitude", _DOUBLE), ("matchedPort_longitude", _DOUBLE), ("matchedPort_name", _TEXT), ("matchedPort_unlocode", _TEXT)],
    "timestamp": [("staticData_updateTimestamp", _TIME), ("InsertDate", _TIME), ("UpdateDate", _TIME)],
}
SCHEMA = T.StructType([T.StructField(n, t) for columns in DOMAINS.values() for n, t in columns] + [T.StructField("aisClass", _TEXT)])


def read_csv(spark: SparkSession, path: str, timestamps: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Vessel records of a headed CSV by the explicit schema; what doesn't fit its type is null, NaN and infinities too.

    Columns are taken by name; those that the file lacks are null and those that the schema lacks are dropped. Rows get a
    ``record_index`` that follows file order within a partition.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("nanValue", "NaN").csv(path)
    there = set(raw.columns)

    def typed(f: T.StructField) -> Column:
        if f.name not in there:
            return F.lit(None).cast(f.dataType)
        text = F.nullif(F.trim(F.col(f.name)), F.lit(""))
        if f.dataType == _TIME:
            return F.coalesce(F.try_to_timestamp(text, F.lit(timestamps)).cast(_TIME), text.try_cast(_TIME))
        if f.dataType in (_LONG, _INT):
            return text.try_cast("double").try_cast(f.dataType)
        return finite(text.try_cast(_DOUBLE)) if f.dataType == _DOUBLE else text

    return raw.select(*[typed(f).alias(f.name) for f in SCHEMA.fields]).withColumn("record_index", F.monotonically_increasing_id())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The default dataset: the first of ``paths`` that is there, on any file system that Spark knows."""
    sc = spark.sparkContext
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def finite(c: Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def sanitised(df: DataFrame) -> DataFrame:
    """``df`` with null for NaN and infinities in every floating column."""
    return df.withColumns({f.name: finite(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def column_domains(df: DataFrame) -> DataFrame:
    """(column_name, data_type, domain) of every column; metadata only."""
    of = {n: d for d, columns in DOMAINS.items() for n, _ in columns}
    rows = [(f.name, f.dataType.simpleString(), of.get(f.name, "other")) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string, domain string")


def inspect(df: DataFrame, most_values: int = 20) -> DataFrame:
    """(column_name, rows, non_null, low, high, mean, kinds, sample): numbers get extremes and mean, all others their kinds.

    ``sample`` lists the values of a column that is no number, as texts in order, if there are at most ``most_values``.
    """
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    texts = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in numbers:
        aggs.append(F.struct(F.count(c).alias("n"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.avg(c).alias("mean"), F.lit(None).cast("long").alias("kinds")).alias(c))
    for c in texts:
        aggs.append(F.struct(F.count(c).alias("n"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("double").alias("mean"), F.count_distinct(c).alias("kinds")).alias(c))
    one = df.agg(*aggs)
    long = one.select("_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("s")) for c in numbers + texts])).alias("e"))
    out = long.select("e.column_name", F.col("_rows").alias("rows"), F.col("e.s.n").alias("non_null"), F.col("e.s.lo").alias("low"), F.col("e.s.hi").alias("high"), F.col("e.s.mean").alias("mean"), F.col("e.s.kinds").alias("kinds"))
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("string").alias("v")) for c in texts])).alias("e")).select("e.*").where("v is not null").distinct()
    few = out.where((F.col("kinds") <= most_values) & (F.col("kinds") > 0)).select(F.col("column_name").alias("of"))
    sample = values.join(F.broadcast(few), "of", "left_semi").groupBy("of").agg(F.array_sort(F.collect_list("v")).alias("sample"))
    return out.join(sample, F.col("column_name") == F.col("of"), "left").drop("of")


def save_config(config: dict, path: str) -> None:
    Path(path).write_text(json.dumps(config, indent=2, sort_keys=True))


def load_config(path: str, defaults: dict) -> dict:
    """``defaults`` overlaid by the nested JSON at ``path``; keys without default are kept."""

    def over(a: dict, b: dict) -> dict:
        return {**a, **{k: over(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}

    return over(defaults, json.loads(Path(path).read_text()))


def as_json_rows(df: DataFrame, limit: int = 50) -> list[str]:
    """The first ``limit`` rows as JSON texts, for a caller outside Spark."""
    return [r[0] for r in df.limit(limit).select(F.to_json(F.struct(*df.columns))).collect()]
