"""The row-wise rules on a stream: they keep no state, so the batch projection runs unchanged."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import validate
from plumbline.sources.vessels import SCHEMA


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records from Parquet files that land in ``folder``, by the explicit schema."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def validated(records: DataFrame, as_of: dt.datetime) -> DataFrame:
    return validate.with_status(records, validate.standard_rules(as_of))


def failures_per_window(records: DataFrame, as_of: dt.datetime, at: str = "UpdateDate", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, validation_status, n): records by day and status; state is dropped once the watermark has passed a window."""
    timed = validated(records, as_of).withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", window), "validation_status").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "validation_status", "n")
