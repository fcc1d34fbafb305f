"""Readers for the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` below ``folder``; with ``columns``, only those (pruned in the scan).

    The tables' times have no zone and mean UTC, so the session that runs the query must have UTC as its time zone.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
