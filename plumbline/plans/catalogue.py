"""All queries of the core and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import general, records


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**general.QUERIES, **records.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**general.SQL, **records.SQL}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return records.v_summary_by_rule(spark, folder)
