"""Findings gathered into alerts: one for each failing rule and each kind of anomaly, with a bounded sample of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rule_alerts(results: DataFrame, key: str, sample: int = 100) -> DataFrame:
    """(alert_type, severity, affected, sample): a row for each rule that some record fails.

    The sample is the first ``sample`` failing records by key. It is built by rank, so no list outgrows it.
    """
    from pyspark.sql import Window as W

    failed = results.where(~F.col("is_valid")).select("rule_id", "severity", F.col(key).cast("string").alias("record"))
    counts = failed.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("affected"))
    # The rank's limit is applied before the shuffle as well.
    first = failed.withColumn("rank", F.row_number().over(W.partitionBy("rule_id").orderBy("record"))).where(F.col("rank") <= sample)
    samples = first.groupBy(F.col("rule_id").alias("of")).agg(F.array_sort(F.collect_list("record")).alias("sample"))
    return counts.join(samples, F.col("rule_id") == F.col("of")).select(F.col("rule_id").alias("alert_type"), "severity", "affected", "sample")


def anomaly_alerts(found: DataFrame, severities: dict[str, str], default: str = "medium", confidence: float = 0.85, sample: int = 50) -> DataFrame:
    """(alert_type, severity, affected, confidence, sample): a row for each kind of anomaly that was found.

    The sample is the first ``sample`` distinct IMO numbers with that anomaly.
    """
    from pyspark.sql import Window as W

    names = F.create_map(*[F.lit(x) for pair in severities.items() for x in pair]) if severities else F.create_map(F.lit(""), F.lit(""))
    counts = found.groupBy(F.col("anomaly_type").alias("alert_type")).agg(F.count(F.lit(1)).alias("affected"))
    each = found.where("imo is not null").select("anomaly_type", "imo").distinct()
    first = each.withColumn("rank", F.row_number().over(W.partitionBy("anomaly_type").orderBy("imo"))).where(F.col("rank") <= sample)
    samples = first.groupBy(F.col("anomaly_type").alias("of")).agg(F.array_sort(F.collect_list("imo")).alias("sample"))
    return counts.join(samples, F.col("alert_type") == F.col("of"), "left").select("alert_type", F.coalesce(F.try_element_at(names, "alert_type"), F.lit(default)).alias("severity"), "affected", F.lit(confidence).alias("confidence"), "sample")


def summary(alerts: DataFrame) -> DataFrame:
    """(by, name, n): alerts by severity and by type, and their total, in one aggregation."""
    sets = alerts.groupingSets([["severity"], ["alert_type"], []], "severity", "alert_type").agg(F.count(F.lit(1)).alias("n"), F.grouping("severity").alias("gs"), F.grouping("alert_type").alias("gt"))
    by = F.when(F.col("gs") == 0, "severity").when(F.col("gt") == 0, "alert_type").otherwise("total")
    return sets.select(by.alias("by"), F.coalesce(F.when(F.col("gs") == 0, F.col("severity")), F.when(F.col("gt") == 0, F.col("alert_type")), F.lit("all")).alias("name"), "n")


def report(statuses: DataFrame, matches: DataFrame, alerts: DataFrame, high: float = 0.9) -> DataFrame:
    """(measure, n): records with and without issues, sure matches, and alerts by severity.

    ``statuses`` has validation_status, ``matches`` overall, ``alerts`` severity and affected.
    """
    records = statuses.groupBy("validation_status").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("records_"), "validation_status").alias("measure"), "n")
    sure = matches.agg(F.count_if(F.col("overall") >= high).alias("n")).select(F.lit("sure_matches").alias("measure"), "n")
    by = alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("alerts_"), "severity").alias("measure"), "n")
    return records.unionByName(sure).unionByName(by)
