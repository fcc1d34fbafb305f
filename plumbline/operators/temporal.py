"""Attribute states over time: intervals, timelines, runs of equal values, state at a time, canonical values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.graph import entity_key
from plumbline.operators.ordered import ROWS_PER_PIECE, largest_key, with_neighbours


def observations(records: DataFrame, attributes: dict[str, str], at: str, seq: str) -> DataFrame:
    """(entity_id, attribute, value, ts, seq): each non-null attribute of each record as text."""
    each = F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(c).cast("string").alias("value")) for n, c in attributes.items()])
    return records.select(entity_key().alias("entity_id"), F.col(at).alias("ts"), F.col(seq).alias("seq"), F.explode(each).alias("o")).select("entity_id", "o.attribute", "o.value", "ts", "seq").where("entity_id is not null and value is not null and ts is not null")


def _key() -> F.Column:
    """The hash only counts and cuts; windows are by the names themselves."""
    return F.xxhash64("entity_id", "attribute")


def _counted(obs: DataFrame) -> tuple[DataFrame, int]:
    """What hot entities are counted and cut by, and the largest number of rows of one: one job."""
    rows = obs.select(_key().alias("_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    return rows, largest_key(rows, "_key")


def _in_order(rows: DataFrame, order: str, rows_per_piece: int, counted: tuple[DataFrame, int] | None = None) -> tuple[DataFrame, W]:
    """``rows`` with ``piece`` and ``guest``, and the window in which each row sees its neighbours of (entity, attribute).

    A hot entity is cut along time (see ``ordered``), by ``counted`` where the caller has it; in order of arrival, whose
    keys may be texts, entities stay whole.
    """
    own = rows.withColumns({"_key": _key(), "_at": F.unix_micros(F.col("ts").cast("timestamp"))})
    if order == "arrival":
        return own.withColumns({"piece": F.lit(0), "guest": F.lit(False)}), W.partitionBy("entity_id", "attribute").orderBy("seq")
    by, most = counted or _counted(rows)
    cut = with_neighbours(own, "_key", "_at", "seq", 1, by, rows_per_piece, most)
    return cut, W.partitionBy("entity_id", "attribute", "piece").orderBy("_at", "seq")


def intervals(obs: DataFrame, order: str = "time", rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """(…, valid_from, valid_to): each observation until the next one; ``order`` time or arrival."""
    rows, w = _in_order(obs, order, rows_per_piece)
    return rows.withColumn("valid_to", F.lead("ts").over(w)).where(~F.col("guest")).select("entity_id", "attribute", "value", "seq", F.col("ts").alias("valid_from"), "valid_to")


def timeline(obs: DataFrame, order: str = "time", rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """(…, ts, old_value, value): observations with the value before."""
    rows, w = _in_order(obs, order, rows_per_piece)
    return rows.withColumn("old_value", F.lag("value").over(w)).where(~F.col("guest")).select("entity_id", "attribute", "ts", "seq", "old_value", "value")


def islands(obs: DataFrame, order: str = "time", rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """(entity_id, attribute, value, start_date, end_date, n, run, old_value): runs of equal values.

    A run ends where the next starts, and ``run`` (the place of its first row) orders an attribute's runs. Rows are only
    compared with the one before; a run's length is the distance between starts, so no task needs to hold a whole run.
    """
    counted = None if order == "arrival" else _counted(obs)
    rows, w = _in_order(obs, order, rows_per_piece, counted)
    rows = rows.withColumn("old_value", F.lag("value").over(w)).where(~F.col("guest"))
    rows = rows.withColumn("_place", F.row_number().over(w))
    sizes = rows.groupBy("entity_id", "attribute", "piece").agg(F.count(F.lit(1)).alias("_n"))
    own = W.partitionBy("entity_id", "attribute")
    before = F.coalesce(F.sum("_n").over(own.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"_before": before, "_all": F.sum("_n").over(own)}).drop("_n")
    starts = rows.where(~F.col("value").eqNullSafe(F.col("old_value"))).join(sizes, ["entity_id", "attribute", "piece"])
    starts = starts.withColumn("run", F.col("_before") + F.col("_place")).drop("piece", "guest", "_place", "_before", "_key", "_at")
    near, w = _in_order(starts, order, rows_per_piece, counted)
    near = near.withColumns({"end_date": F.lead("ts").over(w), "_next": F.lead("run").over(w)}).where(~F.col("guest"))
    return near.select("entity_id", "attribute", "value", F.col("ts").alias("start_date"), "end_date", (F.coalesce("_next", F.col("_all") + 1) - F.col("run")).alias("n"), "run", "old_value")


def state_at(spans: DataFrame, moment) -> DataFrame:
    """(entity_id, attribute, value) valid at ``moment``; of several intervals the earliest-ingested counts."""
    t = F.lit(moment).cast("timestamp_ntz")
    hit = spans.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to"))))
    return hit.groupBy("entity_id", "attribute").agg(F.min_by("value", "seq").alias("value"))


def states_for(spans: DataFrame, probes: DataFrame, days: int = 30) -> DataFrame:
    """Probes (entity_id, probe_ts, …) with the intervals that hold them, by equi-join on entity and month-sized bucket.

    An interval is listed under each bucket it touches, an open one up to the entity's last probe.
    """
    width = days * 86_400
    bucket = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / width)
    last = probes.groupBy("entity_id").agg(F.max("probe_ts").alias("last"))
    listed = spans.join(last, "entity_id").where(F.col("valid_from") <= F.col("last"))
    end = F.least(F.coalesce("valid_to", "last"), F.col("last"))
    listed = listed.where(end >= F.col("valid_from")).withColumn("b", F.explode(F.sequence(bucket(F.col("valid_from")), bucket(end)))).drop("last")
    asked = probes.withColumn("b", bucket(F.col("probe_ts")))
    return asked.join(listed, ["entity_id", "b"]).where((F.col("valid_from") <= F.col("probe_ts")) & (F.col("valid_to").isNull() | (F.col("probe_ts") < F.col("valid_to")))).drop("b")


def canonical(runs: DataFrame, registry: tuple[str, ...] = ()) -> DataFrame:
    """(entity_id, attribute, value, confidence, since): the last run's value; confidence grows by 0.05 a repeat up to 1.

    Attributes in ``registry`` start at 0.9, others at 0.8.
    """
    last = runs.groupBy("entity_id", "attribute").agg(F.max_by(F.struct("value", "n", "start_date"), "run").alias("r"))
    base = F.when(F.col("attribute").isin(list(registry)), F.lit(0.9)).otherwise(F.lit(0.8)) if registry else F.lit(0.8)
    return last.select("entity_id", "attribute", "r.value", F.round(F.least(F.lit(1.0), base + 0.05 * (F.col("r.n") - 1)), 4).alias("confidence"), F.col("r.start_date").alias("since"))


def canonical_entities(runs: DataFrame, most: int = 100) -> DataFrame:
    """(entity_id, current, history, n_runs): nested view of an entity, values by attribute and their runs in order.

    A history has the last ``most`` runs of an attribute; ``n_runs`` counts all of the entity's.
    """
    rank = F.row_number().over(W.partitionBy("entity_id", "attribute").orderBy(F.col("run").desc()))
    counts = runs.groupBy(F.col("entity_id").alias("_of")).agg(F.count(F.lit(1)).alias("n_runs"))
    last = runs.withColumn("_rank", rank).where(F.col("_rank") <= most)
    history = F.array_sort(F.collect_list(F.struct("run", "value", "start_date", "end_date")))
    by = last.groupBy("entity_id", "attribute").agg(history.alias("h"))
    nested = by.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("attribute", F.element_at("h", -1)["value"]))).alias("current"), F.map_from_entries(F.collect_list(F.struct("attribute", "h"))).alias("history"))
    return nested.join(counts, F.col("entity_id") == F.col("_of")).drop("_of")


def changes(runs: DataFrame, attribute: str, since=None) -> DataFrame:
    """(entity_id, old_value, value, changed_at): real changes of an attribute, optionally from ``since`` on."""
    out = runs.where((F.col("attribute") == attribute) & F.col("old_value").isNotNull()).select("entity_id", "old_value", "value", F.col("start_date").alias("changed_at"))
    return out.where(F.col("changed_at") >= F.lit(since).cast("timestamp_ntz")) if since is not None else out
