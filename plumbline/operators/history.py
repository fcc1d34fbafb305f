"""History of changing attributes: a bitemporal ledger, and the versions that hold by what is known now.

An update says from when (valid time) an entity had certain values, and when one learned so (recorded time). The ledger
keeps each state of knowledge: an update that comes late splits the interval it falls into; the row it supersedes gets
its end of record and stays.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.ordered import largest_key, pieces, with_neighbours

#: Updates of one entity that one task may sweep; an entity with more is cut along valid time.
UPDATES_PER_PIECE = 200_000


def sweep(updates: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int | None, int, int | None]]:
    """Ledger rows (update, valid_from, valid_to, recorded_from, recorded_to) of one entity.

    ``updates`` are (number, valid, recorded, ours) in order of record. Updates that aren't ours only close intervals:
    they belong to a later piece of the same entity.
    """
    known: list[int] = []
    now: dict[int, list] = {}  # valid start -> [update, valid_to, recorded_from]
    out = []
    for number, valid, recorded, ours in updates:
        old = now.get(valid)
        if old is not None:  # the same valid start, learned again: supersede
            out.append((old[0], valid, old[1], old[2], recorded))
            now[valid] = [number, old[1], recorded]
            continue
        k = bisect_right(known, valid)
        if k and known[k - 1] == valid:
            continue
        before = now.get(known[k - 1]) if k else None
        if before is not None:  # split the interval this one falls into
            out.append((before[0], known[k - 1], before[1], before[2], recorded))
            now[known[k - 1]] = [before[0], valid, recorded]
        if ours:
            now[valid] = [number, known[k] if k < len(known) else None, recorded]
        insort(known, valid)
    out += [(n, valid, until, since, None) for valid, (n, until, since) in now.items()]
    return out


def ledger(updates: DataFrame, key: str, valid: str, recorded: str, tie: str, values: list[str], per_piece: int = UPDATES_PER_PIECE, most: int | None = None) -> DataFrame:
    """Bitemporal rows (key, valid_from, valid_to, recorded_from, recorded_to, tie, values...); open ends are null.

    Updates without key or valid time say nothing. A null recorded time counts as the earliest. Updates with equal valid
    and recorded time follow each other by ``tie``, and the later one supersedes; what no moment of record ever saw has no
    row. Each update adds two rows at most. An entity with more than ``per_piece`` updates is cut along valid time; a piece
    then also sees those updates of later pieces that were, when learned, the earliest known after it. ``most`` is the
    largest number of updates of an entity, or more, where the caller has counted it (``most_updates``).
    """
    kinds = {f.name: f.dataType for f in updates.schema.fields}
    rows = updates.where(F.col(key).isNotNull() & F.col(valid).isNotNull()).select(
        F.col(key).alias("key"), F.unix_micros(F.col(valid).cast("timestamp")).alias("v"),
        F.coalesce(F.unix_micros(F.col(recorded).cast("timestamp")), F.lit(-(2**62))).alias("r"), F.col(tie).alias("tie"), *[F.col(c).alias(f"value_{c}") for c in values],
    )
    cut, n = pieces(rows, "key", "v", rows.select("key", "v"), per_piece, most)
    own = cut.drop("cuts").withColumn("ours", F.lit(True))
    if n > 1:
        own = own.unionByName(_stairs(cut.where(F.col("cuts").isNotNull()).drop("cuts"), n), allowMissingColumns=True)
    named = [f"value_{c}" for c in values]
    ordered = own.repartition("key", "piece").sortWithinPartitions("key", "piece", "r", "tie", "v")
    schema = T.StructType([T.StructField("key", kinds[key]), *[T.StructField(c, T.LongType()) for c in ("v", "until", "r", "closed")], T.StructField("tie", kinds[tie]), *[T.StructField(f"value_{c}", kinds[c]) for c in values]])

    def run(batches):
        import pyarrow as pa

        def flush(table: pa.Table) -> pa.RecordBatch:
            keys = list(zip(table["key"].to_pylist(), table["piece"].to_pylist(), strict=True))
            v, r, ours = (table[c].to_pylist() for c in ("v", "r", "ours"))
            take, cols, a = [], [[], [], [], []], 0
            while a < len(keys):
                b = bisect_right(keys, keys[a], lo=a)
                for row in sweep([(i, v[i], r[i], ours[i]) for i in range(a, b)]):
                    for c, x in zip((take, *cols), row, strict=True):
                        c.append(x)
                a = b
            picked = table.take(pa.array(take, pa.int64()))
            out = pa.table([picked["key"], *[pa.array(c, pa.int64()) for c in cols], picked["tie"], *[picked[c] for c in named]], names=["key", "v", "until", "r", "closed", "tie", *named])
            return out.combine_chunks().to_batches()[0] if len(out) else pa.RecordBatch.from_pylist([], out.schema)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            keys, parts = batch.column("key"), batch.column("piece")
            last = keys[batch.num_rows - 1].as_py(), parts[batch.num_rows - 1].as_py()
            if (held[0].column("key")[0].as_py(), held[0].column("piece")[0].as_py()) == last:
                continue  # one entity still
            # Rows are sorted, so the last entity's rows are the end of the last batch; it may go on in the next.
            n = bisect_left(range(batch.num_rows), True, key=lambda i: (keys[i].as_py(), parts[i].as_py()) == last)
            yield flush(pa.Table.from_batches([*held[:-1], batch.slice(0, n)]))
            held = [batch.slice(n)]
        if held:
            yield flush(pa.Table.from_batches(held))

    out = ordered.mapInArrow(run, schema).where(F.col("closed").isNull() | (F.col("closed") > F.col("r")))
    stamp = lambda c: F.timestamp_micros(F.when(F.col(c) > -(2**62), F.col(c)))
    return out.select(F.col("key").alias(key), stamp("v").alias("valid_from"), stamp("until").alias("valid_to"), stamp("r").alias("recorded_from"), stamp("closed").alias("recorded_to"), F.col("closed").isNull().alias("current"), F.col("tie").alias(tie), *[F.col(f"value_{c}").alias(c) for c in values])


def _stairs(hot: DataFrame, n: int) -> DataFrame:
    """Updates of later pieces that an earlier piece must see: each that was the earliest known of its piece when learned,
    for the pieces before it up to the nearest one in which something was known by then."""
    w = W.partitionBy("key", "piece").orderBy("r", "tie", "v")
    lowest = F.min("v").over(w.rowsBetween(W.unboundedPreceding, -1))
    stairs = hot.withColumn("lowest", lowest).where(F.col("lowest").isNull() | (F.col("v") < F.col("lowest"))).select("key", "piece", "v", "r", "tie")
    first = hot.groupBy("key", "piece").agg(F.min("r").alias("first")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("piece", "first"))).alias("firsts"))
    between = lambda p: F.filter(F.map_keys("firsts"), lambda q: (q > p) & (q < F.col("piece")) & (F.element_at("firsts", q) < F.col("r")))
    targets = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: (p < F.col("piece")) & (F.size(between(p)) == 0))
    sent = stairs.join(F.broadcast(first), "key").withColumn("to", F.explode(targets))
    return sent.select("key", "v", "r", "tie", F.col("to").alias("piece"), F.lit(False).alias("ours"))


def most_updates(updates: DataFrame, key: str) -> int:
    """Updates of the entity that has most; a bound for its current rows as well."""
    return largest_key(updates.select(key), key)


def versions(current: DataFrame, key: str, valid: str, fields: dict[str, Column], per_piece: int = UPDATES_PER_PIECE, most: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """(key, field_name, field_value, valid_from, valid_to) of the current rows of a ledger, one for each (key, valid).

    ``fields`` gives each field's value as text; null says nothing, and the version before goes on. Neighbouring rows of
    equal value are one version; the last one's valid_to is null. ``most`` and ``counted`` (key, at in microseconds) come
    from the updates where the caller has them, so that the ledger is not computed to be counted.
    """
    long = current.select(F.col(key).alias("key"), F.col(valid).alias("at_time"), F.unix_micros(F.col(valid).cast("timestamp")).alias("at"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in fields.items()])).alias("f"))
    long = long.where(F.col("f.value").isNotNull() & F.col("key").isNotNull() & F.col("at").isNotNull()).select("key", "at_time", "at", F.col("f.name").alias("name"), F.col("f.value").alias("value"))
    found = None
    most = largest_key(current, key) if most is None else most
    counted = long.select("key", "at") if counted is None else counted
    if most <= per_piece:
        found = _changes(long, counted, ["key", "name"], per_piece, most)
    else:
        for n in fields:
            one = _changes(long.where(F.col("name") == n), counted, ["key"], per_piece, most)
            found = one if found is None else found.unionByName(one)
    return found.select(F.col("key").alias(key), F.col("name").alias("field_name"), F.col("value").alias("field_value"), F.col("at_time").alias("valid_from"), F.col("until").alias("valid_to"))


def _changes(long: DataFrame, counted: DataFrame, key: list[str], per_piece: int, most: int) -> DataFrame:
    if len(key) > 1:
        w = W.partitionBy(*key).orderBy("at")
        starts = long.withColumn("prev", F.lag("value").over(w)).where(~F.col("value").eqNullSafe(F.col("prev")))
        return starts.withColumn("until", F.lead("at_time").over(w))
    w = W.partitionBy("key", "piece").orderBy("at")
    near = with_neighbours(long, "key", "at", "at", 1, counted, per_piece, most)
    starts = near.withColumn("prev", F.lag("value").over(w)).where(~F.col("guest") & ~F.col("value").eqNullSafe(F.col("prev"))).drop("prev", "guest", "piece")
    near = with_neighbours(starts, "key", "at", "at", 1, counted, per_piece, most)
    return near.withColumn("until", F.lead("at_time").over(w)).where(~F.col("guest")).drop("guest", "piece")
