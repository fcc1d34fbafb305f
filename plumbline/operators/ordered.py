"""Windows over keys of any size: hot keys are cut into pieces along their order, with exact neighbours across cuts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of one key that one task may hold; a key with more is cut.
ROWS_PER_PIECE = 1_000_000


def largest_key(rows: DataFrame, *key: str) -> int:
    """Rows of the most frequent key; combined on the map side, one number comes back."""
    return rows.groupBy(*key).count().agg(F.max("count")).first()[0] or 0


def pieces(rows: DataFrame, key: str, at: str, counted: DataFrame, rows_per_piece: int, most: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` with the array ``cuts`` (null for keys that fit) and ``piece``, and the number of pieces at most.

    ``counted`` holds at least the rows' keys and their ``at`` (a number); it may be a superset that is cheaper to read.
    ``most`` is the largest key's number of rows, or more, if the caller has counted it. Rows with equal ``at`` share a
    piece. At most count(counted) / rows_per_piece keys are hot, which bounds the broadcast.
    """
    most = largest_key(counted, key) if most is None else most
    if most <= rows_per_piece:
        return rows.withColumns({"cuts": F.lit(None).cast("array<bigint>"), "piece": F.lit(0)}), 1
    n = math.ceil(most / rows_per_piece)
    hot = counted.groupBy(key).count().where(F.col("count") > rows_per_piece).select(key)
    fractions = F.array(*[F.lit(k / n) for k in range(1, n)])
    cuts = counted.join(F.broadcast(hot), key, "left_semi").where(F.col(at).isNotNull()).groupBy(key).agg(F.array_distinct(F.percentile_approx(at, fractions, 10_000)).cast("array<bigint>").alias("cuts"))
    piece = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("cuts", lambda c: c < F.col(at))))
    return rows.join(F.broadcast(cuts), key, "left").withColumn("piece", piece), n


def with_neighbours(rows: DataFrame, key: str, at: str, tie: str, reach: int, counted: DataFrame, rows_per_piece: int = ROWS_PER_PIECE, most: int | None = None) -> DataFrame:
    """``rows`` with ``piece`` and ``guest``, so that windows over (key, piece) ordered by (at, tie) see what windows over
    key would see within ``reach`` rows of each row that is no guest.

    Guests are copies of rows of other pieces; drop them after the window. A key that fits in a task has piece 0 and no
    guests. Rows with a null key or ``at`` must have been left out before.
    """
    cut, n = pieces(rows, key, at, counted, rows_per_piece, most)
    own = cut.drop("cuts").withColumn("guest", F.lit(False))
    if n == 1:
        return own
    hot = cut.where(F.col("cuts").isNotNull()).drop("cuts")
    sizes = hot.groupBy(key, "piece").count()
    # starts[p]: rows of the key before piece p; a table of at most n numbers for each hot key.
    spread = sizes.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("piece", "count"))).alias("sizes"))
    starts = spread.select(key, F.transform(F.sequence(F.lit(0), F.lit(n)), lambda p: F.aggregate(F.map_keys("sizes"), F.lit(0).cast("long"), lambda s, q: s + F.when(q < p, F.element_at("sizes", q)).otherwise(F.lit(0)))).alias("starts"))
    one = W.partitionBy(key, "piece")
    first = hot.withColumn("rank", F.row_number().over(one.orderBy(F.col(at), F.col(tie)))).where(F.col("rank") <= reach)
    last = hot.withColumn("rank", F.row_number().over(one.orderBy(F.col(at).desc(), F.col(tie).desc()))).where(F.col("rank") <= reach)
    start = lambda p: F.get("starts", p)
    earlier = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: (p < F.col("piece")) & (start(F.col("piece")) + F.col("rank") - 1 < start(p + 1) + reach))
    later = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: (p > F.col("piece")) & (start(p) - start(F.col("piece") + 1) + F.col("rank") <= reach))
    guests = [side.join(F.broadcast(starts), key).withColumn("to", F.explode(where)).drop("starts", "rank", "piece").withColumnRenamed("to", "piece").withColumn("guest", F.lit(True)) for side, where in ((first, earlier), (last, later))]
    return own.unionByName(guests[0]).unionByName(guests[1])
