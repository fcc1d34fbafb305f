import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.ordered import largest_key, with_neighbours


def test_pieces_see_their_neighbours(spark):
    r = random.Random(5)
    # one hot key with many ties, so that some pieces are tiny, and small keys beside it
    rows = [(1, int(r.choice([5, 5, 5, *range(400)])), i) for i in range(900)] + [(2, i, 2000 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, at long, tie long")
    for reach in (1, 7):
        cut = with_neighbours(df, "k", "at", "tie", reach, df, rows_per_piece=60)
        w = W.partitionBy("k", "piece").orderBy("at", "tie")
        got = cut.select("*", *[F.lag("tie", n).over(w).alias(f"b{n}") for n in range(1, reach + 1)], *[F.lead("tie", n).over(w).alias(f"f{n}") for n in range(1, reach + 1)]).where("not guest").drop("piece", "guest")
        v = W.partitionBy("k").orderBy("at", "tie")
        want = df.select("*", *[F.lag("tie", n).over(v).alias(f"b{n}") for n in range(1, reach + 1)], *[F.lead("tie", n).over(v).alias(f"f{n}") for n in range(1, reach + 1)])
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert cut.where("k = 1 and not guest").select("piece").distinct().count() > 5


def test_small_keys_are_left_whole(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "k long, at long, tie long")
    assert largest_key(df, "k") == 2
    assert with_neighbours(df, "k", "at", "tie", 3, df).where("piece = 0 and not guest").count() == 2
    assert largest_key(df.limit(0), "k") == 0
