"""Groups of records that pairs link directly or indirectly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut, forget


def linked_groups(pairs: DataFrame, a: str, b: str, most_rounds: int = 200) -> DataFrame:
    """(node, root) for every id that stands in a pair of two different non-null ids; root is the least id of its group.

    Ids are numbered once, and the rounds run on numbers. In a round each node takes the least label over its edges and
    pointer jumping follows these labels to the end of their chain; nodes of one label then become one node, edges within
    it vanish, and equal ones merge. A node that has an edge joins at least one other, so at most half of these are left
    and rounds grow with the logarithm of the ids; most of a graph of small groups is done in the first. Every round and
    jump is written out as a table; it ends when no edge is left, so that no label can change. The least id of each group is taken
    at the end.

    Minima combine before they are shuffled. The edges of a hub and the members of a giant group are the many rows of one
    join key whose other side has a single row, so the skew join of adaptive execution may split them. Repeated and turned
    pairs count once; an empty table gives no rows.
    """
    links = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x") != F.col("y")))
    links = links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    names = cut(links.select(F.explode(F.array("x", "y")).alias("name")).distinct().select("name", F.monotonically_increasing_id().alias("id")))
    one, two = names.select(F.col("name").alias("x"), F.col("id").alias("i")), names.select(F.col("name").alias("y"), F.col("id").alias("j"))
    edges = cut(links.join(one, "x").join(two, "y").select(F.col("i").alias("x"), F.col("j").alias("y")), n=F.count(F.lit(1)))
    maps = []
    while edges.counts["n"]:
        if len(maps) == most_rounds:
            raise RuntimeError(f"labels still change after {most_rounds} rounds")
        maps.append(_jumped(_least(edges)))
        edges = _contracted(edges, maps[-1])
    forget(edges)
    # The last map knows the fewest nodes; each one before it is led on through those behind it.
    done = None
    for m in reversed(maps):
        if done is not None:
            m = m.join(done.select(F.col("node").alias("at"), F.col("root").alias("end")), F.col("root") == F.col("at"), "left").select("node", F.coalesce("end", "root").alias("root"))
        done = m
    if done is None:
        return names.select(F.col("name").alias("node"), F.col("name").alias("root"))
    named = names.join(done, F.col("id") == F.col("node")).select("name", "root")
    least = named.groupBy("root").agg(F.min("name").alias("first"))
    return named.join(least, "root").select(F.col("name").alias("node"), F.col("first").alias("root"))


def _least(edges: DataFrame) -> DataFrame:
    """(node, root): each node's least label over its edges, its own included."""
    both = edges.select(F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("far")), F.struct(F.col("y").alias("node"), F.col("x").alias("far")))).alias("e"))
    return both.groupBy(F.col("e.node").alias("node")).agg(F.min("e.far").alias("far")).select("node", F.least("node", "far").alias("root"))


def _jumped(labels: DataFrame) -> DataFrame:
    """Labels led to the end of their chain: three jumps a pass, until the last of a pass changes none."""
    while True:
        moved = cut(_jump(_jump(_jump(labels))), changed=F.count_if(F.col("root") != F.col("was")))
        if hasattr(labels, "cut_folder"):
            forget(labels)
        if not moved.counts["changed"]:
            return moved.select("node", "root")
        labels = moved


def _jump(labels: DataFrame) -> DataFrame:
    above = labels.select(F.col("node").alias("at"), F.col("root").alias("up"))
    return labels.select("node", F.col("root").alias("was")).join(above, F.col("was") == F.col("at")).select("node", "was", F.col("up").alias("root"))


def _contracted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between different roots, each once."""
    one, two = (roots.select(F.col("node").alias(n), F.col("root").alias(r)) for n, r in (("x", "i"), ("y", "j")))
    left = edges.join(one, "x").join(two, "y").where(F.col("i") != F.col("j"))
    new = cut(left.select(F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y")).distinct(), n=F.count(F.lit(1)))
    forget(edges)
    return new
