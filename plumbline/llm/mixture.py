"""Mixing sources to target shares of tokens, as a min-cost flow over membership patterns.

A text may stand in several sources, and in several documents of each. Texts are grouped by the sources that hold them
and, where every document counts, by how many of their documents do (their pattern); a small
network routes each pattern's tokens to the quotas of its sources, where each further repetition costs more than the
last, and a seeded choice of texts then fills what the flow assigned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import cut

#: The pre-tokenizer pattern that belongs to the byte-level vocabularies (fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(documents: DataFrame, text: str, vocabulary: str, out: str = "tokens") -> DataFrame:
    """``documents`` with the number of tokens of ``text`` by a byte-level vocabulary file (ranks); 0 for null.

    ``vocabulary`` is a path that every executor can read. Whole texts are counted, in Arrow batches.
    """
    schema = documents.select("*", F.lit(0).cast("long").alias(out)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoder = tiktoken.Encoding("counting", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            pdf[out] = [len(encoder.encode_ordinary(t)) if t else 0 for t in pdf[text]]
            yield pdf

    return documents.mapInPandas(run, schema)


class _Network:
    """Hubs of texts with the flow of each to the sources (columns, by name), and the nodes by which tokens enter a hub.

    Of texts that count once a source (``each`` false) every copy is a hub of its own, open to the sources that allow so
    many. Of texts whose documents all count the hub is the pattern, with (source, documents) in place of sources: a source
    takes a text as often as its documents allow together, and only the sum of all uses decides their cost.
    """

    def __init__(self, capacity: dict[tuple, int], sources: list[str], repeats: dict[str, int], each: bool = False):
        self.sources = sources
        at = {s: k for k, s in enumerate(sources)}
        self.names, most, hub, room, cost = [], [], [], [], []
        for pattern in sorted(capacity):
            tokens = capacity[pattern]
            own = {s: n * repeats[s] for s, n in _holders(pattern, each) if s in at and repeats[s] > 0}
            documents = sum(n for s, n in _holders(pattern, each) if s in own)
            for copy in range(min(1, len(own)) if each else max(own.values(), default=0)):
                row = np.zeros(len(sources), np.int64)
                for s, uses in own.items():
                    row[at[s]] = tokens * (uses if each else copy < uses)
                for first, n in _steps(sum(own.values())) if each else [(copy, 1)]:
                    hub.append(len(self.names))
                    room.append(tokens * n)
                    cost.append(first * 10**6 + (first // documents * 1000 if each else 0) + len(own) - 1)
                self.names.append((pattern, copy))
                most.append(row)
        self.most = np.array(most, np.int64).reshape(len(self.names), len(sources))
        self.hub, self.room, self.cost = np.array(hub, np.int64), np.array(room, np.int64), np.array(cost, np.int64)
        self.flow = np.zeros(self.most.shape, np.int64)

    def fill(self, need: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Push what ``nodes`` have left to the sources that need it, by shortest augmenting paths, until none is left.

        A path leads from a hub to a source and, over hubs whose flow may change its source, to one in need. All hubs
        that can make a step make it at once. Returns the sources that ``nodes`` still reach: behind them nothing is in need.
        """
        room = np.zeros(len(self.names), np.int64)
        np.add.at(room, self.hub[nodes], self.room[nodes])
        entered = np.flatnonzero(room)
        room = room[entered]
        while True:
            there = np.minimum(room[:, None], self.most[entered] - self.flow[entered])
            start = there.sum(0)
            came = np.where(start > 0, -1, -2)  # -2: not reached
            queue = list(np.flatnonzero(start > 0))
            arcs: dict[int, np.ndarray] = {}
            goal = next((s for s in queue if need[s] > 0), None)
            k = 0
            while goal is None and k < len(queue):
                s = queue[k]
                of = np.flatnonzero(self.flow[:, s])
                arcs[s] = np.minimum(self.flow[of, s][:, None], self.most[of] - self.flow[of]).sum(0)
                for t in np.flatnonzero((arcs[s] > 0) & (came == -2)):
                    came[t] = s
                    queue.append(t)
                    if need[t] > 0:
                        goal = t
                        break
                k += 1
            if goal is None:
                return came != -2
            path = [goal]
            while came[path[-1]] >= 0:
                path.append(came[path[-1]])
            amount = min(need[goal], start[path[-1]], *[arcs[s][t] for t, s in zip(path, path[1:], strict=False)])
            # From the end, so that each step finds at least the place that the search saw.
            for t, s in zip(path, path[1:], strict=False):
                moved = _first(np.minimum(self.flow[:, s], self.most[:, t] - self.flow[:, t]), amount)
                self.flow[:, s] -= moved
                self.flow[:, t] += moved
            taken = _first(np.minimum(room, self.most[entered, path[-1]] - self.flow[entered, path[-1]]), amount)
            room -= taken
            self.flow[entered, path[-1]] += taken
            need[goal] -= amount


def _holders(pattern: tuple, each: bool) -> list[tuple[str, int]]:
    """(source, documents) of a pattern."""
    return list(pattern) if each else [(s, 1) for s in pattern]


def _steps(uses: int) -> list[tuple[int, int]]:
    """(first, number): uses of a text that cost the same; sixteen by themselves, from then on twice as many each time."""
    steps, first = [], 0
    while first < uses:
        n = min(1 if first < 16 else first, uses - first)
        steps.append((first, n))
        first += n
    return steps


def _first(there: np.ndarray, amount: int) -> np.ndarray:
    """``amount`` taken from the front of ``there``."""
    return np.clip(amount - (np.cumsum(there) - there), 0, there)


def min_cost_flow(capacity: dict[tuple, int], quota: dict[str, int], repeats: dict[str, int], each: bool = False) -> dict[tuple[tuple, str, int], int]:
    """Tokens for (pattern, source, copy number) that fill the quotas as far as possible at least cost.

    The n-th copy of a text costs n - 1 a token, however it is spread over its sources' copies, so costs are convex;
    ties are kept even by preferring patterns with fewer sources. A token's cost is set when it enters the network, and
    changing its source is free: so the successive shortest paths are those of the cheapest nodes first, and each cost's
    nodes are filled together. With ``each`` patterns are ((source, documents), ...), every document may be repeated as
    its source allows, and copies are not told apart (0); of uses that cost the same those come first that repeat no
    document, and uses beyond the 16th share costs by doublings.
    """
    net = _Network(capacity, sorted(quota), repeats, each)
    need = np.array([quota[s] for s in net.sources], np.int64)
    for cost in np.unique(net.cost):
        if not need.any():
            break
        net.fill(need, np.flatnonzero(net.cost == cost))
    return {(*net.names[n][:1], net.sources[s], net.names[n][1]): int(net.flow[n, s]) for n, s in zip(*np.nonzero(net.flow), strict=True)}


def feasible_total(capacity: dict[tuple, int], share: dict[str, float], repeats: dict[str, int], each: bool = False) -> int:
    """The largest total for which every source of ``share`` with any text can have its share.

    Starts with what all sources together can have. While quotas of that total can't be met, the sources behind the cut
    of the flow are those that want more than all texts they have, and the total falls to what these allow: as each cut
    is another one, this ends after as many flows as there are sources at most. Shares of sources without text fall to the
    others in proportion.
    """
    there = sorted({s for p in capacity for s, _ in _holders(p, each) if capacity[p] > 0 and s in share and share[s] > 0 and repeats[s] > 0})
    whole = sum(share[s] for s in there)
    if not there:
        return 0

    def allowed(some: list[str]) -> int:
        uses = lambda p: [n * repeats[s] for s, n in _holders(p, each) if s in some]
        has = sum(c * (sum(uses(p)) if each else max(uses(p), default=0)) for p, c in capacity.items())
        return int(has * whole / sum(share[s] for s in some))

    total = allowed(there)
    while True:
        net = _Network(capacity, there, repeats, each)
        need = np.array([int(total * share[s] / whole) for s in there], np.int64)
        reached = net.fill(need, np.arange(len(net.room)))
        if not need.any():
            return total
        # Sources that nothing left over reaches; those among them that are in need pull the rest in.
        short = [s for s, r in zip(there, reached, strict=True) if not r]
        total = min(total - 1, allowed(short))


def mix(documents: DataFrame, doc_id: str, text: str, source: str, targets: DataFrame, share: str, most: str, vocabulary: str, total: int | None = None, seed: int = 20240229, each_row: bool = False) -> tuple[DataFrame, DataFrame]:
    """(selection, shares). selection: (doc_id, source, copies, tokens), the chosen rows; shares: one row a target source
    with target_share, actual_share, tokens, documents and the most copies of one.

    ``total`` is the size in tokens; None takes the largest for which every source that has text reaches its share. Null
    or blank texts and sources without target give nothing. Rows of equal text within a source count as one text and the
    least doc_id stands for it, so no text goes in more often than its source allows. Quotas are met to within one text
    for each pattern, source and copy: the last text that starts within its tokens is taken.

    With ``each_row`` every doc_id of a source counts as a document of its own, equal texts too: the limit of repeats then
    holds for documents, and all of them are capacity. A text's pattern is then how many documents of each source have it,
    so that the flow sees every use of a text, by whatever document and source; a source's uses of a text are handed out
    evenly to its documents.
    """
    spark = documents.sparkSession
    rows = targets.where(F.col(source).isNotNull()).groupBy(source).agg(F.max(share).alias("share"), F.max(most).alias("most")).collect()  # a row a source
    wanted = {r[0]: float(r["share"] or 0) for r in rows}
    repeats = {r[0]: int(r["most"] or 0) for r in rows}
    of = F.broadcast(spark.createDataFrame([(s,) for s in wanted], "_of string"))
    used = documents.where(F.col(text).isNotNull() & (F.trim(text) != "") & F.col(doc_id).isNotNull()).join(of, F.col(source) == F.col("_of"), "left_semi")
    counted = token_counts(used.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")), "text", vocabulary)
    # Tokens and a 128-bit digest stand for the text from here on; both hashes of a text are needed to be the same one.
    slim = counted.select("id", "source", "tokens", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text", F.length("text")).alias("h2"))
    if each_row:  # a doc_id that stands more than once in a source is one document, with the least of its texts
        docs = cut(slim.groupBy("id", "source").agg(F.min(F.struct("tokens", "h1", "h2")).alias("t")).select("id", "source", "t.tokens", "t.h1", "t.h2"))
        held = docs.groupBy("h1", "h2", "source").agg(F.count(F.lit(1)).alias("n"), F.min("tokens").alias("tokens"))
        texts = held.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("pattern"), F.min("tokens").alias("tokens"))
        kept, kind = ["h1", "h2"], "array<struct<source: string, n: bigint>>"
    else:
        held = slim.groupBy("h1", "h2", "source").agg(F.min("id").alias("id"), F.min("tokens").alias("tokens"))
        texts = held.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("source")).alias("pattern"), F.map_from_entries(F.collect_list(F.struct("source", "id"))).alias("ids"), F.min("tokens").alias("tokens"))
        kept, kind = ["ids"], "array<string>"
    texts = texts.withColumn("draw", F.xxhash64(F.lit(seed), "h1", "h2"))
    texts = cut(texts.select("pattern", *kept, "tokens", "draw", F.pmod(F.shiftright("draw", 8), F.lit(4096)).cast("int").alias("bucket")))
    sums = texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    sizes = sums.collect()  # a row a pattern: at most 2**sources, with ``each_row`` times the numbers of documents that occur
    capacity = {tuple(tuple(x) if each_row else x for x in r["pattern"]): r["tokens"] for r in sizes}
    there = {s for p in capacity for s, _ in _holders(p, each_row) if wanted[s] > 0 and repeats[s] > 0}
    whole = sum(wanted[s] for s in there) or 1.0
    size = feasible_total(capacity, wanted, repeats, each_row) if total is None else total
    flow = min_cost_flow(capacity, {s: int(size * wanted[s] / whole) for s in there}, repeats, each_row)
    plan = _wrapped(flow, capacity) if each_row else _stretches(flow)
    assigned = spark.createDataFrame(plan, f"pattern {kind}, source string, copy long, begins long, ends long").where("ends > begins")
    # Each text has its place on its pattern's line of tokens, in seeded order: totals of buckets first, then inside them.
    totals = texts.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lines = totals.select(F.col("pattern").alias("p"), F.col("bucket").alias("b"), before.alias("before"))
    placed = texts.join(F.broadcast(lines) if len(sizes) <= 256 else lines, (F.col("pattern") == F.col("p")) & (F.col("bucket") == F.col("b")))
    inside = F.coalesce(F.sum("tokens").over(W.partitionBy("pattern", "bucket").orderBy("draw", "tokens").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("start", F.col("before") + inside).select("pattern", *kept, "tokens", "start")
    meets = placed["pattern"] == F.col("a.pattern")
    if each_row:  # how often a stretch, wound round the pattern's line, passes the text's place; then its share of each document
        past = lambda end: F.expr(f"({end} - start + length - 1) div length")
        passed = assigned.withColumnRenamed("copy", "length")
        uses = placed.join(F.broadcast(passed).alias("a"), meets).select("h1", "h2", F.col("source").alias("of"), (past("ends") - past("begins")).alias("uses"), F.filter(placed["pattern"], lambda x: x["source"] == F.col("source"))[0]["n"].alias("n")).where("uses > 0")
        turn = F.row_number().over(W.partitionBy("h1", "h2", "source").orderBy(F.xxhash64(F.lit(seed), "id"), "id"))
        mine = docs.withColumn("turn", turn).join(uses.withColumnsRenamed({"h1": "g1", "h2": "g2"}), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("source") == F.col("of")))
        copies = F.expr("uses div n") + (F.col("turn") <= F.col("uses") % F.col("n")).cast("long")
        selection = mine.select(F.col("id").alias(doc_id), F.col("source").alias(source), copies.alias("copies"), "tokens").where("copies > 0")
    else:
        chosen = placed.join(F.broadcast(assigned).alias("a"), meets & (F.col("start") >= F.col("begins")) & (F.col("start") < F.col("ends")))
        selection = chosen.groupBy(F.element_at("ids", F.col("source")).alias(doc_id), F.col("source").alias(source)).agg(F.count(F.lit(1)).cast("long").alias("copies"), F.min("tokens").alias("tokens"))
    reached = selection.groupBy(source).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    goal = spark.createDataFrame([(s, wanted[s]) for s in sorted(wanted)], "of string, target_share double")
    all_tokens = F.sum(F.coalesce("tokens", F.lit(0))).over(W.partitionBy())
    shares = F.broadcast(goal).join(reached, F.col("of") == F.col(source), "left").withColumn("all", all_tokens)
    shares = shares.select(F.col("of").alias("source"), "target_share", F.coalesce(F.try_divide(F.coalesce("tokens", F.lit(0)), F.col("all")), F.lit(0.0)).alias("actual_share"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "documents", "most_copies")])
    return selection, shares


def _stretches(flow: dict[tuple[tuple[str, ...], str, int], int]) -> list[tuple]:
    """Where on its pattern's line each flow lies: flows of one copy follow each other, so no text is in two of them."""
    at: dict[tuple, int] = {}
    out = []
    for (pattern, source, copy), tokens in sorted(flow.items()):
        begin = at.get((pattern, copy), 0)
        at[pattern, copy] = begin + tokens
        out.append((list(pattern), source, copy, begin, begin + tokens))
    return out


def _wrapped(flow: dict[tuple[tuple, str, int], int], capacity: dict[tuple, int]) -> list[tuple]:
    """(pattern, source, length of the pattern's line, begin, end): flows follow each other on a line wound round the
    pattern's own, so that texts are used equally often but for one, and by a source no oftener than its flow allows."""
    at: dict[tuple, int] = {}
    out = []
    for (pattern, source, _), tokens in sorted(flow.items()):
        begin = at.get(pattern, 0)
        at[pattern] = begin + tokens
        out.append((list(pattern), source, capacity[pattern], begin, begin + tokens))
    return out
