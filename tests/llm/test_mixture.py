import heapq
import random
import time

import pytest

from plumbline.llm import mixture
from plumbline.llm.queries import TOKENIZERS

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def one_path_at_a_time(capacity: dict[tuple[str, ...], int], quota: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str, int], int]:
    """The reference: one shortest path after the other (Dijkstra with potentials), returned with its cost."""
    graph: list[list[list]] = []

    def node() -> int:
        graph.append([])
        return len(graph) - 1

    def edge(u: int, v: int, cap: int, cost: int) -> None:
        graph[u].append([v, cap, cost, len(graph[v])])
        graph[v].append([u, 0, -cost, len(graph[u]) - 1])

    start, end = node(), node()
    sources = {s: node() for s in sorted(quota)}
    for s, n in sources.items():
        edge(n, end, quota[s], 0)
    places = []
    for pattern in sorted(capacity):
        own = [s for s in pattern if s in sources]
        if not own:
            continue
        for copy in range(max(repeats[s] for s in own)):
            n = node()
            edge(start, n, capacity[pattern], copy * 1000 + len(own) - 1)
            for s in own:
                if copy < repeats[s]:
                    places.append((pattern, s, copy, n, len(graph[n])))
                    edge(n, sources[s], capacity[pattern], 0)
    potential = [0] * len(graph)
    while True:
        far = [None] * len(graph)
        far[start], came = 0, [None] * len(graph)
        heap = [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for k, (v, cap, cost, _) in enumerate(graph[u]):
                if cap > 0:
                    w = d + cost + potential[u] - potential[v]
                    if far[v] is None or w < far[v]:
                        far[v], came[v] = w, (u, k)
                        heapq.heappush(heap, (w, v))
        if far[end] is None:
            break
        potential = [p + (f if f is not None else 0) for p, f in zip(potential, far, strict=True)]
        push, v = float("inf"), end
        while v != start:
            u, k = came[v]
            push, v = min(push, graph[u][k][1]), u
        v = end
        while v != start:
            u, k = came[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
    flow = {}
    for pattern, s, copy, n, k in places:
        v, cap, _, back = graph[n][k]
        if graph[v][back][1]:
            flow[pattern, s, copy] = graph[v][back][1]
    return flow


def cost(flow):
    return sum(v * (c * 1000 + len(p) - 1) for (p, _, c), v in flow.items())


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_as_cheap_as_one_path_at_a_time(seed):
    r = random.Random(seed)
    names = "abcdef"[: r.randint(2, 6)]
    repeats = {s: r.randint(1, 3) for s in names}
    capacity = {tuple(sorted(r.sample(names, r.randint(1, len(names))))): r.randint(1, 400) for _ in range(20)}
    quota = {s: r.randint(0, 900) for s in names}
    one, two = mixture.min_cost_flow(capacity, quota, repeats), one_path_at_a_time(capacity, quota, repeats)
    assert sum(one.values()) == sum(two.values()) and cost(one) == cost(two)
    for s in names:
        assert sum(v for (_, x, _), v in one.items() if x == s) <= quota[s]
    for p, c in capacity.items():
        for k in range(3):
            assert sum(v for (q, _, n), v in one.items() if q == p and n == k) <= c and all(k < repeats[s] for (q, s, n) in one if q == p and n == k)
    share = {s: r.random() for s in names}
    there = {s for p in capacity for s in p}
    total, whole = mixture.feasible_total(capacity, share, repeats), sum(share[s] for s in there)

    def fits(t):
        wanted = {s: int(t * share[s] / whole) for s in there}
        return sum(one_path_at_a_time(capacity, wanted, repeats).values()) == sum(wanted.values())

    assert fits(total) and not fits(int(total * 1.01) + 8)


def test_ten_thousand_patterns_take_seconds():
    r = random.Random(3)
    names = [f"s{i:02d}" for i in range(16)]
    capacity = {}
    while len(capacity) < 10_000:
        capacity[tuple(sorted(r.sample(names, r.randint(1, 7))))] = r.randint(1, 100_000)
    repeats, share = {s: r.randint(1, 5) for s in names}, {s: r.random() for s in names}
    began = time.time()
    total = mixture.feasible_total(capacity, share, repeats)
    flow = mixture.min_cost_flow(capacity, {s: int(total * x / sum(share.values())) for s, x in share.items()}, repeats)
    assert abs(sum(flow.values()) - total) <= len(names) and time.time() - began < 60


def test_flow_fills_quotas_and_repeats_last():
    flow = mixture.min_cost_flow({("a",): 100, ("b",): 30, ("a", "b"): 20}, {"a": 90, "b": 60}, {"a": 1, "b": 3})
    to = lambda s: sum(v for (_, x, _), v in flow.items() if x == s)
    assert to("a") == 90 and to("b") == 60
    # b takes its own 30 and the shared 20 before it repeats 10
    assert flow[("a", "b"), "b", 0] == 20 and flow[("b",), "b", 0] == 30 and sum(v for (_, _, c), v in flow.items() if c) == 10
    for copy in range(3):
        assert sum(v for (p, _, c), v in flow.items() if p == ("b",) and c == copy) <= 30


def test_feasible_total():
    assert abs(mixture.feasible_total({("a",): 1000, ("b",): 100}, {"a": 0.5, "b": 0.4, "gone": 0.1}, {"a": 1, "b": 2, "gone": 5}) - 450) <= 3
    assert mixture.feasible_total({}, {"a": 1.0}, {"a": 1}) == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_mixture_reaches_shares(spark, seed):
    r = random.Random(seed)
    text = lambda: " ".join(r.choice(["sea", "harbour", "wind", "crane", "barge", str(r.randint(0, 99999))]) for _ in range(r.randint(3, 40)))
    docs = [(i, text(), s) for i, s in enumerate(r.choices(["a", "b", "c", "other", None], [60, 25, 10, 20, 5], k=3000))]
    shared = [text() for _ in range(40)]
    docs += [(10_000 + 2 * i, t, "b") for i, t in enumerate(shared)] + [(10_001 + 2 * i, t, "c") for i, t in enumerate(shared)]
    docs += [(20_000 + i, x[1], x[2]) for i, x in enumerate(docs[:200])] + [(30_000, None, "a"), (30_001, "  ", "a"), (None, "x", "a")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("nowhere", 0.05, 3)], "source string, share double, most int")
    selection, shares = mixture.mix(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, tokens int"), "doc_id", "text", "source", targets, "share", "most", VOCABULARY)
    got = {x["source"]: x for x in shares.collect()}
    for s, want in (("a", 0.5 / 0.95), ("b", 0.3 / 0.95), ("c", 0.15 / 0.95)):
        assert abs(got[s]["actual_share"] - want) < 0.01
    assert got["nowhere"]["tokens"] == 0 and got["a"]["most_copies"] == 1 and got["c"]["most_copies"] <= 4
    of = {d[0]: d for d in docs}
    rows = selection.collect()
    assert len({(x["doc_id"], x["source"]) for x in rows}) == len(rows)
    per_text = {}
    for x in rows:
        assert of[x["doc_id"]][2] == x["source"]
        key = (of[x["doc_id"]][1], x["source"])
        assert key not in per_text and x["copies"] <= {"a": 1, "b": 2, "c": 4}[x["source"]]
        per_text[key] = x["copies"]
    again = mixture.mix(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7), "doc_id", "text", "source", targets, "share", "most", VOCABULARY)[0]
    assert {tuple(x) for x in again.collect()} == {tuple(x) for x in rows}


def test_each_row_is_capacity(spark):
    docs = [(i, f"harbour {i % 20} wind", "a") for i in range(30)] + [(0, "harbour 0 wind", "a")] + [(100 + i, f"crane {i} barge", "b") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, share double, most int")
    both = [mixture.mix(df, "doc_id", "text", "source", targets, "share", "most", VOCABULARY, each_row=e) for e in (False, True)]
    chosen = [{x["doc_id"]: x["copies"] for x in s.where("source = 'a'").collect()} for s, _ in both]
    assert set(chosen[0]) == set(range(20)) and set(chosen[1]) == set(range(30)) and set(chosen[1].values()) == {2}
    tokens = [{x["source"]: x["tokens"] for x in s.collect()} for _, s in both]
    assert abs(tokens[1]["a"] / tokens[0]["a"] - 1.5) < 0.1 and abs(tokens[1]["a"] - tokens[1]["b"]) < 20


def cheapest(capacity, quota, repeats):
    """Tokens and cost of the reference: one shortest path after the other (Bellman-Ford), every use of a text an edge of its own."""
    edges = []

    def edge(u, v, cap, cost):
        edges.append([u, v, cap, cost])
        edges.append([v, u, 0, -cost])

    for p, tokens in capacity.items():
        for use in range(sum(n * repeats[s] for s, n in p)):
            edge("start", p, tokens, use * 10**6 + use // sum(n for _, n in p) * 1000 + len(p) - 1)
        for s, n in p:
            edge(p, s, tokens * n * repeats[s], 0)
    for s, tokens in quota.items():
        edge(s, "end", tokens, 0)
    sent = cost = 0
    while True:
        far, came, changed = {"start": 0}, {}, True
        while changed:
            changed = False
            for k, (u, v, cap, c) in enumerate(edges):
                if cap > 0 and u in far and far[u] + c < far.get(v, float("inf")):
                    far[v], came[v], changed = far[u] + c, k, True
        if "end" not in far:
            return sent, cost
        path, at = [], "end"
        while at != "start":
            path.append(came[at])
            at = edges[came[at]][0]
        amount = min(edges[k][2] for k in path)
        for k in path:
            edges[k][2] -= amount
            edges[k ^ 1][2] += amount
        sent, cost = sent + amount, cost + amount * far["end"]


@pytest.mark.parametrize("seed", range(6))
def test_flow_of_documents_is_as_cheap_as_one_path_at_a_time(seed):
    r = random.Random(seed)
    names = "abcd"[: r.randint(2, 4)]
    repeats = {s: r.randint(1, 2) for s in names}
    capacity = {tuple((s, r.randint(1, 2)) for s in sorted(r.sample(names, r.randint(1, len(names))))): r.randint(1, 60) for _ in range(10)}
    quota = {s: r.randint(0, 300) for s in names}
    flow = mixture.min_cost_flow(capacity, quota, repeats, each=True)
    got = 0
    for p, tokens in capacity.items():
        of = {s: v for (q, s, _), v in flow.items() if q == p}
        assert all(v <= tokens * dict(p)[s] * repeats[s] for s, v in of.items())
        full, rest = divmod(sum(of.values()), tokens)
        use = lambda k: k * 10**6 + k // sum(n for _, n in p) * 1000 + len(p) - 1  # noqa: B023, E731
        got += tokens * sum(map(use, range(full))) + rest * use(full)
    assert (sum(flow.values()), got) == cheapest(capacity, quota, repeats)
    assert all(sum(v for (_, x, _), v in flow.items() if x == s) <= quota[s] for s in names)


def test_uses_of_a_frequent_text_are_few_steps():
    steps = mixture._steps(3_000_000)
    assert len(steps) < 40 and sum(n for _, n in steps) == 3_000_000 and all(a + n == b for (a, n), (b, _) in zip(steps, steps[1:], strict=False))
    flow = mixture.min_cost_flow({(("a", 1_000_000),): 7, (("a", 1), ("b", 1)): 7}, {"a": 7_000_000, "b": 7}, {"a": 1, "b": 1}, each=True)
    assert sum(flow.values()) == 7_000_007 and all(sum(v for (_, x, _), v in flow.items() if x == s) == n for s, n in (("a", 7_000_000), ("b", 7)))


def test_other_documents_of_a_text_come_before_repeats():
    flow = mixture.min_cost_flow({(("a", 1),): 10, (("a", 2),): 10}, {"a": 30}, {"a": 2}, each=True)
    assert flow == {((("a", 1),), "a", 0): 10, ((("a", 2),), "a", 0): 20}


def test_texts_of_several_sources_are_spread_before_they_repeat(spark):
    text = lambda k: f"barge {k + 100} wind"
    docs = [(k, text(k), "a") for k in range(40)] + [(100 + k, text(k), "b") for k in range(20, 60)]  # 20 of each are the other's too
    docs += [(1000 + k, text(k % 5), "b") for k in range(15)]  # and five of a's three times in b
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, share double, most int")
    one = mixture.token_counts(df, "text", VOCABULARY).first()["tokens"]
    of = {d[0]: d for d in docs}
    for each_of, distinct, most in ((30, 60, 1), (40, 60, 2)):
        got = mixture.mix(df, "doc_id", "text", "source", targets, "share", "most", VOCABULARY, total=2 * each_of * one, each_row=True)[0].collect()
        uses = {}
        for x in got:
            assert of[x["doc_id"]][2] == x["source"] and x["copies"] <= {"a": 1, "b": 2}[x["source"]]
            uses[of[x["doc_id"]][1]] = uses.get(of[x["doc_id"]][1], 0) + x["copies"]
        assert {s: sum(x["copies"] for x in got if x["source"] == s) for s in "ab"} == {"a": each_of, "b": each_of}
        assert len(uses) == distinct and max(uses.values()) == most
    # all documents are capacity: b alone can give each of its 55 documents twice
    alone = spark.createDataFrame([("b", 1.0, 2)], "source string, share double, most int")
    got = mixture.mix(df, "doc_id", "text", "source", alone, "share", "most", VOCABULARY, each_row=True)[0].collect()
    assert {(x["doc_id"], x["copies"]) for x in got} == {(d[0], 2) for d in docs if d[2] == "b"}
    # the uses of a text are handed out evenly to its documents
    got = mixture.mix(df.where("doc_id >= 1000"), "doc_id", "text", "source", alone, "share", "most", VOCABULARY, total=15 * one, each_row=True)[0].collect()
    assert {(x["doc_id"], x["copies"]) for x in got} == {(1000 + k, 1) for k in range(15)}


def test_tokens_and_empty_tables(spark):
    df = spark.createDataFrame([("Hello, world's end", 1), ("", 2), (None, 3), ("<|endoftext|>", 4)], "text string, k int")
    got = {x["k"]: x["tokens"] for x in mixture.token_counts(df, "text", VOCABULARY).collect()}
    assert got[1] == 5 and got[2] == got[3] == 0 and got[4] > 1
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, share double, most int")
    selection, shares = mixture.mix(spark.createDataFrame([], "doc_id long, text string, source string"), "doc_id", "text", "source", targets, "share", "most", VOCABULARY)
    assert selection.count() == 0 and shares.first()["actual_share"] == 0.0
