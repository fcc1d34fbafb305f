import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import history

D = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else D + dt.timedelta(days=n)


SCHEMA = "id long, k long, v timestamp_ntz, r timestamp_ntz, name string, piece string, closed string"


def make(seed, n=400):
    r = random.Random(seed)
    return [(i, r.choice([1, 1, 1, 2, 3]), day(r.randint(0, 60)), day(r.choice([None, *range(100)])), r.choice(["a", "b", None]), "x", "y") for i in range(n)]


def state(rows, k, valid, recorded):
    """What was known at ``recorded`` about ``valid``: the update with the latest valid start, superseded by record order."""
    known = [x for x in rows if x[1] == k and x[2] is not None and x[2] <= valid and (x[3] is None or x[3] <= recorded)]
    return max(known, key=lambda x: (x[2], x[3] or dt.datetime.min, x[0]))[0] if known else None


@pytest.mark.parametrize("per_piece", [10_000, 40])
@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_answers_every_moment(spark, seed, per_piece):
    rows = make(seed)
    got = history.ledger(spark.createDataFrame(rows, SCHEMA), "k", "v", "r", "id", ["name"], per_piece).collect()
    strip = lambda t: t and t.replace(tzinfo=None)
    led = [(x["k"], strip(x["valid_from"]), strip(x["valid_to"]), strip(x["recorded_from"]), strip(x["recorded_to"]), x["id"]) for x in got]
    r = random.Random(seed)
    for _ in range(400):
        k, valid, recorded = r.choice([1, 2, 3]), day(r.randint(-1, 62) + 0.5), day(r.randint(-1, 101) + 0.5)
        hit = [x[5] for x in led if x[0] == k and x[1] <= valid and (x[2] is None or valid < x[2]) and (x[3] is None or x[3] <= recorded) and (x[4] is None or recorded < x[4])]
        assert hit == ([state(rows, k, valid, recorded)] if state(rows, k, valid, recorded) is not None else [])
    assert len(got) <= 2 * len(rows)


@pytest.mark.parametrize("per_piece", [10_000, 30])
def test_versions(spark, per_piece):
    rows = make(7)
    now = history.ledger(spark.createDataFrame(rows, SCHEMA), "k", "v", "r", "id", ["name"], per_piece).where("current")
    got = {(x["k"], x["field_value"], x["valid_from"].replace(tzinfo=None), x["valid_to"] and x["valid_to"].replace(tzinfo=None)) for x in history.versions(now, "k", "valid_from", {"name": F.col("name")}, per_piece).collect()}
    want = set()
    for k in (1, 2, 3):
        best = {}
        for x in rows:
            if x[1] == k and (x[2] not in best or (x[3] or dt.datetime.min, x[0]) > (best[x[2]][3] or dt.datetime.min, best[x[2]][0])):
                best[x[2]] = x
        seq = []
        for v in sorted(best):
            name = best[v][4]
            if name is not None and (not seq or seq[-1][0] != name):
                seq.append((name, v))
        want |= {(k, n, v, seq[i + 1][1] if i + 1 < len(seq) else None) for i, (n, v) in enumerate(seq)}
    assert got == want


def test_late_update_splits_and_supersedes(spark):
    rows = [(1, 5, day(0), day(0), "a", "", ""), (2, 5, day(20), day(20), "c", "", ""), (3, 5, day(10), day(30), "b", "", ""), (4, 5, day(10), day(40), "B", "", ""), (5, None, day(1), day(1), "x", "", ""), (6, 5, None, day(1), "x", "", "")]
    got = history.ledger(spark.createDataFrame(rows, SCHEMA), "k", "v", "r", "id", ["name"]).collect()
    s = lambda t: t and (t.replace(tzinfo=None) - D).days
    assert {(x["name"], s(x["valid_from"]), s(x["valid_to"]), s(x["recorded_from"]), s(x["recorded_to"])) for x in got} == {("a", 0, None, 0, 20), ("a", 0, 20, 20, 30), ("a", 0, 10, 30, None), ("c", 20, None, 20, None), ("b", 10, 20, 30, 40), ("B", 10, 20, 40, None)}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    led = history.ledger(none, "k", "v", "r", "id", ["name"])
    assert led.count() == 0
    assert history.versions(led, "k", "valid_from", {"name": F.col("name")}).count() == 0
