import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from plumbline.operators import profile
from plumbline.plans import general


def write(path, loads, row_group_size):
    path.mkdir()
    for k, rows in enumerate(loads):
        t = pa.table({"load_id": pa.array([x[0] for x in rows], pa.int64()), "a": pa.array([x[1] for x in rows], pa.int64()), "b": pa.array([x[2] for x in rows], pa.string()), "value": pa.array([x[1] for x in rows], pa.int64())})
        pq.write_table(t, path / f"part-{k}.parquet", row_group_size=row_group_size)
    return str(path)


def test_counts_with_settled_and_read_chunks(spark, tmp_path):
    r = random.Random(3)
    settled = [[(1, 7, "x")] * 50 + [(2, 8, "x")] * 50, [(3, None, None)] * 20]
    mixed = [[(4, r.choice([None, 1, 2]), r.choice(["", "y", None])) for _ in range(70)], [(1, 7, "z")] * 5 + [(None, 1, "q")]]
    path = write(tmp_path / "t", settled + mixed, 50)
    rows = [x for f in settled + mixed for x in f]
    for group in ("load_id", None):
        got = {(x["load_id"] if group else None, x["column_name"], x["value"]): x["n"] for x in profile.value_counts(spark, path, group, ["a", "b"]).collect()}
        want = {}
        for row in rows:
            for c, v in (("a", row[1]), ("b", row[2])):
                key = (row[0] if group else None, c, None if v is None else str(v))
                want[key] = want.get(key, 0) + 1
        assert got == want
    got = {(x["load_id"], x["column_name"]): tuple(x)[2:] for x in profile.facts(spark, path, "load_id", ["a", "b"]).collect()}
    for load in (1, 2, 3, 4, None):
        for c, k in (("a", 1), ("b", 2)):
            of = [x[k] for x in rows if x[0] == load]
            there = [x for x in of if x is not None]
            ends = (min(there), max(there)) if there else (None, None)
            assert got[load, c] == (len(of), len(of) - len(there), *((ends + (None, None)) if c == "a" else ((None, None) + ends)))


def test_null_shares_and_ranges_of_a_table_written_load_by_load_need_no_data_page(spark, tmp_path):
    r = random.Random(5)
    rows = [[(load, r.choice([None, *range(9)]), r.choice([None, "p", "q"])) for _ in range(40)] for load in range(6)]
    path = write(tmp_path / "t", rows, 40)
    want = {tuple(x) for x in profile.facts(spark, path, "load_id", ["a", "b"]).collect()}
    for f in (tmp_path / "t").iterdir():
        f.chmod(0o644)
        whole, size = bytearray(f.read_bytes()), pq.ParquetFile(f).metadata.serialized_size
        whole[4 : len(whole) - 8 - size] = bytes(len(whole) - 12 - size)  # the footer alone is left
        f.write_bytes(whole)
    assert {tuple(x) for x in profile.facts(spark, path, "load_id", ["a", "b"]).collect()} == want and len(want) == 12


def test_only_unsettled_chunks_are_read(spark, tmp_path):
    path = write(tmp_path / "t", [[(1, 5, "x"), (1, 9, None)], [(2, 4, "y")] * 3], 10)
    found = {(x["column_name"], x["of"]): (x["rows"], x["nulls"], x["one"], x["alone"]) for x in profile.chunks(spark, path, "load_id", ["a", "b", "gone"]).collect()}
    assert found["a", "1"] == (2, 0, None, True) and found["b", "1"] == (2, 1, None, True) and found["a", "2"] == (3, 0, "4", True) and found["gone", "2"][:2] == (3, 3)


def test_quantiles_match_numpy(spark):
    r = random.Random(4)
    groups = {1: [r.uniform(0, 100) for _ in range(501)], 2: [5.0] * 7, 3: [1.0, 2.0], 4: [r.choice([1.0, 2.0, 1e9]) for _ in range(40)], 5: [3.5], 6: [r.gauss(0, 1) for _ in range(99)] + [0.0] * 30 + [1e300, -1e-300], 7: [50_000 + r.random() for _ in range(300)] + [1e308]}
    counts = {}
    for g, values in groups.items():
        for v in values:
            counts[g, v] = counts.get((g, v), 0) + 1
    df = spark.createDataFrame([(g, v, n) for (g, v), n in counts.items()], "g long, value double, n long")
    for steps in (1, 4096):
        got = profile.quantiles(df, "g", {"median": 0.5, "p90": 0.9}, steps).collect()
        assert len(got) == len(groups)
        for x in got:
            assert np.isclose(x["median"], np.quantile(groups[x["g"]], 0.5), rtol=1e-12) and np.isclose(x["p90"], np.quantile(groups[x["g"]], 0.9), rtol=1e-12)
    assert profile.quantiles(df.limit(0), "g", {"median": 0.5}).count() == 0


def test_shares_of_nothing_are_null(spark):
    df = spark.createDataFrame([(1, "a", None, 4), (1, "b", " ", 2), (1, "b", "ok", 1), (1, "b", "?", 1)], "g long, column_name string, value string, n long")
    got = {x["column_name"]: tuple(x)[2:] for x in profile.shares(df, "g", F.trim("value") == "", F.col("value") == "ok").collect()}
    assert got == {"a": (1.0, None, None, None), "b": (0.5, 0.5, 1.0, " ")}


def test_empty_table(spark, tmp_path):
    path = write(tmp_path / "t", [[]], 10)
    assert profile.value_counts(spark, path, "load_id", ["a", "b"]).count() == 0 and profile.facts(spark, path, "load_id", ["a"]).count() == 0


def test_profile_has_every_column(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n, 1, 2, 3, 4)
    t = pa.table({"row_id": pa.array([1, 2, 3]), "name": ["b", "a name of more than sixteen bytes", None], "flag": ["LR", "NO", "LR"], "deadweight": [2.5, None, float("nan")], "InsertDate": pa.array([day(2), day(1), None], pa.timestamp("us")), "UpdateDate": pa.array([None] * 3, pa.timestamp("us"))})
    pq.write_table(t.slice(0, 2), (tmp_path / "registry_loads.parquet"))
    whole = {x["column_name"]: tuple(x)[1:] for x in general.p2_profile(spark, str(tmp_path)).collect()}
    assert whole["name"] == (2, 0, None, None, "a name of more than sixteen bytes", "b", 2) and whole["flag"] == (2, 0, None, None, "LR", "NO", 2)
    assert whole["deadweight"] == (2, 1, 2.5, 2.5, None, None, 1) and whole["UpdateDate"] == (2, 2, None, None, None, None, 0)
    assert whole["InsertDate"] == (2, 0, None, None, "2024-01-01 01:02:03.000004", "2024-01-02 01:02:03.000004", 2)
    (tmp_path / "n").mkdir()
    pq.write_table(t, tmp_path / "n" / "registry_loads.parquet", row_group_size=1)
    whole = {x["column_name"]: tuple(x)[1:] for x in general.p2_profile(spark, str(tmp_path / "n")).collect()}
    assert whole["deadweight"] == (3, 1, 2.5, 2.5, None, None, 2)  # NaN is a value, but no extreme
    assert whole["InsertDate"] == (3, 1, None, None, "2024-01-01 01:02:03.000004", "2024-01-02 01:02:03.000004", 2)
