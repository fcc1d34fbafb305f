import datetime as dt
import random

import pytest

from plumbline.operators import timestamps

INSERT = dt.datetime(2024, 3, 10, 12, 0, 0, 500)
CASES = [
    # text, source, field, expected
    ("2024-01-02T03:04:05Z", "ny", "t", "2024-01-02 03:04:05.000000"),
    ("2024-01-02 03:04:05.123456789+05:30", "ny", "t", "2024-01-01 21:34:05.123456"),
    ("2024-01-02 03:04:05 GMT-03:30", "ny", "t", "2024-01-02 06:34:05.000000"),
    ("2024-01-02T03:04:05,25", "utc", "t", "2024-01-02 03:04:05.250000"),
    ("2024-07-02 03:04", "ny", "t", "2024-07-02 07:04:00.000000"),
    ("2024-01-02", "ny", "t", "2024-01-02 05:00:00.000000"),
    ("2024-03-10 02:30", "ny", "t", None),  # skipped by the clock
    ("2024-11-03 01:30", "ny", "t", "2024-11-03 05:30:00.000000"),  # twice; the earlier counts
    ("2024-11-03 01:30-0500", "ny", "t", "2024-11-03 06:30:00.000000"),
    ("01/02/2024 4:18 pm", "ny", "t", "2024-01-02 21:18:00.000000"),
    ("01/02/2024 12:00 a.m.", "utc", "t", "2024-02-01 00:00:00.000000"),
    ("13/02/2024 13:00 PM", "utc", "t", None),
    ("31.04.2024 10:00", "utc", "t", None),
    ("05.06.24", "utc", "t", "2024-06-05 00:00:00.000000"),
    ("2024.06.05 10:11:12", "utc", "t", "2024-06-05 10:11:12.000000"),
    ("24/06/05 10:11", "jp", "t", "2024-06-05 01:11:00.000000"),
    ("20240102030405", "utc", "t", "2024-01-02 03:04:05.000000"),
    ("20240102T030405Z", "ny", "t", "2024-01-02 03:04:05.000000"),
    ("20240102", "jp", "t", "2024-01-01 15:00:00.000000"),
    ("1704164645", "ny", "t", "2024-01-02 03:04:05.000000"),
    ("1704164645.07", "ny", "t", "2024-01-02 03:04:05.070000"),
    ("1704164645123", "ny", "t", "2024-01-02 03:04:05.123000"),
    ("1704164645123456", "ny", "t", "2024-01-02 03:04:05.123456"),
    ("0", "utc", "t", None),
    ("2024-060T23:59", "utc", "t", "2024-02-29 23:59:00.000000"),
    ("2023-366T00:00", "utc", "t", None),
    ("29-FEB-24 2158", "utc", "t", "2024-02-29 21:58:00.000000"),
    ("29-FEB-23 2158", "utc", "t", None),
    ("9 Sep 2025 23:51", "utc", "t", "2025-09-09 23:51:00.000000"),
    ("Fri, 01 Mar 2024 16:15:14 +0800", "ny", "t", "2024-03-01 08:15:14.000000"),
    ("010017ZOCT23", "ny", "t", "2023-10-01 00:17:00.000000"),
    ("010017BOCT23", "ny", "t", "2023-09-30 22:17:00.000000"),
    ("2024-12-31 24:00", "utc", "t", "2025-01-01 00:00:00.000000"),
    ("2024-12-31 24:01", "utc", "t", None),
    ("  2024-01-02   03:04:05z ", "ny", "t", "2024-01-02 03:04:05.000000"),
    ("1999-12-31T23:59:59Z", "utc", "t", None),
    ("2035-12-31T23:59:59.9999999Z", "utc", "t", "2035-12-31 23:59:59.999999"),
    ("9999-12-31 23:59:59", "jp", "t", None),
    ("0000-00-00 00:00:00", "utc", "t", None),
    ("12-31 22:51", "jp", "eta", "2024-12-31 22:51:00.000000"),
    ("03/10 12:00", "jp", "eta", "2025-03-10 12:00:00.000000"),
    ("02-29 00:00", "jp", "eta", "2028-02-29 00:00:00.000000"),
    ("03-10 24:00", "jp", "eta", "2024-03-11 00:00:00.000000"),
    ("00-00 24:60", "jp", "eta", None),
    ("12-31 22:51", "jp", "t", None),
    ("TBA", "utc", "t", None),
    ("", "utc", "t", None),
    (" ", "utc", "t", None),
    ("x" * 100_000, "utc", "t", None),
    ("2024-01-02 03:04:05Z", None, "t", "2024-01-02 03:04:05.000000"),
    ("2024-01-02 03:04:05", None, "t", None),
    (None, "utc", "t", None),
]


@pytest.fixture(scope="module")
def clocks(spark):
    return spark.createDataFrame([("utc", None, "dmy"), ("ny", "America/New_York", "mdy"), ("jp", "Asia/Tokyo", "ymd")], "source string, zone string, order string")


def test_forms(spark, clocks):
    rows = [(i, s, INSERT, t if f == "t" else None, t if f == "eta" else None, "x") for i, (t, s, f, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id long, source string, InsertDate timestamp_ntz, t string, eta string, zone string")
    got = {x["id"]: x["utc_time"] for x in timestamps.to_utc(df, "id", "source", "InsertDate", ["t", "eta"], "eta", clocks).collect()}
    for i, (text, _, _, want) in enumerate(CASES):
        assert got.get(i) == want, (text and text[:40], got.get(i), want)


def test_undeclared_clock_is_estimated(spark, clocks):
    r = random.Random(1)
    rows = []
    for i in range(300):
        utc = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randint(0, 500_000))
        seen = utc + dt.timedelta(minutes=r.randint(1, 20))
        rows.append((2 * i, "utc", seen, f"{utc:%Y-%m-%dT%H:%M:%S}Z"))
        rows.append((2 * i + 1, "lost", seen, f"{utc + dt.timedelta(hours=5, minutes=30):%Y-%m-%d %H:%M:%S}"))
    rows += [(10_000 + i, "lost", x[2], x[3]) for i, x in enumerate(rows[:200:2])]
    df = spark.createDataFrame(rows, "id long, source string, InsertDate timestamp_ntz, t string")
    got = {x["id"]: x["utc_time"] for x in timestamps.to_utc(df, "id", "source", "InsertDate", ["t"], "eta", clocks).collect()}
    assert all(got[2 * i + 1] == got[2 * i] for i in range(300))


def test_undeclared_clock_that_moves_and_rows_without_arrival(spark, clocks):
    from zoneinfo import ZoneInfo

    r = random.Random(2)
    rows, truth = [], {}
    start = dt.datetime(2024, 1, 1)
    for i in range(4000):
        seen = start + dt.timedelta(minutes=i * 130)
        utc = seen - dt.timedelta(minutes=r.randint(1, 20))
        rows.append((2 * i, "utc", seen, f"{utc:%Y-%m-%dT%H:%M:%S}Z", "x"))
        zone = ZoneInfo("Asia/Kolkata" if seen < dt.datetime(2024, 5, 10) else "America/New_York" if seen < dt.datetime(2024, 11, 20) else "Asia/Tokyo")
        wall = utc.replace(tzinfo=dt.UTC).astimezone(zone)
        if wall.replace(tzinfo=None).replace(fold=0).replace(tzinfo=zone).astimezone(dt.UTC).replace(tzinfo=None) == utc:  # not the second of two
            truth[2 * i + 1] = f"{utc:%Y-%m-%d %H:%M:%S}.000000"
        rows.append((2 * i + 1, "moves", seen, f"{wall:%Y-%m-%d %H:%M:%S}", "x"))
    df = spark.createDataFrame(rows, "id long, source string, InsertDate timestamp_ntz, t string, day string")
    got = {x["id"]: x["utc_time"] for x in timestamps.to_utc(df, "id", "source", "InsertDate", ["t"], "eta", clocks).collect()}
    assert all(got[k] == t for k, t in truth.items()) and len(truth) > 3990
    # without arrival the order of rows tells when they came
    some = [(*x[:2], None if x[0] % 7 == 1 else x[2], *x[3:]) for x in rows]
    long = timestamps.fields_long(spark.createDataFrame(some, df.schema), "id", "source", "InsertDate", ["t"]).withColumn("order", timestamps.F.lit("dmy"))
    read = timestamps.read(long, "field_text", timestamps.F.lit(False), "order", "InsertDate")
    found = timestamps.estimate_history(read, "id", "source", "InsertDate", timestamps.candidates(clocks)).collect()
    assert sum(x["rows"] for x in found) == 4000 and {x["zone"] for x in found} == {"Asia/Kolkata", "America/New_York", "Asia/Tokyo"}


def test_cheapest_history():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(20):
        bad = r.integers(0, 6, (6, 3)).astype(float)
        cost = lambda p: sum(bad[t, z] for t, z in enumerate(p)) + 4 * sum(a != b for a, b in itertools.pairwise(p))
        assert cost(timestamps.cheapest_history(bad, 4.0)) == min(map(cost, itertools.product(range(3), repeat=6)))


def test_empty(spark, clocks):
    df = spark.createDataFrame([], "id long, source string, InsertDate timestamp_ntz, t string")
    assert timestamps.to_utc(df, "id", "source", "InsertDate", ["t"], "eta", clocks).count() == 0
