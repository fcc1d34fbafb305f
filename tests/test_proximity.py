import math
import random

import pytest

from plumbline.operators.proximity import near_in_space_and_time, points_in_regions

R = 6_371_008.8


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.asin(min(1, math.sqrt(h)))


def good(p):
    return p[0] is not None and p[1] is not None and -90 <= p[0] <= 90 and -180 <= p[1] <= 180 and (p[0], p[1]) != (0, 0)


def around(r, lat, lon, spread):
    lat = max(-90.0, min(90.0, lat + r.uniform(-spread, spread)))
    lon += r.uniform(-spread, spread) / max(0.02, math.cos(math.radians(lat)))
    return lat, (lon + 180) % 360 - 180


CENTRES = [(0.0, 180.0), (0.001, -179.999), (89.99, 10.0), (-89.995, -100.0), (45.0, 45.0), (35.26439, 45.0), (0.0, 45.0), (-35.26439, 135.0), (10.0, 0.001), (51.9, 4.1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_regions_match_brute_force(spark, seed):
    r = random.Random(seed)
    ports = [(i, *around(r, *c, 0.01)) for i, c in enumerate(CENTRES * 2)] + [(900, None, 1.0), (901, 0.0, 0.0), (902, 91.0, 0.0)]
    points = [(i, *around(r, *r.choice(CENTRES), 0.04)) for i in range(1500)] + [(5000, None, None), (5001, 0.0, 0.0), (5002, 95.0, 3.0), (5003, float("nan"), 3.0), (None, 0.0, 180.0)]
    schema = "id long, lat double, lon double"
    got = points_in_regions(spark.createDataFrame(points, schema), "id", "lat", "lon", spark.createDataFrame(ports, schema), "id", "lat", "lon", 1500.0)
    want = {(p[0], q[0]) for p in points for q in ports if p[0] is not None and good(p[1:]) and good(q[1:]) and metres(p[1:], q[1:]) <= 1500}
    rows = [tuple(x) for x in got.collect()]
    assert len(want) > 500 and set(rows) == want and len(rows) == len(want)


def test_regions_without_broadcast(spark, monkeypatch):
    from plumbline.operators import proximity

    monkeypatch.setattr(proximity, "BROADCAST_ROWS", 0)
    ports = spark.createDataFrame([(1, 51.9, 4.1)], "id long, lat double, lon double")
    points = spark.createDataFrame([(7, 51.901, 4.101, "x"), (8, 52.9, 4.1, "y")], "id long, lat double, lon double, cell string")
    assert [tuple(x) for x in points_in_regions(points, "id", "lat", "lon", ports, "id", "lat", "lon", 1500.0).collect()] == [(7, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, own long, lat double, lon double, at timestamp")
    assert points_in_regions(none, "id", "lat", "lon", none, "id", "lat", "lon", 1500.0).count() == 0
    assert near_in_space_and_time(none, "id", "own", "lat", "lon", "at", 500.0, 120).count() == 0


@pytest.mark.parametrize("seed, crowd", [(3, 5000), (4, 5000), (3, 10), (4, 10)])
def test_neighbours_match_brute_force(spark, seed, crowd):
    import datetime as dt

    r = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    points = [(i, r.randint(1, 40), *around(r, *r.choice(CENTRES), 0.008), t0 + dt.timedelta(seconds=r.randint(0, 2000))) for i in range(700)]
    # a third of all rows in one place, all of one owner
    points += [(1000 + i, 99, 45.0, 45.0, t0 + dt.timedelta(seconds=i)) for i in range(300)]
    points += [(5000, None, 45.0, 45.0, t0), (5001, 5, 45.0, 45.0, None), (5002, 5, None, 45.0, t0)]
    df = spark.createDataFrame(points, "id long, own long, lat double, lon double, at timestamp_ntz")
    rows = [tuple(x) for x in near_in_space_and_time(df, "id", "own", "lat", "lon", "at", 500.0, 120, crowd=crowd).collect()]
    use = [p for p in points if good(p[2:4]) and p[1] is not None and p[4] is not None]
    want = {(a[0], b[0]) for a in use for b in use if a[0] < b[0] and a[1] != b[1] and abs((a[4] - b[4]).total_seconds()) <= 120 and metres(a[2:4], b[2:4]) <= 500}
    assert len(want) > 100 and set(rows) == want and len(rows) == len(want)
