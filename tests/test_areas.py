import math
import random

import numpy as np

from plumbline.operators.areas import cover_polygon, points_in_polygons


def inside(p, ring):
    """Angle sum around the point, on the sphere."""
    v = lambda a: np.array([math.cos(math.radians(a[0])) * math.cos(math.radians(a[1])), math.cos(math.radians(a[0])) * math.sin(math.radians(a[1])), math.sin(math.radians(a[0]))])
    o = v(p)
    tangent = [v(c) - (v(c) @ o) * o for c in ring]
    total = 0.0
    for a, b in zip(tangent, tangent[1:] + tangent[:1], strict=True):
        total += math.atan2(o @ np.cross(a, b), a @ b)
    return abs(total) > math.pi and (v(p) @ sum(v(c) for c in ring)) > 0


def star(r, lat, lon, size, corners):
    """A ring around a place, made on its tangent plane."""
    o = np.array([math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat))])
    e = np.cross([0.3, 0.5, 0.8], o)
    e /= np.linalg.norm(e)
    f = np.cross(o, e)
    out = []
    for k in range(corners):
        d = math.tan(math.radians(size * r.uniform(0.4, 1.0)))
        w = o + d * (math.cos(2 * math.pi * k / corners) * e + math.sin(2 * math.pi * k / corners) * f)
        w /= np.linalg.norm(w)
        out.append((math.degrees(math.asin(w[2])), math.degrees(math.atan2(w[1], w[0]))))
    return out


def test_polygons_match_brute_force(spark):
    r = random.Random(1)
    places = [(51.0, 3.0, 0.5), (0.0, 180.0, 2.0), (89.5, 0.0, 1.0), (-89.9, 0.0, 0.6), (35.26439, 45.0, 3.0), (10.0, 45.0, 20.0), (-20.0, -130.0, 0.01)]
    rings = [(i, star(r, *p, r.randint(3, 12))) for i, p in enumerate(places * 2)]
    points = []
    for i, (_, ring) in enumerate(rings):
        size = places[i % len(places)][2] * 1.3
        points += [(i * 100 + k, *star(r, *places[i % len(places)][:2], size * math.sqrt(r.random()), 3)[0]) for k in range(90)]
    areas = [(i, [{"a": a, "b": b} for a, b in ring]) for i, ring in rings] + [(90, None), (91, [{"a": 1.0, "b": 2.0}]), (None, [{"a": 1.0, "b": 2.0}] * 3)]
    p = spark.createDataFrame([*points, (None, 51.0, 3.0), (7777, None, 3.0)], "id long, lat double, lon double")
    a = spark.createDataFrame(areas, "id long, ring array<struct<a double, b double>>")
    want = {(x[0], i) for x in points for i, ring in rings if inside(x[1:], ring)}
    for fine in (9, 14):
        got = [tuple(x) for x in points_in_polygons(p, "id", "lat", "lon", a, "id", "ring", fine).collect()]
        assert len(want) > 300 and len(got) == len(set(got)) and set(got) == want
    assert points_in_polygons(p, "id", "lat", "lon", a, "id", "ring", 12, 64, 0).count() == len(want)
    assert points_in_polygons(p.limit(0), "id", "lat", "lon", a.limit(0), "id", "ring").count() == 0


def test_interior_cells_take_most_of_a_large_area():
    cells = cover_polygon([(10.0, 10.0), (10.0, 30.0), (30.0, 30.0), (30.0, 10.0)], 10, 4096)
    area = lambda c: 4.0 ** -next(k for k in range(25) if 6 * k * 4**k <= c[0] < 6 * (k + 1) * 4**k)
    rim = sum(area(c) for c in cells if not c[1])
    assert sum(area(c) for c in cells if c[1]) > 20 * rim
