"""Points inside polygons on the sphere, by adaptive coverage.

Sides are great circles, which a cube face shows as straight lines, so each face holds a plane polygon. Cells that no side
meets are wholly inside or outside; the rest are split down to the last level and keep the sides that meet them, with
whether their middle is inside. A point in such a cell is inside if the way from the middle to it crosses an even number of
these sides, or odd if the middle is outside: a containment test over a few sides, however many the polygon has.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geo
from plumbline.operators.proximity import ancestors
from plumbline.session import cut


def _vectors(ring: np.ndarray) -> np.ndarray:
    a, b = np.radians(ring[:, 0]), np.radians(ring[:, 1])
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], -1)


def _on_face(points: np.ndarray, axis: int, side: float) -> np.ndarray:
    """The part of a spherical polygon on one cube face, as its corners in the face's plane; empty if there is none."""
    rest = [k for k in range(3) if k != axis]
    planes = []
    for k in rest:
        for sign in (1.0, -1.0):
            n = np.zeros(3)
            n[axis], n[k] = side, sign
            planes.append(n)  # own side at least as large as the other coordinate
    poly = list(points)
    for n in planes:
        out = []
        for p, q in zip(poly, poly[1:] + poly[:1], strict=True):
            dp, dq = float(n @ p), float(n @ q)
            if dp >= 0:
                out.append(p)
            if (dp >= 0) != (dq >= 0):
                cut = p * dq - q * dp if dq > dp else q * dp - p * dq
                out.append(cut / (np.linalg.norm(cut) or 1.0))
        poly = out
        if not poly:
            return np.zeros((0, 2))
    flat = np.array(poly)
    depth = np.abs(flat[:, axis])
    return np.stack([flat[:, k] / np.maximum(depth, 1e-300) for k in rest], -1)


def _crossings(p: np.ndarray, q: np.ndarray, sides: np.ndarray) -> int:
    """How many sides (u1, v1, u2, v2) the way from p to q crosses."""
    d = q - p
    a, b = sides[:, :2] - p, sides[:, 2:] - p
    one, two = d[0] * a[:, 1] - d[1] * a[:, 0], d[0] * b[:, 1] - d[1] * b[:, 0]
    s = sides[:, 2:] - sides[:, :2]
    c = s[:, 0] * (p[1] - sides[:, 1]) - s[:, 1] * (p[0] - sides[:, 0])
    e = s[:, 0] * (q[1] - sides[:, 1]) - s[:, 1] * (q[0] - sides[:, 0])
    return int((((one > 0) != (two > 0)) & ((c > 0) != (e > 0))).sum())


def _meets(sides: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which sides meet a box, by clipping each to it."""
    start, way = sides[:, :2], sides[:, 2:] - sides[:, :2]
    t0, t1 = np.zeros(len(sides)), np.ones(len(sides))
    ok = np.ones(len(sides), bool)
    for k in range(2):
        flat = np.abs(way[:, k]) < 1e-300
        ok &= ~flat | ((start[:, k] >= lo[k]) & (start[:, k] <= hi[k]))
        safe = np.where(flat, 1.0, way[:, k])
        a, b = (lo[k] - start[:, k]) / safe, (hi[k] - start[:, k]) / safe
        t0 = np.where(flat, t0, np.maximum(t0, np.minimum(a, b)))
        t1 = np.where(flat, t1, np.minimum(t1, np.maximum(a, b)))
    return ok & (t0 <= t1 + 1e-12)


def cover_polygon(ring: list[tuple[float, float]], fine: int, most_cells: int) -> list[tuple[int, bool, bool, float, float, list[float]]]:
    """(cell, interior, middle_inside, middle_u, middle_v, sides) of one polygon given by its (latitude, longitude) corners.

    Sides come as u1, v1, u2, v2 in a row and are empty for interior cells. Splitting goes level by level and ends at
    ``fine``, or before a level that would hold more than ``most_cells`` rim cells; what is left then is tested exactly,
    so both only trade cells for tests. The polygon must fit in a hemisphere.
    """
    points = _vectors(np.array(ring, dtype=float))
    out = []
    for axis in range(3):
        for side in (1.0, -1.0):
            flat = _on_face(points, axis, side)
            if len(flat) < 3:
                continue
            face = axis + (0 if side > 0 else 3)
            sides = np.concatenate([flat, np.roll(flat, -1, 0)], 1)
            outside = np.array([3.0, 3.7])  # off the face
            level, cells = 0, [(0, 0, sides)]
            while cells:
                last = level >= fine or 4 * len(cells) > most_cells and level >= 1
                n, later = 1 << level, []
                for i, j, near in cells:
                    lo = np.tan((np.array([i, j]) * 2.0 / n - 1) * math.pi / 4)
                    hi = np.tan(((np.array([i, j]) + 1) * 2.0 / n - 1) * math.pi / 4)
                    pad = (hi - lo) * 1e-9
                    met = near[_meets(near, lo - pad, hi + pad)]
                    middle = np.tan(((np.array([i, j]) + 0.5) * 2.0 / n - 1) * math.pi / 4)
                    if len(met) and not last:
                        later += [(2 * i + a, 2 * j + b, met) for a in (0, 1) for b in (0, 1)]
                        continue
                    inside = _crossings(outside, middle, sides) % 2 == 1
                    if len(met) or inside:
                        out.append((int(((level * 6 + face) * n + i) * n + j), not len(met), inside, float(middle[0]), float(middle[1]), met.ravel().tolist()))
                cells, level = later, level + 1
    return out


def points_in_polygons(points: DataFrame, point_id: str, lat: str, lon: str, areas: DataFrame, area_id: str, ring: str, fine: int = 14, most_cells: int = 4096, broadcast_cells: int = 500_000) -> DataFrame:
    """Pairs (point, area), one for each polygon that holds the point and each repeated point row.

    ``ring`` is an array of structs of latitude and longitude (two doubles each). Unusable points, null ids and rings with
    fewer than three corners or any null match nothing. The coverage is written once, counted by level, and broadcast up to
    ``broadcast_cells``. Points first meet the cells of its coarsest level, and only those that pass are spread over the
    levels that occur.
    """
    kind = dict(areas.dtypes)[area_id]

    def cover(batches):
        for pdf in batches:
            rows = []
            for area, corners in zip(pdf["area"], pdf["ring"], strict=True):
                rows += [(area, *x) for x in cover_polygon([tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in corners], fine, most_cells)]
            yield pd.DataFrame(rows, columns=["area", "cell", "interior", "within", "mu", "mv", "sides"])

    good = areas.where(F.col(area_id).isNotNull() & (F.size(ring) >= 3) & ~F.coalesce(F.exists(ring, lambda c: c.isNull()), F.lit(True)))
    cells = cut(good.select(F.col(area_id).alias("area"), F.col(ring).alias("ring")).mapInPandas(cover, f"area {kind}, cell long, interior boolean, within boolean, mu double, mv double, sides array<double>"))
    levels = {r["level"]: r["n"] for r in cells.groupBy(geo.level_of(F.col("cell"), fine).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a level
    hint = F.broadcast if sum(levels.values()) <= broadcast_cells else (lambda df: df)
    coarse = min(levels, default=0)
    x, y, z = geo.unit_vector(F.col(lat), F.col(lon))
    face, s, t = geo.home_face(F.col("x"), F.col("y"), F.col("z"))
    spots = points.where(geo.usable(F.col(lat), F.col(lon)) & F.col(point_id).isNotNull()).select(F.col(point_id).alias("point"), x.alias("x"), y.alias("y"), z.alias("z"))
    spots = spots.select("point", face.alias("face"), s.alias("s"), t.alias("t"))
    at = lambda k: geo.cell_id(k, F.col("face"), geo.step(F.col("s"), k), geo.step(F.col("t"), k))
    top = ancestors(cells.select("cell"), coarse, max(levels, default=0)).distinct()
    near = spots.withColumn("top", at(coarse)).join(hint(top), "top", "left_semi").drop("top")
    keyed = near.select("*", F.explode(F.array(*[at(k) for k in sorted(levels) or [0]])).alias("cell"))
    met = keyed.join(hint(cells), "cell")
    return met.where(F.col("interior") | _inside()).select("point", "area")


def _inside() -> Column:
    """The exact test in a rim cell: parity of the sides crossed on the way from the cell's middle to the point."""
    pu, pv = F.col("mu"), F.col("mv")
    qu, qv = F.tan(F.col("s") * (math.pi / 4)), F.tan(F.col("t") * (math.pi / 4))
    way = F.struct(pu.alias("pu"), pv.alias("pv"), (qu - pu).alias("du"), (qv - pv).alias("dv"), qu.alias("qu"), qv.alias("qv"))

    def crossed(w: Column, m: Column) -> Column:
        u1, v1, u2, v2 = (F.get("sides", m * 4 + d) for d in range(4))
        one, two = w["du"] * (v1 - w["pv"]) - w["dv"] * (u1 - w["pu"]), w["du"] * (v2 - w["pv"]) - w["dv"] * (u2 - w["pu"])
        c = (u2 - u1) * (w["pv"] - v1) - (v2 - v1) * (w["pu"] - u1)
        e = (u2 - u1) * (w["qv"] - v1) - (v2 - v1) * (w["qu"] - u1)
        return (((one > 0) != (two > 0)) & ((c > 0) != (e > 0))).cast("int")

    count = F.get(F.transform(F.array(way), lambda w: F.aggregate(F.sequence(F.lit(0), (F.size("sides") / 4).cast("int") - 1), F.lit(0), lambda sofar, m: sofar + crossed(w, m))), F.lit(0))
    return (count % 2 == 0) == F.col("within")
