"""Points near regions and points near points, on the whole globe.

Regions (caps around a centre) are covered by cells of different size: where a cell lies wholly inside, an equi-join on
its number accepts a point at once; along the rim small cells remain, and only matches in those get the exact distance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geo

#: Coverage rows up to which a coverage (24 bytes a row) is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Points of one cell of space and time above which it is cut along time.
CROWD = 5_000


def _corner(face: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Unit vectors of face coordinates."""
    u, v = np.tan(s * math.pi / 4), np.tan(t * math.pi / 4)
    own = np.where(face < 3, 1.0, -1.0)
    axis = face % 3
    x = np.where(axis == 0, own, u)
    y = np.where(axis == 1, own, np.where(axis == 0, u, v))
    z = np.where(axis == 2, own, v)
    p = np.stack([x, y, z], -1)
    return p / np.linalg.norm(p, axis=-1, keepdims=True)


def cover_caps(lat: np.ndarray, lon: np.ndarray, radius_m: float, coarse: int, fine: int) -> tuple[np.ndarray, ...]:
    """Cells that cover caps: (cap, level, face, i, j, interior), of level ``coarse`` to ``fine``.

    Cells of one cap don't overlap. A cell is interior when its corners are inside by more than a millimetre, which
    rounding never bridges. Rim cells are split down to ``fine``.
    """
    a, b = np.radians(lat), np.radians(lon)
    centre = np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], -1)
    reach = radius_m / geo.EARTH_M * geo.FACE_RATE
    n = 1 << coarse
    start = []
    for axis in range(3):
        own = centre[:, axis]
        rest = [k for k in range(3) if k != axis]
        depth = np.maximum(np.abs(own), 1e-300)
        s, t = (np.arctan2(centre[:, k], depth) * 4 / math.pi for k in rest)
        for cap in np.nonzero((np.abs(s) <= 1 + reach) & (np.abs(t) <= 1 + reach))[0]:
            lo_i, hi_i, lo_j, hi_j = (int(min(max(math.floor((c + d + 1) * n / 2), 0), n - 1)) for c in (s[cap], t[cap]) for d in (-reach, reach))
            face = axis if own[cap] >= 0 else axis + 3
            start += [(cap, face, i, j) for i in range(lo_i, hi_i + 1) for j in range(lo_j, hi_j + 1)]
    out = []
    left = np.array(start, dtype=np.int64).reshape(-1, 4)
    for level in range(coarse, fine + 1):
        cap, face, i, j = left.T
        w = 2.0 / (1 << level)
        corners = np.stack([_corner(face, i * w - 1 + di * w, j * w - 1 + dj * w) for di, dj in ((0, 0), (0, 1), (1, 0), (1, 1))], 1)
        middle = _corner(face, i * w - 1 + w / 2, j * w - 1 + w / 2)
        arc = lambda p, q: 2 * np.arcsin(np.minimum(1, np.linalg.norm(p - q, axis=-1) / 2)) * geo.EARTH_M
        own = centre[cap]
        far = arc(corners, own[:, None]).max(1)
        inside = far < radius_m - 0.001
        outside = arc(middle, own) > radius_m + arc(corners, middle[:, None]).max(1) + 0.001
        last = level == fine
        keep = inside | (~outside if last else np.zeros_like(inside))
        out.append(np.column_stack([cap, np.full(len(cap), level), face, i, j, inside])[keep])
        split = left[~inside & ~outside]
        left = np.concatenate([split * [1, 1, 2, 2] + [0, 0, di, dj] for di in (0, 1) for dj in (0, 1)]) if len(split) else split
    return tuple(np.concatenate(out).T)


def coverage(regions: DataFrame, region_id: str, lat: str, lon: str, radius_m: float, coarse: int, fine: int) -> DataFrame:
    """One row (region, cell, interior, rlat, rlon) for each cell of each region's coverage; unusable centres have none."""
    kind = dict(regions.dtypes)[region_id]

    def cover(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            cap, level, face, i, j, inside = cover_caps(pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), radius_m, coarse, fine)
            n = np.int64(1) << level
            yield pd.DataFrame({"region": pdf["region"].to_numpy()[cap], "cell": ((level * 6 + face) * n + i) * n + j, "interior": inside.astype(bool), "rlat": pdf["lat"].to_numpy()[cap], "rlon": pdf["lon"].to_numpy()[cap]})

    good = regions.where(geo.usable(F.col(lat), F.col(lon)) & F.col(region_id).isNotNull())
    good = good.select(F.col(region_id).alias("region"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    return good.mapInPandas(cover, f"region {kind}, cell long, interior boolean, rlat double, rlon double")


def _within(one: str, two: str, radius_m: float) -> Column:
    """The exact distance, after the difference of latitudes, which most pairs fail at less cost."""
    lat1, lon1, lat2, lon2 = (F.col(f"{side}{c}") for side in (one, two) for c in ("lat", "lon"))
    return (F.abs(lat1 - lat2) <= math.degrees(radius_m / geo.EARTH_M) * 1.000001) & (geo.distance_m(lat1, lon1, lat2, lon2) <= radius_m)


def points_in_regions(points: DataFrame, point_id: str, lat: str, lon: str, regions: DataFrame, region_id: str, region_lat: str, region_lon: str, radius_m: float, levels: int = 4) -> DataFrame:
    """Pairs (point, region) at most ``radius_m`` apart, one for each pair and repeated point row.

    Points or regions without usable coordinates or without id match nothing; tables may be empty. Points first meet
    the few coarse cells that any region touches, and only those that pass are spread over the levels. The coverage is
    broadcast when its counted rows are within ``BROADCAST_ROWS``; beyond that both joins shuffle on the cell number
    and leave hot cells to the skew join of adaptive execution.
    """
    coarse = max(1, math.floor(math.log2(math.pi / 2 * geo.EARTH_M / (1.6 * radius_m))))
    fine = min(24, coarse + levels)
    cover = coverage(regions, region_id, region_lat, region_lon, radius_m, coarse, fine)
    hint = F.broadcast if cover.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda df: df)
    x, y, z = geo.unit_vector(F.col(lat), F.col(lon))
    face, s, t = geo.home_face(F.col("px"), F.col("py"), F.col("pz"))
    spots = points.where(geo.usable(F.col(lat), F.col(lon)) & F.col(point_id).isNotNull()).select(F.col(point_id).alias("point"), F.col(lat).alias("plat"), F.col(lon).alias("plon"), x.alias("px"), y.alias("py"), z.alias("pz"))
    spots = spots.select("point", "plat", "plon", face.alias("face"), geo.step(s, fine).alias("i"), geo.step(t, fine).alias("j"))
    at = lambda level: geo.cell_id(level, F.col("face"), F.shiftright("i", fine - level), F.shiftright("j", fine - level))
    top = ancestors(cover.select("cell"), coarse, fine).distinct()
    near = spots.withColumn("top", at(coarse)).join(hint(top), "top", "left_semi")
    keyed = near.select("point", "plat", "plon", F.explode(F.array(*[at(k) for k in range(coarse, fine + 1)])).alias("cell"))
    return keyed.join(hint(cover), "cell").where(F.col("interior") | _within("p", "r", radius_m)).select("point", "region")


def ancestors(cells: DataFrame, coarse: int, fine: int) -> DataFrame:
    """The cells of level ``coarse`` that hold the given ones."""
    found = None
    for level in range(coarse, fine + 1):
        n, below = 1 << level, F.lit(level * 6).cast("long") * (1 << level) * (1 << level)
        rest = F.col("cell") - below
        in_level = cells.where((F.col("cell") >= below) & (F.col("cell") < F.lit((level + 1) * 6).cast("long") * n * n))
        face, i, j = F.expr(f"(cell - {level * 6}L * {n} * {n}) div ({n}L * {n})"), F.expr(f"((cell - {level * 6}L * {n} * {n}) div {n}) % {n}"), rest % n
        up = in_level.select(geo.cell_id(coarse, face, F.shiftright(i, level - coarse), F.shiftright(j, level - coarse)).alias("top"))
        found = up if found is None else found.unionByName(up)
    return found


def near_in_space_and_time(points: DataFrame, point_id: str, owner: str, lat: str, lon: str, at: str, radius_m: float, seconds: int, counted: DataFrame | None = None, crowd: int = CROWD) -> DataFrame:
    """Pairs (id_a < id_b) of points of different owners at most ``radius_m`` and ``seconds`` apart, each pair once.

    ``points`` has one row a point id. Null ids, owners, times and unusable coordinates match nothing. Each point lies in
    one cell of space and time, and copies go to the later cells that its reach touches (half a copy a point on average),
    so that one equi-join finds all pairs. Points in the same small cell are near by construction; others get the exact
    distance. Cells with more than ``crowd`` points are cut into stretches of ``seconds``: a point then meets those of its
    own stretch and of the two beside it, whatever the cell holds. ``counted`` has the columns of ``points`` and at least
    its rows, where these are cheaper to count.
    """
    reach = radius_m / geo.EARTH_M * geo.FACE_RATE
    level = max(0, min(20, math.floor(math.log2(1 / (3.2 * reach)))))
    # A cell of this finer level is at most 90 degrees / 2**sub wide; its diagonal is within the radius.
    sub = max(level, math.ceil(math.log2(math.pi / 2 * geo.EARTH_M * math.sqrt(2) / radius_m) + 1e-9))
    width = 8 * seconds
    slot = lambda shift: F.floor((F.col("us") + shift) / F.lit(width * 1_000_000)).cast("long")

    def placed(rows: DataFrame) -> DataFrame:
        x, y, z = geo.unit_vector(F.col("lat"), F.col("lon"))
        good = rows.where(geo.usable(F.col(lat), F.col(lon)) & F.col(point_id).isNotNull() & F.col(owner).isNotNull() & F.col(at).isNotNull())
        micros = F.unix_micros(F.col(at).cast("timestamp"))
        there = good.select(F.col(point_id).alias("id"), F.col(owner).alias("own"), micros.alias("us"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
        there = there.select("*", x.alias("x"), y.alias("y"), z.alias("z"))
        face, s, t = geo.home_face(F.col("x"), F.col("y"), F.col("z"))
        there = there.select("*", face.alias("face"), geo.step(s, sub).alias("fi"), geo.step(t, sub).alias("fj"))
        home_cell = geo.cell_id(level, F.col("face"), F.shiftright("fi", sub - level), F.shiftright("fj", sub - level))
        below = (1 << (sub - level)) - 1
        part = (F.col("fi").bitwiseAND(below) * (below + 1) + F.col("fj").bitwiseAND(below)).cast("int")
        return there.select("id", "own", "us", "lat", "lon", "x", "y", "z", home_cell.alias("home"), slot(0).alias("now"), part.alias("part"))

    spots = placed(points)
    # Cells are counted by a hash: two that share it may count as crowded together, which only cuts them without need.
    crowded = placed(points if counted is None else counted).groupBy(F.hash("home", "now").alias("hot")).count().where(F.col("count") > crowd).select("hot")
    n_crowded = crowded.count()
    kept = ("id", "own", "us", "lat", "lon")
    one = spots.select("home", F.col("now").alias("slot"), *[F.col(c).alias(f"a_{c}") for c in (*kept, "part")])

    touched = []
    for axis in range(3):
        f, s, t = geo.face_coordinates(F.col("x"), F.col("y"), F.col("z"), axis)
        limit = 1 + reach
        i, j = (F.array(geo.step(c - reach, level), geo.step(c + reach, level)) for c in (s, t))
        # A cell is wider than twice the reach, so each axis touches two cells at most.
        cells = F.array_distinct(F.array(*[geo.cell_id(level, f, i[m], j[n]) for m in (0, 1) for n in (0, 1)]))
        touched.append(F.when((F.abs(s) <= limit) & (F.abs(t) <= limit), cells).otherwise(F.array().cast("array<bigint>")))
    two = spots.select(*kept, "part", "home", "now", F.explode(F.concat(*touched)).alias("cell"))
    two = two.withColumn("slot", F.explode(F.sequence(slot(-seconds * 1_000_000), slot(seconds * 1_000_000))))
    # Of two points in different cells, the one in the lesser cell is copied; that finds the pair once.
    same = (F.col("cell") == F.col("home")) & (F.col("slot") == F.col("now"))
    two = two.where(same | (F.col("cell") > F.col("home")) | ((F.col("cell") == F.col("home")) & (F.col("slot") > F.col("now"))))
    two = two.select(F.col("cell").alias("home"), "slot", *[F.col(c).alias(f"b_{c}") for c in kept], F.when(F.col("cell") == F.col("home"), F.col("part")).otherwise(F.lit(-1)).alias("b_part"), same.alias("b_home"))
    stretch = lambda us: F.floor(us / F.lit(seconds * 1_000_000)).cast("long")
    if n_crowded:
        hint = F.broadcast if n_crowded <= BROADCAST_ROWS else (lambda df: df)
        none = F.lit(-(2**62)).cast("long")
        is_hot, cell = F.col("hot").isNotNull(), F.hash("home", "slot") == F.col("hot")
        one = one.join(hint(crowded), cell, "left").withColumn("stretch", F.when(is_hot, stretch(F.col("a_us"))).otherwise(none)).drop("hot")
        beside = F.sequence(stretch(F.col("b_us")) - 1, stretch(F.col("b_us")) + 1)
        two = two.join(hint(crowded), cell, "left").withColumn("stretch", F.explode(F.when(is_hot, beside).otherwise(F.array(none)))).drop("hot")
    met = one.join(two, ["home", "slot", *(["stretch"] if n_crowded else [])]).where(
        (F.abs(F.col("a_us") - F.col("b_us")) <= seconds * 1_000_000) & (F.col("a_own") != F.col("b_own")) & (~F.col("b_home") | (F.col("a_id") < F.col("b_id"))) & ((F.col("a_part") == F.col("b_part")) | _within("a_", "b_", radius_m))
    )
    return met.select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"))
