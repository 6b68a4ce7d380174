"""Distances, projections and rings."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kilometres; fixed values of the three distances in use.
EARTH, MEAN_EARTH = 6371.0, 6371.0088
DEGREE_KM = 111.32


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH) -> Column:
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.sin(a) * F.sin(a) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(b) * F.sin(b)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


#: Clarke 1880 (IGN), WGS84, the shift between them in metres, and the Merchich grid of the north; fixed values.
CLARKE_A, CLARKE_F = 6378249.2, 1 / 293.4660212936269
WGS_A, WGS_F = 6378137.0, 1 / 298.257223563
SHIFT = (31.0, 146.0, 47.0)
LAT0, LON0, SCALE, X0, Y0 = 33.3, -5.4, 0.999625769, 500000.0, 300000.0


def merchich_to_degrees(x: Column, y: Column) -> Column:
    """struct(lat, lng) in WGS84 of a Lambert conformal conic easting and northing in metres (one standard parallel)."""
    e2 = CLARKE_F * (2 - CLARKE_F)
    e, phi0 = math.sqrt(e2), math.radians(LAT0)
    n = math.sin(phi0)

    def iso(phi: float) -> float:
        s = e * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    m0 = math.cos(phi0) / math.sqrt(1 - e2 * math.sin(phi0) ** 2)
    cone = m0 / (n * iso(phi0) ** n)
    rho0 = CLARKE_A * cone * iso(phi0) ** n
    east, north = (x - X0) / SCALE, F.lit(rho0) - (y - Y0) / SCALE
    t = F.pow(F.sqrt(east * east + north * north) / (CLARKE_A * cone), F.lit(1 / n))
    def closer(phi: Column) -> Column:
        s = F.lit(e) * F.sin(phi)
        return F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(e / 2)))

    def shifted(phi: Column, lam: Column) -> Column:
        v = F.lit(CLARKE_A) / F.sqrt(1 - F.lit(e2) * F.sin(phi) * F.sin(phi))
        return F.struct((v * F.cos(phi) * F.cos(lam) + SHIFT[0]).alias("x"), (v * F.cos(phi) * F.sin(lam) + SHIFT[1]).alias("y"), (v * (1 - e2) * F.sin(phi) + SHIFT[2]).alias("z"))

    def degrees(g: Column) -> Column:
        w2, b = WGS_F * (2 - WGS_F), WGS_A * (1 - WGS_F)
        p = F.sqrt(g["x"] * g["x"] + g["y"] * g["y"])
        th = F.atan2(g["z"] * WGS_A, p * b)
        lat = F.atan2(g["z"] + F.lit(w2 / (1 - w2) * b) * F.pow(F.sin(th), F.lit(3.0)), p - F.lit(w2 * WGS_A) * F.pow(F.cos(th), F.lit(3.0)))
        return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(g["y"], g["x"])).alias("lng"))

    # lambdas bind each step's value, so that the expression doesn't grow with its uses
    bound = lambda value, f: F.transform(F.array(value), f)[0]
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(math.pi / 2) - 2 * F.atan(t), lambda phi, _: closer(phi))
    place = F.struct(phi.alias("phi"), (F.lit(math.radians(LON0)) + F.atan2(east, north) / n).alias("lam"))
    return bound(bound(place, lambda p: shifted(p["phi"], p["lam"])), degrees)


def ring_measures(points: DataFrame, radius: float = MEAN_EARTH) -> DataFrame:
    """(ring, area_km2, shoelace, west, south, east, north) of closed rings (ring, seq, x, y; the last point is the first).

    The spherical area is of edges along parallels between vertices.
    """
    w = Window.partitionBy("ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = points.withColumns({"_k": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy("ring")), "_px": F.lag("x").over(w), "_py": F.lag("y").over(w), "_nx": F.lead("x").over(w)})
    # the first point's left neighbour is the last but one, as the last repeats the first
    rows = rows.withColumn("_bl", F.first(F.when(F.col("_k") == F.col("_n") - 1, F.col("x")), ignorenulls=True).over(whole))
    left = F.coalesce("_px", "_bl")
    term = F.when(F.col("_k") < F.col("_n"), (F.col("_nx") - left) * F.lit(math.pi / 180) * F.sin(F.radians("y")))
    shoe = F.when(F.col("_k") > 1, F.col("_px") * F.col("y") - F.col("x") * F.col("_py"))
    return rows.groupBy("ring").agg(
        (F.abs(F.sum(term)) * radius * radius / 2).alias("area_km2"), (F.abs(F.sum(shoe)) / 2).alias("shoelace"),
        F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"),
    )


def decoded_arcs(deltas: DataFrame, scale: tuple[float, float], shift: tuple[float, float]) -> DataFrame:
    """(arc, seq, x, y) of quantised arcs whose points are steps from the one before (arc, seq, dx, dy)."""
    w = Window.partitionBy("arc").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return deltas.select("arc", "seq", (F.sum("dx").over(w) * scale[0] + shift[0]).alias("x"), (F.sum("dy").over(w) * scale[1] + shift[1]).alias("y"))


Point = tuple[float, float]


def clip_half(ring: Sequence[Point], axis: int, limit: float, keep_below: bool) -> list[Point]:
    """A ring's part on one side of a line along an axis (Sutherland and Hodgman)."""
    inside = (lambda p: p[axis] <= limit) if keep_below else (lambda p: p[axis] >= limit)
    out: list[Point] = []
    for a, b in zip([*ring[-1:], *ring[:-1]], ring):
        if inside(a) != inside(b):
            t = (limit - a[axis]) / (b[axis] - a[axis])
            cross = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
            cross[axis] = limit
            out.append((cross[0], cross[1]))
        if inside(b):
            out.append(b)
    return out


def clip_box(ring: Sequence[Point], west: float, south: float, east: float, north: float) -> list[Point]:
    for axis, limit, below in ((0, west, False), (0, east, True), (1, south, False), (1, north, True)):
        ring = clip_half(ring, axis, limit, below) if ring else []
    return list(ring)


RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


@F.pandas_udf(RING)
def clipped(ring: pd.Series, box: pd.DataFrame) -> pd.Series:
    """A ring's part in a box (struct of west, south, east, north)."""
    def one(points, west, south, east, north):
        return [{"x": x, "y": y} for x, y in clip_box([(p["x"], p["y"]) for p in points], west, south, east, north)]

    return pd.Series([one(r, *b) for r, b in zip(ring, box.itertuples(index=False))])


@F.pandas_udf(RING)
def simplified(ring: pd.Series, tolerance: pd.Series) -> pd.Series:
    """A line without the points that lie within a tolerance of what is left (Douglas and Peucker)."""
    def one(points, limit):
        keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
        while todo:
            a, b = todo.pop()
            (ax, ay), (bx, by) = ((points[i]["x"], points[i]["y"]) for i in (a, b))
            span = math.hypot(bx - ax, by - ay)
            far, at = 0.0, None
            for i in range(a + 1, b):
                px, py = points[i]["x"], points[i]["y"]
                d = abs((bx - ax) * (ay - py) - (ax - px) * (by - ay)) / span if span else math.hypot(px - ax, py - ay)
                if d > far:
                    far, at = d, i
            if at is not None and far > limit:
                keep.add(at)
                todo += [(a, at), (at, b)]
        return [points[i] for i in sorted(keep)]

    return pd.Series([one(list(r), t) if len(r) > 2 else r for r, t in zip(ring, tolerance)])
