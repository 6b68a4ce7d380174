"""Geographic lookups: what is near a point, and what a point is in."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersight.functions.geo import DEGREE_KM, haversine
from tiersight.operators.ranks import best_of
from tiersight.operators.staging import stage


def near(units: DataFrame, lat: float, lng: float, radius_km: float, limit: int = 10) -> DataFrame:
    """Units (code, lat, lng) within a radius of one point, nearest first; a band of latitude comes before trigonometry."""
    band = units.where(F.abs(F.col("lat") - lat) <= radius_km / DEGREE_KM)
    found = band.withColumn("km", haversine(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))).where(F.col("km") <= radius_km)
    return found.orderBy("km", "code").limit(limit)


def within(points: DataFrame, units: DataFrame, radius_km: float, widest_lat: float = 60.0) -> DataFrame:
    """(point, code, km) of all pairs within a radius; points: point, lat, lng; units: code, lat, lng.

    Both sides are put in cells as wide as the radius, so that only neighbouring cells meet. Longitude
    cells hold up to `widest_lat` degrees of latitude.
    """
    high = radius_km / DEGREE_KM
    wide = high / math.cos(math.radians(widest_lat))
    cell = lambda c, size: F.floor(F.col(c) / size)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = points.select("point", F.col("lat").alias("plat"), F.col("lng").alias("plng"), cell("lat", high).alias("cy"), cell("lng", wide).alias("cx"))
    right = units.select("code", "lat", "lng", F.explode(around).alias("dy")).select("*", F.explode(around).alias("dx"))
    right = right.withColumns({"cy": cell("lat", high) + F.col("dy"), "cx": cell("lng", wide) + F.col("dx")})
    pairs = left.join(right, ["cy", "cx"]).where(F.abs(F.col("lat") - F.col("plat")) <= high)
    return pairs.withColumn("km", haversine(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng"))).where(F.col("km") <= radius_km).select("point", "code", "km")


#: Shares of the reach within which the nearest is looked for, one after the other.
REACHES = (1 / 64, 1 / 8, 1.0)


def nearest(points: DataFrame, units: DataFrame, reach_km: float) -> DataFrame:
    """(point, code, km): each point's nearest unit within reach, the smallest code of equals.

    What is at one place counts once: the units of a place under their smallest code, and places of points.
    A place that has a unit in a small reach has its nearest there, so that only the others look farther,
    and a dense map gives no more pairs than a thin one.
    """
    at = F.struct("lat", "lng")
    spots = stage(points.where("lat is not null and lng is not null").groupBy("lat", "lng").agg(F.count("*")).select(at.alias("point"), "lat", "lng"))
    held = stage(units.groupBy("lat", "lng").agg(F.min("code").alias("code")))
    first = [F.asc("km"), F.asc("code")]
    open_, out = spots, None
    for share in REACHES:
        found = best_of(within(open_, held, reach_km * share), ["point"], first).select("point.lat", "point.lng", "code", "km")
        # at the very edge of a small reach, rounding may leave out one of equals
        found = stage(found if share == 1.0 else found.where(F.col("km") < reach_km * share * (1 - 1e-9)))
        out = found if out is None else out.unionAll(found)
        open_ = open_.join(found.select("lat", "lng"), ["lat", "lng"], "left_anti")
    return best_of(points.join(out, ["lat", "lng"]).select("point", "code", "km"), ["point"], first)


#: Where the lines between tiles are, as a share of a tile, so that coordinates with few decimals are not on them.
SHIFT = 0.3819660112501051


def _tile(c: Column, tile: float) -> Column:
    return F.floor(c / tile - SHIFT)


def _line(k: Column, tile: float) -> Column:
    """The lower bound of tiles k."""
    return (k + SHIFT) * tile


def _x_at(y: Column) -> Column:
    """Where an edge (x1, y1, x2, y2) is at a height."""
    return F.col("x1") + F.try_divide(y - F.col("y1"), F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))


def _y_at(x: Column) -> Column:
    return F.col("y1") + F.try_divide(x - F.col("x1"), F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))


def _spans(a: str, b: str, at: Column) -> Column:
    return (F.col(a) > at) != (F.col(b) > at)


def tiled(edges: DataFrame, tile: float) -> tuple[DataFrame, DataFrame]:
    """Rings' edges (unit, x1, y1, x2, y2) on a grid: edges by the tiles that they pass, and the tiles wholly inside.

    The first has (unit, tx, ty, odd, x1, y1, x2, y2): odd tells whether the tile's lower right corner is
    inside by the even-odd rule. That follows from where edges cross the line below a row of tiles,
    summed up from the right, so that no edge is needed beyond its own tiles. The second has (unit, tx, ty).
    """
    a, b = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.select("unit", "x1", "y1", "x2", "y2").withColumn("ty", F.explode(F.sequence(_tile(a, tile), _tile(b, tile))))
    low, high = F.greatest(a, _line(F.col("ty"), tile)), F.least(b, _line(F.col("ty") + 1, tile))
    flat = F.col("y1") == F.col("y2")
    ends = [F.when(flat, F.col(x)).otherwise(F.least(F.greatest(_x_at(y), F.least("x1", "x2")), F.greatest("x1", "x2"))) for x, y in (("x1", low), ("x2", high))]
    hair = tile * 1e-9
    rows = rows.withColumns({"west": F.least(*ends) - hair, "east": F.greatest(*ends) + hair})
    laid = rows.withColumn("tx", F.explode(F.sequence(_tile(F.col("west"), tile), _tile(F.col("east"), tile)))).drop("west", "east")
    below = _line(F.col("ty"), tile)
    crossing = _spans("y1", "y2", below) & (_tile(_x_at(below), tile) == F.col("tx"))
    counted = laid.groupBy("unit", "ty", "tx").agg(F.sum(F.coalesce(crossing, F.lit(False)).cast("long")).alias("n"))
    from_right = Window.partitionBy("unit", "ty").orderBy(F.desc("tx"))
    to_right = F.coalesce(F.sum("n").over(from_right.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = counted.select("unit", "ty", "tx", (to_right % 2 == 1).alias("odd"), ((to_right + F.col("n")) % 2 == 1).alias("left_odd"), F.lead("tx").over(from_right).alias("next"))
    # between two tiles with edges all are inside or all outside
    inner = marks.where(F.col("left_odd") & (F.col("next") < F.col("tx") - 1)).select("unit", F.explode(F.sequence(F.col("next") + 1, F.col("tx") - 1)).alias("tx"), "ty")
    return laid.join(marks.select("unit", "tx", "ty", "odd"), ["unit", "tx", "ty"]), inner


def located(points: DataFrame, edges: DataFrame, tile: float) -> DataFrame:
    """(point, unit): the units whose rings a point is in by the even-odd rule; points: point, x, y; edges: unit, x1, y1, x2, y2.

    A point meets the edges of its own tile only: it is as odd as the tile's lower right corner, with a
    change for each edge between it and the tile's right side, and for each that crosses that side
    between there and the corner. Tiles wholly inside a unit need no edge. Points with a null or
    non-finite coordinate are nowhere, nor is anything in edges that have one.
    """
    sound = lambda df, *cols: df.where(" and ".join(f"abs({c}) < double('infinity')" for c in cols))
    passed, inner = tiled(sound(edges, "x1", "y1", "x2", "y2"), tile)
    at = sound(points, "x", "y").select("point", "x", "y", _tile(F.col("x"), tile).alias("tx"), _tile(F.col("y"), tile).alias("ty"))
    right, below = _line(F.col("tx") + 1, tile), _line(F.col("ty"), tile)
    x_at, y_at = _x_at(F.col("y")), _y_at(right)
    across = _spans("y1", "y2", F.col("y")) & (F.col("x") < x_at) & (x_at <= right)
    down = _spans("x1", "x2", right) & (y_at > below) & (y_at <= F.col("y"))
    met = at.join(passed, ["tx", "ty"]).select("point", "unit", "odd", (F.coalesce(across, F.lit(False)).cast("int") + F.coalesce(down, F.lit(False)).cast("int")).alias("n"))
    near = met.groupBy("point", "unit").agg(F.sum("n").alias("n"), F.first("odd").alias("odd")).where("(n % 2 = 1) <> odd").select("point", "unit")
    return near.unionAll(at.join(inner, ["tx", "ty"]).select("point", "unit"))


def boxes(edges: DataFrame) -> DataFrame:
    """(unit, west, south, east, north) of rings' edges."""
    ends = lambda f, g, a, b: f(g(a, b))
    return edges.groupBy("unit").agg(
        ends(F.min, F.least, "x1", "x2").alias("west"), ends(F.min, F.least, "y1", "y2").alias("south"), ends(F.max, F.greatest, "x1", "x2").alias("east"), ends(F.max, F.greatest, "y1", "y2").alias("north"),
    )


def in_boxes(points: DataFrame, units: DataFrame, tile: float) -> DataFrame:
    """(point, unit) of points in units' boxes (unit, west, south, east, north), bounds included; both are put in tiles of two axes."""
    laid = units.withColumn("tx", F.explode(F.sequence(_tile(F.col("west"), tile), _tile(F.col("east"), tile)))).withColumn("ty", F.explode(F.sequence(_tile(F.col("south"), tile), _tile(F.col("north"), tile))))
    at = points.select("point", "x", "y", _tile(F.col("x"), tile).alias("tx"), _tile(F.col("y"), tile).alias("ty"))
    return at.join(laid, ["tx", "ty"]).where("x >= west and x <= east and y >= south and y <= north").select("point", "unit")


def placed(places: DataFrame, edges: DataFrame, tile: float) -> DataFrame:
    """(point, unit, candidates): each place's unit, null outside of all, and how many units' boxes hold it.

    places: point, x, y. Only places that some box holds are held against rings; of several units the smallest counts.
    """
    boxed = in_boxes(places, boxes(edges), tile).groupBy("point").agg(F.count("*").alias("candidates"))
    held = places.join(boxed, "point")
    found = located(held, edges, tile).groupBy("point").agg(F.min("unit").alias("unit"))
    return places.select("point").join(boxed, "point", "left").join(found, "point", "left").select("point", "unit", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


def finest(points: DataFrame, levels: list[DataFrame], tile: float) -> DataFrame:
    """Each point's unit at the first level that has one (finest first)."""
    out = points
    for k, edges in enumerate(levels):
        out = out.join(best_of(located(points, edges, tile), ["point"], [F.asc("unit")]).withColumnRenamed("unit", f"_{k}"), "point", "left")
    names = [f"_{k}" for k in range(len(levels))]
    return out.withColumn("unit", F.coalesce(*names)).drop(*names)


def outlines(edges: DataFrame) -> DataFrame:
    """The outer edges of groups of units (grp, x1, y1, x2, y2): those that no other unit of the group shares."""
    swap = F.struct("x1", "y1") > F.struct("x2", "y2")
    ends = [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(n) for n, a, b in (("p", "x1", "x2"), ("q", "y1", "y2"), ("r", "x2", "x1"), ("s", "y2", "y1"))]
    return edges.select("grp", *ends).groupBy("grp", "p", "q", "r", "s").agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")


def tiles(points: DataFrame, zoom: int) -> DataFrame:
    """Points with the web map tile that they are in."""
    n = float(2**zoom)
    x = F.floor((F.col("lng") + 180) / 360 * n).cast("int")
    phi = F.radians("lat")
    y = F.floor((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n).cast("int")
    return points.withColumns({"tile_x": x, "tile_y": y})
