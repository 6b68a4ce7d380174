"""Outlines cut into map tiles that are split where they hold too many points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersight.functions.geo import clipped
from tiersight.operators.staging import stage


def _cut(rows: DataFrame, origin: tuple[float, float], margin: float) -> DataFrame:
    """Rings clipped to the tile (z, x, y) that they are put in; those with no area in it are left out."""
    size = F.pow(F.lit(0.5), F.col("z"))
    west, south = F.col("x") * size + origin[0], F.col("y") * size + origin[1]
    box = F.struct((west - margin).alias("west"), (south - margin).alias("south"), (west + size + margin).alias("east"), (south + size + margin).alias("north"))
    return rows.withColumn("points", clipped("points", box)).where(F.size("points") >= 3)


def adaptive_tiles(rings: DataFrame, origin: tuple[float, float], most: int = 2500, deepest: int = 8, margin: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(leaves, split) of rings (unit, ring, points), each an array of (x, y) whose last point may repeat the first.

    Tiles of zoom 0 are squares of one unit of length from `origin` on; a tile whose clipped rings have
    over `most` points together is split into four, down to zoom `deepest`. Children clip what their
    parent has clipped. leaves: z, x, y, unit, ring, points; split: z, x, y. Rings reach over the bounds
    of tiles by `margin`. Levels are written one after the other, at most `deepest` of them.
    """
    closed = F.col("points")[0] == F.element_at("points", -1)
    rows = rings.where(F.size("points") >= 3).select("unit", "ring", F.when(closed, F.slice("points", 1, F.size("points") - 1)).otherwise(F.col("points")).alias("points"))
    ends = lambda f, c: f(F.transform("points", lambda p: p[c]))

    def row(c: str, k: int) -> Column:
        return F.explode(F.sequence(F.floor(ends(F.array_min, c) - origin[k] - margin), F.floor(ends(F.array_max, c) - origin[k] + margin)))

    # the map's own tiles; the margin opens no others
    least, greatest = (lambda c, k: F.min(F.floor(ends(F.array_min, c) - origin[k]))), (lambda c, k: F.max(F.floor(ends(F.array_max, c) - origin[k])))
    x0, x1, y0, y1 = rows.agg(least("x", 0), greatest("x", 0), least("y", 1), greatest("y", 1)).first()
    level = rows.withColumn("x", row("x", 0)).withColumn("y", row("y", 1)).withColumn("z", F.lit(0))
    level = level.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    leaves, split = None, None
    for z in range(deepest + 1):
        level = stage(_cut(level, origin, margin).select("z", "x", "y", "unit", "ring", "points"))
        full = level.groupBy("z", "x", "y").agg(F.sum(F.size("points")).alias("n")).where(F.col("n") > (most if z < deepest else float("inf"))).drop("n")
        done = level.join(full, ["z", "x", "y"], "left_anti")
        leaves, split = (done, full) if leaves is None else (leaves.unionByName(done), split.unionByName(full))
        level = level.join(full, ["z", "x", "y"])
        if level.isEmpty():
            break
        quarter = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
        level = level.withColumn("q", quarter).select((F.col("z") + 1).alias("z"), (F.col("x") * 2 + F.col("q.a")).alias("x"), (F.col("y") * 2 + F.col("q.b")).alias("y"), "unit", "ring", "points")
    return leaves, split


def tile_steps(leaves: DataFrame, origin: tuple[float, float], unit: float) -> DataFrame:
    """Leaves with `flat`, their points as whole steps of `unit` from the tile's corner, x and y in turn, repeats of the one before left out."""
    size = F.pow(F.lit(0.5), F.col("z"))
    at = lambda p, c, k: F.floor((p[c] - (F.col(c) * size + origin[k])) / unit + 0.5).cast("long")
    cells = leaves.withColumn("cells", F.transform("points", lambda p: F.array(at(p, "x", 0), at(p, "y", 1))))
    return cells.withColumn("flat", F.flatten(F.expr("filter(cells, (c, i) -> i = 0 or c <> cells[i - 1])"))).drop("cells")
