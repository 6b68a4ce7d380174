"""Boundaries as shared arcs: cutting rings where units meet, joining arcs into rings again, and dissolving units.

A vertex where rings go on differently is a junction; rings are cut there, so that a boundary of two
units is one arc, stored once. Vertices meet by their place, arcs by their points; a task holds one ring.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiersight.operators import graph, places
from tiersight.operators.staging import stage

POINTS = "array<struct<x:double,y:double>>"
CELLS = "array<struct<x:bigint,y:bigint>>"


class Topology(NamedTuple):
    """arcs: part, arc (from 0 in each part), cells; uses: part, unit, ring, place, arc, back; grid: part, x0, y0, kx, ky."""

    arcs: DataFrame
    uses: DataFrame
    grid: DataFrame


def quantised(rings: DataFrame, steps: int = 100_000, widest: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Rings' points (part, unit, ring, seq, x, y) on a grid of `steps` by `steps` over each part: (points, grid).

    widest: the grid of a part that would have wider cells gets more steps, so that places are as exact in a part of any
    extent. Points that fall on the one before, and the last where it repeats the first, are left out.
    """
    even = lambda c: (F.max(c) - F.min(c)) / (steps - 1)
    width = lambda c: F.coalesce(F.nullif(even(c) if widest is None else F.least(even(c), F.lit(widest)), F.lit(0.0)), F.lit(1.0))
    grid = rings.groupBy("part").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), width("x").alias("kx"), width("y").alias("ky"))
    cell = lambda c: F.floor((F.col(c) - F.col(f"{c}0")) / F.col(f"k{c}") + 0.5).cast("long")
    own = Window.partitionBy("part", "unit", "ring")
    on = rings.join(grid, "part").select("part", "unit", "ring", "seq", cell("x").alias("x"), cell("y").alias("y")).withColumn("at", F.struct("x", "y"))
    kept = on.withColumn("before", F.lag("at").over(own.orderBy("seq"))).where("before is null or before <> at").drop("before")
    kept = kept.withColumns({"head": F.first("at").over(own.orderBy("seq")), "later": F.lead("at").over(own.orderBy("seq")), "n": F.row_number().over(own.orderBy("seq"))})
    return kept.where("not (later is null and head = at and n > 1)").drop("later", "n", "head"), grid


def degenerate(points: DataFrame) -> DataFrame:
    """(part, unit, ring) of rings that have fewer than three different points left."""
    return points.groupBy("part", "unit", "ring").agg(F.count_distinct("at").alias("n")).where("n < 3").drop("n")


def _cut(points: list[tuple], joints: list[bool]) -> list[list[tuple]]:
    """A closed ring's pieces between junctions, each with both its ends; a ring without one begins at its least point."""
    at = [k for k, j in enumerate(joints) if j] or [min(range(len(points)), key=points.__getitem__)]
    turned = points[at[0] :] + points[: at[0] + 1]
    edges = [k - at[0] for k in at] + [len(points)]
    return [turned[a : b + 1] for a, b in zip(edges, edges[1:])]


def built(rings: DataFrame, steps: int = 100_000, widest: float | None = None) -> Topology:
    """The topology of rings (part, unit, ring, seq, x, y), each part on a grid of its own (`quantised`).

    part: what is written as one document, such as a region; rings: numbered within their unit. A ring
    that the grid leaves without three different points is an error that names its unit, as its area
    would be lost; so a unit that has rings is covered.
    """
    points, grid = quantised(rings, steps, widest)
    own = Window.partitionBy("part", "unit", "ring")
    points = stage(points)
    lost = [f"{r.unit} ring {r.ring}" for r in degenerate(points).select("unit", "ring").orderBy("unit", "ring").limit(20).collect()]
    if lost:
        raise ValueError(f"rings without area on a grid of {steps}: {', '.join(lost)}")
    ends = [F.first("at").over(own.orderBy(F.col("seq"))), F.first("at").over(own.orderBy(F.desc("seq")))]
    before, after = F.coalesce(F.lag("at").over(own.orderBy("seq")), ends[1]), F.coalesce(F.lead("at").over(own.orderBy("seq")), ends[0])
    around = points.select("part", "at", before.alias("p"), after.alias("q")).select("part", "at", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    joints = around.groupBy("part", "at").agg(F.count("*").alias("n")).where("n > 1").select("part", "at", F.lit(True).alias("joint"))
    flagged = points.join(joints, ["part", "at"], "left").select("part", "unit", "ring", F.struct("seq", "x", "y", F.coalesce("joint", F.lit(False)).alias("joint")).alias("v"))
    whole = flagged.groupBy("part", "unit", "ring").agg(F.array_sort(F.collect_list("v")).alias("v"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, back, cells = [], [], [], []
            for k, ring in enumerate(batch.column("v").to_pylist()):
                for n, piece in enumerate(_cut([(v["x"], v["y"]) for v in ring], [v["joint"] for v in ring])):
                    turned = piece[::-1]
                    row.append(k)
                    place.append(n)
                    back.append(turned < piece)
                    cells.append([{"x": x, "y": y} for x, y in min(piece, turned)])
            kept = [batch.column(c).take(pa.array(row, pa.int64())) for c in ("part", "unit", "ring")]
            typed = pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(place, pa.int32()), pa.array(back, pa.bool_()), pa.array(cells, typed)], ["part", "unit", "ring", "place", "back", "cells"])

    kinds = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in ("part", "unit", "ring"))
    pieces = stage(whole.mapInArrow(each, f"{kinds}, place int, back boolean, cells {CELLS}"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("cells")) - 1
    arcs = stage(pieces.select("part", "cells").distinct().select("part", number.cast("long").alias("arc"), "cells"))
    uses = pieces.join(arcs, ["part", "cells"]).select("part", "unit", "ring", "place", "arc", "back")
    return Topology(arcs, stage(uses), stage(grid))


def steps_of(arcs: DataFrame) -> DataFrame:
    """(part, arc, deltas): each arc as its first cell and the steps from there on, as it is written."""
    change = F.expr("transform(cells, (c, i) -> if(i = 0, array(c.x, c.y), array(c.x - cells[i - 1].x, c.y - cells[i - 1].y)))")
    return arcs.select("part", "arc", change.alias("deltas"))


def summed_steps(arcs: DataFrame) -> DataFrame:
    """(part, arc, cells) of arcs written as steps."""
    start = F.expr(f"named_struct('x', 0L, 'y', 0L, 'all', cast(array() as {CELLS}))")
    step = lambda a, d: F.struct((a["x"] + d[0]).alias("x"), (a["y"] + d[1]).alias("y"), F.array_append(a["all"], F.struct((a["x"] + d[0]).alias("x"), (a["y"] + d[1]).alias("y"))).alias("all"))
    return arcs.select("part", "arc", F.aggregate("deltas", start, step, lambda a: a["all"]).alias("cells"))


def _placed(cells: str = "cells") -> str:
    return f"transform({cells}, c -> named_struct('x', c.x * kx + x0, 'y', c.y * ky + y0))"


def rings_of(topology: Topology) -> DataFrame:
    """(part, unit, ring, points): the closed rings of all units, arcs reversed where they are used so, from their first junction on."""
    used = topology.uses.join(topology.arcs, ["part", "arc"])
    turned = used.select("part", "unit", "ring", F.struct("place", F.expr("slice(if(back, reverse(cells), cells), 1, size(cells) - 1)").alias("cells")).alias("v"))
    joined = turned.groupBy("part", "unit", "ring").agg(F.expr("flatten(transform(array_sort(collect_list(v)), x -> x.cells))").alias("cells"))
    closed = joined.join(topology.grid, "part").withColumn("cells", F.expr("array_append(cells, cells[0])"))
    return closed.select("part", "unit", "ring", F.expr(_placed()).alias("points"))


def documents(topology: Topology, name: str) -> DataFrame:
    """(part, body): each part as the JSON text of a topology whose one object, `name`, has the units as multipolygons.

    A document is one value, so a part is to be of a size that its readers load at once.
    """
    arcs = steps_of(topology.arcs).groupBy("part").agg(F.expr("transform(array_sort(collect_list(struct(arc, deltas))), x -> x.deltas)").alias("arcs"))
    ring = topology.uses.groupBy("part", "unit", "ring").agg(F.expr("transform(array_sort(collect_list(struct(place, if(back, -1 - arc, arc) as signed))), x -> x.signed)").alias("ring_arcs"))
    unit = ring.groupBy("part", "unit").agg(F.expr("transform(array_sort(collect_list(struct(ring, ring_arcs))), x -> array(x.ring_arcs))").alias("arcs"))
    units = unit.groupBy("part").agg(F.expr("array_sort(collect_list(named_struct('unit', unit, 'arcs', arcs)))").alias("units"))
    shapes = F.transform("units", lambda u: F.struct(F.lit("MultiPolygon").alias("type"), u["arcs"].alias("arcs"), F.struct(u["unit"].cast("string").alias("code")).alias("properties")))
    objects = F.struct(F.struct(F.lit("GeometryCollection").alias("type"), shapes.alias("geometries")).alias(name))
    transform = F.struct(F.array("kx", "ky").alias("scale"), F.array("x0", "y0").alias("translate"))
    body = F.to_json(F.struct(F.lit("Topology").alias("type"), transform.alias("transform"), objects.alias("objects"), "arcs"))
    return units.join(arcs, "part").join(topology.grid, "part").select("part", body.alias("body"))


def chained(pieces: DataFrame) -> DataFrame:
    """(grp, ring, closed, points): lines (grp, points) of a group joined end to end, reversed where needed.

    Where more than two ends meet, neighbours by direction are joined. Lines are followed as connected
    components over their joined ends, so that a task holds one ring and not a group. ring: a number.
    """
    rows = stage(pieces.where(F.size("points") > 1).select(F.monotonically_increasing_id().alias("piece"), "grp", "points"))
    closed = F.col("points")[0] == F.element_at("points", -1)
    loops = rows.where(closed).select("grp", F.col("piece").alias("ring"), F.lit(True).alias("closed"), "points")
    open_ = rows.where(~closed)
    side = lambda k, at, to: F.struct(F.lit(k).alias("side"), at.alias("at"), F.atan2(to["y"] - at["y"], to["x"] - at["x"]).alias("angle"))
    p = F.col("points")
    ends = open_.select("grp", "piece", F.explode(F.array(side(0, p[0], p[1]), side(1, F.element_at(p, -1), F.element_at(p, -2)))).alias("e")).select("grp", "piece", "e.*")
    turn = F.row_number().over(Window.partitionBy("grp", "at").orderBy("angle", "piece", "side")) - 1
    ends = stage(ends.withColumn("pair", F.floor(turn / 2)))
    other = ends.select("grp", "at", "pair", F.col("piece").alias("to"), F.col("side").alias("to_side"))
    met = ends.join(other, ["grp", "at", "pair"]).where("piece <> to or side <> to_side").select("piece", "side", "to", "to_side")
    parts = graph.components(met, "piece", "to")
    linked = met.groupBy("piece").agg(F.collect_list(F.struct("side", "to", "to_side")).alias("links"))
    told = open_.join(parts.select(F.col("node").alias("piece"), "component"), "piece", "left").join(linked, "piece", "left").select("grp", F.coalesce("component", "piece").alias("ring"), "piece", "points", "links")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        line = {r.piece: [(p["x"], p["y"]) for p in r.points] for r in pdf.itertuples()}
        to = {(r.piece, x["side"]): (x["to"], x["to_side"]) for r in pdf.itertuples() for x in (r.links if r.links is not None else ())}
        loose = sorted((piece, side) for piece in line for side in (0, 1) if (piece, side) not in to)
        piece, side = loose[0] if loose else (min(line), 0)
        begun, points = (piece, side), []
        while True:
            own = line[piece] if side == 0 else line[piece][::-1]
            points += own if not points else own[1:]
            if (piece, 1 - side) not in to:
                break
            piece, side = to[piece, 1 - side]
            if (piece, side) == begun:
                break
        first = pdf.iloc[0]
        return pd.DataFrame([(first["grp"], first["ring"], points[0] == points[-1], [{"x": x, "y": y} for x, y in points])], columns=["grp", "ring", "closed", "points"])

    joined = told.groupBy("grp", "ring").applyInPandas(walk, f"grp {rows.schema['grp'].dataType.simpleString()}, ring long, closed boolean, points {POINTS}")
    return loops.unionAll(joined)


def dissolved(topology: Topology, groups: DataFrame) -> DataFrame:
    """(grp, ring, closed, points): the outlines of groups of units (unit, grp) of one part, as rings.

    Arcs that an even number of a group's rings use are inside it and fall away.
    """
    outer = topology.uses.join(groups, "unit").groupBy("grp", "part", "arc").agg(F.count("*").alias("n")).where("n % 2 = 1")
    lines = outer.join(topology.arcs, ["part", "arc"]).join(topology.grid, "part").select("grp", F.expr(_placed()).alias("points"))
    return chained(lines)


def nested(rings: DataFrame, tile: float) -> DataFrame:
    """(grp, ring, points, depth, outer, area): how many other rings of its group a closed ring is in, and the ring it is a hole of.

    Rings must not cross. An odd depth is a hole's; outer is null for the others. area: by the shoelace formula, not signed.
    """
    shoelace = F.expr("abs(aggregate(sequence(0, size(points) - 2), 0D, (a, i) -> a + points[i].x * points[i + 1].y - points[i + 1].x * points[i].y)) / 2")
    rows = stage(rings.where("closed").select("grp", "ring", "points", shoelace.alias("area")))
    edges = rows.select(F.col("ring").alias("unit"), F.explode(F.expr("transform(sequence(0, size(points) - 2), i -> named_struct('x1', points[i].x, 'y1', points[i].y, 'x2', points[i + 1].x, 'y2', points[i + 1].y))")).alias("e")).select("unit", "e.*")
    middle = rows.select(F.col("ring").alias("point"), F.expr("(points[0].x + points[1].x) / 2").alias("x"), F.expr("(points[0].y + points[1].y) / 2").alias("y"))
    within = places.located(middle, edges, tile).where("point <> unit")
    about = rows.select(F.col("ring").alias("unit"), F.col("grp").alias("of"), F.col("area").alias("size"))
    held = within.join(about, "unit").join(rows.select(F.col("ring").alias("point"), "grp"), "point").where(F.col("grp").eqNullSafe(F.col("of")))
    depth = held.groupBy(F.col("point").alias("ring")).agg(F.count("*").alias("depth"), F.min_by("unit", F.struct("size", "unit")).alias("inner"))
    found = rows.join(depth, "ring", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return found.select("grp", "ring", "points", "depth", F.when(F.col("depth") % 2 == 1, F.col("inner")).alias("outer"), "area")


def features(rings: DataFrame) -> DataFrame:
    """(grp, area, body): each group's nested rings as a GeoJSON feature, outlines followed by their holes."""
    pair = F.expr("transform(points, p -> array(p.x, p.y))")
    polygon = rings.select("grp", F.coalesce("outer", "ring").alias("of"), F.struct(F.col("outer").isNotNull().alias("hole"), "ring", pair.alias("pairs")).alias("v"), F.when(F.col("outer").isNull(), F.col("area")).otherwise(-F.col("area")).alias("signed"))
    polygons = polygon.groupBy("grp", "of").agg(F.expr("transform(array_sort(collect_list(v)), x -> x.pairs)").alias("polygon"), F.sum("signed").alias("signed"))
    whole = polygons.groupBy("grp").agg(F.expr("transform(array_sort(collect_list(struct(of, polygon))), x -> x.polygon)").alias("coordinates"), F.sum("signed").alias("area"))
    body = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("grp").cast("string").alias("code")).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), "coordinates").alias("geometry"))
    return whole.select("grp", "area", F.to_json(body).alias("body"))
