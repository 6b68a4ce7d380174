import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiersight.operators import places
from tiersight.operators.ranks import best_of


def ring_edges(unit, corners):
    return [(unit, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]


def star(rng, x, y, r, n):
    at = np.sort(rng.uniform(0, 2 * math.pi, n))
    return [(x + r * rng.uniform(0.3, 1) * math.cos(t), y + r * rng.uniform(0.3, 1) * math.sin(t)) for t in at]


def shapes(seed):
    """Stars, a square with a hole, a shape of two parts, a thin one over the whole map, all overlapping."""
    rng = np.random.default_rng(seed)
    edges = []
    for unit in range(8):
        edges += ring_edges(unit, star(rng, *rng.uniform(-20, 20, 2), rng.uniform(0.5, 15), int(rng.integers(3, 40))))
    edges += ring_edges(20, [(-10.0, -10.0), (10.0, -10.0), (10.0, 10.0), (-10.0, 10.0)]) + ring_edges(20, [(-4.0, -4.0), (-4.0, 5.0), (6.0, 5.0), (6.0, -4.0)])
    edges += ring_edges(21, [(-15.0, 0.0), (-12.0, 0.0), (-12.0, 3.0)]) + ring_edges(21, [(12.0, 0.0), (15.0, 0.0), (15.0, 3.0)])
    edges += ring_edges(22, [(-30.0, -0.01), (30.0, 0.3), (30.0, 0.31), (-30.0, 0.02)])
    points = [(k, *map(float, p)) for k, p in enumerate(rng.uniform(-25, 25, (400, 2)))]
    points += [(1000 + k, float(x), float(y)) for k, (x, y) in enumerate(np.stack(np.meshgrid(np.arange(-12, 13, 3) + 0.25, np.arange(-12, 13, 3) + 0.5), -1).reshape(-1, 2))]
    return [(u, *map(float, e)) for u, *e in edges], points


def inside(edges, points):
    out = set()
    for p, x, y in points:
        odd = {}
        for unit, x1, y1, x2, y2 in edges:
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                odd[unit] = not odd.get(unit, False)
        out |= {(p, u) for u, o in odd.items() if o}
    return out


@pytest.mark.parametrize(("seed", "tile"), [(0, 0.7), (1, 3.0), (2, 11.0), (3, 100.0)])
def test_located_as_by_rays_over_all_edges(spark, seed, tile):
    edges, points = shapes(seed)
    rings = spark.createDataFrame(edges, "unit long, x1 double, y1 double, x2 double, y2 double")
    at = spark.createDataFrame(points, "point long, x double, y double")
    got = [tuple(r) for r in places.located(at, rings, tile).collect()]
    assert len(got) == len(set(got)) and set(got) == inside(edges, points)
    boxed = {(p, u) for p, x, y in points for u in {e[0] for e in edges} for own in [[e for e in edges if e[0] == u]] if min(e[1] for e in own) <= x <= max(e[1] for e in own) and min(e[2] for e in own) <= y <= max(e[2] for e in own)}
    assert {tuple(r) for r in places.in_boxes(at, places.boxes(rings), tile).collect()} == boxed


def test_points_meet_edges_of_their_tile_only(spark):
    """Ten times as wide a map with as many points makes no more pairs of points and edges."""
    made = []
    for width in (10, 100):
        edges = [e for k in range(width) for e in ring_edges(k, [(k, 0.0), (k + 1.0, 0.0), (k + 1.0, 1.0), (k, 1.0)])]
        rings = spark.createDataFrame([(u, *map(float, e)) for u, *e in edges], "unit long, x1 double, y1 double, x2 double, y2 double")
        points = spark.createDataFrame([(k, k % width + 0.5, 0.5) for k in range(200)], "point long, x double, y double")
        passed, _ = places.tiled(rings, 1.0)
        at = points.selectExpr("point", f"floor(x - {places.SHIFT}) AS tx", f"floor(y - {places.SHIFT}) AS ty")
        made.append(at.join(passed, ["tx", "ty"]).count())
        assert {tuple(r) for r in places.located(points, rings, 1.0).collect()} == {(k, k % width) for k in range(200)}
    assert made[1] <= 1.1 * made[0]


def test_odd_coordinates_and_no_rows(spark):
    rings = spark.createDataFrame([(u, *map(float, e)) for u, *e in ring_edges(1, [(0, 0), (4, 0), (4, 4), (0, 4)])] + [(2, None, 0.0, 1.0, 1.0), (3, float("nan"), 0.0, float("inf"), 1.0)], "unit long, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, float("inf"), 1.0), (None, 2.0, 2.0), (5, 9.0, 9.0)], "point long, x double, y double")
    assert {tuple(r) for r in places.located(points, rings, 1.5).collect()} == {(1, 1), (None, 1)}
    assert places.located(points.where("false"), rings, 1.5).count() == 0 and places.located(points, rings.where("false"), 1.5).count() == 0
    assert [tuple(r) for r in places.placed(points.where("point in (1, 5)"), rings.where("unit = 1"), 1.5).orderBy("point").collect()] == [(1, 1, 1), (5, None, 0)]
    levels = [rings.where("false"), rings.where("unit = 1")]
    assert {(r.point, r.unit) for r in places.finest(points.where("point in (1, 5)"), levels, 1.5).collect()} == {(1, 1), (5, None)}


def test_nearest_of_crowded_places(spark, monkeypatch):
    """Units and points that share places, or are dense, give few pairs, and the nearest of all pairs."""
    rng = np.random.default_rng(5)
    dense = [(float(a), float(b)) for a, b in np.round(rng.uniform(0, 0.2, (300, 2)), 3)] + [(1.0 + float(a), float(b)) for a, b in np.round(rng.uniform(0, 4, (40, 2)), 1)]
    spot = [dense[i % len(dense)] for i in range(3000)]
    units = spark.createDataFrame([(i, *p) for i, p in enumerate(spot)] + [(-1, None, 0.0)], "code long, lat double, lng double")
    asked = [(float(a), float(b)) for a, b in np.round(rng.uniform(0, 0.2, (60, 2)), 3)] + [(float(a), float(b)) for a, b in np.round(rng.uniform(-2, 6, (200, 2)), 1)] + dense[:20]
    points = spark.createDataFrame([(k, *asked[k % len(asked)]) for k in range(900)] + [(-1, 0.0, None)], "point long, lat double, lng double")
    met, within = [], places.within

    def counted(*args):
        out = within(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(places, "within", counted)
    got = {r.point: (r.code, round(r.km, 9)) for r in places.nearest(points, units, 20.5).collect()}
    best = best_of(within(points, units, 20.5), ["point"], [F.asc("km"), F.asc("code")])
    want = {r.point: (r.code, round(r.km, 9)) for r in best.collect()}
    assert got == want and 300 < len(want) < 900
    assert sum(met) * 50 < within(points, units, 20.5).count()
