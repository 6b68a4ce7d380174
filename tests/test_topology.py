import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tiersight import registry
from tiersight.operators import topology

SCHEMA = "part string, unit long, ring int, seq int, x double, y double"


def shoelace(points):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:]))) / 2


def jittered(seed, n=5):
    """A map of n by n units with wavy sides that neighbours share; one has a hole, in which lies another unit."""
    rng = np.random.default_rng(seed)
    corner = {(i, j): (i + rng.uniform(-0.2, 0.2), j + rng.uniform(-0.2, 0.2)) for i in range(n + 1) for j in range(n + 1)}
    side = {}

    def between(a, b):
        if (a, b) not in side:
            inner = [tuple(np.add(corner[a], np.subtract(corner[b], corner[a]) * t) + rng.uniform(-0.05, 0.05, 2)) for t in (0.3, 0.7)]
            side[a, b], side[b, a] = inner, inner[::-1]
        return [corner[a], *side[a, b]]

    rings = {}
    for i in range(n):
        for j in range(n):
            at = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            points = [p for a, b in zip(at, at[1:] + at[:1]) for p in between(a, b)]
            turn = int(rng.integers(len(points)))
            points = points[turn:] + points[:turn]
            rings[i * n + j, 0] = points[::-1] if rng.random() < 0.5 else points
    island = [(2.4, 2.4), (2.6, 2.45), (2.5, 2.6)]
    rings[2 * n + 2, 1] = island
    rings[99, 0] = island[1:] + island[:1]
    return {k: [(float(x), float(y)) for x, y in [*p, p[0]]] for k, p in rings.items()}


def table(spark, rings, part="p"):
    return spark.createDataFrame([(part, u, r, k, *p) for (u, r), points in rings.items() for k, p in enumerate(points)], SCHEMA)


@pytest.fixture(scope="module")
def maps(spark):
    rings = {(u, r): p for (u, r), p in jittered(1).items()}
    far = {(u + 1000, r): [(x + 50, y) for x, y in p] for (u, r), p in jittered(2, 3).items()}
    rows = table(spark, rings, "near").unionAll(table(spark, far, "far")).repartition(3)
    return rings | far, topology.built(rows, 1_000_001)


def test_round_trip(maps):
    rings, found = maps
    back = {(r.unit, r.ring): [(p.x, p.y) for p in r.points] for r in topology.rings_of(found._replace(arcs=topology.summed_steps(topology.steps_of(found.arcs)))).collect()}
    assert back.keys() == rings.keys()
    for key, points in back.items():
        want = rings[key]
        assert points[0] == points[-1] and len(points) == len(want)
        near = [min(range(len(want) - 1), key=lambda k: abs(want[k][0] - x) + abs(want[k][1] - y)) for x, y in points[:-1]]
        assert all(abs(want[k][0] - x) + abs(want[k][1] - y) < 1e-4 for k, (x, y) in zip(near, points))
        steps = {(b - a) % len(near) for a, b in zip(near, near[1:])}
        assert len(steps) == 1 and sorted(near) == list(range(len(near)))  # the ring, begun elsewhere or turned


def test_shared_sides_are_one_arc(maps):
    _, found = maps
    uses = found.uses.groupBy("part", "arc").agg(F.count("*").alias("n")).collect()
    n = 5
    assert sum(r.part == "near" for r in uses) == 2 * n * (n + 1) - 4 + 1  # every corner cuts but the map's four; one island
    assert {r.n for r in uses} == {1, 2} and sum(r.n == 2 for r in uses if r.part == "near") == 2 * n * (n - 1) + 1
    arcs = found.arcs.groupBy("part").agg(F.min("arc").alias("lo"), F.max("arc").alias("hi"), F.count("*").alias("n")).collect()
    assert all(r.lo == 0 and r.hi == r.n - 1 for r in arcs)


def test_documents_are_read_by_their_format(maps):
    rings, found = maps
    bodies = {r.part: json.loads(r.body) for r in topology.documents(found, "communes").collect()}
    assert bodies.keys() == {"near", "far"}
    for body in bodies.values():
        (kx, ky), (x0, y0) = body["transform"]["scale"], body["transform"]["translate"]
        arcs = []
        for steps in body["arcs"]:
            at = np.cumsum(np.array(steps), axis=0)
            arcs.append([(x * kx + x0, y * ky + y0) for x, y in at.tolist()])
        for shape in body["objects"]["communes"]["geometries"]:
            unit = int(shape["properties"]["code"])
            for r, (signed,) in enumerate(shape["arcs"]):
                points = []
                for k in signed:
                    piece = arcs[k] if k >= 0 else arcs[~k][::-1]
                    assert not points or points[-1] == piece[0]
                    points += piece[1:] if points else piece
                assert points[0] == points[-1] and shoelace(points) == pytest.approx(shoelace(rings[unit, r]), abs=1e-4)


def test_dissolved_units_have_the_sum_of_their_areas(spark, maps):
    rings, found = maps
    net = lambda unit: shoelace(rings[unit, 0]) - (shoelace(rings[unit, 1]) if (unit, 1) in rings else 0)
    # a ring of units around one left out; two units that touch in a corner; all units, with and without the island
    groups = {1: [6, 7, 8, 11, 13, 16, 17, 18], 2: [0, 6], 3: [*range(25), 99], 4: list(range(25)), 5: [1000, 1001, 99 + 1000]}
    rows = spark.createDataFrame([(u, g) for g, units in groups.items() for u in units], "unit long, grp long")
    outlines = topology.dissolved(found, rows)
    nested = topology.nested(outlines, 1.3)
    made = {r.grp: r for r in topology.features(nested).collect()}
    for g, units in groups.items():
        body = json.loads(made[g].body)
        assert made[g].area == pytest.approx(sum(map(net, units)), abs=1e-3)
        assert body["geometry"]["type"] == "MultiPolygon" and body["properties"]["code"] == str(g)
    count = {g: [len(p) for p in json.loads(made[g].body)["geometry"]["coordinates"]] for g in groups}
    assert count[1] == [2] and count[3] == [1] and count[4] == [2] and sorted(count[5]) == [1, 1]
    assert {r.depth for r in nested.collect()} == {0, 1}


def test_lines_of_any_direction_and_open_ones(spark):
    lines = [(1, [(0, 0), (1, 0)]), (1, [(1, 1), (1, 0)]), (1, [(1, 1), (0, 1), (0, 0)]), (1, [(5, 5), (6, 5), (6, 6), (5, 5)]), (2, [(0, 0), (1, 0)]), (2, [(2, 0), (1, 0)]), (2, [(9, 9)]), (3, [(0, 0), (1, 1)]), (3, [(1, 1), (0, 0)])]
    rows = spark.createDataFrame([(g, [(float(x), float(y)) for x, y in p]) for g, p in lines], f"grp long, points {topology.POINTS}")
    got = sorted((r.grp, r.closed, len(r.points)) for r in topology.chained(rows).collect())
    assert got == [(1, True, 4), (1, True, 5), (2, False, 3), (3, True, 3)]
    assert topology.chained(rows.where("false")).count() == 0


def test_rings_that_the_grid_flattens_are_refused(spark):
    rings = {(1, 0): [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 0.0)], (2, 0): [(5.0, 5.0), (5.1, 5.0), (5.1, 5.1), (5.0, 5.0)]}
    with pytest.raises(ValueError, match="2 ring 0"):
        topology.built(table(spark, rings), 50)
    assert topology.built(table(spark, rings), 100_000).arcs.count() == 2


def test_cells_are_as_small_in_a_wide_part(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    rings = {(u, 0): [(x, y + far) for x, y in square] for u, far in ((1, 0.0), (2, 7.0), (3, 60_000.0))}
    area = lambda found: sorted(round(shoelace([(p.x, p.y) for p in r.points]), 6) for r in topology.rings_of(found).collect())
    assert area(topology.built(table(spark, rings), 100_001, 0.001)) == [1.0, 1.0, 1.0]
    assert area(topology.built(table(spark, rings), 100_001)) != [1.0, 1.0, 1.0]


@pytest.mark.parametrize("name", ["topology_of_squares", "dissolved_rings"])
def test_squares_of_far_suppliers(spark, tmp_path, name):
    keys = [1, 2, 3, 13, 2999, 60_001, 60_002, 60_011]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    want = duck.execute(registry.oracle_sql()[name])
    at = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in at) for r in df.collect()) == sorted(want.fetchall())
