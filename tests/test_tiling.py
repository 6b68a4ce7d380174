import math

import numpy as np

from tiersight.functions.geo import clip_box
from tiersight.operators import tiling, topology


def plain_tiles(shapes, origin, most, deepest, margin):
    leaves, split = {}, set()

    def visit(z, x, y, inside):
        size = 0.5**z
        west, south = origin[0] + x * size, origin[1] + y * size
        kept = {}
        for key, ring in inside.items():
            cut = clip_box(ring, west - margin, south - margin, west + size + margin, south + size + margin)
            if len(cut) >= 3:
                kept[key] = cut
        if not kept:
            return
        if sum(map(len, kept.values())) > most and z < deepest:
            split.add((z, x, y))
            for dx in (0, 1):
                for dy in (0, 1):
                    visit(z + 1, 2 * x + dx, 2 * y + dy, kept)
        else:
            leaves.update({(z, x, y, *key): ring for key, ring in kept.items()})

    xs, ys = ([p[k] - origin[k] for r in shapes.values() for p in r] for k in (0, 1))
    for x in range(math.floor(min(xs)), math.floor(max(xs)) + 1):
        for y in range(math.floor(min(ys)), math.floor(max(ys)) + 1):
            visit(0, x, y, shapes)
    return leaves, split


def test_tiles_are_split_as_by_recursion(spark):
    rng = np.random.default_rng(8)
    shapes = {}
    for unit in range(6):
        cx, cy, n = *rng.uniform(0.3, 2.6, 2), int(rng.integers(3, 120))
        at = np.sort(rng.uniform(0, 2 * math.pi, n))
        shapes[unit, 0] = [(float(cx + 0.7 * rng.uniform(0.5, 1) * math.cos(t)), float(cy + 0.7 * rng.uniform(0.5, 1) * math.sin(t))) for t in at]
    rows = [(u, r, [*p, p[0]] if u % 2 else p) for (u, r), p in shapes.items()] + [(50, 0, [(1.0, 1.0), (1.1, 1.1)])]
    table = spark.createDataFrame(rows, f"unit long, ring int, points {topology.POINTS}")
    leaves, split = tiling.adaptive_tiles(table, (0.0, 0.0), 15, 3, 0.01)
    want_leaves, want_split = plain_tiles(shapes, (0.0, 0.0), 15, 3, 0.01)
    assert {tuple(r) for r in split.collect()} == want_split and {z for z, _, _ in want_split} == {0, 1, 2}
    got = {(r.z, r.x, r.y, r.unit, r.ring): [(p.x, p.y) for p in r.points] for r in leaves.collect()}
    assert got.keys() == want_leaves.keys() and all(np.allclose(got[k], want_leaves[k]) for k in got)
    steps = {(r.z, r.x, r.y, r.unit, r.ring): list(r.flat) for r in tiling.tile_steps(leaves, (0.0, 0.0), 1e-3).collect()}
    for (z, x, y, *_), flat, ring in ((k, steps[k], want_leaves[k]) for k in want_leaves):
        cells = [(math.floor((px - x * 0.5**z) / 1e-3 + 0.5), math.floor((py - y * 0.5**z) / 1e-3 + 0.5)) for px, py in ring]
        assert flat == [v for k, c in enumerate(cells) if k == 0 or c != cells[k - 1] for v in c]


def test_no_rings(spark):
    empty = spark.createDataFrame([], f"unit long, ring int, points {topology.POINTS}")
    leaves, split = tiling.adaptive_tiles(empty, (0.0, 0.0))
    assert leaves.count() == split.count() == 0
