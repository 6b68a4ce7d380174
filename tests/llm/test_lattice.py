import itertools
import math

import numpy as np

from tiersight.llm import lattice


def plain(rows, threshold=0.93):
    ok = {i: np.array(v) for i, label, v in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    labels = {i: label for i, label, _ in rows}
    links = {i: set() for i, _, _ in rows}
    for a, b in itertools.combinations(ok, 2):
        if labels[a] == labels[b] and len(ok[a]) == len(ok[b]):
            if ok[a] @ ok[b] / math.sqrt(ok[a] @ ok[a]) / math.sqrt(ok[b] @ ok[b]) >= threshold:
                links[a].add(b), links[b].add(a)
    top = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in top:
                top[j] = i
                todo += links[j]
    return {(i, len(links[i]), top[i], top[i] == i) for i in links}


def test_links_degrees_and_components(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for size, spread in ((300, 0.02), (60, 0.03), (5, 0.03), (2, 0.04), *[(1, 0)] * 300):
        centre = rng.normal(size=64)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            rows.append((n, n % 3 if size == 60 else 1, [float(x) for x in centre + spread * rng.normal(size=64)]))
            n += 1
    rows += [(n + i, 1, rows[0][2]) for i in range(5)]
    n += 5
    rows += [(n, None, rows[0][2]), (n + 1, 1, None), (n + 2, 1, [0.0] * 64), (n + 3, 1, [float("nan")] * 64), (n + 4, 1, [None, 1.0]), (n + 5, 1, []), (n + 6, 1, [1.0, 2.0]), (n + 7, 1, [2.0, 4.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, n_links string")
    got = {tuple(r) for r in lattice.near_vectors(df).collect()}
    want = plain(rows)
    assert len(got) == len(want)
    # pairs at the threshold itself may be missed in no table with a chance of 0.002
    assert sum(len(x) == 4 and x in want for x in got) >= 0.99 * len(want)
    assert lattice.near_vectors(df.where("false")).count() == 0


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 1, [2.0, 0.0]), (None, 1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert {tuple(r) for r in lattice.near_vectors(df).collect()} == {(1, 1, 1, True), (2, 1, 1, False)}


def test_nearest_lattice_point_is_nearest(spark):
    y = np.random.default_rng(2).normal(size=(200, 8)) * 2
    got = lattice.nearest_e8(y)
    base = np.square(y - got).sum(1)
    for m in lattice.MINIMAL:
        assert (np.square(y - got - m).sum(1) >= base - 1e-9).all()


def test_of_repeated_ids_the_row_that_can_be_linked_counts(spark):
    v, w = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.5]
    rows = spark.createDataFrame([(1, 5, v), (1, None, w), (2, 5, v), (3, 5, None), (3, 5, v), (4, None, v)], "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(rows).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True)}
