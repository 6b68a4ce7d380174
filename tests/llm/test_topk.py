import numpy as np

from tiersight.llm import topk


def plain(rows, k=10, every=100):
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in ok:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_against_all_scores(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + 0.1 * rng.normal(size=16)]) for i in range(1500)]
    rows += [(2000 + i, rows[100][1]) for i in range(30)]
    rows += [(3000, None), (3100, [None, 1.0]), (3200, [float("inf")] * 16), (3300, [0.5, -0.25]), (3400, []), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = [tuple(r) for r in topk.top_k(df, shard_rows=200, block=4).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_large_components_and_few_rows(spark):
    rows = [(0, [3e5 + 0.001, -1.2e6]), (1, [1.25e6, 1e4]), (2, [-1.0, 1.3e6 + 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df).collect()} == plain(rows)
    assert topk.top_k(df.where("false")).count() == 0
