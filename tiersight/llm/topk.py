"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt into shards of bounded size, and a ball tree is built once for each. A tree is
searched best bound first. Queries visit the shards in waves: one shard, then some, then the rest.
After each wave the k-th score of all shards so far is what every further shard starts from, so most
nodes are cut off unseen.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiersight.operators.staging import stage

LEAF = 64
EXACT = 2.0**53


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x.astype(np.float64))


def ball_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple]]:
    """Row order and nodes (centre, radius, start, end, left, right); leaves have left -1."""
    order, nodes = np.arange(len(points)), []

    def grow(lo: int, hi: int) -> int:
        rows = points[order[lo:hi]]
        centre = rows.mean(0)
        away = rows - centre
        at = len(nodes)
        nodes.append(None)
        radius = float(np.sqrt((away * away).sum(1).max()))
        left = right = -1
        if hi - lo > leaf and radius > 0:
            far = rows[(away * away).sum(1).argmax()]
            other = rows[((rows - far) ** 2).sum(1).argmax()]
            mid = lo + (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argsort(rows @ (other - far), kind="stable")]
            left, right = grow(lo, mid), grow(mid, hi)
        nodes[at] = (centre, radius, lo, hi, left, right)
        return at

    if len(points):
        grow(0, len(points))
    return order, nodes


class Tree(NamedTuple):
    """A shard's rows in the order of its tree, and the tree's nodes."""

    ids: np.ndarray
    points: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    #: what rounding of bounds is measured by: the largest norm that a row can have
    reach: np.ndarray
    spans: np.ndarray  # start, end, left, right


def search(query: np.ndarray, own: int, k: int, floor: float, tree: Tree) -> list[tuple[int, int]]:
    """Up to k best (score, id) of the rows that score `floor` or more; ties to the smaller id."""
    if not len(tree.ids):
        return []
    near = query.astype(np.float64)
    norm = float(np.sqrt(near @ near))
    bounds = (tree.centres @ near + norm * tree.radii + 1e-9 * norm * tree.reach + 1e-3).tolist()
    best: list[tuple[int, int]] = []  # a heap of (score, -id)
    todo = [(-bounds[0], 0)]
    while todo:
        top, n = heapq.heappop(todo)
        least = max(floor, best[0][0]) if len(best) == k else floor
        if -top < least:
            break
        lo, hi, left, right = tree.spans[n].tolist()
        if left >= 0:
            for child in (left, right):
                heapq.heappush(todo, (-bounds[child], child))
            continue
        scores = tree.points[lo:hi] @ query
        for i in np.flatnonzero(scores >= least):
            if (i_id := int(tree.ids[lo + i])) != own:
                entry = (int(scores[i]), -i_id)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
    return [(s, -i) for s, i in best]


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether inner products of rows of a and b are exact in doubles."""
    return not len(a) or not len(b) or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT


def _wide(vectors: list[np.ndarray], dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def top_k(vectors: DataFrame, query_every: int = 100, k: int = 10, scale: float = 1024.0, shard_rows: int = 1024, block: int = 256, waves: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by integer inner product.

    vectors: vec_id, embedding. A component x counts as floor(scale * x), which must fit 2**62 in
    size, and scores must fit a long; products too large for doubles are taken in whole numbers.
    Queries are the rows whose vec_id is divisible by `query_every`. Vectors that are null or hold
    null or non-finite components, and rows without an id, take no part; a shorter vector counts as
    zero beyond its end. Rows of the query's own vec_id are no candidates; other repeated rows are
    candidates each for itself. Of several query rows of one vec_id the smallest vector asks.
    """
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(scale) * c))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    rows = stage(rows)
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    shards, dim = max(1, -(-n // shard_rows)), max(1, dim or 1)
    shard = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(shards)).cast("int")

    def planted(pdf: pd.DataFrame) -> pd.DataFrame:
        points, ids = _wide(list(pdf["v"]), dim), pdf["vec_id"].to_numpy(np.int64)
        order, nodes = ball_tree(points)
        centres, radii = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        spans = np.array([n[2:] for n in nodes], np.int64)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "ids": [ids[order].tobytes()], "points": [points[order].tobytes()], "centres": [centres.tobytes()], "radii": [radii.tobytes()], "spans": [spans.tobytes()]})

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "points": [_wide(list(pdf["v"]), dim).tobytes()]})

    # each shard is a row of its own, with at most a few times shard_rows vectors
    trees = stage(rows.withColumn("shard", shard).groupBy("shard").applyInPandas(planted, "shard int, ids binary, points binary, centres binary, radii binary, spans binary"))
    asked = rows.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-(-(-n // query_every)) // block))
    block_of = lambda x: F.pmod(F.xxhash64(x, F.lit(11)), F.lit(blocks)).cast("int")
    asked = stage(asked.withColumn("block", block_of("vec_id")).groupBy("block").applyInPandas(gathered, "block int, ids binary, points binary"))

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, at = None, None
        for pdf in batches:
            for row in pdf.itertuples():
                ids, points = np.frombuffer(row.ids, np.int64), np.frombuffer(row.points).reshape(-1, dim)
                if row.block < 0:  # the tree comes before its queries
                    centres, radii = np.frombuffer(row.centres).reshape(-1, dim), np.frombuffer(row.radii)
                    reach = np.sqrt(np.square(centres).sum(1)) + radii
                    tree, at = Tree(ids, points, centres, radii, reach, np.frombuffer(row.spans, np.int64).reshape(-1, 4)), row.shard
                    continue
                if at != row.shard:  # no vectors in this shard
                    continue
                floors = dict(zip(row.asked_ids, row.floors)) if row.asked_ids is not None else {}
                here = tree
                if not _exact(tree.points, points):
                    whole = lambda m: np.array([[int(c) for c in r] for r in m], dtype=object).reshape(-1, dim)
                    here, points = tree._replace(points=whole(tree.points)), whole(points)
                out = [(int(q), i, s) for q, v in zip(ids, points) for s, i in search(v, int(q), k, floors.get(int(q), -np.inf), here)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("asked_ids", "array<long>"), ("floors", "array<long>"))]
    no_tree = [F.lit(None).cast("binary").alias(c) for c in ("centres", "radii", "spans")]
    planted_rows = trees.select("shard", F.lit(-1).alias("block"), "ids", "points", "centres", "radii", "spans", *nothing)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # how far a shard is from the one that a block starts with decides the wave
    away = F.pmod(F.col("shard") - F.col("block"), F.lit(shards))
    edges = [0, 1, *(max(1, shards // 8 ** (waves - 1 - w)) for w in range(1, waves - 1)), shards]
    found = top = None
    for lo, hi in zip(edges, edges[1:]):
        if lo >= hi:
            continue
        held = asked.select("block", "ids", "points")
        if top is None:
            held = held.select("*", *nothing)
        else:
            floors = top.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
            floors = floors.withColumn("block", block_of("query_id")).groupBy("block").agg(F.collect_list(F.struct("query_id", "floor")).alias("f"))
            held = held.join(floors, "block", "left").select("block", "ids", "points", F.col("f.query_id").alias("asked_ids"), F.col("f.floor").alias("floors"))
        visits = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).where((away >= lo) & (away < hi))
        visits = visits.select("shard", "block", "ids", "points", *no_tree, "asked_ids", "floors")
        dealt = planted_rows.unionAll(visits).repartition("shard").sortWithinPartitions("shard", "block")
        wave = stage(dealt.mapInPandas(searched, "query_id long, vec_id long, score long"))
        found = wave if found is None else found.unionAll(wave)
        top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
