"""Embedding near-duplicates by E8 lattice hashing.

Unit vectors are projected at random to eight dimensions, once per table, and decoded to the nearest
point of the E8 lattice. A vector is kept in the cell of its own point and looks into the cells of
the neighbouring lattice points nearest to it. Vectors that meet in a cell of any table are compared
exactly; links' components and degrees follow from blocked cosine products.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersight.llm.flat import mixed
from tiersight.operators.graph import components
from tiersight.operators.staging import stage

#: Cells and components with more vectors than this are compared in blocks of BLOCK by BLOCK.
PAIRED, BLOCK = 48, 1024


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [np.eye(8)[i] * s + np.eye(8)[j] * t for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


MINIMAL = _minimal()


def _d8(y: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum."""
    near = np.rint(y)
    off = y - near
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 moved by a half in each direction."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    return np.where((np.square(y - a).sum(1) <= np.square(y - b).sum(1))[:, None], a, b)


def lattice_cells(unit: np.ndarray, table: int, probes: int, width: float) -> np.ndarray:
    """Hashed cells of one table: each row's own, then those of its nearest neighbour points."""
    rng = np.random.default_rng([table, unit.shape[1]])
    y = unit @ rng.normal(size=(unit.shape[1], 8)) / (8 * width) + rng.random(8)
    own = nearest_e8(y)
    near = np.argpartition(-((y - own) @ MINIMAL.T), probes, axis=1)[:, :probes]
    points = np.concatenate([own[:, None], own[:, None] + MINIMAL[near]], axis=1)
    twice = np.rint(2 * points).astype(np.int64).astype(np.uint64)
    out = np.full(points.shape[:2], table + 1, np.uint64)
    for i in range(8):
        out = mixed(out * np.uint64(31) + twice[..., i])
    return out.view(np.int64)


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.square(x).sum(1, keepdims=True))


def _fine(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _linked(near: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric adjacency matrix reaches."""
    top = np.arange(len(near))
    near = near | np.eye(len(near), dtype=bool)
    while True:
        new = np.where(near, top[None, :], len(near)).min(1)
        new = np.minimum(new, new[new])
        if (new == top).all():
            return top
        top = new


def _blocked(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of groups of n, once for each pair of blocks (i <= j) that they are part of."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("block", mine)
    other = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return other.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def _close_pairs(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Of candidate pairs (a, b), those whose cosine reaches the threshold."""
    left = classes.select(F.col("rep").alias("a"), F.col("v").alias("va"))
    right = classes.select(F.col("rep").alias("b"), F.col("v").alias("vb"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                for _, same in part.groupby(part["va"].map(len)):
                    cosine = (_units(same["va"]) * _units(same["vb"])).sum(1)
                    yield same.loc[cosine >= threshold, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInPandas(each, "a long, b long")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, tables: int = 10, probes: int = 8, width: float = 0.12) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vec_id of `vectors` (vec_id, label, embedding).

    Vectors are linked if their labels are equal and not null and their cosine, in doubles, reaches
    the threshold. Vectors that are null, empty or zero, or hold null or non-finite components, link
    with nothing, nor do vectors of different length. Of several rows of a vec_id the smallest
    (label, embedding) counts of those that can be linked; rows without a vec_id are left out. A pair at the threshold meets in
    a table with a chance of about 0.47, so of ten tables it is missed with one of about 0.002.
    Equal vectors are one class throughout, so copies cost nothing and are always found.
    """
    rows = vectors.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id"))
    sound = F.col("label").isNotNull() & F.coalesce(_fine(F.col("embedding")), F.lit(False))
    rows = stage(rows.agg(F.min(F.struct((~sound).alias("unsound"), "label", F.col("embedding").alias("v"))).alias("x")).select("vec_id", "x.*"))
    sound = ~F.col("unsound")
    classes = stage(
        rows.where(sound).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("v"))
    )

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                for _, same in part.groupby("dim"):
                    unit = _units(same["v"])
                    for t in range(tables):
                        cells = lattice_cells(unit, t, probes, width)
                        own = np.zeros(cells.shape, bool)
                        own[:, 0] = True
                        index = np.repeat(np.arange(len(same)), cells.shape[1])
                        yield pd.DataFrame({"rep": same["rep"].to_numpy()[index], "at": cells.ravel(), "own": own.ravel()})

    met = classes.select("rep", "dim", "v").mapInPandas(hashed, "rep long, at long, own boolean")
    met = met.join(classes.select("rep", "label", "dim"), "rep").select("rep", F.xxhash64("at", "label", "dim").alias("cell"), "own")
    met = stage(met)
    busy = met.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("own").alias("owners")).where("n > 1 and owners > 0")
    met = stage(met.join(busy.select("cell", "n"), "cell"))
    few = met.where(F.col("n") <= PAIRED)
    pairs = few.where("own").select("cell", F.col("rep").alias("x")).join(few.select("cell", F.col("rep").alias("y")), "cell")
    pairs = pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    edges = _close_pairs(pairs, classes, threshold)

    def tied(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same in pdf.groupby("dim"):
            unit, rep = _units(same["v"]), same["rep"].to_numpy()
            top = _linked(unit @ unit.T >= threshold)
            moved = top != np.arange(len(top))
            out.append(pd.DataFrame({"a": rep[moved], "b": rep[top[moved]]}))
        return pd.concat(out)

    many = _blocked(met.where(F.col("n") > PAIRED).select("cell", "rep", "n").distinct(), ["cell"])
    many = many.join(classes.select("rep", "dim", "v"), "rep").groupBy("cell", "i", "j").applyInPandas(tied, "a long, b long")
    found = components(edges.unionAll(many))

    # degrees, from all pairs of each component
    member = classes.join(found, F.col("rep") == F.col("node")).select("rep", "component", "copies", "v")
    sizes = member.groupBy("component").agg(F.count("*").alias("n"))
    member = stage(member.join(sizes, "component"))
    few = member.where(F.col("n") <= PAIRED).select("component", "rep")
    pairs = few.withColumnRenamed("rep", "a").join(few.withColumnRenamed("rep", "b"), "component").where("a < b").select("a", "b")
    close = _close_pairs(pairs, classes, threshold)
    ends = close.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionAll(close.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    ends = ends.join(classes.select(F.col("rep").alias("other"), "copies"), "other").select("rep", F.col("copies").alias("links"))

    def degrees(pdf: pd.DataFrame) -> pd.DataFrame:
        unit, copies, block = _units(pdf["v"]), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
        near = unit @ unit.T >= threshold
        np.fill_diagonal(near, False)
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            near &= block[:, None] != block[None, :]
        return pd.DataFrame({"rep": pdf["rep"], "links": near @ copies})

    many = _blocked(member.where(F.col("n") > PAIRED), ["component"]).groupBy("component", "i", "j").applyInPandas(degrees, "rep long, links long")
    links = ends.unionAll(many).groupBy("rep").agg(F.sum("links").alias("links"))
    found = classes.join(found, F.col("rep") == F.col("node"), "left").join(links, "rep", "left")
    found = found.select("label", "v", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # equal vectors have equal hashes; -0.0 and 0.0 count as equal in both
    joined = rows.drop("unsound").join(found, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), tops AS (
  SELECT a, min(b) AS top FROM reach GROUP BY a
), degrees AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(t.top, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(t.top, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN tops t ON t.a = e.vec_id LEFT JOIN degrees d ON d.a = e.vec_id
"""
