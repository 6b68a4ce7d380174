"""A quality classifier: nearest-neighbour voting over latent-semantic vectors.

Texts become hashed term counts (words, shapes of three characters, immediate repeats and length),
weighted by inverse document frequency and projected to a latent-semantic space, which a truncated
singular value decomposition of a bounded sample of labelled documents spans. The sample's vectors
and labels are broadcast; every document's cosine with all of them is computed in blocks, and its
nearest neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersight.llm.flat import free_name, mixed, parts, utf8, words_of

WORDS, SHAPES, LENGTHS = 1024, 1024, 24
TERMS = WORDS + SHAPES + LENGTHS + 1
#: Lower and upper letters, digits, space, line feed, bytes over 127, each other ASCII character.
SHAPE = np.arange(256)
for _lo, _hi, _as in ((97, 123, 97), (65, 91, 65), (48, 58, 48), (128, 256, 128)):
    SHAPE[_lo:_hi] = _as


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Texts by terms: hashed words and shape trigrams, length class, words equal to the one before."""
    n = len(texts)
    found = words_of(texts)
    owner = np.repeat(np.arange(n), np.diff(found.first))
    out = np.zeros((n, TERMS), np.float32)
    slot = (found.hash >> np.uint64(40)).astype(np.int64) % WORDS
    out[:, :WORDS] = np.bincount(owner * WORDS + slot, minlength=n * WORDS).reshape(n, WORDS)
    size = np.fromiter(map(len, texts), np.int64, n)
    shape = SHAPE[found.data].astype(np.uint64)
    code = (shape[:-2] << np.uint64(16)) | (shape[1:-1] << np.uint64(8)) | shape[2:] if len(shape) > 2 else shape[:0]
    # three characters of a text, the line feed after it included, but nothing of the next one
    ends = np.cumsum(size + 1)
    of = np.repeat(np.arange(n), size + 1)[: len(code)]
    own = np.arange(len(code)) + 2 < ends[of]
    of, code = of[own], code[own]
    slot = (mixed(code) >> np.uint64(40)).astype(np.int64) % SHAPES
    out[:, WORDS : WORDS + SHAPES] = np.bincount(of * SHAPES + slot, minlength=n * SHAPES).reshape(n, SHAPES)
    out[np.arange(n), WORDS + SHAPES + np.minimum(np.log2(np.diff(found.first) + 1).astype(int), LENGTHS - 1)] = 1
    same = np.flatnonzero((found.hash[1:] == found.hash[:-1]) & (owner[1:] == owner[:-1]))
    out[:, -1] = np.bincount(owner[1:][same], minlength=n)
    return out


def _balanced(counts: np.ndarray) -> np.ndarray:
    """Damped counts in which words, shapes, length and repeats each have a set share."""
    out = np.sqrt(counts)
    for lo, hi, share in ((0, WORDS, 0.3), (WORDS, WORDS + SHAPES, 1.0)):
        norm = np.sqrt(np.square(out[:, lo:hi]).sum(1, keepdims=True))
        out[:, lo:hi] *= share / np.maximum(norm, 1e-9)
    total = np.maximum(counts[:, :WORDS].sum(1), 1)
    out[:, WORDS + SHAPES : -1] *= 0.1
    out[:, -1] = counts[:, -1] / total
    return out


class Model(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    quality: np.ndarray
    neighbours: int
    power: float


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.square(x).sum(1, keepdims=True)), 1e-12)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _balanced(counts) * idf


def fit(counts: np.ndarray, quality: np.ndarray, dims: int = 48, neighbours: int = 24, power: float = 6.0) -> Model:
    idf = np.log((len(counts) + 1) / ((counts > 0).sum(0) + 1)) + 1
    idf = np.minimum(idf, 4).astype(np.float32)
    x = _weighted(counts, idf).astype(np.float32)
    # subspace iteration towards the leading right singular vectors
    axes = np.random.default_rng(7).normal(size=(x.shape[1], dims + 8)).astype(np.float32)
    for _ in range(6):
        axes, _ = np.linalg.qr(x.T @ (x @ axes))
    _, _, turn = np.linalg.svd(x @ axes, full_matrices=False)
    axes = (axes @ turn.T)[:, :dims].astype(np.float32)
    return Model(idf, axes, _unit(x @ axes), quality.astype(np.float32), neighbours, power)


def placed(model: Model, counts: np.ndarray) -> np.ndarray:
    """Documents' unit vectors on the model's axes, in doubles."""
    return _unit(_weighted(counts, model.idf).astype(np.float64) @ model.axes.astype(np.float64))


def score(model: Model, counts: np.ndarray, block: int = 256) -> np.ndarray:
    """Share of label 1 among the nearest neighbours, weighted by cosine to a power.

    Cosines count to six decimals, and all neighbours vote whose cosine is that of the last one or
    more, so that a score doesn't depend on the order of ties or on what else is in a block.
    """
    out = np.empty(len(counts))
    k = min(model.neighbours, len(model.vectors))
    vectors = model.vectors.astype(np.float64)
    for at in range(0, len(counts), block):
        z = placed(model, counts[at : at + block])
        cosine = np.round(z @ vectors.T, 6)
        last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        weight = np.where(cosine >= last, np.maximum(cosine, 1e-3) ** model.power, 0.0)
        out[at : at + block] = np.round(weight @ model.quality.astype(np.float64) / weight.sum(1), 9)
    return out


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id as text is divisible by 5."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def sample_counts(docs: DataFrame, labels: DataFrame, fit_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Term counts and labels of at most `fit_rows` labelled documents that aren't held out."""
    spark = docs.sparkSession
    kept = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & kept)
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    chosen = {r.doc_id: int(r.quality > 0) for r in chosen.collect()}  # bounded by fit_rows
    if not chosen:
        return np.zeros((0, TERMS), np.float32), np.zeros(0)
    ids = spark.createDataFrame(list(chosen.items()), "id long, quality int")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids), "id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                counts = term_counts(utf8(part.column("text")))
                packed = pa.array([zlib.compress(c.tobytes(), 1) for c in counts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), packed, part.column("quality")], ["id", "counts", "quality"])

    found: dict[int, tuple[bytes, int]] = {}
    for r in rows.mapInArrow(each, "id long, counts binary, quality int").toLocalIterator():
        found[r.id] = min(found.get(r.id, (bytes(r.counts), r.quality)), (bytes(r.counts), r.quality))
    counts = np.empty((len(found), TERMS), np.float32)
    for i, key in enumerate(sorted(found)):
        counts[i] = np.frombuffer(zlib.decompress(found[key][0]), np.float32)
    return counts, np.array([found[key][1] for key in sorted(found)])


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = 4096, threshold: float = 0.3) -> DataFrame:
    """All columns of `docs`, and held_out, score and predicted.

    The model is fitted on at most `fit_rows` labelled documents outside the held-out fifth, the
    first by a hash of their ids; their vectors (fit_rows times 48 floats) are what is broadcast.
    Every document is scored on its whole text, and nothing but its text. Null texts count as empty;
    a null doc_id is scored too and isn't held out. Of several labels of a document the largest
    counts, of several texts of a labelled document one. Without any label every score is 0.5.
    Columns of `docs` named like a new one are replaced.
    """
    taken = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    out = _scored(docs.select(*taken), labels, fit_rows, "score")
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select(*taken, apart.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scored(docs: DataFrame, labels: DataFrame, fit_rows: int, name: str) -> DataFrame:
    """`docs` and the score in a column of a name that they don't have."""
    counts, quality = sample_counts(docs, labels, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(fit(counts, quality) if len(counts) else None)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in (part for whole in batches for part in parts(whole, "text")):
            scores = np.full(batch.num_rows, 0.5) if model is None else score(model, term_counts(utf8(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, name])

    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(each, f"{typed}, `{name}` double")


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = 4096, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that the classifier accepts."""
    score = free_name("_score", docs)
    return _scored(docs, labels, fit_rows, score).where(F.col(score) >= threshold).select(*docs.columns)
