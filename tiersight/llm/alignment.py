"""Alignment of two tokenizers over a corpus: groups between common cuts, links, and counts of id pairs.

Both tokenizations tile the same bytes, so a whole part of the corpus is aligned at once in flat
arrays: token ends by running sums, common cuts by intersection, links by repeating each token as often
as the other side overlaps it. Counts of id pairs are summed per chunk of documents, then over salts,
then over all; each chunk gets back the counts of its own pairs only, once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiersight.llm import tokens
from tiersight.llm.flat import parts
from tiersight.operators.staging import stage

#: Bytes of text that are aligned at once, and of a chunk whose pairs are looked up together.
AT_ONCE, CHUNK = 1 << 20, 16 << 20
#: Partial sums of an id pair's count.
SALTS = 16

_SPACE = "▁"


class Coder(NamedTuple):
    """Ids of texts that begin with a space, and the bytes of each id."""

    encode: Callable[[list[str]], list[np.ndarray]]
    bytes_of: list[bytes]
    width: np.ndarray


def _coder(encode: Callable[[list[str]], list[np.ndarray]], bytes_of: list[bytes]) -> Coder:
    return Coder(encode, bytes_of, np.fromiter(map(len, bytes_of), np.int64, len(bytes_of)))


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def byte_level(path: str) -> Coder:
    """A byte-level BPE file of the tokenizers library; the strings of its special tokens are plain text."""
    encode = tokens.encoder(path, specials=False)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of = tokens._byte_of()
    entries = {v: bytes(byte_of[c] for c in k) for k, v in spec["model"]["vocab"].items() if all(c in byte_of for c in k)}
    # special tokens never come out of plain text
    size = 1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec.get("added_tokens", []))])
    return _coder(lambda texts: [np.asarray(encode(f" {t}"), np.int64) for t in texts], [entries.get(i, b"\xff") for i in range(size)])


@lru_cache(maxsize=2)
def pieces(path: str) -> Coder:
    """A sentencepiece model, which puts the space before a text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def bytes_of(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(_SPACE, " ").encode()

    return _coder(lambda texts: [np.array(x, np.int64) for x in model.encode(texts, num_threads=1)], [bytes_of(i) for i in range(model.get_piece_size())])


def coder(path: str) -> Coder:
    """The tokenizer of a file, by its ending."""
    return pieces(path) if path.endswith(".model") else byte_level(path)


class Aligned(NamedTuple):
    """Per text how many tokens, groups and links it has; its groups written out; its links' pairs in order of text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    pairs: np.ndarray


def _written(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All groups as text, `a1,a2|b1;a3|b2;`, and how many characters each token and its separator take, A and B in turn of groups."""
    order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
    ids, part = np.concatenate((a, b))[order], np.concatenate((2 * group_a, 2 * group_b + 1))[order]
    digits = 1
    while ids.max() >= 10**digits:
        digits += 1
    cells = np.empty((len(ids), digits + 1), np.uint8)
    for k in range(digits):
        cells[:, k] = 48 + ids // 10 ** (digits - 1 - k) % 10
    last = np.append(part[1:] != part[:-1], True)
    cells[:, digits] = np.where(last, np.where(part & 1, ord(";"), ord("|")), ord(","))
    lead = np.sum([ids < 10**k for k in range(1, digits)], axis=0) if digits > 1 else np.zeros(len(ids), np.int64)
    return cells[np.arange(digits + 1) >= np.asarray(lead)[:, None]], digits + 1 - np.asarray(lead)


def aligned(texts: list[str], coder_a: Coder, coder_b: Coder) -> Aligned:
    """Align texts of any number at once; those that a tokenizer doesn't give back whole, and empty ones, have no tokens."""
    n = len(texts)
    ids = [coder_a.encode(texts), coder_b.encode(texts)]
    for i, text in enumerate(texts):
        want = f" {text}".encode()
        if not text or any(b"".join(map(c.bytes_of.__getitem__, x[i].tolist())) != want for c, x in zip((coder_a, coder_b), ids)):
            ids[0][i] = ids[1][i] = np.zeros(0, np.int64)
    counts = [np.fromiter(map(len, x), np.int64, n) for x in ids]
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in ids)
    if not len(a):
        zeros = np.zeros(n, np.int64)
        return Aligned(zeros, zeros, zeros, zeros, [b""] * n, np.zeros(0, np.int64))
    width_a, width_b = coder_a.width[a], coder_b.width[b]
    end_a, end_b = np.cumsum(width_a), np.cumsum(width_b)
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    # each A token meets the B tokens from the one over its first byte to the one over its last
    first = np.searchsorted(end_b, end_a - width_a, "right")
    times = np.searchsorted(end_b, end_a - 1, "right") - first + 1
    after = np.cumsum(times)
    at = np.arange(after[-1]) - np.repeat(after - times, times) + np.repeat(first, times)
    pairs = np.repeat(a, times) * len(coder_b.bytes_of) + b[at]
    tokens_end = np.cumsum(counts[0])
    per_text = lambda x: np.diff(np.concatenate(([0], x))[np.concatenate(([0], tokens_end))])  # noqa: E731  of a running sum over A tokens
    n_groups, n_links = per_text(group_a + 1), per_text(after)
    chars, widths = _written(a, b, group_a, group_b)
    edges = np.concatenate(([0], np.cumsum(widths)))[np.concatenate(([0], np.cumsum(counts[0] + counts[1])))]
    data = chars.tobytes()
    groups = [data[lo : hi - 1] if hi > lo else b"" for lo, hi in zip(edges.tolist(), edges[1:].tolist())]
    return Aligned(counts[0], counts[1], n_groups, n_links, groups, pairs)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 by planes of their bytes, which compress well where most are small."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


class Alignment(NamedTuple):
    """documents: a row each, see `align`; pairs: (a, b, count, best) of the whole corpus."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, written: bool = False) -> Alignment:
    """Align two tokenizers on the texts of `docs` (doc_id, text).

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and, if
    `written`, groups, the text that is hashed: `a1,a2|b1;a3|b2,b3`, ids of A and B in order, groups cut
    wherever tokens of both end. A link is an A and a B token whose bytes overlap; an id pair's count is
    how many links of the corpus hold it; count_sum adds it up over a document's links; n_best counts
    the links whose pair has the highest count of its B id (all of those at a tie).
    Null and empty texts, and those that a tokenizer doesn't give back byte for byte, have zeros and
    empty strings. Every row is a document of its own, also under null or repeated doc_ids; other
    columns are not looked at. No rows give no rows.

    Texts are tokenized once. A chunk of about 16 MB of texts is stored as its distinct pairs and, per
    document, places among them; so rows of pairs grow with the chunks' distinct pairs and not with
    documents, and a frequent pair has one row a chunk.
    """
    path_a, path_b = path_a or default_paths()[0], path_b or default_paths()[1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_a, code_b = coder(path_a), coder(path_b)
        chunk, held, rows = TaskContext.get().partitionId() << 32, 0, []

        def full() -> Iterator[pa.RecordBatch]:
            own = [r[-1] for r in rows]
            pairs, place, times = np.unique(np.concatenate([x[0] for x in own] or [np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
            sums = np.bincount(place, weights=np.concatenate([x[1] for x in own] or [[]]), minlength=len(pairs)).astype(np.int64)
            edges = np.cumsum([0, *(len(x[0]) for x in own)])
            blank = [None] * 7
            for lo in range(0, len(rows), 1024):
                part = rows[lo : lo + 1024]
                at = [packed(np.diff(place[edges[i] : edges[i + 1]], prepend=0)) for i in range(lo, lo + len(part))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[chunk] * len(part), *zip(*(r[:-1] for r in part)), at, [packed(r[-1][1]) for r in part], [None] * len(part), [None] * len(part)], TYPES)], NAMES)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([chunk, *blank, None, None, pairs.tolist(), sums.tolist()], TYPES)], NAMES)

        for batch in (part for whole in batches for part in parts(whole, "text", AT_ONCE)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = aligned(texts, code_a, code_b)
            edges = np.cumsum([0, *found.n_links])
            numbers = zip(batch.column("doc_id").to_pylist(), *(x.tolist() for x in found[:4]))
            for i, row in enumerate(numbers):
                pairs = np.unique(found.pairs[edges[i] : edges[i + 1]], return_counts=True)
                text = found.groups[i]
                rows.append((*row, hashlib.sha256(text).hexdigest() if text else "", text.decode() if written else None, pairs))
            held += sum(map(len, texts))
            if held >= CHUNK:
                yield from full()
                chunk, held, rows = chunk + 1, 0, []
        if rows:
            yield from full()

    NAMES = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "at", "times", "pairs", "sums"]
    TYPES = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.binary()] * 2 + [pa.list_(pa.int64())] * 2
    schema = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, at binary, times binary, pairs array<long>, sums array<long>"
    coded = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, schema))

    own = coded.where("pairs is not null").select("chunk", F.explode(F.arrays_zip("pairs", "sums")).alias("x")).select("chunk", F.col("x.pairs").alias("pair"), F.col("x.sums").alias("n"))
    partial = own.groupBy("pair", F.pmod("chunk", F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    size_b = F.lit(len(coder(path_b).bytes_of))
    counted = partial.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % size_b)
    # a B id's pairs are bounded by A's vocabulary
    most = F.max("count").over(Window.partitionBy("b"))
    pairs = stage(counted.select("pair", "count", (F.col("count") == most).alias("best")))

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        # both orders are by pair, as the chunk's places are
        right = right.take(pc.sort_indices(right.column("pair")))
        count, best = (right.column(c).to_numpy().astype(np.int64) for c in ("count", "best"))
        n_best, count_sum = [], []
        for at, times in zip(left.column("at").to_pylist(), left.column("times").to_pylist()):
            place, times = np.cumsum(unpacked(at)), unpacked(times)
            n_best.append(int(best[place] @ times))
            count_sum.append(int(count[place] @ times))
        out = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        return out.append_column("groups_sha256", left.column("groups_sha256")).append_column("groups", left.column("groups"))

    rows = coded.where("pairs is null").drop("pairs", "sums")
    known = own.join(pairs, "pair").select(F.col("chunk").alias("of"), "pair", "count", "best")
    documents = rows.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(join, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string")
    out = pairs.select(F.floor(F.col("pair") / size_b).alias("a"), (F.col("pair") % size_b).alias("b"), "count", "best")
    return Alignment(documents if written else documents.drop("groups"), out)
