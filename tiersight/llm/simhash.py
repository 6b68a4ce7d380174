"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its sixteen 4-bit segments. Flipping one bit
moves one count by one, so the Manhattan distance of two such points is at most the Hamming distance
of the fingerprints. Points at Manhattan distance 2 have a grid point at distance 1 from both:
every fingerprint goes to its own grid cell and the neighbouring ones, and cells that several share
give the candidates, which are verified on the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersight.llm.flat import free_name, parts, utf8
from tiersight.operators.graph import components
from tiersight.operators.staging import stage

SEGMENTS, WIDTH = 16, 4
#: Cells with more fingerprints than this are linked through common midpoints instead of pairs.
PAIRED = 64
SEED = 42
#: Shingles whose bits are counted at once.
SLICE = 1 << 17
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, words: int = 3) -> Iterator[np.ndarray]:
    """Unsigned XXH64 of each shingle's UTF-8 bytes, in slices."""
    found = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    digest, lasts = xxhash.xxh64_intdigest, ends[min(words, len(found)) - 1 :]
    for at in range(0, n, SLICE):
        lo, hi = starts[at : min(n, at + SLICE)].tolist(), lasts[at : at + SLICE].tolist()
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(lo, hi)), np.uint64, len(lo))


def fingerprints(texts: list[bytes], words: int = 3) -> np.ndarray:
    """A bit is set if it is set in over half of the text's shingle hashes; no words give zero."""
    out = np.zeros(len(texts), np.uint64)
    hashes: list[np.ndarray] = []
    owners: list[int] = []
    sizes: list[int] = []
    held = 0
    ones: dict[int, np.ndarray] = {}
    totals = np.zeros(len(texts), np.int64)

    def count() -> None:
        nonlocal held
        docs, owner = np.unique(np.repeat(owners, sizes), return_inverse=True)
        octets = np.concatenate(hashes).view(np.uint8).reshape(-1, 8)
        n = np.empty((len(docs), 64), np.int64)
        for i in range(8):
            each = np.bincount(owner * 256 + octets[:, i], minlength=len(docs) * 256).reshape(-1, 256)
            n[:, 8 * i : 8 * i + 8] = each @ BITS
        for doc, row in zip(docs.tolist(), n):
            ones[doc] = ones[doc] + row if doc in ones else row
        hashes.clear(), owners.clear(), sizes.clear()
        held = 0

    for doc, text in enumerate(texts):
        for h in shingle_hashes(text, words):
            hashes.append(h), owners.append(doc), sizes.append(len(h))
            totals[doc] += len(h)
            held += len(h)
            if held >= SLICE or len(owners) >= 512:
                count()
    if owners:
        count()
    weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    for doc, row in ones.items():
        out[doc] = weights[row * 2 > totals[doc]].sum(dtype=np.uint64)
    return out


def with_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long; null texts have no words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                fp = fingerprints(utf8(part.column("text")), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def popcounts(fp: Column) -> Column:
    """The bit counts of the sixteen 4-bit segments, as the nibbles of a long."""

    def half(x: Column) -> Column:
        pairs = x.bitwiseAND(0x55555555) + F.shiftrightunsigned(x, 1).bitwiseAND(0x55555555)
        return pairs.bitwiseAND(0x33333333) + F.shiftrightunsigned(pairs, 2).bitwiseAND(0x33333333)

    low, high = fp.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(fp, 32)
    return half(low).bitwiseOR(F.shiftleft(half(high), 32))


def grid_cells(point: Column) -> Column:
    """The point's own cell and those at Manhattan distance 1 that a fingerprint can have."""
    cells = [point]
    for s in range(SEGMENTS):
        one = 1 << (WIDTH * s)
        bits = F.shiftrightunsigned(point, WIDTH * s).bitwiseAND(7)
        cells += [F.when(bits < WIDTH, point + F.lit(one)), F.when(bits > 0, point - F.lit(one))]
    return F.array_compact(F.array(*cells))


def near_links(classes: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all pairs at 2 or fewer differing bits.

    classes: fp (distinct), rep. Within cells of up to PAIRED fingerprints all pairs are verified.
    In fuller cells each fingerprint is linked to the smallest rep among those with which it shares
    a midpoint, a fingerprint at one bit or none from both: every such link is within two bits, and
    every pair within two bits shares a midpoint, so no group is expanded into pairs.
    Cells and midpoints are many times what their table's size tells Spark, so they are never broadcast.
    """
    cells = classes.where("rep is not null").select("fp", "rep", F.explode(grid_cells(popcounts(F.col("fp")))).alias("cell"))
    busy = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(cells.hint("merge").join(busy, "cell"))
    few = shared.where(F.col("n") <= PAIRED).hint("merge")
    pairs = few.select("cell", F.col("fp").alias("f"), F.col("rep").alias("a")).join(few.select("cell", F.col("fp").alias("g"), F.col("rep").alias("b")), "cell")
    close = pairs.where((F.col("f") < F.col("g")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= 2)).select("a", "b")
    crowded = shared.where(F.col("n") > PAIRED).select("fp", "rep").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - ((i == 63) << 64))) for i in range(64)])
    mids = stage(crowded.select("rep", F.explode(flips).alias("mid")))
    hubs = mids.groupBy("mid").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b < top").select("mid", "b")
    return close.unionAll(mids.hint("merge").join(hubs, "mid").where("rep <> b").select(F.col("rep").alias("a"), "b"))


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    component_id: the smallest doc_id reachable over links of 2 or fewer differing bits. Null and
    wordless texts have fingerprint zero and are linked like any other. Rows without a doc_id get a
    fingerprint, link nothing and have no component. Repeated rows of a doc_id are all returned.
    """
    rows = stage(with_fingerprints(docs, words))
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(near_links(classes))
    groups = classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(groups, "fp")
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component.

    Rows of one doc_id are one document, of which one row stays. Rows without a doc_id all stay.
    """
    own = free_name("_keep", docs)
    keep = near_duplicates(docs, words).where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    known = docs.join(keep, F.col("doc_id").cast("long") == F.col(own), "left_semi").dropDuplicates(["doc_id"])
    return known.unionAll(docs.where(F.col("doc_id").isNull()))
