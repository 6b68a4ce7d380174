"""Best-fit-decreasing packing of token sequences into id matrices.

Pieces of one length are alike, so the packing of all pieces follows from how many there are of each
length: a table of at most `length` rows. Best fit decreasing is run on that table, with a segment
tree over free capacities, moving whole ranges of equal bins at once. Each piece then finds its
place by its rank among the pieces of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiersight.llm import tokens
from tiersight.operators.staging import stage

#: Pieces of one length are counted in parts of about this many.
RANKED = 1000
#: Plans of up to this many rows (40 bytes each) are broadcast.
SHIPPED = 200_000


class CapacityTree:
    """Which capacities have open bins; finds the smallest of at least a given one."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.filled = [0] * (2 * self.size)

    def put(self, capacity: int, filled: bool) -> None:
        at = self.size + capacity
        self.filled[at] = int(filled)
        while at > 1:
            at >>= 1
            self.filled[at] = self.filled[2 * at] | self.filled[2 * at + 1]

    def first(self, least: int) -> int | None:
        at = self.size + least
        if self.filled[at]:
            return least
        while at > 1:
            if not at & 1 and self.filled[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.filled[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


class Move(NamedTuple):
    """Pieces of one length, ranks lo to hi, go `each` to a bin from bin `bin` on, from `offset` on."""

    length: int
    lo: int
    hi: int
    each: int
    bin: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Move], int]:
    """Best fit decreasing of counts[length] pieces of each length; the moves and the number of bins."""
    free: dict[int, list[tuple[int, int]]] = {}  # capacity left: ranges (bin, number)
    tree, moves, bins = CapacityTree(capacity), [], 0

    def add(left: int, start: int, n: int) -> None:
        if left:
            free.setdefault(left, []).append((start, n))
            tree.put(left, True)

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            left = tree.first(length)
            if left is None:
                left, start, there = capacity, bins, -(-(n - rank) // (capacity // length))
                bins += there
            else:
                start, there = free[left].pop()
                if not free[left]:
                    tree.put(left, False)
            # the tightest bin stays the tightest while it takes equal pieces
            each = left // length
            full = min(there, (n - rank) // each)
            if full:
                moves.append(Move(length, rank, rank + full * each, each, start, capacity - left))
                rank += full * each
                add(left - full // full * each * length, start, full)
            elif n > rank:
                each, full = n - rank, 1
                moves.append(Move(length, rank, n, each, start, capacity - left))
                rank = n
                add(left - each * length, start, 1)
            if there > full:
                add(left, start + full, there - full)
    return moves, bins


def places(short: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(row, sequence_id, offset) of all rows (row, length), lengths from 1 to `capacity`; the number of sequences."""
    spark = short.sparkSession
    counts = {r.length: r.n for r in short.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    moves, bins = plan(counts, capacity)
    parts = spark.createDataFrame([(length, n // RANKED + 1) for length, n in counts.items()] or [(0, 1)], "length long, parts long")
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    ranked = short.join(F.broadcast(parts), "length").select("row", "length", part.alias("part"))
    ranked = stage(ranked.withColumn("k", F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1))
    sizes = ranked.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = ranked.join(starts, ["length", "part"]).select("row", "length", (F.col("k") + F.col("start")).alias("rank"))
    table = spark.createDataFrame(pd.DataFrame(moves or [Move(0, 0, 0, 1, 0, 0)], columns=["at", "lo", "hi", "each", "bin", "first"]).astype("int64"))
    table = F.broadcast(table) if len(moves) <= SHIPPED else table
    found = ranked.join(table, (F.col("length") == F.col("at")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    step = F.col("rank") - F.col("lo")
    sequence_id = F.col("bin") + F.floor(step / F.col("each"))
    offset = F.col("first") + step % F.col("each") * F.col("length")
    return found.select("row", sequence_id.cast("long").alias("sequence_id"), offset.cast("long").alias("offset")), bins


def packed_matrices(docs: DataFrame, length: int = 2048, end_id: int = 50256, pad_id: int = 0, path: str | None = None) -> DataFrame:
    """One row per sequence: ids, position_ids, cu_seqlens, n_tokens and what it is made of.

    ids and position_ids are binary, a matrix row of `length` little-endian numbers each; ids have 16
    bits if the vocabulary allows and else 32, positions 32 bits if `length` is over 65,536 and else
    16. Positions start anew with each piece. cu_seqlens are the cumulated lengths of the pieces,
    from 0 to n_tokens; what is beyond n_tokens is padding. doc_ids, pieces and starts name the
    pieces in order. Documents are the ids of their whole text and `end_id`; longer ones are cut into
    pieces of `length`, of which the first can be shorter, and nothing is lost. Null texts count as
    empty, rows with a null or repeated doc_id are documents of their own, other columns are not
    looked at. No rows give no rows.
    """
    path = path or tokens.default_path()
    wide = "<u2" if tokens.encoder_fits(path, end_id) else "<u4"
    spaced = "<u2" if length <= 1 << 16 else "<u4"
    cut = tokens.pieces(docs, length, end_id, path, with_ids=True)
    short = cut.where(F.col("length") < length)
    placed, bins = places(short.select("row", "length"), length)

    def lay(sequence_id: int, content: list[dict]) -> tuple:
        ids = np.concatenate([np.frombuffer(p["ids"], wide) for p in content])
        sizes = [p["length"] for p in content]
        ends = np.cumsum(sizes)
        row, at = np.full(length, pad_id, wide), np.zeros(length, spaced)
        row[: len(ids)] = ids
        at[: len(ids)] = np.arange(len(ids)) - np.repeat(ends - sizes, sizes)
        return sequence_id, row.tobytes(), at.tobytes(), [0, *ends.tolist()], len(ids), *([p[k] for p in content] for k in ("doc_id", "piece", "start"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = ["sequence_id", "ids", "position_ids", "cu_seqlens", "n_tokens", "doc_ids", "pieces", "starts"]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
        rows, content = [], []
        for batch in batches:
            for part in tokens.parts(batch, "ids"):
                for p in part.to_pylist():
                    if content and content[0]["sequence_id"] != p["sequence_id"]:
                        rows.append(lay(content[0]["sequence_id"], content))
                        content = []
                        if len(rows) == 256:
                            yield made(rows)
                            rows = []
                    content.append(p)
        if content:
            rows.append(lay(content[0]["sequence_id"], content))
        yield made(rows)

    schema = "sequence_id long, ids binary, position_ids binary, cu_seqlens array<int>, n_tokens int, doc_ids array<long>, pieces array<int>, starts array<long>"
    part = ["doc_id", "piece", "start", "length", "ids"]
    dealt = short.join(placed, "row").select("sequence_id", "offset", *part).repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    # whole pieces are sequences already and are not dealt out again
    whole = cut.where(F.col("length") >= length).select((F.col("row") + bins).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *part)
    return dealt.mapInArrow(each, schema).unionAll(whole.mapInArrow(each, schema))


def write_packed(packed: DataFrame, path: str, sequences_per_file: int = 65_536) -> None:
    """Write packed sequences as Parquet files of bounded size."""
    packed.write.option("maxRecordsPerFile", sequences_per_file).parquet(path)
