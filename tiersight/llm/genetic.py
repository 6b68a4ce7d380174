"""Best-fit packing by a distributed grouping genetic algorithm.

Pieces are dealt at random into shards. On each shard several islands breed packings: crossover
copies whole well-filled bins of one parent into the other, removes the copied pieces from its old
bins, empties those bins and puts their other pieces back by best fit. Each island's best packing
migrates to the next island between epochs. Populations start from best fit in blurred orders of
length, so that recombination and migration decide. A shard stops when a packing has as few bins as
the sum of lengths allows. Bins with room to spare are opened again and their pieces packed together
with those of other shards, level by level, until one shard holds what is left or a level saves
nothing any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersight.llm import tokens
from tiersight.operators.staging import stage


class Search(NamedTuple):
    """The search's settings."""

    shard_rows: int = 4096
    islands: int = 3
    population: int = 5
    epochs: int = 2
    generations: int = 6
    #: Bins with more than this share of room are packed again with other shards'.
    spare: float = 0.01
    #: Levels go on while they save more than this share of the bins that they open.
    worth: float = 0.001
    #: How much the orders of a population's first packings are blurred, least and most.
    blur: tuple[float, float] = (0.02, 0.3)


class Bins:
    """Open bins by free capacity, for best fit."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.at = capacity, 0, {}

    def add(self, bin_: int, left: int) -> None:
        if left > 0:
            self.at.setdefault(left, []).append(bin_)
            self.mask |= 1 << left

    def take(self, length: int) -> tuple[int, int] | None:
        """The tightest bin for the length, and its capacity."""
        fits = self.mask >> length
        if not fits:
            return None
        left = length + (fits & -fits).bit_length() - 1
        found = self.at[left]
        bin_ = found.pop()
        if not found:
            self.mask &= ~(1 << left)
        return bin_, left


def best_fit(lengths: np.ndarray, items: np.ndarray, bin_of: np.ndarray, fill: list[int], capacity: int) -> None:
    """Put items, in the order given, into the bins with the given fill or new ones."""
    bins = Bins(capacity)
    for b, f in enumerate(fill):
        bins.add(b, capacity - f)
    for i, length in zip(items.tolist(), lengths[items].tolist()):
        found = bins.take(length)
        if found is None:
            found = len(fill), capacity
            fill.append(0)
        b, left = found
        bin_of[i] = b
        fill[b] += length
        bins.add(b, left - length)


def compact(bin_of: np.ndarray) -> np.ndarray:
    return np.unique(bin_of, return_inverse=True)[1].astype(np.int32)


def fitness(lengths: np.ndarray, bin_of: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones."""
    fill = np.bincount(bin_of, weights=lengths) / capacity
    return -len(fill), float(np.square(fill).mean())


def seeded(lengths: np.ndarray, capacity: int, noise: float, rng: np.random.Generator) -> np.ndarray:
    """A packing by best fit in order of length, blurred by noise."""
    order = np.argsort(-lengths * (1 + noise * rng.random(len(lengths))), kind="stable")
    bin_of = np.zeros(len(lengths), np.int32)
    best_fit(lengths, order, bin_of, [], capacity)
    return bin_of


def crossover(lengths: np.ndarray, host: np.ndarray, donor: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The host with whole well-filled bins of the donor."""
    fill = np.bincount(donor, weights=lengths)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    taken = np.zeros(len(fill), bool)
    taken[rng.choice(good, max(1, int(len(good) * rng.uniform(0.1, 0.5))), replace=False)] = True
    injected = taken[donor]
    opened = np.zeros(int(host.max()) + 1, bool)
    opened[host[injected]] = True
    # the emptiest bins are opened too: where pieces move, room can be gathered
    host_fill = np.bincount(host, weights=lengths)
    opened[np.argsort(host_fill)[: max(1, len(host_fill) // 50)]] = True
    displaced = np.flatnonzero(opened[host] & ~injected)
    child = host.copy()
    child[injected] = len(opened) + donor[injected]
    kept = ~opened[host] | injected
    bins, inverse = np.unique(child[kept], return_inverse=True)
    child[kept] = inverse
    new_fill = np.bincount(inverse, weights=lengths[kept], minlength=len(bins)).astype(int).tolist()
    best_fit(lengths, displaced[np.argsort(-lengths[displaced], kind="stable")], child, new_fill, capacity)
    return compact(child)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, size: int, rng: np.random.Generator) -> tuple[list[np.ndarray], int]:
    """Best first, and the generations run; stops early at the fewest bins possible."""
    least = -(-int(lengths.sum()) // capacity)
    ranked = sorted(((fitness(lengths, p, capacity), n, p) for n, p in enumerate(population)), key=lambda x: x[:2], reverse=True)
    g = 0
    while g < generations and -ranked[0][0][0] > least:
        born = []
        for n in range(max(1, size // 2)):
            a, b = rng.integers(0, len(ranked), 2)
            if a == b:
                b = (b + 1) % len(ranked)
            child = crossover(lengths, ranked[min(a, b)][2], ranked[max(a, b)][2], capacity, rng)
            born.append((fitness(lengths, child, capacity), len(population) + g * size + n, child))
        ranked = sorted(ranked + born, key=lambda x: x[:2], reverse=True)[:size]
        g += 1
    return [p for _, _, p in ranked], g


def _level(rows: DataFrame, capacity: int, shards: int, level: int, search: Search) -> DataFrame:
    """(row, length, sequence_id, offset, room, generations): each shard's best packing, and how many generations led to it."""

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True])
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "rows": [pdf["row"].to_numpy(np.int64).tobytes()], "lengths": [pdf["length"].to_numpy(np.int64).tobytes()]})

    shard = F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)).cast("int")
    content = stage(rows.withColumn("shard", shard).groupBy("shard").applyInPandas(gathered, "shard int, rows binary, lengths binary"))
    state_type = "shard int, island int, population array<binary>, bins int, full double, done boolean, generations int"

    def bred(epoch: int):
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.itertuples():
                    lengths = np.frombuffer(r.lengths, np.int64)
                    rng = np.random.default_rng([level, r.shard, r.island, epoch])
                    if epoch == 0:
                        ran, blurs = 0, np.linspace(*search.blur, search.population * search.islands)
                        people = [seeded(lengths, capacity, b, rng) for b in blurs[r.island :: search.islands]]
                    else:
                        ran, people = r.generations, [np.frombuffer(p, np.int32) for p in r.population]
                        people += [np.frombuffer(r.migrant, np.int32)] if r.migrant is not None else []
                    people, more = evolve(lengths, people, capacity, search.generations, search.population, rng)
                    bins, full = fitness(lengths, people[0], capacity)
                    done = -bins <= -(-int(lengths.sum()) // capacity)
                    out.append((r.shard, r.island, [p.tobytes() for p in people[: 1 if done else None]], -bins, full, done, ran + more))
                yield pd.DataFrame(out, columns=["shard", "island", "population", "bins", "full", "done", "generations"])

        return each

    islands = content.select("*", F.explode(F.array(*[F.lit(i) for i in range(search.islands)])).alias("island"))
    best = None
    state = stage(islands.mapInPandas(bred(0), state_type))
    for epoch in range(1, search.epochs):
        solved = state.groupBy("shard").agg(F.bool_or("done").alias("solved"))
        open_ = state.join(solved, "shard").where("not solved").drop("solved")
        if open_.isEmpty():
            break
        elite = open_.select("shard", ((F.col("island") + 1) % search.islands).alias("island"), F.element_at("population", 1).alias("migrant"))
        next_ = open_.join(elite, ["shard", "island"]).join(content.drop("rows"), "shard").mapInPandas(bred(epoch), state_type)
        closed = state.join(solved, "shard").where("solved").drop("solved")
        state = stage(next_.unionAll(closed))
    best = state.groupBy("shard").agg(F.max_by(F.element_at("population", 1), F.struct(-F.col("bins"), "full", -F.col("island"))).alias("best"), F.max("generations").alias("generations"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                lengths, bin_of = np.frombuffer(r.lengths, np.int64), np.frombuffer(r.best, np.int32)
                order = np.argsort(bin_of, kind="stable")
                ends = np.cumsum(lengths[order])
                fill = np.bincount(bin_of, weights=lengths).astype(np.int64)
                base = np.concatenate(([0], np.cumsum(fill)[:-1]))
                of = bin_of[order].astype(np.int64)
                ids = (level << 56) + (r.shard << 24) + of
                yield pd.DataFrame({"row": np.frombuffer(r.rows, np.int64)[order], "length": lengths[order], "sequence_id": ids, "offset": ends - lengths[order] - base[of], "room": capacity - fill[of], "generations": r.generations})

    return stage(content.join(best, "shard").mapInPandas(placed, "row long, length long, sequence_id long, offset long, room long, generations int"))


def genetic_places(rows: DataFrame, capacity: int, search: Search = Search()) -> DataFrame:
    """(row, sequence_id, offset, generations) of rows (row, length), lengths from 1 to `capacity`."""
    out, level, opened = None, 0, None
    rows = rows.select("row", "length")
    n = rows.count()
    while True:
        shards = max(1, round(n / search.shard_rows))
        found = _level(rows, capacity, shards, level, search)
        loose = F.col("room") > search.spare * capacity
        first = F.col("offset") == 0
        bins, left, moved = found.agg(F.count_if(first), F.count_if(first & loose), F.count_if(loose)).first()
        # one shard has nobody to share with; a level that saves next to nothing is the last
        last = shards == 1 or not moved or (opened is not None and opened - bins <= search.worth * opened)
        done = (found if last else found.where(~loose)).select("row", "sequence_id", "offset", "generations")
        out = done if out is None else out.unionAll(done)
        if last:
            return out
        rows, n, opened, level = found.where(loose).select("row", "length"), moved, left, level + 1


def genetic_packing(docs: DataFrame, length: int = 2048, end_id: int = 0, path: str | None = None, search: Search = Search()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, generations), one row per piece.

    Documents are the ids of their whole text and `end_id`. Those over `length` are cut into pieces of
    it, of which the first can be shorter; pieces that fill a sequence are one. Null texts count as
    empty; rows with a null or repeated doc_id are documents of their own; columns other than doc_id
    and text are not looked at. generations: how many the search of the piece's shard ran; 0 if its
    first packings had as few sequences as can be. No rows give no rows.
    """
    cut = tokens.pieces(docs, length, end_id, path or tokens.default_path(), with_ids=False)
    short = cut.where(F.col("length") < length)
    placed = genetic_places(short, length, search)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "generations"]
    # whole pieces have numbers below zero, packed ones from zero on
    whole = cut.where(F.col("length") >= length).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long"), "generations": F.lit(0)})
    return short.join(placed, "row").select(*columns).unionAll(whole.select(*columns))
