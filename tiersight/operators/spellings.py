"""Spelling names of one script in another: pairs of letter groups learned from names written in both."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiersight.operators.staging import stage

#: A graphone reads up to so many source letters and writes up to so many target letters.
READS, WRITES = 2, 3
EDGE = "\x02"


def _moves(n: int, m: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(min(READS, n) + 1) for b in range(min(WRITES, m) + 1) if a or b]


def _pieces(source: str, target: str) -> Iterator[tuple[int, int, int, int]]:
    """All steps of an alignment's lattice, from (i, j) to (i + a, j + b), in an order that reaches each place after its origins."""
    for i in range(len(source) + 1):
        for j in range(len(target) + 1):
            for a, b in _moves(len(source) - i, len(target) - j):
                yield i, j, i + a, j + b


def expectations(source: str, target: str, weight: dict[tuple[str, str], float], start: float) -> dict[tuple[str, str], float]:
    """How often each graphone is expected in the pair, over all alignments; nothing where there is none."""
    shape = (len(source) + 1, len(target) + 1)
    ahead, behind = np.zeros(shape), np.zeros(shape)
    ahead[0, 0] = behind[-1, -1] = 1.0
    steps = [(i, j, k, l, weight.get((source[i:k], target[j:l]), start)) for i, j, k, l in _pieces(source, target)]
    for i, j, k, l, p in steps:
        ahead[k, l] += ahead[i, j] * p
    for i, j, k, l, p in reversed(steps):
        behind[i, j] += behind[k, l] * p
    total, out = ahead[-1, -1], defaultdict(float)
    if total > 0:
        for i, j, k, l, p in steps:
            if (share := ahead[i, j] * p * behind[k, l] / total) > 0:
                out[source[i:k], target[j:l]] += share
    return out


def likeliest(source: str, target: str, weight: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """The pair's likeliest alignment."""
    best: dict[tuple[int, int], tuple[float, tuple[int, int] | None]] = {(0, 0): (0.0, None)}
    for i, j, k, l in _pieces(source, target):
        p = weight.get((source[i:k], target[j:l]))
        if p and (i, j) in best and (score := best[i, j][0] + np.log(p)) > best.get((k, l), (-np.inf, None))[0]:
            best[k, l] = score, (i, j)
    at, out = (len(source), len(target)), []
    while at in best and best[at][1] is not None:
        i, j = best[at][1]
        out.append((source[i : at[0]], target[j : at[1]]))
        at = i, j
    return out[::-1] if at == (0, 0) else []


GRAPHONES = T.ArrayType(T.StructType([T.StructField("reads", T.StringType()), T.StructField("writes", T.StringType())]))


def aligned(pairs: DataFrame, rounds: int = 8, longest: int = 60) -> DataFrame:
    """(source, target, graphones): each pair's likeliest alignment after rounds of expectation-maximisation.

    A round's expectations are summed over all pairs; weights are collected, as there are no more than
    pairs of groups of the two alphabets' letters. Names over `longest` letters are left out.
    """
    spark = pairs.sparkSession
    pairs = stage(pairs.select("source", "target").where((F.length("source") <= longest) & (F.length("target") <= longest)))
    weights: dict[tuple[str, str], float] = {}
    for _ in range(rounds):
        shared, start = spark.sparkContext.broadcast(weights), 0.0 if weights else 1e-3

        def expected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[tuple[str, str], float] = defaultdict(float)
            for pdf in batches:
                for s, t in zip(pdf["source"], pdf["target"]):
                    for key, n in expectations(s, t, shared.value, start).items():
                        total[key] += n
            yield pd.DataFrame([(*k, n) for k, n in sorted(total.items())], columns=["reads", "writes", "n"])

        sums = pairs.mapInPandas(expected, "reads string, writes string, n double").groupBy("reads", "writes").agg(F.sum("n").alias("n"))
        found = {(r.reads, r.writes): r.n for r in sums.collect()}
        whole = sum(found.values())
        weights = {k: n / whole for k, n in found.items()}
    final = spark.sparkContext.broadcast(weights)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(graphones=[[{"reads": a, "writes": b} for a, b in likeliest(s, t, final.value)] for s, t in zip(pdf["source"], pdf["target"])])

    return pairs.mapInPandas(read, T.StructType([*pairs.schema.fields, T.StructField("graphones", GRAPHONES)])).where(F.size("graphones") > 0)


def ngram_counts(alignments: DataFrame, order: int = 4) -> DataFrame:
    """(history, reads, writes, n): how often a graphone follows each history of up to order - 1 others."""
    edge = F.struct(F.lit(EDGE).alias("reads"), F.lit(EDGE).alias("writes"))
    padded = F.concat(F.array_repeat(edge, order - 1), "graphones", F.array(edge))
    rows = alignments.select(padded.alias("g"), F.explode(F.sequence(F.lit(order), F.size("graphones") + order)).alias("at"))
    rows = rows.select("g", "at", F.explode(F.sequence(F.lit(0), F.lit(order - 1))).alias("k"))
    history = F.transform(F.slice("g", F.col("at") - F.col("k"), F.col("k")), lambda x: F.concat_ws("\x1f", x["reads"], x["writes"]))
    this = F.element_at("g", F.col("at"))
    return rows.select(F.concat_ws("\x1e", history).alias("history"), this["reads"].alias("reads"), this["writes"].alias("writes")).groupBy("history", "reads", "writes").agg(F.count("*").alias("n"))


class Speller:
    """Witten-Bell smoothed graphone n-grams, and a beam search over them."""

    def __init__(self, counts: list[tuple[str, str, str, int]], order: int):
        self.order, self.n, self.totals, self.after = order, {}, defaultdict(int), defaultdict(int)
        self.reading: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for history, reads, writes, n in sorted(counts):
            self.n[history, reads, writes] = n
            self.totals[history] += n
            self.after[history] += 1
            if not history and reads != EDGE:
                self.reading[reads].append((reads, writes))
        self.size = sum(map(len, self.reading.values())) + 1

    def chance(self, past: tuple[str, ...], graphone: tuple[str, str]) -> float:
        p = (self.n.get(("", *graphone), 0) + 1) / (self.totals[""] + self.size)
        for k in range(1, len(past) + 1):
            history = "\x1e".join(past[len(past) - k :])
            if total := self.totals.get(history, 0):
                p = (self.n.get((history, *graphone), 0) + self.after[history] * p) / (total + self.after[history])
        return p

    def spell(self, word: str, top: int = 3, beam: int = 48) -> list[tuple[str, float]]:
        """The likeliest spellings and their log probabilities; two graphones that read nothing don't follow each other."""
        edge = "\x1f".join((EDGE, EDGE))
        states = {(0, (edge,) * (self.order - 1), "", False): 0.0}
        done: dict[str, float] = {}
        for _ in range(3 * len(word) + 3):
            grown: dict[tuple, float] = {}
            for (at, past, text, idle), score in states.items():
                if at == len(word):
                    done[text] = max(done.get(text, -np.inf), score + float(np.log(self.chance(past, (EDGE, EDGE)))))
                for a in range(1 if idle else 0, min(READS, len(word) - at) + 1):
                    for g in self.reading.get(word[at : at + a], ()):
                        key = (at + a, (*past, "\x1f".join(g))[-(self.order - 1) :], text + g[1], a == 0)
                        grown[key] = max(grown.get(key, -np.inf), score + float(np.log(self.chance(past, g))))
            states = dict(sorted(grown.items(), key=lambda x: (-x[1], x[0]))[:beam])
            if not states:
                break
        return sorted(done.items(), key=lambda x: (-x[1], x[0]))[:top]


def spelled(words: DataFrame, counts: DataFrame, order: int = 4, top: int = 3, largest: int = 2_000_000) -> DataFrame:
    """(word, spelling, logp, place): the likeliest spellings of each word by the counts, which must be `largest` at most."""
    rows = counts.limit(largest + 1).collect()
    if len(rows) > largest:
        raise ValueError("the counts are too many to send to every task")
    shared = words.sparkSession.sparkContext.broadcast(Speller([(r.history, r.reads, r.writes, r.n) for r in rows], order))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(w, s, p, k + 1) for w in pdf["word"] for k, (s, p) in enumerate(shared.value.spell(w, top))]
            yield pd.DataFrame(out, columns=["word", "spelling", "logp", "place"])

    return words.select("word").where("word is not null").mapInPandas(each, "word string, spelling string, logp double, place int")
