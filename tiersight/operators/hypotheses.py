"""Tests of links and agreement: ranks, permutations, discoveries, intervals."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersight.functions.numbers import kappa, normal_cdf
from tiersight.operators.ranks import average_rank, summed_before


def stream(seed: int) -> Callable[[], float]:
    """mulberry32, the published small generator: equal seeds give equal numbers in [0, 1)."""
    state = seed & 0xFFFFFFFF

    def multiply(a: int, b: int) -> int:
        return (a * b) & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        x = multiply(state ^ (state >> 15), state | 1)
        x ^= (x + multiply(x ^ (x >> 7), x | 61)) & 0xFFFFFFFF
        return ((x ^ (x >> 14)) & 0xFFFFFFFF) / 2**32

    return draw


def shuffled(values: np.ndarray, draw: Callable[[], float]) -> np.ndarray:
    """Fisher and Yates, from the end."""
    out = values.copy()
    for i in range(len(out) - 1, 0, -1):
        j = int(draw() * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Per group n and rho, Pearson's correlation of average-tie ranks; null where one side is constant.

    Ranks are halves, so twice the ranks are whole numbers and their sums exact.
    """
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    twice = both.select(*by, (average_rank(x, *by) * 2).cast("decimal(20,0)").alias("a"), (average_rank(y, *by) * 2).cast("decimal(20,0)").alias("b"))
    sums = twice.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.sum(e).cast("double").alias(k) for k, e in (("a", F.col("a")), ("b", F.col("b")), ("aa", F.col("a") * F.col("a")), ("bb", F.col("b") * F.col("b")), ("ab", F.col("a") * F.col("b")))]
    )
    n = F.col("n").cast("double")
    sxy, sxx, syy = n * F.col("ab") - F.col("a") * F.col("b"), n * F.col("aa") - F.col("a") * F.col("a"), n * F.col("bb") - F.col("b") * F.col("b")
    return sums.select(*by, "n", F.when((sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy)).alias("rho"))


def permutation_p(rows: DataFrame, by: str, x: str, y: str, rounds: int = 999, seed: Column | None = None, tasks: int = 16, largest: int = 1_000_000) -> DataFrame:
    """(by, n, rho, p) per group: the share of reshuffles that correlate as strongly, each with one added; null where a side is constant.

    A reshuffle orders a group's rows by a hash of seed, round and their place among the ranks, so that it
    doesn't depend on how rows are dealt out. Twice the ranks and their sums are whole numbers, so equal
    correlations are equal. Rounds are dealt out: each of up to `tasks` tasks gets a group's distinct pairs of
    ranks with their counts and does its share of the rounds, one vector at a time, so that what is shuffled
    doesn't grow with the rounds. A group of over `largest` rows is refused with an error.
    """
    keyed = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_seed", F.coalesce(seed, F.lit(1)).cast("long") if seed is not None else F.lit(1).cast("long"))
    twice = keyed.select(by, "_seed", (average_rank(x, by) * 2).cast("long").alias("_a"), (average_rank(y, by) * 2).cast("long").alias("_b"))
    # copies of a row are one with a count, so that heavy ties cost nothing
    cells = twice.groupBy(by, "_a", "_b").agg(F.count("*").alias("_times"), F.min("_seed").alias("_seed"))
    block = max(1, -(-rounds // tasks))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(max(rounds - 1, 0) // block))).alias("_block")
    dealt = cells.select("*", blocks)
    key = rows.schema[by].dataType.simpleString()

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_a", "_b"])
        if pdf["_times"].sum() > largest:
            raise ValueError(f"a group has {pdf['_times'].sum()} rows, too many to permute in one task")
        a, b = (np.repeat(pdf[c].to_numpy(np.int64), pdf["_times"]) for c in ("_a", "_b"))
        n, start = len(a), int(pdf["_block"].iloc[0]) * block
        centred = a * n - a.sum(), b * n - b.sum()
        spread = [float(c.astype(float) @ c) for c in centred]
        rho = None if 0.0 in spread else float(centred[0].astype(float) @ centred[1] / np.sqrt(spread[0] * spread[1]))
        hits = 0
        if rho is not None:
            expected, own = int(a.sum()) * int(b.sum()), int(a @ b)
            for r in range(start, min(start + block, rounds)):
                drawn = int(a @ b[np.argsort(mixed(int(pdf["_seed"].min()), r, n), kind="stable")])
                hits += abs(n * drawn - expected) >= abs(n * own - expected)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [n], "rho": [rho], "hits": [hits]})

    counted = dealt.groupBy(by, "_block").applyInPandas(each, f"`{by}` {key}, n long, rho double, hits long")
    p = (F.sum("hits") + 1) / F.lit(float(rounds + 1))
    # a group's tasks agree in all but their hits
    return counted.groupBy(by).agg(F.max("n").alias("n"), F.max("rho").alias("rho"), p.alias("p")).withColumn("p", F.when(F.col("rho").isNotNull(), F.col("p")))


def mixed(seed: int, turn: int, n: int) -> np.ndarray:
    """n well-mixed 64-bit numbers by place for a seed and a round (the finaliser of splitmix64, twice)."""

    def finish(z: np.ndarray) -> np.ndarray:
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    with np.errstate(over="ignore"):
        base = finish(np.array([(seed * 0x9E3779B97F4A7C15 + turn) % 2**64], np.uint64))
        return finish(base + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mann_whitney(rows: DataFrame, by: list[str], first: str, value: str) -> DataFrame:
    """Per group n1, n2 and the two-sided p of the tie-corrected normal approximation; first: whether a row is of the first sample."""
    known = rows.where(F.col(value).isNotNull())
    ranked = known.withColumns({"twice": (average_rank(value, *by) * 2).cast("decimal(20,0)"), "ties": F.count("*").over(Window.partitionBy(*by, value))})
    sums = ranked.groupBy(*by).agg(
        F.count_if(F.col(first)).alias("n1"), F.count_if(~F.col(first)).alias("n2"), F.sum(F.when(F.col(first), F.col("twice")).otherwise(0)).cast("double").alias("twice"),
        F.sum((F.col("ties") * F.col("ties") - 1).cast("decimal(20,0)")).cast("double").alias("tie_sum"),
    )
    a, b = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = a + b
    u = F.col("twice") / 2.0 - a * (a + 1.0) / 2.0
    spread = F.sqrt(a * b / 12.0 * (total + 1.0 - F.col("tie_sum") / (total * (total - 1.0))))
    z = (u - a * b / 2.0) / spread
    return sums.select(*by, "n1", "n2", u.alias("u"), F.when(spread == 0, F.lit(1.0)).otherwise(F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(z)))).alias("p"))


def discoveries(rows: DataFrame, p: str, q: float, tie: str, by: list[str] | None = None) -> DataFrame:
    """Rows with `found`: discoveries by Benjamini and Hochberg at level q."""
    by = by or []
    placed = summed_before(rows.withColumn("_one", F.lit(1)), [F.asc(c) for c in (*by, p, tie)], "_one", "_before")
    groups = placed.groupBy(*by).agg(F.min("_before").alias("_start"), F.count("*").alias("_n"))
    meet = lambda a, b: a.join(b, by) if by else a.join(F.broadcast(b))
    marked = meet(placed, groups).withColumn("_k", F.col("_before") - F.col("_start") + 1)
    cuts = marked.groupBy(*by).agg(F.max(F.when(F.col(p) <= F.col("_k") / F.col("_n") * F.lit(q), F.col("_k"))).alias("_cut"))
    return meet(marked, cuts).withColumn("found", F.coalesce(F.col("_k") <= F.col("_cut"), F.lit(False))).select(*rows.columns, "found")


def judged_links(outcomes: DataFrame, q: float = 0.05, least: float = 0.2) -> DataFrame:
    """Outcomes (id, refused, p, effect, size, held, placebos) with a verdict: consistent, not consistent or refused."""
    tested = discoveries(outcomes.where("not refused"), "p", q, "id").select("id", "found")
    beats = F.forall("placebos", lambda x: F.abs("effect") > F.abs(x))
    good = F.col("found") & F.col("held") & beats & (F.col("size") >= least)
    verdict = F.when(F.col("refused"), "refused").when(F.coalesce(good, F.lit(False)), "consistent").otherwise("not consistent")
    return outcomes.join(tested, "id", "left").withColumn("verdict", verdict).drop("found")


def agreement(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Per group n, the observed share of agreement and Cohen's kappa."""
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = known.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    whole = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left, right = (cells.groupBy(*by, F.col(c).alias("label")).agg(F.sum("n").alias(f"n_{c}")) for c in (a, b))
    chance = left.join(right, [*by, "label"]).groupBy(*by).agg(F.sum((F.col(f"n_{a}") * F.col(f"n_{b}")).cast("decimal(38,0)")).cast("double").alias("products"))
    joined = whole.join(chance, by, "left") if by else whole.join(chance)
    n = F.col("n").cast("double")
    observed, expected = F.col("same").cast("double") / n, F.coalesce("products", F.lit(0.0)) / (n * n)
    return joined.select(*by, "n", observed.alias("observed"), kappa(observed, expected).alias("kappa"))


def majority(rows: DataFrame, by: str, answer: str) -> DataFrame:
    """Per item yes, no and the vote: yes, no, tie, or abstain where nobody answered."""
    yes, no = F.count_if(F.col(answer) == "yes"), F.count_if(F.col(answer) == "no")
    return rows.groupBy(by).agg(yes.alias("yes"), no.alias("no")).withColumn("vote", F.expr("CASE WHEN yes + no = 0 THEN 'abstain' WHEN yes = no THEN 'tie' WHEN yes > no THEN 'yes' ELSE 'no' END"))


def pairwise_agreement(answers: DataFrame) -> DataFrame:
    """(run_a, run_b, n, observed, kappa) for every two runs, over items that both answered (run, item, answer)."""
    left = answers.select(F.col("run").alias("run_a"), "item", F.col("answer").alias("a"))
    right = answers.select(F.col("run").alias("run_b"), "item", F.col("answer").alias("b"))
    return agreement(left.join(right, "item").where("run_a < run_b"), ["run_a", "run_b"], "a", "b")


def entropy(rows: DataFrame, by: list[str], signature: str) -> DataFrame:
    """Per group the entropy, in nats, of how often each signature occurs."""
    n = rows.groupBy(*by, signature).agg(F.count("*").alias("n"))
    share = F.col("n").cast("double") / F.sum("n").over(Window.partitionBy(*by)).cast("double")
    return n.withColumn("term", -share * F.log(share)).groupBy(*by).agg(F.sum("term").alias("entropy"))


def resampled(groups: DataFrame, sums: list[str], statistic: Column, rounds: int = 2000, seed: int = 1, confidence: float = 0.95) -> DataFrame:
    """(value, low, high): a statistic of summed columns, and its interval over resampled groups (group and `sums`).

    statistic: of columns named as `sums`, which stand for sums over groups: a ratio of two, a mean, a
    correlation (`correlation`). Each round draws every group a Poisson(1) number of times, by a hash of
    seed, round and group. Draws are summed by round where they are made, so that a partition sends a
    row for each round, however many groups it has. Rounds whose statistic is null don't count; low and
    high are null if none is left.
    """
    spark = groups.sparkSession
    at = spark.range(rounds).withColumnRenamed("id", "round")
    # P(X <= k) of a Poisson variable with mean 1
    total, term, cdf = 0.0, float(np.exp(-1.0)), []
    for k in range(12):
        total += term
        cdf.append(total)
        term /= k + 1
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "round", F.col("group").cast("string")).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(16**13)
    times = sum(((F.lit(c) <= u).cast("int") for c in cdf), F.lit(0))
    each = groups.select("group", *sums, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).withColumn("times", times).where("times > 0")
    drawn = at.join(each.groupBy("round").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in sums]), "round", "left")
    tail = (1 - confidence) / 2
    interval = drawn.select(statistic.alias("x")).agg(F.percentile("x", tail).alias("low"), F.percentile("x", 1 - tail).alias("high"))
    return groups.agg(*[F.sum(c).alias(c) for c in sums]).select(statistic.alias("value")).join(interval)


def correlation(n: str = "n", x: str = "x", y: str = "y", xx: str = "xx", yy: str = "yy", xy: str = "xy") -> Column:
    """Pearson's correlation from sums; null where a side is constant."""
    n_, x_, y_ = (F.col(c).cast("double") for c in (n, x, y))
    a, b = n_ * F.col(xx).cast("double") - x_ * x_, n_ * F.col(yy).cast("double") - y_ * y_
    return F.when((a > 0) & (b > 0), (n_ * F.col(xy).cast("double") - x_ * y_) / F.sqrt(a * b))


def share(hits: str = "hits", n: str = "n") -> Column:
    """A sum per another, as of a share or a mean; null where that is not above zero."""
    return F.when(F.col(n) > 0, F.col(hits).cast("double") / F.col(n))


def bootstrap(groups: DataFrame, rounds: int = 2000, seed: int = 1, confidence: float = 0.95) -> DataFrame:
    """(low, high) of the share hits / n over resampled groups (group, hits, n)."""
    return resampled(groups, ["hits", "n"], share(), rounds, seed, confidence).select("low", "high")


def stratified(rows: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum, the first by a seeded hash of their key (a sampling operator)."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(order, key))).where(F.col("_k") <= n).drop("_k")
