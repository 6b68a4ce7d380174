"""Sums up a hierarchy, shares, bands and histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersight.operators.ranks import summed_before
from tiersight.operators.staging import stage


def child_counts(children: DataFrame, parent: str, parents: DataFrame, key: str, name: str = "children") -> DataFrame:
    """Every parent with its number of children, 0 where it has none."""
    counts = children.groupBy(F.col(parent).alias(key)).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def complete_sum(value: Column) -> Column:
    """The sum of a group, null if any part is missing."""
    return F.when(F.count(value) == F.count("*"), F.sum(value))


def summed_parents(facts: DataFrame, links: DataFrame) -> DataFrame:
    """facts (code, path, value) and, for parents that have none of their own, their children's sums.

    links: code, parent. basis says which: own or children_sum.
    """
    sums = facts.join(links, "code").groupBy(F.col("parent").alias("code"), "path").agg(F.sum("value").alias("value"))
    missing = sums.join(facts.select("code").distinct(), "code", "left_anti")
    return facts.select("code", "path", "value", F.lit("own").alias("basis")).unionByName(missing.withColumn("basis", F.lit("children_sum")))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Per group, of the rows that have a value; null where their weights sum to nothing."""
    total = F.sum(F.when(value.isNotNull(), weight)).cast("double")
    return F.sum(value * weight).cast("double") / F.nullif(total, F.lit(0.0))


def share_beyond(value: Column, weight: Column, limit: float) -> Column:
    total = F.sum(F.when(value.isNotNull(), weight)).cast("double")
    return F.coalesce(F.sum(F.when(value > limit, weight)), F.lit(0)).cast("double") / F.nullif(total, F.lit(0.0)) * 100


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, lo, hi, n) of half-open bins, also empty ones; the first and last are open-ended."""
    spark = rows.sparkSession
    bin_ = F.lit(0)
    for k, edge in enumerate(edges):
        bin_ = F.when(F.col(value) >= edge, k + 1).otherwise(bin_)
    counts = rows.where(F.col(value).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    bounds = [(k, None if k == 0 else edges[k - 1], None if k == len(edges) else edges[k]) for k in range(len(edges) + 1)]
    return spark.createDataFrame(bounds, "bin int, lo double, hi double").join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def equal_width(rows: DataFrame, value: str, bins: int, log: bool = False) -> DataFrame:
    """(bin, n) of equal bins from the least to the most value, which is in the last; empty bins too.

    log: bins of equal width on a logarithmic axis, of values above zero.
    """
    x = F.when(F.col(value) > 0, F.log(value)) if log else F.col(value)
    rows = rows.select(x.alias("x")).where("x is not null")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    placed = rows.join(F.broadcast(ends)).select(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(placed.groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def nearest_ranks(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, n, ranks): per group the values at place floor(n * share), from 0, of its sorted values; nulls don't count.

    Equal values are counted first and dealt out by ranges of (group, value), so that a group of any
    size is in as many tasks as it has ranges; each range starts from the count of the group's earlier
    ones, and only values that hold a wanted place are kept.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    ranged = stage(counted.repartitionByRange(*by, "_value").withColumn("_range", F.spark_partition_id()))
    parts = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_of_range"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_of_range").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_at"), before.alias("_start"), F.sum("_of_range").over(group).alias("n"))
    met = (F.col("_range") == F.col("_at")) & reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True))
    within = Window.partitionBy(*by, "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(parts, met).withColumn("_start", F.col("_start") + F.coalesce(F.sum("_n").over(within), F.lit(0)))
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1).alias("rank")) for k, q in enumerate(shares)])
    held = placed.select(*by, "n", "_value", F.explode(F.filter(wanted, lambda w: (w["rank"] >= F.col("_start")) & (w["rank"] < F.col("_start") + F.col("_n")))).alias("w"))
    found = held.groupBy(*by, "n").agg(F.array_sort(F.collect_list(F.struct(F.col("w.k").alias("k"), F.col("_value").alias("value")))).alias("w"))
    return found.select(*by, "n", F.transform("w", lambda w: w["value"]).alias("ranks"))


def greedy_cover(rows: DataFrame, code: str, density: str, amount: str, share: float = 0.5) -> DataFrame:
    """The densest units that together hold a share of the amount, and what the denser ones hold (reached)."""
    total = rows.agg(F.sum(amount).alias("_total"))
    summed = summed_before(rows, [F.desc(density), F.asc(code)], amount, "reached").join(F.broadcast(total))
    return summed.where(F.col("reached") < F.col("_total") * F.lit(share).cast("decimal(3,2)")).select(*rows.columns, "reached")


def residual(total: Column, parts: Column, held: Column) -> Column:
    """What of a total its parts and what is held back leave; null when nothing."""
    left = total - F.coalesce(parts, F.lit(0)) - F.coalesce(held, F.lit(0))
    return F.when(left > 0, left)


def nested_topics(facts: DataFrame) -> DataFrame:
    """(code, topics): map of topic to map of key to value, from (code, path, value)."""
    topic, key = F.substring_index("path", ".", 1), F.regexp_extract("path", r"^[^.]*\.(.*)$", 1)
    inner = facts.groupBy("code", topic.alias("topic")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.col("value").alias("v"))))).alias("values"))
    return inner.groupBy("code").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("topic", F.to_json("values").alias("values"))))).alias("topics"))


def run_compared(a: DataFrame, b: DataFrame, top: int = 5) -> DataFrame:
    """Two runs on their common ids: passes, sums, flips and the biggest moves (id, passed, score)."""
    both = a.select("id", F.col("passed").alias("p1"), F.col("score").alias("s1")).join(b.select("id", F.col("passed").alias("p2"), F.col("score").alias("s2")), "id")
    moves = both.where("s1 <> s2").select((-F.abs(F.col("s2") - F.col("s1"))).alias("by"), "id").orderBy("by", "id").limit(top)
    moves = moves.agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("by", "id"))), lambda m: m["id"].cast("string"))).alias("moves"))
    sums = both.agg(
        F.count("*").alias("common"), F.count_if("p1").alias("passes_1"), F.count_if("p2").alias("passes_2"),
        F.sum("s1").alias("sum_1"), F.sum("s2").alias("sum_2"), F.count_if(F.col("p1") != F.col("p2")).alias("flips"),
    )
    return sums.join(F.broadcast(moves))
