"""Ranks, tails, standings and filled-down hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersight.operators.staging import stage


def with_moments(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Rows with n, mean and population spread of their group; the spread is null where there is none.

    value: a decimal or whole number, so that sums are exact however they are dealt out. Groups are
    summed up before their rows are joined, so that a hot group is nowhere together.
    """
    x = F.col(value)
    sums = rows.groupBy(*by).agg(F.count(x).alias("n"), F.sum(x).cast("double").alias("mean"), F.sum(x * x).cast("double").alias("spread"))
    n, mean = F.col("n").cast("double"), F.col("mean") / F.col("n").cast("double")
    spread = F.sqrt(F.greatest(F.col("spread") / n - mean * mean, F.lit(0.0)))
    return rows.join(sums.select(*by, "n", mean.alias("mean"), F.when(spread > 0, spread).alias("spread")), list(by))


def summed_before(rows: DataFrame, order: list[Column], amount: str, name: str) -> DataFrame:
    """Rows with the sum of an amount over all rows before them in an order, which must be total.

    Rows are dealt out by ranges of the order and written; each range starts from what the earlier ones
    sum up to, a row for each range, so that no task sees more than a range.
    """
    part, start = f"_{name}_range", f"_{name}_start"
    ranged = stage(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(part).agg(F.sum(amount).alias("_sum")).select(part, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias(start))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), part)
    return out.withColumn(name, F.col(start) + F.coalesce(F.sum(amount).over(within), F.lit(0))).drop(part, start)


def average_rank(value: str, *by: str) -> Column:
    """1-based ranks; equal values share the mean of theirs."""
    ordered, tied = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return F.rank().over(ordered) + (F.count("*").over(tied) - 1) / F.lit(2.0)


def percentile_rank(value: str, *by: str) -> Column:
    """0 to 100, ties in the middle; 50 for a group of one."""
    n = F.count("*").over(Window.partitionBy(*by))
    return F.when(n < 2, F.lit(50.0)).otherwise((average_rank(value, *by) - F.lit(1.0)) / (n - 1) * F.lit(100.0))


def standing(value: str, *by: str) -> tuple[Column, Column]:
    """Percent of the others below and above."""
    n = F.count("*").over(Window.partitionBy(*by))
    below = F.rank().over(Window.partitionBy(*by).orderBy(F.col(value))) - 1
    above = F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).desc())) - 1
    others = F.nullif(n - 1, F.lit(0)).cast("double")
    return below.cast("double") / others * 100, above.cast("double") / others * 100


def best_of(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def short_lists(rows: DataFrame, section: str, value: str, ties: list[str], most: int = 100) -> DataFrame:
    """Rows with `place`, highest value first, of the sections that `most` rows or fewer are in; rows without a value are in none.

    Sections are counted before their rows meet, so that no long one is ordered.
    """
    known = rows.where(F.col(value).isNotNull() & F.col(section).isNotNull())
    short = known.groupBy(section).agg(F.count("*").alias("_n")).where(F.col("_n") <= most).select(section)
    order = Window.partitionBy(section).orderBy(F.col(value).desc(), *ties)
    return known.join(short, section, "left_semi").withColumn("place", F.row_number().over(order))


def unique_slugs(rows: DataFrame, slug: str, code: str) -> DataFrame:
    """Slugs that several rows share get their code's digits."""
    shared = F.count("*").over(Window.partitionBy(slug)) > 1
    return rows.withColumn(slug, F.when(shared, F.concat(F.col(slug), F.lit("-"), F.regexp_replace(F.col(code).cast("string"), r"\.", ""))).otherwise(F.col(slug)))


#: What a row of a kind opens, and what it closes; rows of other kinds do neither.
OPENS = {"region": "region", "province": "province", "district": "district", "cercle": "cercle", "commune": "commune"}
CLOSES = {
    "region": {"province", "cercle", "district", "commune"},
    "province": {"cercle", "district", "commune"},
    "cercle": {"district", "commune"},
    "commune": {"district"},
}


def filled_down(rows: DataFrame, part: str, index: str = "row_idx", kind: str = "kind", code: str = "code") -> DataFrame:
    """Rows of a published listing with the codes of the units that they stand under.

    part: the listing (sheet or file) that rows are of, in each of which state starts anew. A level's
    last opener counts unless a row that closes the level came after it.
    """
    w = Window.partitionBy(part).orderBy(index)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = rows
    for level in OPENS:
        opened = F.struct(F.col(index).alias("at"), F.col(code).alias("code"))
        closers = [k for k, closed in CLOSES.items() if level in closed]
        last = F.last(F.when(F.col(kind) == level, opened), ignorenulls=True).over(before)
        closed = F.last(F.when(F.col(kind).isin(closers), F.col(index)), ignorenulls=True).over(before) if closers else F.lit(None).cast("long")
        out = out.withColumn(f"_{level}", F.when(closed.isNull() | (closed < last["at"]), last["code"]))
    own_closes = lambda level: F.col(kind).isin([k for k, closed in CLOSES.items() if level in closed])
    for level in OPENS:
        out = out.withColumn(f"in_{level}", F.when(~own_closes(level) & (F.col(kind) != level), F.col(f"_{level}")))
    settled = F.when(F.col(kind) == "commune", F.when(F.col("in_cercle").isNotNull(), "rural").otherwise("urban"))
    return out.withColumn("type", settled).drop(*[f"_{level}" for level in OPENS])
