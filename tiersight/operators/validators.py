"""Checks of a dataset: each gives rows of problems, all of them, so that one run reports everything."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersight.operators.graph import components

PROBLEM = "check string, code string, detail string"


def _problem(rows: DataFrame, check: str, code: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), code.cast("string").alias("code"), detail.cast("string").alias("detail"))


def wrong_count(rows: DataFrame, expected: int, check: str) -> DataFrame:
    n = rows.agg(F.count("*").alias("n")).where(F.col("n") != expected)
    return _problem(n, check, F.lit(None), F.concat(F.col("n").cast("string"), F.lit(f" instead of {expected}")))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    n = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return _problem(n, f"duplicate {key}", F.col(key), F.col("n"))


def orphans(children: DataFrame, parent: str, parents: DataFrame, key: str, code: str) -> DataFrame:
    lost = children.where(F.col(parent).isNotNull()).join(parents.select(F.col(key).alias(parent)), parent, "left_anti")
    return _problem(lost, f"no such {parent}", F.col(code), F.col(parent))


def not_bijective(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return duplicates(pairs, left).unionAll(duplicates(pairs, right))


def out_of_range(rows: DataFrame, code: str, value: str, lo: float, hi: float) -> DataFrame:
    return _problem(rows.where((F.col(value) < lo) | (F.col(value) > hi)), f"{value} out of range", F.col(code), F.col(value))


def unequal_parts(facts: DataFrame, whole: str, parts: list[str], tolerance: Column | float = 0.0) -> DataFrame:
    """Wholes that differ from the sum of their parts, where all are known (facts: code, path, value)."""
    wanted = facts.where(F.col("path").isin([whole, *parts])).groupBy("code").agg(
        F.max(F.when(F.col("path") == whole, F.col("value"))).alias("whole"),
        F.sum(F.when(F.col("path") != whole, F.col("value"))).alias("sum"),
        F.count(F.when(F.col("path") != whole, F.col("value"))).alias("known"),
    )
    bad = wanted.where((F.col("known") == len(parts)) & (F.abs(F.col("whole") - F.col("sum")) > tolerance))
    return _problem(bad, f"{whole} is not its parts", F.col("code"), F.col("whole") - F.col("sum"))


def shares_off(facts: DataFrame, prefix: str, slack: float = 0.05) -> DataFrame:
    """Shares of one question that don't add up to 100, give or take a rounding of each."""
    rows = facts.where(F.col("path").startswith(prefix)).groupBy("code").agg(F.sum("value").alias("sum"), F.count("value").alias("known"), F.count("*").alias("n"))
    bad = rows.where((F.col("known") == F.col("n")) & (F.abs(F.col("sum") - 100) > F.col("n") * F.lit(slack)))
    return _problem(bad, f"{prefix} off 100", F.col("code"), F.col("sum"))


def unreconciled(facts: DataFrame, links: DataFrame) -> DataFrame:
    """(parent, path, own, children): parents' figures that aren't the sum of their children's, either side missing included."""
    sums = facts.join(links, "code").groupBy("parent", "path").agg(F.sum("value").alias("children"))
    own = facts.join(links.select(F.col("parent").alias("code")).distinct(), "code", "left_semi").select(F.col("code").alias("parent"), "path", F.col("value").alias("own"))
    return own.join(sums, ["parent", "path"], "full_outer").where(~F.col("own").eqNullSafe(F.col("children")))


def disagreeing(now: DataFrame, before: DataFrame, limit: float) -> DataFrame:
    """(code, path, moved): shares that moved further between censuses than a population can."""
    both = now.join(before.withColumnRenamed("value", "old"), ["code", "path"])
    return both.withColumn("moved", F.col("value") - F.col("old")).where(F.abs("moved") > limit).select("code", "path", "moved")


def undone(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Border problems: pairs out of order, repeated pairs, units without any border."""
    order = _problem(edges.where("a >= b"), "pair out of order", F.col("a"), F.col("b"))
    twice = edges.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    ends = edges.select(F.col("a").alias("code")).union(edges.select("b")).distinct()
    lone = nodes.join(ends, "code", "left_anti")
    return order.unionAll(_problem(twice, "repeated pair", F.col("a"), F.col("b"))).unionAll(_problem(lone, "no border", F.col("code"), F.lit(None)))


def in_parts(edges: DataFrame) -> DataFrame:
    """A problem for every part of a border graph but the one with the smallest unit."""
    parts = components(edges).where("node = component").select("component")
    first = parts.agg(F.min("component").alias("first"))
    return _problem(parts.join(F.broadcast(first), F.col("component") > F.col("first")), "not connected", F.col("component"), F.lit(None))


def uncovered_area(parents: DataFrame, children: DataFrame, limit: float = 0.01) -> DataFrame:
    """Parents (code, area) whose children's areas (parent, area) differ from theirs by over a share of it; decimals."""
    sums = children.groupBy(F.col("parent").alias("code")).agg(F.sum("area").alias("covered"))
    off = parents.join(sums, "code").where(F.abs(F.col("covered") - F.col("area")) > F.col("area") * F.lit(limit).cast("decimal(4,3)"))
    return _problem(off, "area not covered", F.col("code"), F.col("covered"))


def unsourced(records: DataFrame, figures: dict[str, str], sources: DataFrame) -> DataFrame:
    """Figures that are there without a source (figures: column to the column of its source), and sources that aren't registered (sources: id)."""
    said = F.explode(F.array(*[F.struct(F.lit(v).alias("figure"), F.col(v).isNotNull().alias("there"), F.col(c).alias("source")) for v, c in figures.items()])).alias("x")
    rows = records.select("code", said).select("code", "x.*")
    missing = _problem(rows.where("there and source is null"), "no source", F.col("code"), F.col("figure"))
    unknown = rows.where("source is not null").join(F.broadcast(sources), F.col("source") == F.col("id"), "left_anti")
    return missing.unionAll(_problem(unknown, "unknown source", F.col("code"), F.col("source")))


def differing_lists(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What is found but not known, and known but not found."""
    both = found.select(key).distinct().withColumn("_found", F.lit(True)).join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "full_outer")
    return _problem(both.where("_found is null or _known is null"), "list differs", F.col(key), F.when(F.col("_known").isNull(), "not known").otherwise("not found"))


def degenerate_rings(points: DataFrame) -> DataFrame:
    n = points.groupBy("ring").agg(F.count_distinct("x", "y").alias("n")).where("n < 3")
    return _problem(n, "degenerate ring", F.col("ring"), F.col("n"))


def lost_share(before: DataFrame, after: DataFrame, limit: float = 0.05) -> DataFrame:
    """A problem if more than a share of the rows went missing between two fetches."""
    n = before.agg(F.count("*").alias("b")).join(after.agg(F.count("*").alias("a")))
    return _problem(n.where(F.col("b") - F.col("a") > F.col("b") * F.lit(limit)), "partial fetch", F.lit(None), F.concat_ws(" of ", "a", "b"))


def collected(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def fail_on(problems: DataFrame, shown: int = 50) -> None:
    """Raise one error that lists the first problems, if there are any."""
    rows = problems.orderBy("check", "code").limit(shown).collect()
    if rows:
        raise ValueError("\n".join(f"{r.check}: {r.code} {r.detail or ''}".rstrip() for r in rows))
