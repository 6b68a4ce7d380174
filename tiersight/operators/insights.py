"""Figures that stand out: extremes, changes, gaps, and what is more likely an error in the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiersight.functions.text import short_id
from tiersight.operators.ranks import best_of, with_moments

FINDING = ["id", "code", "level", "measure", "kind", "value", "reference", "score", "direction"]


def _finding(rows: DataFrame, kind: str, high) -> DataFrame:
    named = rows.withColumns({"kind": F.lit(kind), "id": short_id(F.col("code"), F.col("measure"), F.lit(kind)), "direction": F.when(high, "high").otherwise("low")})
    return named.select(*FINDING)


def extremes(facts: DataFrame, floor: float, share: float = 0.01) -> DataFrame:
    """Both tails of each measure among units of some size; facts: code, level, size, measure, value (decimal).

    A tail has a share of the units, one at least. Ties are cut by code.
    """
    rows = facts.where(F.col("size") >= floor).where("value is not null")
    # every row of a tail is beyond these, whose ranks are off by a ten-thousandth of the rows at most
    beyond = min(1.0, 1.5 * share + 0.001)
    cuts = rows.groupBy("measure").agg(F.percentile_approx("value", [beyond, 1 - beyond], 10_000).alias("cut"))
    rows = with_moments(rows, "value", "measure").join(cuts, "measure").where((F.col("value") <= F.col("cut")[0]) | (F.col("value") >= F.col("cut")[1]))
    up, down = Window.partitionBy("measure").orderBy("value", "code"), Window.partitionBy("measure").orderBy(F.desc("value"), F.desc("code"))
    tail = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share) + F.lit(0.5)))
    rows = rows.withColumns({"tail": tail, "low": F.row_number().over(up), "top": F.row_number().over(down)})
    rows = rows.where("spread is not null and (low <= tail or top <= tail)").withColumn("value", F.col("value").cast("double"))
    scored = rows.withColumns({"reference": F.col("mean"), "score": F.abs(F.col("value") - F.col("mean")) / F.col("spread")})
    return _finding(scored, "extreme", F.col("value") >= F.col("reference"))


def changes(facts: DataFrame, edges: DataFrame, least_units: int = 10, threshold: float = 3.0, still: float = 0.1) -> DataFrame:
    """Changes far from those of their level; lone swings of slow measures where the population stood still are artefacts.

    facts: code, level, measure, slow, before, after (decimals), size_before, size_after. edges: a, b, both ways.
    A swing is borne out by a neighbour that moved the same way at least half as much.
    """
    moved = facts.where("before is not null and after is not null").withColumn("change", F.col("after") - F.col("before"))
    scored = with_moments(moved, "change", "level", "measure")
    scored = scored.withColumn("z", (F.col("change").cast("double") - F.col("mean")) / F.col("spread"))
    far = scored.where((F.col("n") >= least_units) & (F.abs("z") >= threshold))
    near = edges.join(moved.select(F.col("code").alias("b"), "measure", F.col("change").alias("theirs")), "b")
    same_way = F.signum("theirs") == F.signum("change")
    borne_out = far.join(near.withColumnRenamed("a", "code"), ["code", "measure"]).where(same_way & (F.abs("theirs") * 2 >= F.abs("change"))).select("code", "measure").distinct()
    still_there = (F.col("size_before") > 0) & (F.abs(F.col("size_after") - F.col("size_before")) / F.col("size_before") < still)
    judged = far.join(borne_out.withColumn("borne_out", F.lit(True)), ["code", "measure"], "left")
    kind = F.when(F.col("slow") & F.coalesce(still_there, F.lit(False)) & F.col("borne_out").isNull(), "artefact").otherwise("change")
    out = judged.withColumns({"kind": kind, "value": F.col("change").cast("double"), "reference": F.lit(0.0), "score": F.abs("z")})
    return out.withColumns({"id": short_id(F.col("code"), F.col("measure"), F.col("kind")), "direction": F.when(F.col("value") > 0, "high").otherwise("low")}).select(*FINDING)


def gaps(children: DataFrame, parents: DataFrame, least: int = 8, threshold: float = 3.0) -> DataFrame:
    """Children far from their parent's own figure, against their siblings.

    children: code, level, parent, measure, value (decimal); parents: parent, measure, parent_value.
    """
    rows = children.where("value is not null").join(parents.where("parent_value is not null"), ["parent", "measure"]).withColumn("diff", F.col("value") - F.col("parent_value"))
    rows = with_moments(rows, "diff", "parent", "measure")
    rows = rows.withColumn("z", (F.col("diff").cast("double") - F.col("mean")) / F.col("spread")).where((F.col("n") >= least) & (F.abs("z") >= threshold))
    high = F.col("diff") > 0
    return _finding(rows.withColumns({"value": F.col("value").cast("double"), "reference": F.col("parent_value").cast("double"), "score": F.abs("z")}), "gap", high)


def implausible(facts: DataFrame, checks: dict[str, object]) -> DataFrame:
    """(code, reason): the first check that a unit's record fails, in the order given."""
    reason = F.lit(None).cast("string")
    for name, failed in reversed(list(checks.items())):
        reason = F.when(failed, name).otherwise(reason)
    return facts.withColumn("reason", reason).where("reason is not null").select("code", "reason")


def with_artefacts(findings: DataFrame, wrong: DataFrame) -> DataFrame:
    """Findings on implausible records as artefacts; of one id the one with the highest score."""
    hit = findings.join(wrong.select("code").distinct().withColumn("wrong", F.lit(True)), "code", "left")
    turned = F.col("wrong").isNotNull() & (F.col("kind") != "artefact")
    hit = hit.withColumns({"id": F.when(turned, short_id(F.col("code"), F.col("measure"), F.lit("artefact"))).otherwise(F.col("id")), "kind": F.when(turned, "artefact").otherwise(F.col("kind"))})
    return best_of(hit.select(*FINDING), ["id"], [F.desc("score"), F.desc("kind")])


def ranked(findings: DataFrame, per_unit: int = 3, cap: int = 300) -> DataFrame:
    """The highest scores: so many of each unit, so many in all (a report's length)."""
    order = [F.desc("score"), F.asc("id")]
    return best_of(findings, ["code"], order, per_unit).orderBy(*order).limit(cap)


def dropped(findings: DataFrame, reasons: dict[str, object]) -> DataFrame:
    """Findings with the first reason not to publish them; null where there is none."""
    reason = F.lit(None).cast("string")
    for name, applies in reversed(list(reasons.items())):
        reason = F.when(applies, name).otherwise(reason)
    return findings.withColumn("dropped", reason)


def neighbour_context(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, middle, furthest, distance): the neighbours' median and the one whose value is furthest; facts: code, value."""
    pairs = edges.join(facts.select(F.col("code").alias("b"), F.col("value").alias("theirs")), "b").join(facts.select(F.col("code").alias("a"), "value"), "a")
    away = F.abs(F.col("theirs") - F.col("value"))
    best = F.max_by("b", F.struct(away, -F.col("b")))
    return pairs.groupBy(F.col("a").alias("code")).agg(F.median("theirs").alias("middle"), best.alias("furthest"), F.max(away).alias("distance"))
