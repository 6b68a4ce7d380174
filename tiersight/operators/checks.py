"""Checks of findings, as data: a figure compared, a change, or a rank, of a unit, its parent, its neighbours or the country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "id string, code string, kind string, subject string, other string, path string, period string, op string, value double, within string, position string, share double"


def _holds(op: Column, left: Column, right: Column) -> Column:
    return F.when(op == ">", left > right).when(op == ">=", left >= right).when(op == "<", left < right).when(op == "<=", left <= right)


def subjects(checks: DataFrame, units: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, target): the units that a check reads: one, or all neighbours."""
    parent = units.select("code", "parent")
    own = checks.where("subject = 'self'").select("id", F.col("code").alias("target"))
    up = checks.where("subject = 'parent'").join(parent, "code").select("id", F.col("parent").alias("target")).where("target is not null")
    given = checks.where("subject = 'code'").select("id", F.col("other").alias("target"))
    country = checks.where("subject = 'country'").join(F.broadcast(units.where("parent is null").select(F.col("code").alias("target"))))
    near = checks.where("subject = 'neighbours'").join(edges, F.col("code") == F.col("a")).select("id", F.col("b").alias("target"))
    return own.unionAll(up).unionAll(given).unionAll(country.select("id", "target")).unionAll(near)


def evaluated(checks: DataFrame, units: DataFrame, facts: DataFrame, edges: DataFrame, families: DataFrame, measures: DataFrame) -> DataFrame:
    """(id, status, reason, number): passed, failed or refused.

    checks: SCHEMA; units: code, level, parent; facts: code, path, period (now, before), value; edges: a, b,
    both ways; families: path, family; measures: code, measure, the finding's own, whose family a check may
    not read. A check of several neighbours reads their median and refuses fewer than two; a missing figure
    fails; a rank refuses a share of less than one place.
    """
    known = facts.where(F.col("value").isNotNull())
    asked = checks.join(families, "path", "left").join(measures, "code", "left").join(families.select(F.col("path").alias("measure"), F.col("family").alias("own")), "measure", "left")
    asked = asked.withColumn("tautology", F.coalesce(F.col("family") == F.col("own"), F.lit(False)))
    read = checks.select("id", "path", "period", "kind", "subject").join(subjects(checks, units, edges), "id")
    now = known.where("period = 'now'").select(F.col("code").alias("target"), "path", F.col("value").alias("now"))
    before = known.where("period = 'before'").select(F.col("code").alias("target"), "path", F.col("value").alias("before"))
    both = read.join(now, ["target", "path"], "left").join(before, ["target", "path"], "left")
    number = F.when(F.col("kind") == "change", F.col("now") - F.col("before")).when(F.col("period") == "before", F.col("before")).otherwise(F.col("now"))
    values = both.withColumn("number", number).groupBy("id").agg(F.median("number").alias("number"), F.count("number").alias("n"), F.count("*").alias("targets"))
    # ranks among units of the subject's level, in the country or under the same parent
    levels = units.select(F.col("code").alias("target"), "level", "parent")
    figures = known.select(F.col("code").alias("target"), "path", "period", F.col("value").alias("v")).join(levels, "target")
    ranks = None
    for within, group in (("country", ["level"]), ("parent", ["level", "parent"])):
        w = Window.partitionBy(*group, "path", "period")
        part = figures.select("target", "path", "period", F.lit(within).alias("within"), F.rank().over(w.orderBy(F.desc("v"))).alias("rank"), F.count("*").over(w).alias("of"))
        ranks = part if ranks is None else ranks.unionAll(part)
    placed = checks.where("kind = 'rank'").select("id", "path", "period", "within").join(subjects(checks.where("kind = 'rank' and subject in ('self', 'parent', 'code')"), units, edges), "id").join(ranks, ["target", "path", "period", "within"])
    out = asked.join(values, "id", "left").join(placed.select("id", "rank", "of"), "id", "left")
    cut = F.ceil(F.col("share") * F.col("of"))
    top = F.when(F.col("position") == "top", F.col("rank") <= cut).otherwise(F.col("rank") > F.col("of") - cut)
    ranked = F.col("kind") == "rank"
    reason = (
        F.when(F.col("family").isNull(), "unknown field").when(F.col("tautology"), "tautology").when(F.coalesce("targets", F.lit(0)) == 0, "unknown unit")
        .when(ranked & F.col("subject").isin("neighbours", "country"), "wrong subject")
        .when((F.col("subject") == "neighbours") & (F.col("n") < 2), "too few neighbours")
        .when(ranked & (F.col("share") * F.col("of") < 1), "too few places for that share")
    )
    passed = F.when(ranked, top).otherwise(_holds(F.col("op"), F.col("number"), F.col("value")))
    status = F.when(F.col("reason").isNotNull(), "refused").when(F.coalesce(passed, F.lit(False)), "passed").otherwise("failed")
    out = out.withColumn("reason", reason)
    why = F.coalesce("reason", F.when(F.when(ranked, F.col("rank")).otherwise(F.col("number")).isNull(), "missing"))
    return out.select("id", status.alias("status"), why.alias("reason"), F.when(ranked, F.col("rank").cast("double")).otherwise(F.col("number")).alias("number"))
