"""Tests of links between measures: together over all units, or against peers, with placebos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiersight.operators.hypotheses import mann_whitney, spearman

LEAST_UNITS, LEAST_HALF, PLACEBOS = 30, 10, 3


def placebos(tests: DataFrame, measures: DataFrame, n: int = PLACEBOS) -> DataFrame:
    """(id, measure, k): n measures of other topics and families for each test, by a seeded hash.

    tests: id, x, y, seed; measures: measure, topic, family.
    """
    of = lambda side: measures.select(F.col("measure").alias(side), F.col("topic").alias(f"topic_{side}"), F.col("family").alias(f"family_{side}"))
    known = tests.join(of("x"), "x").join(of("y"), "y")
    other = (F.col("topic") != F.col("topic_x")) & (F.col("topic") != F.col("topic_y")) & (F.col("family") != F.col("family_x")) & (F.col("family") != F.col("family_y"))
    pairs = known.join(F.broadcast(measures), other)  # a catalogue of measures against a batch of tests
    order = F.md5(F.concat_ws(":", F.col("seed").cast("string"), "measure").cast("binary"))
    return pairs.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(order, "measure"))).where(F.col("k") <= n).select("id", "measure", "k")


def _asked(tests: DataFrame, drawn: DataFrame) -> DataFrame:
    """(id, k, x, y): each test as k = 0, and again with each placebo for its x."""
    again = drawn.join(tests.select("id", "y"), "id").select("id", "k", F.col("measure").alias("x"), "y")
    return tests.select("id", F.lit(0).alias("k"), "x", "y").unionAll(again)


def _paired(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, k, code, x_value, y_value) of units that have both figures (facts: code, measure, value)."""
    x = facts.select("code", F.col("measure").alias("x"), F.col("value").alias("x_value"))
    y = facts.select("code", F.col("measure").alias("y"), F.col("value").alias("y_value"))
    return asked.join(x, "x").join(y, ["y", "code"]).where("x_value is not null and y_value is not null")


def together(tests: DataFrame, facts: DataFrame, drawn: DataFrame) -> DataFrame:
    """(id, n, rho, held, placebos, refused): the rank correlation of each test and of its placebos (tests: id, x, y, direction)."""
    rows = spearman(_paired(_asked(tests, drawn), facts), ["id", "k"], "x_value", "y_value")
    own = rows.where("k = 0").select("id", "n", "rho")
    others = rows.where("k > 0 and rho is not null").groupBy("id").agg(F.sort_array(F.collect_list("rho")).alias("placebos"))
    out = tests.select("id", "direction").join(own, "id", "left").join(others, "id", "left")
    refused = F.when(F.coalesce("n", F.lit(0)) < LEAST_UNITS, "too few units").when(F.col("rho").isNull(), "no variation").when(F.coalesce(F.size("placebos"), F.lit(0)) < PLACEBOS, "too few computable placebos")
    return out.select("id", F.coalesce("n", F.lit(0)).alias("n"), "rho", F.when(F.col("direction") == "positive", F.col("rho") > 0).otherwise(F.col("rho") < 0).alias("held"), "placebos", refused.alias("refused"))


def peers(tests: DataFrame, facts: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, n1, n2, u, p, effect, held, refused): outcomes of units over their group's median of x against those under it.

    tests: id, x, y, direction; groups: code, grp.
    """
    rows = _paired(tests.select("id", F.lit(0).alias("k"), "x", "y"), facts).join(groups, "code")
    middle = rows.groupBy("id", "grp").agg(F.median("x_value").alias("middle"))
    split = rows.join(middle, ["id", "grp"]).where("x_value <> middle").withColumn("first", F.col("x_value") > F.col("middle"))
    tested = mann_whitney(split, ["id"], "first", "y_value")
    effect = F.median(F.when(F.col("first"), F.col("y_value"))) - F.median(F.when(~F.col("first"), F.col("y_value")))
    out = tests.select("id", "direction").join(tested, "id", "left").join(split.groupBy("id").agg(effect.alias("effect")), "id", "left")
    n1, n2 = F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))
    refused = F.when(n1 + n2 < LEAST_UNITS, "too few units").when(F.least(n1, n2) < LEAST_HALF, "unbalanced halves")
    return out.select("id", n1.alias("n1"), n2.alias("n2"), "u", "p", "effect", F.when(F.col("direction") == "higher", F.col("effect") > 0).otherwise(F.col("effect") < 0).alias("held"), refused.alias("refused"))
