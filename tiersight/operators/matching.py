"""Joins that pair up records: fallbacks, names unique on both sides, mutual best, and what is left over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersight.operators.ranks import best_of


def prior_values(now: DataFrame, before: DataFrame, children: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(code, value, basis): the earlier value by equal code, else the complete sum of children, else the crosswalk.

    now: code; before: code, value; children: parent, code; crosswalk: code, before_code. A sum with a
    missing child counts as none.
    """
    exact = before.select("code", F.col("value").alias("v1"))
    parts = children.join(before, "code", "left").groupBy(F.col("parent").alias("code"))
    sums = parts.agg(F.when(F.count("value") == F.count("*"), F.sum("value")).alias("v2"))
    crossed = crosswalk.join(before.select(F.col("code").alias("before_code"), F.col("value").alias("v3")), "before_code").select("code", "v3")
    joined = now.select("code").join(exact, "code", "left").join(sums, "code", "left").join(crossed, "code", "left")
    basis = F.when(F.col("v1").isNotNull(), "code").when(F.col("v2").isNotNull(), "children_sum").when(F.col("v3").isNotNull(), "crosswalk")
    return joined.select("code", F.coalesce("v1", "v2", "v3").alias("value"), basis.alias("basis"))


def split_matched(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of left that right has, those that it hasn't, and right's that left hasn't."""
    return left.join(right, key, "left_semi"), left.join(right, key, "left_anti"), right.join(left, key, "left_anti")


def unique_pairs(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(left, right) codes whose key occurs once on either side, as in a crosswalk's first pass."""
    once = lambda df, name: df.groupBy(*key).agg(F.count("*").alias("n"), F.first("code").alias(name)).where("n = 1").drop("n")
    return once(left.dropna(subset=key), "left").join(once(right.dropna(subset=key), "right"), key).select("left", "right")


def crosswalk(left: DataFrame, right: DataFrame, group: str, name: str) -> DataFrame:
    """(left, right, method, candidates) of units (code, row_idx, size, group, name) that changed their code.

    First by a name unique in its group on both sides; then, in groups where one unit of the right is
    left, to the first of the left that remains. candidates: how many of the right were left in the
    group when the pair was made. ratio: left size over right size, null for a base of zero.
    """
    first = unique_pairs(left, right, [group, name]).withColumn("method", F.lit("name"))
    rest_left = left.join(first.select(F.col("left").alias("code")), "code", "left_anti")
    rest_right = right.join(first.select(F.col("right").alias("code")), "code", "left_anti")
    sole = rest_right.groupBy(group).agg(F.count("*").alias("n"), F.first("code").alias("right")).where("n = 1").drop("n")
    second = best_of(rest_left, [group], [F.asc("row_idx")]).select(group, F.col("code").alias("left")).join(sole, group).select("left", "right", F.lit("sole").alias("method"))
    pairs = first.select("left", "right", "method").unionByName(second)
    placed = pairs.join(left.select(F.col("code").alias("left"), group, "row_idx", F.col("size").alias("left_size")), "left").join(right.select(F.col("code").alias("right"), F.col("size").alias("right_size")), "right")
    total = right.groupBy(group).agg(F.count("*").alias("total"))
    order = Window.partitionBy(group).orderBy(F.col("method") == "sole", "row_idx")
    taken = F.row_number().over(order) - 1
    ratio = F.col("left_size") / F.nullif(F.col("right_size"), F.lit(0).cast("decimal(1,0)"))
    return placed.join(total, group).select("left", "right", "method", (F.col("total") - taken).alias("candidates"), ratio.cast("double").alias("ratio"))


def gated(left: DataFrame, right: DataFrame, key: str, gate: Column) -> DataFrame:
    """Pairs of equal key that also pass a gate on their columns."""
    return left.join(right, key).where(gate)


def best_within(pairs: DataFrame, left: str, score: Column, ties: list[Column]) -> DataFrame:
    """Each left's best partner."""
    return best_of(pairs.withColumn("score", score), [left], [F.desc("score"), *ties])


def mutual_best(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs that are each other's best; ties go to the smaller names."""
    a = F.row_number().over(Window.partitionBy(left).orderBy(F.desc(score), right))
    b = F.row_number().over(Window.partitionBy(right).orderBy(F.desc(score), left))
    return pairs.withColumns({"_a": a, "_b": b}).where("_a = 1 and _b = 1").drop("_a", "_b")


def claimed(rows: DataFrame, units: DataFrame, tag: str) -> DataFrame:
    """Rows with status and reason: matched, unmatched, or rejected where an earlier row has the unit (rows: row_idx, tag)."""
    joined = rows.join(units.select(F.col("code").alias(tag), F.lit(True).alias("known")), tag, "left")
    first = F.row_number().over(Window.partitionBy(tag).orderBy("row_idx"))
    status = F.when(F.col(tag).isNull() | F.col("known").isNull(), "unmatched").when(first > 1, "rejected").otherwise("matched")
    reason = F.when(F.col(tag).isNull(), "no tag").when(F.col("known").isNull(), "unknown code").when(first > 1, "taken")
    return joined.withColumns({"status": status, "reason": reason}).drop("known")


def zipped(sheets: list[DataFrame], key: str = "row_idx", same: str = "code") -> DataFrame:
    """Sheets side by side, row by row; fails where the rows' codes differ or a row is missing."""
    out = sheets[0]
    for sheet in sheets[1:]:
        other = sheet.withColumnRenamed(same, f"_{same}")
        out = out.join(other, key, "full_outer")
        fine = F.col(same).eqNullSafe(F.col(f"_{same}"))
        message = F.concat(F.lit("rows differ at "), F.col(key).cast("string"))
        out = out.withColumn(same, F.when(fine, F.col(same)).otherwise(F.raise_error(message).cast(sheets[0].schema[same].dataType))).drop(f"_{same}")
    return out


def precedence(rows: DataFrame, sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """The value of the first source that has one."""
    out = rows
    for k, source in enumerate(sources):
        out = out.join(source.select(key, F.col(value).alias(f"_{k}")), key, "left")
    names = [f"_{k}" for k in range(len(sources))]
    which = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(k)) for k, n in enumerate(names)])
    return out.withColumns({value: F.coalesce(*names), "source": which}).drop(*names)


def decoy_share(pairs: DataFrame, decoys: DataFrame) -> DataFrame:
    """(matches, decoys, chance): how many matches a join makes where none can be true, per true one."""
    m, d = pairs.agg(F.count("*").alias("matches")), decoys.agg(F.count("*").alias("decoys"))
    return m.join(d).withColumn("chance", F.col("decoys").cast("double") / F.nullif(F.col("matches").cast("double"), F.lit(0.0)))


def nearest_twin(rows: DataFrame, code: str, group: str, values: list[str], widths: list[float]) -> DataFrame:
    """(code, twin, distance): the nearest of another group, within `widths` on each value.

    Values are put on a grid of their widths; only rows of neighbouring cells of the first two meet.
    """
    cells = {f"_c{i}": F.floor(F.col(v) / w) for i, (v, w) in enumerate(zip(values[:2], widths[:2]))}
    left = rows.withColumns(cells)
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    right = rows.select(F.col(code).alias("twin"), F.col(group).alias("_group"), *[F.col(v).alias(f"_{v}") for v in values])
    for i, (v, w) in enumerate(zip(values[:2], widths[:2])):
        right = right.withColumn("_d", near).withColumn(f"_c{i}", F.floor(F.col(f"_{v}") / w) + F.col("_d")).drop("_d")
    met = left.join(right, list(cells)).where(F.col(group) != F.col("_group"))
    for v, w in zip(values, widths):
        met = met.where(F.abs(F.col(v) - F.col(f"_{v}")) <= w)
    distance = sum((((F.col(v) - F.col(f"_{v}")) / w) * ((F.col(v) - F.col(f"_{v}")) / w) for v, w in zip(values[1:], widths[1:])), ((F.col(values[0]) - F.col(f"_{values[0]}")) / widths[0]) * ((F.col(values[0]) - F.col(f"_{values[0]}")) / widths[0]))
    return best_of(met.select(F.col(code).alias("code"), "twin", distance.alias("distance")), ["code"], [F.asc("distance"), F.asc("twin")])


def shared_edges(segments: DataFrame) -> DataFrame:
    """(a, b, length) of units that share boundary segments; segments: unit, x1, y1, x2, y2, length.

    Ends are put in order, so that a segment and its reverse are one.
    """
    swap = F.struct("x1", "y1") > F.struct("x2", "y2")
    ends = [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(n) for n, a, b in (("p", "x1", "x2"), ("q", "y1", "y2"), ("r", "x2", "x1"), ("s", "y2", "y1"))]
    normal = segments.select("unit", *ends, "length").dropDuplicates(["unit", "p", "q", "r", "s"])
    other = normal.select(F.col("unit").alias("b"), "p", "q", "r", "s")
    pairs = normal.withColumnRenamed("unit", "a").join(other, ["p", "q", "r", "s"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.sum("length").alias("length"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def placed_under(leaves: DataFrame, parents: DataFrame, width: int, skip: int = 0) -> DataFrame:
    """Leaves (code, ...) with `parent`, the unit (code) whose digits after the first `skip` are the leaf's first `width`; null where none is.

    Codes are digits, padded on both sides. Of parents of equal digits the smallest counts.
    """
    keyed = parents.groupBy(F.substr(F.col("code"), F.lit(skip + 1)).alias("_key")).agg(F.min("code").alias("parent"))
    return leaves.withColumn("_key", F.substring("code", 1, width)).join(keyed, "_key", "left").drop("_key")


def placing_problems(placed: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(code, problem) of what `placed_under` gives: no parent, listed twice, and what the parents' own lists say otherwise.

    listed (parent, name, size): leaves by name as the parents' records have them; placed has name and size
    then. A leaf is not listed, or has another size, where no row of its name there has the same; null sizes are equal.
    """
    out = placed.where("parent is null").select("code", F.lit("no parent").alias("problem")).distinct()
    out = out.unionByName(placed.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code", F.lit("listed twice").alias("problem")))
    if listed is None:
        return out
    known = listed.select("parent", "name", F.col("size").alias("_size"), F.lit(True).alias("_there"))
    held = placed.where("parent is not null").join(known, ["parent", "name"], "left").groupBy("code", "parent", "name", "size").agg(F.bool_or("_there").alias("there"), F.bool_or(F.col("_size").eqNullSafe(F.col("size"))).alias("same"))
    wrong = F.when(F.col("there").isNull(), "not listed").when(~F.col("same"), "other size")
    return out.unionByName(held.select("code", wrong.alias("problem")).where("problem is not null").distinct())


def widest_gap(units: DataFrame, edges: DataFrame, figures: DataFrame, least: float, smallest: float = 0) -> DataFrame:
    """(code, neighbour, path, here, there, gap): where a unit and one that borders it are furthest apart, if by `least` or more.

    units: code, population, flagged (figures that can't be compared); edges: a, b, both ways; figures: code,
    path, value. Units under `smallest` people and flagged ones take no part. Gaps are rounded to one decimal; of
    equal ones the first path counts, then the first neighbour.
    """
    sound = units.where((F.col("population") >= smallest) & ~F.coalesce("flagged", F.lit(False))).select("code")
    values = figures.where("value is not null").join(sound, "code", "left_semi")
    here = values.select(F.col("code").alias("a"), "path", F.col("value").alias("here"))
    there = values.select(F.col("code").alias("b"), "path", F.col("value").alias("there"))
    apart = edges.select("a", "b").where("a <> b").join(here, "a").join(there, ["b", "path"]).withColumn("gap", F.floor(F.abs(F.col("here") - F.col("there")) * 10 + 0.5) / 10).where(F.col("gap") >= least)
    best = F.min(F.struct((-F.col("gap")).alias("by"), "path", F.col("b").alias("neighbour"), "here", "there", "gap")).alias("x")
    return apart.groupBy(F.col("a").alias("code")).agg(best).select("code", "x.neighbour", "x.path", "x.here", "x.there", "x.gap")
