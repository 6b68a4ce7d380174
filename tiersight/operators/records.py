"""Records of units: what applies, what is withheld, sub-cubes, and how two tables of them meet."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiersight.functions.geo import haversine
from tiersight.operators.graph import components
from tiersight.operators.matching import mutual_best

#: Words that say a unit's level in front of its name, and what links them to it; fixed values.
LEVELS = "Communes?|Arrondissements?|Cercles?|Provinces?|Préfectures?|Régions?"
LEVELS_AR = "جهة|عمالة|إقليم|دائرة|جماعة|مقاطعات|مقاطعة"
LINKS = r"de\s+la\s+|de\s+l['’]\s*|de\s+|du\s+|des\s+|d['’]\s*"
LABEL = rf"(?iu)^(?:(?:{LEVELS})\s+(?:{LINKS})?)+"
LABEL_AR = rf"^(?:(?:{LEVELS_AR})\s+)+"


def _without(name: Column, label: str) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(name, r"\*+$", "")), label, ""))


def stripped_label(name: Column) -> Column:
    """A name without its footnote marks and the labels in front of it, however many; a label ends in a blank."""
    return _without(name, LABEL)


def stripped_label_ar(name: Column) -> Column:
    return _without(name, LABEL_AR)


def by_path(people: Column, homes: Column, path: str) -> Column:
    """The value at topic.key; homes only where people has no such topic, so a null under one of its topics stays null."""
    topic, _, key = path.partition(".")
    return F.when(people[topic].isNotNull(), people[topic][key]).otherwise(homes[topic][key])


def sub_cube(facts: DataFrame, topics: list[str] | None = None, areas: list[str] | None = None, sexes: list[str] | None = None, periods: list[str] | None = None) -> DataFrame:
    """Facts (code, path, area, sex, period, value) of some topics, areas, sexes and periods; households have no sex."""
    for column, wanted in ((F.substring_index("path", ".", 1), topics), (F.col("area"), areas), (F.col("period"), periods)):
        if wanted is not None:
            facts = facts.where(column.isin(wanted))
    return facts if sexes is None else facts.where(F.col("sex").isNull() | F.col("sex").isin(sexes))


def at_level(units: DataFrame, level: str | None = None, code: str | None = None) -> DataFrame:
    """One unit, all of a level, or the country."""
    if code is not None:
        return units.where(F.col("code") == code)
    return units.where(F.col("level") == (level or "country"))


def applicable(facts: DataFrame, by: list[str]) -> DataFrame:
    """Blocks of which any cell applies; a block of cells marked `n/a` throughout goes (reason column)."""
    applies = F.bool_or(F.col("reason").isNull() | (F.col("reason") != "n/a")).over(Window.partitionBy(*by))
    return facts.withColumn("_a", applies).where("_a").drop("_a")


def withheld(values: list[Column]) -> Column:
    """Whether a record's values are all missing."""
    return F.forall(F.array(*values), lambda v: v.isNull())


def ordinary(population: Column, households: Column) -> Column:
    """Enough households, and not so many people in each that most live elsewhere."""
    return F.coalesce((households >= 300) & (population <= households * 8), F.lit(False))


def rateable(before: Column, percent: Column) -> Column:
    return F.coalesce((before >= 500) & (F.abs(percent) <= 500), F.lit(False))


def sampled(measure: Column, households: Column) -> Column:
    """Whether a figure is an estimate: of the census, where the long form went to a sample."""
    return F.coalesce(~measure.startswith("economy.") & ~measure.startswith("housing.") & (households >= 2000), F.lit(False))


def comparison_matrix(facts: DataFrame, units: DataFrame, flags: DataFrame, measures: list[str]) -> tuple[DataFrame, DataFrame]:
    """Ordinary units by measures, flagged figures blanked; and those left out, with why.

    facts: code, measure, value; units: code, population, households; flags: code, measure.
    """
    few, odd = F.coalesce(F.col("households") < 300, F.lit(True)), F.col("population") > F.col("households") * 8
    judged = units.withColumn("reason", F.when(few, "few").when(odd, "special"))
    clean = facts.join(flags.withColumn("flagged", F.lit(True)), ["code", "measure"], "left").withColumn("value", F.when(F.col("flagged").isNull(), F.col("value")))
    matrix = clean.join(judged.where("reason is null").select("code"), "code").groupBy("code").pivot("measure", measures).agg(F.first("value"))
    return matrix, judged.where("reason is not null").select("code", "reason")


def matched_both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right joined on a key; fails where either has one that the other hasn't."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), key, "full_outer")
    lost = F.concat(F.lit("no match for "), F.col(key).cast("string"))
    kind = both.schema[key].dataType
    fine = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.withColumn(key, F.when(fine, F.col(key)).otherwise(F.raise_error(lost).cast(kind))).drop("_l", "_r")


def total_near(parts: list[Column], counted: Column, slack: float = 0.5) -> Column:
    """Whether shares add up to 100 where anyone was counted."""
    total = sum(parts[1:], parts[0])
    return (counted == 0) | (F.abs(total - 100) <= slack)


def second_pass(pairs: DataFrame, matched: DataFrame, reach_km: float = 3.0, least: float = 0.7) -> DataFrame:
    """Mutual best pairs near what the first pass matched in the same group.

    pairs: left, right, grp, score, lat, lng (of the right); matched: left, right, grp, lat, lng. Sides that
    are matched take no part; a right must be within reach of a matched one of its group.
    """
    free = pairs.join(matched.select("left"), "left", "left_anti").join(matched.select("right"), "right", "left_anti").where(F.col("score") >= least)
    placed = matched.select("grp", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    spots = free.select("right", "grp", "lat", "lng").distinct().join(placed, "grp")
    near = spots.groupBy("right", "grp").agg(F.min(haversine(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))).alias("km")).where(F.col("km") <= reach_km)
    joined = free.join(near, ["right", "grp"]).withColumn("_order", F.col("score") - F.col("km") / 1e6)
    return mutual_best(joined, "left", "right", "_order").select("left", "right", "score", "km")


def visitor_keys(addresses: Column, day: Column, secret: bytes) -> Column:
    """A visitor's key of a day, which can't be turned back without the secret; the secret isn't part of the plan."""

    @F.pandas_udf(T.StringType())
    def keyed(text: pd.Series) -> pd.Series:
        return text.map(lambda s: None if s is None else hmac.new(secret, s.encode(), hashlib.sha256).hexdigest()[:32])

    return keyed(F.concat_ws("|", day.cast("string"), addresses))


def outline_parts(edges: DataFrame) -> DataFrame:
    """(grp, ring, sides, west, south, east, north, outline): the connected outlines of groups of units.

    edges: grp, p, q, r, s, sides that no two units of a group share. The outline with the largest box is
    the group's own; others inside its box are holes in its coverage, others outside are islands.
    """
    ends = edges.withColumns({"a": F.concat_ws(":", "grp", "p", "q"), "b": F.concat_ws(":", "grp", "r", "s")})
    sided = ends.join(components(ends.select("a", "b")).withColumnRenamed("node", "a"), "a")
    boxes = sided.groupBy("grp", F.col("component").alias("ring")).agg(
        F.count("*").alias("sides"), F.min(F.least("p", "r")).alias("west"), F.min(F.least("q", "s")).alias("south"), F.max(F.greatest("p", "r")).alias("east"), F.max(F.greatest("q", "s")).alias("north")
    )
    area = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    first = F.row_number().over(Window.partitionBy("grp").orderBy(area.desc(), "ring"))
    return boxes.withColumn("outline", first == 1)


def coverage_holes(edges: DataFrame) -> DataFrame:
    """(grp, ring, sides, west, south, east, north) of the holes in groups' coverage."""
    parts = outline_parts(edges)
    own = parts.where("outline").select("grp", *[F.col(c).alias(f"_{c}") for c in ("west", "south", "east", "north")])
    inside = (F.col("west") >= F.col("_west")) & (F.col("south") >= F.col("_south")) & (F.col("east") <= F.col("_east")) & (F.col("north") <= F.col("_north"))
    return parts.where("not outline").join(own, "grp").where(inside).select("grp", "ring", "sides", "west", "south", "east", "north")


def group_of(rows: DataFrame, groups: DataFrame, key: str, value: object, figures: list[str] | None = None) -> DataFrame:
    """The rows of one group, with some figures or all; a group that isn't there is an error, one without rows isn't."""
    if groups.where(F.col(key) == F.lit(value)).isEmpty():
        raise ValueError(f"no {key} {value}")
    found = rows.where(F.col(key) == F.lit(value))
    return found if figures is None else found.select(*[c for c in rows.columns if c in ("code", "name", key)], *figures)


def inherited_names(unnamed: DataFrame, named: DataFrame, place: str, key: str, value: str, order: str) -> DataFrame:
    """`unnamed` with the value of the first of `named` (by order) in the same place under the same key."""
    first = named.where(F.col(value).isNotNull()).groupBy(place, key).agg(F.min_by(value, order).alias(value))
    return unnamed.join(first, [place, key], "left")


def bare_arabic(normalised: Column) -> Column:
    """A folded Arabic name without spaces and article, if two letters or more are left."""
    return F.regexp_replace(F.replace(normalised, F.lit(" "), F.lit("")), "^ال(?=..)", "")


def postcodes(named: DataFrame, localities: DataFrame, provinces: DataFrame, units: DataFrame) -> DataFrame:
    """(postcode, code, names): which units a postcode is of, with the names it is written for.

    named: postcode, code, name; localities: postcode, province, locality, which is looked up by name
    among the provinces (code, name) and then among the province's units (code, province, name).
    Postcodes have five digits; names that are none or several of their place give nothing.
    """
    once = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n"), F.first("code").alias("code")).where("n = 1").drop("n")
    inside = localities.join(once(provinces, "name").select(F.col("name").alias("province"), F.col("code").alias("p")), "province")
    own = once(units, "province", "name").select(F.col("province").alias("p"), F.col("name").alias("locality"), "code")
    placed = inside.join(own, ["p", "locality"]).select("postcode", "code", F.lit(None).cast("string").alias("name"))
    both = named.select("postcode", "code", "name").unionAll(placed).where(F.col("postcode").rlike(r"^\d{5}$"))
    return both.groupBy("postcode", "code").agg(F.sort_array(F.collect_set("name")).alias("names"))


def mean_changes(facts: DataFrame) -> DataFrame:
    """(level, measure, change): the mean change of units that have both figures, those matched by a crosswalk left out.

    facts: level, basis, measure, before, after (decimals or whole numbers).
    """
    fine = facts.where("before is not null and after is not null and (basis is null or basis <> 'crosswalk')")
    sums = fine.groupBy("level", "measure").agg(F.sum(F.col("after") - F.col("before")).cast("double").alias("s"), F.count("*").alias("n"))
    return sums.select("level", "measure", (F.col("s") / F.col("n").cast("double")).alias("change"))
