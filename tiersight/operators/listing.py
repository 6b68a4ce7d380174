"""Lists of units: conjunctive filters, sorting by any record key or metric, and pages."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORD_KEYS = {"code", "name", "population", "change", "density", "area"}
PATH = re.compile(r"^(-?)(?:(2014|change|economy)\.)?([A-Za-z]\w*)\.([\w+-]+)$")


@dataclass(frozen=True)
class Sort:
    """What a list is sorted by: a record's key, or a metric's path of one period, change or kind."""

    descending: bool
    kind: str  # record, now, before, change or economy
    key: str


def sort_of(text: str, paths: set[str], comparable: set[str] = frozenset()) -> Sort:
    """`[-][2014.|change.|economy.]topic.key` or a record's key; raises ValueError that says what is wrong."""
    down, bare = text.startswith("-"), text.removeprefix("-")
    if bare in RECORD_KEYS:
        return Sort(down, "record", bare)
    found = PATH.match(text)
    if not found:
        raise ValueError(f"sort is a record key ({', '.join(sorted(RECORD_KEYS))}) or a path such as labour.rate, not {text!r}")
    kind, path = {None: "now", "2014": "before"}.get(found[2], found[2]), f"{found[3]}.{found[4]}"
    if path not in paths:
        raise ValueError(f"no metric {path!r}")
    if kind == "change" and path not in comparable:
        raise ValueError(f"{path!r} was asked differently before, so it has no change")
    return Sort(down, kind, path)


def page_of(number: int | str, last: int = 10_000) -> int:
    n = int(number)
    if not 1 <= n <= last:
        raise ValueError(f"page is 1 to {last}")
    return n


def filtered(units: DataFrame, equal: dict[str, object], least: float | None = None, most: float | None = None, size: str = "population") -> DataFrame:
    """Units that meet every condition; a null size meets no bound."""
    if least is not None and most is not None and least > most:
        raise ValueError("the least size is over the most")
    for name, value in equal.items():
        units = units.where(F.col(name) == value)
    if least is not None:
        units = units.where(F.col(size) >= least)
    return units if most is None else units.where(F.col(size) <= most)


def order_by(value: Column, descending: bool, tie: Column) -> list[Column]:
    """Nulls last in both directions, ties by code."""
    return [value.desc_nulls_last() if descending else value.asc_nulls_last(), tie.asc()]


def paged(rows: DataFrame, order: list[Column], page: int, size: int = 50) -> DataFrame:
    """One page; the only rows that are sorted as a whole are those of the first pages."""
    return rows.orderBy(*order).limit(page * size).orderBy(*order).offset((page - 1) * size)


def page_meta(rows: DataFrame, page: int, size: int = 50) -> DataFrame:
    """(total, pages, page, previous, next); an empty list has one page."""
    n = F.count("*")
    pages = F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("long")
    counted = rows.agg(n.alias("total"), pages.alias("pages")).withColumn("page", F.lit(page).cast("long"))
    return counted.select(
        "total", "pages", "page",
        F.when((F.col("page") > 1) & (F.col("page") <= F.col("pages") + 1), F.col("page") - 1).alias("previous"),
        F.when(F.col("page") < F.col("pages"), F.col("page") + 1).alias("next"),
    )


def with_metric(units: DataFrame, facts: DataFrame, sort: Sort) -> DataFrame:
    """Units with the value that they are sorted by; facts: code, period (now, before, economy), path, value."""
    at = lambda period: facts.where((F.col("period") == period) & (F.col("path") == sort.key)).select("code", F.col("value").alias(f"v_{period}"))
    if sort.kind == "change":
        both = units.join(at("now"), "code", "left").join(at("before"), "code", "left")
        return both.withColumn("value", F.floor((F.col("v_now") - F.col("v_before")) * 100 + 0.5) / 100).drop("v_now", "v_before")
    period = sort.kind
    return units.join(at(period), "code", "left").withColumnRenamed(f"v_{period}", "value")


def resolved(ids: DataFrame, aliases: DataFrame, level: str | None = None) -> DataFrame:
    """(id, code, level, status) of identifiers: codes, padded or bare digits, and slugs.

    aliases: alias, level, code, prio. The wanted level's claim comes first, then the least prio;
    status is found, absent (well-formed) or malformed.
    """
    wanted = (F.col("level") != level).cast("int") if level else F.lit(0)
    first = Window.partitionBy("id").orderBy(wanted, F.col("prio"), F.col("code"))
    joined = ids.join(aliases, F.lower(F.trim("id")) == F.col("alias"), "left")
    best = joined.withColumn("k", F.row_number().over(first)).where("k = 1")
    sound = F.trim("id").rlike(r"^[0-9a-zA-Z][0-9a-zA-Z.-]*$")
    return best.select("id", "code", "level", F.when(F.col("code").isNotNull(), "found").when(sound, "absent").otherwise("malformed").alias("status"))


def alias_rows(units: DataFrame) -> DataFrame:
    """(alias, level, code, prio) of units (code, digits, slug, level): what each can be called."""
    bare = F.regexp_replace("digits", "^0+", "")
    names = F.array(
        F.struct(F.col("code").alias("alias"), F.lit(0).alias("prio")), F.struct(F.col("digits").alias("alias"), F.lit(1).alias("prio")),
        F.struct(bare.alias("alias"), F.lit(2).alias("prio")), F.struct(F.lower("slug").alias("alias"), F.lit(3).alias("prio")),
    )
    return units.select("level", "code", F.explode(F.array_distinct(names)).alias("n")).select("n.alias", "level", "code", "n.prio").where("alias <> ''")
