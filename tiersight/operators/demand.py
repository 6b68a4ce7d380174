"""What is looked up: an event log rolled up into daily counts, rankings and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersight.operators.ranks import best_of

KEY = ["day", "kind", "text", "code", "name", "locale", "via", "bot"]
#: Days that raw rows are kept, times a text must be typed in a day to be kept, and times a place must be opened to be ranked.
KEPT_DAYS, TYPED, SHOWN_FROM, CATCH_UP = 90, 3, 5, 7


def daily_counts(events: DataFrame, typed: int = TYPED) -> DataFrame:
    """Counts of a day's events by KEY; a text is kept only if it names a place or was typed often enough that day.

    events: KEY and named. All else is counted under the empty text, so that no rare search is kept.
    """
    often = events.where("text <> ''").groupBy("day", "kind", "text").agg(F.max("named").alias("named"), F.count("*").alias("n"))
    kept = often.where(F.col("named") | (F.col("n") >= typed)).select("day", "kind", "text", F.lit(True).alias("kept"))
    marked = events.join(kept, ["day", "kind", "text"], "left")
    folded = marked.withColumn("text", F.when(F.col("kept").isNotNull(), F.col("text")).otherwise(""))
    return folded.groupBy(*KEY).agg(F.count("*").alias("n"))


def pruned(events: DataFrame, today: Column, days: int = KEPT_DAYS) -> DataFrame:
    """Events from the cut-off day on."""
    return events.where(F.col("day") >= F.date_sub(today, days))


def ranking(daily: DataFrame, since: Column, shown_from: int = SHOWN_FROM, most: int = 100) -> DataFrame:
    """The places that people opened most (a report of `most` rows)."""
    opened = daily.where((F.col("day") >= since) & (F.col("kind") == "place") & (F.col("via") == "browser") & ~F.col("bot"))
    counted = opened.groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= shown_from)
    return counted.orderBy(F.desc("n"), "code").limit(most)


def report(daily: DataFrame, by: str, where: Column, most: int = 25) -> DataFrame:
    """The most frequent values of one column (a report of `most` rows)."""
    return daily.where(where & (F.col(by).cast("string") != "")).groupBy(F.col(by).cast("string").alias("value")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def reports(daily: DataFrame, events: DataFrame, since: Column, most: int = 25) -> DataFrame:
    """(report, value, n): the seven reports on what was looked up since a day, `most` rows each but for where people came from.

    daily: KEY and n; events: KEY and results, the number of hits. Programs' rows count for tools and clients only.
    """
    kind, person = F.col("kind"), ~F.col("bot")
    recent, raw = daily.where(F.col("day") >= since), events.where(F.col("day") >= since).withColumn("n", F.lit(1))
    parts = {
        "places": (recent, "code", person & (kind == "place")),
        "searches": (recent, "text", person & (kind == "search")),
        "nothing found": (raw, "text", person & (kind == "search") & (F.col("results") == 0)),
        "tools": (recent, "name", kind == "tool"),
        "clients": (recent, "name", kind == "client"),
        "downloads": (recent, "code", person & (kind == "download")),
    }
    came = recent.where(person & kind.isin("place", "search", "download")).groupBy(F.col("via").alias("value")).agg(F.sum("n").alias("n"))
    out = came.select(F.lit("came from").alias("report"), "value", "n")
    for name, (table, by, where) in parts.items():
        out = out.unionAll(report(table, by, where, most).select(F.lit(name), "value", "n"))
    return out


def refresh(daily: DataFrame, path: str) -> None:
    """Write counts by day; a day that is written again is replaced as a whole, days not in `daily` stay."""
    daily.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def accepted(suggestions: DataFrame, known: DataFrame, farthest: float, votes: int = 2) -> DataFrame:
    """(place, name, spelling, votes): names that enough visitors gave, close enough, the best of each place.

    suggestions: place, name, spelling, visitor, day, distance; known: place, those that have a name.
    A visitor counts once for a name; the spelling is the earliest.
    """
    fresh = suggestions.join(known, "place", "left_anti").where(F.col("distance") <= farthest)
    counted = fresh.groupBy("place", "name").agg(
        F.count_distinct("visitor").alias("votes"), F.min("distance").alias("distance"), F.min_by("spelling", F.struct("day", "spelling")).alias("spelling")
    )
    best = best_of(counted.where(F.col("votes") >= votes), ["place"], [F.desc("votes"), F.asc("distance"), F.asc("name")])
    return best.select("place", "name", "spelling", "votes")


def limited(suggestions: DataFrame, most: int = 20) -> DataFrame:
    """A visitor's first suggestions of a day, each name once (a rate limit)."""
    once = best_of(suggestions, ["place", "name", "visitor"], [F.asc("day"), F.asc("spelling")])
    return best_of(once, ["visitor", "day"], [F.asc("place"), F.asc("name")], most)


def messages(bodies: DataFrame, most: int = 20) -> DataFrame:
    """(id, method, tool) of the first messages of JSON-RPC bodies, single or in batches."""
    kind = "array<struct<method:string,params:struct<name:string>>>"
    text = F.when(F.trim("body").startswith("["), F.col("body")).otherwise(F.concat(F.lit("["), "body", F.lit("]")))
    parsed = bodies.select("id", F.explode(F.slice(F.from_json(text, kind), 1, most)).alias("m"))
    return parsed.select("id", "m.method", F.col("m.params.name").alias("tool")).where("method is not null")
