"""Approximate search of names: an inverted index of trigrams, spellings by consonants, and tiers of matches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersight.functions import text as names
from tiersight.functions.numbers import half_up
from tiersight.operators.ranks import best_of
from tiersight.operators.stored import Stored

#: Scores of the tiers, fixed values.
EXACT, PREFIX, SPELLING, PLACE_EXACT, PLACE_PREFIX, PLACE_WORD = 1000.0, 500.0, 300.0, 950.0, 450.0, 250.0


@dataclass(frozen=True)
class Index:
    """entries: entry, level_rank, name, arabic, slug, grams (number of distinct ones); postings: gram, entry; skeletons: bones, entry; aliases: alias, entry."""

    entries: DataFrame
    postings: DataFrame
    skeletons: DataFrame
    aliases: DataFrame
    stored: Stored | None = None

    def part(self, table: str, keys: DataFrame) -> DataFrame:
        """A table's rows for keys; of a stored index only their buckets are read."""
        return self.stored.matching(table, keys) if self.stored else getattr(self, table)


def build_index(units: DataFrame, aliases: DataFrame | None = None, decompose: bool = True) -> Index:
    """Index of units (entry, level_rank, name, slug, and arabic, if they have names in a second script).

    Trigrams are those of all of an entry's names and its slug. An alias that is a unit's name, names
    none, or is claimed twice is refused; others are found by their consonants too.
    """
    second = F.coalesce("arabic", F.lit("")) if "arabic" in units.columns else F.lit("")
    entries = units.select("entry", "level_rank", names.normalise(F.col("name"), decompose).alias("name"), names.normalise(second, decompose).alias("arabic"), F.replace("slug", F.lit("-"), F.lit(" ")).alias("slug"))
    grams = F.array_distinct(F.concat(*[names.trigrams(F.col(c)) for c in ("name", "arabic", "slug")]))
    entries = entries.select("*", grams.alias("all"))
    postings = entries.select("entry", F.explode("all").alias("gram"))
    entries = entries.select("*", F.size("all").alias("grams")).drop("all")
    bones = lambda df, c: df.select(names.skeleton(F.col(c)).alias("bones"), "entry").where(F.length("bones") >= 2)
    if aliases is None:
        return Index(entries, postings, bones(entries, "name").distinct(), entries.select(F.col("name").alias("alias"), "entry").where("false"))
    folded = aliases.select(names.normalise(F.col("alias"), decompose).alias("alias"), "entry")
    known = folded.join(entries.select("entry"), "entry", "left_semi").join(entries.select(F.col("name").alias("alias")), "alias", "left_anti")
    once = known.groupBy("alias").agg(F.count_distinct("entry").alias("n"), F.min("entry").alias("entry")).where("n = 1").select("alias", "entry")
    return Index(entries, postings, bones(entries, "name").unionAll(bones(once, "alias")).distinct(), once)


def index_tables(index: Index) -> dict[str, tuple[DataFrame, str]]:
    """What `stored.write_version` takes of an index."""
    return {"entries": (index.entries, "entry"), "postings": (index.postings, "gram"), "skeletons": (index.skeletons, "bones"), "aliases": (index.aliases, "alias")}


def stored_index(found: Stored) -> Index:
    """The index that a version holds."""
    return Index(*(found.whole(t) for t in ("entries", "postings", "skeletons", "aliases")), found)


def _known(rows: DataFrame, entries: DataFrame, what: str) -> DataFrame:
    """Rows whose unit (entry) the index holds; another unit is an error."""
    held = rows.join(entries.select("entry", F.lit(True).alias("_held")), "entry", "left")
    strange = F.raise_error(F.concat(F.lit(f"{what} "), F.col(what), F.lit(" is placed in a unit that the index doesn't hold"))).cast("string")
    return held.withColumn(what, F.when(F.col("_held"), F.col(what)).otherwise(strange)).drop("_held")


def attached_places(index: Index, places: DataFrame, decompose: bool = True) -> DataFrame:
    """(key, place, entry): the folded names, other spellings too, that a place (place, entry, also) is searched by."""
    named = _known(places, index.entries, "place").select("place", "entry", F.explode(F.concat(F.array("place"), F.coalesce("also", F.array().cast("array<string>")))).alias("name"))
    return named.select(names.normalise(F.col("name"), decompose).alias("key"), "place", "entry").where("key <> ''").distinct()


def attached_postcodes(index: Index, postcodes: DataFrame, most: int = 4) -> DataFrame:
    """(postcode, entry, names): the units of a postcode with the first few names of each (postcode, entry, names)."""
    return _known(postcodes, index.entries, "postcode").select("postcode", "entry", F.slice("names", 1, most).alias("names"))


def _name_hits(index: Index, queries: DataFrame, decompose: bool) -> DataFrame:
    """(query, entry, level_rank, score, matched): all that queries find by units' names."""
    q = queries.select("query", names.normalise(F.col("query"), decompose).alias("q")).where("q <> ''").distinct()
    q = q.select("*", F.size(names.trigrams(F.col("q"))).alias("q_grams"), names.skeleton(F.col("q")).alias("bones"))
    asked = q.select("query", F.explode(F.array_distinct(names.trigrams(F.col("q")))).alias("gram"))
    overlap = asked.join(index.part("postings", asked), "gram").groupBy("query", "entry").agg(F.count("*").alias("overlap"))
    also = q.select("query", F.col("q").alias("alias"))
    alias = also.join(index.part("aliases", also), "alias").select("query", "entry", F.lit(True).alias("aliased"))
    heard = q.where(F.length("bones") >= 2).select("query", "bones")
    spelt = heard.join(index.part("skeletons", heard), "bones").select("query", "entry", F.lit(True).alias("spelt"))
    found = overlap.join(alias, ["query", "entry"], "full_outer").join(spelt, ["query", "entry"], "full_outer")
    hits = found.join(q, "query").join(index.entries, "entry")
    dice = F.lit(200.0) * F.coalesce("overlap", F.lit(0)) / (F.col("grams") + F.col("q_grams"))
    fields = [F.col(c) for c in ("name", "arabic", "slug")]
    field = F.coalesce(*[F.when(f.startswith(F.col("q")), f) for f in fields])
    over = F.length(field) - F.length("q")
    same = reduce(lambda x, y: x | y, [f == F.col("q") for f in fields])
    score = (
        F.when(same | F.col("aliased").isNotNull(), F.lit(EXACT))
        .when(field.isNotNull(), F.lit(PREFIX) - F.least(F.lit(PREFIX - 1), over.cast("double")))
        .when(F.col("spelt").isNotNull(), half_up(F.lit(SPELLING) + dice, 4))
        .otherwise(half_up(dice, 4))
    )
    matched = F.when(same, "exact").when(F.col("aliased").isNotNull(), "alias").when(field.isNotNull(), "prefix").when(F.col("spelt").isNotNull(), "spelling").otherwise("trigram")
    return hits.select("query", "entry", "level_rank", score.alias("score"), matched.alias("matched")).where("score > 0")


def search(index: Index, queries: DataFrame, limit: int = 10, decompose: bool = True) -> DataFrame:
    """(query, entry, score, matched, place): each query's best entries (queries: query).

    Exact names and aliases first, then prefixes less the letters over, then equal consonants, then
    the share of trigrams. The overlap counts distinct trigrams, its base all of them.
    """
    w = Window.partitionBy("query").orderBy(F.desc("score"), "level_rank", "entry")
    ranked = _name_hits(index, queries, decompose).withColumn("place", F.row_number().over(w))
    return ranked.where(F.col("place") <= limit).select("query", "entry", "score", "matched", "place")


def _place_hits(index: Index, queries: DataFrame, places: DataFrame, placed_level: int | None, decompose: bool) -> DataFrame:
    """(query, entry, level_rank, score, place_name): units that queries find by a place in them (places: key, place, entry)."""
    q = names.normalise(F.col("query"), decompose)
    asked = queries.select("query", q.alias("q"), F.substr(q, F.lit(1), F.lit(3)).alias("head")).where("length(q) >= 3").distinct()
    heads = F.transform(F.array_append(F.split("key", " "), F.col("key")), lambda w: F.substr(w, F.lit(1), F.lit(3)))
    met = places.select("key", "place", "entry", F.explode(F.array_distinct(heads)).alias("head")).join(asked, "head")
    bonus = F.when(F.col("level_rank") == placed_level, 1.0).otherwise(0.0) if placed_level is not None else F.lit(0.0)
    scored = met.join(index.entries.select("entry", "level_rank"), "entry").withColumn("score", place_score(F.col("q"), F.col("key")) + bonus)
    return scored.where("score is not null").select("query", "entry", "level_rank", "score", F.col("place").alias("place_name"))


def search_all(
    index: Index, queries: DataFrame, codes: DataFrame, places: DataFrame | None = None, postcodes: DataFrame | None = None, levels: list[int] | None = None, limit: int = 10,
    placed_level: int | None = None, decompose: bool = True,
) -> DataFrame:
    """(query, entry, score, matched, place_name, names, place): names, places in units, codes and postcodes at once.

    codes: code, digits, entry; places and postcodes as attached to the index. A query of digits and dots is
    a code: it finds the units of that code, by level and entry, then those of a postcode of five digits with
    the names it covers, and nothing by name. Others find a unit once, by its own name or the place nearest
    to the query, place_name; places of units of `placed_level` go before those matched as well. `levels`:
    the level_ranks to find. A null query finds nothing.
    """
    digits = F.trim("query").rlike(r"^[0-9][0-9.]*$")
    spelt, numbers = queries.where(~digits), queries.where(digits).select("query").distinct()
    none, few = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    hits = _name_hits(index, spelt, decompose).withColumn("place_name", none)
    if places is not None:
        by_place = _place_hits(index, spelt, places, placed_level, decompose).withColumn("matched", F.lit("place"))
        hits = hits.unionByName(by_place)
    best = F.min(F.struct(-F.col("score"), F.coalesce("place_name", F.lit("")), "place_name", "matched", "score", "level_rank")).alias("b")
    hits = hits.groupBy("query", "entry").agg(best).select("query", "entry", "b.score", "b.matched", "b.place_name", few.alias("names"), "b.level_rank")
    level = index.entries.select("entry", "level_rank")
    found = by_code(codes, numbers).join(codes.select("code", "entry"), "code").select("query", "entry").distinct().join(level, "entry")
    hits = hits.unionByName(found.select("query", "entry", F.lit(EXACT).alias("score"), F.lit("code").alias("matched"), none.alias("place_name"), few.alias("names"), "level_rank"))
    if postcodes is not None:
        five = numbers.select("query", F.trim("query").alias("postcode")).where(F.length("postcode") == 5)
        found = five.join(postcodes, "postcode").join(level, "entry")
        hits = hits.unionByName(found.select("query", "entry", F.lit(EXACT).alias("score"), F.lit("postcode").alias("matched"), none.alias("place_name"), "names", "level_rank"))
    if levels is not None:
        hits = hits.where(F.col("level_rank").isin(levels))
    late = F.col("matched") == "postcode"
    w = Window.partitionBy("query").orderBy(F.desc("score"), late, F.when(~late, F.col("level_rank")), "entry")
    ranked = hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return ranked.select("query", "entry", "score", "matched", "place_name", "names", "place")


def by_code(codes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, code): dotted, padded and bare forms of a code (codes: code, digits)."""
    raw = F.trim("query")
    asked = queries.where(raw.rlike(r"^[0-9][0-9.]*$")).select("query", raw.alias("raw"), F.when(~raw.contains("."), F.regexp_replace(raw, "^0+", "")).alias("bare"))
    dotted = asked.join(codes, F.col("raw") == F.col("code")).select("query", "code")
    bare = asked.join(codes.withColumn("bare", F.regexp_replace("digits", "^0+", "")), "bare").select("query", "code")
    return dotted.union(bare).distinct()


def place_score(q: Column, place: Column) -> Column:
    """A neighbourhood's name: itself, its beginning, or a word's beginning; null for none. Needs three letters."""
    over = (F.length(place) - F.length(q)).cast("double")
    word = ~q.contains(" ") & F.exists(F.split(place, " "), lambda w: w.startswith(q))
    score = (
        F.when(place == q, F.lit(PLACE_EXACT))
        .when(place.startswith(q), F.lit(PLACE_PREFIX) - F.least(F.lit(PLACE_PREFIX - PLACE_WORD - 1), over))
        .when(word, F.lit(PLACE_WORD) - F.least(F.lit(PLACE_WORD - SPELLING / 3 - 1), over))
    )
    return F.when(F.length(q) >= 3, score)


def _starts(s: Column) -> Column:
    """All runs of one to three characters of a text, by which any text inside it is found."""
    n = F.length(s)

    def of(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(k)))

    runs = [of(k) for k in (1, 2, 3)]
    return F.array_distinct(F.concat(*runs))


def _sounded(s: Column) -> Column:
    """ou as w, spaces left out."""
    return F.replace(F.replace(s, F.lit(" "), F.lit("")), F.lit("ou"), F.lit("w"))


@dataclass(frozen=True)
class VillageIndex:
    """entries: code, latin, people; runs: run, script, code, name (runs of one to three letters of either name); begins: begin, code, key."""

    entries: DataFrame
    runs: DataFrame
    begins: DataFrame
    stored: Stored | None = None

    def part(self, table: str, keys: DataFrame) -> DataFrame:
        return self.stored.matching(table, keys) if self.stored else getattr(self, table)


def village_index(entries: DataFrame) -> VillageIndex:
    """Index of villages (code, arabic, latin (folded names), keys (array), people)."""
    inside = lambda name: entries.select("code", F.lit(name).alias("script"), F.col(name).alias("name"), F.explode(_starts(F.col(name))).alias("run"))
    begins = F.array_append(F.transform(F.sequence(F.lit(2), F.greatest(F.length("key"), F.lit(2))), lambda i: F.substr("key", F.lit(1), i)), F.col("key"))
    keyed = entries.select("code", F.explode("keys").alias("key")).where("key <> ''").select("code", "key", F.explode(F.array_distinct(begins)).alias("begin"))
    return VillageIndex(entries.select("code", "latin", "people"), inside("arabic").unionAll(inside("latin")), keyed)


def village_tables(index: VillageIndex) -> dict[str, tuple[DataFrame, str]]:
    return {"entries": (index.entries, "code"), "runs": (index.runs, "run"), "begins": (index.begins, "begin")}


def stored_villages(found: Stored) -> VillageIndex:
    return VillageIndex(*(found.whole(t) for t in ("entries", "runs", "begins")), found)


def villages(index: VillageIndex | DataFrame, queries: DataFrame, limit: int = 10, close: float = 0.34) -> DataFrame:
    """(query, code, rank, near, total, place): villages that queries find, best first.

    index: of villages, or the table it is made of (`village_index`); queries: query (folded), keys.
    Arabic: 0 at the name's beginning, 1 at a word's, 2 inside. Latin: 0 for an equal key, 1 for a
    key's beginning (two letters), 2 for letters inside the name (three); where spellings are close,
    before all others. Then the nearer spelling, the more people, the code.
    """
    index = village_index(index) if isinstance(index, DataFrame) else index
    asked = queries.where(F.col("query") != "").withColumn("script", F.when(F.col("query").rlike(r"\p{IsArabic}"), "arabic").otherwise("latin"))
    head = asked.where("script = 'arabic' or length(query) >= 3").select("query", "script", F.substring("query", 1, 3).alias("run"))
    at = F.instr("name", F.col("query"))
    base = F.when(F.col("script") == "latin", 2).when(at == 1, 0).when(F.substr("name", at - 1, F.lit(1)) == " ", 1).otherwise(2)
    inside = index.part("runs", head).join(head, ["run", "script"]).where(at > 0).select("query", "code", base.alias("base"))
    wanted = asked.where("script = 'latin'").select("query", F.explode("keys").alias("begin")).where("begin <> ''")
    keyed = index.part("begins", wanted).join(wanted, "begin").select("query", "code", F.when(F.col("key") == F.col("begin"), 0).otherwise(1).alias("base"))
    hits = inside.unionAll(keyed).groupBy("query", "code").agg(F.min("base").alias("base"))
    hits = hits.join(index.entries, "code").join(asked.select("query", "script").distinct(), "query")
    near = F.when(F.col("script") == "latin", names.letters_apart_share(_sounded(F.col("query")), _sounded(F.col("latin"))))
    rank = F.when(near <= close, F.least("base", F.lit(0)) - 1).otherwise(F.col("base"))
    ranked = hits.withColumns({"near": near, "rank": rank})
    total = ranked.groupBy("query").agg(F.count("*").alias("total"))
    w = Window.partitionBy("query").orderBy("rank", F.coalesce("near", F.lit(0.0)), F.desc("people"), "code")
    best = ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return best.join(total, "query").select("query", "code", "rank", "near", "total", "place")


#: A unit's name has about so many runs of letters; up to so many queries are held against each unit without them.
DIRECT = 64


def picked(units: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """(query, code, tier, place): units for a picker, the larger first within a tier.

    units: code, name, arabic (folded), bones, people; queries: query (folded), bones. Tiers: the whole
    name, its beginning, a word's beginning, equal first consonants (two or more), inside (three letters).
    """
    asked = queries.where(F.col("query") != "").groupBy("query").agg(F.collect_set("bones").alias("asked_bones"))
    q = F.col("query")
    # a word begins after a space or with the name, and has no space
    word = lambda c: ~q.contains(" ") & F.concat(F.lit(" "), c).contains(F.concat(F.lit(" "), q))
    either = lambda test: F.coalesce(test(F.col("name")), F.lit(False)) | F.coalesce(test(F.col("arabic")), F.lit(False))
    inside = (F.length(q) >= 3) & either(lambda c: c.contains(q))
    tier = lambda heard: F.when(either(lambda c: c == q), 0).when(either(lambda c: c.startswith(q)), 1).when(either(word), 2).when(heard, 3).when(inside, 4)
    best = lambda hits: best_of(hits.select("query", "code", "tier", "people").where("tier is not null"), ["query"], [F.asc("tier"), F.desc("people"), F.asc("code")], limit)
    if asked.limit(DIRECT + 1).count() <= DIRECT:
        heard = F.exists("asked_bones", lambda b: (F.length(b) >= 2) & F.col("bones").startswith(b))
        # a file of few megabytes is one task's, though each of its rows meets all queries
        dealt = units.repartition(units.sparkSession.sparkContext.defaultParallelism)
        hits = best(dealt.crossJoin(F.broadcast(asked)).withColumn("tier", tier(F.coalesce(heard, F.lit(False)))))
    else:
        runs = F.array_distinct(F.concat(_starts(F.coalesce("name", F.lit(""))), _starts(F.coalesce("arabic", F.lit("")))))
        spelt = units.select("code", "name", "arabic", "people", F.explode(runs).alias("run")).join(asked.select("query", F.substring("query", 1, 3).alias("run")), "run")
        begins = F.transform(F.sequence(F.lit(2), F.greatest(F.length("bones"), F.lit(2))), lambda i: F.substr("bones", F.lit(1), i))
        heard = units.where(F.length("bones") >= 2).select("code", "people", F.explode(begins).alias("bones")).join(asked.select("query", F.explode("asked_bones").alias("bones")).where(F.length("bones") >= 2), "bones")
        # what is before a unit in one of the two is before it in both together, so that no more of either counts
        both = best(spelt.withColumn("tier", tier(F.lit(False)))).unionAll(best(heard.dropDuplicates(["query", "code"]).withColumn("tier", F.lit(3))))
        hits = best(both.groupBy("query", "code").agg(F.min("tier").alias("tier"), F.first("people").alias("people")))
    place = F.row_number().over(Window.partitionBy("query").orderBy("tier", F.desc("people"), "code"))
    return hits.select("query", "code", "tier", place.alias("place"))
