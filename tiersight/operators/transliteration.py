"""Names written in the other script: words of a table first, then a learned model, then letter rules.

A name is cut into pieces, pieces into words, and each distinct word is spelled once; tables meet words in
joins, so that they may be of any size. The rules of a letter look at the letters beside it only, so they
are one expression over a word's letters.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiersight.functions.scripts import arabic_keys, keys_meet, latin_keys
from tiersight.functions.text import ARTICLES, normalise, stripped
from tiersight.operators.spellings import spelled
from tiersight.operators.staging import stage

# Letters, and words that are translated.
LATIN = {
    "ب": "b", "پ": "p", "ت": "t", "ث": "t", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "d", "ر": "r",
    "ز": "z", "س": "s", "ش": "ch", "ص": "s", "ض": "d", "ط": "t", "ظ": "d", "غ": "gh", "ف": "f", "ڤ": "v",
    "ق": "k", "ك": "k", "ݣ": "g", "ڭ": "g", "گ": "g", "ک": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "ء": "",
}
SUN = list("تثدذرزسشصضطظلن")
VOWELS = list("اأإآوييىةؤئ")
ARABIC = {
    "b": "ب", "t": "ت", "d": "د", "j": "ج", "h": "ح", "r": "ر", "z": "ز", "s": "س", "c": "ك", "f": "ف", "k": "ك", "q": "ق", "g": "ك",
    "l": "ل", "m": "م", "n": "ن", "w": "و", "y": "ي", "p": "ب", "v": "ف", "x": "كس", "a": "ا", "i": "ي", "o": "و", "u": "و", "e": "",
}
ARABIC_GROUPS = {"ch": "ش", "sh": "ش", "kh": "خ", "gh": "غ", "rh": "غ", "th": "ت", "dh": "ض", "ou": "و", "aa": "اع"}
TRANSLATED = {
    "المركز": "Centre", "مركز": "Centre", "سابقا": "ex", "كلم": "Km", "دوار": "Douar",
    "قرية الصيد": "Village de pêche", "معبر الحدود": "Poste frontière", "محطة القطار": "Gare",
    "تعاونية": "Coopérative", "التعاونية": "Coopérative", "تعاونيات": "Coopératives", "التعاونية الفلاحية": "Coopérative agricole",
    "ضيعة": "Ferme", "الضيعة": "Ferme", "الضيعة الفلاحية": "Ferme", "مزرعة": "Ferme", "المزرعة": "Ferme",
    "تجزئة": "Lotissement", "إقامة": "Résidence", "ميناء": "Port", "الميناء": "Port",
    "الثكنة": "Caserne", "الثكنة العسكرية": "Caserne", "ثكنة مخزن": "Caserne Makhzen", "موبيل": "Mobile",
    "سد": "Barrage", "السد": "Barrage", "محمد الخامس": "Mohammed V", "منجم": "Mine", "المنجم": "Mine",
    "منطقة": "Zone", "المنطقة": "Zone", "المنطقة الصناعية": "Zone industrielle",
    "مدرسة": "École", "المدرسة": "École", "المدرسة العتيقة": "École traditionnelle", "المدرسة الفلاحية": "École d'agriculture",
    "المدرسة الوطنية الفلاحية": "École nationale d'agriculture", "للمدرسة الوطنية الفلاحية": "de l'École nationale d'agriculture",
    "المجمع السكني": "Complexe résidentiel", "معمل السكر": "Sucrerie", "قرية معمل السكر": "Village de la sucrerie",
    "اوراش تحلية مياه البحر": "Chantier de dessalement d'eau de mer",
}
KEEP_PLACE = ["Centre", "Douar", "ex", "Km", "Mobile", "Mohammed V"]
FORMERLY = ["سابقا", "سابقاً"]
DIGITS = "٠١٢٣٤٥٦٧٨٩"
GAP_SEEN, GAP_SHARE = 4, 0.4

SPACE = r"\s \-–"
LONGEST = max(len(k.split()) for k in TRANSLATED)


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def capital(text: Column) -> Column:
    """Each word with a capital, the rest as it is."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def words_of(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(f"[^{SPACE}]+"), F.lit(0))


def latin_words_of(name: Column) -> Column:
    """A Latin name's words, an article written apart with the word after it."""
    return F.regexp_extract_all(name, F.lit(f"(?i)(?:{'|'.join(ARTICLES)})[{SPACE}]+[^{SPACE}]+|[^{SPACE}]+"), F.lit(0))


def without_ayn(latin: Column, arabic: Column) -> Column:
    """A Latin word without the marks that lists write for ayn: those before a word or after a vowel, and, where the Arabic has ayn, all but typed ones and the n' and d' that join words."""
    marks = "’‘`ʿ"
    out = F.regexp_replace(latin, rf"(?<![^{SPACE}])['{marks}]+", "")
    out = F.regexp_replace(out, rf"(?i)(?<=[aeiouàâäéèêëîïôöûü])[{marks}]+", "")
    return F.when(arabic.contains("ع"), F.regexp_replace(out, rf"(?i)(?<!(?<![^{SPACE}])[nd])[{marks}]", "")).otherwise(out)


def word_pairs(names: DataFrame) -> DataFrame:
    """(arabic, latin, n): words that names in both scripts (fr, ar) write for each other, and how often.

    Names of as many words are lined up as they are. Where the Arabic has one more, abd and the word after it are
    taken as one, if there is one way to do so in which the keys of all words meet. Words with digits and
    words whose keys don't meet are left out.
    """
    rows = names.where("fr is not null and ar is not null").groupBy("fr", "ar").agg(F.count("*").alias("n")).withColumns({"f": latin_words_of(F.col("fr")), "a": words_of(F.col("ar"))})
    same = rows.where("size(a) = size(f)").select("fr", "ar", "n", "f", F.lit(-1).alias("way"), "a")
    abd = F.filter(F.transform("a", lambda w, i: F.when((F.regexp_replace(w, "[ً-ْٰـ]", "") == "عبد") & (i < F.size("a") - 1), i)), lambda i: i.isNotNull())
    longer = rows.where("size(a) = size(f) + 1").select("fr", "ar", "n", "f", F.explode(abd).alias("way"), "a")
    at = F.col("way")
    joined = F.concat(F.slice("a", F.lit(1), at), F.array(F.concat_ws(" ", F.get("a", at), F.get("a", at + 1))), F.slice("a", at + 3, F.size("a")))
    longer = longer.withColumn("a", joined)
    each = same.unionByName(longer).select("fr", "ar", "n", "way", F.inline(F.arrays_zip("a", "f"))).toDF("fr", "ar", "n", "way", "arabic", "latin")
    met = stage(each.withColumn("meet", keys_meet(arabic_keys(F.col("arabic")), latin_keys(F.col("latin")))))
    good = met.where("way >= 0").groupBy("fr", "ar", "way").agg(F.bool_and("meet").alias("good")).where("good").groupBy("fr", "ar").agg(F.count("*").alias("ways"), F.min("way").alias("way")).where("ways = 1").drop("ways")
    kept = met.where("way < 0").unionByName(met.join(good, ["fr", "ar", "way"], "left_semi")).where(F.col("meet") & ~F.concat("arabic", "latin").rlike(r"\p{Nd}"))
    return kept.groupBy("arabic", without_ayn(F.col("latin"), F.col("arabic")).alias("latin")).agg(F.sum("n").alias("n"))


def word_table(pairs: DataFrame, to_latin: bool = True) -> DataFrame:
    """(arabic, latin) of `word_pairs`: for each word of one script, as it folds, what the other writes for it most often; of equals the first in order."""
    source, target = ("arabic", "latin") if to_latin else ("latin", "arabic")
    counted = pairs.groupBy(normalise(F.col(source)).alias(source), target).agg(F.sum("n").alias("n")).where(f"{source} <> ''")
    return counted.groupBy(source).agg(F.min(F.struct((-F.col("n")).alias("by"), target)).alias("x")).select(source, f"x.{target}").select("arabic", "latin")


def letters_of(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))


def bare_word(word: Column) -> Column:
    """An Arabic word without its article, if letters enough are left."""
    return F.when(word.startswith("ال") & (F.length(word) > 3), F.substr(word, F.lit(3))).otherwise(word)


def article_in_latin(word: Column) -> Column:
    """The article of an Arabic word as it is said: el and a space, or melted into the letter after it."""
    first = F.substring(bare_word(word), 1, 1)
    melted = F.concat(F.lit("e"), F.substring(_lookup(LATIN)[first], 1, 1))
    return F.when(bare_word(word) == word, "").when(first.isin(SUN), melted).otherwise("el ")


def sounds_in_latin(letters: Column, construct: Column) -> Column:
    """What each letter of a word (without article) is in Latin by those beside it; construct: whether a final ta marbuta is said as t."""
    vowel = lambda c: _true(c.isin(VOWELS))

    def one(ch: Column, i: Column) -> Column:
        before, after = F.get(letters, i - 1), F.get(letters, i + 1)
        is_, next_ = lambda s: ch.isin(list(s)), lambda s: _true(after.isin(list(s)))
        ends_in_n = next_("ن") & (i == F.size(letters) - 2)
        rules = [
            (is_("اأآى"), "a"),
            (is_("إ"), "i"),
            (is_("ع") & (next_("ا") | ~vowel(before)), "a"),
            (is_("وؤ"), "ou"),
            (is_("يئ") & ~next_("ة") & ~ends_in_n & (before.isNull() | vowel(before) | next_("ا")), "y"),
            (is_("يئ"), "i"),
            (is_("ة") & construct, "at"),
            (is_("ة"), "a"),
            (is_("سص") & vowel(before) & vowel(after), "ss"),
            (is_("ݣڭگ") & next_("يى"), "gu"),
        ]
        out = F.coalesce(_lookup(LATIN)[ch], F.lit(""))
        for fits, writes in reversed(rules):
            out = F.when(fits, writes).otherwise(out)
        return out

    return F.transform(letters, one)


def gap_keys(letters: Column, sounds: Column) -> Column:
    """(place, rank, key) of each gap between two consonants that are spelled side by side, the closest key first.

    Keys: both letters and what follows (C a consonant, V another letter, # the end), both letters, and __ with what
    follows; ^ in front marks a word's first gap. The first gap of a word of under four letters, or one that
    begins with ta, has none.
    """
    solid = lambda j: _true((F.get(sounds, j) != "") & ~F.get(letters, j).isin([*VOWELS, "ع"]))

    def one(ch: Column, i: Column) -> Column:
        folded = F.translate(F.concat(ch, F.get(letters, i + 1)), "ݣڭگک", "كككك")
        follows = F.when(F.size(letters) == i + 2, "#").when(solid(i + 2), "C").otherwise("V")
        front = F.when(i == 0, "^").otherwise("")
        keys = [F.concat(front, folded, follows), F.concat(front, folded), F.concat(front, F.lit("__"), follows)]
        barred = (i == 0) & ((ch == "ت") | (F.size(letters) < 4))
        rows = F.array(*[F.struct(i.alias("place"), F.lit(k).alias("rank"), key.alias("key")) for k, key in enumerate(keys)])
        return F.when(solid(i) & solid(i + 1) & ~barred, rows)

    return F.flatten(F.filter(F.transform(letters, one), lambda x: x.isNotNull()))


def _sounded(words: DataFrame) -> DataFrame:
    """Words (word, construct) with their letters and what each is in Latin."""
    return words.withColumn("letters", letters_of(bare_word(F.col("word")))).withColumn("sounds", sounds_in_latin(F.col("letters"), F.col("construct")))


def by_rule(words: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """(word, construct, latin) of each distinct Arabic word (word, construct), letter by letter.

    gaps (key, vowel), as `learned_gaps` gives them: vowels that are said between two consonants. A word that
    begins with ta and a consonant begins Ta-; a long vowel before a final n takes a silent e.
    """
    rows = _sounded(words.select("word", "construct").where("word is not null").distinct())
    if gaps is None:
        rows = rows.withColumn("vowels", F.lit(None).cast("map<int,string>"))
    else:
        keys = rows.select("word", "construct", F.inline(gap_keys(F.col("letters"), F.col("sounds"))))
        best = keys.join(gaps.select("key", "vowel"), "key").groupBy("word", "construct", "place").agg(F.min_by("vowel", "rank").alias("vowel"))
        best = best.groupBy("word", "construct").agg(F.map_from_entries(F.collect_list(F.struct("place", "vowel"))).alias("vowels"))
        rows = rows.join(best, ["word", "construct"], "left")
    said = F.concat_ws("", F.transform("sounds", lambda s, i: F.concat(s, F.coalesce(F.col("vowels")[i], F.lit("")))))
    said = F.regexp_replace(said, "a{3,}", "aa")
    bare = bare_word(F.col("word"))
    tamazight = bare.rlike(f"^ت[^{''.join(VOWELS)}ع]") & (F.length(bare) > 2) & said.rlike("^t(?![aeiou])")
    said = F.when(tamazight, F.concat(F.lit("ta"), F.substr(said, F.lit(2)))).otherwise(said)
    silent = F.when(said.rlike("(a|i|ou)n$") & bare.rlike("[اوي]ن$"), "e").otherwise("")
    return rows.select("word", "construct", capital(F.concat(article_in_latin(F.col("word")), said, silent)).alias("latin"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _added(head: pd.Series, sounds: pd.Series, latin: pd.Series) -> pd.Series:
    """For each sound, the vowels that the fewest edits put after it to make head and sounds the Latin word."""

    def one(start: str, parts: list[str], goal: str) -> list[str]:
        text = start + "".join(parts)
        left = [list(range(len(goal) + 1))]
        for i, a in enumerate(text, 1):
            row = [i]
            for j, b in enumerate(goal):
                row.append(min(left[-1][j] + (a != b), left[-1][j + 1] + 1, row[j] + 1))
            left.append(row)
        put, i, j = dict.fromkeys(range(len(text) + 1), ""), len(text), len(goal)
        while i or j:
            if i and j and left[i][j] == left[i - 1][j - 1] + (text[i - 1] != goal[j - 1]):
                i, j = i - 1, j - 1
            elif j and left[i][j] == left[i][j - 1] + 1:
                j -= 1
                put[i] = goal[j] + put[i]
            else:
                i -= 1
        ends, at = [], len(start)
        for part in parts:
            at += len(part)
            ends.append("".join(c for c in put[at] if c in "aeiou"))
        return ends

    return pd.Series([one(h, list(s), x) for h, s, x in zip(head, sounds, latin)], dtype=object)


def plain_latin(text: Column) -> Column:
    """Lower case without accents and all that is not a letter or space."""
    return F.regexp_replace(F.lower(stripped(text)), "[^a-z ]", "")


def learned_gaps(pairs: DataFrame, seen: int = GAP_SEEN, share: float = GAP_SHARE) -> DataFrame:
    """(key, vowel): what sources put between two consonants that Arabic writes side by side, from words in both scripts (arabic, latin).

    A key counts if it was seen often enough, and one way of writing it, none included, has its share; of
    equal ones the first in order. Pairs are taken as often as they come; words with spaces are left out.
    """
    words = pairs.where("arabic is not null and latin is not null and not contains(arabic, ' ')").select(F.col("arabic").alias("word"), "latin", F.lit(False).alias("construct"))
    letters_only = lambda c: F.replace(plain_latin(c), F.lit(" "), F.lit(""))
    rows = _sounded(words).withColumn("vowels", _added(letters_only(article_in_latin(F.col("word"))), F.col("sounds"), letters_only(F.col("latin"))))
    each = rows.select("vowels", F.inline(gap_keys(F.col("letters"), F.col("sounds")))).select("key", F.get("vowels", F.col("place")).alias("vowel"))
    counted = each.groupBy("key", "vowel").agg(F.count("*").alias("n"))
    best = counted.groupBy("key").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("less"), "vowel")).alias("top"))
    return best.where((F.col("total") >= seen) & (-F.col("top.less") >= F.col("total") * F.lit(share))).select("key", F.col("top.vowel").alias("vowel"))


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s and unicodedata.normalize("NFC", s))


def model_arabic(word: Column) -> Column:
    """An Arabic word as a model reads it: without vowel marks."""
    return F.regexp_replace(_composed(word), "[ً-ْٰـ]", "")


def _guessed(rows: DataFrame, word: Column, counts: DataFrame | None, order: int) -> DataFrame:
    """Rows with `guess`, the likeliest spelling by a model's counts of what its words read; null without a model."""
    if counts is None:
        return rows.withColumn("guess", F.lit(None).cast("string"))
    keyed = rows.withColumn("_read", F.when(F.col("known").isNull(), word))
    best = spelled(keyed.select(F.col("_read").alias("word")).where("word <> ''").distinct(), counts, order=order, top=1)
    return keyed.join(best.select(F.col("word").alias("_read"), F.nullif(F.col("spelling"), F.lit("")).alias("guess")), "_read", "left").drop("_read")


def translations(spark: SparkSession) -> DataFrame:
    """(key, to): words that a name holds as nouns, which are translated."""
    rows = spark.createDataFrame(list(TRANSLATED.items()), "arabic string, to string")
    return rows.select(normalise(F.col("arabic")).alias("key"), "to")


def in_latin(names: DataFrame, table: DataFrame | None = None, gaps: DataFrame | None = None, counts: DataFrame | None = None, order: int = 4) -> DataFrame:
    """(name, latin) of each distinct Arabic name (name) but null; empty where a name has no words.

    table (arabic, latin): words, or two words that are one in Latin, as they are known to be written. counts: a
    model from Arabic to Latin (`spellings.ngram_counts`, of that order), for words not in the table. Other words are
    spelled by rule, with `gaps`. Parts in brackets are spelled on their own; one that says formerly begins with ex.
    Common nouns are translated, and come first unless they keep their place.
    """
    pieces = F.regexp_extract_all("name", F.lit(r"(?s)\([^()]*\)|(?:(?!\([^()]*\)).)+"), F.lit(0))
    rows = names.select("name").where("name is not null").distinct().select("name", F.posexplode_outer(pieces).alias("piece", "text"))
    raw = words_of(F.translate(F.coalesce("text", F.lit("")), "()", "  "))
    bracket = F.col("text").rlike(r"(?s)^\([^()]*\)$")
    first_old = F.array_position(F.transform("raw", lambda w: w.isin(FORMERLY)), True) - 1
    rows = rows.select("name", F.coalesce("piece", F.lit(0)).alias("piece"), _true(bracket).alias("bracket"), raw.alias("raw")).withColumn("_old", F.when(F.col("bracket"), first_old).otherwise(-1))
    rows = rows.select("name", "piece", "bracket", (F.col("_old") >= 0).alias("old"), F.filter("raw", lambda w, i: i != F.col("_old")).alias("words"))
    rows = stage(rows)
    # runs of words that the table or the translations have
    runs = rows.select("name", "piece", "words", F.posexplode("words").alias("at", "_")).select("name", "piece", "words", "at", F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("n"))
    runs = runs.where("at + n <= size(words)").select("name", "piece", "at", "n", F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ").alias("run"))
    # a mark that stands alone folds to nothing, and spoils its run
    keyed = runs.select("*", normalise(F.col("run")).alias("key")).where("key <> '' and (n = 1 or size(split(key, ' ')) = n)")
    lexicon = translations(names.sparkSession).select("key", F.lit(1).alias("translated"), F.col("to").alias("known"))
    if table is not None:
        own = table.groupBy(normalise(F.col("arabic")).alias("key")).agg(F.min("latin").alias("known")).where("known is not null and size(split(key, ' ')) <= 2")
        lexicon = lexicon.unionByName(own.select("key", F.lit(0).alias("translated"), "known"))
    hit = keyed.join(lexicon, "key").groupBy("name", "piece").agg(F.collect_list(F.struct("n", "translated", "known", "at")).alias("hits"))
    met = rows.join(hit, ["name", "piece"], "left")
    alone = lambda i: F.struct(F.lit(1).alias("n"), F.lit(0).alias("translated"), F.lit(None).cast("string").alias("known"), i.alias("at"))
    best = lambda i: F.coalesce(F.array_max(F.filter("hits", lambda h: h["at"] == i)), alone(i))
    none = F.array().cast("array<struct<n:int,translated:int,known:string,at:int>>")
    step = lambda to, i: F.when(i < to["next"], to).otherwise(F.struct((i + best(i)["n"]).alias("next"), F.concat(to["taken"], F.array(best(i))).alias("taken")))
    places = F.transform("words", lambda w, i: i)
    taken = F.aggregate(places, F.struct(F.lit(0).alias("next"), none.alias("taken")), step, lambda to: to["taken"])
    flat = met.withColumn("taken", taken).select("name", "piece", "bracket", "old", "words", F.inline_outer("taken"))
    follow = F.get("words", F.col("at") + F.col("n"))
    word = F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ")
    flat = flat.select("name", "piece", "bracket", "old", "at", "translated", "known", F.when(F.col("at").isNotNull(), word).alias("word"), follow.alias("follow"))
    # numbers stay numbers, whatever the table says
    flat = flat.withColumn("known", F.when(F.col("word").rlike(f"^[0-9{DIGITS}]+$"), F.translate("word", DIGITS, "0123456789")).when(F.col("translated") == 1, F.col("known")).otherwise(_shown(F.col("known"))))
    flat = flat.withColumn("construct", _true(F.col("word").endswith("ة") & F.col("follow").isNotNull() & ~F.col("follow").startswith("ال")))
    flat = stage(_guessed(flat, model_arabic(F.col("word")), counts, order))
    flat = flat.join(by_rule(flat.where("known is null and guess is null"), gaps), ["word", "construct"], "left")
    spelt = F.coalesce("known", capital(F.col("guess")), "latin")
    parts = flat.select("name", "piece", "bracket", "old", F.when(F.col("word").isNotNull(), F.struct("at", spelt.alias("x"), "translated")).alias("part")).repartition("name")
    whole = parts.groupBy("name", "piece", "bracket", "old").agg(F.array_sort(F.collect_list("part")).alias("p"))
    first, last = F.get("p", F.lit(0)), F.get("p", F.size("p") - 1)
    moves = _true((F.size("p") > 1) & (last["translated"] == 1) & (first["translated"] == 0) & last["x"].rlike(r"^\p{Lu}") & ~last["x"].isin(KEEP_PLACE))
    said = F.transform("p", lambda x: x["x"])
    said = F.array_join(F.when(moves, F.concat(F.slice(said, -1, 1), F.slice(said, 1, F.size("p") - 1))).otherwise(said), " ")
    shown = F.when(said == "", None).when(F.col("bracket"), F.concat(F.lit("("), F.when(F.col("old"), "ex ").otherwise(""), said, F.lit(")"))).otherwise(said)
    ordered = F.array_sort(F.collect_list(F.when(shown.isNotNull(), F.struct("piece", shown.alias("x")))))
    return whole.groupBy("name").agg(F.array_join(F.transform(ordered, lambda x: x["x"]), " ").alias("latin"))


def _shown(known: Column) -> Column:
    """A table's word as a name shows it: with a capital, but for the n' and d' that join two words."""
    known = F.translate(known, "’", "'")
    return F.when(known.rlike("^[nd]'"), known).otherwise(capital(known))


def word_in_arabic(word: Column) -> Column:
    """A normalised Latin word without spaces, read from the left, groups of letters before single ones."""
    w = F.regexp_replace(word, "e$", "")
    group = r"[cskgtd]h|rh(?=[aeiou])|ou|(?<!^)aa(?=.)"
    doubled = r"([bdfghjklmnpqrstvxzc])\1(?!(?<=[cskgtd])h|(?<=r)h[aeiou])"
    read = F.regexp_extract_all(w, F.lit(f"{group}|{doubled}|."), F.lit(0))
    letter = lambda x: F.coalesce(_lookup(ARABIC_GROUPS)[x], _lookup(ARABIC)[F.substring(x, 1, 1)], F.substring(x, 1, 1))
    begins = lambda x, i: (i == 0) & x.isin(["e", "i"])
    return F.concat_ws("", F.transform(read, lambda x, i: F.when(begins(x, i), "إ").when((i == 0) & (x == "o"), "أو").when((i > 0) & (i == F.size(read) - 1) & (x == "a"), "ة").otherwise(letter(x))))


def in_arabic(names: DataFrame, table: DataFrame | None = None, counts: DataFrame | None = None, order: int = 4, decompose: bool = True) -> DataFrame:
    """(name, arabic) of each distinct Latin name (name) but null; empty where a name has no words.

    An article written apart goes with the word after it. table (latin, arabic): words with their article, if any,
    as they are known to be written; counts: a model from Latin to Arabic for those it lacks; then letter rules.
    decompose: False where all names are ASCII.
    """
    rows = names.select("name").where("name is not null").distinct().select("name", F.posexplode_outer(latin_words_of(F.col("name"))).alias("at", "word"))
    apart = F.col("word").rlike(f"[{SPACE}]")
    # a word whose article stands apart is the rest, and has the article joined on
    rows = rows.withColumns({"key": normalise(F.col("word"), decompose), "rest": normalise(F.when(apart, F.regexp_extract("word", f"[{SPACE}]+(.*)$", 1)).otherwise(F.col("word")), decompose), "apart": apart})
    if table is None:
        rows = rows.withColumn("known", F.lit(None).cast("string"))
    else:
        rows = rows.join(table.groupBy(normalise(F.col("latin"), decompose).alias("key")).agg(F.min("arabic").alias("known")), "key", "left")
    rows = rows.withColumn("known", F.when(F.col("word").rlike("^[0-9]+$"), F.col("word")).otherwise(F.col("known")))
    rows = _guessed(rows, plain_latin(F.regexp_replace("word", f"[{SPACE}]+", " ")), counts, order)
    ruled = F.concat(F.when(F.col("apart"), "ال").otherwise(""), word_in_arabic(F.replace("rest", F.lit(" "), F.lit(""))))
    part = F.when(F.col("word").isNotNull(), F.struct("at", F.coalesce("known", "guess", ruled).alias("x")))
    return rows.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["x"]), " ").alias("arabic"))
