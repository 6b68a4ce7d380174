"""Names across spellings and scripts: folding, keys, trigrams, codes and safety checks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters without a decomposition and what they fold to; fixed values.
LETTERS = {"ة": "ه", "ى": "ي", "ء": "", "ـ": "", "ݣ": "ك", "ڭ": "ك", "گ": "ك", "ک": "ك", "ﻻ": "لا"}
SEPARATORS = "’'`‘-–—_/.,()"
#: Articles written as words of their own; fixed values.
ARTICLES = "el al l ed er es ez et en ech ad ar as az at an".split()
#: Digits that stand for letters in Latin chat spelling; 2 and 3 stand for sounds that Latin spellings drop. Fixed values.
CHAT = {"5": "kh", "7": "h", "9": "q", "2": "", "3": ""}
#: Groups of letters that are one sound, and letters that sound as another or not at all; fixed values.
GROUPS = {"ou": "w", "kh": "x", "sh": "S", "ch": "S", "gh": "G", "th": "t", "dh": "d", "ph": "f"}
SINGLE = {"q": "k", "c": "k"} | dict.fromkeys("aeiou0123456789", "")
LABELS = "Commune|Arrondissement|Cercle|Province|Préfecture|Région"


@F.pandas_udf(T.StringType())
def stripped(names: pd.Series) -> pd.Series:
    """Decomposed, without combining marks."""
    return names.map(lambda s: s and "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))


def normalise(name: Column, decompose: bool = True) -> Column:
    """The form that names and queries are compared in: folded, lower case, single spaces.

    decompose: False where all names are ASCII, which keeps the whole expression in the JVM.
    """
    s = stripped(name) if decompose else name
    for letter, to in LETTERS.items() if decompose else ():
        s = F.replace(s, F.lit(letter), F.lit(to))
    s = F.translate(F.lower(s), SEPARATORS, " " * len(SEPARATORS))
    s = F.regexp_replace(s, r"[^\p{L}\p{N} ]+", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def spelled_out(s: Column) -> Column:
    """Chat spelling with letters in place of its digits."""
    single = {k: v for k, v in CHAT.items() if len(v) < 2}
    for digit in CHAT.keys() - single.keys():
        s = F.replace(s, F.lit(digit), F.lit(CHAT[digit]))
    kept = [k for k, v in single.items() if v]
    return F.translate(s, "".join([*kept, *(single.keys() - set(kept))]), "".join(single[k] for k in kept))


def sounds(s: Column, groups: dict[str, str], single: dict[str, str]) -> Column:
    """A text read sound by sound from the left: groups of letters before single ones, what is in neither as it is.

    Sounds said twice in a row count once.
    """
    read = F.regexp_extract_all(s, F.lit("|".join([*groups, "."])), F.lit(0))
    said = F.create_map(*[F.lit(x) for pair in (single | groups).items() for x in pair])
    return F.regexp_replace(F.concat_ws("", F.transform(read, lambda x: F.coalesce(said[x], x))), r"(.)\1+", "$1")


def skeleton(normalised: Column) -> Column:
    """A Latin name's consonants, which survive transliteration; empty for other scripts."""
    words = F.filter(F.split(spelled_out(normalised), " "), lambda w: ~w.isin(ARTICLES))
    return F.when(normalised.rlike("[^a-z0-9 ]"), "").otherwise(sounds(F.concat_ws("", words), GROUPS, SINGLE))


def trigrams(s: Column) -> Column:
    """All runs of three characters, repeats included; of a shorter text the text itself."""
    n = F.length(s)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(s, i, F.lit(3)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(runs)


def dice(a: Column, b: Column) -> Column:
    """Twice the shared members over all members of two sets (arrays without repeats); 0 if one is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.lit(2.0) * both / total)


def padded_grams(slug: Column) -> Column:
    """Distinct trigrams of a slug without hyphens and with a space at either end."""
    return F.array_distinct(trigrams(F.concat(F.lit(" "), F.translate(slug, "-", ""), F.lit(" "))))


def slugify(name: Column, decompose: bool = True) -> Column:
    bare = F.regexp_replace(name, rf"(?i)^({LABELS})\s+(de\s+la\s+|de\s+l['’]|de\s+|du\s+|des\s+|d['’])?", "")
    low = F.lower(F.translate(stripped(bare) if decompose else bare, "'’", "  "))
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def term_key(term: Column) -> Column:
    """A heading or term without case, brackets, separators and kinds of apostrophe."""
    s = F.translate(F.lower(term), "‘’()%.:·", "''      ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def snake(name: str) -> str:
    """camelCase and dotted names as column names."""
    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()).strip("_")


def letters_apart_share(a: Column, b: Column) -> Column:
    """Edits that turn one into the other, as a share of the longer."""
    return F.levenshtein(a, b).cast("double") / F.greatest(F.length(a), F.length(b), F.lit(1))


def closeness(a: Column, b: Column) -> Column:
    """1 less the share of edits, with or without leading articles, whichever is closer."""
    bare = lambda s: F.regexp_replace(s, rf"^({'|'.join(ARTICLES)}) ", "")
    return F.lit(1.0) - F.least(letters_apart_share(a, b), letters_apart_share(bare(a), bare(b)))


def padded_code(code: Column, width: int = 9) -> Column:
    """A code's digits, padded; fails for none or too many."""
    digits = F.regexp_replace(code, r"\D", "")
    wrong = (F.length(digits) == 0) | (F.length(digits) > width)
    return F.when(wrong, F.raise_error(F.concat(F.lit("no code of up to "), F.lit(str(width)), F.lit(" digits: "), code))).otherwise(F.lpad(digits, width, "0"))


def dotted_code(code: Column, parent: Column) -> Column:
    """region.province.commune[.rest]: the parent's digits padded to five, then the code's own two and the rest as published."""
    own, above = F.regexp_replace(code, r"\D", ""), F.regexp_replace(parent, r"\D", "")
    full = F.lpad(above, 5, "0")
    rest = F.substr(own, F.length(above) + 1)
    head, tail = F.substring(rest, 1, 2), F.substr(rest, F.lit(3))
    parts = F.array(F.substring(full, 1, 2), F.substring(full, 3, 3), head, tail)
    dotted = F.concat_ws(".", F.filter(parts, lambda x: x != ""))
    return F.when(~own.startswith(above), F.raise_error(F.concat(F.lit("not under its province: "), code))).otherwise(dotted)


def short_id(*parts: Column) -> Column:
    """Twelve hexadecimal digits that name the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)


def seed_of(*parts: Column) -> Column:
    """A seed below 2**32 from the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("long")


def script_runs(s: Column) -> Column:
    """struct(latin, arabic, tifinagh): a name's runs of each script."""
    run = lambda p: F.trim(F.concat_ws(" ", F.regexp_extract_all(s, F.lit(p), F.lit(0))))
    return F.struct(
        run(r"\p{IsLatin}[\p{IsLatin}\p{N}'’ -]*").alias("latin"),
        run(r"\p{IsArabic}[\p{IsArabic}\p{N} ]*").alias("arabic"),
        run(r"\p{IsTifinagh}[\p{IsTifinagh}\p{N} ]*").alias("tifinagh"),
    )


def numbers_in(s: Column) -> Column:
    """The numbers in prose, with thin or plain spaces between thousands and decimal commas or points."""
    found = F.regexp_extract_all(s, F.lit("-?\\d+(?:[\\u00a0\\u202f ]\\d{3})*(?:[.,٫]\\d+)?"), F.lit(0))
    return F.transform(found, lambda x: F.translate(F.regexp_replace(x, "[\\u00a0\\u202f ]", ""), ",٫", "..").try_cast("double"))


def scrubbed(s: Column) -> Column:
    """A search text without addresses, links and long numbers."""
    for pattern in (r"[\w.+-]+@[\w-]+\.[\w.]+", r"https?://\S+", r"\+?\d(?:[\s().-]*\d){7,}"):
        s = F.regexp_replace(s, pattern, " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def personal(s: Column) -> Column:
    """Whether a text holds an address, a long number, or an honorific before a name."""
    return s.rlike(r"[\w.+-]+@[\w-]+\.[\w.]+") | s.rlike(r"\+?\d(?:[\s().-]*\d){7,}") | s.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Mme|M)\.? \p{Lu}\p{L}+")


def route(path: Column) -> Column:
    """A request's path with its identifiers replaced."""
    return F.regexp_replace(F.regexp_replace(path, r"\?.*$", ""), r"/(?:\d[\d.]*|[a-z0-9]+(?:-[a-z0-9]+)*-\d+)(?=/|$)", "/:id")


def referrer_class(referrer: Column, own_host: str) -> Column:
    host = F.regexp_replace(F.coalesce(F.try_parse_url(referrer, F.lit("HOST")), F.lit("")), r"^www\.", "")
    return F.when(host == "", "direct").when(host == own_host, "internal").when(host.rlike(r"(?:^|\.)(?:google|bing|duckduckgo|qwant|yahoo|ecosia|baidu|yandex)\."), "search").otherwise("site")


def crawler(agent: Column) -> Column:
    return F.coalesce(agent.rlike(r"(?i)bot|crawl|spider|slurp|preview|fetch|curl|wget|python-requests|headless"), F.lit(True))


def locale_of(path: Column) -> Column:
    found = F.regexp_extract(path, r"^/(ar|en)(?:/|$)", 1)
    return F.when(found == "", "fr").otherwise(found)


#: Words that end a village's name in an address; fixed values.
AFTER_VILLAGE = ["commune", "cr", r"c\.r", "c/r", "ccr", "caidat", "caïdat", "cercle"]
AFTER_VILLAGE_AR = ["جماعة", "ج/", r"ج\.", "الجماعة", "قيادة", "دائرة"]


def village_in(address: Column, arabic: bool = False) -> Column:
    """The village that an address names, up to the commune or district; null where it names none."""
    first, ends = (r"دوار\s*", AFTER_VILLAGE_AR) if arabic else (r"(?i)\bdouar\s+", AFTER_VILLAGE)
    stop = "|".join(ends)
    found = F.regexp_extract(address, rf"{first}(.+?)(?:\s+(?:{stop}){'' if arabic else chr(92) + 'b'}.*)?$", 1)
    return F.nullif(F.trim(found), F.lit(""))
