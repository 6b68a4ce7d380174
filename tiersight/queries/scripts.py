"""Names of the tables written in Arabic letters, and those in Latin letters again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiersight.operators import transliteration
from tiersight.queries.base import Tables, query

LATIN = "btdjhrzscfkqglmnwypvaiou"
ARABIC = "".join(transliteration.ARABIC[c] for c in LATIN)
CONSONANTS = "".join(c for c in transliteration.LATIN if c != "خ" and c != "ش" and c != "غ" and c != "ء")
SOUNDS = "".join(transliteration.LATIN[c] for c in CONSONANTS)


def _replaced(word: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        word = f"regexp_replace({word}, '{pattern}', '{to}', 'g')"
    return word


STEPS = [("e$", ""), ("ch|sh", "ش"), ("kh", "خ"), ("gh", "غ"), ("rh([aeiou])", r"غ\1"), ("th", "ت"), ("dh", "ض"), ("ou", "و"), *[(c + c, c) for c in "bcdfghjklmnpqrstvxz"], ("^a", "ا"), ("^[ei]", "إ"), ("^o", "أو"), ("a$", "ة"), ("aa", "اع"), ("x", "كس"), ("e", "")]
IN_ARABIC = rf"""p AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'Al-' || p_name WHEN 1 THEN p_name || ' ' || p_size ELSE p_type || ' ' || p_name END AS name FROM part),
ws AS (SELECT name, regexp_extract_all(lower(name), 'al-[^ ]+|[^ ]+') AS ws FROM p), w AS (SELECT name, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM ws),
s AS (SELECT name, k, CASE WHEN w LIKE 'al-%' THEN 'ال' ELSE '' END || translate({_replaced("regexp_replace(w, '^al-', '')", STEPS)}, '{LATIN}', '{ARABIC}') AS x FROM w),
a AS (SELECT name, string_agg(x, ' ' ORDER BY k) AS arabic FROM s GROUP BY name)"""
VOWELS = "".join(transliteration.VOWELS)
LETTER = f"""CASE WHEN c IN ('ا', 'أ', 'آ', 'ى') THEN 'a' WHEN c = 'إ' THEN 'i' WHEN c = 'ع' THEN CASE WHEN z = 'ا' OR b = '' OR NOT contains('{VOWELS}', b) THEN 'a' ELSE '' END WHEN c IN ('و', 'ؤ') THEN 'ou'
WHEN c IN ('ي', 'ئ') THEN CASE WHEN z = 'ة' OR (z = 'ن' AND i = n - 1) THEN 'i' WHEN b = '' OR contains('{VOWELS}', b) OR z = 'ا' THEN 'y' ELSE 'i' END WHEN c = 'ة' THEN CASE WHEN held THEN 'at' ELSE 'a' END
WHEN c IN ('س', 'ص') AND b <> '' AND z <> '' AND contains('{VOWELS}', b) AND contains('{VOWELS}', z) THEN 'ss' WHEN c IN ('ݣ', 'ڭ', 'گ') AND z IN ('ي', 'ى') THEN 'gu' WHEN c IN ('خ', 'ش', 'غ') THEN translate(c, 'خشغ', 'kcg') || 'h' WHEN contains('{CONSONANTS}', c) THEN translate(c, '{CONSONANTS}', '{SOUNDS}') ELSE '' END"""


def _in_arabic(t: Tables):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Al-"), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).otherwise(F.concat_ws(" ", "p_type", "p_name"))
    return transliteration.in_arabic(t.part.select(name.alias("name")), decompose=False)


@query(f"WITH {IN_ARABIC} SELECT name, arabic FROM a")
def written_in_arabic(spark, sf_dir):
    """Parts' names, some with an article or a number, in Arabic letters by rule."""
    return _in_arabic(Tables(spark, sf_dir))


@query(f"""WITH {IN_ARABIC}, d AS (SELECT DISTINCT arabic, string_split(arabic, ' ') AS ws FROM a), v AS (SELECT arabic, unnest(ws) AS w, generate_subscripts(ws, 1) AS k, ws FROM d),
h AS (SELECT arabic, k, w, w LIKE '%ة' AND k < len(ws) AND NOT starts_with(coalesce(ws[k + 1], ''), 'ال') AS held, CASE WHEN starts_with(w, 'ال') AND length(w) > 3 THEN substr(w, 3) ELSE w END AS r FROM v),
l AS (SELECT h.*, i, substr(r, i, 1) AS c, CASE WHEN i > 1 THEN substr(r, i - 1, 1) ELSE '' END AS b, substr(r, i + 1, 1) AS z, length(r) AS n FROM (SELECT *, unnest(range(1, length(r) + 1)) AS i FROM h) h),
o AS (SELECT arabic, k, w, r, regexp_replace(string_agg({LETTER}, '' ORDER BY i), 'a{{3,}}', 'aa', 'g') AS x FROM l GROUP BY ALL),
q AS (SELECT arabic, k, w, r, CASE WHEN length(r) > 2 AND r[1] = 'ت' AND NOT contains('{VOWELS}ع', r[2]) AND regexp_matches(x, '^t([^aeiou]|$)') THEN 'ta' || x[2:] ELSE x END AS x FROM o),
e AS (SELECT arabic, k, CASE WHEN regexp_matches(w, '^[0-9]+$') THEN w WHEN w = r THEN upper(x[1]) || x[2:] WHEN contains('{"".join(transliteration.SUN)}', r[1]) THEN 'E' || CASE r[1] WHEN 'ش' THEN 'c' ELSE translate(r[1], '{CONSONANTS}', '{SOUNDS}') END || x ELSE 'El ' || upper(x[1]) || x[2:] END
  || CASE WHEN regexp_matches(x, '(a|i|ou)n$') AND regexp_matches(r, '[اوي]ن$') THEN 'e' ELSE '' END AS x FROM q)
SELECT arabic AS name, string_agg(x, ' ' ORDER BY k) AS latin FROM e GROUP BY arabic""")
def written_in_latin(spark, sf_dir):
    """The same names, as they are in Arabic letters, written in Latin letters again by rule."""
    return transliteration.in_latin(_in_arabic(Tables(spark, sf_dir)).select(F.col("arabic").alias("name")))


@query()
def known_words(spark, sf_dir):
    """What parts' names in Arabic letters write for each word of theirs in Latin ones, most often."""
    pairs = _in_arabic(Tables(spark, sf_dir)).select(F.col("name").alias("fr"), F.col("arabic").alias("ar"))
    return transliteration.word_table(transliteration.word_pairs(pairs))
