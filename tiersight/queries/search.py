"""Search of names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tiersight.functions import text as names
from tiersight.operators import stored, textsearch
from tiersight.queries.base import Tables, query

#: Letters for names in a second script, made up for the test tables.
SCRIPT = ("abdefhiklmnorstuz", "ابدعفحيكلمنورستثز")
ASKED = ["lavender", "rose red", "lav", "roze", "red pink", "zz", "part 12", "light", "blue steel", "smoke", "bloo steele", *(a.translate(str.maketrans(*SCRIPT)) for a in ("rose", "old plate", "lavend", "hot bolt"))]
GRAMS = "list_transform(range(1, greatest(length({s}) - 1, 2)), lambda i: substr({s}, i, 3))"
NORMAL = r"trim(regexp_replace(regexp_replace(translate(lower({s}), '’''`‘-–—_/.,()', '              '), '[^\p{{L}}\p{{N}} ]+', '', 'g'), '\s+', ' ', 'g'))"
ARTICLES_SQL = ", ".join(f"'{a}'" for a in names.ARTICLES)


def skeleton_sql(s: str) -> str:
    out = f"translate(replace({s}, '5', 'kh'), '7923', 'hq')"
    out = f"array_to_string(list_filter(string_split({out}, ' '), lambda w: w NOT IN ({ARTICLES_SQL})), '')"
    for letters, sound in names.GROUPS.items():
        out = f"replace({out}, '{letters}', '{sound}')"
    out = f"translate({out}, 'qcaeiou0123456789', 'kk')"
    squeezed = f"array_to_string(list_transform(range(1, length({out}) + 1), lambda i: CASE WHEN i > 1 AND substr({out}, i, 1) = substr({out}, i - 1, 1) THEN '' ELSE substr({out}, i, 1) END), '')"
    return f"CASE WHEN regexp_matches({s}, '[^a-z0-9 ]') THEN '' ELSE {squeezed} END"


def name_units(t: Tables):
    """Names of parts as units; two of three have a name in a second script."""
    rows = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("entry"))
    second = F.when(F.col("entry") % 3 > 0, F.translate("p_name", *SCRIPT))
    return rows.select("entry", (F.col("entry") % 3).cast("int").alias("level_rank"), F.col("p_name").alias("name"), second.alias("arabic"), F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("slug"))


UNITS_SQL = f"""u AS (SELECT min(p_partkey) AS entry, (min(p_partkey) % 3)::INTEGER AS level_rank, {NORMAL.format(s='p_name')} AS name, CASE WHEN min(p_partkey) % 3 > 0 THEN {NORMAL.format(s=f"translate(p_name, '{SCRIPT[0]}', '{SCRIPT[1]}')")} ELSE '' END AS arabic,
  replace(lower(replace(p_name, ' ', '-')), '-', ' ') AS slug FROM part GROUP BY p_name)"""
ALL_GRAMS = f"list_distinct(list_concat({GRAMS.format(s='name')}, CASE WHEN arabic = '' THEN [] ELSE {GRAMS.format(s='arabic')} END, {GRAMS.format(s='slug')}))"


def name_index(spark, sf_dir, name: str = "names", aliases=None) -> textsearch.Index:
    """The index of names, read from the shared folder; written there the first time."""
    t = Tables(spark, sf_dir)

    def make():
        units = name_units(t)
        return textsearch.index_tables(textsearch.build_index(units, aliases and aliases(units), decompose=False))

    return textsearch.stored_index(stored.kept(spark, name, stored.fingerprint(t.part), make))


@query(f"WITH {UNITS_SQL}, g AS (SELECT entry, unnest({ALL_GRAMS}) AS gram FROM u) SELECT gram, count(*) AS entries, min(entry) AS first FROM g GROUP BY gram")
def trigram_postings(spark, sf_dir):
    return name_index(spark, sf_dir).postings.groupBy("gram").agg(F.count("*").alias("entries"), F.min("entry").alias("first"))


@query(f"WITH {UNITS_SQL}, b AS (SELECT entry, name, {skeleton_sql('name')} AS bones FROM u) SELECT bones, count(*) AS n, min(entry) AS first FROM b WHERE length(bones) >= 2 GROUP BY bones")
def skeleton_index(spark, sf_dir):
    return name_index(spark, sf_dir).skeletons.groupBy("bones").agg(F.count("*").alias("n"), F.min("entry").alias("first"))


def search_sql(asked: list[str]) -> str:
    """The SQL of a search for `asked`; it lacks the aliases, a (alias, entry)."""
    return f"""WITH {UNITS_SQL}, e AS (SELECT *, {ALL_GRAMS} AS own, len({ALL_GRAMS}) AS grams, {skeleton_sql('name')} AS bones FROM u),
asked(query) AS (VALUES {', '.join(f"('{a}')" for a in asked)}), q0 AS (SELECT query, {NORMAL.format(s='query')} AS q FROM asked),
ab AS (SELECT {skeleton_sql('alias')} AS bones, entry FROM a), q AS (SELECT *, len({GRAMS.format(s='q')}) AS q_grams, {skeleton_sql('q')} AS q_bones FROM q0 WHERE q <> ''),
o AS (SELECT q.query, e.entry, len(list_intersect({GRAMS.format(s='q.q')}, e.own)) AS overlap, length(q_bones) >= 2 AND (q_bones = bones OR EXISTS (SELECT 1 FROM ab WHERE ab.bones = q_bones AND ab.entry = e.entry)) AS spelt, EXISTS (SELECT 1 FROM a WHERE a.alias = q.q AND a.entry = e.entry) AS aliased FROM q, e),
s AS (
  SELECT query, entry, level_rank, 200.0::DOUBLE * overlap / (grams + q_grams) AS dice, name = q OR arabic = q OR slug = q AS same, aliased, spelt,
    CASE WHEN starts_with(name, q) THEN name WHEN starts_with(arabic, q) THEN arabic WHEN starts_with(slug, q) THEN slug END AS field, q FROM o JOIN q USING (query) JOIN e USING (entry) WHERE overlap > 0 OR spelt OR aliased
), h AS (
  SELECT query, entry, level_rank, CASE WHEN same OR aliased THEN 1000.0 WHEN field IS NOT NULL THEN 500.0 - least(499.0, length(field) - length(q)) WHEN spelt THEN floor((300.0::DOUBLE + dice) * 1e4 + 0.5) / 1e4 ELSE floor(dice * 1e4 + 0.5) / 1e4 END::DOUBLE AS score,
    CASE WHEN same THEN 'exact' WHEN aliased THEN 'alias' WHEN field IS NOT NULL THEN 'prefix' WHEN spelt THEN 'spelling' ELSE 'trigram' END AS matched FROM s
)
SELECT query, entry, score, matched, row_number() OVER (PARTITION BY query ORDER BY score DESC, level_rank, entry)::INTEGER AS place FROM h WHERE score > 0 QUALIFY place <= 10"""


@query(search_sql(ASKED).replace("asked(query)", "x AS (SELECT 'smoke' AS alias, min(entry) AS entry FROM u UNION ALL SELECT 'blue steel', max(entry) FROM u), a AS (SELECT alias, entry FROM x WHERE alias NOT IN (SELECT name FROM u)), asked(query)", 1))
def name_search(spark, sf_dir):
    aliases = lambda units: units.agg(F.min("entry").alias("lo"), F.max("entry").alias("hi")).select(F.explode(F.array(F.struct(F.lit("smoke").alias("alias"), F.col("lo").alias("entry")), F.struct(F.lit("blue steel").alias("alias"), F.col("hi").alias("entry")))).alias("x")).select("x.*")
    index = name_index(spark, sf_dir, "aliased-names", aliases)
    return textsearch.search(index, spark.createDataFrame([(a,) for a in ASKED], "query string"), decompose=False)


ASKED_ALL = ["lavender", "tin", "promo", "standard anodized", "anod", "steel", "lavender b", "7", "10007", "000000012", "00000.0015", "zz", "po", " 10011 "]
PLACES_SQL = f""", n AS (SELECT DISTINCT query, trim(query) AS raw FROM asked WHERE regexp_full_match(trim(query), '[0-9][0-9.]*')),
p AS (SELECT DISTINCT {NORMAL.format(s='p_type')} AS key, p_type AS place_name, min(p_partkey) OVER (PARTITION BY p_name) AS entry FROM part),
ps AS (
  SELECT query, entry, level_rank, place_name, CASE WHEN key = q THEN 950.0 WHEN starts_with(key, q) THEN 450.0 - least(199.0, length(key) - length(q))
    WHEN NOT contains(q, ' ') AND len(list_filter(string_split(key, ' '), lambda w: starts_with(w, q))) > 0 THEN 250.0 - least(149.0, length(key) - length(q)) END + (level_rank = 2)::INTEGER AS score
  FROM p JOIN e USING (entry), q WHERE length(q) >= 3 AND query NOT IN (SELECT query FROM n)
), x AS (
  SELECT query, entry, level_rank, score, matched, NULL::VARCHAR AS place_name FROM h WHERE score > 0 AND query NOT IN (SELECT query FROM n)
  UNION ALL SELECT query, entry, level_rank, score::DOUBLE, 'place', place_name FROM ps WHERE score IS NOT NULL
), y AS (
  SELECT *, NULL::VARCHAR AS names FROM x QUALIFY row_number() OVER (PARTITION BY query, entry ORDER BY score DESC, coalesce(place_name, '')) = 1
  UNION ALL SELECT query, entry, level_rank, 1000.0::DOUBLE, 'code', NULL, NULL FROM n JOIN e ON raw = substr(lpad(entry::VARCHAR, 9, '0'), 1, 5) || '.' || substr(lpad(entry::VARCHAR, 9, '0'), 6)
    OR (NOT contains(raw, '.') AND ltrim(raw, '0') = ltrim(entry::VARCHAR, '0'))
  UNION ALL SELECT query, entry, level_rank, 1000.0::DOUBLE, 'postcode', NULL, names FROM n JOIN
    (SELECT (10000 + p_size)::VARCHAR AS raw, entry, array_to_string(list_slice(list_sort(list_distinct(list(p_type))), 1, 4), ', ') AS names
     FROM (SELECT p_size, p_type, min(p_partkey) OVER (PARTITION BY p_name) AS entry FROM part) GROUP BY p_size, entry) USING (raw) JOIN e USING (entry)
)
SELECT query, entry, score, matched, place_name, names,
  row_number() OVER (PARTITION BY query ORDER BY score DESC, matched = 'postcode', CASE WHEN matched <> 'postcode' THEN level_rank END, entry)::INTEGER AS place
FROM y WHERE level_rank IN (1, 2) QUALIFY place <= 10"""


@query(search_sql(ASKED_ALL).replace("asked(query)", "a AS (SELECT name AS alias, entry FROM u WHERE false), asked(query)", 1).rsplit("\nSELECT query, entry, score", 1)[0] + PLACES_SQL)
def unit_search(spark, sf_dir):
    """Names, places in units, codes and postcodes in one search."""
    part = Tables(spark, sf_dir).part
    units = name_units(Tables(spark, sf_dir))
    index = name_index(spark, sf_dir)
    inside = part.join(units.select("entry", F.col("name").alias("p_name")), "p_name").select("entry", "p_type", "p_size")
    places = inside.select(F.col("p_type").alias("place"), "entry", F.lit(None).cast("array<string>").alias("also")).distinct()
    postcodes = inside.groupBy((F.col("p_size") + 10000).cast("string").alias("postcode"), "entry").agg(F.array_sort(F.collect_set("p_type")).alias("names"))
    digits = names.padded_code(F.col("entry").cast("string"))
    codes = units.select(F.concat(F.substring(digits, 1, 5), F.lit("."), F.substring(digits, 6, 4)).alias("code"), digits.alias("digits"), "entry")
    found = textsearch.search_all(
        index, spark.createDataFrame([(a,) for a in ASKED_ALL], "query string"), codes, textsearch.attached_places(index, places, decompose=False),
        textsearch.attached_postcodes(index, postcodes), levels=[1, 2], placed_level=2, decompose=False,
    )
    return found.withColumn("names", F.array_join("names", ", "))


@query("""WITH c AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS digits, substr(lpad(p_partkey::VARCHAR, 9, '0'), 1, 5) || '.' || substr(lpad(p_partkey::VARCHAR, 9, '0'), 6) AS code FROM part),
q(query) AS (VALUES ('7'), ('000000012'), ('00000.0015'), (' 19 '), ('abc'), ('1.2'))
SELECT DISTINCT query, code FROM q JOIN c ON regexp_full_match(trim(query), '[0-9][0-9.]*') AND (trim(query) = code OR (NOT contains(query, '.') AND ltrim(trim(query), '0') = ltrim(digits, '0')))""")
def code_search(spark, sf_dir):
    digits = names.padded_code(F.col("p_partkey").cast("string"))
    codes = Tables(spark, sf_dir).part.select(F.concat(F.substring(digits, 1, 5), F.lit("."), F.substring(digits, 6, 4)).alias("code"), digits.alias("digits"))
    return textsearch.by_code(codes, spark.createDataFrame([(q,) for q in ("7", "000000012", "00000.0015", " 19 ", "abc", "1.2")], "query string"))


@query("""SELECT p_partkey AS code, levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type), 1) AS apart,
  1.0::DOUBLE - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type), 1) AS close FROM part""")
def letters_apart(spark, sf_dir):
    a, b = F.col("p_name"), F.col("p_type")
    close = F.lit(1.0) - names.letters_apart_share(a, b)
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("code"), names.letters_apart_share(a, b).alias("apart"), close.alias("close"))


@query(f"""SELECT p_partkey AS code, trim(regexp_replace(regexp_replace(lower(replace(p_name, ' ', '--')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
  len(list_distinct({GRAMS.format(s="(' ' || replace(p_name, ' ', '') || ' ')")})) AS grams, substr(sha256(p_partkey || '|' || p_name), 1, 12) AS id, ('0x' || substr(sha256(p_partkey || ':' || p_name), 1, 8))::BIGINT AS seed,
  trim(regexp_replace(translate(lower(p_type), '‘’()%.:·', '''''      '), '\\s+', ' ', 'g')) AS term FROM part""")
def name_keys(spark, sf_dir):
    """Slugs, padded trigrams, ids, seeds and term keys of names."""
    code = F.col("p_partkey").cast("string")
    slug = names.slugify(F.replace("p_name", F.lit(" "), F.lit("--")), decompose=False)
    return Tables(spark, sf_dir).part.select(
        F.col("p_partkey").alias("code"), slug.alias("slug"), F.size(names.padded_grams(F.replace("p_name", F.lit(" "), F.lit("-")))).cast("long").alias("grams"),
        names.short_id(code, F.col("p_name")).alias("id"), names.seed_of(code, F.col("p_name")).alias("seed"), names.term_key(F.col("p_type")).alias("term"),
    )


@query()
def folded_names(spark, sf_dir):
    """Words of documents in several languages, folded, with their consonants."""
    words = Tables(spark, sf_dir).documents.select("doc_id", F.explode(F.split("text", r"\s+")).alias("word")).select("word").distinct()
    folded = words.withColumn("name", names.normalise(F.col("word")))
    return folded.select("word", "name", names.skeleton(F.col("name")).alias("bones"))
