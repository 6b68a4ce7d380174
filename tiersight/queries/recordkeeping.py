"""Records of units."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiersight.functions.text import padded_grams
from tiersight.operators import alike, matching, places, records
from tiersight.queries.base import Tables, query
from tiersight.queries.geography import square_sides
from tiersight.queries.joins import DICE_SQL, grams_sql


@query("""SELECT c_custkey AS code, CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END ELSE c_nationkey::DOUBLE END AS value FROM customer""")
def figure_by_path(spark, sf_dir):
    """A figure at a path, from people's topics and else from homes'."""
    k = F.col("c_custkey")
    people = F.when(k % 3 != 0, F.create_map(F.lit("age"), F.create_map(F.lit("old"), F.when(k % 2 == 0, F.col("c_acctbal")))))
    homes = F.create_map(F.lit("age"), F.create_map(F.lit("old"), F.col("c_nationkey").cast("double")))
    rows = Tables(spark, sf_dir).customer.select(k.alias("code"), F.coalesce(people, F.create_map().cast("map<string,map<string,double>>")).alias("people"), homes.alias("homes"))
    return rows.select("code", records.by_path(F.col("people"), F.col("homes"), "age.old").alias("value"))


@query("""SELECT l_orderkey AS code, l_returnflag || '.' || l_linestatus AS path, l_linestatus AS area, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag END AS sex, sum(l_quantity::BIGINT)::BIGINT AS value FROM lineitem
WHERE l_returnflag IN ('A', 'N') AND l_linestatus = 'F' AND (l_returnflag = 'A' OR l_returnflag IN ('N')) GROUP BY ALL""")
def sub_cube(spark, sf_dir):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    facts = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_orderkey").alias("code"), F.concat(flag, F.lit("."), status).alias("path"), status.alias("area"), F.when(flag != "A", flag).alias("sex")).agg(F.sum(F.col("l_quantity").cast("long")).alias("value"))
    return records.sub_cube(facts.withColumn("period", F.lit("now")), topics=["A", "N"], areas=["F"], sexes=["N"], periods=["now"]).drop("period")


@query("""WITH c AS (SELECT l_orderkey AS code, l_returnflag AS topic, l_linenumber AS key, CASE WHEN l_partkey % 2 = 0 THEN 'n/a' END AS reason FROM lineitem),
a AS (SELECT *, bool_or(reason IS NULL OR reason <> 'n/a') OVER (PARTITION BY code, topic) AS a FROM c) SELECT code, topic, count(*) AS cells, count(reason) AS marked FROM a WHERE a GROUP BY ALL""")
def applicable_blocks(spark, sf_dir):
    cells = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("code"), F.col("l_returnflag").alias("topic"), F.when(F.col("l_partkey") % 2 == 0, "n/a").alias("reason"))
    return records.applicable(cells, ["code", "topic"]).groupBy("code", "topic").agg(F.count("*").alias("cells"), F.count("reason").alias("marked"))


@query("""SELECT p_partkey AS code, p_size * 40 >= 300 AND p_partkey <= p_size * 40 * 8 AS ordinary, p_partkey >= 500 AND abs(p_size * 15) <= 500 AS rateable, p_brand NOT LIKE 'economy.%' AND p_size * 100 >= 2000 AS sampled, p_size % 2 = 0 AND p_size % 3 = 0 AS withheld FROM part""")
def record_predicates(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    held = records.withheld([F.when(size % 2 != 0, size), F.when(size % 3 != 0, size)])
    return Tables(spark, sf_dir).part.select(key.alias("code"), records.ordinary(key, size * 40).alias("ordinary"), records.rateable(key, size * 15).alias("rateable"), records.sampled(F.col("p_brand"), size * 100).alias("sampled"), held.alias("withheld"))


@query("""WITH u AS (SELECT c_custkey AS code, c_custkey AS population, (c_custkey * 7) % 900 AS households FROM customer) SELECT u.code, c_acctbal AS balance, CASE WHEN u.code % 10 <> 0 THEN c_nationkey::DOUBLE END AS nation
FROM u JOIN customer ON c_custkey = u.code WHERE households >= 300 AND population <= households * 8""")
def comparison_matrix(spark, sf_dir):
    k = F.col("c_custkey")
    customer = Tables(spark, sf_dir).customer
    units = customer.select(k.alias("code"), k.alias("population"), (k * 7 % 900).alias("households"))
    facts = customer.select(k.alias("code"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation")).unpivot(["code"], ["balance", "nation"], "measure", "value")
    flags = customer.where("c_custkey % 10 = 0").select(k.alias("code"), F.lit("nation").alias("measure"))
    return records.comparison_matrix(facts, units, flags, ["balance", "nation"])[0]


@query("SELECT n_nationkey AS code, n_name AS name, count(c_custkey) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def matched_both_ways(spark, sf_dir):
    t = Tables(spark, sf_dir)
    counts = t.customer.groupBy(F.col("c_nationkey").alias("code")).agg(F.count("*").alias("customers"))
    names = t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")).join(counts.select("code"), "code", "left_semi")
    return records.matched_both_ways(names, counts, "code")


LABELLED = ["Commune de ", "Préfecture d'arrondissements de la ", "Région  de l'", "PROVINCE Cercle du ", "Régional ", "communes "]
LABELLED_AR = ["جماعة ", "عمالة مقاطعات ", "إقليم جهة", "دائرة  ", "", "مقاطعة "]
LABELS_SQL = "".join(f" WHEN {i} THEN '{front.replace(chr(39), chr(39) * 2)}'" for i, front in enumerate(LABELLED))
LABELS_AR_SQL = "".join(f" WHEN {i} THEN '{front}'" for i, front in enumerate(LABELLED_AR))


@query(rf"""WITH n AS (SELECT c_custkey AS code, CASE c_custkey % 6{LABELS_SQL} END || c_name || CASE WHEN c_custkey % 4 = 0 THEN '**' ELSE '' END AS fr, CASE c_custkey % 6{LABELS_AR_SQL} END || c_name || '*' AS ar FROM customer)
SELECT code, trim(regexp_replace(trim(regexp_replace(fr, '\*+$', '')), '^((communes?|arrondissements?|cercles?|provinces?|préfectures?|régions?)\s+(de\s+la\s+|de\s+l''\s*|de\s+|du\s+|des\s+|d''\s*)?)+', '', 'i')) AS fr,
  trim(regexp_replace(trim(regexp_replace(ar, '\*+$', '')), '^((جهة|عمالة|إقليم|دائرة|جماعة|مقاطعات|مقاطعة)\s+)+', '')) AS ar FROM n""")
def stripped_labels(spark, sf_dir):
    """Names without the labels of their levels, in two scripts."""
    front = lambda texts: F.element_at(F.array(*map(F.lit, texts)), (F.col("c_custkey") % len(texts)).cast("int") + 1)
    marks = F.when(F.col("c_custkey") % 4 == 0, "**").otherwise("")
    rows = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("code"), F.concat(front(LABELLED), "c_name", marks).alias("fr"), F.concat(front(LABELLED_AR), "c_name", F.lit("*")).alias("ar"))
    return rows.select("code", records.stripped_label(F.col("fr")).alias("fr"), records.stripped_label_ar(F.col("ar")).alias("ar"))


@query(f"""WITH s AS (SELECT p_partkey AS code, p_size % 5 AS grp, ' ' || replace(p_name, ' ', '') || ' ' AS name FROM part), g AS (SELECT code, grp, {grams_sql('name')} AS g FROM s),
b AS (SELECT x.code AS l, y.code AS r, {DICE_SQL} AS score, row_number() OVER (PARTITION BY x.code ORDER BY {DICE_SQL} DESC, y.code) AS k FROM g x JOIN g y ON x.grp = y.grp AND x.code % 3 = 0 AND y.code % 3 = 1 WHERE {DICE_SQL} >= 0.6)
SELECT l AS "left", r AS "right", score FROM b WHERE k = 1""")
def best_within_parent(spark, sf_dir):
    """Each part's most alike one of the others in its group."""
    rows = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("code"), (F.col("p_size") % 5).alias("grp"), padded_grams(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("grams"))
    return alike.best_alike(rows.where("code % 3 = 0"), rows.where("code % 3 = 1"), 0.6)


@query()
def coverage_holes(spark, sf_dir):
    """The closed lines around groups of squares, of which each lacks every sixth; those that are holes."""
    edges = places.outlines(square_sides(Tables(spark, sf_dir)).withColumn("grp", F.floor(F.col("unit") / 50)))
    holes = records.coverage_holes(edges).select("grp", "ring", F.lit(True).alias("hole"))
    lines = records.outline_parts(edges).join(holes, ["grp", "ring"], "left")
    return lines.select("grp", "sides", "west", "south", "east", "north", F.coalesce("hole", F.lit(False)).alias("hole"))
