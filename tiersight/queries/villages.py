"""Villages, pickers, inherited names, postcodes and checks of areas, borders and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiersight.functions import numbers
from tiersight.functions import text as names
from tiersight.operators import records, stored, textsearch, validators
from tiersight.queries.base import Tables, query

ASKED = ["lav", "almond", "red", "ro", "pnk", "rose pink", "oliv", "zz", "ta"]
ASKED_SQL = ", ".join(f"('{a}')" for a in ASKED)
KEY_SQL = "translate({0}, 'aeiou ', '')"


@query(f"""WITH e AS (SELECT p_name AS code, p_name AS latin, {KEY_SQL.format('p_name')} AS key, max(p_size) AS people FROM part GROUP BY p_name), q(query) AS (VALUES {ASKED_SQL}), k AS (SELECT query, {KEY_SQL.format('query')} AS w FROM q),
x AS (SELECT query, code, people, CASE WHEN w <> '' AND key = w THEN 0 WHEN length(w) >= 2 AND starts_with(key, w) THEN 1 WHEN length(query) >= 3 AND contains(latin, query) THEN 2 END AS base,
  levenshtein(replace(replace(query, ' ', ''), 'ou', 'w'), replace(replace(latin, ' ', ''), 'ou', 'w'))::DOUBLE / greatest(length(replace(replace(query, ' ', ''), 'ou', 'w')), length(replace(replace(latin, ' ', ''), 'ou', 'w')), 1) AS near FROM e, k),
r AS (SELECT query, code, (CASE WHEN near <= 0.34 THEN least(base, 0) - 1 ELSE base END)::INTEGER AS rank, near, people FROM x WHERE base IS NOT NULL),
o AS (SELECT *, count(*) OVER (PARTITION BY query) AS total, row_number() OVER (PARTITION BY query ORDER BY rank, near, people DESC, code)::INTEGER AS place FROM r)
SELECT query, code, rank, near, total, place FROM o WHERE place <= 10""")
def village_search(spark, sf_dir):
    """Village names by key, by a key's beginning and by letters inside, over a written index."""
    part = Tables(spark, sf_dir).part
    key = lambda c: F.array(F.translate(c, "aeiou ", ""))

    def make():
        entries = part.groupBy(F.col("p_name").alias("latin")).agg(F.max("p_size").alias("people"))
        entries = entries.select(F.col("latin").alias("code"), F.lit("").alias("arabic"), "latin", key("latin").alias("keys"), "people")
        return textsearch.village_tables(textsearch.village_index(entries))

    index = textsearch.stored_villages(stored.kept(spark, "villages", stored.fingerprint(part), make))
    asked = spark.createDataFrame([(a,) for a in ASKED], "query string")
    return textsearch.villages(index, asked.select("query", key("query").alias("keys")))


@query(f"""WITH u AS (SELECT c_custkey AS code, lower(c_mktsegment || ' ' || c_name) AS name, translate(lower(c_mktsegment), 'aeiou', '') AS bones, c_acctbal AS people FROM customer), q(query) AS (VALUES ('building'), ('house'), ('customer'), ('bld'), ('fu'), ('9'), ('furniture customer'), ('zz'), ('stomer')),
t AS (SELECT query, code, people, CASE WHEN name = query THEN 0 WHEN starts_with(name, query) THEN 1 WHEN len(list_filter(string_split(name, ' '), lambda w: starts_with(w, query))) > 0 THEN 2
  WHEN length(translate(query, 'aeiou', '')) >= 2 AND starts_with(bones, translate(query, 'aeiou', '')) THEN 3 WHEN length(query) >= 3 AND contains(name, query) THEN 4 END::INTEGER AS tier FROM u, q),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, people DESC, code)::INTEGER AS place FROM t WHERE tier IS NOT NULL) SELECT query, code, tier, place FROM o WHERE place <= 8""")
def unit_picker(spark, sf_dir):
    bones = lambda c: F.translate(c, "aeiou", "")
    segment = F.lower("c_mktsegment")
    units = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("code"), F.concat_ws(" ", segment, F.lower("c_name")).alias("name"), F.lit(None).cast("string").alias("arabic"), bones(segment).alias("bones"), F.col("c_acctbal").alias("people"))
    asked = spark.createDataFrame([(a,) for a in ("building", "house", "customer", "bld", "fu", "9", "furniture customer", "zz", "stomer")], "query string")
    return textsearch.picked(units, asked.select("query", bones("query").alias("bones")))


@query("SELECT c_custkey AS code, c_acctbal AS balance, c_nationkey AS grp FROM customer WHERE c_nationkey = 7")
def group_members(spark, sf_dir):
    """A group's rows, with one figure."""
    t = Tables(spark, sf_dir)
    rows = t.customer.select(F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    return records.group_of(rows, t.nation.select(F.col("n_nationkey").alias("grp")), "grp", 7, ["balance"])


@query("""WITH n AS (SELECT s_nationkey AS place, s_suppkey % 3 AS key, arg_min(s_name, s_suppkey) AS latin FROM supplier GROUP BY ALL)
SELECT c_custkey AS code, c_nationkey AS place, c_custkey % 5 AS key, latin FROM customer LEFT JOIN n ON place = c_nationkey AND key = c_custkey % 5""")
def inherited_names(spark, sf_dir):
    t = Tables(spark, sf_dir)
    named = t.supplier.select(F.col("s_nationkey").alias("place"), (F.col("s_suppkey") % 3).alias("key"), F.col("s_name").alias("latin"), "s_suppkey")
    unnamed = t.customer.select(F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("place"), (F.col("c_custkey") % 5).alias("key"))
    return records.inherited_names(unnamed, named, "place", "key", "latin", "s_suppkey")


@query("""WITH named AS (SELECT lpad((c_custkey % 300)::VARCHAR, CASE WHEN c_custkey % 7 = 0 THEN 4 ELSE 5 END, '1') AS postcode, 'n' || c_nationkey AS code, c_mktsegment AS name FROM customer),
loc AS (SELECT lpad((s_suppkey % 50)::VARCHAR, 5, '2') AS postcode, r_name AS province, CASE WHEN s_suppkey % 4 = 0 THEN 'elsewhere' ELSE n_name END AS locality FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
placed AS (SELECT loc.postcode, 'n' || n_nationkey AS code, NULL AS name FROM loc JOIN region r ON r_name = province JOIN nation ON n_regionkey = r_regionkey AND n_name = locality),
a AS (SELECT * FROM named UNION ALL SELECT * FROM placed) SELECT postcode, code, coalesce(list_sort(list(DISTINCT name) FILTER (name IS NOT NULL)), []) AS names FROM a WHERE regexp_full_match(postcode, '[0-9]{5}') GROUP BY ALL""")
def postcode_units(spark, sf_dir):
    """Postcodes with the units and names they are of, from two lists."""
    t = Tables(spark, sf_dir)
    code = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    long = F.lpad((F.col("c_custkey") % 300).cast("string"), 5, "1")
    named = t.customer.select(F.when(F.col("c_custkey") % 7 == 0, F.lpad((F.col("c_custkey") % 300).cast("string"), 4, "1")).otherwise(long).alias("postcode"), code("c_nationkey").alias("code"), F.col("c_mktsegment").alias("name"))
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    localities = t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lpad((F.col("s_suppkey") % 50).cast("string"), 5, "2").alias("postcode"), F.col("r_name").alias("province"), F.when(F.col("s_suppkey") % 4 == 0, "elsewhere").otherwise(F.col("n_name")).alias("locality"))
    provinces = t.region.select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("name"))
    units = t.nation.select(code("n_nationkey").alias("code"), F.col("n_regionkey").alias("province"), F.col("n_name").alias("name"))
    return records.postcodes(named, localities, provinces, units)


@query("""SELECT c_mktsegment AS level, 'm' || c_nationkey % 3 AS measure, sum(c_nationkey - c_custkey)::DOUBLE / count(*)::DOUBLE AS change FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 GROUP BY ALL""")
def mean_changes(spark, sf_dir):
    k = F.col("c_custkey")
    facts = Tables(spark, sf_dir).customer.select(F.col("c_mktsegment").alias("level"), F.when(k % 4 == 0, "crosswalk").when(k % 4 == 1, "code").alias("basis"), F.concat(F.lit("m"), (F.col("c_nationkey") % 3).cast("string")).alias("measure"), F.when(k % 5 != 0, k).alias("before"), F.col("c_nationkey").alias("after"))
    return records.mean_changes(facts)


@query("""WITH c AS (SELECT l_orderkey AS code, sum(l_quantity::DECIMAL(12,2)) AS covered FROM lineitem GROUP BY 1), p AS (SELECT o_orderkey AS code, coalesce(covered, 0)::DECIMAL(12,2) + o_orderkey % 5 AS area FROM orders LEFT JOIN c ON code = o_orderkey)
SELECT 'area not covered' AS "check", code::VARCHAR AS code, covered::VARCHAR AS detail FROM p JOIN c USING (code) WHERE abs(covered - area) > area * 0.010::DECIMAL(4,3)""")
def area_check(spark, sf_dir):
    """Parents that their children don't cover within a hundredth."""
    t = Tables(spark, sf_dir)
    children = t.lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_quantity").cast("decimal(12,2)").alias("area"))
    sums = children.groupBy(F.col("parent").alias("code")).agg(F.sum("area").alias("a"))
    parents = t.orders.select(F.col("o_orderkey").alias("code")).join(sums, "code", "left").select("code", (F.coalesce("a", F.lit(0).cast("decimal(12,2)")).cast("decimal(12,2)") + F.col("code") % 5).cast("decimal(18,2)").alias("area"))
    return validators.uncovered_area(parents, children)


@query("""SELECT 'not connected' AS "check", (CASE WHEN r = 0 THEN 0 ELSE r END)::VARCHAR AS code, NULL::VARCHAR AS detail FROM (SELECT DISTINCT c_custkey % 4 AS r FROM customer WHERE c_custkey >= 4) WHERE r > 0""")
def border_parts(spark, sf_dir):
    """Chains of every fourth customer, which no border joins."""
    edges = Tables(spark, sf_dir).customer.where("c_custkey >= 4").select((F.col("c_custkey") - 4).alias("a"), F.col("c_custkey").alias("b"))
    return validators.in_parts(edges)


@query("""WITH r AS (SELECT s_suppkey AS code, unnest(['name', 'balance']) AS figure, unnest([true, s_suppkey % 2 = 0]) AS there, unnest(['registry', CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'census' WHEN 2 THEN 'rumour' ELSE NULL END]) AS source FROM supplier)
SELECT 'no source' AS "check", code::VARCHAR AS code, figure AS detail FROM r WHERE there AND source IS NULL UNION ALL SELECT 'unknown source', code::VARCHAR, source FROM r WHERE source = 'rumour'""")
def source_check(spark, sf_dir):
    k = F.col("s_suppkey")
    records_ = Tables(spark, sf_dir).supplier.select(k.alias("code"), F.col("s_name").alias("name"), F.lit("registry").alias("name_source"), F.when(k % 2 == 0, F.col("s_acctbal")).alias("balance"), F.when(k % 4 == 1, "census").when(k % 4 == 2, "rumour").alias("balance_source"))
    known = spark.createDataFrame([("registry",), ("census",)], "id string")
    return validators.unsourced(records_, {"name": "name_source", "balance": "balance_source"}, known)


@query(r"""WITH a AS (SELECT c_custkey AS code, CASE c_custkey % 4 WHEN 0 THEN 'rue 5 DOUAR ' || c_name || ' cr ' || c_mktsegment WHEN 1 THEN 'douar  ' || c_name WHEN 2 THEN c_name || ' ville' ELSE 'Douar ' || c_name || ' C/R x commune y' END AS address FROM customer)
SELECT code, CASE WHEN code % 4 <> 2 THEN (SELECT c_name FROM customer WHERE c_custkey = code) END AS village FROM a""")
def address_villages(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    address = F.when(k % 4 == 0, F.concat(F.lit("rue 5 DOUAR "), name, F.lit(" cr "), "c_mktsegment")).when(k % 4 == 1, F.concat(F.lit("douar  "), name)).when(k % 4 == 2, F.concat(name, F.lit(" ville"))).otherwise(F.concat(F.lit("Douar "), name, F.lit(" C/R x commune y")))
    return Tables(spark, sf_dir).customer.select(k.alias("code"), names.village_in(address).alias("village"))


NICE_SQL = ", ".join(f"{n}::DOUBLE" for n in numbers.NICE)


@query(f"""WITH p AS (SELECT s_suppkey AS code, s_acctbal AS x, CASE WHEN s_acctbal > 0 THEN pow(10.0::DOUBLE, floor(log10(s_acctbal))) END AS power FROM supplier)
SELECT code, CASE WHEN x <= 0 THEN 1.0::DOUBLE ELSE floor(list_filter([{NICE_SQL}], lambda n: n * power >= x - 1e-9)[1] * power * 1e6 + 0.5) / 1e6 END AS top FROM p""")
def axis_tops(spark, sf_dir):
    return Tables(spark, sf_dir).supplier.select(F.col("s_suppkey").alias("code"), numbers.nice_top(F.col("s_acctbal")).alias("top"))
