"""Names from several lists, links between measures, and small functions over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tiersight.functions import text as names
from tiersight.functions.numbers import half_up
from tiersight.operators import demand, gazetteers, links, matching, ranks, spellings
from tiersight.queries.base import Tables, query


def measure_facts(t: Tables):
    k = F.col("c_custkey")
    values = {"a.balance": F.col("c_acctbal"), "b.nation": F.col("c_nationkey").cast("double"), "c.key": (k % 97).cast("double"), "d.mod": (k * 31 % 53).cast("double"), "e.square": ((k % 11) * (k % 11)).cast("double"), "f.sum": (k % 97 + k % 5 * 8).cast("double")}
    wide = t.customer.select(k.alias("code"), *[v.alias(n) for n, v in values.items()])
    return wide.unpivot(["code"], [f"`{n}`" for n in values], "measure", "value")


VALUES_SQL = """v AS (SELECT c_custkey AS code, c_nationkey AS grp, c_acctbal AS "a.balance", c_nationkey::DOUBLE AS "b.nation", (c_custkey % 97)::DOUBLE AS "c.key", (c_custkey * 31 % 53)::DOUBLE AS "d.mod", ((c_custkey % 11) * (c_custkey % 11))::DOUBLE AS "e.square", (c_custkey % 97 + c_custkey % 5 * 8)::DOUBLE AS "f.sum" FROM customer),
f AS (UNPIVOT v ON "a.balance", "b.nation", "c.key", "d.mod", "e.square", "f.sum" INTO NAME measure VALUE value)"""
TESTS = [("t1", "c.key", "f.sum", "positive", 1), ("t2", "a.balance", "b.nation", "negative", 2), ("t3", "d.mod", "e.square", "positive", 3)]
TESTS_SQL = "t(id, x, y, direction, seed) AS (VALUES " + ", ".join(map(str, TESTS)) + ")"


@query(f"""WITH {VALUES_SQL}, {TESTS_SQL}, m(measure, topic) AS (VALUES ('a.balance', 'a'), ('b.nation', 'b'), ('c.key', 'c'), ('d.mod', 'd'), ('e.square', 'e'), ('f.sum', 'f')),
d AS (SELECT id, measure, row_number() OVER (PARTITION BY id ORDER BY md5(seed || ':' || measure), measure) AS k FROM t, m WHERE topic <> substr(x, 1, 1) AND topic <> substr(y, 1, 1)),
q AS (SELECT id, 0 AS k, x, y FROM t UNION ALL SELECT id, k, measure, y FROM d JOIN t USING (id) WHERE k <= 3),
p AS (SELECT id, k, a.value AS xv, b.value AS yv FROM q JOIN f a ON a.measure = q.x JOIN f b ON b.measure = q.y AND b.code = a.code),
r AS (SELECT id, k, 2 * rank() OVER (PARTITION BY id, k ORDER BY xv) + count(*) OVER (PARTITION BY id, k, xv) - 1 AS a, 2 * rank() OVER (PARTITION BY id, k ORDER BY yv) + count(*) OVER (PARTITION BY id, k, yv) - 1 AS b FROM p),
s AS (SELECT id, k, count(*) AS n, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, sum(a * a)::DOUBLE AS aa, sum(b * b)::DOUBLE AS bb, sum(a * b)::DOUBLE AS ab FROM r GROUP BY ALL),
c AS (SELECT id, k, n, (n::DOUBLE * ab - a * b) / sqrt((n::DOUBLE * aa - a * a) * (n::DOUBLE * bb - b * b)) AS rho FROM s)
SELECT c.id, c.n, c.rho, CASE WHEN direction = 'positive' THEN c.rho > 0 ELSE c.rho < 0 END AS held, (SELECT list(rho ORDER BY rho) FROM c o WHERE o.id = c.id AND o.k > 0) AS placebos, NULL::VARCHAR AS refused FROM c JOIN t USING (id) WHERE c.k = 0""")
def link_together(spark, sf_dir):
    facts = measure_facts(Tables(spark, sf_dir))
    tests = spark.createDataFrame(TESTS, "id string, x string, y string, direction string, seed long")
    measures = spark.createDataFrame([(m, m[0], m[0]) for m in ("a.balance", "b.nation", "c.key", "d.mod", "e.square", "f.sum")], "measure string, topic string, family string")
    return links.together(tests, facts, links.placebos(tests, measures))


@query(f"""WITH {VALUES_SQL}, {TESTS_SQL}, p AS (SELECT id, a.code, g.grp, a.value AS xv, b.value AS yv FROM t JOIN f a ON a.measure = t.x JOIN f b ON b.measure = t.y AND b.code = a.code JOIN v g ON g.code = a.code),
m AS (SELECT id, grp, median(xv) AS middle FROM p GROUP BY ALL), s AS (SELECT id, yv, xv > middle AS first FROM p JOIN m USING (id, grp) WHERE xv <> middle)
SELECT id, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, floor((median(yv) FILTER (first) - median(yv) FILTER (NOT first)) * 10000 + 0.5) / 10000 AS effect FROM s GROUP BY id""")
def link_peers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tests = spark.createDataFrame([x[:4] for x in TESTS], "id string, x string, y string, direction string")
    out = links.peers(tests, measure_facts(t), t.customer.select(F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("grp")))
    return out.select("id", "n1", "n2", half_up(F.col("effect"), 4).alias("effect"))


@query(r"""WITH p AS (SELECT p_partkey AS code, '/api/' || split_part(p_type, ' ', 1) || '/' || p_partkey || '/x?y=' || p_size AS path FROM part)
SELECT code, regexp_replace(regexp_replace(path, '\?.*$', ''), '/(?:\d[\d.]*|[a-z0-9]+(?:-[a-z0-9]+)*-\d+)(/|$)', '/:id\1', 'g') AS route, CASE WHEN code % 3 = 0 THEN 'ar' WHEN code % 3 = 1 THEN 'en' ELSE 'fr' END AS locale FROM p""")
def request_routes(spark, sf_dir):
    path = F.concat(F.lit("/api/"), F.substring_index("p_type", " ", 1), F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/x?y="), F.col("p_size").cast("string"))
    prefix = F.when(F.col("p_partkey") % 3 == 0, "/ar/x").when(F.col("p_partkey") % 3 == 1, "/en").otherwise("/data/x")
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("code"), names.route(path).alias("route"), names.locale_of(prefix).alias("locale"))


@query("""WITH b AS (SELECT o_orderkey AS id, o_orderkey % 3 AS k, o_orderpriority AS tool FROM orders)
SELECT id, unnest(CASE WHEN k = 0 THEN ['tools/call'] WHEN k = 1 THEN ['tools/list', 'tools/call'] ELSE []::VARCHAR[] END) AS method, unnest(CASE WHEN k = 0 THEN [tool] WHEN k = 1 THEN [NULL, tool] ELSE []::VARCHAR[] END) AS tool FROM b""")
def rpc_messages(spark, sf_dir):
    """Methods and tools in JSON-RPC bodies, single and in batches."""
    tool = F.concat(F.lit('{"method":"tools/call","params":{"name":"'), "o_orderpriority", F.lit('"}}'))
    body = F.when(F.col("o_orderkey") % 3 == 0, tool).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('[{"method":"tools/list"},'), tool, F.lit("]"))).otherwise("{}")
    return demand.messages(Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("id"), body.alias("body")))


@query("""WITH d AS (SELECT event_id, ts::DATE AS day, user_id FROM events) SELECT user_id, strftime(min(day), '%Y-%m-%d') AS first, strftime(max(day), '%Y-%m-%d') AS last, count(DISTINCT day) AS days, count(*) FILTER (day >= (SELECT max(day) - 7 FROM d)) AS recent FROM d GROUP BY 1""")
def day_spans(spark, sf_dir):
    """First and last day, days seen, and the last week, in UTC."""
    rows = Tables(spark, sf_dir).events.select("user_id", F.to_date("ts").alias("day"))
    last = rows.agg(F.max("day").alias("latest"))
    rows = rows.join(F.broadcast(last))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.groupBy("user_id").agg(shown(F.min("day")).alias("first"), shown(F.max("day")).alias("last"), F.count_distinct("day").alias("days"), F.count_if(F.col("day") >= F.date_sub("latest", 7)).alias("recent"))


@query("""WITH n AS (SELECT n_name AS name, n_regionkey AS grp, n_nationkey AS code FROM nation), a AS (SELECT lower(replace(n_name, '_', '')) AS name, n_regionkey AS grp FROM nation)
SELECT upper(a.name) AS name, a.grp, n.code, CASE WHEN n.code IS NOT NULL THEN 'name' END AS by FROM a LEFT JOIN n ON a.grp = n.grp AND lower(replace(n.name, '_', '')) = a.name""")
def place_lookup(spark, sf_dir):
    nation = Tables(spark, sf_dir).nation
    units = nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("grp"))
    asked = nation.select(F.upper(F.replace("n_name", F.lit("_"), F.lit(""))).alias("name"), F.col("n_regionkey").alias("grp"))
    return gazetteers.looked_up(asked, units, decompose=False)


@query()
def merged_place_lists(spark, sf_dir):
    """Parts' names of even and odd keys as two lists of a city; the second's spellings go under the first's names."""
    part = Tables(spark, sf_dir).part
    rows = lambda odd, name: part.where(F.col("p_partkey") % 2 == odd).select(F.col("p_brand").alias("city"), name.alias("name"), (F.col("p_size") % 5).cast("string").alias("postcode")).distinct()
    return gazetteers.merged_lists(rows(0, F.col("p_name")), rows(1, F.regexp_replace("p_name", "e", "a")), decompose=False).select("city", "name", "list", F.array_join("also", ", ").alias("also"))


@query()
def bordering_names(spark, sf_dir):
    """Parts' names that a brand has of its own go to the brand beside it that is known to have them."""
    part = Tables(spark, sf_dir).part
    rows = part.select(F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("city"), F.concat_ws(" ", "p_name", "p_type").alias("name"), "p_partkey")
    located, added = rows.where("p_partkey % 2 = 0").select("city", "name"), rows.where("p_partkey % 2 = 1").select("city", "name")
    cities = rows.select(F.col("city").alias("a")).distinct()
    borders = cities.select("a", F.explode(F.array(F.col("a") - 1, F.col("a") + 1)).alias("b"))
    return gazetteers.spilled(added, located, borders, decompose=False)


@query()
def learned_spellings(spark, sf_dir):
    """Graphones learned from parts' names and their reversed alphabet; the best spelling of each name."""
    words = Tables(spark, sf_dir).part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = words.select(F.translate("w", letters, letters[::-1]).alias("source"), F.col("w").alias("target"))
    counts = spellings.ngram_counts(spellings.aligned(pairs, rounds=4), order=3)
    return spellings.spelled(pairs.select(F.col("source").alias("word")), counts, order=3, top=1)


@query("""WITH f AS (SELECT o_custkey AS id, max(o_totalprice) AS v FROM orders GROUP BY 1), r AS (SELECT c_custkey AS code, c_name AS name, coalesce(v, 0) AS value, c_mktsegment AS measure FROM customer LEFT JOIN f ON id = c_custkey)
SELECT code, 'In ' || name || ', ' || lower(measure) || ' stands at ' || floor(value)::BIGINT || CASE WHEN value > 200000 THEN ', among the highest.' ELSE '.' END AS en, name || ' : ' || lower(measure) || ', ' || floor(value)::BIGINT || CASE WHEN value > 200000 THEN ', parmi les plus hauts.' ELSE '.' END AS fr FROM r""")
def finding_sentences(spark, sf_dir):
    """A sentence for each finding in each language."""
    t = Tables(spark, sf_dir)
    top = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    rows = t.customer.join(top, "c_custkey", "left").withColumn("value", F.coalesce("v", F.lit(0.0)))
    whole, high = F.floor("value").cast("string"), F.col("value") > 200000
    en = F.concat(F.lit("In "), "c_name", F.lit(", "), F.lower("c_mktsegment"), F.lit(" stands at "), whole, F.when(high, ", among the highest.").otherwise("."))
    fr = F.concat("c_name", F.lit(" : "), F.lower("c_mktsegment"), F.lit(", "), whole, F.when(high, ", parmi les plus hauts.").otherwise("."))
    return rows.select(F.col("c_custkey").alias("code"), en.alias("en"), fr.alias("fr"))


@query("""WITH p AS (SELECT p_brand AS unit, lower(p_name) AS name, p_partkey AS k FROM part WHERE p_name NOT LIKE 'a%') SELECT unit, name, min(k) AS k FROM p GROUP BY ALL""")
def place_list(spark, sf_dir):
    """Places without street-like names, the first of each unit and name."""
    rows = Tables(spark, sf_dir).part.select(F.col("p_brand").alias("unit"), F.lower("p_name").alias("name"), F.col("p_partkey").alias("k"))
    return ranks.best_of(rows.where(~F.col("name").rlike("^a")), ["unit", "name"], [F.asc("k")])


@query("""WITH e AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier), x AS (SELECT a, b, abs(sa.s_acctbal - sb.s_acctbal) AS gap FROM e JOIN supplier sa ON sa.s_suppkey = a JOIN supplier sb ON sb.s_suppkey = b), s AS (SELECT a, gap, b FROM x UNION ALL SELECT b, gap, a FROM x)
SELECT a AS code, arg_max(b, gap * 1000000000.0 - b) AS neighbour, max(gap) AS gap FROM s GROUP BY 1 HAVING max(gap) >= 3000""")
def neighbour_gaps(spark, sf_dir):
    """The neighbour whose share is furthest, where it is far."""
    t = Tables(spark, sf_dir)
    value = t.supplier.select(F.col("s_suppkey").alias("code"), F.col("s_acctbal").alias("v"))
    edges = matching.both_ways(t.supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b")))
    pairs = edges.join(value.toDF("a", "va"), "a").join(value.toDF("b", "vb"), "b").withColumn("gap", F.abs(F.col("va") - F.col("vb")))
    return pairs.groupBy(F.col("a").alias("code")).agg(F.max_by("b", F.struct("gap", -F.col("b"))).alias("neighbour"), F.max("gap").alias("gap")).where("gap >= 3000")


@query("""WITH u AS (SELECT s_suppkey AS code, s_suppkey % 900 AS population, s_suppkey % 17 = 0 AS flagged FROM supplier), s AS (SELECT * FROM u WHERE population >= 50 AND NOT flagged),
f AS (SELECT s_suppkey AS code, unnest(['balance', 'key', 'nation']) AS path, unnest([floor(s_acctbal / 100), (s_suppkey * 37 % 101)::DOUBLE, CASE WHEN s_nationkey <> 3 THEN s_nationkey * 4.0::DOUBLE END]) AS value FROM supplier), v AS (SELECT f.* FROM f JOIN s USING (code) WHERE value IS NOT NULL),
e AS (SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON y.s_suppkey IN (x.s_suppkey - 3, x.s_suppkey - 1, x.s_suppkey + 1, x.s_suppkey + 3)),
g AS (SELECT a, b, x.path, x.value AS here, y.value AS there, floor(abs(x.value - y.value) * 10 + 0.5) / 10 AS gap FROM e JOIN v x ON x.code = a JOIN v y ON y.code = b AND y.path = x.path)
SELECT a AS code, b AS neighbour, path, here, there, gap FROM g WHERE gap >= 30 QUALIFY row_number() OVER (PARTITION BY a ORDER BY gap DESC, path, b) = 1""")
def widest_gaps(spark, sf_dir):
    """The figure on which a supplier is furthest from one that borders it."""
    rows = Tables(spark, sf_dir).supplier
    key = F.col("s_suppkey")
    units = rows.select(key.alias("code"), (key % 900).alias("population"), (key % 17 == 0).alias("flagged"))
    wide = rows.select(key.alias("code"), F.floor(F.col("s_acctbal") / 100).cast("double").alias("balance"), (key * 37 % 101).cast("double").alias("key"), F.when(F.col("s_nationkey") != 3, F.col("s_nationkey") * F.lit(4.0)).alias("nation"))
    edges = rows.select(key.alias("a"), F.explode(F.array(key + 1, key + 3)).alias("b"))
    return matching.widest_gap(units, matching.both_ways(edges), wide.unpivot(["code"], ["balance", "key", "nation"], "path", "value"), 30, 50)


@query("""WITH p AS (SELECT p_partkey AS row, CASE WHEN p_partkey % 13 > 0 THEN p_brand END AS unit, CASE p_size % 10 WHEN 0 THEN 'Rue ' || p_name WHEN 1 THEN '' WHEN 2 THEN lower(p_type) WHEN 3 THEN upper(p_name) ELSE p_name END AS fr FROM part),
u AS (SELECT p_brand AS unit, min(p_type) AS fr FROM part GROUP BY 1), j AS (SELECT p.*, u.fr AS own FROM p LEFT JOIN u USING (unit)),
s AS (SELECT row, unit, fr, CASE WHEN fr = '' THEN 'unnamed' WHEN fr LIKE 'Rue %' THEN 'street' WHEN own IS NULL THEN 'outside' WHEN lower(fr) = lower(own) THEN 'unit' END AS state FROM j)
SELECT row, unit, fr, coalesce(state, CASE WHEN row = min(row) OVER (PARTITION BY unit, lower(fr), state) THEN 'kept' ELSE 'repeat' END) AS state FROM s""")
def place_states(spark, sf_dir):
    """What becomes of each place of a list: parts as places of their brands."""
    part = Tables(spark, sf_dir).part
    cases = F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("Rue "), "p_name")).when(F.col("p_size") % 10 == 1, "").when(F.col("p_size") % 10 == 2, F.lower("p_type")).when(F.col("p_size") % 10 == 3, F.upper("p_name")).otherwise(F.col("p_name"))
    none = F.lit(None).cast("string").alias("ar")
    places = part.select(F.col("p_partkey").alias("row"), F.when(F.col("p_partkey") % 13 > 0, F.col("p_brand")).alias("unit"), cases.alias("fr"), none)
    units = part.groupBy(F.col("p_brand").alias("code")).agg(F.min("p_type").alias("fr")).select("code", "fr", none)
    return gazetteers.place_states(places, units, decompose=False).select("row", "unit", "fr", "state")


@query("""SELECT proposer, finding, id, row_number() OVER (PARTITION BY proposer, finding ORDER BY score DESC, id) AS place FROM (SELECT p_brand AS proposer, p_size % 5 AS finding, p_partkey AS id, p_retailprice AS score FROM part WHERE p_size > 25)""")
def rank_among_passing(spark, sf_dir):
    rows = Tables(spark, sf_dir).part.where("p_size > 25").select(F.col("p_brand").alias("proposer"), (F.col("p_size") % 5).alias("finding"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    place = F.row_number().over(Window.partitionBy("proposer", "finding").orderBy(F.desc("score"), "id"))
    return rows.select("proposer", "finding", "id", place.cast("long").alias("place"))
