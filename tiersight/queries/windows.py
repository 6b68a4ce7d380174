"""Windows: ranks, tails, peers and what stands out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tiersight.operators import insights, ranks
from tiersight.queries.base import Tables, money, query

MEAN = "sum({v}) OVER ({w})::DOUBLE / count({v}) OVER ({w})::DOUBLE"


def moments_sql(v: str, by: str) -> tuple[str, str]:
    w = f"PARTITION BY {by}"
    n, mean = f"count({v}) OVER ({w})::DOUBLE", MEAN.format(v=v, w=w)
    spread = f"sqrt(greatest(sum({v} * {v}) OVER ({w})::DOUBLE / {n} - ({mean}) * ({mean}), 0.0))"
    return mean, f"CASE WHEN {spread} > 0 THEN {spread} END"


def metric_facts(t: Tables):
    """Suppliers' balance and customers' balance as whole cents, with a size."""
    s = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("code"), F.lit("supplier").alias("level"), F.lit("money.balance").alias("measure"), F.col("s_acctbal").cast("decimal(12,2)").alias("value"), (F.col("s_suppkey") % 100).cast("double").alias("size"))
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey"), F.lit("customer"), F.concat(F.lit("segment."), "c_mktsegment"), F.col("c_acctbal").cast("decimal(12,2)"), (F.col("c_custkey") % 100).cast("double"))
    return s.unionAll(c)


FACTS_SQL = """facts AS (
  SELECT 's' || s_suppkey AS code, 'supplier' AS level, 'money.balance' AS measure, s_acctbal::DECIMAL(12,2) AS value, (s_suppkey % 100)::DOUBLE AS size FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'customer', 'segment.' || c_mktsegment, c_acctbal::DECIMAL(12,2), (c_custkey % 100)::DOUBLE FROM customer
)"""
_M, _S = moments_sql("value", "measure")
EXTREMES_SQL = f"""{FACTS_SQL}, scored AS (
  SELECT *, {_M} AS mean, {_S} AS spread, greatest(1, floor(count(*) OVER (PARTITION BY measure) * 0.01 + 0.5)) AS tail,
    row_number() OVER (PARTITION BY measure ORDER BY value, code) AS low, row_number() OVER (PARTITION BY measure ORDER BY value DESC, code DESC) AS top
  FROM facts WHERE size >= 5 AND value IS NOT NULL
), extremes AS (
  SELECT substr(sha256(code || '|' || measure || '|extreme'), 1, 12) AS id, code, level, measure, 'extreme' AS kind, value::DOUBLE AS value, mean AS reference,
    abs(value::DOUBLE - mean) / spread AS score, CASE WHEN value::DOUBLE >= mean THEN 'high' ELSE 'low' END AS direction
  FROM scored WHERE spread IS NOT NULL AND (low <= tail OR top <= tail)
)"""


@query(f"WITH {EXTREMES_SQL} SELECT * FROM extremes")
def extreme_tails(spark, sf_dir):
    return insights.extremes(metric_facts(Tables(spark, sf_dir)), 5)


_CM, _CS = moments_sql("change", "level, measure")
CHANGES_SQL = f"""edges AS (
  SELECT DISTINCT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON x.c_nationkey = y.c_nationkey AND abs(x.c_custkey - y.c_custkey) BETWEEN 1 AND 40
), sides AS (
  SELECT o_custkey AS code, sum(o_totalprice::DECIMAL(18,2)) FILTER (year(o_orderdate) = 1995) AS before, sum(o_totalprice::DECIMAL(18,2)) FILTER (year(o_orderdate) = 1996) AS after,
    count(*) FILTER (year(o_orderdate) = 1995) AS size_before, count(*) FILTER (year(o_orderdate) = 1996) AS size_after FROM orders GROUP BY 1
), moved AS (
  SELECT code, 'customer' AS level, 'orders.total' AS measure, after - before AS change, size_before, size_after, code % 2 = 0 AS slow FROM sides WHERE before IS NOT NULL AND after IS NOT NULL
), scored AS (
  SELECT *, {_CM} AS mean, {_CS} AS spread, count(*) OVER (PARTITION BY level, measure) AS n FROM moved
), far AS (
  SELECT *, (change::DOUBLE - mean) / spread AS z FROM scored WHERE n >= 10 AND abs((change::DOUBLE - mean) / spread) >= 2.5
), judged AS (
  SELECT f.*, CASE WHEN slow AND size_before > 0 AND abs(size_after - size_before)::DOUBLE / size_before < 0.1 AND NOT EXISTS (
    SELECT 1 FROM edges e JOIN moved m ON m.code = e.b WHERE e.a = f.code AND sign(m.change) = sign(f.change) AND abs(m.change) * 2 >= abs(f.change)
  ) THEN 'artefact' ELSE 'change' END AS kind FROM far f
), changes AS (
  SELECT substr(sha256(code || '|' || measure || '|' || kind), 1, 12) AS id, code::VARCHAR AS code, level, measure, kind, change::DOUBLE AS value, 0.0::DOUBLE AS reference, abs(z) AS score,
    CASE WHEN change > 0 THEN 'high' ELSE 'low' END AS direction FROM judged
)"""


def customer_edges(t: Tables):
    """Customers of a nation whose numbers are close, as neighbours, both ways."""
    side = lambda n: t.customer.select("c_nationkey", F.col("c_custkey").alias(n), F.floor(F.col("c_custkey") / 41).alias(f"cell_{n}"))
    near = side("b").select("c_nationkey", "b", F.explode(F.array(*[F.col("cell_b") + k for k in (-1, 0, 1)])).alias("cell_a"))
    return side("a").join(near, ["c_nationkey", "cell_a"]).where(F.abs(F.col("a") - F.col("b")).between(1, 40)).select("a", "b")


def change_findings(t: Tables):
    year, price = F.year("o_orderdate"), F.col("o_totalprice").cast("decimal(18,2)")
    sides = t.orders.where(year.isin(1995, 1996)).groupBy(F.col("o_custkey").alias("code")).agg(
        F.sum(F.when(year == 1995, price)).cast("decimal(18,2)").alias("before"), F.sum(F.when(year == 1996, price)).cast("decimal(18,2)").alias("after"),
        F.count_if(year == 1995).alias("size_before"), F.count_if(year == 1996).alias("size_after"),
    )
    facts = sides.withColumns({"level": F.lit("customer"), "measure": F.lit("orders.total"), "slow": F.col("code") % 2 == 0})
    return insights.changes(facts, customer_edges(t), threshold=2.5).withColumn("code", F.col("code").cast("string"))


@query(f"WITH {CHANGES_SQL} SELECT * FROM changes")
def change_outliers(spark, sf_dir):
    return change_findings(Tables(spark, sf_dir))


_GM, _GS = moments_sql("diff", "parent, measure")
GAPS_SQL = f"""parents AS (
  SELECT p_brand AS parent, 'price' AS measure, (sum(p_retailprice::DECIMAL(18,2)) / count(*))::DECIMAL(12,2) AS parent_value FROM part GROUP BY 1
), diffs AS (
  SELECT 'p' || p_partkey AS code, 'part' AS level, p_brand AS parent, 'price' AS measure, p_retailprice::DECIMAL(12,2) AS value, parent_value, p_retailprice::DECIMAL(12,2) - parent_value AS diff
  FROM part JOIN parents ON p_brand = parents.parent
), scored AS (SELECT *, {_GM} AS mean, {_GS} AS spread, count(*) OVER (PARTITION BY parent, measure) AS n FROM diffs),
gaps AS (
  SELECT substr(sha256(code || '|price|gap'), 1, 12) AS id, code, level, measure, 'gap' AS kind, value::DOUBLE AS value, parent_value::DOUBLE AS reference, abs((diff::DOUBLE - mean) / spread) AS score,
    CASE WHEN diff > 0 THEN 'high' ELSE 'low' END AS direction FROM scored WHERE n >= 8 AND abs((diff::DOUBLE - mean) / spread) >= 1.5
)"""


@query(f"WITH {GAPS_SQL} SELECT * FROM gaps".replace("(sum(p_retailprice::DECIMAL(18,2)) / count(*))::DECIMAL(12,2)", "max(p_retailprice)::DECIMAL(12,2)"))
def parent_gaps(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    parents = part.groupBy(F.col("p_brand").alias("parent")).agg(F.max("p_retailprice").cast("decimal(12,2)").alias("parent_value")).withColumn("measure", F.lit("price"))
    children = part.select(F.concat(F.lit("p"), "p_partkey").alias("code"), F.lit("part").alias("level"), F.col("p_brand").alias("parent"), F.lit("price").alias("measure"), F.col("p_retailprice").cast("decimal(12,2)").alias("value"))
    return insights.gaps(children, parents, threshold=1.5)


@query(f"""WITH {EXTREMES_SQL}, wrong AS (SELECT 'c' || c_custkey AS code FROM customer WHERE c_acctbal < -900 OR c_custkey % 97 = 0),
turned AS (SELECT CASE WHEN w.code IS NOT NULL THEN substr(sha256(e.code || '|' || measure || '|artefact'), 1, 12) ELSE id END AS id, e.code, level, measure, CASE WHEN w.code IS NOT NULL THEN 'artefact' ELSE kind END AS kind, value, reference, score, direction
  FROM extremes e LEFT JOIN wrong w ON w.code = e.code),
per_unit AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY score DESC, id) AS k FROM turned)
SELECT id, code, level, measure, kind, value, reference, score, direction, CASE WHEN kind = 'artefact' THEN 'artefact' WHEN level <> 'customer' THEN 'not a customer' WHEN measure LIKE '%MACHINERY' THEN 'local' END AS dropped
FROM per_unit WHERE k <= 3 ORDER BY score DESC, id LIMIT 300""")
def ranked_findings(spark, sf_dir):
    """Implausible records as artefacts, the top of each unit, the report's length, and what isn't published."""
    t = Tables(spark, sf_dir)
    checks = {"balance": F.col("c_acctbal") < -900, "number": F.col("c_custkey") % 97 == 0}
    wrong = insights.implausible(t.customer.withColumn("code", F.concat(F.lit("c"), "c_custkey")), checks)
    top = insights.ranked(insights.with_artefacts(insights.extremes(metric_facts(t), 5), wrong))
    reasons = {"artefact": F.col("kind") == "artefact", "not a customer": F.col("level") != "customer", "local": F.col("measure").endswith("MACHINERY")}
    return insights.dropped(top, reasons)


@query("""WITH e AS (SELECT x.c_custkey AS a, y.c_custkey AS b, x.c_acctbal AS v, y.c_acctbal AS w FROM customer x JOIN customer y ON x.c_nationkey = y.c_nationkey AND abs(x.c_custkey - y.c_custkey) BETWEEN 1 AND 40)
SELECT a AS code, floor(median(w) * 10000 + 0.5) / 10000 AS middle, arg_max(b, abs(w - v) * 1000000000.0 - b) AS furthest, max(abs(w - v)) AS distance FROM e GROUP BY 1""")
def neighbour_context(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = insights.neighbour_context(t.customer.select(F.col("c_custkey").alias("code"), F.col("c_acctbal").alias("value")), customer_edges(t))
    return out.withColumn("middle", F.floor(F.col("middle") * 10000 + 0.5) / 10000)


@query("""SELECT c_custkey AS code, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS place, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0::DOUBLE AS average,
  (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0::DOUBLE - 1) / (count(*) OVER (PARTITION BY c_mktsegment) - 1) * 100 AS percentile,
  (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1)::DOUBLE / (count(*) OVER (PARTITION BY c_mktsegment) - 1)::DOUBLE * 100 AS below,
  (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) - 1)::DOUBLE / (count(*) OVER (PARTITION BY c_mktsegment) - 1)::DOUBLE * 100 AS above FROM customer""")
def ranks_and_standings(spark, sf_dir):
    below, above = ranks.standing("c_acctbal", "c_mktsegment")
    place = F.rank().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal")))
    return Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("code"), place.cast("long").alias("place"), ranks.average_rank("c_acctbal", "c_mktsegment").alias("average"), ranks.percentile_rank("c_acctbal", "c_mktsegment").alias("percentile"), below.alias("below"), above.alias("above"))


@query("""WITH r AS (SELECT c_custkey AS code, c_mktsegment AS type, CASE WHEN c_custkey % 3 = 0 THEN 'large' ELSE 'small' END AS band, rank() OVER (PARTITION BY c_mktsegment, c_custkey % 3 = 0 ORDER BY c_acctbal DESC) AS r, count(*) OVER (PARTITION BY c_mktsegment, c_custkey % 3 = 0) AS n FROM customer)
SELECT code, type, band, CASE WHEN r <= n * 0.01 THEN 1 WHEN r <= n * 0.05 THEN 5 ELSE 10 END AS tail FROM r WHERE n >= 20 AND r <= n * 0.1""")
def peer_tails(spark, sf_dir):
    """The top 1, 5 and 10 percent among peers of a type and size band."""
    band = F.when(F.col("c_custkey") % 3 == 0, "large").otherwise("small")
    rows = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("code"), F.col("c_mktsegment").alias("type"), band.alias("band"), "c_acctbal")
    peers = Window.partitionBy("type", "band")
    rows = rows.withColumns({"r": F.rank().over(peers.orderBy(F.desc("c_acctbal"))), "n": F.count("*").over(peers)})
    part = lambda p: F.col("r") <= F.col("n") * F.lit(p).cast("decimal(3,2)")
    return rows.where((F.col("n") >= 20) & part(0.1)).select("code", "type", "band", F.when(part(0.01), 1).when(part(0.05), 5).otherwise(10).alias("tail"))


@query("""WITH b AS (SELECT c_custkey AS code, c_mktsegment AS topic, c_acctbal AS score, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer),
t AS (SELECT * FROM b WHERE k = 1 ORDER BY score DESC, code LIMIT 40)
SELECT topic, CASE topic WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END AS place, list(code ORDER BY score DESC, code) AS codes FROM t GROUP BY topic""")
def best_by_topic(spark, sf_dir):
    """Each unit's best finding, the top of them, grouped by topic in a fixed order."""
    rows = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("code"), F.col("c_mktsegment").alias("topic"), F.col("c_acctbal").alias("score"), "c_nationkey")
    top = ranks.best_of(rows, ["c_nationkey", "topic"], [F.desc("score"), F.asc("code")]).orderBy(F.desc("score"), "code").limit(40)
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("by"), "code"))), lambda x: x["code"])
    place = F.when(F.col("topic") == "BUILDING", 0).when(F.col("topic") == "MACHINERY", 1).otherwise(2)
    return top.groupBy("topic").agg(listed.alias("codes")).select("topic", place.alias("place"), "codes")


@query("""WITH s AS (SELECT o_custkey AS code, o_orderpriority AS path, sum(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice::DECIMAL(18,2) ELSE -o_totalprice::DECIMAL(18,2) END) AS moved FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY abs(moved) DESC, path) AS k FROM s)
SELECT code, path, moved::DOUBLE AS moved FROM r WHERE k = 1 AND abs(moved) >= 100000""")
def largest_move(spark, sf_dir):
    year, price = F.year("o_orderdate"), F.col("o_totalprice").cast("decimal(18,2)")
    rows = Tables(spark, sf_dir).orders.where(year.isin(1995, 1996)).groupBy(F.col("o_custkey").alias("code"), F.col("o_orderpriority").alias("path")).agg(F.sum(F.when(year == 1996, price).otherwise(-price)).alias("moved"))
    best = ranks.best_of(rows, ["code"], [F.abs("moved").desc(), F.asc("path")])
    return best.where(F.abs("moved") >= 100_000).withColumn("moved", F.col("moved").cast("double"))


@query("""WITH m AS (SELECT p_brand || '.' || p_size AS path, p_partkey AS code, p_retailprice AS v FROM part), c AS (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM m WHERE v > 950),
r AS (SELECT *, row_number() OVER (PARTITION BY code % 50 ORDER BY n, path, code) AS k FROM c WHERE n <= 100) SELECT code % 50 AS unit, path, n FROM r WHERE k <= 2""")
def rare_figures(spark, sf_dir):
    """What few units have above a bar, the two rarest of each."""
    rows = Tables(spark, sf_dir).part.where("p_retailprice > 950").select(F.concat_ws(".", "p_brand", "p_size").alias("path"), F.col("p_partkey").alias("code"))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("path"))).where("n <= 100").withColumn("unit", F.col("code") % 50)
    return ranks.best_of(rows, ["unit"], [F.asc("n"), F.asc("path"), F.asc("code")], 2).select("unit", "path", "n")


@query("""WITH m AS (SELECT c_nationkey, median(c_acctbal) AS middle FROM customer GROUP BY 1)
SELECT c_custkey AS code, CASE WHEN c_acctbal > middle THEN 'above' WHEN c_acctbal < middle THEN 'below' END AS half FROM customer JOIN m USING (c_nationkey) WHERE c_acctbal <> middle""")
def peer_median_split(spark, sf_dir):
    customer = Tables(spark, sf_dir).customer
    middle = customer.groupBy("c_nationkey").agg(F.median("c_acctbal").alias("middle"))
    half = F.when(F.col("c_acctbal") > F.col("middle"), "above").when(F.col("c_acctbal") < F.col("middle"), "below")
    return customer.join(F.broadcast(middle), "c_nationkey").where("c_acctbal <> middle").select(F.col("c_custkey").alias("code"), half.alias("half"))


@query("""WITH m AS (SELECT p_name AS section, p_partkey AS code, p_brand AS name, CASE WHEN p_size > 10 THEN p_retailprice END AS value FROM part), k AS (SELECT * FROM m WHERE value IS NOT NULL)
SELECT section, code, name, value, row_number() OVER (PARTITION BY section ORDER BY value DESC, name, code) AS place FROM k WHERE section IN (SELECT section FROM k GROUP BY 1 HAVING count(*) <= 25)""")
def short_lists(spark, sf_dir):
    """Names of parts that few have, each with its parts, dearest first."""
    rows = Tables(spark, sf_dir).part.select(F.col("p_name").alias("section"), F.col("p_partkey").alias("code"), F.col("p_brand").alias("name"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("value"))
    return ranks.short_lists(rows, "section", "value", ["name", "code"], 25).select("section", "code", "name", "value", F.col("place").cast("long").alias("place"))


@query("""WITH s AS (SELECT lower(replace(p_name, ' ', '-')) AS slug, p_partkey AS code FROM part)
SELECT code, CASE WHEN count(*) OVER (PARTITION BY slug) > 1 THEN slug || '-' || code ELSE slug END AS slug FROM s""")
def unique_slugs(spark, sf_dir):
    rows = Tables(spark, sf_dir).part.select(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("slug"), F.col("p_partkey").alias("code"))
    return ranks.unique_slugs(rows, "slug", "code")


@query("""WITH s AS (SELECT s_suppkey AS row_idx, s_nationkey AS part, CASE s_suppkey % 11 WHEN 0 THEN 'region' WHEN 1 THEN 'province' WHEN 4 THEN 'district' WHEN 5 THEN 'cercle' WHEN 9 THEN 'other' ELSE 'commune' END AS kind, 'u' || s_suppkey AS code FROM supplier),
pairs AS (
  SELECT s.*, l.level, (SELECT max(o.row_idx) FROM s o WHERE o.part = s.part AND o.row_idx < s.row_idx AND o.kind = l.level) AS opened,
    (SELECT max(c.row_idx) FROM s c WHERE c.part = s.part AND c.row_idx < s.row_idx AND list_contains(l.closers, c.kind)) AS closed, list_contains(l.closers, s.kind) OR s.kind = l.level AS own
  FROM s, (VALUES ('region', []::VARCHAR[]), ('province', ['region']), ('district', ['region', 'province', 'cercle', 'commune']), ('cercle', ['region', 'province']), ('commune', ['region', 'province', 'cercle'])) l(level, closers)
), f AS (SELECT part, row_idx, kind, code, level, CASE WHEN NOT own AND opened IS NOT NULL AND (closed IS NULL OR closed < opened) THEN 'u' || opened END AS up FROM pairs)
SELECT part, row_idx, kind, code, max(up) FILTER (level = 'region') AS in_region, max(up) FILTER (level = 'province') AS in_province, max(up) FILTER (level = 'district') AS in_district, max(up) FILTER (level = 'cercle') AS in_cercle, max(up) FILTER (level = 'commune') AS in_commune,
  CASE WHEN kind = 'commune' THEN CASE WHEN max(up) FILTER (level = 'cercle') IS NOT NULL THEN 'rural' ELSE 'urban' END END AS type FROM f GROUP BY part, row_idx, kind, code""")
def hierarchy_fill_down(spark, sf_dir):
    kind = F.lit("commune")
    for k, name in ((0, "region"), (1, "province"), (4, "district"), (5, "cercle"), (9, "other")):
        kind = F.when(F.col("s_suppkey") % 11 == k, name).otherwise(kind)
    rows = Tables(spark, sf_dir).supplier.select(F.col("s_suppkey").alias("row_idx"), F.col("s_nationkey").alias("part"), kind.alias("kind"), F.concat(F.lit("u"), "s_suppkey").alias("code"))
    return ranks.filled_down(rows, "part")
