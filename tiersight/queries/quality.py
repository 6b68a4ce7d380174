"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiersight.functions import text as names
from tiersight.functions.canonical import canonical_json
from tiersight.operators import validators
from tiersight.queries.base import Tables, money, query


@query("""SELECT 'customers' AS "check", NULL::VARCHAR AS code, count(*) || ' instead of 1' AS detail FROM customer HAVING count(*) <> 1
UNION ALL SELECT 'duplicate p_name', p_name, count(*)::VARCHAR FROM part GROUP BY p_name HAVING count(*) > 1
UNION ALL SELECT 'no such o_custkey', o_orderkey::VARCHAR, o_custkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)
UNION ALL SELECT 'p_size out of range', p_partkey::VARCHAR, p_size::VARCHAR FROM part WHERE p_size < 3 OR p_size > 48
UNION ALL SELECT 'list differs', coalesce(f, k)::VARCHAR, CASE WHEN k IS NULL THEN 'not known' ELSE 'not found' END FROM (SELECT DISTINCT c_nationkey AS f FROM customer) a FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 1 UNION SELECT 99) b ON f = k WHERE f IS NULL OR k IS NULL""")
def collected_problems(spark, sf_dir):
    t = Tables(spark, sf_dir)
    known = t.nation.where("n_nationkey > 1").select(F.col("n_nationkey").alias("k")).unionAll(spark.createDataFrame([(99,)], "k int"))
    return validators.collected(
        validators.wrong_count(t.customer, 1, "customers"), validators.duplicates(t.part, "p_name"),
        validators.orphans(t.orders, "o_custkey", t.customer.where("c_custkey % 50 <> 0"), "c_custkey", "o_orderkey"),
        validators.out_of_range(t.part, "p_partkey", "p_size", 3, 48), validators.differing_lists(t.customer.select(F.col("c_nationkey").alias("k")), known, "k"),
    )


@query("""WITH f AS (SELECT l_orderkey AS code, sum(l_quantity)::BIGINT AS whole, (sum(l_quantity) FILTER (l_returnflag = 'A'))::BIGINT AS a, (sum(l_quantity) FILTER (l_returnflag = 'N'))::BIGINT AS n, (sum(l_quantity) FILTER (l_returnflag = 'R'))::BIGINT AS r FROM lineitem GROUP BY 1)
SELECT 'all is not its parts' AS "check", code::VARCHAR AS code, (whole + code % 2 - a - n - r)::VARCHAR AS detail FROM f WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL AND code % 2 = 1""")
def part_whole_check(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    rows = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_orderkey").alias("code")).agg((F.sum(q) + F.max("l_orderkey") % 2).alias("all"), *[F.sum(F.when(F.col("l_returnflag") == x, q)).alias(x) for x in "ANR"])
    facts = rows.unpivot(["code"], ["all", "A", "N", "R"], "path", "value")
    return validators.unequal_parts(facts, "all", ["A", "N", "R"])


@query("""WITH f AS (SELECT l_orderkey AS code, count(*) FILTER (l_returnflag = x) * 100 // count(*) AS share FROM lineitem, (VALUES ('A'), ('N'), ('R')) t(x) GROUP BY l_orderkey, x)
SELECT 'flag. off 100' AS "check", code::VARCHAR AS code, sum(share)::BIGINT::VARCHAR AS detail FROM f GROUP BY code HAVING abs(sum(share) - 100) > count(*) * 0.05""")
def shares_check(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_orderkey").alias("code")).agg(*[F.floor(F.count_if(F.col("l_returnflag") == x) * 100 / F.count("*")).alias(f"flag.{x}") for x in "ANR"])
    return validators.shares_off(rows.unpivot(["code"], ["`flag.A`", "`flag.N`", "`flag.R`"], "path", "value"), "flag.")


@query("""WITH leaf AS (SELECT c_nationkey AS parent, c_mktsegment AS path, sum(c_acctbal::DECIMAL(18,2)) AS v FROM customer GROUP BY ALL),
own AS (SELECT c_nationkey AS parent, c_mktsegment AS path, sum(c_acctbal::DECIMAL(18,2)) + CASE WHEN c_nationkey % 4 = 0 THEN 1 ELSE 0 END AS v FROM customer WHERE NOT (c_nationkey = 5 AND c_mktsegment = 'BUILDING') GROUP BY c_nationkey, c_mktsegment)
SELECT coalesce(own.parent, leaf.parent)::VARCHAR AS parent, coalesce(own.path, leaf.path) AS path, own.v::DOUBLE AS own, leaf.v::DOUBLE AS children FROM own FULL JOIN leaf ON own.parent = leaf.parent AND own.path = leaf.path WHERE own.v IS DISTINCT FROM leaf.v""")
def tree_reconciliation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    leaf = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("code"), F.col("c_mktsegment").alias("path"), F.col("c_acctbal").cast("decimal(18,2)").alias("value"), F.col("c_nationkey").cast("string").alias("parent"))
    nation = t.customer.where("not (c_nationkey = 5 and c_mktsegment = 'BUILDING')").groupBy(F.col("c_nationkey").cast("string").alias("code"), F.col("c_mktsegment").alias("path")).agg(money("c_acctbal").alias("v"))
    own = nation.select("code", "path", (F.col("v") + F.when(F.col("code").cast("int") % 4 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("value"))
    facts = leaf.select("code", "path", "value").unionByName(own)
    out = validators.unreconciled(facts, leaf.select("code", "parent"))
    return out.withColumns({"own": F.col("own").cast("double"), "children": F.col("children").cast("double")})


@query("""WITH s AS (SELECT o_custkey AS code, o_orderpriority AS path, year(o_orderdate) AS y, count(*) * 100 // sum(count(*)) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS v FROM orders GROUP BY o_custkey, o_orderpriority, year(o_orderdate))
SELECT a.code, a.path, (a.v - b.v)::BIGINT AS moved FROM s a JOIN s b ON a.code = b.code AND a.path = b.path AND a.y = 1996 AND b.y = 1995 WHERE abs(a.v - b.v) > 30""")
def census_disagreement(spark, sf_dir):
    from pyspark.sql import Window

    n = Tables(spark, sf_dir).orders.groupBy(F.col("o_custkey").alias("code"), F.col("o_orderpriority").alias("path"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    share = F.floor(F.col("n") * 100 / F.sum("n").over(Window.partitionBy("code", "y")))
    rows = n.withColumn("value", share)
    at = lambda y: rows.where(F.col("y") == y).select("code", "path", "value")
    return validators.disagreeing(at(1996), at(1995), 30)


@query("""WITH e AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem)
SELECT 'pair out of order' AS "check", a::VARCHAR AS code, b::VARCHAR AS detail FROM e WHERE a >= b UNION ALL SELECT 'repeated pair', a::VARCHAR, b::VARCHAR FROM e GROUP BY a, b HAVING count(*) > 1
UNION ALL SELECT 'no border', p_partkey::VARCHAR, NULL FROM part WHERE p_partkey NOT IN (SELECT a FROM e UNION SELECT b FROM e)""")
def border_graph_check(spark, sf_dir):
    t = Tables(spark, sf_dir)
    edges = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return validators.undone(edges, t.part.select(F.col("p_partkey").alias("code")))


@query("""SELECT 'degenerate ring' AS "check", l_orderkey::VARCHAR AS code, count(DISTINCT (l_partkey % 3, l_suppkey % 3))::VARCHAR AS detail FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT (l_partkey % 3, l_suppkey % 3)) < 3""")
def degenerate_rings(spark, sf_dir):
    return validators.degenerate_rings(Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("ring"), (F.col("l_partkey") % 3).alias("x"), (F.col("l_suppkey") % 3).alias("y")))


@query("""SELECT 'partial fetch' AS "check", NULL::VARCHAR AS code, (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0) || ' of ' || (SELECT count(*) FROM orders) AS detail""")
def partial_fetch_guard(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    return validators.lost_share(orders, orders.where("o_orderkey % 10 <> 0"))


@query(r"""SELECT conv_id, turn, regexp_matches(text, '[\w.+-]+@[\w-]+\.[\w.]+') OR regexp_matches(text, '\+?\d(?:[\s().-]*\d){7,}') OR regexp_matches(text, '\b(?:Mr|Mrs|Ms|Dr|Mme|M)\.? \p{Lu}\p{L}+') AS personal FROM conversations""")
def personal_data_flags(spark, sf_dir):
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", names.personal(F.col("text")).alias("personal"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\w.+-]+@[\w-]+\.[\w.]+', ' ', 'g'), 'https?://\S+', ' ', 'g'), '\+?\d(?:[\s().-]*\d){7,}', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM conversations""")
def scrubbed_texts(spark, sf_dir):
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", names.scrubbed(F.col("text")).alias("text"))


@query(r"""WITH c AS (SELECT p_partkey AS id, p_brand AS field, p_size / 3.0::DOUBLE AS value, p_size / 700.0::DOUBLE AS share, p_size % 2 = 0 AS ranked FROM part),
n AS (SELECT *, regexp_replace((floor(value * 10 + 0.5) / 10)::DECIMAL(18,1)::VARCHAR, '\.?0+$', '') AS v, regexp_replace((floor(share * 100 + 0.5) / 100)::DECIMAL(18,2)::VARCHAR, '\.?0+$', '') AS s FROM c)
SELECT id, CASE WHEN ranked THEN '{"check":"rank","field":"' || field || '","position":"top","share":' || s || ',"within":["level",null]}'
  ELSE '{"check":"compare","left":{"field":"' || field || '","subject":"self"},"op":">","right":{"value":' || v || '}}' END AS signature FROM n""")
def check_signatures(spark, sf_dir):
    """Checks of findings in canonical JSON."""
    rows = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("field"), (F.col("p_size") / F.lit(3.0)).alias("value"), (F.col("p_size") / F.lit(700.0)).alias("share"), (F.col("p_size") % 2 == 0).alias("ranked"))
    rank = F.struct(F.lit("top").alias("position"), "share", F.array(F.lit("level"), F.lit(None).cast("string")).alias("within"), "field", F.lit("rank").alias("check"))
    left = F.struct(F.lit("self").alias("subject"), "field")
    compare = F.struct(F.lit(">").alias("op"), F.struct("value").alias("right"), left.alias("left"), F.lit("compare").alias("check"))
    both = rows.select("id", "ranked", rank.alias("rank"), compare.alias("compare"))
    finer = {"share": 2}
    written = {c: canonical_json(F.col(c), both.schema[c].dataType, 1, finer) for c in ("rank", "compare")}
    return both.select("id", F.when(F.col("ranked"), written["rank"]).otherwise(written["compare"]).alias("signature"))
