"""Statistics of links, agreement and discoveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiersight.functions import numbers
from tiersight.operators import hypotheses
from tiersight.queries.base import Tables, query


@query("""WITH r AS (SELECT p_brand AS brand, 2 * rank() OVER (PARTITION BY p_brand ORDER BY p_size) + count(*) OVER (PARTITION BY p_brand, p_size) - 1 AS a, 2 * rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1 AS b FROM part),
s AS (SELECT brand, count(*) AS n, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, sum(a * a)::DOUBLE AS aa, sum(b * b)::DOUBLE AS bb, sum(a * b)::DOUBLE AS ab FROM r GROUP BY 1)
SELECT brand, n, (n::DOUBLE * ab - a * b) / sqrt((n::DOUBLE * aa - a * a) * (n::DOUBLE * bb - b * b)) AS rho FROM s""")
def spearman_by_group(spark, sf_dir):
    return hypotheses.spearman(Tables(spark, sf_dir).part.withColumnRenamed("p_brand", "brand"), ["brand"], "p_size", "p_retailprice")


MWU_P = """CASE WHEN s = 0 THEN 1.0 ELSE floor((2.0 * (1.0 - 0.5 * (1.0 + (1.0 - (((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-x * x))))) * 1e9 + 0.5) / 1e9 END"""


@query(f"""WITH r AS (SELECT c_mktsegment AS segment, c_custkey % 2 = 0 AS first, 2 * rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1 AS twice, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS ties FROM customer),
g AS (SELECT segment, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, (sum(twice) FILTER (first))::DOUBLE AS twice, sum(ties * ties - 1)::DOUBLE AS tie_sum FROM r GROUP BY 1),
u AS (SELECT *, twice / 2.0 - n1::DOUBLE * (n1::DOUBLE + 1) / 2.0 AS u, sqrt(n1::DOUBLE * n2::DOUBLE / 12.0 * (n1 + n2 + 1.0::DOUBLE - tie_sum / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)::DOUBLE))) AS s FROM g),
z AS (SELECT *, abs((u - n1::DOUBLE * n2::DOUBLE / 2.0) / s) / sqrt(2.0::DOUBLE) AS x FROM u), w AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * x) AS t FROM z)
SELECT segment, n1, n2, u, {MWU_P}::DOUBLE AS p FROM w""")
def mann_whitney_by_group(spark, sf_dir):
    rows = Tables(spark, sf_dir).customer.select(F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") % 2 == 0).alias("first"), "c_nationkey")
    return hypotheses.mann_whitney(rows, ["segment"], "first", "c_nationkey").withColumn("p", numbers.half_up(F.col("p"), 9))


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey * 7919 % 1000 + 1) / 100000.0::DOUBLE AS p FROM part), k AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS n FROM p)
SELECT id, p, coalesce(k <= (SELECT max(k) FROM k WHERE p <= k / n::DOUBLE * 0.005::DOUBLE), false) AS found FROM k""")
def false_discovery_rate(spark, sf_dir):
    rows = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7919 % 1000 + 1) / F.lit(100000.0)).alias("p"))
    return hypotheses.discoveries(rows, "p", 0.005, "id")


@query("""WITH s AS (SELECT n_name AS nation, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND n_nationkey <> 3 GROUP BY 1),
f AS (SELECT *, count(*) OVER () AS z FROM (SELECT nation, CASE WHEN nation = 'x' THEN 0 ELSE n END AS n, k FROM s))
SELECT nation, n, k, CASE WHEN n = 0 THEN 0.0 ELSE ((k::DOUBLE / n + 3.8416 / (2.0::DOUBLE * n)) / (1.0::DOUBLE + 3.8416 / n) - 1.96 * sqrt(k::DOUBLE / n * (1 - k::DOUBLE / n) / n + 3.8416 / (4.0::DOUBLE * n * n)) / (1.0::DOUBLE + 3.8416 / n)) END AS low,
  CASE WHEN n = 0 THEN 1.0 ELSE ((k::DOUBLE / n + 3.8416 / (2.0::DOUBLE * n)) / (1.0::DOUBLE + 3.8416 / n) + 1.96 * sqrt(k::DOUBLE / n * (1 - k::DOUBLE / n) / n + 3.8416 / (4.0::DOUBLE * n * n)) / (1.0::DOUBLE + 3.8416 / n)) END AS high FROM f""".replace("SELECT nation, n, k, CASE", "SELECT nation, n, k, floor(1e9 * CASE").replace("END AS low", "END + 0.5) / 1e9 AS low").replace("CASE WHEN n = 0 THEN 1.0", "floor(1e9 * CASE WHEN n = 0 THEN 1.0").replace("END AS high", "END + 0.5) / 1e9 AS high"))
def wilson_intervals(spark, sf_dir):
    t = Tables(spark, sf_dir)
    counts = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("k")).where("n_nationkey <> 3")
    rows = t.nation.join(counts, "n_nationkey", "left").select(F.col("n_name").alias("nation"), F.when(F.col("n_nationkey") == 3, F.lit(1)).otherwise(F.coalesce("n", F.lit(1))).cast("long").alias("n"), F.coalesce("k", F.lit(0)).alias("k"))
    interval = numbers.wilson(F.col("k"), F.col("n"))
    return rows.select("nation", "n", "k", numbers.half_up(interval["low"], 9).alias("low"), numbers.half_up(interval["high"], 9).alias("high"))


@query("""WITH l AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b)::DOUBLE AS same FROM l),
e AS (SELECT sum((SELECT count(*) FROM l WHERE a = v)::DOUBLE * (SELECT count(*) FROM l WHERE b = v)::DOUBLE) AS products FROM (VALUES (0), (1)) t(v))
SELECT n::BIGINT AS n, same / n AS observed, CASE WHEN products / (n * n) = 1 THEN 0.0 ELSE (same / n - products / (n * n)) / (1.0::DOUBLE - products / (n * n)) END AS kappa FROM n, e""")
def cohen_kappa(spark, sf_dir):
    return hypotheses.agreement(Tables(spark, sf_dir).labels, [], "quality", "toxic")


@query("""WITH a AS (SELECT l_linenumber AS run, l_orderkey AS item, l_returnflag AS answer FROM lineitem WHERE l_linenumber <= 4 QUALIFY row_number() OVER (PARTITION BY l_linenumber, l_orderkey ORDER BY l_returnflag, l_partkey) = 1),
p AS (SELECT x.run AS run_a, y.run AS run_b, x.answer AS a, y.answer AS b FROM a x JOIN a y ON x.item = y.item AND x.run < y.run),
n AS (SELECT run_a, run_b, count(*) AS n, count(*) FILTER (a = b) AS same FROM p GROUP BY ALL),
l AS (SELECT run_a, run_b, a AS v, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT run_a, run_b, b AS v, count(*) AS n FROM p GROUP BY ALL),
e AS (SELECT run_a, run_b, sum(l.n * r.n)::DOUBLE AS products FROM l JOIN r USING (run_a, run_b, v) GROUP BY ALL)
SELECT run_a, run_b, n, same::DOUBLE / n::DOUBLE AS observed, (same::DOUBLE / n::DOUBLE - products / (n::DOUBLE * n::DOUBLE)) / (1.0::DOUBLE - products / (n::DOUBLE * n::DOUBLE)) AS kappa FROM n JOIN e USING (run_a, run_b)""")
def pairwise_agreement(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.where("l_linenumber <= 4").groupBy(F.col("l_linenumber").alias("run"), F.col("l_orderkey").alias("item")).agg(F.min("l_returnflag").alias("answer"))
    return hypotheses.pairwise_agreement(rows)


@query("""WITH v AS (SELECT l_orderkey AS item, count(*) FILTER (l_returnflag = 'R') AS yes, count(*) FILTER (l_returnflag = 'A') AS no FROM lineitem GROUP BY 1)
SELECT item, yes, no, CASE WHEN yes + no = 0 THEN 'abstain' WHEN yes = no THEN 'tie' WHEN yes > no THEN 'yes' ELSE 'no' END AS vote FROM v""")
def majority_votes(spark, sf_dir):
    answer = F.when(F.col("l_returnflag") == "R", "yes").when(F.col("l_returnflag") == "A", "no")
    return hypotheses.majority(Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("item"), answer.alias("answer")), "item", "answer")


@query("""WITH n AS (SELECT o_orderpriority AS priority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT priority, n::DOUBLE / sum(n) OVER (PARTITION BY priority)::DOUBLE AS p FROM n)
SELECT priority, floor(-sum(p * ln(p)) * 1e9 + 0.5) / 1e9 AS entropy FROM s GROUP BY 1""")
def semantic_entropy(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.withColumnRenamed("o_orderpriority", "priority")
    return hypotheses.entropy(rows, ["priority"], "o_orderstatus").withColumn("entropy", numbers.half_up(F.col("entropy"), 9))


@query("""SELECT o_orderstatus AS stratum, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('11:' || o_orderkey), o_orderkey) <= 20""")
def stratified_sample(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.select(F.col("o_orderstatus").alias("stratum"), F.col("o_orderkey").alias("id"))
    return hypotheses.stratified(rows, "stratum", "id", 20, 11)


@query("""WITH g AS (SELECT c_nationkey AS grp, count(*) FILTER (c_acctbal < 0) AS hits, count(*) AS n FROM customer GROUP BY 1),
cdf AS (SELECT sum(exp(-1.0) / factorial(k::INT)::DOUBLE) OVER (ORDER BY k) AS c FROM range(0, 12) t(k)),
d AS (SELECT r.round, g.hits, g.n, ('0x' || substr(md5('5:' || r.round || ':' || g.grp), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM range(0, 400) r(round), g),
t AS (SELECT round, hits, n, (SELECT count(*) FROM cdf WHERE c <= u) AS times FROM d),
s AS (SELECT sum(hits * times)::DOUBLE / sum(n * times)::DOUBLE AS share FROM t GROUP BY round HAVING sum(n * times) > 0)
SELECT floor(quantile_cont(share, 0.025) * 1e9 + 0.5) / 1e9 AS low, floor(quantile_cont(share, 0.975) * 1e9 + 0.5) / 1e9 AS high FROM s""")
def bootstrap_interval(spark, sf_dir):
    groups = Tables(spark, sf_dir).customer.groupBy(F.col("c_nationkey").alias("group")).agg(F.count_if(F.col("c_acctbal") < 0).alias("hits"), F.count("*").alias("n"))
    out = hypotheses.bootstrap(groups, rounds=400, seed=5)
    return out.select(numbers.half_up(F.col("low"), 9).alias("low"), numbers.half_up(F.col("high"), 9).alias("high"))


@query("""WITH g AS (SELECT c_nationkey AS grp, count(*) AS n, sum(c_custkey % 100) AS x, sum(c_nationkey + c_custkey % 7) AS y, sum((c_custkey % 100) * (c_custkey % 100)) AS xx, sum((c_nationkey + c_custkey % 7) * (c_nationkey + c_custkey % 7)) AS yy, sum((c_custkey % 100) * (c_nationkey + c_custkey % 7)) AS xy FROM customer GROUP BY 1),
cdf AS (SELECT sum(exp(-1.0) / factorial(k::INT)::DOUBLE) OVER (ORDER BY k) AS c FROM range(0, 12) t(k)),
d AS (SELECT r.round, g.*, ('0x' || substr(md5('9:' || r.round || ':' || g.grp), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM range(0, 300) r(round), g),
t AS (SELECT *, (SELECT count(*) FROM cdf WHERE c <= u) AS times FROM d),
s AS (SELECT round, sum(n * times)::DOUBLE AS n, sum(x * times)::DOUBLE AS x, sum(y * times)::DOUBLE AS y, sum(xx * times)::DOUBLE AS xx, sum(yy * times)::DOUBLE AS yy, sum(xy * times)::DOUBLE AS xy FROM t GROUP BY 1
  UNION ALL SELECT -1, sum(n)::DOUBLE, sum(x)::DOUBLE, sum(y)::DOUBLE, sum(xx)::DOUBLE, sum(yy)::DOUBLE, sum(xy)::DOUBLE FROM g),
v AS (SELECT round, 'correlation' AS statistic, CASE WHEN n * xx - x * x > 0 AND n * yy - y * y > 0 THEN (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)) END AS v FROM s UNION ALL SELECT round, 'mean', CASE WHEN n > 0 THEN x / n END FROM s)
SELECT statistic, floor(max(v) FILTER (round = -1) * 1e6 + 0.5) / 1e6 AS value, floor(quantile_cont(v, 0.05) FILTER (round >= 0) * 1e6 + 0.5) / 1e6 AS low, floor(quantile_cont(v, 0.95) FILTER (round >= 0) * 1e6 + 0.5) / 1e6 AS high FROM v GROUP BY 1""")
def resampled_statistics(spark, sf_dir):
    """A mean and a correlation with their intervals over resampled groups."""
    x, y = F.col("c_custkey") % 100, F.col("c_nationkey") + F.col("c_custkey") % 7
    groups = Tables(spark, sf_dir).customer.groupBy(F.col("c_nationkey").alias("group")).agg(F.count("*").alias("n"), *[F.sum(e).alias(c) for c, e in (("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))])
    sums = ["n", "x", "y", "xx", "yy", "xy"]
    kinds = (("correlation", hypotheses.correlation()), ("mean", hypotheses.share("x", "n")))
    found = [hypotheses.resampled(groups, sums, of, rounds=300, seed=9, confidence=0.9).select(F.lit(name).alias("statistic"), *[numbers.half_up(F.col(c), 6).alias(c) for c in ("value", "low", "high")]) for name, of in kinds]
    return found[0].unionAll(found[1])


@query()
def permutation_test(spark, sf_dir):
    """Rank correlation of size and price per brand with its p over 199 seeded shuffles."""
    rows = Tables(spark, sf_dir).part.select(F.col("p_brand").alias("brand"), "p_size", "p_retailprice")
    return hypotheses.permutation_p(rows, "brand", "p_size", "p_retailprice", rounds=199)


@query("""WITH o AS (SELECT p_partkey AS id, p_size = 7 AS refused, (p_partkey * 37 % 500 + 1) / 10000.0::DOUBLE AS p, (p_size - 25) / 25.0::DOUBLE AS effect, abs(p_size - 25) / 50.0::DOUBLE AS size, p_size > 20 AS held, (p_partkey % 9) / 10.0::DOUBLE AS placebo FROM part),
k AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS n FROM o WHERE NOT refused), c AS (SELECT max(k) AS cut FROM k WHERE p <= k / n::DOUBLE * 0.05::DOUBLE)
SELECT o.id, CASE WHEN o.refused THEN 'refused' WHEN coalesce(k.k <= cut, false) AND o.held AND abs(o.effect) > abs(o.placebo) AND o.size >= 0.2 THEN 'consistent' ELSE 'not consistent' END AS verdict FROM o LEFT JOIN k USING (id), c""")
def judged_links(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = Tables(spark, sf_dir).part.select(
        key.alias("id"), (size == 7).alias("refused"), ((key * 37 % 500 + 1) / F.lit(10000.0)).alias("p"), ((size - 25) / F.lit(25.0)).alias("effect"), (F.abs(size - 25) / F.lit(50.0)).alias("size"),
        (size > 20).alias("held"), F.array((key % 9) / F.lit(10.0)).alias("placebos"),
    )
    return hypotheses.judged_links(rows).select("id", "verdict")
