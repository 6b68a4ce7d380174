"""Aggregations over the hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiersight.functions import numbers
from tiersight.operators import ranks, rollups
from tiersight.queries.base import Tables, money, query


@query("SELECT c_nationkey AS nation, list_sort(list(c_custkey)) AS customers FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment = 'BUILDING' GROUP BY 1")
def grouped_lists(spark, sf_dir):
    rows = Tables(spark, sf_dir).customer.where("c_nationkey is not null and c_mktsegment = 'BUILDING'")
    return rows.groupBy(F.col("c_nationkey").alias("nation")).agg(F.sort_array(F.collect_list("c_custkey")).alias("customers"))


@query("SELECT n_nationkey AS nation, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS suppliers FROM nation")
def child_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rollups.child_counts(t.supplier.where("s_acctbal > 5000"), "s_nationkey", t.nation.select(F.col("n_nationkey").alias("nation")), "nation", "suppliers")


@query("""WITH f AS (SELECT p_brand AS code, p_size AS size, CASE WHEN p_size = 7 THEN NULL ELSE p_retailprice::DECIMAL(18,2) END AS v FROM part)
SELECT code, count(*) AS n, sum(v)::DOUBLE AS known, CASE WHEN count(v) = count(*) THEN sum(v)::DOUBLE END AS complete FROM f GROUP BY code, size % 5""")
def complete_only_sums(spark, sf_dir):
    v = F.when(F.col("p_size") != 7, F.col("p_retailprice").cast("decimal(18,2)"))
    rows = Tables(spark, sf_dir).part.select(F.col("p_brand").alias("code"), (F.col("p_size") % 5).alias("k"), v.alias("v"))
    return rows.groupBy("code", "k").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("known"), rollups.complete_sum(F.col("v")).cast("double").alias("complete")).drop("k")


@query("""WITH own AS (SELECT 'c' || c_custkey AS code, 'balance' AS path, c_acctbal::DECIMAL(18,2) AS value, 'n' || c_nationkey AS parent FROM customer),
given AS (SELECT 'n' || n_nationkey AS code, 'balance' AS path, 1.00::DECIMAL(18,2) AS value FROM nation WHERE n_nationkey < 5)
SELECT code, path, value::DOUBLE AS value, 'own' AS basis FROM given
UNION ALL SELECT parent, path, sum(value)::DOUBLE, 'children_sum' FROM own WHERE parent NOT IN (SELECT code FROM given) GROUP BY ALL""")
def parents_from_children(spark, sf_dir):
    t = Tables(spark, sf_dir)
    own = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("code"), F.lit("balance").alias("path"), F.col("c_acctbal").cast("decimal(18,2)").alias("value"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    given = t.nation.where("n_nationkey < 5").select(F.concat(F.lit("n"), "n_nationkey").alias("code"), F.lit("balance").alias("path"), F.lit("1.00").cast("decimal(18,2)").alias("value"))
    facts = own.drop("parent").unionByName(given)
    out = rollups.summed_parents(facts, own.select("code", "parent"))
    return out.where("code like 'n%'").withColumn("value", F.col("value").cast("double"))


@query("""SELECT l_returnflag AS flag, sum(l_discount::DECIMAL(18,2) * l_quantity::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE AS mean_discount,
  sum(CASE WHEN l_discount > 0.05 THEN l_quantity::DECIMAL(18,2) ELSE 0 END)::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE * 100 AS share_over FROM lineitem GROUP BY 1""")
def weighted_means(spark, sf_dir):
    q, d = F.col("l_quantity").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(18,2)")
    return Tables(spark, sf_dir).lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(rollups.weighted_mean(d, q).alias("mean_discount"), rollups.share_beyond(F.col("l_discount"), q, 0.05).alias("share_over"))


@query("""WITH b AS (SELECT c_mktsegment AS segment, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 3000 THEN 1 WHEN c_acctbal < 6000 THEN 2 ELSE 3 END AS band, 1 AS w FROM customer)
SELECT segment, band::INTEGER AS band, sum(w)::DOUBLE / sum(sum(w)) OVER (PARTITION BY segment)::DOUBLE AS share FROM b GROUP BY segment, band""")
def weighted_bands(spark, sf_dir):
    from pyspark.sql import Window

    rows = Tables(spark, sf_dir).customer.select(F.col("c_mktsegment").alias("segment"), numbers.banded(F.col("c_acctbal"), [0.0, 3000.0, 6000.0]).cast("int").alias("band"))
    n = rows.groupBy("segment", "band").agg(F.count("*").alias("n"))
    return n.select("segment", "band", (F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("segment")).cast("double")).alias("share"))


@query("SELECT o_orderpriority AS priority, count(DISTINCT o_custkey) AS customers, count(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY 1")
def distinct_counts(spark, sf_dir):
    return Tables(spark, sf_dir).orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct(F.year("o_orderdate")).alias("years"))


@query("""WITH y AS (SELECT r_name AS region, sum(CASE WHEN year(o_orderdate) = 1995 THEN o_totalprice::DECIMAL(18,2) END) AS b, sum(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice::DECIMAL(18,2) END) AS a
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT region, b::DOUBLE AS before, a::DOUBLE AS after, CASE WHEN b > 0 THEN floor((a::DOUBLE - b::DOUBLE) / b::DOUBLE * 100 * 10 + 0.5) / 10 END AS percent FROM y""")
def region_change(spark, sf_dir):
    t = Tables(spark, sf_dir)
    of = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    year = F.year("o_orderdate")
    per_customer = t.orders.where(year.isin(1995, 1996)).groupBy("o_custkey").agg(*[F.sum(F.when(year == y, F.col("o_totalprice").cast("decimal(18,2)"))).alias(n) for y, n in ((1995, "b"), (1996, "a"))])
    rows = per_customer.join(of, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("r_name").alias("region")).agg(F.sum("b").cast("double").alias("before"), F.sum("a").cast("double").alias("after"))
    return rows.withColumn("percent", numbers.change_percent(F.col("after"), F.col("before")))


@query("""WITH b(bin, lo, hi) AS (VALUES (0, NULL, 900.0::DOUBLE), (1, 900.0::DOUBLE, 1000.0::DOUBLE), (2, 1000.0::DOUBLE, 1500.0::DOUBLE), (3, 1500.0::DOUBLE, 1e9::DOUBLE), (4, 1e9::DOUBLE, NULL))
SELECT bin::INTEGER AS bin, lo, hi, (SELECT count(*) FROM part WHERE (lo IS NULL OR p_retailprice >= lo) AND (hi IS NULL OR p_retailprice < hi)) AS n FROM b""")
def size_histogram(spark, sf_dir):
    return rollups.histogram(Tables(spark, sf_dir).part, "p_retailprice", [900.0, 1000.0, 1500.0, 1e9])


@query("""WITH e AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier), b AS (SELECT unnest(range(60))::INTEGER AS bin),
n AS (SELECT least(floor((s_acctbal - lo) / (hi - lo) * 60), 59)::INTEGER AS bin, count(*) AS n FROM supplier, e GROUP BY 1)
SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN n USING (bin)""")
def equal_width_histogram(spark, sf_dir):
    return rollups.equal_width(Tables(spark, sf_dir).supplier, "s_acctbal", 60)


@query("""WITH x AS (SELECT ln(o_totalprice) AS x FROM orders WHERE o_totalprice > 0), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x), b AS (SELECT unnest(range(40))::INTEGER AS bin),
n AS (SELECT least(floor((x - lo) / (hi - lo) * 40), 39)::INTEGER AS bin, count(*) AS n FROM x, e GROUP BY 1) SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN n USING (bin)""")
def logarithmic_histogram(spark, sf_dir):
    return rollups.equal_width(Tables(spark, sf_dir).orders, "o_totalprice", 40, log=True)


@query("""WITH g AS (SELECT c_mktsegment AS segment, list_sort(list(c_acctbal)) AS v FROM customer GROUP BY 1)
SELECT segment, v[least(len(v), floor(len(v) * 0.1)::INT + 1)] AS p10, v[least(len(v), floor(len(v) * 0.5)::INT + 1)] AS p50, v[least(len(v), floor(len(v) * 0.9)::INT + 1)] AS p90 FROM g""")
def nearest_rank_quantiles(spark, sf_dir):
    rows = rollups.nearest_ranks(Tables(spark, sf_dir).customer.withColumnRenamed("c_mktsegment", "segment"), ["segment"], "c_acctbal", [0.1, 0.5, 0.9])
    return rows.select("segment", *[F.col("ranks")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


@query("SELECT c_mktsegment AS segment, floor(median(c_acctbal) * 10000 + 0.5) / 10000 AS middle, floor(quantile_cont(c_acctbal, 0.25) * 10000 + 0.5) / 10000 AS lower, quantile_disc(c_acctbal, 0.9) AS ninth FROM customer GROUP BY 1")
def medians_and_quantiles(spark, sf_dir):
    rows = Tables(spark, sf_dir).customer.groupBy(F.col("c_mktsegment").alias("segment"))
    return rows.agg(numbers.half_up(F.median("c_acctbal"), 4).alias("middle"), numbers.half_up(F.percentile("c_acctbal", 0.25), 4).alias("lower"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY c_acctbal)").alias("ninth"))


@query("""SELECT n_name AS nation, count(*) FILTER (c_mktsegment = 'BUILDING')::DOUBLE / count(*)::DOUBLE AS share,
  count(*) FILTER (c_acctbal < 0) AS shrank, count(*) FILTER (c_acctbal >= 0) AS grew FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def shares_and_conditional_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.customer.groupBy("c_nationkey").agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("b"), F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("shrank"), F.count_if(F.col("c_acctbal") >= 0).alias("grew"))
    return rows.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), (F.col("b").cast("double") / F.col("n").cast("double")).alias("share"), "shrank", "grew")


@query("""WITH r AS (SELECT o_orderkey AS code, o_totalprice::DECIMAL(18,2) AS amount, o_custkey % 50 AS density FROM orders WHERE o_orderstatus = 'F'),
c AS (SELECT *, coalesce(sum(amount) OVER (ORDER BY density DESC, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached, sum(amount) OVER () AS total FROM r)
SELECT code, density, amount::DOUBLE AS amount, reached::DOUBLE AS reached FROM c WHERE reached < total * 0.50::DECIMAL(3,2)""")
def greedy_coverage(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("code"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), (F.col("o_custkey") % 50).alias("density"))
    return rollups.greedy_cover(rows, "code", "density", "amount").withColumns({"amount": F.col("amount").cast("double"), "reached": F.col("reached").cast("double")})


@query("""WITH g AS (SELECT p_brand AS brand, count(*) AS n, avg(p_size::DOUBLE) AS mean, sum(p_size::BIGINT) AS s, sum(p_size::BIGINT * p_size) AS ss FROM part GROUP BY 1)
SELECT brand, n, s::DOUBLE / n::DOUBLE AS mean, sqrt(ss::DOUBLE / n::DOUBLE - (s::DOUBLE / n::DOUBLE) * (s::DOUBLE / n::DOUBLE)) AS spread FROM g""")
def mean_and_spread(spark, sf_dir):
    rows = Tables(spark, sf_dir).part.select(F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size"))
    return ranks.with_moments(rows, "size", "brand").select("brand", "n", "mean", "spread").distinct()


@query("SELECT s_nationkey AS nation, list_sort(list(DISTINCT (s_suppkey % 7)::BIGINT)) AS codes FROM supplier GROUP BY 1")
def distinct_sorted_lists(spark, sf_dir):
    return Tables(spark, sf_dir).supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.sort_array(F.collect_set(F.col("s_suppkey") % 7)).alias("codes"))


@query("""WITH w AS (SELECT o_orderkey % 1000 AS k, unnest(string_split(o_orderpriority, '-')) AS word, o_orderstatus AS status FROM orders)
SELECT word, max_by(status, n * 1000 - ascii(status)) AS status FROM (SELECT word, status, count(*) AS n FROM w GROUP BY ALL) GROUP BY word""")
def most_frequent_pair(spark, sf_dir):
    """The most frequent translation of each word."""
    rows = Tables(spark, sf_dir).orders.select(F.explode(F.split("o_orderpriority", "-")).alias("word"), F.col("o_orderstatus").alias("status"))
    return rows.groupBy("word", "status").agg(F.count("*").alias("n")).groupBy("word").agg(F.max_by("status", F.col("n") * 1000 - F.ascii("status")).alias("status"))


@query("""WITH p AS (SELECT substr(p_type, 1, 3) AS gap, p_brand AS fill, count(*) AS n FROM part GROUP BY ALL)
SELECT gap, fill, n, n::DOUBLE / sum(n) OVER (PARTITION BY gap)::DOUBLE AS share FROM p QUALIFY n >= 4 AND n::DOUBLE / sum(n) OVER (PARTITION BY gap)::DOUBLE >= 0.04""")
def learned_gaps(spark, sf_dir):
    """Pairs seen often enough, with a share of their group over a bar."""
    from pyspark.sql import Window

    n = Tables(spark, sf_dir).part.groupBy(F.substring("p_type", 1, 3).alias("gap"), F.col("p_brand").alias("fill")).agg(F.count("*").alias("n"))
    share = F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("gap")).cast("double")
    return n.withColumn("share", share).where("n >= 4 and share >= 0.04")


@query("""WITH o AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2)) AS parts FROM orders GROUP BY 1)
SELECT c_custkey AS code, CASE WHEN c_acctbal::DECIMAL(18,2) * 100 - coalesce(parts, 0) - 1000 > 0 THEN (c_acctbal::DECIMAL(18,2) * 100 - coalesce(parts, 0) - 1000)::DOUBLE END AS rest FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def residuals(spark, sf_dir):
    t = Tables(spark, sf_dir)
    parts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(money("o_totalprice").alias("parts"))
    total = F.col("c_acctbal").cast("decimal(18,2)") * 100
    return t.customer.join(parts, "c_custkey", "left").select(F.col("c_custkey").alias("code"), rollups.residual(total, F.col("parts"), F.lit(1000)).cast("double").alias("rest"))


@query("""WITH b AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2)) FILTER (year(o_orderdate) = 1995) AS b, sum(o_totalprice::DECIMAL(18,2)) FILTER (year(o_orderdate) = 1996) AS a FROM orders GROUP BY 1)
SELECT c_mktsegment AS segment, count(*) AS both_sides, (sum(a)::DOUBLE - sum(b)::DOUBLE) / sum(b)::DOUBLE AS moved FROM b JOIN customer ON o_custkey = c_custkey WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def two_sided_totals(spark, sf_dir):
    t = Tables(spark, sf_dir)
    year, price = F.year("o_orderdate"), F.col("o_totalprice").cast("decimal(18,2)")
    sides = t.orders.where(year.isin(1995, 1996)).groupBy("o_custkey").agg(F.sum(F.when(year == 1995, price)).alias("b"), F.sum(F.when(year == 1996, price)).alias("a")).where("a is not null and b is not null")
    rows = sides.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("both_sides"), F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    return rows.select("segment", "both_sides", ((F.col("a") - F.col("b")) / F.col("b")).alias("moved"))


@query("""WITH s AS (SELECT l_orderkey AS code, l_linenumber AS part, CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem)
SELECT code, CASE WHEN count(v) = count(*) THEN list(v ORDER BY part, v) END AS parts, CASE WHEN count(v) = count(*) THEN sum(v) END AS total FROM s GROUP BY code""")
def complete_breakdowns(spark, sf_dir):
    """The parts of a whole, listed and summed, or null if any is missing."""
    v = F.when(F.col("l_discount") != 0, F.col("l_quantity"))
    rows = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("code"), "l_linenumber", v.alias("v"))
    full = F.count("v") == F.count("*")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "v"))), lambda x: x["v"])
    return rows.groupBy("code").agg(F.when(full, listed).alias("parts"), F.when(full, F.sum("v")).alias("total"))


@query("""WITH a AS (SELECT p_partkey AS id, p_size > 20 AS p1, p_size AS s1 FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS id, p_size > 25 AS p2, p_size + CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 100 ELSE 0 END AS s2 FROM part WHERE p_partkey % 4 <> 0),
j AS (SELECT * FROM a JOIN b USING (id)), t AS (SELECT id, row_number() OVER (ORDER BY abs(s2 - s1) DESC, id) AS k FROM j WHERE s1 <> s2)
SELECT count(*) AS common, count(*) FILTER (p1) AS passes_1, count(*) FILTER (p2) AS passes_2, sum(s1)::BIGINT AS sum_1, sum(s2)::BIGINT AS sum_2, count(*) FILTER (p1 <> p2) AS flips,
  (SELECT string_agg(id::VARCHAR, ',' ORDER BY k) FROM t WHERE k <= 5) AS moves FROM j""")
def run_to_run_diff(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    a = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") > 20).alias("passed"), F.col("p_size").cast("long").alias("score"))
    b = part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") > 25).alias("passed"), (F.col("p_size") + F.when(F.col("p_partkey") % 10 == 0, F.col("p_partkey") % 100).otherwise(0)).cast("long").alias("score"))
    return rollups.run_compared(a, b)


@query("""WITH f AS (SELECT l_returnflag AS area, l_linestatus AS sex, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT coalesce(area, 'all') AS area, coalesce(sex, 'all') AS sex, sum(n)::BIGINT AS n FROM f GROUP BY GROUPING SETS ((area, sex), (area), (sex), ())""")
def area_by_sex_cube(spark, sf_dir):
    """The metric cube with its totals as long rows."""
    rows = Tables(spark, sf_dir).lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("l_returnflag", F.lit("all")).alias("area"), F.coalesce("l_linestatus", F.lit("all")).alias("sex"), "n")


@query("""WITH f AS (SELECT c_custkey AS code, unnest([c_acctbal, c_nationkey::DOUBLE]) AS value, unnest(['money.balance', 'place.nation']) AS path FROM customer)
SELECT code, value, split_part(path, '.', 1) AS topic, regexp_extract(path, '^[^.]*\\.(.*)$', 1) AS key FROM f""")
def unpivoted_metrics(spark, sf_dir):
    rows = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("code"), F.col("c_acctbal").alias("money.balance"), F.col("c_nationkey").cast("double").alias("place.nation"))
    long = rows.unpivot(["code"], ["`money.balance`", "`place.nation`"], "path", "value")
    return long.select("code", "value", F.substring_index("path", ".", 1).alias("topic"), F.regexp_extract("path", r"^[^.]*\.(.*)$", 1).alias("key"))


@query("""SELECT c_custkey AS code, '{"balance":' || printf('%d', floor(c_acctbal)::BIGINT) || '}' AS money, '{"nation":' || c_nationkey || '}' AS place FROM customer""")
def nested_topics(spark, sf_dir):
    t = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("code"), F.array(F.struct(F.lit("money.balance").alias("path"), F.floor("c_acctbal").alias("value")), F.struct(F.lit("place.nation").alias("path"), F.col("c_nationkey").cast("long").alias("value"))).alias("f"))
    nested = rollups.nested_topics(t.select("code", F.explode("f").alias("f")).select("code", "f.path", "f.value"))
    return nested.select("code", F.col("topics")["money"].alias("money"), F.col("topics")["place"].alias("place"))
