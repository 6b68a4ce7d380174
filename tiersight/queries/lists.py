"""Lists of units."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiersight.functions import numbers
from tiersight.functions import text as names
from tiersight.operators import listing
from tiersight.queries.base import UNITS_SQL, Tables, money, query, units


@query(f"""WITH {UNITS_SQL}
SELECT * FROM units WHERE region = 'EUROPE' AND segment = 'BUILDING' AND population >= 0 AND population <= 9000
ORDER BY population DESC NULLS LAST, code LIMIT 50""")
def list_units(spark, sf_dir):
    rows = listing.filtered(units(Tables(spark, sf_dir)), {"region": "EUROPE", "segment": "BUILDING"}, 0, 9000)
    return listing.paged(rows, listing.order_by(F.col("population"), True, F.col("code")), 1)


@query(f"""WITH {UNITS_SQL}, n AS (SELECT count(*) AS total FROM units WHERE segment = 'BUILDING'),
m AS (SELECT total, greatest(ceil(total / 50.0), 1)::BIGINT AS pages, 2::BIGINT AS page FROM n)
SELECT total, pages, page, CASE WHEN page > 1 AND page <= pages + 1 THEN page - 1 END AS previous, CASE WHEN page < pages THEN page + 1 END AS next FROM m""")
def list_page_meta(spark, sf_dir):
    return listing.page_meta(listing.filtered(units(Tables(spark, sf_dir)), {"segment": "BUILDING"}), 2)


def year_facts(t: Tables):
    """What each customer ordered in 1996 (now) and in 1995 (before), as metrics."""
    year = F.year("o_orderdate")
    rows = t.orders.where(year.isin(1995, 1996)).groupBy("o_custkey", F.when(year == 1996, "now").otherwise("before").alias("period"))
    return rows.agg(money("o_totalprice").cast("double").alias("value")).select(F.col("o_custkey").alias("code"), "period", F.lit("orders.total").alias("path"), "value")


@query(f"""WITH {UNITS_SQL}, f AS (
  SELECT o_custkey AS code, year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders
  WHERE year(o_orderdate) IN (1995, 1996) GROUP BY ALL
), v AS (
  SELECT u.*, floor((a.value - b.value) * 100 + 0.5) / 100 AS value FROM units u
  LEFT JOIN f a ON a.code = u.code AND a.y = 1996 LEFT JOIN f b ON b.code = u.code AND b.y = 1995
)
SELECT * FROM v ORDER BY value DESC NULLS LAST, code LIMIT 50 OFFSET 50""")
def list_by_change(spark, sf_dir):
    t = Tables(spark, sf_dir)
    sort = listing.sort_of("-change.orders.total", {"orders.total"}, {"orders.total"})
    rows = listing.with_metric(units(t), year_facts(t), sort)
    return listing.paged(rows, listing.order_by(F.col("value"), sort.descending, F.col("code")), 2)


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1),
n AS (SELECT n_name AS nation, count(*) AS customers, sum(coalesce(n, 0))::BIGINT AS orders, sum(CASE WHEN c_acctbal < -1e9 THEN 1 ELSE 0 END)::BIGINT AS none
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1)
SELECT nation, customers, orders, floor(orders::DOUBLE / nullif(customers::DOUBLE, 0) * 1000 * 10 + 0.5) / 10 AS per_1000,
  floor(orders::DOUBLE / nullif(none::DOUBLE, 0) * 1000 * 10 + 0.5) / 10 AS per_none FROM n""")
def list_ratios(spark, sf_dir):
    """Ratios to a base; a base of zero gives none."""
    t = Tables(spark, sf_dir)
    made = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = t.customer.join(made, "c_custkey", "left").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum(F.coalesce("n", F.lit(0))).alias("orders"), F.count_if(F.col("c_acctbal") < -1e9).alias("none"))
    rows = rows.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("n_name").alias("nation"), "customers", "orders", numbers.per(F.col("orders"), F.col("customers")).alias("per_1000"), numbers.per(F.col("orders"), F.col("none")).alias("per_none"))


@query("""SELECT s_suppkey AS code, s_name AS name, n_name AS nation, row_number() OVER (ORDER BY n_name, s_suppkey) AS place
FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY n_name, s_suppkey LIMIT 100""")
def list_by_name(spark, sf_dir):
    """Names in the order of a French reader."""
    t = Tables(spark, sf_dir)
    rows = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("nation"))
    top = listing.paged(rows, [F.collate("nation", "fr"), F.col("code")], 1, 100)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.collate("nation", "fr"), "code")).cast("long"))


@query("""WITH ids(id) AS (VALUES ('000000007'), ('7'), ('customer-7'), ('part-3'), ('no such'), ('99999999'), ('Customer-12')),
u AS (SELECT 'customer' AS level, c_custkey AS k FROM customer UNION ALL SELECT 'part', p_partkey FROM part),
a AS (
  SELECT lpad(k::VARCHAR, 9, '0') AS alias, level, level || '.' || k AS code, 1 AS prio FROM u
  UNION ALL SELECT k::VARCHAR, level, level || '.' || k, 2 FROM u UNION ALL SELECT level || '-' || k, level, level || '.' || k, 3 FROM u
), j AS (
  SELECT id, code, level, row_number() OVER (PARTITION BY id ORDER BY (level <> 'customer')::INT NULLS FIRST, prio NULLS FIRST, code NULLS FIRST) AS r FROM ids LEFT JOIN a ON lower(trim(id)) = alias
)
SELECT id, code, level, CASE WHEN code IS NOT NULL THEN 'found' WHEN regexp_full_match(trim(id), '[0-9a-zA-Z][0-9a-zA-Z.-]*') THEN 'absent' ELSE 'malformed' END AS status FROM j WHERE r = 1""")
def resolve_identifiers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    both = t.customer.select(F.lit("customer").alias("level"), F.col("c_custkey").alias("k")).unionAll(t.part.select(F.lit("part"), "p_partkey"))
    digits = names.padded_code(F.col("k").cast("string"))
    rows = both.select("level", F.concat_ws(".", "level", "k").alias("code"), digits.alias("digits"), F.concat_ws("-", "level", "k").alias("slug"))
    ids = spark.createDataFrame([(x,) for x in ("000000007", "7", "customer-7", "part-3", "no such", "99999999", "Customer-12")], "id string")
    return listing.resolved(ids, listing.alias_rows(rows), "customer")


@query(f"""WITH {UNITS_SQL} SELECT region, nation, count(*) AS customers, min(population) AS least, max(population) AS most FROM units GROUP BY ALL""")
def level_table(spark, sf_dir):
    rows = units(Tables(spark, sf_dir))
    return rows.groupBy("region", "nation").agg(F.count("*").alias("customers"), F.min("population").alias("least"), F.max("population").alias("most"))


@query("""SELECT c_custkey AS code, CASE WHEN c_acctbal IS NULL THEN 'n' WHEN c_acctbal < 0 THEN '0' WHEN c_acctbal < 1000 THEN '1' WHEN c_acctbal < 5000 THEN '2' ELSE '3' END AS band FROM customer""")
def classify_by_breaks(spark, sf_dir):
    return Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("code"), numbers.banded(F.col("c_acctbal"), [0.0, 1000.0, 5000.0]).alias("band"))
