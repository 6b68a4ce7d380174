"""Joins that pair records up."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tiersight.functions import text as names
from tiersight.operators import alike, graph, matching
from tiersight.queries.base import Tables, money, query


@query("""WITH b AS (SELECT o_custkey AS code, sum(o_totalprice::DECIMAL(18,2)) AS v FROM orders WHERE year(o_orderdate) = 1995 AND o_custkey % 4 <> 0 GROUP BY 1),
s AS (SELECT c_custkey // 3 * 3 + 1 AS code, count(v) AS known, count(*) AS n, sum(v) AS v FROM customer LEFT JOIN b ON code = c_custkey GROUP BY 1)
SELECT c_custkey AS code, coalesce(b.v, CASE WHEN s.known = s.n THEN s.v END, x.v)::DOUBLE AS value,
  CASE WHEN b.v IS NOT NULL THEN 'code' WHEN s.known = s.n THEN 'children_sum' WHEN x.v IS NOT NULL THEN 'crosswalk' END AS basis
FROM customer LEFT JOIN b ON b.code = c_custkey LEFT JOIN s ON s.code = c_custkey LEFT JOIN b x ON x.code = c_custkey + 1 AND c_custkey % 2 = 0""")
def fallback_resolution(spark, sf_dir):
    t = Tables(spark, sf_dir)
    before = t.orders.where((F.year("o_orderdate") == 1995) & (F.col("o_custkey") % 4 != 0)).groupBy(F.col("o_custkey").alias("code")).agg(money("o_totalprice").alias("value"))
    now = t.customer.select(F.col("c_custkey").alias("code"))
    children = now.select((F.floor(F.col("code") / 3) * 3 + 1).cast("long").alias("parent"), "code")
    crossed = now.where("code % 2 = 0").select("code", (F.col("code") + 1).alias("before_code"))
    return matching.prior_values(now, before, children, crossed).withColumn("value", F.col("value").cast("double"))


def yearly(t: Tables, year: int):
    return t.orders.where(F.year("o_orderdate") == year).select(F.col("o_custkey").alias("code")).distinct()


@query("""WITH a AS (SELECT DISTINCT o_custkey AS code FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey AS code FROM orders WHERE year(o_orderdate) = 1995)
SELECT code, 'matched' AS side FROM a WHERE code IN (SELECT code FROM b) UNION ALL SELECT code, 'new' FROM a WHERE code NOT IN (SELECT code FROM b) UNION ALL SELECT code, 'gone' FROM b WHERE code NOT IN (SELECT code FROM a)""")
def matched_and_unmatched(spark, sf_dir):
    t = Tables(spark, sf_dir)
    both, new, gone = matching.split_matched(yearly(t, 1996), yearly(t, 1995), "code")
    return both.withColumn("side", F.lit("matched")).unionAll(new.withColumn("side", F.lit("new"))).unionAll(gone.withColumn("side", F.lit("gone")))


CROSSWALK_SQL = """WITH l AS (SELECT p_partkey AS code, p_partkey AS row_idx, p_size::DECIMAL(12,2) AS size, p_brand AS grp, p_name AS name FROM part WHERE p_partkey % 3 <> 0),
r AS (SELECT p_partkey + 1000000 AS code, p_size::DECIMAL(12,2) % 7 AS size, p_brand AS grp, CASE WHEN p_partkey % 10 = 0 THEN p_name || 'x' ELSE p_name END AS name FROM part WHERE p_partkey % 5 <> 0),
l1 AS (SELECT grp, name, min(code) AS code FROM l GROUP BY ALL HAVING count(*) = 1), r1 AS (SELECT grp, name, min(code) AS code FROM r GROUP BY ALL HAVING count(*) = 1),
p1 AS (SELECT l1.code AS l, r1.code AS r, 'name' AS method FROM l1 JOIN r1 USING (grp, name)),
rl AS (SELECT * FROM l WHERE code NOT IN (SELECT l FROM p1)), rr AS (SELECT * FROM r WHERE code NOT IN (SELECT r FROM p1)),
sole AS (SELECT grp, min(code) AS code FROM rr GROUP BY 1 HAVING count(*) = 1),
p2 AS (SELECT arg_min(rl.code, rl.row_idx) AS l, min(sole.code) AS r, 'sole' AS method FROM rl JOIN sole USING (grp) GROUP BY grp),
p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2)
SELECT p.l AS "left", p.r AS "right", p.method, (SELECT count(*) FROM r x WHERE x.grp = l.grp) - row_number() OVER (PARTITION BY l.grp ORDER BY p.method = 'sole', l.row_idx) + 1 AS candidates,
  l.size::DOUBLE / nullif(r.size::DOUBLE, 0) AS ratio FROM p JOIN l ON l.code = p.l JOIN r ON r.code = p.r"""


@query(CROSSWALK_SQL)
def crosswalk(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    size = F.col("p_size").cast("decimal(12,2)")
    left = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("code"), F.col("p_partkey").alias("row_idx"), size.alias("size"), F.col("p_brand").alias("grp"), F.col("p_name").alias("name"))
    name = F.when(F.col("p_partkey") % 10 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name"))
    right = part.where("p_partkey % 5 <> 0").select((F.col("p_partkey") + 1_000_000).alias("code"), (size % 7).cast("decimal(12,2)").alias("size"), F.col("p_brand").alias("grp"), name.alias("name"))
    out = matching.crosswalk(left, right, "grp", "name")
    sizes = left.select(F.col("code").alias("left"), F.col("size").cast("double").alias("a"))
    both = out.drop("ratio").join(sizes, "left").join(right.select(F.col("code").alias("right"), F.col("size").cast("double").alias("b")), "right")
    return both.select("left", "right", "method", "candidates", (F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).alias("ratio"))


GRAMS_SQL = "list_distinct(list_transform(range(1, greatest(length({s}) - 1, 2)), lambda i: substr({s}, i, 3)))"


def grams_sql(s: str) -> str:
    return GRAMS_SQL.format(s=s)


DICE_SQL = "2.0::DOUBLE * len(list_intersect(x.g, y.g))::DOUBLE / (len(x.g) + len(y.g))"


@query(f"""WITH s AS (SELECT p_partkey AS code, p_brand AS grp, ' ' || replace(p_name, ' ', '') || ' ' AS name, p_size AS size FROM part),
g AS (SELECT code, grp, size, {grams_sql('name')} AS g FROM s)
SELECT x.code AS "left", y.code AS "right", {DICE_SQL} AS similarity FROM g x JOIN g y ON x.grp = y.grp AND x.code < y.code AND x.code % 2 = 0 AND y.code % 2 = 1
WHERE {DICE_SQL} >= 0.5 OR x.size = y.size""")
def fuzzy_gated_join(spark, sf_dir):
    """Pairs in a group whose names are alike or whose sizes are equal."""
    left, right = name_sides(Tables(spark, sf_dir), "size")
    close = alike.alike(left, right, 0.5).select("left", "right", F.col("score").alias("similarity"))
    equal = alike.scored_equals(left, right, "size").where("score < 0.5").select("left", "right", F.col("score").alias("similarity"))
    return close.unionAll(equal).where("left < right")


MUTUAL_SQL = f"""s AS (SELECT p_partkey AS code, p_brand AS grp, ' ' || replace(p_name, ' ', '') || ' ' AS name FROM part),
g AS (SELECT code, grp, {grams_sql('name')} AS g FROM s),
pairs AS (SELECT x.code AS l, y.code AS r, {DICE_SQL} AS score FROM g x JOIN g y ON x.grp = y.grp AND x.code % 2 = 0 AND y.code % 2 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS a, row_number() OVER (PARTITION BY r ORDER BY score DESC, l) AS b FROM pairs WHERE score > 0.2)"""


def name_sides(t: Tables, *more: str, shift: int = 0):
    """Parts of even and of odd numbers by brand, the odd ones' brands moved along by `shift`."""
    rows = t.part.select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("grp"), F.col("p_size").alias("size"), names.padded_grams(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("grams"))
    left, right = rows.where("code % 2 = 0"), rows.where("code % 2 = 1")
    if shift:
        groups = t.part.select("p_brand").distinct().withColumn("k", F.dense_rank().over(Window.orderBy("p_brand")) - 1)
        n = groups.select("p_brand", "k")
        swapped = n.withColumnRenamed("p_brand", "grp").join(n.agg(F.count("*").alias("n"))).withColumn("to", (F.col("k") + shift) % F.col("n"))
        moved = swapped.join(n.select(F.col("p_brand").alias("other"), F.col("k").alias("to")), "to").select("grp", "other")
        right = right.join(moved, "grp").withColumn("grp", F.col("other")).drop("other")
    columns = ["code", "grp", "grams", *more]
    return left.select(columns), right.select(columns)


@query(f'WITH {MUTUAL_SQL} SELECT l AS "left", r AS "right", score FROM k WHERE a = 1 AND b = 1')
def mutual_best_match(spark, sf_dir):
    return alike.mutual_alike(*name_sides(Tables(spark, sf_dir)), 0.2)


@query(f"""WITH {MUTUAL_SQL}, brands AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand FROM part)),
moved AS (SELECT x.p_brand AS grp, y.p_brand AS other FROM brands x JOIN brands y ON y.k = (x.k + 7) % x.n),
d AS (SELECT x.code AS l, y.code AS r, {DICE_SQL} AS score FROM g x JOIN (SELECT g.code, moved.other AS grp, g.g FROM g JOIN moved USING (grp)) y ON x.grp = y.grp AND x.code % 2 = 0 AND y.code % 2 = 1),
dk AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS a, row_number() OVER (PARTITION BY r ORDER BY score DESC, l) AS b FROM d WHERE score > 0.2),
c AS (SELECT (SELECT count(*) FROM k WHERE a = 1 AND b = 1) AS matches, (SELECT count(*) FROM dk WHERE a = 1 AND b = 1) AS decoys)
SELECT matches, decoys, decoys::DOUBLE / nullif(matches::DOUBLE, 0) AS chance FROM c""")
def decoy_join(spark, sf_dir):
    """How many matches the join makes against groups swapped seven along."""
    t = Tables(spark, sf_dir)
    best = lambda shift: alike.mutual_alike(*name_sides(t, shift=shift), 0.2)
    return matching.decoy_share(best(0), best(7))


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS row_idx, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey END ORDER BY l_orderkey * 10 + l_linenumber, l_suppkey, l_quantity) AS k, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey END AS tag FROM lineitem),
s AS (SELECT tag, CASE WHEN tag IS NULL OR tag % 5 = 0 THEN 'unmatched' WHEN k > 1 THEN 'rejected' ELSE 'matched' END AS status, CASE WHEN tag IS NULL THEN 'no tag' WHEN tag % 5 = 0 THEN 'unknown code' WHEN k > 1 THEN 'taken' END AS reason FROM r)
SELECT tag, status, reason, count(*) AS n FROM s GROUP BY ALL""")
def tag_claims(spark, sf_dir):
    """Rows that claim a unit by its tag: the first has it."""
    t = Tables(spark, sf_dir)
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey")).alias("tag"))
    units = t.part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("code"))
    return matching.claimed(rows, units, "tag").groupBy("tag", "status", "reason").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS row_idx, p_brand AS code, p_size AS people, p_retailprice AS homes, p_type AS kind FROM part")
def positional_zip(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    sheet = lambda *cols: part.select(F.col("p_partkey").alias("row_idx"), F.col("p_brand").alias("code"), *cols)
    return matching.zipped([sheet(F.col("p_size").alias("people")), sheet(F.col("p_retailprice").alias("homes")), sheet(F.col("p_type").alias("kind"))])


@query("""SELECT c_custkey AS code, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'first' END, CASE WHEN c_custkey % 2 = 0 THEN 'second' END, CASE WHEN c_custkey % 5 = 0 THEN 'third' END) AS name,
  CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN 1 WHEN c_custkey % 5 = 0 THEN 2 END AS source FROM customer""")
def source_precedence(spark, sf_dir):
    codes = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("code"))
    sources = [codes.where(f"code % {k} = 0").withColumn("name", F.lit(n)) for k, n in ((3, "first"), (2, "second"), (5, "third"))]
    return matching.precedence(codes, sources, "code", "name")


@query("""WITH r AS (SELECT s_suppkey AS code, s_nationkey AS grp, s_acctbal AS x, (s_suppkey % 100)::DOUBLE AS y FROM supplier),
d AS (SELECT a.code, b.code AS twin, ((a.x - b.x) / 300) * ((a.x - b.x) / 300) + ((a.y - b.y) / 10) * ((a.y - b.y) / 10) AS distance FROM r a JOIN r b ON a.grp <> b.grp AND abs(a.x - b.x) <= 300 AND abs(a.y - b.y) <= 10)
SELECT code, twin, distance FROM d QUALIFY row_number() OVER (PARTITION BY code ORDER BY distance, twin) = 1""")
def nearest_twin(spark, sf_dir):
    rows = Tables(spark, sf_dir).supplier.select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("grp"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 100).cast("double").alias("y"))
    return matching.nearest_twin(rows, "code", "grp", ["x", "y"], [300.0, 10.0])


SQUARES_SQL = """WITH cells AS (SELECT s_suppkey AS unit, s_suppkey % 10 AS cx, s_suppkey // 10 AS cy FROM supplier WHERE s_suppkey % 6 <> 0),
seg AS (
  SELECT unit, cx AS x1, cy AS y1, cx + 1 AS x2, cy AS y2 FROM cells UNION ALL SELECT unit, cx, cy + 1, cx + 1, cy + 1 FROM cells
  UNION ALL SELECT unit, cx, cy, cx, cy + 1 FROM cells UNION ALL SELECT unit, cx + 1, cy, cx + 1, cy + 1 FROM cells
), edges AS (SELECT x.unit AS a, y.unit AS b, count(*)::DOUBLE AS length FROM seg x JOIN seg y ON x.x1 = y.x1 AND x.y1 = y.y1 AND x.x2 = y.x2 AND x.y2 = y.y2 AND x.unit < y.unit GROUP BY ALL)"""


def square_edges(t: Tables):
    """Suppliers as squares on a grid, each ring in order; their shared sides."""
    cells = t.supplier.where("s_suppkey % 6 <> 0").select(F.col("s_suppkey").alias("unit"), (F.col("s_suppkey") % 10).alias("cx"), F.floor(F.col("s_suppkey") / 10).alias("cy"))
    corner = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    side = [F.struct((F.col("cx") + a).alias("x1"), (F.col("cy") + b).alias("y1"), (F.col("cx") + c).alias("x2"), (F.col("cy") + d).alias("y2")) for (a, b), (c, d) in zip(corner, corner[1:])]
    return matching.shared_edges(cells.select("unit", F.explode(F.array(*side)).alias("s")).select("unit", "s.*", F.lit(1.0).alias("length")))


@query(SQUARES_SQL + " SELECT * FROM edges")
def shared_segments(spark, sf_dir):
    return square_edges(Tables(spark, sf_dir))


@query(SQUARES_SQL.replace("WITH cells", "WITH RECURSIVE cells") + """, sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a)
SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a""")
def border_components(spark, sf_dir):
    return graph.components(square_edges(Tables(spark, sf_dir)))


@query(SQUARES_SQL + ", sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges) SELECT a AS unit, list_sort(list(b)) AS neighbours FROM sym GROUP BY 1")
def adjacency_lists(spark, sf_dir):
    return matching.both_ways(square_edges(Tables(spark, sf_dir))).groupBy(F.col("a").alias("unit")).agg(F.sort_array(F.collect_list("b")).alias("neighbours"))


@query("""SELECT c_custkey AS code, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS marked,
  (SELECT arg_min(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS earliest FROM customer""")
def mark_join_and_first(spark, sf_dir):
    """A flag for existence, and the first value by order."""
    t = Tables(spark, sf_dir)
    marked = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("code")).distinct().withColumn("marked", F.lit(True))
    first = t.orders.groupBy(F.col("o_custkey").alias("code")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("earliest"))
    rows = t.customer.select(F.col("c_custkey").alias("code")).join(marked, "code", "left").join(first, "code", "left")
    return rows.select("code", F.coalesce("marked", F.lit(False)).alias("marked"), "earliest")


@query("""WITH p AS (SELECT substr(lpad(p_partkey::VARCHAR, 9, '0'), 1, 7) AS parent, p_partkey AS code FROM part), c AS (SELECT DISTINCT substr(lpad(p_partkey::VARCHAR, 9, '0'), 1, 7) AS parent FROM part WHERE p_partkey % 200 < 150)
SELECT c.parent, count(code) AS n, min(code) AS first FROM c JOIN p USING (parent) GROUP BY 1""")
def prefix_join(spark, sf_dir):
    """Leaves to the units whose code theirs starts with."""
    placed = _placed_parts(Tables(spark, sf_dir)).where("parent is not null")
    return placed.groupBy("parent").agg(F.count("key").alias("n"), F.min("key").alias("first"))


def _placed_parts(t: Tables):
    """Parts by nine digits under the units that seven of them name, which some lack."""
    leaves = t.part.select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("code"), F.col("p_partkey").alias("key"), F.col("p_brand").alias("name"), F.col("p_size").alias("size"))
    parents = leaves.where("key % 200 < 150").select(F.substring("code", 1, 7).alias("code")).distinct()
    return matching.placed_under(leaves, parents, 7)


@query("""WITH p AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS code, substr(lpad(p_partkey::VARCHAR, 9, '0'), 1, 7) AS parent, p_brand AS name, p_size AS size, p_partkey AS key FROM part),
c AS (SELECT DISTINCT parent FROM p WHERE key % 200 < 150), l AS (SELECT parent, name, size FROM p WHERE key % 3 = 0)
SELECT code, CASE WHEN parent NOT IN (SELECT parent FROM c) THEN 'no parent' WHEN NOT EXISTS (SELECT 1 FROM l WHERE l.parent = p.parent AND l.name = p.name) THEN 'not listed' ELSE 'other size' END AS problem FROM p
WHERE parent NOT IN (SELECT parent FROM c) OR NOT EXISTS (SELECT 1 FROM l WHERE l.parent = p.parent AND l.name = p.name AND l.size = p.size)""")
def placing_problems(spark, sf_dir):
    """Leaves without a unit, and those that their unit's list of names and sizes, a third of all here, doesn't have."""
    placed = _placed_parts(Tables(spark, sf_dir))
    listed = placed.where("key % 3 = 0").select("parent", "name", "size")
    return matching.placing_problems(placed, listed)


@query("""WITH m AS (SELECT p_brand AS a, p_type AS b, p_partkey AS code FROM part), k AS (SELECT b, min(a) AS a FROM m GROUP BY b HAVING count(DISTINCT a) <= 2)
SELECT code, m.b AS name, coalesce(k.a, m.a) AS unit FROM m LEFT JOIN k USING (b)""")
def reassigned_names(spark, sf_dir):
    """A name that occurs in few units goes to the first of them."""
    rows = Tables(spark, sf_dir).part.select(F.col("p_brand").alias("a"), F.col("p_type").alias("name"), F.col("p_partkey").alias("code"))
    few = rows.groupBy("name").agg(F.count_distinct("a").alias("n"), F.min("a").alias("to")).where("n <= 2").select("name", "to")
    return rows.join(few, "name", "left").select("code", "name", F.coalesce("to", "a").alias("unit"))
