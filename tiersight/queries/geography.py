"""Geographic queries and checks of findings, on coordinates made from ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiersight.functions import geo
from tiersight.functions.numbers import half_up
from tiersight.operators import checks, matching, places, tiling, topology
from tiersight.queries.base import Tables, query
from tiersight.queries.joins import SQUARES_SQL

POINTS_SQL = """c AS (SELECT c_custkey AS code, 30.0 + (c_custkey * 37 % 600) / 100.0::DOUBLE AS lat, -9.0 + (c_custkey * 91 % 700) / 100.0::DOUBLE AS lng FROM customer),
s AS (SELECT s_suppkey AS point, 30.0 + (s_suppkey * 53 % 600) / 100.0::DOUBLE AS lat, -9.0 + (s_suppkey * 29 % 700) / 100.0::DOUBLE AS lng FROM supplier)"""
KM = "2 * 6371.0::DOUBLE * asin(sqrt(sin(radians({b}lat - {a}lat) / 2) * sin(radians({b}lat - {a}lat) / 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * sin(radians({b}lng - {a}lng) / 2) * sin(radians({b}lng - {a}lng) / 2)))"


def customer_points(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("code"), (F.lit(30.0) + (k * 37 % 600) / F.lit(100.0)).alias("lat"), (F.lit(-9.0) + (k * 91 % 700) / F.lit(100.0)).alias("lng"))


def supplier_points(t: Tables):
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("point"), (F.lit(30.0) + (k * 53 % 600) / F.lit(100.0)).alias("lat"), (F.lit(-9.0) + (k * 29 % 700) / F.lit(100.0)).alias("lng"))


@query(f"WITH {POINTS_SQL}, q AS (SELECT 33.5731::DOUBLE AS lat, -7.5898::DOUBLE AS lng), d AS (SELECT code, {KM.format(a='q.', b='c.')} AS km FROM c, q) SELECT code, floor(km * 1e6 + 0.5) / 1e6 AS km FROM d WHERE km <= 60.03 ORDER BY km, code LIMIT 25")
def near_point(spark, sf_dir):
    return places.near(customer_points(Tables(spark, sf_dir)), 33.5731, -7.5898, 60.03, 25).select("code", half_up(F.col("km"), 6).alias("km"))


@query(f"WITH {POINTS_SQL}, d AS (SELECT point, code, {KM.format(a='s.', b='c.')} AS km FROM s, c) SELECT point, code, floor(km * 1e6 + 0.5) / 1e6 AS km FROM d WHERE km <= 12.34")
def radius_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return places.within(supplier_points(t), customer_points(t), 12.34).withColumn("km", half_up(F.col("km"), 6))


@query(f"WITH {POINTS_SQL}, d AS (SELECT point, code, {KM.format(a='s.', b='c.')} AS km FROM s, c) SELECT point, code, floor(km * 1e6 + 0.5) / 1e6 AS km FROM d WHERE km <= 20.5 QUALIFY row_number() OVER (PARTITION BY point ORDER BY km, code) = 1")
def nearest_within_reach(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return places.nearest(supplier_points(t), customer_points(t), 20.5).withColumn("km", half_up(F.col("km"), 6))


def square_sides(t: Tables):
    cells = t.supplier.where("s_suppkey % 6 <> 0").select(F.col("s_suppkey").alias("unit"), (F.col("s_suppkey") % 10).alias("cx"), F.floor(F.col("s_suppkey") / 10).alias("cy"))
    corner = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    side = [F.struct((F.col("cx") + a).cast("double").alias("x1"), (F.col("cy") + b).cast("double").alias("y1"), (F.col("cx") + c).cast("double").alias("x2"), (F.col("cy") + d).cast("double").alias("y2")) for (a, b), (c, d) in zip(corner, corner[1:])]
    return cells.select("unit", F.explode(F.array(*side)).alias("s")).select("unit", "s.*")


@query("""WITH p AS (SELECT p_partkey AS point, (p_partkey * 17 % 1000) / 100.0::DOUBLE + 0.003 AS x, (p_partkey * 43 % 1100) / 100.0::DOUBLE + 0.003 AS y FROM part)
SELECT point, s_suppkey AS unit FROM p JOIN supplier ON s_suppkey % 6 <> 0 AND floor(x) = s_suppkey % 10 AND floor(y) = s_suppkey // 10""")
def point_in_polygon(spark, sf_dir):
    t = Tables(spark, sf_dir)
    k = F.col("p_partkey")
    points = t.part.select(k.alias("point"), ((k * 17 % 1000) / F.lit(100.0) + 0.003).alias("x"), ((k * 43 % 1100) / F.lit(100.0) + 0.003).alias("y"))
    return places.located(points, square_sides(t), 3.0)


@query("""WITH p AS (SELECT p_partkey AS point, (p_partkey * 17 % 1300) / 100.0::DOUBLE - 1.497 AS x, (p_partkey * 43 % 1100) / 100.0::DOUBLE + 0.003 AS y FROM part),
e AS (SELECT s_suppkey AS unit, (s_suppkey % 10)::DOUBLE AS x, (s_suppkey // 10)::DOUBLE AS y, 1.0 + s_suppkey % 3 AS w FROM supplier)
SELECT point, min(unit) FILTER ((p.x - e.x) / w + (p.y - e.y) < 1) AS unit, count(unit) AS candidates
FROM p LEFT JOIN e ON p.x BETWEEN e.x AND e.x + w AND p.y BETWEEN e.y AND e.y + 1 GROUP BY 1""")
def placed_in_boxes(spark, sf_dir):
    """Places in triangles: boxes first, then rings."""
    t = Tables(spark, sf_dir)
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    points = t.part.select(k.alias("point"), ((k * 17 % 1300) / F.lit(100.0) - 1.497).alias("x"), ((k * 43 % 1100) / F.lit(100.0) + 0.003).alias("y"))
    x, y, w = (s % 10).cast("double"), F.floor(s / 10).cast("double"), (1 + s % 3).cast("double")
    side = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    sides = F.array(side(x, y, x + w, y), side(x + w, y, x, y + 1), side(x, y + 1, x, y))
    edges = t.supplier.select(s.alias("unit"), F.explode(sides).alias("e")).select("unit", "e.*")
    return places.placed(points, edges, 2.0)


@query(SQUARES_SQL + ", g AS (SELECT unit // 20 AS grp, x1, y1, x2, y2, count(*) AS n FROM seg GROUP BY ALL HAVING count(*) % 2 = 1) SELECT grp, count(*) AS sides FROM g GROUP BY 1")
def dissolved_outlines(spark, sf_dir):
    """Outlines of groups of units: sides that two of a group share fall away."""
    sides = square_sides(Tables(spark, sf_dir)).withColumn("grp", F.floor(F.col("unit") / 20))
    return places.outlines(sides).groupBy("grp").agg(F.count("*").alias("sides"))


#: All squares are one part, which grows with the table; cells of the grid don't.
WIDEST = 0.001


def square_rings(t: Tables):
    """Corners of the squares as rings of one part."""
    cells = t.supplier.where("s_suppkey % 6 <> 0").select(F.col("s_suppkey").alias("unit"), (F.col("s_suppkey") % 10).alias("cx"), F.floor(F.col("s_suppkey") / 10).alias("cy"))
    corner = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    points = F.posexplode(F.array(*[F.struct((F.col("cx") + a).cast("double").alias("x"), (F.col("cy") + b).cast("double").alias("y")) for a, b in corner])).alias("seq", "p")
    return cells.select("unit", points).select(F.lit("all").alias("part"), "unit", F.lit(0).alias("ring"), "seq", "p.x", "p.y")


@query(SQUARES_SQL + ", u AS (SELECT unit, x1, y1, x2, y2, count(*) OVER (PARTITION BY x1, y1, x2, y2) AS n FROM seg) SELECT unit, 4 AS sides, sum((n > 1)::INTEGER)::BIGINT AS shared, 1.0::DOUBLE AS area FROM u GROUP BY unit")
def topology_of_squares(spark, sf_dir):
    """Squares cut into shared arcs, written as steps, and put together again: their sides, how many are shared, and their areas."""
    found = topology.built(square_rings(Tables(spark, sf_dir)), 100_001, WIDEST)
    again = found._replace(arcs=topology.summed_steps(topology.steps_of(found.arcs)))
    times = found.uses.groupBy("arc").agg(F.count("*").alias("n"))
    lengths = found.arcs.join(found.grid, "part").select("arc", F.expr("aggregate(sequence(1, size(cells) - 1), 0D, (a, i) -> a + abs(cells[i].x - cells[i - 1].x) * kx + abs(cells[i].y - cells[i - 1].y) * ky)").alias("length"))
    used = found.uses.join(times, "arc").join(lengths, "arc").groupBy("unit").agg(F.round(F.sum(F.when(F.col("n") > 1, F.col("length")).otherwise(0.0))).cast("long").alias("shared"), F.round(F.sum("length")).cast("int").alias("sides"))
    area = F.expr("abs(aggregate(sequence(0, size(points) - 2), 0D, (a, i) -> a + points[i].x * points[i + 1].y - points[i + 1].x * points[i].y)) / 2")
    areas = topology.rings_of(again).select("unit", half_up(area, 3).alias("area"))
    return used.join(areas, "unit").select("unit", "sides", "shared", "area")


@query(SQUARES_SQL + ", g AS (SELECT unit // 20 AS grp, x1, y1, x2, y2, count(*) AS n FROM seg GROUP BY ALL HAVING count(*) % 2 = 1), a AS (SELECT unit // 20 AS grp, count(DISTINCT unit)::DOUBLE AS area FROM seg GROUP BY 1) SELECT grp, a.area, count(*)::DOUBLE AS perimeter FROM g JOIN a USING (grp) GROUP BY ALL")
def dissolved_rings(spark, sf_dir):
    """Groups of units as closed rings with holes: area and perimeter."""
    rows = square_rings(Tables(spark, sf_dir))
    groups = rows.select("unit").distinct().withColumn("grp", F.floor(F.col("unit") / 20))
    nested = topology.nested(topology.dissolved(topology.built(rows, 100_001, WIDEST), groups), 2.0)
    around = F.expr("aggregate(sequence(0, size(points) - 2), 0D, (a, i) -> a + abs(points[i + 1].x - points[i].x) + abs(points[i + 1].y - points[i].y))")
    perimeter = nested.groupBy("grp").agg(F.sum(around).alias("perimeter"))
    return topology.features(nested).join(perimeter, "grp").select("grp", half_up(F.col("area"), 3).alias("area"), half_up(F.col("perimeter"), 3).alias("perimeter"))


@query("""WITH r AS (SELECT s_suppkey AS ring, (s_suppkey % 10)::DOUBLE AS cx, (s_suppkey // 10)::DOUBLE AS cy, 1.0 + s_suppkey % 3 AS w FROM supplier)
SELECT ring, floor(abs(2 * w * radians(1) * (sin(radians(cy + 1)) - sin(radians(cy)))) * 6371.0088 * 6371.0088 / 2 * 1e4 + 0.5) / 1e4 AS area_km2, w::DOUBLE AS shoelace, cx AS west, cy AS south, cx + w AS east, cy + 1 AS north FROM r""")
def ring_measures(spark, sf_dir):
    """Area, shoelace area and box of rectangles."""
    k = F.col("s_suppkey")
    base = Tables(spark, sf_dir).supplier.select(k.alias("ring"), (k % 10).cast("double").alias("cx"), F.floor(k / 10).cast("double").alias("cy"), (1 + k % 3).cast("double").alias("w"))
    corner = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    points = base.select("ring", F.posexplode(F.array(*[F.struct((F.col("cx") + a * F.col("w")).alias("x"), (F.col("cy") + b).alias("y")) for a, b in corner])).alias("seq", "p")).select("ring", "seq", "p.*")
    out = geo.ring_measures(points)
    return out.withColumn("area_km2", half_up(F.col("area_km2"), 4))


@query("""WITH d AS (SELECT l_orderkey AS arc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS seq, l_partkey % 9 - 4 AS dx, l_suppkey % 7 - 3 AS dy FROM lineitem)
SELECT arc, seq::BIGINT AS seq, sum(dx) OVER w * 0.5::DOUBLE - 9 AS x, sum(dy) OVER w * 0.25::DOUBLE + 30 AS y FROM d WINDOW w AS (PARTITION BY arc ORDER BY seq)""")
def decoded_arcs(spark, sf_dir):
    from pyspark.sql import Window

    rows = Tables(spark, sf_dir).lineitem
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")).cast("long")
    deltas = rows.select(F.col("l_orderkey").alias("arc"), seq.alias("seq"), (F.col("l_partkey") % 9 - 4).alias("dx"), (F.col("l_suppkey") % 7 - 3).alias("dy"))
    return geo.decoded_arcs(deltas, (0.5, 0.25), (-9, 30))


@query(f"WITH {POINTS_SQL} SELECT code, floor((lng + 180) / 360 * 256)::INTEGER AS tile_x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256)::INTEGER AS tile_y FROM c")
def map_tiles(spark, sf_dir):
    return places.tiles(customer_points(Tables(spark, sf_dir)), 8).select("code", "tile_x", "tile_y")


@query()
def projected_points(spark, sf_dir):
    """Eastings and northings as degrees."""
    k = F.col("s_suppkey")
    return Tables(spark, sf_dir).supplier.select(k.alias("code"), geo.merchich_to_degrees(F.lit(300000.0) + k * 1000, F.lit(200000.0) + k * 500).alias("at")).select("code", half_up(F.col("at.lat"), 6).alias("lat"), half_up(F.col("at.lng"), 6).alias("lng"))


@query("""WITH u AS (SELECT 'n' || n_nationkey AS code, 'nation' AS level, 'r' || n_regionkey AS parent, n_nationkey AS k FROM nation UNION ALL SELECT 'r' || r_regionkey, 'region', 'all', 100 + r_regionkey FROM region),
f AS (SELECT 'n' || c_nationkey AS code, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS now, count(*)::DOUBLE * 100 AS before FROM customer GROUP BY 1 UNION ALL SELECT 'r' || n_regionkey, sum(c_acctbal::DECIMAL(18,2))::DOUBLE, count(*)::DOUBLE * 100 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
x AS (SELECT u.*, f.now, f.before, p.now AS up, rank() OVER (PARTITION BY level ORDER BY f.now DESC) AS rank, count(*) OVER (PARTITION BY level) AS of, (SELECT median(n.now) FROM f n JOIN u m USING (code) WHERE m.level = u.level AND u.level = 'nation' AND abs(m.k - u.k) = 1) AS near, (SELECT count(*) FROM u m WHERE m.level = u.level AND abs(m.k - u.k) = 1) AS n FROM u LEFT JOIN f USING (code) LEFT JOIN f p ON p.code = u.parent)
SELECT 'a' || code AS id, CASE WHEN now > 100000 THEN 'passed' ELSE 'failed' END AS status, NULL::VARCHAR AS reason, now AS number FROM x WHERE level = 'nation'
UNION ALL SELECT 'b' || code, CASE WHEN now - before < 0 THEN 'passed' ELSE 'failed' END, NULL, now - before FROM x WHERE level = 'nation'
UNION ALL SELECT 'c' || code, CASE WHEN rank <= ceil(0.2 * of) THEN 'passed' ELSE 'failed' END, NULL, rank::DOUBLE FROM x WHERE level = 'nation'
UNION ALL SELECT 'd' || code, CASE WHEN up > 1000000 THEN 'passed' ELSE 'failed' END, NULL, up FROM x WHERE level = 'nation'
UNION ALL SELECT 'e' || code, CASE WHEN n < 2 THEN 'refused' WHEN near > 200000 THEN 'passed' ELSE 'failed' END, CASE WHEN n < 2 THEN 'too few neighbours' END, near FROM x WHERE level = 'nation'
UNION ALL SELECT 'f' || code, 'refused', 'too few places for that share', rank::DOUBLE FROM x WHERE level = 'nation'""")
def finding_checks(spark, sf_dir):
    """Comparisons, changes and ranks of a unit, its parent and its neighbours."""
    t = Tables(spark, sf_dir)
    code = F.concat(F.lit("n"), "n_nationkey")
    units = t.nation.select(code.alias("code"), F.lit("nation").alias("level"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).unionAll(t.region.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("region"), F.lit("all")))
    leaf = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    sums = lambda by: leaf.groupBy(by.alias("code")).agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("now"), (F.count("*").cast("double") * 100).alias("before"))
    both = sums(F.concat(F.lit("n"), "c_nationkey")).unionAll(sums(F.concat(F.lit("r"), "n_regionkey")))
    facts = both.unpivot(["code"], ["now", "before"], "period", "value").withColumn("path", F.lit("balance.total"))
    edges = t.nation.select(code.alias("a"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1).cast("string")).alias("b")).where("b <> 'n25'")
    base = {"id": None, "code": None, "kind": "compare", "subject": "self", "other": None, "path": "balance.total", "period": "now", "op": None, "value": None, "within": None, "position": None, "share": None}
    kinds = [{"id": "a", "op": ">", "value": 100000.0}, {"id": "b", "kind": "change", "op": "<", "value": 0.0}, {"id": "c", "kind": "rank", "within": "country", "position": "top", "share": 0.2}, {"id": "d", "subject": "parent", "op": ">", "value": 1000000.0}, {"id": "e", "subject": "neighbours", "op": ">", "value": 200000.0}, {"id": "f", "kind": "rank", "within": "country", "position": "bottom", "share": 0.01}]
    asked = spark.createDataFrame([tuple((base | k).values()) for k in kinds], checks.SCHEMA)
    asked = asked.drop("code").join(t.nation.select(code.alias("code"))).withColumn("id", F.concat("id", "code")).select(*[c.split()[0] for c in checks.SCHEMA.split(", ")])
    families = spark.createDataFrame([("balance.total", "balance"), ("other.total", "other")], "path string, family string")
    measures = units.select("code", F.lit("other.total").alias("measure"))
    return checks.evaluated(asked, units, facts, matching.both_ways(edges), families, measures)


@query()
def adaptive_tiles(spark, sf_dir):
    """Squares' outlines in tiles that are split where they hold many points."""
    rings = square_rings(Tables(spark, sf_dir)).groupBy("unit", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).select("unit", "ring", F.transform("p", lambda p: F.struct(p["x"] / 4 + 0.013, p["y"] / 4 + 0.017)).cast("array<struct<x:double,y:double>>").alias("points"))
    leaves, _ = tiling.adaptive_tiles(rings, (0.0, 0.0), 24, 4)
    return tiling.tile_steps(leaves, (0.0, 0.0), 1e-4).select("z", "x", "y", "unit", "ring", F.size("points").alias("n"), F.to_json("flat").alias("flat"))
