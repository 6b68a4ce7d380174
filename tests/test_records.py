import pytest
from pyspark.sql import functions as F

from tiersight.operators import places, records


def squares(cells):
    corner = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    return [(1, float(x + a), float(y + b), float(x + c), float(y + d)) for x, y in cells for (a, b), (c, d) in zip(corner, corner[1:])]


def test_holes_islands_and_outline(spark):
    ring = [(x, y) for x in range(4) for y in range(4) if (x, y) != (1, 1)] + [(9, 9)]
    edges = places.outlines(spark.createDataFrame(squares(ring), "grp int, x1 double, y1 double, x2 double, y2 double"))
    assert records.outline_parts(edges).count() == 3
    holes = records.coverage_holes(edges).collect()
    assert [(r.sides, r.west, r.south, r.east, r.north) for r in holes] == [(4, 1.0, 1.0, 2.0, 2.0)]


def test_second_pass(spark):
    pairs = spark.createDataFrame([("a", "p", "g", 0.9, 30.0, -9.0), ("b", "q", "g", 0.8, 30.01, -9.0), ("c", "r", "g", 0.95, 31.0, -9.0), ("d", "s", "g", 0.5, 30.0, -9.0)], "left string, right string, grp string, score double, lat double, lng double")
    matched = spark.createDataFrame([("a", "p", "g", 30.0, -9.0)], "left string, right string, grp string, lat double, lng double")
    assert [(r.left, r.right) for r in records.second_pass(pairs, matched).collect()] == [("b", "q")]


def test_keys_of_visitors(spark):
    rows = spark.createDataFrame([("1.2.3.4", "2024-01-01"), ("1.2.3.4", "2024-01-02"), ("1.2.3.4", "2024-01-01")], "a string, d string")
    keys = [r.k for r in rows.select(records.visitor_keys(F.col("a"), F.col("d"), b"secret").alias("k")).collect()]
    assert keys[0] == keys[2] != keys[1] and len(keys[0]) == 32


def test_both_ways_and_totals(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "code int, v string"), spark.createDataFrame([(1, "p")], "code int, w string")
    with pytest.raises(Exception, match="no match for 2"):
        records.matched_both_ways(a, b, "code").collect()
    row = spark.createDataFrame([(60.2, 40.0, 5), (60.0, 45.0, 0), (60.0, 45.0, 1)], "a double, b double, n int")
    assert [r.x for r in row.select(records.total_near([F.col("a"), F.col("b")], F.col("n")).alias("x")).collect()] == [True, True, False]
    bare = lambda f, name: spark.range(1).select(f(F.lit(name)).alias("x")).first().x
    assert bare(records.stripped_label_ar, "جماعة أكادير") == "أكادير"
    # a label is a word of its own; groupings carry two, the second in the plural; footnote marks go
    assert bare(records.stripped_label_ar, "عمالة مقاطعات النور*") == "النور" and bare(records.stripped_label_ar, "جماعةأكادير") == "جماعةأكادير"
    assert bare(records.stripped_label, "Régional") == "Régional" and bare(records.stripped_label, "PRÉFECTURE d'Arrondissements de Nord **") == "Nord"
