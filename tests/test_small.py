import datetime
import random

import pytest
from pyspark.sql import functions as F

from tiersight.functions import numbers
from tiersight.functions import text as names
from tiersight.operators import records, rollups, textsearch, validators
from tiersight.queries import recordkeeping
from tiersight.streaming import demand


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scripts_of_a_name(spark):
    got = one(spark, names.script_runs(F.lit("Tanger طنجة ⵟⴰⵏⵊⴰ 2")))
    assert got.latin.startswith("Tanger") and got.arabic.startswith("طنجة") and got.tifinagh.startswith("ⵟⴰⵏⵊⴰ")
    none = one(spark, names.script_runs(F.lit("")))
    assert (none.latin, none.arabic, none.tifinagh) == ("", "", "")


def test_where_requests_come_from(spark):
    kinds = {"https://www.google.com/search?q=x": "search", "https://own.test/a": "internal", "https://www.own.test/": "internal", "https://news.test/x": "site", "": "direct", "not a url": "direct"}
    assert {u: one(spark, names.referrer_class(F.lit(u), "own.test")) for u in kinds} == kinds and one(spark, names.referrer_class(F.lit(None).cast("string"), "own.test")) == "direct"
    assert [one(spark, names.crawler(F.lit(a))) for a in ("Mozilla/5.0", "Googlebot/2.1", None)] == [False, True, True]


def test_places_on_a_logarithmic_axis(spark):
    assert [one(spark, numbers.log_position(F.lit(x), 1.0, 100.0)) for x in (1.0, 10.0, 100.0)] == pytest.approx([0, 0.5, 1])


def test_units_of_a_level(spark):
    units = spark.createDataFrame([("0", "country"), ("1", "region"), ("2", "region")], "code string, level string")
    assert [sorted(r.code for r in records.at_level(units, **k).collect()) for k in ({}, {"level": "region"}, {"code": "2"}, {"code": "9"})] == [["0"], ["1", "2"], ["2"], []]


def test_pairs_that_are_not_one_to_one(spark):
    pairs = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "l string, r string")
    assert validators.not_bijective(pairs, "l", "r").count() == 1 and validators.not_bijective(pairs.where("l <> 'c'"), "l", "r").count() == 0


def test_weighted_means_of_rows_with_a_value(spark):
    rows = spark.createDataFrame([("g", 1.0, 3.0), ("g", 5.0, 1.0), ("g", None, 9.0), ("h", None, 1.0), ("i", 2.0, 0.0)], "g string, v double, w double")
    got = {r.g: r.m for r in rows.groupBy("g").agg(rollups.weighted_mean(F.col("v"), F.col("w")).alias("m")).collect()}
    assert got == {"g": 2.0, "h": None, "i": None}


def test_holes_of_squares(spark):
    holes = recordkeeping.coverage_holes(spark, "/root/testdata/sf0.01").where("hole").collect()
    # every sixth square of a block of ten by five is missing; those in its middle are holes
    assert holes and all(r.sides == 4 and r.east - r.west == r.north - r.south == 1 for r in holes)
    inside = {(u % 10, u // 10) for u in range(100) if u % 6 == 0 and 0 < u % 10 < 9 and 0 < u // 10 % 5 < 4}
    assert {(int(r.west), int(r.south)) for r in holes} == inside


def test_daily_counts_of_a_stream(spark, tmp_path):
    day = lambda d, h: datetime.datetime(2024, 1, d, h)
    rows = [(1, day(1, 3), "a"), (1, day(1, 3), "a"), (2, day(1, 9), "a"), (3, day(2, 1), "b"), (4, day(28, 1), "a")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, kind string").parquet(str(tmp_path / "in"))
    counts = demand.windowed_counts(stream).select(F.col("window.start").cast("date").cast("string").alias("day"), "kind", "n")
    written = demand.run_to_table(counts, str(tmp_path / "out"), str(tmp_path / "mark"))
    # the last day stays open until events come that are later than it by the watermark
    assert {tuple(r) for r in written.collect()} == {("2024-01-01", "a", 2), ("2024-01-02", "b", 1)}


def test_picker_by_few_and_by_many_queries(spark, monkeypatch):
    """Both ways of meeting give what a plain scan gives, and few queries need no runs of letters."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abei") for _ in range(rng.randint(1, 5)))
    rows = [(k, None if k % 50 == 0 else " ".join(word() for _ in range(rng.randint(1, 3))), None if k % 3 else word(), word(), float(k % 7)) for k in range(400)]
    units = spark.createDataFrame(rows, "code long, name string, arabic string, bones string, people double")
    asked = sorted({word() for _ in range(90)}) + ["ab e", ""]
    queries = spark.createDataFrame([(q, q.replace("a", "")) for q in asked], "query string, bones string")

    def plain(q, bones, name, arabic, own):
        names = [n for n in (name, arabic) if n is not None]
        tests = [any(n == q for n in names), any(n.startswith(q) for n in names), any(w.startswith(q) for n in names for w in n.split(" ")), len(bones) >= 2 and own.startswith(bones), len(q) >= 3 and any(q in n for n in names)]
        return next((k for k, t in enumerate(tests) if t), None)

    want = []
    for q in asked:
        found = sorted((t, -p, c) for c, name, arabic, own, p in rows if q and (t := plain(q, q.replace("a", ""), name, arabic, own)) is not None)
        want += [(q, c, t, k + 1) for k, (t, _, c) in enumerate(found[:8])]
    many = textsearch.picked(units, queries)
    monkeypatch.setattr(textsearch, "DIRECT", 1000)
    few = textsearch.picked(units, queries)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) == sorted(want)
    assert "Generate" in many._jdf.queryExecution().optimizedPlan().toString() and "Generate" not in few._jdf.queryExecution().optimizedPlan().toString()
