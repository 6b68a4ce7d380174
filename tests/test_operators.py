"""Operators on small inputs with known results."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiersight.functions import numbers
from tiersight.functions import text as names
from tiersight.operators import graph, hypotheses, listing, matching, ranks, records, rollups, textsearch, validators
from tiersight.plans import views


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "name,want",
    [("Tétouan", "tetouan"), ("L'Oulja - El  Jadida", "l oulja el jadida"), ("أكادير", "اكادير"), ("سلا ـ ة", "سلا ه"), ("ݣلميم", "كلميم"), ("", "")],
)
def test_normalise(spark, name, want):
    assert one(spark, names.normalise(F.lit(name))) == want


@pytest.mark.parametrize("a,b", [("tetouan", "titwan"), ("essaouira", "souira"), ("el jadida", "jdida"), ("ketama", "ktama")])
def test_skeletons_meet(spark, a, b):
    x, y = (one(spark, names.skeleton(F.lit(s))) for s in (a, b))
    assert x == y or {x, y} == {"swr", "sr"}


def test_text_functions(spark):
    assert one(spark, names.trigrams(F.lit("abcd"))) == ["abc", "bcd"] and one(spark, names.trigrams(F.lit("ab"))) == ["ab"] and one(spark, names.trigrams(F.lit(""))) == []
    assert one(spark, names.slugify(F.lit("Province de la Côte d’Or"))) == "cote-d-or"
    assert one(spark, names.padded_code(F.lit("1.511.01"))) == "000151101"
    assert one(spark, names.dotted_code(F.lit("1.511.01.10"), F.lit("1.511"))) == "01.511.01.10"
    assert one(spark, names.dotted_code(F.lit("1511"), F.lit("1511"))) == "01.511"
    assert one(spark, names.numbers_in(F.lit("1 234,5 and -2.5"))) == [1234.5, -2.5]
    assert one(spark, names.dice(names.padded_grams(F.lit("rhafsai")), names.padded_grams(F.lit("ghafsai")))) == pytest.approx(2 * 5 / 14)
    assert one(spark, names.closeness(F.lit("el jadida"), F.lit("jadida"))) == 1.0
    assert one(spark, names.route(F.lit("/api/communes/01.511/x?y"))) == "/api/communes/:id/x"
    assert names.snake("age.averageSize") == "age_average_size"
    with pytest.raises(Exception, match="no code"):
        one(spark, names.padded_code(F.lit("12345678901")))


def test_numbers(spark):
    assert [one(spark, numbers.half_up(F.lit(x))) for x in (-2.5, 2.5, 0.49)] == [-2.0, 3.0, 0.0]
    low_high = one(spark, numbers.wilson(F.lit(45), F.lit(50)))
    assert low_high.low == pytest.approx(0.7864, abs=1e-4) and low_high.high == pytest.approx(0.9565, abs=1e-4)
    assert tuple(one(spark, numbers.wilson(F.lit(0), F.lit(0)))) == (0.0, 1.0)
    assert one(spark, numbers.normal_cdf(F.lit(1.96))) == pytest.approx(0.975, abs=1e-4)
    assert one(spark, numbers.per(F.lit(1), F.lit(0))) is None


def test_discoveries(spark):
    ps = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216, 0.222, 0.251, 0.269, 0.275, 0.34, 0.341, 0.384, 0.569, 0.594, 0.696, 0.762, 0.94, 0.942, 0.975, 0.986]
    rows = hypotheses.discoveries(spark.createDataFrame(list(enumerate(ps)), "id long, p double"), "p", 0.25, "id")
    assert sorted(r.id for r in rows.where("found").collect()) == [0, 1, 2, 3, 4, 5]


def test_statistics(spark):
    rows = spark.createDataFrame([(1, x, y) for x, y in zip([1, 2, 3, 4, 5], [5, 6, 7, 8, 7])], "g int, x int, y int")
    assert hypotheses.spearman(rows, ["g"], "x", "y").first().rho == pytest.approx(0.8207826816681233)
    p = hypotheses.permutation_p(rows, "g", "x", "y", rounds=99).first()
    assert p.rho == pytest.approx(0.8207826816681233) and 0.01 <= p.p <= 0.3
    draw = hypotheses.stream(42)
    assert [draw() for _ in range(2)] == pytest.approx([0.6011037519201636, 0.44829055899754167])
    labels = spark.createDataFrame([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15, "a string, b string")
    assert hypotheses.agreement(labels, [], "a", "b").first().kappa == pytest.approx(0.4)
    two = spark.createDataFrame([("a", True, float(v)) for v in (1, 2, 3)] + [("a", False, float(v)) for v in (4, 5, 6)], "g string, first boolean, v double")
    assert hypotheses.mann_whitney(two, ["g"], "first", "v").first().p == pytest.approx(0.0495, abs=1e-3)


def test_permutations_against_all_of_them(spark):
    a, b = [1, 2, 3, 4, 5, 5], [2, 1, 4, 3, 6, 6]
    known = [(1, x, y) for x, y in zip(a, b)]
    rows = spark.createDataFrame([*known, (1, None, 3), (1, 9, None), (2, 1, 1), (2, 1, 2), (3, 4, 4), *[(4, i // 3, -(i // 3)) for i in range(30)]], "g int, x int, y int")
    got = {r.g: r for r in hypotheses.permutation_p(rows, "g", "x", "y", rounds=2000).collect()}
    twice = lambda v: np.array([2 * sum(o < x for o in v) + sum(o == x for o in v) + 1 for x in v])
    p, q = twice(a), twice(b)
    apart = lambda order: abs(len(p) * int(p @ q[list(order)]) - p.sum() * q.sum())
    every = [apart(o) >= apart(range(6)) for o in itertools.permutations(range(6))]
    assert got[1].n == 6 and got[1].p == pytest.approx(np.mean(every), abs=0.02)
    assert (got[2].rho, got[2].p, got[3].rho, got[3].n) == (None, None, None, 1)
    assert got[4].rho == -1.0 and got[4].p == pytest.approx(1 / 2001)
    again = {r.g: r for r in hypotheses.permutation_p(rows.repartition(7), "g", "x", "y", rounds=2000, tasks=3).collect()}
    assert again == got
    seeded = hypotheses.permutation_p(rows.where("g = 1"), "g", "x", "y", rounds=2000, seed=F.lit(77)).first()
    assert seeded.p != got[1].p and seeded.p == pytest.approx(got[1].p, abs=0.02)
    with pytest.raises(Exception, match="too many"):
        hypotheses.permutation_p(rows, "g", "x", "y", rounds=9, largest=5).collect()
    assert hypotheses.permutation_p(rows.limit(0), "g", "x", "y").collect() == []


def test_hierarchy(spark):
    kinds = "region province cercle commune centre commune district province commune arrondissement region commune".split()
    rows = spark.createDataFrame([(i, 0, k, f"c{i}") for i, k in enumerate(kinds)], "row_idx long, part int, kind string, code string")
    got = {r.row_idx: r for r in ranks.filled_down(rows, "part").collect()}
    assert (got[3].type, got[3].in_cercle, got[3].in_province) == ("rural", "c2", "c1")
    assert got[4].in_commune == "c3" and got[5].in_cercle == "c2" and got[6].in_province == "c1"
    assert (got[8].type, got[8].in_province, got[8].in_cercle) == ("urban", "c7", None)
    assert got[9].in_commune == "c8" and (got[11].in_region, got[11].in_province) == ("c10", None)


def test_borders_share_a_segment_not_a_corner(spark):
    side = lambda u, x1, y1, x2, y2: (u, x1, y1, x2, y2, 2.0)
    rows = [side("a", 0, 0, 1, 0), side("a", 1, 0, 1, 1), side("b", 1, 1, 1, 0), side("b", 1, 0, 2, 0), side("c", 1, 1, 2, 2)]
    got = matching.shared_edges(spark.createDataFrame(rows, "unit string, x1 int, y1 int, x2 int, y2 int, length double")).collect()
    assert [tuple(r) for r in got] == [("a", "b", 2.0)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7), (None, 3), (100, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sort_paths_and_pages():
    assert listing.sort_of("-change.labour.rate", {"labour.rate"}, {"labour.rate"}) == listing.Sort(True, "change", "labour.rate")
    assert listing.sort_of("2014.age.75+", {"age.75+"}).kind == "before" and listing.sort_of("name", set()).kind == "record"
    for wrong in ("x", "labour.other", "change.labour.rate", "a.b.c.d"):
        with pytest.raises(ValueError):
            listing.sort_of(wrong, {"labour.rate"})
    with pytest.raises(ValueError):
        listing.page_of(0)
    assert views.written_answer({}, None, False) == "all" and views.written_answer({"region": "01"}, "code", False) == "region/01"
    assert views.written_answer({"region": "01"}, "-name", False) is None and views.written_answer({}, None, True) is None


def test_written_answers(spark, tmp_path):
    rows = spark.range(5)
    rows.write.parquet(f"{tmp_path}/all")
    assert views.answer(spark, str(tmp_path), {"all"}, {}, None, False, lambda: 1 / 0).count() == 5
    assert views.answer(spark, str(tmp_path), {"all"}, {"a": 1}, None, False, lambda: rows.limit(2)).count() == 2


def test_validators_fire(spark):
    facts = spark.createDataFrame([("a", "all", 3.0), ("a", "m", 1.0), ("a", "f", 1.0), ("b", "all", 2.0), ("b", "m", 1.0), ("b", "f", 1.0), ("c", "all", 9.0), ("c", "m", None), ("c", "f", 1.0)], "code string, path string, value double")
    problems = validators.unequal_parts(facts, "all", ["m", "f"])
    assert [r.code for r in problems.collect()] == ["a"]
    with pytest.raises(ValueError, match="all is not its parts: a"):
        validators.fail_on(problems)
    validators.fail_on(problems.where("false"))


def test_zip_refuses_other_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "row_idx int, code string")
    b = spark.createDataFrame([(1, "x", 5), (2, "z", 6)], "row_idx int, code string, v int")
    with pytest.raises(Exception, match="rows differ at 2"):
        matching.zipped([a, b]).collect()


def test_greedy_cover(spark):
    rows = spark.createDataFrame([(i, d, 10) for i, d in enumerate([5, 5, 4, 3, 2, 1])], "code long, density int, amount long")
    assert sorted(r.code for r in rollups.greedy_cover(rows, "code", "density", "amount").collect()) == [0, 1, 2]


def test_groups_postcodes_and_addresses(spark):
    rows = spark.createDataFrame([("1", "a", "g", 2)], "code string, name string, grp string, n int")
    groups = spark.createDataFrame([("g",), ("h",)], "grp string")
    assert records.group_of(rows, groups, "grp", "g", []).columns == ["code", "name", "grp"] and records.group_of(rows, groups, "grp", "h").count() == 0
    with pytest.raises(ValueError, match="no grp x"):
        records.group_of(rows, groups, "grp", "x")
    assert one(spark, names.village_in(F.lit("دوار النخلة جماعة الواد"), arabic=True)) == "النخلة"
    assert one(spark, names.village_in(F.lit("rue des Douarnenez"))) is None
    assert one(spark, records.bare_arabic(F.lit("ال واد"))) == "واد" and one(spark, records.bare_arabic(F.lit("الو"))) == "الو"


def test_villages_in_arabic(spark):
    entries = spark.createDataFrame([("1", "وادي", "wadi", ["wd"], 5), ("2", "ايت وادي", "ait wadi", ["twd"], 9), ("3", "بوادي", "bouadi", ["bd"], 7)], "code string, arabic string, latin string, keys array<string>, people int")
    asked = spark.createDataFrame([("وا", []), ("wadi", ["wd"]), ("", [])], "query string, keys array<string>")
    got = {(r.query, r.place): (r.code, r["rank"], r.total) for r in textsearch.villages(entries, asked).collect()}
    assert got[("وا", 1)] == ("1", 0, 3) and got[("وا", 2)] == ("2", 1, 3) and got[("وا", 3)] == ("3", 2, 3)
    assert got[("wadi", 1)] == ("1", -1, 2) and got[("wadi", 2)][0] == "2"


def test_axis_ticks_and_running_sums(spark):
    assert one(spark, numbers.decade_ticks(F.lit(0.1), F.lit(1000.0))) == [0.1, 1.0, 10.0, 100.0, 1000.0]
    rows = spark.range(1000).select("id", (F.col("id") * 7 % 13).alias("v"))
    got = {r.id: r.b for r in ranks.summed_before(rows, [F.desc("v"), F.asc("id")], "v", "b").collect()}
    total, want = 0, {}
    for i in sorted(range(1000), key=lambda i: (-(i * 7 % 13), i)):
        want[i] = total
        total += i * 7 % 13
    assert got == want
