from tiersight.operators import gazetteers, matching, ranks


def test_leaves_are_placed_by_prefix(spark):
    leaves = spark.createDataFrame([("1230", "A", 5), ("1231", "B", None), ("1240", "C", 1), ("1231", "B", None), ("1232", "D", 7), ("1233", "A", 6)], "code string, name string, size int")
    parents = spark.createDataFrame([("99123",), ("98123",), ("99125",)], "code string")
    placed = matching.placed_under(leaves, parents, 3, skip=2)
    assert sorted((r.code, r.parent) for r in placed.collect()) == [("1230", "98123"), ("1231", "98123"), ("1231", "98123"), ("1232", "98123"), ("1233", "98123"), ("1240", None)]
    problems = lambda df: sorted((r.code, r.problem) for r in df.collect())
    assert problems(matching.placing_problems(placed)) == [("1231", "listed twice"), ("1240", "no parent")]
    listed = spark.createDataFrame([("98123", "A", 5), ("98123", "B", None), ("98123", "X", 7)], "parent string, name string, size int")
    assert problems(matching.placing_problems(placed, listed)) == [("1231", "listed twice"), ("1232", "not listed"), ("1233", "other size"), ("1240", "no parent")]
    assert matching.placing_problems(matching.placed_under(leaves.limit(0), parents.limit(0), 3)).collect() == []


def test_the_widest_gap_to_a_neighbour(spark):
    units = spark.createDataFrame([(1, 100, False), (2, 100, None), (3, 5, False), (4, 100, True), (5, 100, False)], "code int, population int, flagged boolean")
    edges = matching.both_ways(spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5)], "a int, b int"))
    figures = spark.createDataFrame([(1, "x", 10.0), (1, "y", 0.0), (2, "x", 40.0), (2, "y", 30.04), (3, "x", 99.0), (4, "x", 99.0), (5, "x", None), (5, "y", 29.94)], "code int, path string, value double")
    got = sorted(map(tuple, matching.widest_gap(units, edges, figures, 30, 50).collect()))
    assert got == [(1, 2, "x", 10.0, 40.0, 30.0), (2, 1, "x", 40.0, 10.0, 30.0)]


def test_places_of_a_list(spark):
    units = spark.createDataFrame([("u", "Fès", "فاس"), ("v", None, None)], "code string, fr string, ar string")
    places = [(1, "u", "Hay Salam", None), (2, "u", "hay  salam", ""), (3, "u", " ", None), (4, "u", "Bd. Zerktouni", "x"), (5, None, "Oasis", None), (6, "w", "Oasis", None), (7, "u", "FES", "y"), (8, "u", "", "فاس"), (9, "v", "Hay Salam", None), (10, "u", "Routes", None), (11, "u", "Hay Salam", "ب")]
    got = {r.row: r.state for r in gazetteers.place_states(spark.createDataFrame(places, "row int, unit string, fr string, ar string"), units).collect()}
    assert got == {1: "kept", 2: "repeat", 3: "unnamed", 4: "street", 5: "outside", 6: "outside", 7: "unit", 8: "unit", 9: "kept", 10: "kept", 11: "kept"}


def test_short_lists(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("a", 3, 7.0), ("a", 4, None), ("b", 1, 1.0), *[("c", i, 1.0) for i in range(4)], ("d", 1, None), (None, 1, 2.0)], "s string, code int, v double")
    got = sorted((r.s, r.place, r.code) for r in ranks.short_lists(rows, "s", "v", ["code"], 3).collect())
    assert got == [("a", 1, 2), ("a", 2, 3), ("a", 3, 1), ("b", 1, 1)]
    assert ranks.short_lists(rows.limit(0), "s", "v", ["code"]).collect() == []
