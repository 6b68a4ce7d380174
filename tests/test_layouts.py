import pytest
from pyspark.sql import functions as F

from tiersight.sources.layouts import Figure, Layout, Sheet, checked, figures, french_half, layout_problems, source_registry

SCHEMA = "path string, sheet int, row_idx long, cells array<string>"
READ, WRITE = Figure("read", "Languages · read"), Figure("write", "Languages · write")
BLOCKS = Layout(
    [Sheet(1, [READ, WRITE]), Sheet(2, [READ, WRITE], "urban")], first=2, code=0, label=1, top=3, header=[1, 2], filled=[1],
    sexes={"all": "Both", "male": "Men"}, opens="Land", missing=("", "-"), total="Total",
)
HEAD = [
    [None, "area", "both", None, None, "Men"],
    [None, None, "Languages", None, None, "Languages "],
    ["code", "name", "read", "write", "Total", "read", "write", "Total"],
]


def sheet(number, units, head=HEAD):
    return [("b", number, i, cells) for i, cells in enumerate(head + units)]


LAND = [None, "Land", "40.04", "59.96", "100", "-", "50", "100.4"]
TOWN = ["01.511", "Old  town", "0", "0", "0", None, None, None]


def test_blocks(spark):
    rows = spark.createDataFrame(sheet(1, [LAND, TOWN, [None, " "]]) + sheet(2, [LAND, [], TOWN]), SCHEMA)
    got = {(r.n, r.code, r.label, r.area, r.sex, r.name): r.value for r in figures(checked(rows, BLOCKS), BLOCKS).collect()}
    assert len(got) == 2 * 2 * 2 * 2
    assert got[1, None, "Land", "total", "all", "read"] == 40.0 and got[1, None, "Land", "urban", "all", "write"] == 60.0
    assert got[1, None, "Land", "total", "male", "read"] is None and got[2, "01511", "Old town", "urban", "all", "read"] == 0.0
    assert figures(spark.createDataFrame([], SCHEMA), BLOCKS).count() == 0


@pytest.mark.parametrize(
    "units, problem",
    [
        ([LAND, ["01511", "New town"] + TOWN[2:]], "different units"),
        ([LAND], "different units"),
        ([LAND, TOWN[:2] + ["x"] + TOWN[3:]], "unreadable figure: x"),
        ([LAND, TOWN[:2] + ["60", "60", "120", None, None, None]], "add up to 100"),
    ],
)
def test_units_that_dont_fit(spark, units, problem):
    rows = spark.createDataFrame(sheet(1, [LAND, TOWN]) + sheet(2, units), SCHEMA)
    with pytest.raises(Exception, match=problem):
        figures(rows, BLOCKS).collect()


def test_layout_problems(spark):
    moved = [HEAD[0][:5] + ["Women"], HEAD[1], ["code", "name", "write", "read", "Total", "read", "write", "Sum", "more"]]
    rows = spark.createDataFrame(sheet(1, [LAND]) + sheet(2, [["", "Sea"]], moved), SCHEMA)
    got = {(r.sheet, r.problem) for r in layout_problems(rows, BLOCKS).collect()}
    assert got == {
        (2, "column 5: sex reads Women, not Men"), (2, "column 2: heading reads Languages · write, not Languages · read"), (2, "column 3: heading reads Languages · read, not Languages · write"),
        (2, "column 7: heading reads Sum, not Total"), (2, "column 1: first unit reads Sea, not Land"), (2, "it has 9 columns, not 8"),
    }
    with pytest.raises(ValueError, match="sheet 2: column 1"):
        checked(rows, BLOCKS)


def test_people_beside_homes(spark):
    layout = Layout(
        [Sheet(1, [Figure("people", "Population", "count")]), Sheet(2, [Figure("road", "Access · road", "km"), Figure("water", "Access · water")])],
        first=2, code=0, label=1, top=2, header=[0, 1], filled=[0], codes=r"^\d{5}$", missing=("X",), halves=True,
    )
    head = [["c", "n", "سكان — Population"], []]
    homes = [["c", "n", "ولوج — Access"], ["", "", "طريق — road", "(%) water"]]
    rows = spark.createDataFrame(sheet(1, [["00012", "a", "11.5"], ["00013", "b", "X"], ["note", "x"]], head) + sheet(2, [["00012", "a", "1.005", "9.96"], ["00013", "b", "X", "1E1"], ["note"]], homes), SCHEMA)
    got = {(r.code, r.name): r.value for r in figures(checked(rows, layout), layout).collect()}
    assert got == {("00012", "people"): 12.0, ("00013", "people"): None, ("00012", "road"): 1.0, ("00012", "water"): 10.0, ("00013", "road"): None, ("00013", "water"): 10.0}
    assert spark.range(1).select(french_half(F.lit("ا — b"))).first()[0] == "b"


def test_source_registry(spark):
    assert source_registry(spark, [("a", "u", "f", "l"), ("b", "u", "g", "l")]).count() == 2
    with pytest.raises(ValueError, match="file is there twice"):
        source_registry(spark, [("a", "u", "f", "l"), ("b", "u", "f", "l")])
