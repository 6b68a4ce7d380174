import zipfile

import pytest
from pyspark.sql import functions as F

from tiersight.functions import geo, scripts
from tiersight.sources import files, workbooks

SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="G1"><v>x</v></c></row><row r="2"/>
<row r="3"><c r="A3" t="s"><v>0</v></c><c r="D3"><v>21 407 965</v></c></row>
<row r="4"><c r="A4" t="s"><v>1</v></c><c r="D4"><v>100</v></c><c r="F4" t="inlineStr"><is><t>ا</t></is></c><c r="G4"><v>000823</v></c></row>
<row r="5"><c r="A5"><v>Cercle: a &amp; b</v></c><c r="D5"><v>n/a</v></c></row><row r="6"><c r="A6"><v>Commune: c</v></c><c r="AA6"><v>z</v></c></row><row r="7"><c r="A7"><v>note</v></c></row>
</sheetData></worksheet>"""
STRINGS = """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Ensemble du territoire national</t></si><si><r><t>Préfecture d'</t></r><r><t xml:space="preserve">Arrondissements: x</t></r></si></sst>"""


@pytest.fixture
def workbook(tmp_path):
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as archive:
        archive.writestr("xl/worksheets/sheet1.xml", SHEET)
        archive.writestr("xl/sharedStrings.xml", STRINGS)
    return str(tmp_path / "book.xlsx")


def test_workbook(spark, workbook):
    rows = workbooks.read_sheets(spark, workbook)
    got = {r.row_idx: r.cells for r in rows.collect()}
    assert got[1] == [] and got[3][6] == "000823" and got[3][0] == "Préfecture d'Arrondissements: x" and got[3][5] == "ا"
    assert got[4][0] == "Cercle: a & b" and got[5][26] == "z" and got[5][1] is None
    typed = workbooks.population_rows(rows).orderBy("row_idx").collect()
    assert [r.kind for r in typed] == ["national", "district", "cercle", "commune"]
    assert typed[0].population == 21407965 and typed[1].code == "000823" and typed[2].population is None
    entry = workbooks.zip_entries(spark, workbook, "xl/sharedStrings.xml").first()
    assert bytes(entry.content).decode() == STRINGS
    with pytest.raises(Exception, match="no sheet9|no xl/worksheets/sheet9.xml"):
        workbooks.read_sheets(spark, workbook, [9]).count()


def test_pinned_bytes_and_headings(spark, workbook):
    content = spark.read.format("binaryFile").load(workbook).select("path", "content")
    good = content.select(F.sha2("content", 256)).first()[0]
    assert workbooks.pinned(content, {"book.xlsx": good}).count() == 1
    with pytest.raises(Exception, match="changed bytes"):
        workbooks.pinned(content, {"book.xlsx": "0"}).select(F.length("content")).collect()
    rows = workbooks.read_sheets(spark, workbook)
    assert workbooks.pinned_headings(rows, 2, {3: "21 407 965"}).count() == 4
    with pytest.raises(Exception, match="isn't Total"):
        workbooks.pinned_headings(rows, 2, {3: "Total"}).select("cells").collect()
    merged = spark.createDataFrame([(["A", None, "", "B"],)], "cells array<string>")
    assert [r.heading for r in workbooks.headings(merged).orderBy("column").collect()] == ["A", "A", "A", "B"]
    lines = spark.createDataFrame([("p", i, x) for i, x in enumerate(["Intro", "Term :", "", "What it is.", "Other:", "More."])], "path string, row_idx int, line string")
    assert {(r.term, r.body) for r in workbooks.definitions(lines).collect()} == {("Term", "What it is."), ("Other", "More.")}


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("001", 'a "b", c', 1.5), ("002", None, None)], "code string, name string, v double")
    files.write_csv(rows, str(tmp_path / "t"), ["code"])
    text = next((tmp_path / "t").glob("part-*.csv")).read_text("utf-8")
    assert text.startswith("﻿code,name,v\n")
    assert sorted(map(tuple, files.read_table(spark, str(tmp_path / "t"), "code string, name string, v double").collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    with pytest.raises(ValueError, match="no column other"):
        files.read_table(spark, str(tmp_path / "t"), "other string")
    assert [r.line for r in files.csv_lines(rows).collect()] == ["﻿code,name,v", '001,"a ""b"", c",1.5', "002,,"]


def test_levels_answers_and_places(spark, tmp_path):
    rows = spark.createDataFrame([("01", "r1", 1), ("02", "r2", 2)], "code string, region string, n long")
    files.write_level(rows, str(tmp_path / "l"), "region")
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    (tmp_path / "one.json").write_text('[{"code": "01"}, {"code": "02"}]')
    assert [r.code for r in files.read_level(spark, str(tmp_path / "one.json"), "code string").collect()] == ["01", "02"]
    made = files.answers(rows.withColumn("at", F.concat(F.lit("/"), "code")), "at", "v1")
    files.write_answers(made, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="more than one answer for /01"):
        files.write_answers(made.unionAll(made.where("path = '/01'")), str(tmp_path / "b"))
    (tmp_path / "g.tsv").write_text("1\tAgadir\tx\tAgadir,أكادير\t30.4\t-9.6\tP\n2\tRiver\tx\t\t1\t1\tH\n", "utf-8")
    place = files.read_places(spark, str(tmp_path / "g.tsv")).collect()
    assert len(place) == 1 and place[0].latin == ["Agadir"] and place[0].arabic == ["أكادير"]


def test_keys_meet_across_scripts(spark):
    pairs = [("خالد", "Khaled"), ("شمس", "Chems"), ("شمس", "Shams"), ("بدر", "Badr"), ("قمر", "Qamar"), ("قمر", "9amar"), ("جبل النور", "Jbel Nour"), ("مدينة الزهور", "Medinat Zohour"), ("خالد", "Ma5lad"), ("بدر", "Nadir")]
    rows = spark.createDataFrame(pairs, "ar string, fr string")
    got = [r.m for r in rows.select(scripts.keys_meet(scripts.arabic_keys(F.col("ar")), scripts.latin_keys(F.col("fr"))).alias("m")).collect()]
    assert got == [True] * 8 + [False] * 2


def test_rings(spark):
    square = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))]
    box = F.struct(F.lit(1.0).alias("west"), F.lit(1.0).alias("south"), F.lit(9.0).alias("east"), F.lit(2.0).alias("north"))
    rows = spark.createDataFrame([(square,)], "ring array<struct<x:double,y:double>>")
    got = rows.select(geo.clipped("ring", box).alias("r")).first().r
    assert {(p.x, p.y) for p in got} == {(1.0, 1.0), (4.0, 1.0), (4.0, 2.0), (1.0, 2.0)}
    line = spark.createDataFrame([([{"x": float(i), "y": 0.01 * (i % 2)} for i in range(9)],)], "ring array<struct<x:double,y:double>>")
    assert len(line.select(geo.simplified("ring", F.lit(0.1)).alias("r")).first().r) == 2
