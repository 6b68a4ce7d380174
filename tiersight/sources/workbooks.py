"""Workbooks and zip archives as tables of rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROW = re.compile(r"<row\b[^>]*?(?:/>|>(.*?)</row>)", re.S)
CELL = re.compile(r"<c\b([^>]*?)(?:/>|>(.*?)</c>)", re.S)
PLACE, KIND = re.compile(r'\br="([A-Z]+)\d*"'), re.compile(r'\bt="([^"]*)"')
VALUE, INLINE = re.compile(r"<v[^>]*>(.*?)</v>", re.S), re.compile(r"<t[^>]*>(.*?)</t>", re.S)


def column_number(letters: str) -> int:
    """A is 0, AA is 26."""
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def shared_strings(archive: zipfile.ZipFile) -> list[str]:
    """The workbook's strings; runs of rich text are joined."""
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    with archive.open("xl/sharedStrings.xml") as file:
        return ["".join(t.text or "" for t in item.iter(f"{SPACE}t")) for item in ElementTree.parse(file).getroot().iter(f"{SPACE}si")]


def sheet_rows(data: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """A sheet's rows up to each one's last cell; cells are texts as written, so that codes keep their zeros."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        name = f"xl/worksheets/sheet{sheet}.xml"
        if name not in archive.namelist():
            raise ValueError(f"no {name} in the workbook")
        strings, xml = shared_strings(archive), archive.read(name).decode()
    for row in ROW.finditer(xml):
        cells: dict[int, str] = {}
        for attributes, content in CELL.findall(row[1] or ""):
            place, kind = PLACE.search(attributes), KIND.search(attributes)
            if place is None:
                continue
            kind = kind[1] if kind else ""
            value = "".join(INLINE.findall(content)) if kind == "inlineStr" else (m[1] if (m := VALUE.search(content)) else None)
            if value is not None:
                cells[column_number(place[1])] = strings[int(value)] if kind == "s" else unescape(value)
        yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def read_sheets(spark: SparkSession, path: str, sheets: list[int] | None = None) -> DataFrame:
    """(path, sheet, row_idx, cells) of the workbooks under a path; one task reads a workbook."""
    wanted = sheets or [1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for sheet in wanted:
                    rows = list(sheet_rows(content, sheet))
                    for at in range(0, len(rows), 4096):
                        part = rows[at : at + 4096]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(part)), pa.array([sheet] * len(part), pa.int32()), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.list_(pa.string()))],
                            ["path", "sheet", "row_idx", "cells"],
                        )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(each, "path string, sheet int, row_idx long, cells array<string>")


def zip_entries(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """(path, content) of one entry of each archive; fails where an archive has none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    if entry not in archive.namelist():
                        raise ValueError(f"no {entry} in {name}")
                    contents.append(archive.read(entry))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(contents, pa.binary())], ["path", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(each, "path string, content binary")


def pinned(files: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Files whose bytes have the SHA-256 that is on record for their name; others fail."""
    spark = files.sparkSession
    known = spark.createDataFrame(list(sums.items()), "name string, sum string")
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(F.broadcast(known), "name")
    wrong = F.concat(F.lit("changed bytes: "), "name")
    return named.withColumn("content", F.when(F.sha2("content", 256) == F.col("sum"), F.col("content")).otherwise(F.raise_error(wrong).cast("binary"))).drop("name", "sum")


def cell(i: int) -> Column:
    """A row's trimmed cell; null where it is empty or beyond the row's end."""
    return F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit(""))


def whole_number(text: Column) -> Column:
    """A count with any spaces between its digits; null for what isn't one."""
    bare = F.regexp_replace(text, r"[\s  ]", "")
    return F.when(bare.rlike(r"^\d+$"), bare.try_cast("long"))


def share(text: Column) -> Column:
    """A share to one decimal; null for the marks of a missing one."""
    number = F.when(~text.isin("_", "-", "", "X"), F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))
    return F.floor(number * 10 + 0.5) / 10


def headings(row: DataFrame) -> DataFrame:
    """(column, heading) of a heading row whose merged cells are written once (cells)."""
    w = Window.orderBy("column").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = row.select(F.posexplode("cells").alias("column", "heading"))
    return placed.select("column", F.last(F.nullif(F.trim("heading"), F.lit("")), ignorenulls=True).over(w).alias("heading"))


def pinned_headings(rows: DataFrame, row_idx: int, expected: dict[int, str]) -> DataFrame:
    """The rows below a heading row, which must read as expected."""
    head = rows.where(F.col("row_idx") == row_idx).select("path", "sheet", F.col("cells").alias("head"))
    moved = F.concat_ws(", ", F.array_compact(F.array(*[F.when(~F.trim(F.get("head", F.lit(i))).eqNullSafe(F.lit(name)), F.lit(f"column {i} isn't {name}")) for i, name in expected.items()])))
    joined = rows.where(F.col("row_idx") > row_idx).join(F.broadcast(head), ["path", "sheet"])
    return joined.withColumn("cells", F.when(moved == "", F.col("cells")).otherwise(F.raise_error(moved).cast("array<string>"))).drop("head")


#: How labels of a population listing begin, in the order they are tried; fixed values.
KINDS = [
    ("^Ensemble du territoire national", "national"), ("^Région", "region"), ("(?i)^Préfecture d['’]arrondissements?\\b", "district"), ("^Préfecture", "province"), ("^Province", "province"),
    ("^Cercle", "cercle"), ("^Commune", "commune"), ("^Arrondissement", "arrondissement"), ("^dont le centre urbain", "urban_centre"),
]


def row_kind(label: Column) -> Column:
    kind = F.lit(None).cast("string")
    for pattern, name in reversed(KINDS):
        kind = F.when(label.rlike(pattern), name).otherwise(kind)
    return kind


def population_rows(rows: DataFrame) -> DataFrame:
    """Typed rows of the last national block of a population listing (columns: name, natives, foreigners, all, households, Arabic name, code)."""
    typed = rows.select(
        "path", "sheet", "row_idx", cell(0).alias("name"), whole_number(cell(1)).alias("natives"), whole_number(cell(2)).alias("foreigners"), whole_number(cell(3)).alias("population"),
        whole_number(cell(4)).alias("households"), cell(5).alias("name_ar"), cell(6).alias("code"),
    ).withColumn("kind", row_kind(F.col("name")))
    last = typed.where("kind = 'national'").groupBy("path", "sheet").agg(F.max("row_idx").alias("start"))
    return typed.join(F.broadcast(last), ["path", "sheet"]).where("row_idx >= start and kind is not null").drop("start")


def definitions(lines: DataFrame) -> DataFrame:
    """(path, term, body): lines that end in a colon are terms, the line after is the definition (path, row_idx, line)."""
    w = Window.partitionBy("path").orderBy("row_idx")
    marked = lines.where(F.trim("line") != "").withColumns({"term": F.lag("line").over(w), "is_term": F.col("line").endswith(":")})
    return marked.where(~F.col("is_term") & F.col("term").endswith(":")).select("path", F.regexp_replace("term", r"\s*:$", "").alias("term"), F.col("line").alias("body"))
