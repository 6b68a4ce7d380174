"""Census workbooks of known layouts as long tables of figures.

A layout says where a workbook's figures are and what its headings read. One reader serves them all: blocks
by area and sex, sheets of people beside sheets of homes, blocks that end in a total, marks for what is missing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Decimals that a unit is published with.
DECIMALS = {"count": 0, "share": 1, "km": 2}
NUMBER = r"(?i)^-?\d+(\.\d+)?(E-?\d+)?$"


@dataclass(frozen=True)
class Figure:
    """A column of figures: its name, its header cells from top to bottom joined by ` · `, and its unit."""

    name: str
    heading: str
    unit: str = "share"


@dataclass(frozen=True)
class Sheet:
    number: int
    figures: list[Figure]
    area: str = "total"


@dataclass(frozen=True)
class Layout:
    """Where a workbook's figures are; rows and columns count from 0.

    first: column of the first figure; top: row of the first unit; header: header rows; filled: those of them
    whose cells are written once for several columns; sexes: what is written over each block, in order, in
    `sex_row` (None: one block); total: blocks end in a column of that heading; missing: marks without a figure;
    opens: label of the first unit; codes: pattern of the codes that units have (None: all rows with a label);
    halves: header cells are in two languages.
    """

    sheets: list[Sheet]
    first: int
    code: int
    label: int
    top: int
    header: list[int]
    filled: list[int] = field(default_factory=list)
    sexes: dict[str, str] | None = None
    sex_row: int = 0
    total: str | None = None
    missing: tuple[str, ...] = ("",)
    opens: str | None = None
    codes: str | None = None
    halves: bool = False

    def width(self, sheet: Sheet) -> int:
        return len(sheet.figures) + (self.total is not None)

    def blocks(self, sheet: Sheet) -> dict[str, int]:
        """The first column of each sex's block."""
        return {sex: self.first + i * self.width(sheet) for i, sex in enumerate(self.sexes or ["all"])}


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def at(cells: str, i: int) -> Column:
    """A row's cell without needless white space; empty beyond its end."""
    return clean(F.get(cells, F.lit(i)))


def french_half(text: Column) -> Column:
    """The half of a bilingual heading after its dashes; without dashes, after its per cent mark."""
    parts = F.when(text.contains("—"), F.split(text, "—+")).otherwise(F.split(text, r"\(%\)"))
    return F.trim(F.element_at(parts, -1))


def figure(text: Column, unit: str, missing: tuple[str, ...] = ("",)) -> Column:
    """A cell's figure to the decimals of its unit; null for marks of a missing one, an error for what can't be read."""
    scale = 10 ** DECIMALS[unit]
    number = F.floor(text.try_cast("double") * scale + 0.5) / scale
    wrong = F.raise_error(F.concat(F.lit("unreadable figure: "), text)).cast("double")
    return F.when(text.isin(*missing), F.lit(None).cast("double")).when(text.rlike(NUMBER), number).otherwise(wrong)


def _expected(spark: SparkSession, layout: Layout) -> DataFrame:
    """(sheet, block, column, role, text): what the header cells must read; as long as the layout is."""
    rows = []
    for sheet in layout.sheets:
        for sex, start in layout.blocks(sheet).items():
            headings = [f.heading for f in sheet.figures] + ([layout.total] if layout.total is not None else [])
            rows += [(sheet.number, sex, start + i, "heading", text) for i, text in enumerate(headings)]
            rows += [(sheet.number, sex, start, "sex", layout.sexes[sex])] if layout.sexes else []
        rows.append((sheet.number, "", layout.label, "first unit", layout.opens)) if layout.opens else None
    return spark.createDataFrame(rows, "sheet int, block string, column int, role string, text string")


def layout_problems(rows: DataFrame, layout: Layout) -> DataFrame:
    """(path, sheet, problem): where the header cells of workbooks (path, sheet, row_idx, cells) differ from a layout."""
    wanted = F.broadcast(_expected(rows.sparkSession, layout))
    head = rows.where(F.col("row_idx") <= layout.top)
    wide = head.where(F.col("row_idx") < layout.top).groupBy("path", "sheet").agg(F.max(F.size("cells")).alias("width"))
    widths = {s.number: layout.first + len(layout.blocks(s)) * layout.width(s) for s in layout.sheets}
    sized = wide.withColumn("expected", F.create_map(*[F.lit(x) for pair in widths.items() for x in pair])[F.col("sheet")]).where("width <> expected")
    columns = F.concat(F.lit("it has "), F.col("width").cast("string"), F.lit(" columns, not "), F.col("expected").cast("string"))

    levels = head.groupBy("path", "sheet").agg(F.map_from_entries(F.collect_list(F.struct("row_idx", "cells"))).alias("rows"))
    every = levels.join(wanted, "sheet")
    shown = french_half if layout.halves else (lambda text: text)
    cell = lambda row: shown(clean(F.get(F.col("rows")[F.lit(row).cast("long")], F.col("column"))))
    block = Window.partitionBy("path", "sheet", "block", "role").orderBy("column").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = [F.last(F.nullif(cell(r), F.lit("")), ignorenulls=True).over(block) if r in layout.filled else F.nullif(cell(r), F.lit("")) for r in layout.header]
    last = F.nullif(cell(layout.header[-1]), F.lit(""))
    heading = F.when(F.col("text") == F.lit(layout.total), last).otherwise(F.concat_ws(" · ", *parts)) if layout.total is not None else F.concat_ws(" · ", *parts)
    read = every.withColumn("heading", heading).select(
        "path", "sheet", "column", "role", "text",
        F.coalesce(F.when(F.col("role") == "heading", F.col("heading")).when(F.col("role") == "sex", cell(layout.sex_row)).otherwise(cell(layout.top)), F.lit("")).alias("got"),
    )
    same = F.when(F.col("role") == "sex", F.lower("got") == F.lower("text")).otherwise(F.col("got") == F.col("text"))
    told = F.concat(F.lit("column "), F.col("column").cast("string"), F.lit(": "), "role", F.lit(" reads "), "got", F.lit(", not "), "text")
    return read.where(~same).select("path", "sheet", told.alias("problem")).unionAll(sized.select("path", "sheet", columns.alias("problem")))


def checked(rows: DataFrame, layout: Layout) -> DataFrame:
    """The rows, if their sheets have the layout; else an error that names some of the problems."""
    found = layout_problems(rows, layout).orderBy("path", "sheet", "problem").limit(20).collect()
    if found:
        raise ValueError("\n".join(f"{r.path}, sheet {r.sheet}: {r.problem}" for r in found))
    return rows


def figures(rows: DataFrame, layout: Layout) -> DataFrame:
    """(path, n, code, label, area, sex, name, value) of workbooks of a layout: rows path, sheet, row_idx, cells.

    n counts units from 1. All sheets must list the same units in the same order, and shares with a total
    must add up to 100 within half a point where there are any; what doesn't is an error. Codes are digits, null if none.
    """
    units = rows.where(F.col("row_idx") >= layout.top).withColumns({"digits": F.nullif(F.regexp_replace(at("cells", layout.code), r"\D", ""), F.lit("")), "label": at("cells", layout.label)})
    units = units.where(F.col("label") != "" if layout.codes is None else at("cells", layout.code).rlike(layout.codes))
    units = units.where(F.col("sheet").isin([s.number for s in layout.sheets]))
    numbered = units.withColumn("n", F.row_number().over(Window.partitionBy("path", "sheet").orderBy("row_idx")))
    same, unit = Window.partitionBy("path", "n"), F.struct(F.coalesce("digits", F.lit("")), "label")
    agree = (F.min(unit).over(same) == F.max(unit).over(same)) & (F.count("*").over(same) == len(layout.sheets))
    differ = F.raise_error(F.concat(F.lit("sheets list different units at row "), F.col("n").cast("string"))).cast("string")
    lined = numbered.withColumn("label", F.when(agree, F.col("label")).otherwise(differ))

    def long(sheet: Sheet) -> Column:
        cells = []
        for sex, start in layout.blocks(sheet).items():
            values = [figure(at("cells", start + i), f.unit, layout.missing) for i, f in enumerate(sheet.figures)]
            if layout.total is not None:
                total = figure(at("cells", start + len(values)), "share", layout.missing)
                off = F.coalesce((total != 0) & (F.abs(total - 100) > 0.5), F.lit(False))
                values = [F.when(off, F.raise_error(F.concat(F.lit("shares don't add up to 100: "), "label")).cast("double")).otherwise(v) for v in values]
            cells += [F.struct(F.lit(sheet.area).alias("area"), F.lit(sex).alias("sex"), F.lit(f.name).alias("name"), v.alias("value")) for f, v in zip(sheet.figures, values)]
        return F.array(*cells)

    by_sheet = F.lit(None).cast("array<struct<area:string,sex:string,name:string,value:double>>")
    for sheet in layout.sheets:
        by_sheet = F.when(F.col("sheet") == sheet.number, long(sheet)).otherwise(by_sheet)
    return lined.select("path", "n", F.col("digits").alias("code"), "label", F.explode(by_sheet).alias("f")).select("path", "n", "code", "label", "f.*")


def source_registry(spark: SparkSession, entries: list[tuple[str, str, str, str]]) -> DataFrame:
    """(id, url, filename, licence) of the sources; an id or a file named twice is an error."""
    for i, what in ((0, "id"), (2, "file")):
        named = [e[i] for e in entries]
        if len(set(named)) < len(named):
            raise ValueError(f"a source's {what} is there twice")
    return spark.createDataFrame(entries, "id string, url string, filename string, licence string")
