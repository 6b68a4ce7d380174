"""Published files: levels as JSON, typed CSV, place lists; and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_level(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A level's records, from one JSON file or a folder of them."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A published CSV: header, optional byte-order mark, gzip or not, empty cells null, codes as strings by the schema."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    named = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    missing = [f.name for f in wanted if f.name not in named.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    return named.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, latin, arabic, lat, lng) of populated places in a tab-separated gazetteer; alternative names by script."""
    rows = spark.read.option("sep", "\t").option("quote", "").csv(path)
    c = rows.columns
    names = F.split(F.coalesce(F.col(c[3]), F.lit("")), ",")
    placed = rows.where(F.col(c[6]) == "P")
    return placed.select(
        F.col(c[0]).cast("long").alias("id"), F.col(c[1]).alias("name"), F.filter(names, lambda n: n.rlike(r"\p{IsLatin}")).alias("latin"), F.filter(names, lambda n: n.rlike(r"\p{IsArabic}")).alias("arabic"),
        F.col(c[4]).cast("double").alias("lat"), F.col(c[5]).cast("double").alias("lng"),
    )


def csv_lines(rows: DataFrame, first: str = "﻿") -> DataFrame:
    """(line): rows as CSV text, quoted only where they must be; nested columns aren't allowed. `first` begins the header."""
    def quoted(name: str):
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    header = rows.sparkSession.createDataFrame([(first + ",".join(rows.columns),)], "line string")
    return header.unionAll(rows.select(F.array_join(F.array(*[quoted(c) for c in rows.columns]), ",").alias("line")))


def write_csv(rows: DataFrame, path: str, order: list[str], mark: bool = True) -> None:
    """CSV parts in order, each with the byte-order mark and the header, so that each opens by itself."""
    names, bom = rows.columns, "﻿" if mark else ""
    named = rows.toDF(bom + names[0], *names[1:]).select(*[F.col(f"`{c}`").cast("string") for c in (bom + names[0], *names[1:])])
    at = [F.col(f"`{bom if n == names[0] else ''}{n}`") for n in order]
    named.repartitionByRange(*at).sortWithinPartitions(*at).write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_level(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """A level's records as JSON lines, in folders by a column if given."""
    writer = rows.write.option("ignoreNullFields", False)
    (writer.partitionBy(partition) if partition else writer).json(path)


def long_metrics(facts: DataFrame) -> DataFrame:
    """A cube (code, topic, key, area, sex, value) as one row per code and metric, a column for each area and sex."""
    return facts.groupBy("code", "topic", "key").pivot("cell", ["total_all", "total_male", "total_female", "urban_all", "rural_all"]).agg(F.first("value")) if "cell" in facts.columns else long_metrics(facts.withColumn("cell", F.concat_ws("_", "area", "sex")))


def answers(rows: DataFrame, path: str, version: str) -> DataFrame:
    """(path, body): an envelope for each row as JSON; `path` names the column with the answer's place."""
    data = [c for c in rows.columns if c != path]
    body = F.to_json(F.struct(F.struct(*data).alias("data"), F.struct(F.lit(version).alias("datasetVersion")).alias("meta"), F.struct(F.col(path).alias("self")).alias("links")))
    return rows.select(F.col(path).alias("path"), body.alias("body"))


def finding_files(findings: DataFrame, folder: str = "units") -> DataFrame:
    """(path, body): a unit's published findings as JSON, highest score first (code, id, score, and what else they say)."""
    said = [c for c in findings.columns if c not in ("code", "id", "score")]
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_order"), "id", "score", *said)))
    units = findings.groupBy("code").agg(F.transform(ordered, lambda f: F.struct(f["id"].alias("id"), f["score"].alias("score"), *[f[c].alias(c) for c in said])).alias("findings"))
    return units.select(F.concat(F.lit(f"{folder}/"), "code", F.lit(".json")).alias("path"), F.to_json(F.struct("code", "findings"), {"ignoreNullFields": "false"}).alias("body"))


def finding_index(findings: DataFrame) -> DataFrame:
    """(code, findings, best): the units with findings, how many and the best score; written with `write_level`."""
    return findings.groupBy("code").agg(F.count("*").alias("findings"), F.max("score").alias("best"))


def write_answers(made: DataFrame, out: str) -> None:
    """Write answers; two for one path are an error."""
    twice = made.groupBy("path").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError("more than one answer for " + ", ".join(r.path for r in twice))
    made.write.parquet(out)


def package(rows: DataFrame, path: str, dropped: list[str]) -> None:
    """A table for a package: without some columns, as compressed CSV."""
    rows.drop(*dropped).write.option("header", True).option("compression", "gzip").csv(path)
