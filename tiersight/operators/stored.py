"""Lookup tables written once, in versions and by buckets of a key, so that a lookup reads its keys' buckets only."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tiersight.operators.staging import shared_root

#: A bucket is written by up to this many tasks, so that a frequent key is not one task's.
WRITERS = 8
VERSION = "version string, buckets int, keys map<string,string>, schemas map<string,string>"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Stored:
    """One version of a set of tables, each with the column it is looked up by."""

    spark: SparkSession
    root: str
    version: str
    buckets: int
    keys: dict[str, str]
    schemas: dict[str, str]

    def _read(self, table: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.schemas[table])).add("bucket", "integer")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{self.version}/{table}")

    def whole(self, table: str) -> DataFrame:
        return self._read(table).drop("bucket")

    def matching(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of a table in the buckets of `keys`, a table with the same key column; a superset of those with such a key.

        Bucket numbers, no more than there are buckets, go through the driver, and other buckets' files are not opened.
        """
        key = self.keys[table]
        wanted = [r.b for r in keys.select(_bucket(key, self.buckets).alias("b")).distinct().collect()]
        return self._read(table).where(F.col("bucket").isin(wanted)).drop("bucket")


def versions(spark: SparkSession, root: str) -> DataFrame | None:
    """(version, buckets, keys, schemas, written) of all complete versions under a folder; None if there is none."""
    try:
        return spark.read.schema(f"{VERSION}, written timestamp").parquet(f"{root}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def opened(spark: SparkSession, root: str, version: str | None = None) -> Stored | None:
    """A version, or the last one written; None where it isn't there."""
    known = versions(spark, root)
    if known is None:
        return None
    found = (known if version is None else known.where(F.col("version") == version)).orderBy(F.desc("written"), F.desc("version")).first()
    return found and Stored(spark, root, found.version, found.buckets, found["keys"], found["schemas"])


def write_version(root: str, version: str, tables: dict[str, tuple[DataFrame, str]], buckets: int = 64) -> Stored:
    """Write tables, each by the buckets of its key column, as a version; it is there for readers once all of it is written."""
    spark = next(iter(tables.values()))[0].sparkSession
    for name, (table, key) in tables.items():
        rows = table.withColumn("bucket", _bucket(key, buckets))
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64(*table.columns), F.lit(WRITERS))).sortWithinPartitions("bucket", key)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{version}/{name}")
    keys, schemas = {name: key for name, (_, key) in tables.items()}, {name: table.schema.json() for name, (table, _) in tables.items()}
    spark.createDataFrame([(version, buckets, keys, schemas)], VERSION).withColumn("written", F.current_timestamp()).write.mode("append").parquet(f"{root}/versions")
    return Stored(spark, root, version, buckets, keys, schemas)


def fingerprint(*tables: DataFrame) -> str:
    """A name for what tables' files hold now: their paths, sizes and times."""
    parts = []
    for table in tables:
        files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        parts.append(tuple(files.agg(F.count("*"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()))
    return hashlib.sha256(str(parts).encode()).hexdigest()[:16]


def kept(spark: SparkSession, name: str, version: str, make: Callable[[], dict[str, tuple[DataFrame, str]]]) -> Stored:
    """A version of the tables of a name in the cluster's shared folder; made and written where it isn't there yet."""
    root = f"{shared_root(spark)}/kept-{name}"
    return opened(spark, root, version) or write_version(root, version, make())
