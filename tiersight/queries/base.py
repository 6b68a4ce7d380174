"""Registering queries with the SQL that gives the same rows, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def money(name: str):
    """A sum of amounts as exact decimals."""
    return F.sum(F.col(name).cast("decimal(18,2)"))


def units(t: Tables) -> DataFrame:
    """Customers as the leaves of region, nation, customer."""
    return (
        t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("population"))
    )


UNITS_SQL = """units AS (
  SELECT c_custkey AS code, c_name AS name, n_name AS nation, r_name AS region, c_mktsegment AS segment, c_acctbal AS population
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
