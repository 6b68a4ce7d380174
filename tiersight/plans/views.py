"""Answering a list from a table that was written for it, where one fits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def written_answer(conditions: dict[str, object], sort: str | None, bounded: bool) -> str | None:
    """The name of the written table that holds exactly this list; None if it must be worked out.

    Tables are written for the whole list and for each value of one condition, in order of code.
    """
    if bounded or sort not in (None, "code") or len(conditions) > 1:
        return None
    return "/".join(str(x) for pair in conditions.items() for x in pair) or "all"


def answer(spark: SparkSession, root: str, written: set[str], conditions: dict[str, object], sort: str | None, bounded: bool, otherwise: Callable[[], DataFrame]) -> DataFrame:
    """The written table if there is one, else the plan of `otherwise`."""
    name = written_answer(conditions, sort, bounded)
    return spark.read.parquet(f"{root}/{name}") if name in written else otherwise()
