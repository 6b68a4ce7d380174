"""Cutting lineage through tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables written while `settled` is making one; None outside it.
_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder (`spark.checkpoint.dir`); a local one only where none is set and all runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="tiersight-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet under the shared folder and read it back.

    What is read back survives lost executors and is computed once, however often it is used.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    if (written := _written.get()) is not None:
        written.append(out)
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """Stage what `make` returns, then delete the tables that were staged in making it.

    Only for a `make` whose tables nothing else reads.
    """
    inner: list[DataFrame] = []
    token = _written.set(inner)
    try:
        made = make()
    finally:
        _written.reset(token)
    out = stage(made)
    for table in inner:
        discard(table)
    return out


def discard(staged: DataFrame) -> None:
    """Delete what `stage` wrote for this table; nothing that is still to be computed may read it."""
    spark = staged.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(staged.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
