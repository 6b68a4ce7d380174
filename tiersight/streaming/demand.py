"""The event log as a stream: the same rollup, run on what arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tiersight.operators.demand import CATCH_UP, daily_counts, refresh


def rollup_stream(events: DataFrame, raw: str, daily: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append events to the raw table and write the counts of the days they touch anew.

    A micro-batch that is run again writes its own folder of the raw table again and the same days'
    counts, so that nothing counts twice. Late events count in their own day, however late.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").partitionBy("day").parquet(f"{raw}/batch={number}")
        touched = spark.read.parquet(f"{raw}/batch={number}").select("day").distinct()
        everything = spark.read.option("basePath", raw).parquet(raw).drop("batch")
        refresh(daily_counts(everything.join(F.broadcast(touched), "day", "left_semi")), daily)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = f"{CATCH_UP} days") -> DataFrame:
    """Tumbling days by kind with a watermark, once per event id."""
    fresh = events.withWatermark(ts, late).dropDuplicatesWithinWatermark(["event_id"])
    return fresh.groupBy(F.window(ts, "1 day"), "kind").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Each user's sessions: runs of events with no longer gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), "user_id").agg(F.count("*").alias("n"))


def run_to_table(frame: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What a stream's present input gives, appended to a table."""
    spark: SparkSession = frame.sparkSession
    frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)
