"""Folding histories as a stream: counts, last event and open activities of each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import ns
from ..store import new_folder


def fold(events: DataFrame) -> DataFrame:
    """The state of each run after the events so far; the same for a table and for a stream, in any order of arrival."""
    opened, closed = F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type").isin("purchase", "error"))
    return events.groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("events"), F.max("event_id").alias("last_event_id"), F.max(ns("ts")).alias("last_event_time"), F.greatest(opened - closed, F.lit(0)).cast("bigint").alias("open_activities"))


def streamed_fold(spark: SparkSession, source: str, per_batch: int = 1) -> DataFrame:
    """Reads a folder of event files as a stream, keeps the fold in the state store, and returns its final state.

    Each run's newest state wins, so a batch that is written twice after a failure changes nothing."""
    out, state = new_folder(spark), new_folder(spark)
    events = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = fold(events).writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    names = [c for c in rows.columns if c not in ("run_id", "batch")]
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("run_id", "s.*")
