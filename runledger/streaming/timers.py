"""Pending activities and timers of runs, kept over a stream of history events.

Events may come in any order and more than once: a run keeps the sets of what was opened and of what was closed, and what
is pending follows from the sets, not from the order. A close of the run clears all, an event of a closed run changes
nothing. The state is that of a streaming aggregate, so rows never leave the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import new_folder

#: Events that open something, those that close it, those that close a run.
OPENS, CLOSES, ENDS = (40, 60), (42, 43, 44, 46, 61, 62), (2, 3, 4, 5, 6, 7)
#: Parts in which the feed is written, one after the other, and batches that read it.
WAVES, BATCHES = 4, 2


def pending_state(events: DataFrame) -> DataFrame:
    """run_id, ended, opened (event_id, kind, fire_at), closed (event_ids): of a table or a stream, in any order of arrival.

    A fire_at of 0 stands for an activity without a timeout, which wants no timer."""
    kind = F.col("event_type")
    fire_at = F.when((kind == 60) | (F.col("timeout") > 0), F.col("event_time") + F.col("timeout")).otherwise(0)
    opened = F.struct("event_id", F.when(kind == 60, 0).otherwise(2).alias("kind"), fire_at.alias("fire_at"))
    return events.where(kind.isin(*OPENS, *CLOSES, *ENDS)).groupBy("run_id").agg(
        F.max(kind.isin(*ENDS)).alias("ended"),
        F.collect_set(F.when(kind.isin(*OPENS), opened)).alias("opened"),
        F.collect_set(F.when(kind.isin(*CLOSES), F.col("target"))).alias("closed"),
    )


def wanted(runs: DataFrame) -> DataFrame:
    """run_id, event_id, kind, fire_at: the timers that open runs of pending_state want."""
    rows = runs.where("not ended").withColumn("left", F.array_except(F.transform("opened", lambda o: o["event_id"]), "closed"))
    waits = F.filter("opened", lambda o: (o["fire_at"] != 0) & F.array_contains("left", o["event_id"]))
    return rows.where(F.size("left") > 0).select("run_id", F.inline(waits)).select("run_id", "event_id", "kind", "fire_at")


def shuffled_feed(history: DataFrame, path: str, waves: int = WAVES) -> int:
    """Writes a history as event files out of order, one event in nine twice; returns the number of files.

    An event's wave follows from its hash. The waves are written one after the other by the tasks that derive the events,
    so no event is shuffled."""
    rows = history.select("run_id", "event_id", "event_type", "event_time", F.coalesce("timeout", F.lit(0)).alias("timeout"), F.when(F.col("event_type") > 46, F.col("started_id")).otherwise(F.col("scheduled_id")).alias("target"))
    again = F.pmod(F.xxhash64("run_id", "event_id"), F.lit(9)) == 0
    wave = F.pmod(F.xxhash64("event_id", "run_id"), F.lit(waves))
    spread = [rows.where((wave == w) | again if w == 0 else wave == w) for w in range(waves)]
    spread[0] = spread[0].withColumn("times", F.when((wave == 0) & again, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).withColumn("times", F.explode("times")).drop("times")
    feed = spread[0]
    for more in spread[1:]:
        feed = feed.union(more)
    feed.write.parquet(path)
    return len(history.sparkSession.read.parquet(path).inputFiles())


def streamed_timers(spark: SparkSession, history: DataFrame) -> DataFrame:
    """run_id, event_id, kind, fire_at: the user timers (0) and activity timeouts (2) that open runs want in the end.

    Each run's newest state wins, so a batch that is written twice after a failure changes nothing."""
    source, out, state = (new_folder(spark) for _ in range(3))
    files = shuffled_feed(history, source)
    # RocksDB keeps state off the heap; its memory is held to a bound for all partitions of an executor
    settings = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "rocksdb.boundedMemoryUsage": "true", "rocksdb.maxMemoryUsageMB": "500"}
    settings = {f"spark.sql.streaming.stateStore.{k}": v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        schema = spark.read.parquet(source).schema
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // BATCHES))).parquet(source)
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        pending_state(events).writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    newest = rows.groupBy("run_id").agg(F.max_by(F.struct("ended", "opened", "closed"), "batch").alias("s"))
    return wanted(newest.select("run_id", "s.*"))
