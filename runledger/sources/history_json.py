"""History files: a JSON array of {id, time, type, attrs} for each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codes of the event types by name.
EVENT_TYPES = {
    "WorkflowExecutionStarted": 1,
    "WorkflowExecutionCompleted": 2,
    "WorkflowExecutionFailed": 3,
    "WorkflowExecutionTimedOut": 4,
    "WorkflowExecutionCanceled": 5,
    "WorkflowExecutionTerminated": 6,
    "WorkflowExecutionContinuedAsNew": 7,
    "WorkflowExecutionCancelRequested": 8,
    "WorkflowExecutionSignaled": 9,
    "WorkflowTaskScheduled": 20,
    "WorkflowTaskStarted": 21,
    "WorkflowTaskCompleted": 22,
    "WorkflowTaskFailed": 23,
    "WorkflowTaskTimedOut": 24,
    "ActivityTaskScheduled": 40,
    "ActivityTaskStarted": 41,
    "ActivityTaskCompleted": 42,
    "ActivityTaskFailed": 43,
    "ActivityTaskTimedOut": 44,
    "ActivityTaskCancelRequested": 45,
    "ActivityTaskCanceled": 46,
    "TimerStarted": 60,
    "TimerFired": 61,
    "TimerCanceled": 62,
    "MarkerRecorded": 80,
}


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    """file, event_id, event_time, event_type, name, attrs (JSON text). Malformed files and unknown types are errors."""
    rows = spark.read.schema("id bigint, time timestamp, type string, attrs string").option("multiLine", True).option("mode", "FAILFAST").json(path)
    code = F.create_map(*(F.lit(x) for kv in EVENT_TYPES.items() for x in kv))[F.col("type")]
    known = F.when(code.isNull(), F.raise_error(F.concat(F.lit("unknown event type "), F.coalesce("type", F.lit("null"))))).otherwise(code)
    return rows.select(F.input_file_name().alias("file"), F.col("id").alias("event_id"), F.col("time").alias("event_time"), known.cast("int").alias("event_type"), F.col("type").alias("name"), "attrs")


def write_histories(events: DataFrame, path: str) -> None:
    """JSON lines of the same envelopes, a folder per run."""
    events.select("run_id", F.col("event_id").alias("id"), F.col("event_time").alias("time"), F.col("name").alias("type"), "attrs").write.partitionBy("run_id").json(path)
