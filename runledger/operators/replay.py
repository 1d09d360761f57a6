"""Replay conformance: what a workflow asks for now against what its history recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..histories import COMMANDS

#: Names of the command types by code, and causes of failed tasks.
COMMAND_NAMES = ("ScheduleActivityTask", "RequestCancelActivityTask", "StartTimer", "CancelTimer", "CompleteWorkflowExecution", "FailWorkflowExecution", "CancelWorkflowExecution", "ContinueAsNewWorkflow", "RecordMarker")
CAUSES = {"NonDeterminismError": "NON_DETERMINISM", "CoroutinePanicError": "WORKFLOW_PANIC", "WorkflowPanic": "WORKFLOW_PANIC", "DeadlockError": "WORKFLOW_PANIC"}


def command_of(event_type: Column) -> Column:
    """The type of the command that produces an event, null if none does."""
    return F.create_map(*(F.lit(x) for kv in COMMANDS.items() for x in kv))[event_type]


def recorded(history: DataFrame) -> DataFrame:
    """The events that commands produced, with their place in the batch of their workflow task."""
    rows = history.where(F.col("event_type").isin(*COMMANDS))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("run_id", "task_id").orderBy("event_id")).cast("bigint"))


def _compared(history: DataFrame, commands: DataFrame) -> DataFrame:
    """run_id, task_id, pos, event_id, starts, reason of every event of a command, every command, and every start of a run
    (starts; without a task and a place, so that it meets no command)."""
    kind = F.col("event_type")
    place = F.sum((kind != 1).cast("bigint")).over(Window.partitionBy("run_id", "task_id").orderBy("event_id"))
    rows = history.where(kind.isin(1, *COMMANDS)).withColumn("pos", F.when(kind != 1, place))
    key = ["run_id", "task_id", "pos"]
    events = rows.select(*key, "event_id", "event_type", F.struct("name", "kind", "timeout", "started_id", "scheduled_id").alias("e"))
    asked = commands.select(*key, "command_type", F.struct("name", "kind", "timeout", "started_id").alias("c"))
    differ = lambda c: ~F.col(f"e.{c}").eqNullSafe(F.col(f"c.{c}"))
    reason = (
        F.when(kind == 1, None)
        .when(F.col("command_type").isNull(), "missing command")
        .when(kind.isNull(), "extra command")
        .when(F.col("command_type") != command_of(kind), "wrong type")
        .when((kind == 40) & differ("name"), "activity id")
        .when((kind == 40) & differ("kind"), "activity type")
        .when((kind == 60) & differ("name"), "timer id")
        .when((kind == 60) & differ("timeout"), "timer duration")
        .when((kind == 80) & differ("name"), "marker name")
        .when((kind == 80) & differ("kind"), "marker id")
        .when((kind == 62) & differ("started_id"), "timer cancel")
        .when((kind == 45) & ~F.col("e.scheduled_id").eqNullSafe(F.col("c.started_id")), "activity cancel")
    )
    return events.join(asked, key, "full_outer").select(*key, "event_id", F.coalesce(kind == 1, F.lit(False)).alias("starts"), reason.alias("reason"))


def mismatches(history: DataFrame, commands: DataFrame) -> DataFrame:
    """run_id, task_id, pos, event_id, reason of every place where commands and history differ.

    One full outer join on the place in the batch: missing and extra commands, another type, and by type another activity
    id or type, timer id or duration, marker name or id, or target of a cancel."""
    return _compared(history.where("event_type <> 1"), commands).where("reason is not null").drop("starts")


def replay_report(history: DataFrame, commands: DataFrame) -> DataFrame:
    """run_id, ok, mismatches, first_reason, cause of every run: a replay job's verdict.

    cause is that of a workflow task that would fail for it."""
    found = _compared(history, commands).where("starts or reason is not null")
    order = F.when(F.col("reason").isNotNull(), F.struct("task_id", "pos"))
    out = found.groupBy("run_id").agg(F.count("reason").alias("mismatches"), F.min_by("reason", order).alias("first_reason"), F.max("starts").alias("starts")).where("starts")
    return out.select("run_id", (F.col("mismatches") == 0).alias("ok"), "mismatches", "first_reason", F.when(F.col("mismatches") > 0, "NON_DETERMINISM").alias("cause"))


def failure_cause(failure: Column) -> Column:
    """The cause that the text `Type: message` of a failed task stands for."""
    name = F.regexp_extract(failure, r"^(\w+):", 1)
    return F.when(failure.isNotNull(), F.coalesce(F.create_map(*(F.lit(x) for kv in CAUSES.items() for x in kv))[name], F.lit("UNSPECIFIED")))


def replayed_tasks(history: DataFrame) -> DataFrame:
    """run_id, event_id, completed_id of the started workflow tasks that a replay runs: those that were completed."""
    done = history.where("event_type = 22").select("run_id", F.col("started_id").alias("event_id"), F.col("event_id").alias("completed_id"))
    return history.where("event_type = 21").select("run_id", "event_id").join(done, ["run_id", "event_id"])


def marker_index(history: DataFrame) -> DataFrame:
    """run_id, name, kind (the marker's id), event_id: the newest marker of each name and id."""
    return history.where("event_type = 80").groupBy("run_id", "name", "kind").agg(F.max("event_id").alias("event_id"))


def buffered_events(history: DataFrame) -> DataFrame:
    """run_id, event_id, buffered of the started workflow tasks during which other events arrived."""
    done = history.where("event_type = 22").select("run_id", F.col("started_id").alias("event_id"), F.col("event_id").alias("completed_id"))
    return done.select("run_id", "event_id", (F.col("completed_id") - F.col("event_id") - 1).alias("buffered")).where("buffered > 0")


def tasks_in_flight(history: DataFrame) -> DataFrame:
    """run_id, most: the greatest number of workflow tasks scheduled and not yet closed at one time."""
    step = F.when(F.col("event_type") == 20, 1).when(F.col("event_type").isin(22, 23, 24), -1).otherwise(0)
    order = Window.partitionBy("run_id").orderBy("event_id")
    return history.where("event_type between 20 and 24").select("run_id", F.sum(step).over(order).alias("open")).groupBy("run_id").agg(F.max("open").alias("most"))


def owned_tasks(history: DataFrame, claims: DataFrame) -> DataFrame:
    """run_id, worker, verdict of each claim (run_id, worker) to the run's workflow task in flight."""
    from .state import run_state

    now = run_state(history, holder=True).select("run_id", "status", "task", "holder")
    found = claims.join(now, "run_id", "left")
    other = (F.coalesce("worker", F.lit("")) != "") & (F.coalesce("holder", F.lit("")) != "") & (F.col("worker") != F.col("holder"))
    verdict = F.when(F.col("status").isNull(), "not found").when(F.col("status") != 0, "closed").when(F.col("task") != "started", "not in flight").when(other, "held by another").otherwise("owned")
    return found.select("run_id", "worker", verdict.alias("verdict"))
