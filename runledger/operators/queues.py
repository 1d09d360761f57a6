"""Dispatch queues and request metrics. No queue or operation is ever sorted in one task: ranks and running sums are taken
within slots of time, on top of the totals of the slots before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a slot of time: a queue's slots are counted, and only those counts meet in one task.
SLOT = 3_600_000_000_000
#: Fixed value: references that a queue holds.
MAX_BACKLOG = 50_000


def ranked(rows: DataFrame, key: str, at: str, tie: Sequence[str], slot: int = SLOT) -> DataFrame:
    """rows with k, their place (from 1) in the order of (at, tie) among those of one key."""
    slotted = rows.withColumn("slot", F.floor(F.col(at) / slot))
    per = slotted.groupBy(key, "slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(key, "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = F.row_number().over(Window.partitionBy(key, "slot").orderBy(at, *tie))
    placed = slotted.withColumn("inner", inner).join(offsets, [key, "slot"])
    return placed.withColumn("k", (F.col("offset") + F.col("inner")).cast("bigint")).drop("slot", "offset", "inner")


def fifo_match(tasks: DataFrame, pollers: DataFrame) -> DataFrame:
    """task_queue, k, run_id, poller: the kth task of a queue goes to its kth poller.

    tasks: task_queue, run_id, started_at; pollers: task_queue, request_id, caller, at_ns."""
    waiting = ranked(tasks.select("task_queue", "run_id", "started_at"), "task_queue", "started_at", ["run_id"])
    parked = ranked(pollers.select("task_queue", "request_id", "caller", "at_ns"), "task_queue", "at_ns", ["request_id"])
    return waiting.join(parked, ["task_queue", "k"]).select("task_queue", "k", "run_id", F.col("caller").alias("poller"))


def backlog(tasks: DataFrame, most: int = MAX_BACKLOG) -> DataFrame:
    """task_queue, waiting, rejected (the newest beyond what a queue holds), oldest."""
    made = tasks.groupBy("task_queue").agg(F.count("*").alias("waiting"), F.min("started_at").alias("oldest"))
    return made.select("task_queue", "waiting", F.greatest(F.col("waiting") - most, F.lit(0)).cast("bigint").alias("rejected"), "oldest")


def oldest_running(executions: DataFrame) -> DataFrame:
    oldest = F.min(F.struct("started_at", "run_id")).alias("o")
    return executions.where("status = 0").groupBy("task_queue").agg(oldest).select("task_queue", "o.run_id", "o.started_at")


def in_flight_peaks(executions: DataFrame, slot: int = SLOT) -> DataFrame:
    """task_queue, peak: the most runs of a queue that were open at one time; at one time, closes count before starts."""
    steps = executions.select("task_queue", "run_id", F.inline(F.array(F.struct(F.col("started_at").alias("at_ns"), F.lit(1).alias("d")), F.struct(F.col("closed_at").alias("at_ns"), F.lit(-1).alias("d")))))
    steps = steps.where("at_ns is not null").withColumn("slot", F.floor(F.col("at_ns") / slot))
    per = steps.groupBy("task_queue", "slot").agg(F.sum("d").alias("net"))
    before = Window.partitionBy("task_queue").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("task_queue", "slot", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("base"))
    running = F.sum("d").over(Window.partitionBy("task_queue", "slot").orderBy("at_ns", "d", "run_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    top = steps.select("task_queue", "slot", running.alias("depth")).groupBy("task_queue", "slot").agg(F.max("depth").alias("depth"))
    return top.join(base, ["task_queue", "slot"]).groupBy("task_queue").agg(F.max(F.col("base") + F.col("depth")).alias("peak"))


def unserved_queues(tasks: DataFrame, pollers: DataFrame) -> DataFrame:
    """task_queue: queues with tasks and without a poller."""
    return tasks.select("task_queue").distinct().join(pollers.select("task_queue").distinct(), "task_queue", "left_anti")


def _counts(value: str, bounds: Sequence[float]) -> Column:
    return F.array(*(F.count_if(F.col(value) <= b) for b in bounds))


def histogram(rows: DataFrame, key: str, value: str, bounds: Sequence[float]) -> DataFrame:
    """key, le, n: cumulative counts, all bounds in one pass over the rows."""
    each = rows.groupBy(key).agg(_counts(value, bounds).alias("counts")).select(key, F.posexplode("counts").alias("i", "n"))
    return each.select(key, F.element_at(F.array(*(F.lit(float(b)) for b in bounds)), F.col("i") + 1).alias("le"), "n")


def histogram_quantile(rows: DataFrame, key: str, value: str, bounds: Sequence[float], q: float) -> DataFrame:
    """key, le, low, n, before, total: the bucket in which the quantile lies; interpolate inside it."""
    made = rows.groupBy(key).agg(_counts(value, bounds).alias("c"))
    total = F.element_at("c", -1)
    i = F.filter(F.sequence(F.lit(1), F.lit(len(bounds))), lambda k: F.element_at("c", k) >= total * q)[0]
    le = F.array(*(F.lit(float(b)) for b in bounds))
    made = made.withColumn("total", total).withColumn("i", i).where("i is not null")
    at = lambda a, k, none: F.when(k > 0, F.element_at(a, F.greatest(k, F.lit(1)))).otherwise(none)
    return made.select(key, at(le, F.col("i"), 0.0).alias("le"), at(le, F.col("i") - 1, 0.0).alias("low"), at(F.col("c"), F.col("i"), 0).alias("n"), at(F.col("c"), F.col("i") - 1, 0).alias("before"), "total")


def interpolated(rows: DataFrame, key: str, q: float, name: str) -> DataFrame:
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.lit(q) * F.col("total") - F.col("before")) / (F.col("n") - F.col("before"))
    return rows.select(key, F.round(F.when(F.col("n") == F.col("before"), F.col("le")).otherwise(inside), 9).alias(name))


def rate(rows: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """key, slot, rate: events a second in tumbling windows."""
    slot = F.floor(F.col(at) / (seconds * 1_000_000_000)).cast("bigint")
    return rows.groupBy(key, slot.alias("slot")).agg(F.round(F.count("*") / float(seconds), 9).alias("rate"))


def ratio(rows: DataFrame, key: str, over: Column, under: Column, name: str = "ratio") -> DataFrame:
    """key and the ratio of two aggregates, whose denominator is 0.001 at least."""
    return rows.groupBy(key).agg(F.round(over.cast("double") / F.greatest(under.cast("double"), F.lit(0.001)), 9).alias(name))


def held_alerts(slots: DataFrame, key: str, hold: int) -> DataFrame:
    """key, since, slots: runs of hold or more consecutive slots (rows of key, slot) in which a condition was true."""
    island = F.col("slot") - F.row_number().over(Window.partitionBy(key).orderBy("slot"))
    runs = slots.select(key, "slot", island.alias("island")).groupBy(key, "island").agg(F.min("slot").alias("since"), F.count("*").alias("slots"))
    return runs.where(F.col("slots") >= hold).select(key, "since", "slots")


def queue_summary(executions: DataFrame) -> DataFrame:
    running = F.col("status") == 0
    return executions.groupBy("task_queue", "workflow_type").agg(F.count("*").alias("n"), F.count_if(running).alias("running"), F.count_if(~running).alias("closed"))
