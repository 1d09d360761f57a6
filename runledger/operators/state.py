"""The state of runs, folded from their histories by aggregates that combine before the shuffle.

The folds equal an event-by-event fold of histories without violations; hold doubtful ones to `validation` first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import cut

#: Statuses by terminal event type, and texts of the statuses.
STATUS_OF = {2: 1, 3: 2, 4: 5, 5: 3, 6: 4, 7: 6}
STATUS = ("RUNNING", "COMPLETED", "FAILED", "CANCELED", "TERMINATED", "TIMED_OUT", "CONTINUED_AS_NEW")
#: Kinds of timers.
USER, ACTIVITY_RETRY, ACTIVITY_TIMEOUT, TASK_TIMEOUT, EXECUTION_TIMEOUT, WORKFLOW_RETRY = range(6)

_AT = "event_id"


def _fold(history: DataFrame, holder: bool = False) -> DataFrame:
    """What run_state needs of a run, and the worker that holds its newest started task, if asked for.

    Two steps: the first aggregates numbers by run and text, in buffers of fixed size and so by hashing, where texts in
    buffers would sort all events; the second picks the texts among the few rows that are left of a run."""
    kind, at, time = F.col("event_type"), F.col(_AT), F.col("event_time")
    id_of = lambda *kinds: F.when(kind.isin(*kinds), at)
    said = F.when(kind.isin(7, 8), F.col("name")).when(kind == 3, F.col("failure"))
    if holder:
        said = said.when(kind == 21, F.col("worker"))
    parts = history.groupBy("run_id", said.alias("said")).agg(
        F.max(id_of(*STATUS_OF)).alias("ended"),
        F.max_by(kind, id_of(*STATUS_OF)).alias("terminal"),
        F.max(F.when(kind.isin(*STATUS_OF), time)).alias("closed_at"),
        F.max(at).alias("last_event_id"),
        F.max(time).alias("last_event_time"),
        F.count_if(kind == 9).alias("signals"),
        F.min(id_of(8)).alias("canceled"),
        F.max(id_of(20, 21, 22, 23, 24)).alias("task_event"),
        F.max_by(kind, id_of(20, 21, 22, 23, 24)).alias("task_type"),
        F.min(id_of(1)).alias("begun"),
        F.min_by(F.when(F.col("timeout") > 0, time + F.col("timeout")), id_of(1)).alias("run_deadline"),
        F.max(id_of(3)).alias("failed"),
        F.max(id_of(7)).alias("continued"),
        *([F.max(id_of(21)).alias("held")] if holder else []),
    )
    return parts.groupBy("run_id").agg(
        F.max_by("terminal", "ended").alias("terminal"),
        F.max("closed_at").alias("closed_at"),
        F.max("last_event_id").alias("last_event_id"),
        F.max("last_event_time").alias("last_event_time"),
        F.sum("signals").alias("signals"),
        (F.count("canceled") > 0).alias("cancel_requested"),
        F.min_by("said", "canceled").alias("cancel_reason"),
        F.max_by("task_type", "task_event").alias("task_type"),
        F.max("task_event").alias("task_event"),
        F.min_by("run_deadline", "begun").alias("run_deadline"),
        F.max_by("said", "failed").alias("failure"),
        F.max_by("said", "continued").alias("next_run"),
        *([F.max_by("said", "held").alias("holder")] if holder else []),
    )


def run_state(history: DataFrame, holder: bool = False) -> DataFrame:
    """run_id, status, closed_at, last_event_id, last_event_time, signals, cancel_requested, cancel_reason (the first
    one), task (none, scheduled or started), task_event, run_deadline, failure, next_run: one row a run.

    With holder also the worker of the newest started task."""
    status = F.create_map(*(F.lit(x) for kv in STATUS_OF.items() for x in kv))
    made = _fold(history, holder)
    closed = F.col("terminal").isNotNull()
    open_task = F.when(closed, "none").when(F.col("task_type") == 20, "scheduled").when(F.col("task_type") == 21, "started").otherwise("none")
    return made.select(
        "run_id",
        F.coalesce(status[F.col("terminal")], F.lit(0)).cast("int").alias("status"),
        "closed_at",
        "last_event_id",
        "last_event_time",
        "signals",
        "cancel_requested",
        "cancel_reason",
        open_task.alias("task"),
        F.when(open_task != "none", F.col("task_event")).alias("task_event"),
        F.when(~closed, F.col("run_deadline")).alias("run_deadline"),
        "failure",
        "next_run",
        *(["holder"] if holder else []),
    )


def open_runs(history: DataFrame) -> DataFrame:
    return history.groupBy("run_id").agg(F.count_if(F.col("event_type").isin(*STATUS_OF)).alias("closes")).where("closes = 0").select("run_id")


def activities(history: DataFrame) -> DataFrame:
    """run_id, event_id (of the schedule), name, kind, scheduled_at, deadline (schedule to close), started_id, started_at,
    worker, attempt, cancel_requested, closed_id, outcome, failure of every scheduled activity.

    Events of an activity meet by an aggregate on (run, scheduled id), so the history is shuffled once."""
    kind = F.col("event_type")
    rows = history.where(kind.between(40, 46)).withColumn("at", F.when(kind == 40, F.col(_AT)).otherwise(F.col("scheduled_id")))
    of = lambda what, *kinds: F.max(F.when(kind.isin(*kinds), F.col(what) if isinstance(what, str) else what))
    made = rows.groupBy("run_id", F.col("at").alias("event_id")).agg(
        of("name", 40).alias("name"),
        of("kind", 40).alias("kind"),
        of("event_time", 40).alias("scheduled_at"),
        of(F.when(F.col("timeout") > 0, F.col("event_time") + F.col("timeout")), 40).alias("deadline"),
        of(_AT, 41).alias("started_id"),
        of("event_time", 41).alias("started_at"),
        of("worker", 41).alias("worker"),
        F.coalesce(of("attempt", 41), F.lit(1)).alias("attempt"),
        (F.count_if(kind == 45) > 0).alias("cancel_requested"),
        of(_AT, 42, 43, 44, 46).alias("closed_id"),
        of(kind, 42, 43, 44, 46).alias("closed_type"),
        of("failure", 43).alias("failure"),
    )
    names = F.create_map(*(F.lit(x) for kv in ((42, "COMPLETED"), (43, "FAILED"), (44, "TIMED_OUT"), (46, "CANCELED")) for x in kv))
    return made.where("scheduled_at is not null").withColumn("outcome", F.coalesce(names[F.col("closed_type")], F.lit("PENDING"))).drop("closed_type")


def timers(history: DataFrame) -> DataFrame:
    """run_id, event_id (of the start), name, fire_at, closed_id, outcome of every user timer."""
    kind = F.col("event_type")
    rows = history.where(kind.between(60, 62)).withColumn("at", F.when(kind == 60, F.col(_AT)).otherwise(F.col("started_id")))
    made = rows.groupBy("run_id", F.col("at").alias("event_id")).agg(
        F.max(F.when(kind == 60, F.col("name"))).alias("name"),
        F.max(F.when(kind == 60, F.col("event_time") + F.coalesce("timeout", F.lit(0)))).alias("fire_at"),
        F.max(F.when(kind > 60, F.col(_AT))).alias("closed_id"),
        F.max(F.when(kind > 60, kind)).alias("closed_type"),
    )
    return made.where("fire_at is not null").withColumn("outcome", F.when(F.col("closed_type") == 61, "FIRED").when(F.col("closed_type") == 62, "CANCELED").otherwise("PENDING")).drop("closed_type")


def pending(items: DataFrame, history: DataFrame) -> DataFrame:
    """Of activities() or timers() those still pending: a close of the run clears them all."""
    return items.where("outcome = 'PENDING'").join(open_runs(history), "run_id", "left_semi")


def _items(history: DataFrame, *more: tuple[Column, str], others: tuple[int, ...] = ()) -> DataFrame:
    """Rows by run_id, what (40 an activity, 60 a timer, 20 a task, 1 the rest of the run) and event_id (of the schedule or
    start): opened, fire_at, closed, ends (events that close the run) and the aggregates in more."""
    kind = F.col("event_type")
    act, timer, opens = kind.between(40, 46), kind.between(60, 62), kind.isin(40, 60)
    rows = history.where(act | timer | kind.isin(*STATUS_OF, *others))
    what = F.when(act, 40).when(timer, 60).when(kind.isin(20, 21), 20).otherwise(1)
    item = F.when(opens | (kind == 20), F.col(_AT)).when(act | (kind == 21), F.col("scheduled_id")).when(timer, F.col("started_id"))
    return rows.groupBy("run_id", what.alias("what"), item.alias(_AT)).agg(
        F.max(F.when(opens, F.col("event_time"))).alias("opened"),
        F.max(F.when((kind == 40) & (F.col("timeout") > 0), F.col("event_time") + F.col("timeout")).when(kind == 60, F.col("event_time") + F.coalesce("timeout", F.lit(0)))).alias("fire_at"),
        F.count_if(kind.isin(42, 43, 44, 46, 61, 62)).alias("closed"),
        F.count_if(kind.isin(*STATUS_OF)).alias("ends"),
        *(c.alias(name) for c, name in more),
    )


def pending_work(history: DataFrame) -> DataFrame:
    """run_id, event_id, what (activity or timer), name of all that is pending, in one pass: the same as pending() of
    activities() and of timers()."""
    name = F.max(F.when(F.col("event_type").isin(40, 60), F.col("name")))
    waits = F.col("opened").isNotNull() & (F.col("closed") == 0)
    found = _items(history, (name, "name")).where(waits | (F.col("ends") > 0))
    found = found.withColumn("over", F.max("ends").over(Window.partitionBy("run_id")))
    return found.where((F.col("over") == 0) & waits).select("run_id", _AT, F.when(F.col("what") == 40, "activity").otherwise("timer").alias("what"), "name")


def desired_timers(history: DataFrame) -> DataFrame:
    """run_id, event_id, kind, fire_at: all timers that the state of the runs asks for, in one pass.

    A task's timeout counts from its start, if that is the newest event of the run's tasks."""
    kind, at, time = F.col("event_type"), F.col(_AT), F.col("event_time")
    started = F.when(kind == 21, at)
    more = [
        (F.max(F.when(kind.between(20, 24), at)), "task_at"),
        (F.max(started), "started"),
        (F.max_by(time, started), "started_at"),
        (F.max(F.when(kind == 20, F.col("timeout"))), "allowed"),
        (F.min_by(F.when(F.col("timeout") > 0, time + F.col("timeout")), F.when(kind == 1, at)), "deadline"),
    ]
    found = _items(history, *more, others=(1, 20, 21, 22, 23, 24))
    waits = F.col("what").isin(40, 60) & F.col("fire_at").isNotNull() & (F.col("closed") == 0)
    found = found.where(waits | ~F.col("what").isin(40, 60))
    run = Window.partitionBy("run_id")
    found = found.withColumn("over", F.max("ends").over(run)).withColumn("newest", F.max("task_at").over(run)).where("over = 0")
    what = F.col("what")
    held = (what == 20) & (F.col("started") == F.col("newest")) & (F.col("allowed") > 0)
    made = found.select(
        "run_id",
        F.when(what == 1, 1).when(what == 20, F.col("started")).otherwise(at).cast("bigint").alias(_AT),
        F.when(what == 1, EXECUTION_TIMEOUT).when(what == 20, TASK_TIMEOUT).when(what == 60, USER).otherwise(ACTIVITY_TIMEOUT).alias("kind"),
        F.when(what == 1, F.col("deadline")).when(held, F.col("started_at") + F.col("allowed")).when(what.isin(40, 60), F.col("fire_at")).alias("fire_at"),
    )
    return made.where("fire_at is not null")


def timer_changes(armed: DataFrame, wanted: DataFrame) -> DataFrame:
    """run_id, event_id, kind, action (upsert or delete), fire_at that turn the armed timers into the wanted ones."""
    key = ["run_id", _AT, "kind"]
    both = armed.select(*key, F.col("fire_at").alias("was")).join(wanted.select(*key, "fire_at"), key, "full_outer")
    action = F.when(F.col("fire_at").isNull(), "delete").when(~F.col("fire_at").eqNullSafe(F.col("was")), "upsert")
    return both.select(*key, action.alias("action"), "fire_at").where("action is not null")


def chains(history: DataFrame, max_links: int = 1000) -> DataFrame:
    """run_id, link (from 0), head, last of every run: its place among the runs that continue each other, the first and
    the last run of its chain.

    Links are doubled: after k rounds each run knows the run 2**k before it, so a chain of n takes log2(n) joins, and only
    linked runs are joined. Histories are read once, for their starts and links."""
    link = F.col("event_type") == 7
    base = history.where("event_type = 1 or event_type = 7 and name is not null")
    base = cut(base.select("run_id", F.when(link, F.col("name")).alias("next"), link.alias("link")).distinct())
    runs = base.where("not link").select("run_id")
    links = base.where("link").select(F.col("next").alias("run_id"), F.col("run_id").alias("up")).join(runs, "run_id", "left_semi")
    links = cut(links)
    known = links.withColumn("steps", F.lit(1).cast("bigint"))
    size = 1
    while size < max_links:
        far = known.select(F.col("run_id").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
        known = known.join(far, "up", "left").select("run_id", F.coalesce("further", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        known = cut(known)
        size *= 2
        if not known.join(links.select(F.col("run_id").alias("up")), "up", "left_semi").take(1):
            break
    # a run without links is its own head and last
    last = known.groupBy(F.col("up").alias("head")).agg(F.max_by("run_id", "steps").alias("last"))
    placed = runs.join(known, "run_id", "left").select("run_id", F.coalesce("steps", F.lit(0)).cast("bigint").alias("link"), F.coalesce("up", "run_id").alias("head"))
    return placed.join(last, "head", "left").select("run_id", "link", "head", F.coalesce("last", "head").alias("last"))
