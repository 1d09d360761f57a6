"""Reads over execution and history tables, as DataFrame functions."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.history_json import EVENT_TYPES

#: Page sizes.
DEFAULT_PAGE, MAX_PAGE = 100, 1000
#: Events that a history may have.
MAX_EVENTS = 50_000
#: (event types, attribute that names an earlier event, type of that event, rule).
REFERENCES = [
    ((2, 3, 5, 7, 40, 45, 60, 62, 80), "workflow_task_completed_event_id", 22, "V11"),
    ((21,), "scheduled_event_id", 20, "V12"),
    ((22, 23, 24), "started_event_id", 21, "V12"),
    ((41, 42, 43, 44, 45, 46), "scheduled_event_id", 40, "V13"),
    ((42,), "started_event_id", 41, "V13"),
    ((61, 62), "started_event_id", 60, "V14"),
]
#: Attributes that must not be empty, by event type.
NAMED = [(40, "activity_id"), (60, "timer_id"), (80, "marker_name"), (7, "new_run_id"), (1, "workflow_type"), (1, "task_queue"), (9, "signal_name")]


def page_size(wanted: int | None) -> int:
    return DEFAULT_PAGE if not wanted or wanted <= 0 else min(wanted, MAX_PAGE)


def _fingerprint(filters: dict) -> str:
    return json.dumps(filters, sort_keys=True)


def list_executions(executions: DataFrame, filters: dict, size: int | None = None, token: str = "") -> tuple[DataFrame, str]:
    """A page of executions that equal the filters, newest first, and the token of the next page ("" at the end).

    Pages are found by key, never by offset; a token is bound to its filters."""
    rows, n = executions, page_size(size)
    for name, value in filters.items():
        rows = rows.where(F.col(name) == value)
    if token:
        bound, started, run = json.loads(base64.urlsafe_b64decode(token))
        if bound != _fingerprint(filters):
            raise ValueError("the token belongs to other filters")
        rows = rows.where((F.col("started_at") < started) | ((F.col("started_at") == started) & (F.col("run_id") < run)))
    page = rows.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n + 1)
    keys = page.select("started_at", "run_id").collect()  # n + 1 rows at most
    more = len(keys) > n
    last = keys[n - 1] if more else None
    cursor = base64.urlsafe_b64encode(json.dumps([_fingerprint(filters), last.started_at, last.run_id]).encode()).decode() if last else ""
    return rows.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n), cursor


def current_runs(executions: DataFrame) -> DataFrame:
    """The newest run of each workflow, by an aggregate that combines before the shuffle."""
    names = [c for c in executions.columns if c not in ("ns", "workflow_id")]
    newest = F.max_by(F.struct(*names), F.struct("started_at", "run_id")).alias("r")
    return executions.groupBy("ns", "workflow_id").agg(newest).select("ns", "workflow_id", "r.*")


def history_range(history: DataFrame, first: int = 1, last: int = 0) -> DataFrame:
    rows = history.where(F.col("event_id") >= max(1, first))
    return rows.where(F.col("event_id") <= last) if last else rows


def activity_pairs(history: DataFrame) -> DataFrame:
    """run_id, scheduled_id, started_id, closed_id of every scheduled activity: the next start and the next close among
    all later events of its run, null where there is none. An activity without a close is pending."""
    later = Window.partitionBy("run_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    next_of = lambda *kinds: F.min(F.when(F.col("event_type").isin(*kinds), F.col("event_id"))).over(later)
    seen = history.select("run_id", "event_type", F.col("event_id").alias("scheduled_id"), next_of(41).alias("started_id"), next_of(42, 43, 44, 46).alias("closed_id"))
    return seen.where("event_type = 40").drop("event_type")


def violations(history: DataFrame) -> DataFrame:
    """run_id, event_id, rule: structural violations of histories (run_id, event_id, event_type, event_time, attrs).

    attrs is JSON text. Histories without that column are held to V1 to V3 and V5 to V9 only. V10 is any broken
    reference; V11 to V14 say which. V1 is reported at the last event."""
    run = Window.partitionBy("run_id").orderBy("event_id")
    whole = Window.partitionBy("run_id")
    seen = history.withColumn("n", F.row_number().over(run)).withColumn("before", F.lag("event_time").over(run)).withColumn("last", F.max("event_id").over(whole)).withColumn("size", F.count("*").over(whole))
    kind = F.col("event_type")
    rules = {
        "V1": (F.col("size") > MAX_EVENTS) & (F.col("n") == F.col("size")),
        "V2": (F.col("n") == 1) & (kind != 1),
        "V3": F.col("event_id") != F.col("n"),
        "V5": ~F.coalesce(kind.isin(*EVENT_TYPES.values()), F.lit(False)),
        "V6": F.coalesce(F.col("event_time"), F.lit(0)) == 0,
        "V7": F.col("event_time") < F.col("before"),
        "V8": (F.col("n") > 1) & (kind == 1),
        "V9": kind.between(2, 7) & (F.col("event_id") < F.col("last")),
    }
    if "attrs" in history.columns:
        of = lambda name: F.get_json_object(F.col("attrs"), f"$.{name}")
        empty = F.lit(False)
        for k, name in NAMED:
            empty = empty | (kind == k) & (F.coalesce(of(name), F.lit("")) == "")
        present = F.coalesce(F.trim("attrs"), F.lit("null")) != "null"
        rules |= {
            "V4": ~present,
            "V15": present & (empty | (kind == 60) & (F.coalesce(of("start_to_fire_timeout").cast("bigint"), F.lit(0)) < 0)),
            "V16": present & kind.isin(3, 43) & of("failure").isNull(),
        }
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    found = seen.select("run_id", "event_id", F.explode(found).alias("rule"))
    if "attrs" not in history.columns:
        return found
    named = [F.when(kind.isin(*kinds), F.struct(F.lit(rule).alias("rule"), F.coalesce(of(name).cast("bigint"), F.lit(0)).alias("ref"), F.lit(target).alias("ref_type"))) for kinds, name, target, rule in REFERENCES]
    each = history.where(present).select("run_id", "event_id", F.inline(F.array_compact(F.array(*named))))
    earlier = history.select(F.col("run_id").alias("in_run"), F.col("event_id").alias("at"), F.col("event_type").alias("at_type"))
    met = (F.col("run_id") == F.col("in_run")) & (F.col("ref") == F.col("at")) & (F.col("ref_type") == F.col("at_type")) & (F.col("at") < F.col("event_id"))
    broken = each.join(earlier, met, "left_anti")
    return found.union(broken.select("run_id", "event_id", F.explode(F.array(F.lit("V10"), "rule"))).distinct())
