"""Structural validation of histories with typed attributes (columns of `histories.COLUMNS`), and of commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.history_json import EVENT_TYPES
from .reads import MAX_EVENTS, NAMED, REFERENCES

#: The column that holds an attribute of a history file.
COLUMN_OF = {"workflow_task_completed_event_id": "task_id", "scheduled_event_id": "scheduled_id", "started_event_id": "started_id", "activity_id": "name", "timer_id": "name", "marker_name": "name", "new_run_id": "name", "workflow_type": "name", "task_queue": "kind", "signal_name": "name"}
#: Bytes that identifiers may have, and the form of a namespace.
NAMESPACE_BYTES, WORKFLOW_ID_BYTES, QUEUE_BYTES, TYPE_BYTES = 64, 512, 256, 256
NAMESPACE_FORM = r"^[a-zA-Z0-9][a-zA-Z0-9._-]*$"


#: Types of the events that others refer to, one bit each.
TARGETS = {k: 1 << i for i, k in enumerate(sorted({target for _, _, target, _ in REFERENCES}))}
#: Of these, the one whose events come in blocks; of the others, the newest is meant as a rule.
BLOCKS = 40


def violations(history: DataFrame, max_events: int = MAX_EVENTS) -> DataFrame:
    """run_id, event_id, rule: every violation of V1 to V9 and V11 to V16; V11 to V14 are the kinds of V10.

    Windows over the runs in the order of their ids, sorted once. A reference is right if it names the newest earlier
    event of its type or, for activities, one among ids without a gap; runs with any other reference have all of theirs
    looked up by id. V1 is reported at the last event."""
    run = Window.partitionBy("run_id").orderBy("event_id")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = run.rowsBetween(Window.unboundedPreceding, -1)
    kind, at = F.col("event_type"), F.col("event_id")
    seen = history.withColumn("n", F.row_number().over(run)).withColumn("earlier", F.lag("event_time").over(run)).withColumn("id_before", F.lag("event_id").over(run))
    seen = seen.withColumn("last", F.max("event_id").over(whole)).withColumn("size", F.count("*").over(whole))
    of = lambda k: F.when(kind == k, at)
    new = F.col("id_before").isNull() | (F.col("id_before") < at)
    near = {f"newest_{k}": F.max(of(k)).over(so_far) for k in TARGETS}
    near |= {"block_from": F.min(of(BLOCKS)).over(so_far), "block": F.count_if((kind == BLOCKS) & new).over(so_far)}
    seen = seen.select("*", *(c.alias(name) for name, c in near.items()))
    unclear = F.lit(False)
    asked = []
    for kinds, name, target, rule in REFERENCES:
        ref, newest = F.coalesce(COLUMN_OF[name], F.lit(0)).cast("bigint"), F.col(f"newest_{target}")
        met = ref == newest
        if target == BLOCKS:
            met = met | (ref.between(F.col("block_from"), newest) & (newest - F.col("block_from") + 1 == F.col("block")))
        unclear = unclear | (kind.isin(*kinds) & ~F.coalesce(met & (ref < at), F.lit(False)))
        asked.append(F.when(F.col("has_attrs") & kind.isin(*kinds), F.struct(F.lit(rule).alias("rule"), ref.alias("ref"), F.lit(TARGETS[target]).alias("needs"), F.lit(0).alias("is"))))
    seen = seen.withColumn("unclear", F.max(F.coalesce(F.col("has_attrs"), F.lit(False)) & unclear).over(whole))
    empty = F.lit(False)
    for k, name in NAMED:
        empty = empty | ((kind == k) & (F.coalesce(COLUMN_OF[name], F.lit("")) == ""))
    rules = {
        "V1": (F.col("size") > max_events) & (F.col("n") == F.col("size")),
        "V2": (F.col("n") == 1) & (kind != 1),
        "V3": at != F.col("n"),
        "V4": ~F.col("has_attrs"),
        "V5": ~kind.isin(*EVENT_TYPES.values()),
        "V6": F.coalesce(F.col("event_time"), F.lit(0)) == 0,
        "V7": F.col("event_time") < F.col("earlier"),
        "V8": (F.col("n") > 1) & (kind == 1),
        "V9": kind.between(2, 7) & (at < F.col("last")),
        "V15": F.col("has_attrs") & (empty | ((kind == 60) & (F.coalesce("timeout", F.lit(0)) < 0))),
        "V16": F.col("has_attrs") & kind.isin(3, 43) & F.col("failure").isNull(),
    }
    # few events break a rule and few runs need a look-up: only these are expanded. A row without a rule is a target
    wrong = F.lit(False)
    for c in rules.values():
        wrong = wrong | F.coalesce(c, F.lit(False))
    bit = F.coalesce(F.create_map(*(F.lit(x) for kv in TARGETS.items() for x in kv))[kind], F.lit(0))
    plain = [F.when(c, F.struct(F.lit(k).alias("rule"), F.lit(None).cast("bigint").alias("ref"), F.lit(0).alias("needs"), F.lit(0).alias("is"))) for k, c in rules.items()]
    target = F.when(bit > 0, F.struct(F.lit(None).cast("string").alias("rule"), at.alias("ref"), F.lit(0).alias("needs"), bit.alias("is")))
    seen = seen.withColumn("wrong", wrong).where("wrong or unclear")
    rows = F.concat(F.when(F.col("wrong"), F.array(*plain)).otherwise(F.array()), F.when(F.col("unclear"), F.array(*asked, target)).otherwise(F.array()))
    found = seen.select("run_id", "event_id", F.inline(F.filter(rows, lambda r: r.isNotNull())))
    held = F.bit_or("is").over(Window.partitionBy("run_id", "ref"))
    right = (F.col("ref") < at) & (held.bitwiseAND(F.col("needs")) > 0)
    broken = found.withColumn("right", F.when(F.col("ref").isNotNull(), right).otherwise(False)).where("rule is not null and not right")
    # two references of one event may break the same rule
    return broken.groupBy("run_id", "event_id", "rule").agg(F.max(F.col("ref").isNull()).alias("plain")).select("run_id", "event_id", "rule")


def first_violations(found: DataFrame) -> DataFrame:
    """run_id, violations, first_event, first_rule: of each run the number of violations and the first one."""
    order = F.struct("event_id", F.substring("rule", 2, 2).cast("int"))
    return found.groupBy("run_id").agg(F.count("*").alias("violations"), F.min("event_id").alias("first_event"), F.min_by("rule", order).alias("first_rule"))


def _control(c: Column) -> Column:
    return c.rlike(r"[\x00-\x1f\x7f]")


def valid_namespace(c: Column) -> Column:
    return c.isNotNull() & (F.octet_length(c) <= NAMESPACE_BYTES) & c.rlike(NAMESPACE_FORM)


def valid_name(c: Column, most: int) -> Column:
    """Whether a workflow id, task queue or type name is not empty, not too long in bytes and free of control characters."""
    return c.isNotNull() & (F.octet_length(c) > 0) & (F.octet_length(c) <= most) & ~_control(c)


def command_errors(commands: DataFrame) -> DataFrame:
    """run_id, task_id, pos, error: the commands of a batch that are not valid, each with its first error.

    A closing command must be the last of its batch."""
    kind, name = F.col("command_type"), F.coalesce("name", F.lit(""))
    timeout, heartbeat = F.coalesce("timeout", F.lit(0)), F.coalesce("heartbeat", F.lit(0))
    checks = [
        (F.col("n_sets") != 1, "attributes"),
        (~kind.between(1, 9), "unknown type"),
        ((kind == 1) & (name == ""), "empty activity id"),
        ((kind == 1) & ~valid_name(F.col("kind"), TYPE_BYTES), "activity type"),
        ((kind == 1) & (timeout <= 0), "no timeout"),
        ((kind == 1) & (heartbeat < 0), "negative heartbeat"),
        ((kind == 1) & (heartbeat > timeout), "heartbeat exceeds timeout"),
        ((kind == 3) & (name == ""), "empty timer id"),
        ((kind == 3) & (timeout < 0), "negative timer"),
        ((kind == 4) & (F.coalesce("started_id", F.lit(0)) <= 0), "no started event"),
        ((kind == 6) & F.col("failure").isNull(), "no failure"),
        ((kind == 9) & (name == ""), "empty marker name"),
        (kind.between(5, 8) & (F.col("pos") < F.col("last")), "closing not last"),
    ]
    error = None
    for bad, text in checks:
        error = F.when(bad, text) if error is None else error.when(bad, text)
    last = F.max("pos").over(Window.partitionBy("run_id", "task_id"))
    return commands.withColumn("last", last).select("run_id", "task_id", "pos", error.alias("error")).where("error is not null")


def precheck(commands: DataFrame, pending: DataFrame) -> DataFrame:
    """run_id, task_id, pos, error: commands that collide with what is pending (run_id, event_id, what, name) or with each other.

    One join: commands that open something look for a pending name, those that cancel for a pending id."""
    kind, number = F.col("command_type"), lambda c: F.col(c).cast("string")
    again = F.row_number().over(Window.partitionBy("run_id", "task_id", "command_type", "name").orderBy("pos"))
    act = F.col("what") == "activity"
    ways = F.array(F.struct(F.when(act, 1).otherwise(3).alias("command_type"), F.col("name").alias("target")), F.struct(F.when(act, 2).otherwise(4).alias("command_type"), number("event_id").alias("target")))
    held = pending.select("run_id", F.inline(ways)).distinct().withColumn("held", F.lit(True))
    opens = kind.isin(1, 3)
    asked = commands.where(kind.isin(1, 2, 3, 4)).withColumn("nth", again).withColumn("target", F.when(opens, F.col("name")).otherwise(number("started_id")))
    error = F.when(opens & F.col("held"), "already pending").when(opens & (F.col("nth") > 1), "reused in batch").when(~opens & F.col("held").isNull(), "not pending")
    return asked.join(held, ["run_id", "command_type", "target"], "left").select("run_id", "task_id", "pos", error.alias("error")).where("error is not null")
