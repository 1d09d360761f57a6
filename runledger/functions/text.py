"""Texts of histories for people, as column expressions. Durations and times are nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a payload, of a failure and of a run id that are shown.
PREVIEW, FAILURE, SHORT = 96, 120, 8
_SECOND = 1_000_000_000


def compact_duration(d: Column) -> Column:
    """Milliseconds, seconds with one decimal, or the two largest units of a duration; its sign is not shown."""
    d = F.abs(d)
    whole = (d / _SECOND).cast("bigint")
    text = lambda c: c.cast("bigint").cast("string")
    # joined from integers, as a formatter takes longer than all else; tenths are rounded half up, as it does
    two = lambda a, b, units: F.concat(text(whole / a), F.lit(units[0]), F.lpad(text(whole % a / b), 2, "0"), F.lit(units[1]))
    tenths = F.floor((d + _SECOND // 20) / (_SECOND // 10)).cast("bigint")
    return (
        F.when(d < _SECOND, F.concat(text(d / 1_000_000), F.lit("ms")))
        .when(d < 60 * _SECOND, F.concat(text(F.floor(tenths / 10)), F.lit("."), text(tenths % 10), F.lit("s")))
        .when(d < 3600 * _SECOND, two(60, 1, "ms"))
        .when(d < 86400 * _SECOND, two(3600, 60, "hm"))
        .otherwise(two(86400, 3600, "dh"))
    )


def relative(now: Column, t: Column) -> Column:
    """When t was, seen from now: "-" if unset."""
    d = now - t
    return F.when(t.isNull() | (t == 0), "-").when(d < 0, F.concat(F.lit("in "), compact_duration(d))).when(d < _SECOND // 2, "just now").otherwise(F.concat(compact_duration(d), F.lit(" ago")))


def delta(d: Column) -> Column:
    """The gap to the event before; "!" marks one that goes back in time."""
    return F.concat(F.when(d < 0, "!").otherwise("+"), compact_duration(d))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate_middle(text: Column, most: int) -> Column:
    """Both ends of a text that is longer than most."""
    if most < 5:
        return text
    head = (most - 2) // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("..."), F.right(text, F.lit(most - 3 - head))))


def short_id(run_id: Column) -> Column:
    return F.substring(run_id, 1, SHORT)


def payload_preview(encoding: Column, data: Column) -> Column:
    """JSON data on one line, cut at PREVIEW; of other encodings the size alone."""
    text = squeezed(data.cast("string"))
    shown = F.when(F.length(text) > PREVIEW, F.concat(F.substring(text, 1, PREVIEW), F.lit("..."))).otherwise(text)
    sized = F.format_string("<%s %d bytes>", encoding, F.octet_length(data))
    return F.when(data.isNull(), "").when(encoding == "nil", "nil").when(encoding != "json", sized).otherwise(shown)


def failure_text(message: Column, non_retryable: Column) -> Column:
    """A failure on one line; both ends of a long one."""
    text = F.concat(squeezed(message), F.when(F.coalesce(non_retryable, F.lit(False)), " (non-retryable)").otherwise(""))
    return F.coalesce(truncate_middle(text, FAILURE), F.lit(""))


def event_detail() -> Column:
    """key=value of a typed history's event, by its type; what is empty or zero is left out."""
    kind = F.col("event_type")

    def field(key: str, value: str | Column, *kinds: int) -> Column:
        value = (F.col(value) if isinstance(value, str) else value).cast("string")
        return F.when(kind.isin(*kinds) & ~F.coalesce(value, F.lit("")).isin("", "0"), F.concat(F.lit(key + "="), value))

    # a function of a lambda keeps all of this out of one compiled method, which the JVM would leave uncompiled for its size
    span = F.when(F.col("timeout") > 0, F.transform(F.array("timeout"), compact_duration)[0])
    failure = F.when(F.col("failure").isNotNull(), failure_text(F.col("failure"), F.lit(False)))
    return F.concat_ws(
        " ",
        field("type", "name", 1), field("signal", "name", 9), field("reason", "name", 6, 8), field("activity", "kind", 40), field("id", "name", 40),
        field("new_run", short_id(F.col("name")), 7), field("timer", "name", 60, 61, 62), field("marker", "name", 80), field("id", "kind", 80),
        field("task_queue", "kind", 1, 20), field("kind", "kind", 4, 24, 44), field("cause", "kind", 23), field("worker", "worker", 21, 22, 23), field("by", "worker", 6, 8, 9),
        field("scheduled", "scheduled_id", 21, 41, 42, 43, 44, 45, 46), field("started", "started_id", 22, 24, 61, 62), field("attempt", "attempt", 1, 20, 41),
        field("run_timeout", span, 1), field("start_to_close", span, 20), field("schedule_to_close", span, 40), field("fires_in", span, 60),
        field("worker", "worker", 41), field("failure", failure, 3, 23, 43), field("from_task", "task_id", 2),
    )
