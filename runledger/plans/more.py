"""Queries that are not one SQL text: jitter, the streamed fold, violations and the newest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures
from ..functions.random import jitter
from ..operators import queues
from ..operators.reads import activity_pairs, current_runs, violations
from ..streaming.fold import streamed_fold
from .catalogue import BOUNDS


def retry_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    timers = fixtures.timers(spark, sf_dir)
    counter = F.col("event_id") * 1000003 + F.col("attempt")
    return timers.select("run_id", "event_id", F.round(jitter(F.col("run_id"), counter), 12).alias("jitter"))


def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed_fold(spark, f"{sf_dir}/event[s].parquet")  # a pattern: a table may be one file or a folder


def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_runs(fixtures.executions(spark, sf_dir))


def structural_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(fixtures.history(spark, sf_dir))


def activity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_pairs(fixtures.history(spark, sf_dir))


#: The queue whose pollers an operation stands for.
QUEUE_OF = {"click": "BUILDING", "view": "MACHINERY", "purchase": "FURNITURE", "error": "HOUSEHOLD", "signup": "AUTOMOBILE"}


def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.executions(spark, sf_dir).where("status = 0")


def fifo_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = F.create_map(*(F.lit(x) for kv in QUEUE_OF.items() for x in kv))[F.col("operation")]
    return queues.fifo_match(_open(spark, sf_dir), fixtures.requests(spark, sf_dir).withColumn("task_queue", queue))


def backlog_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.backlog(_open(spark, sf_dir))


def tq_oldest_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.oldest_running(fixtures.executions(spark, sf_dir))


def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.in_flight_peaks(fixtures.executions(spark, sf_dir))


def unserved_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = fixtures.requests(spark, sf_dir).where("operation = 'click'").select(F.lit("BUILDING").alias("task_queue"))
    return queues.unserved_queues(_open(spark, sf_dir), served)


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.histogram(fixtures.requests(spark, sf_dir), "operation", "latency", BOUNDS)


def latency_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = queues.histogram_quantile(fixtures.requests(spark, sf_dir), "operation", "latency", BOUNDS, 0.99)
    return queues.interpolated(found, "operation", 0.99, "p99")


def rate_by_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.rate(fixtures.requests(spark, sf_dir), "operation", "at_ns", 300)


def error_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.ratio(fixtures.requests(spark, sf_dir), "caller", F.count_if(F.col("code") != "ok"), F.count("*"))


def failure_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.ratio(fixtures.executions(spark, sf_dir), "workflow_type", F.count_if(F.col("status") == 2), F.count_if(F.col("status") != 0))


def retry_amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.ratio(fixtures.activities(spark, sf_dir), "task_queue", F.sum("attempt"), F.count_if(F.col("outcome") != "PENDING"))


def alert_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.floor(F.col("at_ns") / 3_600_000_000_000).cast("bigint").alias("slot")
    busy = fixtures.requests(spark, sf_dir).groupBy("operation", slot).count().where("count >= 2")
    return queues.held_alerts(busy, "operation", 2)


def tq_summary_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.queue_summary(fixtures.executions(spark, sf_dir))


def current_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_runs(fixtures.executions(spark, sf_dir)).select("ns", "workflow_id", "run_id", "status", "started_at")


def validate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the runs instead of one a rule."""
    order = Window.partitionBy("run_id").orderBy("event_id")
    kind, at = F.col("event_type"), F.col("event_id")
    seen = fixtures.history(spark, sf_dir).select("run_id", "event_id", "event_type", "event_time", F.lag("event_type").over(order).alias("last_type"))
    rules = {2: (at == 1) & (kind != 9), 6: F.coalesce("event_time", F.lit(0)) == 0, 8: (at > 1) & (kind == 9), 13: (kind == 41) & (F.coalesce("last_type", F.lit(0)) != 40)}
    broken = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda r: r.isNotNull())
    per = seen.select("run_id", "event_id", broken.alias("rules")).groupBy("run_id").agg(
        F.count("*").alias("size"),
        F.sum(F.size("rules")).alias("broken"),
        F.min(F.when(F.size("rules") > 0, F.struct("event_id", F.array_min("rules").alias("n")))).alias("first"),
    )
    long = (F.col("size") > 50_000).cast("bigint")
    rule = F.when(F.col("first").isNull(), "V1").otherwise(F.concat(F.lit("V"), F.col("first.n").cast("string")))
    return per.select("run_id", rule.alias("first_rule"), (F.col("broken") + long).alias("violations")).where("violations > 0")


#: Those that the catalogue also has as SQL run here as operators; there is their oracle.
_OPERATORS = (fifo_match, backlog_depth, tq_oldest_running, in_flight, unserved_queues, latency_histogram, latency_p99, rate_by_op, error_ratio, failure_ratio, retry_amplification, alert_for, tq_summary_type, current_run, validate_all)
MORE = {f.__name__: f for f in _OPERATORS} | {f.__name__: f for f in (retry_jitter, stream_fold, newest_runs, structural_violations, activity_spans)}

_G, _A, _B, _M = "11400714819323198485", "13787848793156543929", "10723151780598845931", "18446744073709551616"


def _mixed(x: str, name: str, rest: str) -> str:
    """Three nested selects that apply splitmix64 to the UBIGINT x."""
    wrap = lambda e, by: f"CAST(CAST({e} AS UHUGEINT) * {by}::UHUGEINT % {_M}::UHUGEINT AS UBIGINT)"
    one = f"SELECT *, CAST((CAST({x} AS UHUGEINT) + {_G}::UHUGEINT) % {_M}::UHUGEINT AS UBIGINT) AS a FROM {rest}"
    two = f"SELECT *, {wrap('xor(a, a >> 30)', _A)} AS b FROM ({one})"
    three = f"SELECT *, {wrap('xor(b, b >> 27)', _B)} AS c FROM ({two})"
    return f"(SELECT * EXCLUDE (a, b, c), xor(c, c >> 31) AS {name} FROM ({three}))"


_INNER = _mixed("CAST(event_id * 1000003 + attempt AS UBIGINT)", "k", "timers")
MORE_SQL = {
    "retry_jitter": f"WITH {fixtures.CTES['timers']} SELECT run_id, event_id, round(CAST(m >> 11 AS DOUBLE) / 9007199254740992, 12) AS jitter FROM {_mixed('xor(CAST(run_id AS UBIGINT), k)', 'm', _INNER)}",
    "stream_fold": "SELECT user_id AS run_id, count(*) AS events, max(event_id) AS last_event_id, max(epoch_us(ts) * 1000) AS last_event_time, greatest(count(CASE WHEN event_type = 'click' THEN 1 END) - count(CASE WHEN event_type IN ('purchase', 'error') THEN 1 END), 0) AS open_activities FROM events GROUP BY user_id",
    "newest_runs": f"WITH {fixtures.CTES['executions']} SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY ns, workflow_id ORDER BY started_at DESC, run_id DESC) AS k FROM executions) WHERE k = 1",
    "structural_violations": f"WITH {fixtures.CTES['history']} SELECT run_id, event_id, 'V2' AS rule FROM history WHERE event_id = 1 AND event_type <> 1",
    "activity_spans": f"WITH {fixtures.CTES['history']} SELECT s.run_id, s.event_id AS scheduled_id, min(CASE WHEN t.event_type = 41 THEN t.event_id END) AS started_id, min(CASE WHEN t.event_type IN (42, 43, 44, 46) THEN t.event_id END) AS closed_id FROM history s LEFT JOIN history t ON t.run_id = s.run_id AND t.event_id > s.event_id WHERE s.event_type = 40 GROUP BY s.run_id, s.event_id",
}
