"""Queries over complete histories (`runledger.histories`), and SQL for the same rows that is written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures, histories
from ..functions import random, retry, text
from ..operators import replay, state, validation
from ..store import cut
from ..streaming.timers import streamed_timers

NOW = 850_000_000_000_000_000
MAX_EVENTS = 24


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histories.histories(spark, sf_dir)


def full_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir)


def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.violations(histories.broken(spark, sf_dir), MAX_EVENTS)


def validate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.first_violations(validation.violations(histories.broken(spark, sf_dir)))


def fold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.run_state(_all(spark, sf_dir))


def activity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.activities(_all(spark, sf_dir))


def timer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.timers(_all(spark, sf_dir))


def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pending_work(_all(spark, sf_dir))


def wanted_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.desired_timers(_all(spark, sf_dir))


def reconcile_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = cut(state.desired_timers(_all(spark, sf_dir)))  # used three times
    number = F.substring("run_id", 5, 20).cast("bigint")
    armed = wanted.where(number % 5 != 0).withColumn("fire_at", F.when(number % 5 == 1, F.col("fire_at") + 1).otherwise(F.col("fire_at")))
    gone = wanted.where(number % 5 == 2).withColumn("event_id", F.col("event_id") + 1000)
    return state.timer_changes(armed.union(gone), wanted)


def run_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.chains(_all(spark, sf_dir))


def replay_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.mismatches(_all(spark, sf_dir), histories.commands(spark, sf_dir))


def replay_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay_report(_all(spark, sf_dir), histories.commands(spark, sf_dir))


def command_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.command_errors(histories.commands(spark, sf_dir))


def command_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.precheck(histories.commands(spark, sf_dir), state.pending_work(_all(spark, sf_dir)))


def failed_task_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).where("event_type = 23").select("run_id", "event_id", replay.failure_cause(F.col("failure")).alias("cause"))


def replayed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replayed_tasks(_all(spark, sf_dir))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.marker_index(_all(spark, sf_dir))


def task_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.buffered_events(histories.broken(spark, sf_dir))


def workflow_tasks_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.tasks_in_flight(_all(spark, sf_dir))


def command_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.recorded(_all(spark, sf_dir)).select("run_id", "task_id", "event_id", "pos", replay.command_of(F.col("event_type")).alias("command_type"))


def task_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _all(spark, sf_dir)
    number = F.substring("run_id", 5, 20).cast("bigint")
    claims = h.where("event_type = 1").select("run_id", F.concat(F.lit("w"), (number % 2).cast("string")).alias("worker"))
    return replay.owned_tasks(h, claims)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).select("run_id", "event_id", text.event_detail().alias("detail"))


def shown_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = state.run_state(_all(spark, sf_dir))
    d = F.col("last_event_time") - F.lit(NOW)
    return runs.select("run_id", text.relative(F.lit(NOW), F.col("last_event_time")).alias("ago"), text.delta(F.pmod(d, F.lit(86400_000_000_000))).alias("gap"), text.short_id(F.col("run_id")).alias("short"))


def shown_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    shown = text.payload_preview(F.when(F.col("turn") % 3 == 0, "binary").otherwise("json"), F.col("text"))
    return docs.select("conv_id", "turn", shown.alias("preview"), text.truncate_middle(F.coalesce("text", F.lit("")), 41).alias("cut"), text.failure_text(F.coalesce("text", F.lit("")), F.col("turn") == 1).alias("failure"))


def identifier_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", validation.valid_namespace(F.col("source")).alias("namespace_ok"), validation.valid_name(F.substring("text", 1, 300), validation.QUEUE_BYTES).alias("queue_ok"), validation.valid_name(F.col("text"), validation.WORKFLOW_ID_BYTES).alias("id_ok"))


def retry_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity").cast("bigint") % 7 - 1).alias("a"))
    first, grow, most = retry.policy(F.col("a") * 500_000_000, (F.col("l_linenumber") % 3 * 0.75).cast("double"), F.col("l_suppkey") % 4 * 1_000_000_000)
    rows = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "a", first.alias("first_wait"), grow.alias("coefficient"), most.alias("longest"))
    wait = retry.client_backoff(F.col("a"), F.lit(200_000_000), F.lit(2.0), F.lit(1_000_000_000), F.col("l_partkey") % 8 / 8.0, F.when(F.col("l_suppkey") % 9 == 0, 700_000_000))
    scan = retry.scan_wait(F.col("l_suppkey") % 9, 1_000_000_000, 30_000_000_000, 0.25, F.col("l_partkey") % 4 / 4.0)
    return rows.select("*", retry.policy_error(F.col("first_wait"), F.col("coefficient"), F.col("longest"), F.col("a")).alias("error"), wait.alias("client_wait"), scan.alias("scan_wait"))


def retry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = state.activities(_all(spark, sf_dir)).where("outcome in ('FAILED', 'TIMED_OUT')")
    number = F.substring("run_id", 5, 20).cast("bigint")
    kind = F.when(F.col("outcome") == "TIMED_OUT", "timeout").when(number % 10 == 3, "canceled").otherwise("application")
    name = retry.error_type(kind, F.regexp_extract("failure", r"^(\w+):", 1), F.lit("START_TO_CLOSE"))
    again = retry.retried(name, retry.retryable(kind, number % 10 == 5), F.col("attempt"), F.lit(3), F.when(number % 4 == 0, F.array(F.lit("Returned"))).otherwise(F.array(F.lit("Other"))))
    return acts.select("run_id", "event_id", name.alias("error_type"), again.alias("again"))


def random_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 5 + 1).alias("nth"))
    key = F.col("o_orderkey")
    return rows.select("o_orderkey", "nth", random.next_seed(key).alias("next_seed"), random.random_word(key, F.col("nth")).alias("word"))


def limited_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 250 closed runs, as pages of 100, 100 and 50 would give them."""
    return fixtures.executions(spark, sf_dir).where("status <> 0").orderBy(F.desc("started_at"), F.desc("run_id")).limit(250)


def stream_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed_timers(spark, _all(spark, sf_dir))


_FUNCTIONS = (
    full_histories, validate_rules, validate_first, fold_state, activity_table, timer_table, pending_work, wanted_timers, reconcile_timers, run_chains, replay_mismatches, replay_verdicts, command_validation,
    command_precheck, failed_task_causes, replayed_tasks, markers, task_buffer, workflow_tasks_in_flight, command_positions, task_ownership, event_lines, shown_times, shown_payloads, identifier_checks,
    retry_policies, retry_decisions, random_streams, limited_list, stream_timers,
)
COMPLETE = {f.__name__: f for f in _FUNCTIONS}

_V = """
refs(kinds, attr, target, rule) AS (VALUES ([2,3,5,7,40,45,60,62,80], 'task', 22, 'V11'), ([21], 'scheduled', 20, 'V12'), ([22,23,24], 'started', 21, 'V12'), ([41,42,43,44,45,46], 'scheduled', 40, 'V13'), ([42], 'started', 41, 'V13'), ([61,62], 'started', 60, 'V14')),
uses AS (SELECT run_id, event_id, rule, target, CASE attr WHEN 'task' THEN task_id WHEN 'scheduled' THEN scheduled_id ELSE started_id END AS ref FROM broken JOIN refs ON list_contains(kinds, event_type) WHERE has_attrs),
found AS (
  SELECT run_id, max(event_id) AS event_id, 'V1' AS rule FROM broken GROUP BY run_id HAVING count(*) > {most}
  UNION ALL SELECT run_id, event_id, 'V2' FROM broken b WHERE event_type <> 1 AND NOT EXISTS (SELECT 1 FROM broken c WHERE c.run_id = b.run_id AND c.event_id < b.event_id)
  UNION ALL SELECT run_id, event_id, 'V3' FROM (SELECT run_id, event_id, count(*) OVER (PARTITION BY run_id ORDER BY event_id) AS so_far FROM broken) WHERE so_far <> event_id
  UNION ALL SELECT run_id, event_id, 'V4' FROM broken WHERE NOT has_attrs
  UNION ALL SELECT run_id, event_id, 'V5' FROM broken WHERE event_type NOT IN (1,2,3,4,5,6,7,8,9,20,21,22,23,24,40,41,42,43,44,45,46,60,61,62,80)
  UNION ALL SELECT run_id, event_id, 'V6' FROM broken WHERE event_time = 0
  UNION ALL SELECT b.run_id, b.event_id, 'V7' FROM broken b ASOF JOIN broken c ON b.run_id = c.run_id AND b.event_id > c.event_id WHERE b.event_time < c.event_time
  UNION ALL SELECT run_id, event_id, 'V8' FROM broken b WHERE event_type = 1 AND event_id <> 1
  UNION ALL SELECT run_id, event_id, 'V9' FROM broken b WHERE event_type IN (2,3,4,5,6,7) AND EXISTS (SELECT 1 FROM broken c WHERE c.run_id = b.run_id AND c.event_id > b.event_id)
  UNION ALL SELECT DISTINCT run_id, event_id, rule FROM uses u WHERE NOT EXISTS (SELECT 1 FROM broken c WHERE c.run_id = u.run_id AND c.event_id = u.ref AND c.event_type = u.target AND c.event_id < u.event_id)
  UNION ALL SELECT run_id, event_id, 'V15' FROM broken WHERE has_attrs AND ((event_type IN (1, 7, 9, 40, 60, 80) AND coalesce(name, '') = '') OR (event_type = 1 AND coalesce(kind, '') = '') OR (event_type = 60 AND timeout < 0))
  UNION ALL SELECT run_id, event_id, 'V16' FROM broken WHERE has_attrs AND event_type IN (3, 43) AND failure IS NULL)"""

_STATE = """
closes AS (SELECT run_id, event_type, event_time, name, failure FROM histories WHERE event_type IN (2,3,4,5,6,7)),
tasks AS (SELECT run_id, event_id, event_type, row_number() OVER (PARTITION BY run_id ORDER BY event_id DESC) AS back FROM histories WHERE event_type BETWEEN 20 AND 24),
cancels AS (SELECT run_id, name, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS nth FROM histories WHERE event_type = 8),
state AS (SELECT h.run_id, CAST(CASE c.event_type WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 5 WHEN 5 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN 6 ELSE 0 END AS INT) AS status, c.event_time AS closed_at, h.last_event_id, h.last_event_time, h.signals,
    x.run_id IS NOT NULL AS cancel_requested, x.name AS cancel_reason, CASE WHEN c.run_id IS NOT NULL THEN 'none' WHEN t.event_type = 20 THEN 'scheduled' WHEN t.event_type = 21 THEN 'started' ELSE 'none' END AS task,
    CASE WHEN c.run_id IS NULL AND t.event_type IN (20, 21) THEN t.event_id END AS task_event, CASE WHEN c.run_id IS NULL AND s.timeout > 0 THEN s.event_time + s.timeout END AS run_deadline,
    CASE WHEN c.event_type = 3 THEN c.failure END AS failure, CASE WHEN c.event_type = 7 THEN c.name END AS next_run
  FROM (SELECT run_id, max(event_id) AS last_event_id, max(event_time) AS last_event_time, count(*) FILTER (event_type = 9) AS signals FROM histories GROUP BY run_id) h
  LEFT JOIN closes c USING (run_id) LEFT JOIN tasks t ON t.run_id = h.run_id AND t.back = 1 LEFT JOIN cancels x ON x.run_id = h.run_id AND x.nth = 1 LEFT JOIN histories s ON s.run_id = h.run_id AND s.event_type = 1),
acts AS (SELECT s.run_id, s.event_id, s.name, s.kind, s.event_time AS scheduled_at, CASE WHEN s.timeout > 0 THEN s.event_time + s.timeout END AS deadline, b.event_id AS started_id, b.event_time AS started_at, b.worker, coalesce(b.attempt, 1) AS attempt,
    EXISTS (SELECT 1 FROM histories r WHERE r.run_id = s.run_id AND r.event_type = 45 AND r.scheduled_id = s.event_id) AS cancel_requested, c.event_id AS closed_id, CASE WHEN c.event_type = 43 THEN c.failure END AS failure,
    CASE c.event_type WHEN 42 THEN 'COMPLETED' WHEN 43 THEN 'FAILED' WHEN 44 THEN 'TIMED_OUT' WHEN 46 THEN 'CANCELED' ELSE 'PENDING' END AS outcome
  FROM histories s LEFT JOIN histories b ON b.run_id = s.run_id AND b.event_type = 41 AND b.scheduled_id = s.event_id LEFT JOIN histories c ON c.run_id = s.run_id AND c.event_type IN (42, 43, 44, 46) AND c.scheduled_id = s.event_id WHERE s.event_type = 40),
tmrs AS (SELECT s.run_id, s.event_id, s.name, s.event_time + s.timeout AS fire_at, c.event_id AS closed_id, CASE c.event_type WHEN 61 THEN 'FIRED' WHEN 62 THEN 'CANCELED' ELSE 'PENDING' END AS outcome
  FROM histories s LEFT JOIN histories c ON c.run_id = s.run_id AND c.event_type IN (61, 62) AND c.started_id = s.event_id WHERE s.event_type = 60),
live AS (SELECT DISTINCT run_id FROM histories EXCEPT SELECT run_id FROM closes),
wanted AS (SELECT run_id, CAST(1 AS BIGINT) AS event_id, 4 AS kind, run_deadline AS fire_at FROM state WHERE run_deadline IS NOT NULL
  UNION ALL SELECT s.run_id, task_event, 3, h.event_time + w.timeout FROM state s JOIN histories h ON h.run_id = s.run_id AND h.event_id = s.task_event JOIN histories w ON w.run_id = s.run_id AND w.event_id = h.scheduled_id WHERE s.task = 'started' AND w.timeout > 0
  UNION ALL SELECT run_id, event_id, 0, fire_at FROM tmrs JOIN live USING (run_id) WHERE outcome = 'PENDING'
  UNION ALL SELECT run_id, event_id, 2, deadline FROM acts JOIN live USING (run_id) WHERE outcome = 'PENDING' AND deadline IS NOT NULL)"""

_N = "CAST(substr(run_id, 5) AS BIGINT)"


def _shown(d: str) -> str:
    w = f"CAST(floor(abs({d}) / 1000000000) AS BIGINT)"
    return f"""CASE WHEN abs({d}) < 1000000000 THEN CAST(floor(abs({d}) / 1000000) AS BIGINT) || 'ms' WHEN abs({d}) < 60000000000 THEN printf('%.1fs', abs({d}) / 1e9) WHEN abs({d}) < 3600000000000 THEN printf('%dm%02ds', {w} // 60, {w} % 60)
      WHEN abs({d}) < 86400000000000 THEN printf('%dh%02dm', {w} // 3600, {w} % 3600 // 60) ELSE printf('%dd%02dh', {w} // 86400, {w} % 86400 // 3600) END"""


_REASONS = """
said AS (SELECT run_id, task_id, pos, event_id, event_type, name, kind, timeout, started_id, CASE event_type WHEN 40 THEN 1 WHEN 45 THEN 2 WHEN 60 THEN 3 WHEN 62 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 6 WHEN 5 THEN 7 WHEN 7 THEN 8 ELSE 9 END AS want FROM asked),
wrong AS (SELECT * FROM (
  SELECT run_id, task_id, pos, event_id, 'missing command' AS reason FROM said s WHERE NOT EXISTS (SELECT 1 FROM commands c WHERE c.run_id = s.run_id AND c.task_id = s.task_id AND c.pos = s.pos)
  UNION ALL SELECT run_id, task_id, pos, NULL, 'extra command' FROM commands c WHERE NOT EXISTS (SELECT 1 FROM said s WHERE c.run_id = s.run_id AND c.task_id = s.task_id AND c.pos = s.pos)
  UNION ALL SELECT s.run_id, s.task_id, s.pos, s.event_id, CASE WHEN c.command_type <> s.want THEN 'wrong type' WHEN s.want = 1 AND c.name <> s.name THEN 'activity id' WHEN s.want = 1 AND c.kind <> s.kind THEN 'activity type' WHEN s.want = 3 AND c.name <> s.name THEN 'timer id'
      WHEN s.want = 3 AND c.timeout <> s.timeout THEN 'timer duration' WHEN s.want = 9 AND c.name <> s.name THEN 'marker name' WHEN s.want = 9 AND c.kind <> s.kind THEN 'marker id' WHEN s.want = 4 AND c.started_id <> s.started_id THEN 'timer cancel' END
    FROM said s JOIN commands c ON c.run_id = s.run_id AND c.task_id = s.task_id AND c.pos = s.pos) WHERE reason IS NOT NULL)"""

_SPACES = r"trim(regexp_replace({}, '[ \t\n\x0b\f\r]+', ' ', 'g'))"
_TXT = _SPACES.format("text")
_FAIL = f"({_SPACES.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} || CASE WHEN turn = 1 THEN ' (non-retryable)' ELSE '' END)"
_LINE = {"attempt": "attempt", "worker": "worker", "scheduled": "scheduled_id", "started": "started_id"}


def _field(key: str, value: str, *kinds: int) -> str:
    return f"CASE WHEN event_type IN ({', '.join(map(str, kinds))}) AND coalesce(CAST({value} AS VARCHAR), '') NOT IN ('', '0') THEN '{key}=' || {value} END"


_SPAN = f"(CASE WHEN timeout > 0 THEN {_shown('timeout')} END)"
_DETAIL = ", ".join(
    _field(*f)
    for f in (
        ("type", "name", 1), ("signal", "name", 9), ("reason", "name", 6, 8), ("activity", "kind", 40), ("id", "name", 40), ("new_run", "substr(name, 1, 8)", 7), ("timer", "name", 60, 61, 62), ("marker", "name", 80), ("id", "kind", 80),
        ("task_queue", "kind", 1, 20), ("kind", "kind", 4, 24, 44), ("cause", "kind", 23), ("worker", "worker", 21, 22, 23), ("by", "worker", 6, 8, 9), ("scheduled", "scheduled_id", 21, 41, 42, 43, 44, 45, 46), ("started", "started_id", 22, 24, 61, 62),
        ("attempt", "attempt", 1, 20, 41), ("run_timeout", _SPAN, 1), ("start_to_close", _SPAN, 20), ("schedule_to_close", _SPAN, 40), ("fires_in", _SPAN, 60), ("worker", "worker", 41), ("failure", "failure", 3, 23, 43), ("from_task", "task_id", 2),
    )
)


def _with(more: str, select: str) -> str:
    return f"WITH RECURSIVE {histories.SQL}{',' + more if more else ''}\n{select}"


_M64, _G = "18446744073709551616::UHUGEINT", "11400714819323198485::UHUGEINT"


def _mix(x: str) -> str:
    """splitmix64 of a UHUGEINT below 2**64, by nested selects."""
    return f"(SELECT xor(c, c >> 31) FROM (SELECT (xor(b, b >> 27) * 10723151780598845931::UHUGEINT) % {_M64} AS c FROM (SELECT (xor(a, a >> 30) * 13787848793156543929::UHUGEINT) % {_M64} AS b FROM (SELECT ({x} + {_G}) % {_M64} AS a))))"


COMPLETE_SQL = {
    "full_histories": _with("", "SELECT * EXCLUDE (o) FROM histories"),
    "validate_rules": _with(_V.format(most=MAX_EVENTS), "SELECT run_id, event_id, rule FROM found"),
    "validate_first": _with(_V.format(most=50_000), "SELECT run_id, count(*) AS violations, min(event_id) AS first_event, arg_min(rule, event_id * 100 + CAST(substr(rule, 2) AS INT)) AS first_rule FROM found GROUP BY run_id"),
    "fold_state": _with(_STATE, "SELECT * FROM state"),
    "activity_table": _with(_STATE, "SELECT * FROM acts"),
    "timer_table": _with(_STATE, "SELECT * FROM tmrs"),
    "pending_work": _with(_STATE, "SELECT run_id, event_id, 'activity' AS what, name FROM acts WHERE outcome = 'PENDING' AND run_id IN (FROM live) UNION ALL SELECT run_id, event_id, 'timer', name FROM tmrs WHERE outcome = 'PENDING' AND run_id IN (FROM live)"),
    "wanted_timers": _with(_STATE, "SELECT * FROM wanted"),
    "reconcile_timers": _with(_STATE, f"SELECT run_id, event_id, kind, 'upsert' AS action, fire_at FROM wanted WHERE {_N} % 5 IN (0, 1) UNION ALL SELECT run_id, event_id + 1000, kind, 'delete', NULL FROM wanted WHERE {_N} % 5 = 2"),
    "run_chains": _with(
        " links AS (SELECT name AS run_id, run_id AS up FROM histories WHERE event_type = 7), starts AS (SELECT run_id FROM histories WHERE event_type = 1), walk AS (SELECT run_id, 0 AS link, run_id AS head FROM starts WHERE run_id NOT IN (SELECT run_id FROM links) UNION ALL SELECT l.run_id, link + 1, head FROM walk JOIN links l ON l.up = walk.run_id JOIN starts s ON s.run_id = l.run_id)",
        "SELECT run_id, CAST(link AS BIGINT) AS link, head, last_value(run_id) OVER (PARTITION BY head ORDER BY link ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM walk",
    ),
    "replay_mismatches": _with(_REASONS, "SELECT * FROM wrong"),
    "replay_verdicts": _with(_REASONS, "SELECT h.run_id, count(w.reason) = 0 AS ok, count(w.reason) AS mismatches, arg_min(w.reason, w.task_id * 1000000 + w.pos) AS first_reason, CASE WHEN count(w.reason) > 0 THEN 'NON_DETERMINISM' END AS cause FROM histories h LEFT JOIN wrong w ON w.run_id = h.run_id WHERE h.event_type = 1 GROUP BY h.run_id"),
    "command_validation": _with(
        "",
        "SELECT * FROM (SELECT run_id, task_id, pos, CASE WHEN n_sets <> 1 THEN 'attributes' WHEN command_type = 1 AND timeout <= 0 THEN 'no timeout' WHEN command_type = 1 AND heartbeat > timeout THEN 'heartbeat exceeds timeout' WHEN command_type IN (1, 3, 9) AND coalesce(name, '') = '' THEN CASE command_type WHEN 1 THEN 'empty activity id' WHEN 3 THEN 'empty timer id' ELSE 'empty marker name' END"
        " WHEN command_type = 3 AND timeout < 0 THEN 'negative timer' WHEN command_type = 6 AND failure IS NULL THEN 'no failure' WHEN command_type BETWEEN 5 AND 8 AND pos < (SELECT max(pos) FROM commands d WHERE d.run_id = c.run_id AND d.task_id = c.task_id) THEN 'closing not last' END AS error FROM commands c) WHERE error IS NOT NULL",
    ),
    "command_precheck": _with(
        _STATE,
        "SELECT c.run_id, c.task_id, c.pos, CASE WHEN held THEN 'already pending' ELSE 'reused in batch' END AS error FROM (SELECT *, row_number() OVER (PARTITION BY run_id, task_id, command_type, name ORDER BY pos) AS nth, EXISTS (SELECT 1 FROM acts a JOIN live USING (run_id) WHERE a.run_id = k.run_id AND a.name = k.name AND a.outcome = 'PENDING' AND k.command_type = 1) OR EXISTS (SELECT 1 FROM tmrs a JOIN live USING (run_id) WHERE a.run_id = k.run_id AND a.name = k.name AND a.outcome = 'PENDING' AND k.command_type = 3) AS held FROM commands k WHERE command_type IN (1, 3)) c WHERE held OR nth > 1"
        " UNION ALL SELECT run_id, task_id, pos, 'not pending' FROM commands c WHERE command_type = 4 AND NOT EXISTS (SELECT 1 FROM tmrs t JOIN live USING (run_id) WHERE t.run_id = c.run_id AND t.event_id = c.started_id AND t.outcome = 'PENDING')",
    ),
    "failed_task_causes": _with("", "SELECT run_id, event_id, kind AS cause FROM histories WHERE event_type = 23"),
    "replayed_tasks": _with("", "SELECT a.run_id, a.event_id, b.event_id AS completed_id FROM histories a JOIN histories b ON a.run_id = b.run_id AND b.event_id = a.event_id + 1 WHERE a.event_type = 21 AND b.event_type = 22"),
    "markers": _with("", "SELECT run_id, name, kind, event_id FROM histories WHERE event_type = 80"),
    "task_buffer": _with("", f"SELECT run_id, started_id AS event_id, event_id - started_id - 1 AS buffered FROM broken WHERE event_type = 22 AND event_id - started_id > 1"),
    "workflow_tasks_in_flight": _with("", "SELECT run_id, CAST(1 AS BIGINT) AS most FROM histories WHERE event_type = 1"),
    "command_positions": _with("", "SELECT run_id, task_id, event_id, pos, CAST(CASE event_type WHEN 40 THEN 1 WHEN 60 THEN 3 WHEN 62 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 6 WHEN 5 THEN 7 WHEN 7 THEN 8 WHEN 80 THEN 9 END AS INT) AS command_type FROM asked"),
    "task_ownership": _with(_STATE, f"SELECT run_id, 'w' || ({_N} % 2) AS worker, CASE WHEN status <> 0 THEN 'closed' WHEN task <> 'started' THEN 'not in flight' WHEN {_N} % 2 <> {_N} % 5 THEN 'held by another' ELSE 'owned' END AS verdict FROM state"),
    "event_lines": _with("", f"SELECT run_id, event_id, concat_ws(' ', {_DETAIL}) AS detail FROM histories"),
    "shown_times": _with(
        _STATE,
        f"SELECT run_id, CASE WHEN d < 0 THEN 'in ' || {_shown('d')} WHEN d < 500000000 THEN 'just now' ELSE {_shown('d')} || ' ago' END AS ago, '+' || {_shown('((86400000000000 - d % 86400000000000) % 86400000000000)')} AS gap, substr(run_id, 1, 8) AS short FROM (SELECT run_id, {NOW} - last_event_time AS d FROM state)",
    ),
    "shown_payloads": f"SELECT conv_id, turn, CASE WHEN text IS NULL THEN '' WHEN turn % 3 = 0 THEN '<binary ' || octet_length(encode(text)) || ' bytes>' WHEN length({_TXT}) > 96 THEN left({_TXT}, 96) || '...' ELSE {_TXT} END AS preview, CASE WHEN length(coalesce(text, '')) <= 41 THEN coalesce(text, '') ELSE left(text, 19) || '...' || right(text, 19) END AS cut, CASE WHEN length({_FAIL}) <= 120 THEN {_FAIL} ELSE left({_FAIL}, 59) || '...' || right({_FAIL}, 58) END AS failure FROM conversations",
    "identifier_checks": r"SELECT doc_id, coalesce(regexp_full_match(source, '[a-zA-Z0-9][a-zA-Z0-9._-]*') AND octet_length(encode(source)) <= 64, false) AS namespace_ok, coalesce(octet_length(encode(left(text, 300))) BETWEEN 1 AND 256 AND NOT regexp_matches(left(text, 300), '[\x00-\x1f\x7f]'), false) AS queue_ok, coalesce(octet_length(encode(text)) BETWEEN 1 AND 512 AND NOT regexp_matches(text, '[\x00-\x1f\x7f]'), false) AS id_ok FROM documents",
    "retry_policies": "WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) % 7 - 1 AS a FROM lineitem), b AS (SELECT *, CASE WHEN a = 0 THEN 1000000000 ELSE a * 500000000 END AS first_wait, CASE WHEN l_linenumber % 3 = 0 THEN 2.0::DOUBLE ELSE (l_linenumber % 3 * 0.75)::DOUBLE END AS coefficient FROM a),"
    " c AS (SELECT *, CASE WHEN l_suppkey % 4 = 0 THEN least(100 * first_wait, 100000000000) ELSE l_suppkey % 4 * 1000000000 END AS longest FROM b) SELECT *, CASE WHEN first_wait < 0 THEN 'negative initial interval' WHEN coefficient < 1 THEN 'coefficient under 1' WHEN longest < first_wait THEN 'maximum under initial interval' WHEN a < 0 THEN 'negative attempts' END AS error,"
    " greatest(CAST(trunc(least(2e8 * pow(2, greatest(a, 1) - 1), 1e9) * (0.5 + 0.5 * (l_partkey % 8 / 8))) AS BIGINT), CASE WHEN l_suppkey % 9 = 0 THEN 700000000 ELSE 0 END) AS client_wait, CAST(trunc(least(1e9 * pow(2, l_suppkey % 9), 3e10) * (1 + 0.25 * (l_partkey % 4 / 4))) AS BIGINT) AS scan_wait FROM c",
    "retry_decisions": _with(_STATE, f"SELECT run_id, event_id, CASE WHEN outcome = 'TIMED_OUT' THEN 'TimeoutError:START_TO_CLOSE' WHEN {_N} % 10 = 3 THEN '' ELSE 'Returned' END AS error_type, CASE WHEN attempt >= 3 THEN false WHEN outcome = 'TIMED_OUT' THEN true ELSE {_N} % 10 NOT IN (3, 5) AND {_N} % 4 <> 0 END AS again FROM acts WHERE outcome IN ('FAILED', 'TIMED_OUT')"),
    "random_streams": f"SELECT o_orderkey, o_custkey % 5 + 1 AS nth, CAST({_mix('CAST(o_orderkey AS UHUGEINT)')} % 9223372036854775808::UHUGEINT AS BIGINT) AS next_seed, CAST({_mix(f'CAST(o_orderkey AS UHUGEINT) + {_G} * CAST(o_custkey % 5 AS UHUGEINT)')} >> 1 AS BIGINT) AS word FROM orders",
    "limited_list": f"WITH {fixtures.CTES['executions']} SELECT * FROM executions WHERE status <> 0 ORDER BY started_at DESC, run_id DESC LIMIT 250",
    "stream_timers": _with(_STATE, "SELECT run_id, event_id, kind, fire_at FROM wanted WHERE kind IN (0, 2)"),
}
