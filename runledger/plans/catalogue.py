"""The queries over workflow histories, one SQL text each, run by Spark over the projections of `fixtures`.

{name} stands for a projection. The text after "--duck" replaces the first one in the oracle where dialects differ.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures

#: Fixed points in time: 2024-01-10, and a day, in nanoseconds.
NOW, DAY = 1704844800000000000, 86400000000000
#: Bounds of the request latency histogram in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
_BOUNDS = " UNION ALL ".join(f"SELECT CAST({b} AS DOUBLE) AS le" for b in BOUNDS)

QUERIES: dict[str, str] = {
    # 2.1 reads
    "point_lookup": "SELECT e.* FROM {executions} e WHERE ns = 'default' AND workflow_id = 'cust-1' ",
    "current_run": "SELECT ns, workflow_id, run_id, status, started_at FROM (SELECT *, row_number() OVER (PARTITION BY ns, workflow_id ORDER BY started_at DESC, run_id DESC) AS k FROM {executions}) WHERE k = 1",
    "history_range": "SELECT run_id, event_id, event_type, event_time FROM {history} WHERE event_id BETWEEN 5 AND 20",
    "history_cursor": "SELECT run_id, CAST(max(event_id) + 1 AS BIGINT) AS next_event_id, count(*) AS n FROM {history} WHERE event_id >= 10 GROUP BY run_id",
    "visibility_list": "SELECT * FROM {executions} WHERE ns = 'default' AND status = 1 AND workflow_type = '1-URGENT' ORDER BY started_at DESC, run_id DESC LIMIT 101",
    "visibility_page2": "SELECT * FROM {executions} WHERE status = 1 AND (started_at < 850000000000000000 OR (started_at = 850000000000000000 AND run_id < 'run-5')) ORDER BY started_at DESC, run_id DESC LIMIT 101",
    "visibility_since": "SELECT workflow_type, status, count(*) AS n FROM {executions} WHERE started_at >= 800000000000000000 GROUP BY workflow_type, status",
    "open_executions": "SELECT ns, workflow_id, run_id, started_at FROM {executions} WHERE status = 0",
    "due_timers": f"SELECT run_id, event_id, kind, attempt, fire_at FROM {{timers}} WHERE fire_at <= {NOW} + 3650 * {DAY} ORDER BY fire_at, run_id, event_id, kind LIMIT 1000",
    "event_codec": "SELECT event_id, run_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {history} --duck SELECT event_id, run_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM {history}",
    # 2.1 sinks: what a conditional write would do
    "dedupe_request": "SELECT caller, operation, request_id FROM (SELECT *, row_number() OVER (PARTITION BY caller, operation, floor(latency) ORDER BY at_ns, request_id) AS k FROM {requests}) WHERE k = 1",
    "conditional_append": "SELECT a.run_id, a.event_id, CASE WHEN a.event_id = h.version + 1 THEN 'append' WHEN a.event_id <= h.version THEN 'conflict' ELSE 'gap' END AS verdict FROM {history} a JOIN (SELECT run_id, max(event_id) AS version FROM {history} WHERE source_id % 3 <> 0 GROUP BY run_id) h ON a.run_id = h.run_id WHERE a.source_id % 3 = 0",
    "mutable_fields": "SELECT run_id, CASE WHEN status <> 0 THEN status ELSE 4 END AS status, CASE WHEN status <> 0 THEN closed_at ELSE greatest(started_at, 1600000000000000000) END AS closed_at FROM {executions}",
    "timer_upsert": "SELECT run_id, kind, fire_at, attempt FROM (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY event_id DESC) AS k FROM {timers}) WHERE k = 1",
    "timers_of_open_runs": "SELECT t.run_id, t.event_id, t.kind FROM {timers} t WHERE NOT EXISTS (SELECT 1 FROM {history} h WHERE h.run_id = t.run_id AND h.event_type = 43 AND h.source_id > t.event_id)",
    "terminate_in_place": "SELECT run_id, CAST(max(event_id) + 1 AS BIGINT) AS event_id, 6 AS event_type, greatest(max(event_time), 1700000000000000000) AS event_time FROM {history} GROUP BY run_id",
    "reuse_policy": "SELECT workflow_id, run_id, status, CASE WHEN status = 0 THEN 'reject' ELSE 'start' END AS allow_duplicate, CASE WHEN status IN (0, 1, 6) THEN 'reject' ELSE 'start' END AS failed_only, CASE WHEN status = 0 THEN 'terminate' ELSE 'start' END AS terminate_if_running, 'reject' AS reject_any FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY started_at DESC, run_id DESC) AS k FROM {executions}) WHERE k = 1",
    # 2.2 predicates
    "event_filter": "SELECT run_id, event_id, event_type FROM {history} WHERE event_type IN (40, 43)",
    "event_by_id": "SELECT run_id, event_type, event_time FROM {history} WHERE event_id = 7",
    "terminal_flags": "SELECT status, status <> 0 AS terminal, count(*) AS n FROM {executions} GROUP BY status",
    "valid_ids": "SELECT run_id, length(workflow_id) BETWEEN 1 AND 512 AND workflow_id NOT LIKE '% %' AS ok_workflow, length(task_queue) BETWEEN 1 AND 256 AS ok_queue FROM {executions}",
    "duplicate_commands": "SELECT run_id, activity_id, count(*) AS n FROM {activities} GROUP BY run_id, activity_id HAVING count(*) > 1",
    "stale_attempts": "SELECT a.run_id, a.activity_id, a.attempt FROM {activities} a JOIN (SELECT run_id, max(attempt) AS live FROM {activities} GROUP BY run_id) m ON a.run_id = m.run_id WHERE a.attempt < m.live AND a.outcome = 'PENDING'",
    # 2.3 joins
    "validate_refs": "SELECT h.run_id, h.event_id, h.event_type FROM {history} h WHERE h.event_type IN (41, 42, 43) AND NOT EXISTS (SELECT 1 FROM {history} p WHERE p.run_id = h.run_id AND p.event_id = h.event_id - 1 AND p.event_type = 40)",
    "activity_pairs": "SELECT s.run_id, s.event_id AS scheduled_id, min(t.event_id) AS started_id FROM {history} s LEFT JOIN {history} t ON t.run_id = s.run_id AND t.event_type = 41 AND t.event_id > s.event_id AND t.event_id <= s.event_id + 5 WHERE s.event_type = 40 GROUP BY s.run_id, s.event_id",
    "pending_activities": "SELECT s.run_id, s.event_id FROM {history} s WHERE s.event_type = 40 AND NOT EXISTS (SELECT 1 FROM {history} c WHERE c.run_id = s.run_id AND c.event_type IN (42, 43) AND c.event_id = s.event_id + 1)",
    "pending_timers": "SELECT t.run_id, t.event_id, t.fire_at FROM {timers} t WHERE t.kind = 0 AND NOT EXISTS (SELECT 1 FROM {history} h WHERE h.run_id = t.run_id AND h.event_type = 42 AND h.source_id = t.event_id + 1)",
    "replay_diff": "SELECT coalesce(e.run_id, c.run_id) AS run_id, CAST(coalesce(e.pos, c.pos) AS BIGINT) AS pos, CASE WHEN c.run_id IS NULL THEN 'missing command' WHEN e.run_id IS NULL THEN 'extra command' WHEN e.event_type <> c.event_type THEN 'wrong type' ELSE 'differs' END AS reason FROM (SELECT run_id, event_type, props, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS pos FROM {history} WHERE event_type >= 40) e FULL OUTER JOIN (SELECT run_id, event_type, CASE WHEN source_id % 11 = 0 THEN 'x' ELSE props END AS props, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS pos FROM {history} WHERE event_type >= 40 AND source_id % 401 <> 0) c ON e.run_id = c.run_id AND e.pos = c.pos WHERE c.run_id IS NULL OR e.run_id IS NULL OR e.event_type <> c.event_type OR e.props <> c.props",
    "fifo_match": "SELECT t.task_queue, t.k, t.run_id, p.caller AS poller FROM (SELECT task_queue, run_id, CAST(row_number() OVER (PARTITION BY task_queue ORDER BY started_at, run_id) AS BIGINT) AS k FROM {executions} WHERE status = 0) t JOIN (SELECT CASE operation WHEN 'click' THEN 'BUILDING' WHEN 'view' THEN 'MACHINERY' WHEN 'purchase' THEN 'FURNITURE' WHEN 'error' THEN 'HOUSEHOLD' ELSE 'AUTOMOBILE' END AS task_queue, caller, CAST(row_number() OVER (PARTITION BY operation ORDER BY at_ns, request_id) AS BIGINT) AS k FROM {requests}) p ON t.task_queue = p.task_queue AND t.k = p.k",
    "timer_diff": "SELECT coalesce(a.run_id, w.run_id) AS run_id, coalesce(a.kind, w.kind) AS kind, CASE WHEN w.run_id IS NULL THEN 'delete' ELSE 'upsert' END AS action, w.fire_at FROM (SELECT run_id, kind, max(fire_at) AS fire_at FROM {timers} WHERE event_id % 2 = 0 GROUP BY run_id, kind) a FULL OUTER JOIN (SELECT run_id, kind, max(fire_at) AS fire_at FROM {timers} WHERE event_id % 3 = 0 GROUP BY run_id, kind) w ON a.run_id = w.run_id AND a.kind = w.kind WHERE a.run_id IS NULL OR w.run_id IS NULL OR a.fire_at <> w.fire_at",
    "run_chain": "SELECT workflow_id, run_id, started_at, first_value(run_id) OVER (PARTITION BY workflow_id ORDER BY started_at, run_id) AS first_run_id, lead(run_id) OVER (PARTITION BY workflow_id ORDER BY started_at, run_id) AS next_run_id, CAST(row_number() OVER (PARTITION BY workflow_id ORDER BY started_at, run_id) AS BIGINT) AS link FROM {executions}",
    "command_origin": "SELECT h.run_id, h.event_id, CAST(max(CASE WHEN event_type = 9 THEN event_id END) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS origin FROM {history} h",
    "row_vs_history": "SELECT e.run_id, e.n, coalesce(t.n, 0) AS timers FROM (SELECT run_id, count(*) AS n FROM {history} GROUP BY run_id) e LEFT JOIN (SELECT run_id, count(*) AS n FROM {timers} WHERE kind < 3 GROUP BY run_id) t ON e.run_id = t.run_id WHERE e.n <> coalesce(t.n, 0)",
    "unserved_queues": "SELECT DISTINCT e.task_queue FROM {executions} e WHERE e.status = 0 AND NOT EXISTS (SELECT 1 FROM {requests} p WHERE p.operation = 'click' AND e.task_queue = 'BUILDING')",
    # 2.4 aggregates
    "run_fold": "SELECT run_id, count(*) AS events, count_if(event_type = 9) AS signals, CAST(max(event_id) AS BIGINT) AS last_event_id, max(event_time) AS last_event_time, max(CASE WHEN event_type IN (42, 43) THEN event_id END) AS last_close, min_by(event_type, event_id) AS first_type, max_by(event_type, event_id) AS last_type FROM {history} GROUP BY run_id",
    "tq_summary_status": "SELECT task_queue, status, count(*) AS n FROM {executions} GROUP BY task_queue, status ORDER BY n DESC, task_queue, status",
    "tq_summary_type": "SELECT task_queue, workflow_type, count(*) AS n, count_if(status = 0) AS running, count_if(status <> 0) AS closed FROM {executions} GROUP BY task_queue, workflow_type",
    "tq_oldest_running": "SELECT task_queue, run_id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY task_queue ORDER BY started_at, run_id) AS k FROM {executions} WHERE status = 0) WHERE k = 1",
    "status_count": "SELECT status, count(*) AS n FROM {executions} GROUP BY status",
    "history_summary": "SELECT run_id, count(*) AS n, max(event_time) - min(event_time) AS span, min_by(event_type, event_id) AS first_type, max_by(event_type, event_id) AS last_type FROM {history} GROUP BY run_id",
    "counters": "SELECT operation, code, count(*) AS n, round(sum(latency), 4) AS latency_sum FROM {requests} GROUP BY operation, code",
    "in_flight": "SELECT task_queue, max(depth) AS peak FROM (SELECT task_queue, CAST(sum(d) OVER (PARTITION BY task_queue ORDER BY at_ns, d, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS depth FROM (SELECT task_queue, started_at AS at_ns, 1 AS d, run_id FROM {executions} UNION ALL SELECT task_queue, closed_at, -1, run_id FROM {executions} WHERE closed_at IS NOT NULL)) GROUP BY task_queue",
    "latency_histogram": f"SELECT operation, le, count_if(latency <= le) AS n FROM {{requests}} CROSS JOIN ({_BOUNDS}) GROUP BY operation, le",
    "latency_p99": f"SELECT operation, round(CASE WHEN n = before THEN le ELSE low + (le - low) * (0.99 * total - before) / (n - before) END, 9) AS p99 FROM (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY le) AS k FROM (SELECT operation, le, n, total, coalesce(lag(le) OVER (PARTITION BY operation ORDER BY le), 0.0) AS low, coalesce(lag(n) OVER (PARTITION BY operation ORDER BY le), 0) AS before FROM (SELECT operation, le, count_if(latency <= le) AS n, count_if(latency <= 60) AS total FROM {{requests}} CROSS JOIN ({_BOUNDS}) GROUP BY operation, le)) WHERE n >= 0.99 * total) WHERE k = 1",
    "rate_by_op": "SELECT operation, CAST(floor(at_ns / 300000000000) AS BIGINT) AS slot, round(count(*) / 300e0, 9) AS rate FROM {requests} GROUP BY operation, CAST(floor(at_ns / 300000000000) AS BIGINT)",
    "error_ratio": "SELECT caller, round(count_if(code <> 'ok') / greatest(CAST(count(*) AS DOUBLE), 0.001), 9) AS ratio FROM {requests} GROUP BY caller",
    "retry_amplification": "SELECT task_queue, round(CAST(sum(attempt) AS DOUBLE) / greatest(CAST(count_if(outcome <> 'PENDING') AS DOUBLE), 0.001), 9) AS ratio FROM {activities} GROUP BY task_queue",
    "sync_match_ratio": "SELECT task_queue, round(count_if(started_at = scheduled_at) / CAST(count(*) AS DOUBLE), 9) AS ratio FROM {activities} GROUP BY task_queue",
    "failure_ratio": "SELECT workflow_type, round(count_if(status = 2) / greatest(CAST(count_if(status <> 0) AS DOUBLE), 0.001), 9) AS ratio FROM {executions} GROUP BY workflow_type",
    "one_task_in_flight": "SELECT run_id, max(open) AS most FROM (SELECT run_id, CAST(sum(CASE event_type WHEN 40 THEN 1 WHEN 42 THEN -1 WHEN 43 THEN -1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS open FROM {history}) GROUP BY run_id HAVING max(open) > 1",
    "resolved_once": "SELECT run_id, activity_id, count(*) AS n FROM {activities} WHERE outcome <> 'PENDING' GROUP BY run_id, activity_id HAVING count(*) > 1",
    "report_totals": "SELECT count(*) AS activities, count_if(outcome = 'FAILED') AS failed, count_if(outcome = 'COMPLETED') AS completed, CAST(sum(attempt) AS BIGINT) AS attempts, coalesce(max(attempt), 0) AS most FROM {activities}",
    # 2.5 windows
    "history_delta": "SELECT run_id, event_id, event_time - lag(event_time) OVER (PARTITION BY run_id ORDER BY event_id) AS delta FROM {history}",
    "workflow_clock": "SELECT run_id, event_id, max(event_time) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clock FROM {history}",
    "validate_density": "SELECT run_id, source_id, k FROM (SELECT run_id, source_id, event_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY source_id) AS BIGINT) AS k FROM {history}) WHERE event_id <> k",
    "validate_time": "SELECT run_id, activity_id, started_at FROM (SELECT run_id, activity_id, started_at, lag(started_at) OVER (PARTITION BY run_id ORDER BY attempt, activity_id, started_at) AS before FROM {activities}) WHERE started_at < before",
    "validate_terminal_last": "SELECT run_id, event_id FROM (SELECT run_id, event_id, event_type, max(event_id) OVER (PARTITION BY run_id) AS last_id FROM {history}) WHERE event_type = 43 AND event_id < last_id",
    "validate_all": "SELECT run_id, min_by(rule, event_id * 100 + n) AS first_rule, count(*) AS violations FROM (SELECT run_id, event_id, 2 AS n, 'V2' AS rule FROM {history} WHERE event_id = 1 AND event_type <> 9 UNION ALL SELECT run_id, event_id, 6, 'V6' FROM {history} WHERE event_time = 0 OR event_time IS NULL UNION ALL SELECT run_id, event_id, 8, 'V8' FROM {history} WHERE event_id > 1 AND event_type = 9 UNION ALL SELECT run_id, event_id, 13, 'V13' FROM {history} h WHERE event_type = 41 AND NOT EXISTS (SELECT 1 FROM {history} p WHERE p.run_id = h.run_id AND p.event_id = h.event_id - 1 AND p.event_type = 40) UNION ALL SELECT run_id, max(event_id), 1, 'V1' FROM {history} GROUP BY run_id HAVING count(*) > 50000) GROUP BY run_id",
    "buffered_events": "SELECT s.run_id, s.event_id, s.next_id - s.event_id - 1 AS buffered FROM (SELECT run_id, event_id, lead(event_id) OVER (PARTITION BY run_id ORDER BY event_id) AS next_id FROM {history} WHERE event_type IN (41, 42)) s WHERE s.next_id - s.event_id > 1",
    "call_counters": "SELECT run_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY run_id, event_type ORDER BY event_id) AS BIGINT) AS nth FROM {history}",
    "mutable_changes": "SELECT run_id, event_id, event_type FROM (SELECT run_id, event_id, event_type, lag(event_type) OVER (PARTITION BY run_id ORDER BY event_id) AS before FROM {history}) WHERE before IS NULL OR event_type <> before",
    "skip_incomplete_tasks": "SELECT run_id, event_id FROM (SELECT run_id, event_id, event_type, lead(event_type) OVER (PARTITION BY run_id ORDER BY event_id) AS next FROM {history}) WHERE event_type = 41 AND next = 42",
    "marker_index": "SELECT run_id, props, max(event_id) AS event_id FROM {history} WHERE event_type = 9 GROUP BY run_id, props",
    # 2.8 scalar functions
    "retry_backoff": "SELECT run_id, event_id, attempt, CAST(least(1000000000e0 * pow(2e0, greatest(attempt, 1) - 1), 100000000000e0) * (1e0 + 2e-1 * least(greatest((event_id % 7) / 6e0, 0e0), 1e0)) AS BIGINT) AS delay FROM {timers} --duck SELECT run_id, event_id, attempt, CAST(trunc(least(1000000000e0 * pow(2e0, greatest(attempt, 1) - 1), 100000000000e0) * (1e0 + 2e-1 * least(greatest((event_id % 7) / 6e0, 0e0), 1e0))) AS BIGINT) AS delay FROM {timers}",
    "retry_decision": "SELECT run_id, activity_id, attempt, outcome, CASE WHEN outcome <> 'FAILED' THEN 'none' WHEN quantity % 5 = 0 THEN 'non-retryable' WHEN attempt >= 4 THEN 'attempts exhausted' ELSE 'retry' END AS decision FROM {activities}",
    "expired_clock": "SELECT run_id, event_id, CASE WHEN kind = 0 AND fire_at - set_at > 50000000000 THEN 'HEARTBEAT' WHEN fire_at - set_at > 100000000000 THEN 'START_TO_CLOSE' WHEN kind = 2 AND fire_at - set_at > 20000000000 THEN 'SCHEDULE_TO_START' WHEN fire_at - set_at > 10000000000 THEN 'SCHEDULE_TO_CLOSE' ELSE 'NONE' END AS expired FROM {timers}",
    "nearest_deadline": "SELECT run_id, activity_id, attempt, least(scheduled_at + 600000000000, CASE WHEN outcome <> 'PENDING' THEN started_at + quantity * 1000000000 END, CASE WHEN quantity % 2 = 0 THEN started_at + 30000000000 END) AS deadline FROM {activities}",
    "compact_duration": "SELECT run_id, s, CASE WHEN s IS NULL THEN '-' WHEN s >= 86400 THEN CAST(floor(s / 86400) AS BIGINT) || 'd' || CAST(floor(s % 86400 / 3600) AS BIGINT) || 'h' WHEN s >= 3600 THEN CAST(floor(s / 3600) AS BIGINT) || 'h' || CAST(floor(s % 3600 / 60) AS BIGINT) || 'm' WHEN s >= 60 THEN CAST(floor(s / 60) AS BIGINT) || 'm' || CAST(s % 60 AS BIGINT) || 's' ELSE s || 's' END AS shown FROM (SELECT run_id, CAST((closed_at - started_at) / 1000000000 AS BIGINT) AS s FROM {executions})",
    "enum_names": "SELECT status, CASE status WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'CANCELED' WHEN 4 THEN 'TERMINATED' WHEN 5 THEN 'TIMED_OUT' WHEN 6 THEN 'CONTINUED_AS_NEW' END AS name, replace(replace(lower(trim(workflow_type)), '-', ''), '_', '') AS normal, count(*) AS n FROM {executions} GROUP BY 1, 2, 3",
    "event_detail": "SELECT run_id, event_id, concat_ws(' ', 'type=' || event_type, CASE WHEN value > 0 THEN 'value=' || CAST(floor(value) AS BIGINT) END, CASE WHEN props <> '' THEN 'props=' || props END) AS detail FROM {history}",
    "preview": "SELECT run_id, event_id, CASE WHEN length(p) > 12 THEN substring(p, 1, 5) || '...' || substring(p, length(p) - 3, 4) ELSE p END AS shown FROM (SELECT run_id, event_id, trim(props) AS p FROM {history})",
    # 2.9, 2.11, 2.13
    "recovery_ready": "SELECT run_id, event_id, 'workflow' AS kind FROM {history} h WHERE event_type = 9 AND NOT EXISTS (SELECT 1 FROM {history} n WHERE n.run_id = h.run_id AND n.event_id = h.event_id + 1 AND n.event_type = 41) UNION ALL SELECT run_id, activity_id, 'activity' FROM {activities} WHERE outcome = 'PENDING' AND started_at = scheduled_at",
    "wake_coalescing": "SELECT run_id, CAST(sum(starts) AS BIGINT) AS wakes FROM (SELECT run_id, CASE WHEN event_type IN (9, 42) AND coalesce(lag(event_type) OVER (PARTITION BY run_id ORDER BY event_id), 0) NOT IN (9, 42) THEN 1 ELSE 0 END AS starts FROM {history}) GROUP BY run_id",
    "signals_in_order": "SELECT run_id, event_id, props, CAST(row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS BIGINT) AS nth FROM {history} WHERE event_type = 9",
    "activity_sessions": "SELECT run_id, session, count(*) AS events, min(event_time) AS began, max(event_time) AS ended FROM (SELECT run_id, event_time, CAST(sum(fresh) OVER (PARTITION BY run_id ORDER BY event_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM (SELECT run_id, event_id, event_time, CASE WHEN event_time - lag(event_time) OVER (PARTITION BY run_id ORDER BY event_id) < 21600000000000 THEN 0 ELSE 1 END AS fresh FROM {history})) GROUP BY run_id, session",
    "backlog_depth": "SELECT task_queue, count(*) AS waiting, count_if(k > 50000) AS rejected, min(started_at) AS oldest FROM (SELECT task_queue, started_at, row_number() OVER (PARTITION BY task_queue ORDER BY started_at, run_id) AS k FROM {executions} WHERE status = 0) GROUP BY task_queue",
    "alert_for": "SELECT operation, min(slot) AS since, count(*) AS slots FROM (SELECT operation, slot, slot - row_number() OVER (PARTITION BY operation ORDER BY slot) AS island FROM (SELECT operation, CAST(floor(at_ns / 3600000000000) AS BIGINT) AS slot, count(*) AS n FROM {requests} GROUP BY operation, CAST(floor(at_ns / 3600000000000) AS BIGINT)) WHERE n >= 2) GROUP BY operation, island HAVING count(*) >= 2",
    "describe": "SELECT h.run_id, h.length, coalesce(p.pending, 0) AS pending, coalesce(t.timers, 0) AS timers FROM (SELECT run_id, count(*) AS length FROM {history} GROUP BY run_id) h LEFT JOIN (SELECT run_id, count(*) AS pending FROM {history} WHERE event_type = 40 GROUP BY run_id) p ON h.run_id = p.run_id LEFT JOIN (SELECT run_id, count(*) AS timers FROM {timers} WHERE kind = 0 GROUP BY run_id) t ON h.run_id = t.run_id",
    "failure_cause": "SELECT run_id, event_id, CASE WHEN event_type <> 43 THEN 0 WHEN value < 10 THEN 1 WHEN value < 50 THEN 5 ELSE 6 END AS cause FROM {history}",
}


def _used(text: str) -> list[str]:
    return [t for t in fixtures.TABLES if f"{{{t}}}" in text]


def query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    text = text.partition("--duck")[0]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: fixtures.TABLES[t](spark, sf_dir) for t in _used(text)})

    return run


def oracle(text: str) -> str:
    first, _, other = text.partition("--duck")
    text = other or first
    ctes = ",\n".join(fixtures.CTES[t] for t in _used(text))
    # DuckDB's count_if is a HUGEINT
    text = re.sub(r"count_if\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"count(CASE WHEN \1 THEN 1 END)", text)
    return f"WITH {ctes}\n" + re.sub(r"\{(\w+)\}", r"\1", text)
