"""Every history query against its SQL in DuckDB, over whole small tables."""

import json
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

NAMES = [k for k in entry.queries() if not (k[:2] == "op" and k[2:3].isdigit()) and k != "pipeline"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{t}')")
    return con


def rows(df, columns):
    plain = lambda v: "" if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(map(plain, r)) for r in df[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, sf_dir, duck, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_pages_by_key(spark, sf_dir):
    from runledger import fixtures
    from runledger.operators.reads import list_executions

    runs = fixtures.executions(spark, sf_dir)
    seen, token = [], ""
    while True:
        page, token = list_executions(runs, {"status": 1}, 200, token)
        seen += [r.run_id for r in page.collect()]
        if not token:
            break
    assert len(seen) == len(set(seen)) == runs.where("status = 1").count()


def test_history_files(spark, tmp_path):
    from runledger.sources.history_json import read_histories

    (tmp_path / "a.json").write_text('[{"id": 1, "time": "2024-03-01T12:00:00Z", "type": "WorkflowExecutionStarted", "attrs": {"attempt": 1}}]')
    (row,) = read_histories(spark, f"{tmp_path}/a.json").collect()
    assert row.event_type == 1 and json.loads(row.attrs) == {"attempt": 1}
    (tmp_path / "b.json").write_text('[{"id": 1, "time": "2024-03-01T12:00:00Z", "type": "Nonsense", "attrs": {}}]')
    with pytest.raises(Exception, match="unknown event type"):
        read_histories(spark, f"{tmp_path}/b.json").collect()


def test_violations_of_attributes_and_references(spark):
    from runledger.operators.reads import violations

    w = {"workflow_task_completed_event_id": 4}
    good = [(1, 1, {"workflow_type": "t", "task_queue": "q"}), (2, 20, {}), (3, 21, {"scheduled_event_id": 2}), (4, 22, {"scheduled_event_id": 2, "started_event_id": 3})]
    good += [(5, 40, {"activity_id": "a", **w}), (6, 60, {"timer_id": "t", "start_to_fire_timeout": 1, **w}), (7, 41, {"scheduled_event_id": 5}), (8, 42, {"scheduled_event_id": 5, "started_event_id": 7}), (9, 61, {"started_event_id": 6}), (10, 2, w)]
    bad = {
        "V4": (10, 9, None), "V5": (10, 99, {}), "V15": (6, 60, {"timer_id": "", **w}), "V16": (10, 3, w),
        "V11": (10, 2, {"workflow_task_completed_event_id": 0}), "V12": (4, 22, {"started_event_id": 2}), "V13": (8, 42, {"scheduled_event_id": 5, "started_event_id": 5}), "V14": (9, 61, {"started_event_id": 9}),
    }
    runs = {"good": good} | {rule: [x if e[0] == x[0] else e for e in good] for rule, x in bad.items()}
    rows = [(r, k, t, 1000 + k, None if a is None else json.dumps(a)) for r, events in runs.items() for k, t, a in events]
    out = violations(spark.createDataFrame(rows, "run_id string, event_id long, event_type int, event_time long, attrs string")).collect()
    got = {r: {x.rule for x in out if x.run_id == r} for r in runs}
    want = {r: {r} | ({"V10"} if r in ("V11", "V12", "V13", "V14") else set()) for r in runs} | {"good": set()}
    assert got == want
    long = spark.range(1, 50_002).selectExpr("'r' AS run_id", "id AS event_id", "if(id = 1, 1, 9) AS event_type", "id AS event_time")
    assert [tuple(r) for r in violations(long).collect()] == [("r", 50_001, "V1")]


def test_activity_pairs_beyond_five_events(spark):
    from runledger.operators.reads import activity_pairs

    kinds = [40, 9, 9, 9, 9, 9, 9, 41, 9, 43, 40, 41, 40]
    rows = [(1, k + 1, t) for k, t in enumerate(kinds)]
    out = activity_pairs(spark.createDataFrame(rows, "run_id long, event_id long, event_type int")).collect()
    assert sorted(tuple(r)[1:] for r in out if r.scheduled_id < 11) == [(1, 8, 10)]
    assert {r.scheduled_id: (r.started_id, r.closed_id) for r in out if r.scheduled_id > 10} == {11: (12, None), 13: (None, None)}


def test_times_do_not_move_with_the_session(spark, sf_dir):
    from runledger import fixtures

    here = sorted(fixtures.requests(spark, sf_dir).limit(50).select("request_id", "at_ns").collect())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(fixtures.requests(spark, sf_dir).limit(50).select("request_id", "at_ns").collect()) == here
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_page_tokens(spark, sf_dir):
    from runledger import fixtures
    from runledger.operators.reads import list_executions, page_size

    assert [page_size(x) for x in (None, 0, -1, 5, 5000)] == [100, 100, 100, 5, 1000]
    runs = fixtures.executions(spark, sf_dir)
    _, token = list_executions(runs, {"status": 1}, 10)
    with pytest.raises(ValueError, match="other filters"):
        list_executions(runs, {"status": 0}, 10, token)


def test_pending_timers_of_a_stream_equal_the_batch(spark, sf_dir):
    from runledger import histories
    from runledger.operators import state
    from runledger.streaming.timers import streamed_timers

    h = histories.histories(spark, sf_dir).where("substring(run_id, 5, 9) % 3 = 0")
    got = sorted(map(tuple, streamed_timers(spark, h).collect()))
    assert got == sorted(map(tuple, state.desired_timers(h).where("kind in (0, 2)").collect())) and got


def test_uuids_and_words(spark):
    import uuid

    from runledger.functions import random

    def word(seed, n):
        x = (seed + n * random.GAMMA) % 2**64
        x = (x ^ x >> 30) * random.MIX_1 % 2**64
        x = (x ^ x >> 27) * random.MIX_2 % 2**64
        return (x ^ x >> 31) >> 1

    rows = spark.createDataFrame([(42, n) for n in range(1, 6)], "seed long, n long").select("n", random.random_word("seed", "n").alias("w"), random.random_uuid("seed", "n").alias("u"))
    stream = [word(42 ^ random.UUID_SALT, k // 7 + 1) >> 8 * (k % 7) & 255 for k in range(80)]
    for r in rows.collect():
        assert r.w == word(42, r.n) and r.u == str(uuid.UUID(bytes=bytes(stream[16 * r.n - 16 : 16 * r.n]), version=4))


def test_chains_of_many_runs(spark):
    from runledger.operators.state import chains

    rows = [(f"r{i}", 1, 1, None) for i in range(40)] + [(f"r{i}", 2, 7, f"r{i + 1}") for i in range(36)] + [("r39", 2, 7, "gone")]
    out = {r.run_id: (r.link, r.head, r.last) for r in chains(spark.createDataFrame(rows, "run_id string, event_id long, event_type int, name string")).collect()}
    assert out == {f"r{i}": (i, "r0", "r36") for i in range(37)} | {f"r{i}": (0, f"r{i}", f"r{i}") for i in (37, 38, 39)}


@pytest.mark.parametrize("name", ["fold_state", "activity_table", "pending_work", "wanted_timers", "validate_rules", "validate_first", "event_lines", "stream_feed"])
def test_events_are_not_shuffled(spark, sf_dir, name):
    from runledger import histories

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = histories.histories(spark, sf_dir) if name == "stream_feed" else entry.queries()[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 2 and plan.count("FileScan") == 2  # lines and orders, once each


def test_references_to_older_and_doubled_events(spark):
    from runledger.operators.validation import violations

    cols = "run_id string, event_id long, event_type int, event_time long, scheduled_id long, started_id long, task_id long, name string, kind string, timeout long, failure string, has_attrs boolean"
    event = lambda i, t, s=None, b=None, w=None, n=None: (i, t, 100 + i, s, b, w, n, "q", 1, None, True)
    base = [event(1, 1, n="t"), event(2, 20), event(3, 21, 2), event(4, 22, 2, 3), event(5, 40, w=4, n="a"), event(6, 60, w=4, n="t"), event(7, 40, w=4, n="b"), event(8, 60, w=4, n="u")]
    runs = {
        "gap": [event(9, 41, 5), event(10, 42, 5, 9), event(11, 61, b=6)],  # an activity and a timer that are not the newest
        "other": [event(9, 41, 6), event(10, 42, 5, 9), event(11, 61, b=8)],  # 6 lies among the activities but is a timer
        "later": [event(9, 41, 12), event(10, 42, 5, 9), event(11, 61, b=6), event(12, 40, w=4, n="c")],
        "twice": [event(8, 40, w=4, n="d"), event(9, 41, 8), event(10, 61, b=8)],  # id 8 is a timer and an activity
    }
    rows = [(r, *e) for r, more in runs.items() for e in base + more]
    found = violations(spark.createDataFrame(rows, cols)).where("rule in ('V11', 'V12', 'V13', 'V14')").collect()
    assert sorted(tuple(r) for r in found) == [("later", 9, "V13"), ("other", 9, "V13")]


def test_durations_are_rounded_half_up(spark):
    from pyspark.sql import functions as F

    from runledger.functions.text import compact_duration

    want = {0: "0ms", 999_999_999: "999ms", 1_049_999_999: "1.0s", 1_050_000_000: "1.1s", 59_950_000_000: "60.0s", 60_000_000_000: "1m00s", 3_599_000_000_000: "59m59s", 3_660_000_000_000: "1h01m", 90_000_000_000_000: "1d01h", -2_250_000_000: "2.3s", 9_000_000_000_000_000: "104d04h"}
    rows = spark.createDataFrame([(d,) for d in want], "d long").select("d", compact_duration(F.col("d")).alias("t"))
    assert {r.d: r.t for r in rows.collect()} == want
    assert "format_string" not in rows._jdf.queryExecution().executedPlan().toString()


def test_report_of_runs_without_commands(spark):
    from runledger.operators.replay import replay_report

    h = spark.createDataFrame([("a", 1, 1, None, "x"), ("a", 2, 40, 1, "a1"), ("b", 1, 1, None, "x"), ("c", 1, 40, 1, "a1")], "run_id string, event_id long, event_type int, task_id long, name string")
    h = h.selectExpr("*", "'k' AS kind", "0L AS timeout", "0L AS started_id", "0L AS scheduled_id")
    c = spark.createDataFrame([("a", 1, 1, 1, "a2", "k", 0, 0), ("d", 1, 1, 1, "a2", "k", 0, 0)], "run_id string, task_id long, pos long, command_type int, name string, kind string, timeout long, started_id long")
    assert sorted(tuple(r) for r in replay_report(h, c).collect()) == [("a", False, 1, "activity id", "NON_DETERMINISM"), ("b", True, 0, None, None)]


@pytest.mark.parametrize("name", ["activities", "full"])
def test_parts_of_lines_are_not_merged(spark, sf_dir, name):
    from runledger import fixtures, histories

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    try:
        df = (fixtures.activities if name == "activities" else histories.histories)(spark, sf_dir)
        used = {r[0] for r in df.selectExpr("spark_partition_id()").distinct().collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(used) == 29
