"""Deterministic projections of the driver's tables into workflow-history shape, for Spark and as SQL.

Times are BIGINT nanoseconds; 0 never occurs for a set time. The tables are derived, so every query grows with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types that the five kinds of events stand for.
EVENT_CODES = {"signup": 9, "click": 40, "view": 41, "purchase": 42, "error": 43}


def ns(ts: str) -> Column:
    """Nanoseconds since 1970 of a time without zone, whatever the session's zone."""
    t = f"CAST({ts} AS TIMESTAMP_NTZ)"
    return F.expr(f"(unix_date(CAST({t} AS DATE)) * 86400000000L + (hour({t}) * 3600L + minute({t}) * 60L) * 1000000L + CAST(extract(SECOND FROM {t}) * 1000000 AS BIGINT)) * 1000L")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, line = (_read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    shipped = line.groupBy("l_orderkey").agg(F.max(ns("l_shipdate")).alias("shipped"))
    rows = orders.join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(2)
    closed = F.when(F.col("o_orderstatus") != "O", F.greatest(ns("o_orderdate"), F.coalesce("shipped", F.lit(0))))
    return rows.select(
        F.lit("default").alias("ns"),
        F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("workflow_id"),
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_orderpriority").alias("workflow_type"),
        F.col("c_mktsegment").alias("task_queue"),
        status.alias("status"),
        ns("o_orderdate").alias("started_at"),
        closed.alias("closed_at"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.create_map(*(F.lit(x) for kv in EVENT_CODES.items() for x in kv))[F.col("event_type")]
    # run_id is named before the window, so that later windows and joins on it reuse its partitions
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("source_id"), code.alias("event_type"), "ts", "value", "props")
    order = F.expr("row_number() OVER (PARTITION BY run_id ORDER BY ts, source_id)").cast("bigint")
    return rows.select("run_id", order.alias("event_id"), "source_id", "event_type", ns("ts").alias("event_time"), "value", "props")


def timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        "event_id",
        (F.col("event_id") % 6).cast("int").alias("kind"),
        (F.col("event_id") % 5 + 1).cast("int").alias("attempt"),
        (ns("ts") + (F.col("value") * 1000).cast("bigint") * 1000000).alias("fire_at"),
        ns("ts").alias("set_at"),
    )


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows by key in spark.sql.shuffle.partitions parts. A number that is asked for stays, where parts that a join makes
    are merged up to 64 MB as shuffled, and a task then holds many times that."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = dealt(_read(spark, sf_dir, "lineitem"), "l_orderkey"), _read(spark, sf_dir, "orders")
    rows = line.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("attempt"),
        F.col("l_partkey").alias("activity_id"),
        F.when(F.col("l_returnflag") == "R", "FAILED").when(F.col("l_returnflag") == "A", "COMPLETED").otherwise("PENDING").alias("outcome"),
        F.col("l_linestatus").alias("task_queue"),
        ns("o_orderdate").alias("scheduled_at"),
        F.greatest(ns("o_orderdate"), ns("l_shipdate")).alias("started_at"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("caller"),
        F.col("event_type").alias("operation"),
        F.when(F.col("event_type") == "error", "internal").otherwise("ok").alias("code"),
        (F.col("value") / 100).alias("latency"),
        ns("ts").alias("at_ns"),
    )


TABLES = {"executions": executions, "history": history, "timers": timers, "activities": activities, "requests": requests}

#: The same projections for the SQL oracle.
CTES = {
    "executions": """executions AS (SELECT 'default' AS ns, 'cust-' || o_custkey AS workflow_id, 'run-' || o_orderkey AS run_id, o_orderpriority AS workflow_type, c_mktsegment AS task_queue,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 2 END AS status, epoch_us(o_orderdate) * 1000 AS started_at,
  CASE WHEN o_orderstatus <> 'O' THEN greatest(epoch_us(o_orderdate) * 1000, coalesce(shipped, 0)) END AS closed_at
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, max(epoch_us(l_shipdate) * 1000) AS shipped FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)""",
    "history": """history AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_id, event_id AS source_id,
  CASE event_type WHEN 'signup' THEN 9 WHEN 'click' THEN 40 WHEN 'view' THEN 41 WHEN 'purchase' THEN 42 WHEN 'error' THEN 43 END AS event_type, epoch_us(ts) * 1000 AS event_time, value, props FROM events)""",
    "timers": """timers AS (SELECT user_id AS run_id, event_id, CAST(event_id % 6 AS INT) AS kind, CAST(event_id % 5 + 1 AS INT) AS attempt,
  epoch_us(ts) * 1000 + CAST(trunc(value * 1000) AS BIGINT) * 1000000 AS fire_at, epoch_us(ts) * 1000 AS set_at FROM events)""",
    "activities": """activities AS (SELECT l_orderkey AS run_id, l_linenumber AS attempt, l_partkey AS activity_id, CASE l_returnflag WHEN 'R' THEN 'FAILED' WHEN 'A' THEN 'COMPLETED' ELSE 'PENDING' END AS outcome,
  l_linestatus AS task_queue, epoch_us(o_orderdate) * 1000 AS scheduled_at, greatest(epoch_us(o_orderdate), epoch_us(l_shipdate)) * 1000 AS started_at, CAST(l_quantity AS BIGINT) AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "requests": """requests AS (SELECT event_id AS request_id, user_id AS caller, event_type AS operation, CASE WHEN event_type = 'error' THEN 'internal' ELSE 'ok' END AS code, value / 100 AS latency, epoch_us(ts) * 1000 AS at_ns FROM events)""",
}
