"""Frames derived from the driver tables, each with the same frame as a SQL subquery.

The SQL twins are built from plain columns; the Spark side carries the documents as JSON text,
so that parsing is part of what is compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"


def sec(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- journal of load documents: four versions per load, from events -------------------------

STATUS_OF = {"error": "ERROR", "purchase": "SUCCESS", "view": "RUNNING", "click": "EVENT-WAIT", "signup": "TIME-WAIT"}


def status_of(c):
    out = None
    for k, v in STATUS_OF.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_OF.items()) + " END"
ALIVE_SQL = "CASE event_type WHEN 'error' THEN 'ABORTED' WHEN 'purchase' THEN 'COMPLETED' ELSE 'ACTIVE' END"


def load_versions(t) -> DataFrame:
    """Plain columns of the load versions."""
    e = t.events
    alive = F.when(F.col("event_type") == "error", "ABORTED").when(F.col("event_type") == "purchase", "COMPLETED").otherwise("ACTIVE")
    return e.select(
        F.floor(F.col("event_id") / 4).cast("bigint").alias("id"), "ts", "event_id", "user_id", "value",
        alive.alias("alive"), status_of(F.col("event_type")).alias("status"),
        (F.floor(F.col("event_id") / 4) % 97).cast("bigint").alias("wf_id"),
        (F.col("user_id") % 2 == 0).alias("auto"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("profile"),
        F.col("ts").cast("timestamp").alias("at"),
    )


LOADS_SQL = f"""(SELECT event_id // 4 AS id, ts, event_id, user_id, value, {ALIVE_SQL} AS alive,
  {STATUS_SQL} AS status, (event_id // 4) % 97 AS wf_id, user_id % 2 = 0 AS auto,
  'p' || (user_id % 3) AS profile FROM events)"""


def load_journal(t) -> DataFrame:
    """Journal rows (ts, seq, id, obj, url, msg) with the load documents as JSON."""
    v = load_versions(t)
    hour = F.expr("interval 1 hour")
    minute = F.expr("interval 1 minute")
    statuses = F.array(
        F.struct(sec(F.col("ts")).alias("effective_from"), F.col("status").alias("status"), F.lit("now").alias("log")),
        F.struct(sec(F.col("ts") - hour).alias("effective_from"), F.lit("START").alias("status"), F.lit("begin").alias("log")),
    )
    doc = F.struct(
        "id", "alive", "auto", "profile", "wf_id", "status", sec(F.col("ts") - hour).alias("start_dttm"),
        sec(F.col("ts") + minute).alias("end_dttm"),
        F.concat(F.lit("v"), F.round("value").cast("bigint").cast("string")).alias("status_log"),
        statuses.alias("loading_status"),
    )
    return v.select(
        "ts", F.col("event_id").alias("seq"), "id", F.lit("loading").alias("obj"), F.concat(F.lit("/loading/"), F.col("id").cast("string")).alias("url"),
        F.to_json(doc).alias("msg"),
    )


# Newest version of every load, plain columns.
LAST_LOADS_SQL = f"""(SELECT * FROM {LOADS_SQL} QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1)"""


# --- start/end journal from events ----------------------------------------------------------

def run_journal(t) -> DataFrame:
    """(id, ts, parent, wf_action, wf_message): errors and purchases end the previous event."""
    is_end = F.col("event_type").isin("error", "purchase")
    begin = F.to_json(F.struct(
        F.concat(F.lit("wf_"), F.col("user_id").cast("string")).alias("wf"), F.col("user_id").alias("lid"),
        F.concat(F.lit("tb_"), (F.col("user_id") % 20).cast("string")).alias("obj"), F.lit("stg").alias("sch"),
    ))
    end = F.to_json(F.struct(
        F.when(F.col("event_type") == "error", F.lit("-9")).otherwise(F.when(F.col("value") > 50, "1").otherwise("0")).alias("res"),
        (F.col("user_id") % 97).alias("wf_id"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("msg"),
        sec(F.col("ts")).alias("last"),
    ))
    return t.events.select(
        F.col("event_id").alias("id"), "ts", F.when(is_end, F.col("event_id") - 1).alias("parent"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "end").otherwise("start").alias("wf_action"),
        F.when(is_end, end).otherwise(begin).alias("wf_message"),
    )


RUNS_SQL = """(SELECT a.event_id AS beg_id, a.ts AS beg_ts, 'wf_' || a.user_id AS wf, a.user_id AS loading_id,
  'tb_' || (a.user_id % 20) AS obj, 'stg' AS sch, a.event_type AS category,
  b.event_id AS end_id, b.ts AS end_ts,
  CASE b.event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'end' END AS end_action,
  CASE WHEN b.event_type = 'error' THEN -9 WHEN b.value > 50 THEN 1 WHEN b.event_id IS NOT NULL THEN 0 END AS res,
  b.user_id % 97 AS wf_id, CASE WHEN b.event_id IS NOT NULL THEN 'm' || b.event_id END AS msg, b.value AS end_value,
  (epoch_us(b.ts) - epoch_us(a.ts)) / 1000000.0::DOUBLE AS duration
  FROM (SELECT * FROM events WHERE event_type NOT IN ('error', 'purchase')) a
  LEFT JOIN (SELECT * FROM events WHERE event_type IN ('error', 'purchase')) b ON b.event_id - 1 = a.event_id)"""


# --- daily growth series: object = order priority, one row per day -----------------------------

def growth_history(t) -> DataFrame:
    """z-test history (object, key_date, rows_count, key_diff, value, ..., ztest, ts, log_id).

    One row per object and calendar day, so the windows below stay small whatever the data size.
    """
    from pyspark.sql import Window as W

    daily = t.orders.groupBy(F.col("o_orderpriority").alias("object"), F.to_date("o_orderdate").alias("key_date")).agg(
        F.count("*").alias("n"))
    w = W.partitionBy("object").orderBy("key_date")
    s = daily.withColumn("rows_count", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn(
        "prev", F.lag("key_date").over(w)).withColumn("prev_rows", F.lag("rows_count").over(w))
    diff = F.datediff("key_date", "prev")
    value = F.when(F.col("prev").isNotNull(), F.expr("(rows_count - prev_rows) div datediff(key_date, prev)"))
    s = s.select("object", "key_date", "rows_count", diff.alias("key_diff"), value.alias("value"))
    rolling = w.rowsBetween(-30, 0)
    return s.select(
        "*",
        F.round(F.avg("value").over(rolling)).cast("bigint").alias("avg"),
        F.round(F.stddev_pop("value").over(rolling)).cast("bigint").alias("std"),
        F.count("value").over(rolling).alias("cnt"), F.min("value").over(rolling).alias("min"),
        F.max("value").over(rolling).alias("max"),
        ((F.dayofmonth("key_date") % 11) != 0).alias("ztest"),
        ((F.dayofmonth("key_date") - 16) * 0.4).alias("zscore"),
        (F.to_timestamp("key_date") + F.expr("interval 30 hours")).alias("ts"),
        F.datediff("key_date", F.lit("1990-01-01").cast("date")).cast("bigint").alias("log_id"),
    )


GROWTH_SQL = """(SELECT *,
  CAST(round(avg(value) OVER r) AS BIGINT) AS avg, CAST(round(stddev_pop(value) OVER r) AS BIGINT) AS std,
  count(value) OVER r AS cnt, min(value) OVER r AS min, max(value) OVER r AS max,
  (day(key_date) % 11) <> 0 AS ztest, (day(key_date) - 16) * 0.4::DOUBLE AS zscore,
  key_date::TIMESTAMP + INTERVAL 30 HOUR AS ts, key_date - DATE '1990-01-01' AS log_id
 FROM (SELECT object, key_date, rows_count, key_date - lag(key_date) OVER w AS key_diff,
   (rows_count - lag(rows_count) OVER w) // (key_date - lag(key_date) OVER w) AS value
  FROM (SELECT object, key_date, CAST(sum(n) OVER (PARTITION BY object ORDER BY key_date) AS BIGINT) AS rows_count
   FROM (SELECT o_orderpriority AS object, o_orderdate::DATE AS key_date, count(*) AS n FROM orders GROUP BY ALL))
  WINDOW w AS (PARTITION BY object ORDER BY key_date))
 WINDOW r AS (PARTITION BY object ORDER BY key_date ROWS BETWEEN 30 PRECEDING AND CURRENT ROW))"""

# --- z-test settings per object, from the distinct priorities ----------------------------------

def growth_config(t) -> DataFrame:
    """(object, active, rollback, key, hist, min, max, interval_days, skip, beg, end, dots, zfr, zto, z_except, z_error)."""
    o = t.orders.groupBy(F.col("o_orderpriority").alias("object")).agg(F.count("*").alias("n"))
    digit = F.substring("object", 1, 1).cast("int")
    return o.select(
        "object", (digit != 9).alias("active"), digit.isin(1, 3, 4).alias("rollback"),
        F.lit(None).cast("int").alias("key"),
        F.when(digit == 2, (F.col("n") / 2).cast("bigint")).alias("hist"),
        F.when(digit == 4, F.lit(0)).cast("bigint").alias("min"),
        F.when(digit == 4, F.lit(100000)).cast("bigint").alias("max"),
        F.when(digit == 3, F.lit(2)).cast("int").alias("interval_days"),
        F.when(digit == 5, F.lit(False)).alias("skip"),
        F.when(digit == 3, F.lit("1999-01-01").cast("date")).alias("beg"),
        F.lit(None).cast("date").alias("end"),
        F.when(digit == 1, F.lit(30)).cast("int").alias("dots"),
        F.when(digit == 2, F.lit(-4.0)).alias("zfr"), F.lit(None).cast("double").alias("zto"),
        F.array(F.lit("2001-07-22").cast("date")).alias("z_except"),
        F.array(F.lit("2001-07-15").cast("date")).alias("z_error"),
    )


GROWTH_CONFIG_SQL = """(SELECT object, d <> 9 AS active, d IN (1, 3, 4) AS rollback, CASE WHEN d = 2 THEN n // 2 END AS hist,
  CASE WHEN d = 4 THEN 0 END AS zmin, CASE WHEN d = 4 THEN 100000 END AS zmax,
  CASE WHEN d = 3 THEN 2 END AS interval_days, CASE WHEN d = 5 THEN false END AS skip,
  CASE WHEN d = 3 THEN DATE '1999-01-01' END AS beg, CASE WHEN d = 1 THEN 30 END AS dots,
  CASE WHEN d = 2 THEN -4.0::DOUBLE END AS zfr, [DATE '2001-07-22'] AS z_except, [DATE '2001-07-15'] AS z_error
  FROM (SELECT o_orderpriority AS object, CAST(substr(o_orderpriority, 1, 1) AS INT) AS d, count(*) AS n FROM orders GROUP BY ALL))"""
