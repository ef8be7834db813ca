"""Report queries."""

from pyspark.sql import functions as F

from tidewatch.operators import journal as J
from tidewatch.operators import quality as Q
from tidewatch.operators import reports as R
from tidewatch.plans import inputs as I
from tidewatch.plans.registry import query

AT = "2024-01-10 12:00:00"


def sizes(t):
    """Order lines as size samples of the tables of a supplier."""
    s = F.col("l_suppkey")
    storage = F.when(s % 3 == 0, "a").when(s % 3 == 1, "c").otherwise("h")
    size = t.lineitem.select(F.concat(F.lit("s.t"), s.cast("string")).alias("tbl"), F.col("l_shipdate").alias("load_date"), (F.col("l_partkey") * 1000 + F.col("l_orderkey")).alias("size"),
                             (F.col("l_partkey") * 3 + F.col("l_linenumber")).alias("rows"), storage.alias("storage"))
    skew = t.lineitem.select(F.concat(F.lit("s.t"), s.cast("string")).alias("tbl"), F.col("l_shipdate").alias("ts"), (F.col("l_partkey") * 1000 + F.col("l_orderkey")).alias("tbl_size"),
                             (F.col("l_partkey") * (s % 11) * 100).alias("data_size"), F.round(F.col("l_quantity") / 7, 3).alias("skew"), storage.alias("storage"))
    return size, skew


_SIZE = """sz AS (SELECT 's.t' || l_suppkey AS tbl, l_shipdate AS ts, l_partkey * 1000 + l_orderkey AS size, l_partkey * 3 + l_linenumber AS rws, l_partkey * (l_suppkey % 11) * 100 AS data_size, round(l_quantity / 7, 3) AS skew,
  CASE l_suppkey % 3 WHEN 0 THEN 'row' WHEN 1 THEN 'column' ELSE 'uncompress' END AS storage FROM lineitem)"""


@query("growth_stats", f"""WITH {_SIZE}, r AS (SELECT * FROM sz WHERE ts >= TIMESTAMP '2001-06-25' AND ts < TIMESTAMP '2001-07-27'),
n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY ts DESC, size DESC, rws DESC) = 1), o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY ts, size, rws) = 1),
k AS (SELECT tbl, round(skew, 2) AS skew FROM sz QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY ts DESC, skew DESC) = 1),
x AS (SELECT n.tbl, n.size, n.size - o.size AS size_delta, n.rws - o.rws AS rows_delta, nullif(n.ts::DATE - o.ts::DATE, 0) AS days, (SELECT sum(size) FROM n) AS total, k.skew, n.storage FROM n JOIN o USING (tbl) LEFT JOIN k USING (tbl))
SELECT tbl, size, storage, size_delta, rows_delta, days, skew, size_delta // days AS size_speed, rows_delta // days AS rows_speed, round(size_delta * 100.0::DOUBLE / days / total, 4) AS speed_percent, round(size * 100.0::DOUBLE / total, 4) AS size_percent FROM x""")
def _(t):
    g = R.growth_stats(*sizes(t), "2001-07-25", days=30)
    return g.select("tbl", "size", "storage", "size_delta", "rows_delta", "days", "skew", "size_speed", "rows_speed", "speed_percent", "size_percent")


_LASTS = _SIZE + """, l AS (SELECT *, round(size / nullif(data_size, 0)::DOUBLE, 2) AS size_ratio FROM sz WHERE ts BETWEEN TIMESTAMP '2001-06-25' AND TIMESTAMP '2001-07-26' QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY ts DESC, size DESC) = 1)"""
_LCOLS = ["tbl", "tbl_size", "data_size", "size_ratio", "storage"]


@query("skew_report", f"WITH {_LASTS} SELECT tbl, size AS tbl_size, data_size, size_ratio, storage FROM l ORDER BY size * coalesce(skew * skew, 1) DESC, tbl LIMIT 25")
def _(t):
    return R.skew_report(sizes(t)[1], "2001-07-25", 25).select(*_LCOLS)


@query("ratio_report", f"WITH {_LASTS} SELECT tbl, size AS tbl_size, data_size, size_ratio, storage FROM l WHERE data_size > 0 ORDER BY size - data_size DESC, tbl LIMIT 25")
def _(t):
    return R.ratio_report(sizes(t)[1], "2001-07-25", 25).select(*_LCOLS)


@query("uncompressed_report", f"WITH {_LASTS} SELECT tbl, size AS tbl_size, data_size, size_ratio, storage FROM l WHERE storage = 'uncompress' ORDER BY size DESC, tbl LIMIT 25")
def _(t):
    return R.uncompressed_report(sizes(t)[1], "2001-07-25", 25).select(*_LCOLS)


# --- control log: the paired run journal with the start event type as category ----------------------

def control(t):
    p = J.control_log(I.run_journal(t))
    cat = t.events.select(F.col("event_id").alias("beg_id"), F.col("event_type").alias("category"))
    return p.join(cat, "beg_id")


_CL = f"cl AS (SELECT *, date_trunc('day', TIMESTAMP '{AT}') AS d0 FROM {I.RUNS_SQL})"
_CNT = ", ".join(f"nullif(count(*) FILTER (WHERE res = {c}), 0) AS {n}" for c, n in R.RESULT_COUNTERS.items())
_LIST = "beg_id, end_id, wf, loading_id, CAST(res AS BIGINT) AS res, duration"
_LISTC = ["beg_id", "end_id", "wf", "loading_id", "res", "duration"]


@query("day_summary", f"""WITH {_CL}, r AS (SELECT * FROM cl WHERE beg_ts >= d0 - INTERVAL 1 DAY AND beg_ts < d0)
SELECT category, count(*) AS wf_cnt, round(sum(duration), 3) AS sum_time, round(max(duration), 3) AS max_dur, {_CNT} FROM r GROUP BY category
UNION ALL SELECT 'All', count(*), round(sum(duration), 3), round(max(duration), 3), {_CNT} FROM r""")
def _(t):
    return R.day_summary(control(t), AT)


_LABEL = "CASE res " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in R.RESULT_LABELS.items()) + " ELSE 'Error' END"


@query("done_board", f"""WITH {_CL}, r AS (SELECT *, {_LABEL} AS res_msg FROM cl WHERE beg_ts >= d0 AND beg_ts <= TIMESTAMP '{AT}' AND res IS NOT NULL)
SELECT res_msg, category, 'wf' AS wf_prefix, count(*) AS cnt, min(beg_ts)::VARCHAR AS min_beg, max(end_ts)::VARCHAR AS max_end, round(max(duration), 3) AS max_duration, round(sum(duration), 3) AS sum_duration FROM r GROUP BY ALL
UNION ALL SELECT 'total', NULL, NULL, count(*), min(beg_ts)::VARCHAR, max(end_ts)::VARCHAR, round(max(duration), 3), round(sum(duration), 3) FROM r""")
def _(t):
    return R.done_board(control(t), AT)


@query("errors_merged", """WITH e AS (SELECT ts, 'o' || (user_id % 10) AS obj, 'm' || (event_id % 3) AS msg, CASE WHEN event_id % 4 = 0 THEN ts - INTERVAL 1 HOUR END AS f, event_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-11')
SELECT 'log' AS src, f::VARCHAR AS first_ts, ts::VARCHAR AS last_ts, event_id AS cnt, obj, msg FROM e WHERE f IS NOT NULL UNION ALL SELECT 'tbl', min(ts)::VARCHAR, max(ts)::VARCHAR, count(*), obj, msg FROM e WHERE f IS NULL GROUP BY obj, msg""")
def _(t):
    k = F.col("event_id")
    e = t.events.filter("event_type = 'error'").select(
        "ts", F.concat(F.lit("o"), (F.col("user_id") % 10).cast("string")).alias("obj"), F.concat(F.lit("m"), (k % 3).cast("string")).alias("msg"),
        F.when(k % 4 == 0, F.expr("ts - interval 1 hour")).alias("first_ts"), F.col("ts").alias("last_ts"), k.alias("cnt"))
    return R.errors_merged(e, AT)


def long_log(t):
    """Events as loads that last up to some hours."""
    return t.events.select(
        F.col("event_id").alias("beg_id"), F.col("event_type").alias("category"), F.concat(F.lit("wf_"), (F.col("user_id") % 40).cast("string")).alias("wf"), F.col("ts").alias("beg_ts"),
        F.expr("ts + make_dt_interval(0, 0, 0, cast(value * 40 as int))").alias("end_ts"), F.col("user_id").alias("loading_id"))


_SLOT = """ll AS (SELECT event_id, event_type, 'wf_' || (user_id % 40) AS wf, ts AS b, ts + to_seconds(CAST(trunc(value * 40) AS BIGINT)) AS e FROM events),
sl AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-09', TIMESTAMP '2024-01-09 23:59:00', INTERVAL 10 MINUTE)) AS slot),
ov AS (SELECT slot, wf, event_type, epoch_us(least(e, slot + INTERVAL 10 MINUTE)) - epoch_us(greatest(b, slot)) AS busy FROM sl JOIN ll ON b < slot + INTERVAL 10 MINUTE AND e > slot),
ag AS (SELECT slot, count(DISTINCT wf) AS wf, sum(busy) / 1000000.0::DOUBLE / 600 / (SELECT max(user_id % 7 + 1) FROM events WHERE ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-10') AS rate FROM ov GROUP BY 1)"""


@query("workload_10min", f"WITH {_SLOT} SELECT hour(slot) AS hour, " + ", ".join(
    f"coalesce(max(wf) FILTER (WHERE minute(slot) = {m}), 0) AS cnt_{m:02d}, round(coalesce(max(rate) FILTER (WHERE minute(slot) = {m}), 0), 4) AS rate_{m:02d}" for m in range(0, 60, 10)) + " FROM ag GROUP BY 1")
def _(t):
    return R.workload_10min(long_log(t), t.events.select(F.col("ts").alias("beg_ts"), (F.col("user_id") % 7 + 1).alias("processes")), AT)


@query("workload_categories", f"WITH {_SLOT} SELECT hour(slot) AS hour, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS categories FROM ov GROUP BY 1")
def _(t):
    return R.workload_categories(long_log(t), AT).withColumn("categories", F.array_join("categories", ","))


_OK = "ok AS (SELECT wf, max(beg_ts)::VARCHAR AS last_ok FROM cl WHERE res = 1 AND category <> 'view' GROUP BY 1)"


@query("errors_with_last_ok", f"WITH {_CL}, {_OK} SELECT {_LIST}, last_ok FROM cl LEFT JOIN ok USING (wf) WHERE res NOT IN (0, 1) AND end_ts >= d0 - INTERVAL 1 DAY AND end_ts < d0")
def _(t):
    return R.errors_with_last_ok(control(t), AT, "view").select(*_LISTC, "last_ok")


@query("today_errors", f"WITH {_CL}, {_OK} SELECT {_LIST}, last_ok FROM cl LEFT JOIN ok USING (wf) WHERE res NOT IN (0, 1) AND end_ts >= d0 AND end_ts <= TIMESTAMP '{AT}'")
def _(t):
    return R.today_errors(control(t), AT, "view").select(*_LISTC, "last_ok")


@query("no_data", f"WITH {_CL}, {_OK} SELECT {_LIST}, last_ok FROM cl LEFT JOIN ok USING (wf) WHERE res = 0 AND end_ts >= d0 AND end_ts <= TIMESTAMP '{AT}'")
def _(t):
    return R.no_data(control(t), AT, "view").select(*_LISTC, "last_ok")


@query("long_runs", f"WITH {_CL} SELECT {_LIST} FROM cl WHERE duration >= 300 AND end_ts >= d0 - INTERVAL 1 DAY AND end_ts < d0")
def _(t):
    return R.long_runs(control(t), AT, minutes=5).select(*_LISTC)


@query("ok_today", f"WITH {_CL} SELECT {_LIST} FROM cl WHERE res = 1 AND end_ts >= d0 AND end_ts < d0 + INTERVAL 1 DAY")
def _(t):
    return R.ok_today(control(t), AT).select(*_LISTC)


@query("facts_today", f"WITH {_CL} SELECT {_LIST} FROM cl WHERE category = 'view' AND end_ts >= d0 AND end_ts < d0 + INTERVAL 1 DAY")
def _(t):
    return R.facts_today(control(t), AT, "view").select(*_LISTC)


@query("all_today", f"WITH {_CL} SELECT {_LIST} FROM cl WHERE end_ts >= d0 AND end_ts < d0 + INTERVAL 1 DAY")
def _(t):
    return R.all_today(control(t), AT).select(*_LISTC)


@query("all_yesterday", f"WITH {_CL} SELECT {_LIST} FROM cl WHERE end_ts >= d0 - INTERVAL 1 DAY AND end_ts < d0")
def _(t):
    return R.all_yesterday(control(t), AT).select(*_LISTC)


# --- loads with their catalog ----------------------------------------------------------------------

def catalog(t):
    w = I.load_versions(t).select("wf_id").distinct()
    k = F.col("wf_id")
    return w.select("wf_id", F.concat(F.lit("wf_"), k.cast("string")).alias("name"), F.concat(F.lit("c"), (k % 5).cast("string")).alias("category"), F.concat(F.lit("p"), (k % 2).cast("string")).alias("wf_profile"),
                    (k % 3 == 0).alias("scheduled"), (k % 11 == 0).alias("deleted"), ((1 + k % 4) * 21600).alias("interval_s"))


def loads(t):
    s = J.loading_state(I.load_journal(t))
    code = F.regexp_extract("status_log", r"v(\d+)", 1).cast("int") % 3 - 1
    return s.withColumn("status_log", F.concat(F.lit('{"res": '), code.cast("string"), F.lit("}")))


_LD = f"""ld AS (SELECT id, wf_id, alive, CASE WHEN alive = 'ABORTED' THEN 'ABORTED' ELSE status END AS status, date_trunc('second', CASE WHEN alive = 'ABORTED' THEN ts + INTERVAL 1 MINUTE ELSE ts END) AS status_dttm, date_trunc('second', ts - INTERVAL 1 HOUR) AS start_dttm, status AS raw_status,
  date_trunc('second', ts + INTERVAL 1 MINUTE) AS end_dttm, CAST(round(value) AS BIGINT) % 3 - 1 AS res, 'wf_' || wf_id AS name, 'c' || (wf_id % 5) AS category, 'p' || (wf_id % 2) AS wf_profile, wf_id % 3 = 0 AS scheduled, wf_id % 11 = 0 AS deleted, (1 + wf_id % 4) * 21600 AS itv,
  epoch(TIMESTAMP '{AT}') AS now, epoch(date_trunc('second', CASE WHEN alive = 'ABORTED' THEN ts + INTERVAL 1 MINUTE ELSE ts END)) AS st FROM {I.LAST_LOADS_SQL})"""


@query("day_board", f"""WITH {_LD}, r AS (SELECT * FROM ld WHERE NOT deleted AND (status_dttm >= TIMESTAMP '2024-01-10' OR alive = 'ACTIVE')),
g AS (SELECT category, nullif(count(DISTINCT wf_id) FILTER (WHERE alive = 'ACTIVE'), 0) AS active, nullif(count(DISTINCT wf_id) FILTER (WHERE alive = 'COMPLETED'), 0) AS completed, nullif(count(DISTINCT wf_id) FILTER (WHERE res > 0), 0) AS cnt_ok,
  nullif(count(DISTINCT wf_id) FILTER (WHERE res = 0), 0) AS cnt_no, nullif(count(DISTINCT wf_id) FILTER (WHERE res < 0), 0) AS cnt_err, nullif(count(DISTINCT wf_id) FILTER (WHERE alive IN ('ACTIVE', 'COMPLETED')) - count(DISTINCT wf_id) FILTER (WHERE alive = 'COMPLETED'), 0) AS waited,
  nullif(count(DISTINCT wf_id) FILTER (WHERE alive = 'ACTIVE' AND now - st BETWEEN itv AND itv * 2), 0) AS delayed, nullif(count(DISTINCT wf_id) FILTER (WHERE alive = 'ACTIVE' AND now - st > itv * 2), 0) AS expired FROM r GROUP BY 1)
SELECT * FROM g UNION ALL SELECT 'total', CAST(sum(active) AS BIGINT), CAST(sum(completed) AS BIGINT), CAST(sum(cnt_ok) AS BIGINT), CAST(sum(cnt_no) AS BIGINT), CAST(sum(cnt_err) AS BIGINT), CAST(sum(waited) AS BIGINT), CAST(sum(delayed) AS BIGINT), CAST(sum(expired) AS BIGINT) FROM g""")
def _(t):
    return R.day_board(loads(t), catalog(t), AT)


@query("old_and_working", f"WITH {_LD} SELECT id, wf_id, status, now - st AS status_age FROM ld WHERE alive = 'ACTIVE' AND wf_profile = 'p1' AND (now - epoch(start_dttm) > itv OR status NOT IN ('EVENT-WAIT', 'TIME-WAIT'))")
def _(t):
    return R.old_and_working(loads(t), catalog(t), AT, "p1").select("id", "wf_id", "status", "status_age")


@query("not_scheduled", f"WITH {_LD} SELECT DISTINCT wf_id, name, category FROM ld WHERE NOT scheduled AND NOT deleted AND category <> 'c4'")
def _(t):
    return R.not_scheduled(catalog(t), "c4").select("wf_id", "name", "category")


@query("catalog_board", f"""WITH {_LD}, w AS (SELECT wf_id, any_value(category) AS category, any_value(wf_profile) AS wf_profile, bool_or(scheduled) AS sc, bool_or(deleted) AS de, bool_or(alive = 'ACTIVE' AND status IN ('EVENT-WAIT', 'TIME-WAIT')) AS wa, bool_or(alive = 'ACTIVE' AND status NOT IN ('EVENT-WAIT', 'TIME-WAIT')) AS ru FROM ld GROUP BY 1)
SELECT category, wf_profile, count(*) AS flows, count(*) FILTER (WHERE sc AND NOT de) AS scheduled, count(*) FILTER (WHERE NOT sc AND NOT de) AS not_scheduled, count(*) FILTER (WHERE de) AS deleted, count(*) FILTER (WHERE wa) AS waiting, count(*) FILTER (WHERE ru) AS running FROM w GROUP BY ALL""")
def _(t):
    return R.catalog_board(catalog(t), loads(t))


@query("active_loads", f"WITH {_LD} SELECT id, wf_id, category, status, now - st AS status_age FROM ld WHERE alive = 'ACTIVE' AND status <> 'EVENT-WAIT'")
def _(t):
    return R.active_loads(loads(t), catalog(t), AT).select("id", "wf_id", "category", "status", "status_age")


@query("event_trace", f"""WITH {_LD}, r AS (SELECT * FROM ld WHERE alive <> 'ACTIVE' AND status_dttm >= TIMESTAMP '2024-01-09' AND status_dttm < TIMESTAMP '2024-01-10')
SELECT id, wf_id, name, 1::BIGINT AS nn, start_dttm::VARCHAR AS status_dttm, 'START' AS status, 'begin' AS log FROM r UNION ALL SELECT id, wf_id, name, 2, (start_dttm + INTERVAL 1 HOUR)::VARCHAR, raw_status, 'now' FROM r""")
def _(t):
    return R.event_trace(loads(t), catalog(t), AT).drop("alive")


def packages(t):
    """Package totals by load number."""
    return t.events.groupBy(F.floor(F.col("event_id") / 4).cast("bigint").alias("id")).agg(
        F.count("*").alias("keys_cnt"), F.sum("user_id").alias("cnt"), F.max("ts").alias("ts"), (F.max("user_id") % 4 != 0).alias("completed"), (F.min("user_id") % 5 == 0).alias("retry"),
        F.concat(F.lit("vw_"), (F.min("user_id") % 13).cast("string")).alias("wf_name"))


_PK = "pk AS (SELECT event_id // 4 AS id, count(*) AS keys_cnt, CAST(sum(user_id) AS BIGINT) AS cnt, max(ts) AS ts, max(user_id) % 4 <> 0 AS completed, min(user_id) % 5 = 0 AS retry, 'vw_' || (min(user_id) % 13) AS wf_name FROM events GROUP BY 1)"


def running_loads(t):
    """Loads whose first status entry says RUNNING."""
    return loads(t).withColumn("msg", F.regexp_replace("msg", '"START"', '"RUNNING"'))


@query("flow_last", f"""WITH {_LD}, {_PK}, x AS (SELECT * FROM ld WHERE category = 'c1' AND alive <> 'ACTIVE' AND status NOT IN ('EVENT-WAIT', 'TIME-WAIT', 'ABORTED') AND status_dttm >= TIMESTAMP '2024-01-03' AND status_dttm < TIMESTAMP '2024-01-11' QUALIFY row_number() OVER (PARTITION BY wf_id ORDER BY id DESC) = 1)
SELECT wf_id, id, status, 0.0::DOUBLE AS wait_s, st - epoch(start_dttm) AS run_s, keys_cnt, cnt, completed FROM x LEFT JOIN pk USING (id)""")
def _(t):
    return R.flow_last(running_loads(t), catalog(t), packages(t).drop("ts", "wf_name"), AT, "c1").select("wf_id", "id", "status", "wait_s", "run_s", "keys_cnt", "cnt", "completed")


@query("flow_errors", f"""WITH {_LD}, {_PK} SELECT wf_id, id, status, completed FROM ld LEFT JOIN pk USING (id) WHERE category = 'c1' AND alive <> 'ACTIVE' AND status_dttm >= TIMESTAMP '2024-01-03' AND status_dttm < TIMESTAMP '2024-01-11' AND (status <> 'SUCCESS' OR NOT completed)""")
def _(t):
    return R.flow_errors(running_loads(t), catalog(t), packages(t).drop("ts", "wf_name"), AT, "c1").select("wf_id", "id", "status", "completed")


@query("logged_last", f"WITH {_PK} SELECT wf_name, id, cnt, completed FROM pk WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-11' QUALIFY row_number() OVER (PARTITION BY wf_name ORDER BY ts DESC, id DESC) = 1")
def _(t):
    return R.logged_last(packages(t), AT).select("wf_name", "id", "cnt", "completed")


@query("logged_errors", f"WITH {_PK} SELECT wf_name, id, completed, retry FROM pk WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-11' AND (NOT completed OR retry)")
def _(t):
    return R.logged_errors(packages(t), AT).select("wf_name", "id", "completed", "retry")


def external(t):
    return control(t).select(F.col("wf").alias("workflow"), F.col("beg_action").alias("start_action"), "end_action", F.col("beg_ts").alias("start_ts"), F.col("beg_id").alias("start_id"), "end_id")


@query("external_last", f"WITH {_CL} SELECT wf AS workflow, end_action, beg_id AS start_id, end_id FROM cl QUALIFY row_number() OVER (PARTITION BY wf, end_action ORDER BY beg_ts DESC, beg_id DESC) = 1")
def _(t):
    return R.external_last(external(t)).select("workflow", "end_action", "start_id", "end_id")


@query("external_log", f"WITH {_CL} SELECT wf AS workflow, end_action, beg_id AS start_id FROM cl WHERE beg_ts >= d0 - INTERVAL 7 DAY AND beg_ts < d0 + INTERVAL 1 DAY")
def _(t):
    return R.external_log(external(t), AT).select("workflow", "end_action", "start_id")


@query("external_day_errors", f"""WITH {_LD} SELECT id, wf_id, status FROM ld WHERE category = 'c2' AND status = 'SUCCESS' AND (now - epoch(end_dttm) < 86400 OR (alive = 'COMPLETED' AND status_dttm > TIMESTAMP '2023-12-10 12:00:00'))""")
def _(t):
    # Finished loads stand in for failed ones, completed for open ones.
    l = loads(t).withColumn("status", F.when(F.col("status") == "SUCCESS", "ERROR").otherwise("x")).withColumn("alive", F.when(F.col("alive") == "COMPLETED", "ACTIVE").otherwise("x"))  # noqa: E741
    return R.external_day_errors(l, catalog(t), AT, "c2").select("id", "wf_id", F.lit("SUCCESS").alias("status"))


@query("external_yesterday", f"WITH {_LD} SELECT id, wf_id, status FROM ld WHERE category = 'c2' AND status_dttm >= TIMESTAMP '2024-01-09' AND status_dttm < TIMESTAMP '2024-01-10'")
def _(t):
    return R.external_yesterday(loads(t), catalog(t), AT, "c2").select("id", "wf_id", "status")


@query("ztest_errors", f"""WITH v AS (SELECT * FROM {I.GROWTH_SQL} WHERE ts > TIMESTAMP '2001-07-11 12:00:00' AND ts <= TIMESTAMP '2001-07-12 12:00:00' QUALIFY row_number() OVER (PARTITION BY object ORDER BY ts DESC, key_date DESC) = 1)
SELECT object, key_date::VARCHAR AS key_date, round(zscore, 4) AS zscore FROM v WHERE NOT ztest""")
def _(t):
    v = Q.ztest_view(I.growth_history(t), I.growth_config(t))
    return R.ztest_errors(v, "2001-07-12 12:00:00").select("object", "key_date", F.round("zscore", 4).alias("zscore"))


@query("engine_errors", "SELECT event_id AS log_id, 'f_' || event_type AS last_call FROM events WHERE ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-10' AND event_type <> 'view'")
def _(t):
    ctx = F.concat(F.lit("PL/pgSQL function "), F.lit("f_"), F.col("event_type"), F.lit("(text) line 7 at EXECUTE"))
    chains = J.error_call_chain(t.events.select(F.col("event_id").alias("log_id"), F.col("ts").alias("dt"), ctx.alias("context")))
    return R.engine_errors(chains, AT, "f_view").select("log_id", "last_call")


@query("freshness_grade", f"""SELECT event_id, CASE WHEN a > 172800 THEN 'salmon' WHEN a > 43200 THEN 'pink' WHEN a > 21600 THEN 'LemonChiffon' END AS grade,
  CASE WHEN value / 400 >= 0.75 THEN 'salmon' WHEN value / 400 >= 0.6 THEN 'orange' WHEN value / 400 >= 0.45 THEN 'gold' WHEN value / 400 >= 0.3 THEN 'yellow' WHEN value / 400 >= 0.15 THEN 'LemonChiffon' END AS rate_grade
FROM (SELECT *, (epoch_us(TIMESTAMP '{AT}') - epoch_us(ts)) / 1000000.0::DOUBLE AS a FROM events)""")
def _(t):
    return R.freshness_grade(t.events, "ts", AT).select("event_id", "grade", R.grade("rate", F.col("value") / 400).alias("rate_grade"))
