"""Telemetry queries."""

from pyspark.sql import functions as F

from tidewatch.operators import telemetry as T

from tidewatch.plans.registry import query

AT = "2024-01-10 12:00:00"
EV = ("error", "purchase")


def log(t):
    """Events as an incident log; signups are the starts."""
    u, k = F.col("user_id"), F.col("event_id")
    return t.events.select(
        F.col("ts").alias("dttm"), F.when(F.col("event_type") == "signup", T.STARTS).otherwise(F.col("event_type")).alias("event"),
        F.when(u % 9 != 0, F.concat(F.lit("d"), (u % 30).cast("string"))).alias("dag_id"), F.concat(F.lit("t"), (u % 7).cast("string")).alias("task_id"),
        F.floor(k / 50).cast("bigint").alias("run_id"), F.lit(-1).alias("map_index"), (k % 2).alias("try_number"))


_LOG = """lg AS (SELECT ts, CASE event_type WHEN 'signup' THEN 'running' ELSE event_type END AS event, CASE WHEN user_id % 9 <> 0 THEN 'd' || (user_id % 30) END AS dag_id, 't' || (user_id % 7) AS task_id, event_id // 50 AS run_id, event_id % 2 AS try_number FROM events),
f AS (SELECT *, (dag_id, task_id, run_id, try_number) AS att FROM lg WHERE event IN ('error', 'purchase') AND ts > TIMESTAMP '2024-01-06 12:00:00' AND ts <= TIMESTAMP '2024-01-10 12:00:00')"""


@query("delivery_failures", f"""WITH {_LOG}, s AS (SELECT count(*) AS runs FROM lg WHERE event = 'running' AND ts > TIMESTAMP '2024-01-06 12:00:00' AND ts <= TIMESTAMP '2024-01-10 12:00:00')
SELECT count(*) AS total, count(DISTINCT att) AS tasks, any_value(runs) AS runs, round(count(DISTINCT att) * 100.0::DOUBLE / nullif(any_value(runs), 0), 2) AS share_pct FROM f, s""")
def _(t):
    return T.delivery_failures(log(t), AT, 96, EV)


@query("failures_by_event", f"WITH {_LOG} SELECT event, count(*) AS cnt, count(DISTINCT att) AS tasks FROM f GROUP BY 1")
def _(t):
    return T.failures_by_event(log(t), AT, 96, EV)


@query("failures_by_task", f"""WITH {_LOG} SELECT coalesce(dag_id, '—') AS dag_id, task_id, count(*) AS cnt, count(DISTINCT event) AS kinds, count(DISTINCT (run_id, try_number)) AS tasks, (max(ts) + INTERVAL 3 HOUR)::VARCHAR AS last_seen
FROM f GROUP BY lg.dag_id, task_id ORDER BY cnt DESC, lg.dag_id NULLS FIRST, task_id LIMIT 20""".replace("lg.dag_id", "f.dag_id"))
def _(t):
    return T.failures_by_task(log(t), AT, 96, EV, 20)


@query("failures_by_day", f"WITH {_LOG} SELECT (ts + INTERVAL 3 HOUR)::DATE::VARCHAR AS day, count(*) AS cnt, count(DISTINCT att) AS tasks FROM f GROUP BY 1")
def _(t):
    return T.failures_by_day(log(t), AT, 4, EV)


@query("unknown_events", f"""SELECT 'x stuck ' || event_type AS event, count(*) AS cnt FROM events WHERE ts > TIMESTAMP '2024-01-06 12:00:00' AND ts <= TIMESTAMP '2024-01-10 12:00:00' AND event_type IN ('view', 'click') GROUP BY 1""")
def _(t):
    lg = log(t).withColumn("event", F.when(F.col("event").isin("view", "click"), F.concat(F.lit("x stuck "), F.col("event"))).otherwise(F.concat(F.lit("zombie "), F.col("event"))))
    return T.unknown_events(lg, AT, 96, ["nothing"], ["zombie error", "zombie purchase", f"zombie {T.STARTS}"])


@query("unknown_events_quiet", "SELECT 'x' AS event, 1::BIGINT AS cnt FROM events WHERE false")
def _(t):
    return T.unknown_events(log(t).withColumn("event", F.concat(F.lit("zombie "), F.col("event"))), AT, 96, ["zombie error"])


# --- runs from orders, tasks from lines, definitions from customers -----------------------------------
AS_OF = "2001-08-02 00:00:00"


def runs(t):
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("success")
    return t.orders.select(F.col("o_custkey").alias("dag_id"), k.alias("run_id"), state.alias("state"), F.when(k % 5 != 0, F.col("o_orderdate")).alias("queued_at"),
                           F.when(k % 4 != 0, F.expr("o_orderdate + interval 1 hour")).alias("start_date"), F.expr("o_orderdate - interval 1 day").alias("execution_date"),
                           F.when(k % 3 == 0, F.expr("o_orderdate + interval 2 hours")).alias("last_scheduling_decision"))


def tasks(t):
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    li = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("dag_id")), "l_orderkey")
    state = F.when(n == 1, "running").when(n == 2, "queued").when(n == 3, "scheduled").otherwise("success")
    ts = F.expr("l_shipdate + make_dt_interval(0, 0, 0, l_partkey % 86400)")
    return li.select("dag_id", F.col("l_orderkey").alias("run_id"), F.concat_ws("-", n, s, F.col("l_partkey")).alias("task_id"), state.alias("state"), ts.alias("queued_dttm"),
                     (ts + F.expr("interval 5 seconds")).alias("start_date"), F.when(n > 3, F.expr("l_shipdate + make_dt_interval(1, 0, 0, l_partkey % 86400)")).alias("end_date"), ts.alias("updated_at"), F.when(s % 3 != 0, s).alias("pid"), n.alias("n"))


def dags(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return t.customer.select(k.alias("dag_id"), (n < 8).alias("is_paused"), (n % 5 != 0).alias("is_active"), F.concat(F.lit("/f"), (k % 60).cast("string")).alias("fileloc"),
                             F.expr("timestamp'2001-08-01' + make_dt_interval(0, 0, c_custkey % 700)").alias("last_parsed_time"), (n % 3).alias("max_active_tasks"))


def errors(t):
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("/f"), (F.col("s_suppkey") % 40).cast("string")).alias("filename"), F.concat(F.lit(" e "), "s_name", F.lit(" ")).alias("stacktrace"))


_FR = f"""rn AS (SELECT o_custkey AS dag_id, o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'queued' ELSE 'success' END AS state, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS queued_at,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 1 HOUR END AS start_date, o_orderdate - INTERVAL 1 DAY AS execution_date, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 2 HOUR END AS lsd FROM orders),
ti AS (SELECT o_custkey AS dag_id, l_orderkey AS run_id, l_linenumber || '-' || l_suppkey || '-' || l_partkey AS task_id, CASE l_linenumber WHEN 1 THEN 'running' WHEN 2 THEN 'queued' WHEN 3 THEN 'scheduled' ELSE 'success' END AS state, l_shipdate + to_seconds(l_partkey % 86400) AS q,
  CASE WHEN l_linenumber > 3 THEN l_shipdate + INTERVAL 1 DAY + to_seconds(l_partkey % 86400) END AS end_date, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey END AS pid FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
dg AS (SELECT c_custkey AS dag_id, c_nationkey < 8 AS is_paused, c_nationkey % 5 <> 0 AS is_active, '/f' || (c_custkey % 60) AS fileloc, TIMESTAMP '2001-08-01' + to_minutes(c_custkey % 700) AS parsed, c_nationkey % 3 AS mx FROM customer)"""


@query("stuck_runs", f"""WITH {_FR}, a AS (SELECT run_id, max(end_date) AS le, count(*) FILTER (WHERE state = 'running') AS w FROM ti GROUP BY 1),
x AS (SELECT rn.*, w, CASE WHEN state = 'queued' THEN coalesce(queued_at, execution_date) ELSE coalesce(le, start_date, queued_at) END AS since FROM rn LEFT JOIN a USING (run_id) WHERE state IN ('queued', 'running'))
SELECT run_id, since::VARCHAR AS since,
  CASE WHEN state = 'running' AND coalesce(w, 0) > 0 THEN 'busy' WHEN coalesce((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(since)) / 1000000.0::DOUBLE, 0) / 3600 >= 24000 THEN 'close' ELSE 'young' END AS verdict FROM x""")
def _(t):
    return T.stuck_runs(runs(t), tasks(t), AS_OF, 24000).select("run_id", "since", "verdict")


@query("task_health", f"""WITH {_FR} SELECT count(*) FILTER (WHERE state = 'queued') AS queued, count(*) FILTER (WHERE state = 'queued' AND q < TIMESTAMP '2001-07-03') AS queued_stale, count(*) FILTER (WHERE state = 'running') AS running,
  count(*) FILTER (WHERE state = 'scheduled') AS scheduled, count(*) FILTER (WHERE state = 'scheduled' AND q < TIMESTAMP '2001-07-03') AS scheduled_stale, count(*) FILTER (WHERE state = 'running' AND pid IS NULL AND q + INTERVAL 5 SECOND < TIMESTAMP '2001-07-03') AS running_no_pid,
  max((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(q)) / 1000000.0::DOUBLE) FILTER (WHERE state = 'queued') AS oldest_queued_sec, count(*) FILTER (WHERE state = 'queued' AND q < TIMESTAMP '2001-04-24') AS queued_over_timeout FROM ti""")
def _(t):
    return T.task_health(tasks(t), AS_OF, 30 * 86400, 100 * 86400)


@query("parse_health", f"""WITH {_FR}, f AS (SELECT fileloc, epoch(TIMESTAMP '{AS_OF}' - max(parsed)) AS age FROM dg WHERE is_active GROUP BY 1)
SELECT count(*) AS files, max(age) AS oldest_sec, min(age) AS newest_sec, quantile_cont(age, 0.5) AS median_sec, (SELECT count(*) FROM supplier) AS import_errors FROM f""")
def _(t):
    return T.parse_health(dags(t), errors(t), AS_OF)


@query("stale_files", f"WITH {_FR} SELECT fileloc, epoch(TIMESTAMP '{AS_OF}' - max(parsed)) AS age FROM dg WHERE is_active GROUP BY 1 HAVING epoch(TIMESTAMP '{AS_OF}' - max(parsed)) > 3600")
def _(t):
    return T.stale_files(dags(t), AS_OF, 3600)


@query("not_serialized", f"WITH {_FR} SELECT dag_id FROM dg WHERE is_active AND dag_id NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 7 <> 0)")
def _(t):
    return T.not_serialized(dags(t), t.orders.filter("o_custkey % 7 <> 0").select(F.col("o_custkey").alias("dag_id")))


@query("new_errors", "SELECT s_suppkey AS id, '/f' || (s_suppkey % 40) AS filename FROM supplier WHERE s_suppkey > 5")
def _(t):
    return T.new_errors(errors(t), 5).select("id", "filename")


@query("run_health", f"""WITH {_FR} SELECT count(*) FILTER (WHERE state = 'queued' AND coalesce(queued_at, execution_date) < TIMESTAMP '2001-07-03') AS queued_stale, count(*) FILTER (WHERE is_paused) AS paused_active, count(*) FILTER (WHERE NOT is_active) AS inactive_active
FROM rn JOIN dg USING (dag_id) WHERE state IN ('queued', 'running')""")
def _(t):
    return T.run_health(runs(t), dags(t), AS_OF, 30 * 86400)


@query("paused_runs", f"""WITH {_FR} SELECT dag_id, run_id, CAST(epoch(TIMESTAMP '{AS_OF}' - CASE WHEN state = 'running' AND start_date IS NOT NULL THEN start_date ELSE coalesce(queued_at, execution_date) END) AS BIGINT) AS age_sec FROM rn JOIN dg USING (dag_id)
WHERE is_paused AND state IN ('queued', 'running') ORDER BY age_sec DESC, dag_id, run_id LIMIT 20""")
def _(t):
    return T.paused_runs(runs(t), dags(t), AS_OF, 20).select("dag_id", "run_id", "age_sec")


@query("scheduled_waits", f"""WITH {_FR}, x AS (SELECT ti.*, rn.run_id IS NOT NULL AS live FROM ti LEFT JOIN (SELECT run_id FROM rn WHERE state = 'running') rn USING (run_id)),
g AS (SELECT dag_id, count(*) FILTER (WHERE state = 'scheduled' AND q < TIMESTAMP '2001-07-03' AND live) AS scheduled, min(q) FILTER (WHERE state = 'scheduled' AND q < TIMESTAMP '2001-07-03' AND live) AS since,
  count(*) FILTER (WHERE state IN ('queued', 'running')) AS active, count(*) FILTER (WHERE live AND end_date > TIMESTAMP '2000-08-02') AS recent FROM x GROUP BY 1)
SELECT dag_id, scheduled, active, recent, mx::BIGINT AS max_active_tasks, CAST(epoch(TIMESTAMP '{AS_OF}' - since) AS BIGINT) AS oldest_sec FROM g JOIN dg USING (dag_id) WHERE scheduled > 0 AND NOT is_paused""")
def _(t):
    return T.scheduled_waits(tasks(t), runs(t), dags(t), AS_OF, 30 * 86400, 365 * 86400)


@query("frozen_runs", f"""WITH {_FR}, e AS (SELECT '/f' || (s_suppkey % 40) AS fileloc, 'e ' || arg_max(s_name, s_suppkey) AS error FROM supplier GROUP BY 1)
SELECT dag_id, run_id, CAST(epoch(TIMESTAMP '{AS_OF}' - coalesce(lsd, start_date, queued_at, execution_date)) AS BIGINT) AS frozen_sec, error FROM rn JOIN dg USING (dag_id) LEFT JOIN e USING (fileloc)
WHERE NOT is_active AND state IN ('queued', 'running') ORDER BY frozen_sec DESC, dag_id, run_id LIMIT 25""")
def _(t):
    return T.frozen_runs(runs(t), dags(t), errors(t), AS_OF, 25).select("dag_id", "run_id", "frozen_sec", "error")


@query("dag_size", f"""WITH {_FR}, l AS (SELECT dag_id, run_id FROM rn QUALIFY row_number() OVER (PARTITION BY dag_id ORDER BY execution_date DESC, run_id DESC) = 1), m AS (SELECT dag_id, count(*) AS n FROM ti JOIN l USING (dag_id, run_id) GROUP BY 1),
x AS (SELECT dg.dag_id, is_paused, CASE WHEN dag_id % 3 <> 0 THEN dag_id % 400 END AS tasks, coalesce(n, 0) AS max_ti FROM dg LEFT JOIN m USING (dag_id) WHERE is_active), y AS (SELECT *, greatest(coalesce(tasks, 0), max_ti) AS size FROM x)
SELECT dag_id, tasks, max_ti, size, CASE WHEN size = 0 THEN 'unknown' WHEN size <= 1 THEN '1' WHEN size <= 3 THEN '2–3' WHEN size <= 10 THEN '4–10' WHEN size <= 30 THEN '11–30' WHEN size <= 100 THEN '31–100' WHEN size <= 300 THEN '101–300' ELSE '>300' END AS class, size > 300 AS alert FROM y""")
def _(t):
    d = t.customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("dag_id"), (F.col("c_custkey") % 400).alias("tasks"))
    return T.dag_size(dags(t), d, runs(t), tasks(t), [1, 3, 10, 30, 100, 300]).drop("is_paused")


@query("change_activity", f"""WITH u AS (SELECT o_custkey AS k, max(o_orderdate) AS lu, min(o_orderdate) + INTERVAL 1200 DAY AS lp FROM orders GROUP BY 1), a AS (SELECT *, TIMESTAMP '{AS_OF}' AS n FROM u)
SELECT count(*) AS dags, count(*) FILTER (WHERE lu > n - INTERVAL 1 YEAR) AS year, count(*) FILTER (WHERE lu > n - INTERVAL 3 MONTH) AS quarter, count(*) FILTER (WHERE lu > n - INTERVAL 1 MONTH) AS month, count(*) FILTER (WHERE lu > n - INTERVAL 7 DAY) AS week, count(*) FILTER (WHERE lu > n - INTERVAL 1 DAY) AS day,
  count(*) FILTER (WHERE lu > n - INTERVAL 1 HOUR) AS hour, count(*) FILTER (WHERE lu >= lp - INTERVAL 1 DAY) AS at_parse FROM a""")
def _(t):
    s = t.orders.groupBy(F.col("o_custkey").alias("dag_id")).agg(F.max("o_orderdate").alias("last_updated"), F.expr("min(o_orderdate) + interval 1200 days").alias("last_parsed_time"))
    return T.change_activity(s, AS_OF, 86400)


def activity(t):
    """Events as database sessions; a session may wait for the one before it."""
    k, u, v = F.col("event_id"), F.col("user_id"), F.col("value").cast("int")
    state = F.when(F.col("event_type") == "error", "idle in transaction").when(F.col("event_type") == "view", "active").otherwise("idle")
    return t.events.select(k.alias("pid"), F.concat(F.lit("app-x_"), u.cast("string")).alias("application_name"), state.alias("state"), v.alias("tx_age"), v.alias("query_age"), v.alias("state_age"),
                           F.when(k % 10 == 3, F.array(k - 1, k - 2)).alias("blocking_pids"))


_SESS = """ac AS (SELECT event_id AS pid, user_id, event_type AS et, CAST(trunc(value) AS INT) AS v, event_id % 10 = 3 AS b FROM events),
fi AS (SELECT pid, 'idle in transaction' AS kind FROM ac WHERE et = 'error' AND v >= 60 UNION ALL SELECT pid, 'long query' FROM ac WHERE et = 'view' AND v >= 80 UNION ALL SELECT pid, 'blocked' FROM ac WHERE b AND v >= 20
  UNION ALL SELECT DISTINCT pid - d, 'blocker' FROM ac CROSS JOIN (VALUES (1), (2)) x(d) WHERE b AND v >= 20)"""


@query("session_findings", f"WITH {_SESS} SELECT * FROM fi")
def _(t):
    return T.session_findings(activity(t), 60, 80, 20)


def owners(t):
    """Suppliers as task processes with a job each."""
    s = F.col("s_suppkey")
    tk = t.supplier.select(s.alias("pid"), F.concat(F.lit("k"), s.cast("string")).alias("task_key"), F.when(s % 3 == 0, "running").otherwise("failed").alias("state"), (s + 1000).alias("job_id"))
    jb = t.supplier.filter("s_suppkey % 4 <> 1").select((s + 1000).alias("job_id"), F.lit("LocalTaskJob").alias("job_type"), F.lit("running").alias("state"), F.expr("timestamp'2024-01-10 12:00:00' - make_dt_interval(0, cast(s_suppkey % 12 as int))").alias("latest_heartbeat"))
    return tk, jb


@query("session_owners", "SELECT s_suppkey AS pid FROM supplier WHERE s_suppkey % 3 = 0 OR (s_suppkey % 4 <> 1 AND s_suppkey % 12 < 6)")
def _(t):
    return T.session_owners(*owners(t), AT).select("pid")


@query("session_summary", f"""WITH {_SESS}, ow AS (SELECT s_suppkey AS p, s_suppkey % 3 = 0 AND s_suppkey % 4 <> 1 AND s_suppkey % 12 * 3600 <= 9000 AS alive FROM supplier WHERE s_suppkey % 3 = 0 OR (s_suppkey % 4 <> 1 AND s_suppkey % 12 < 6))
SELECT kind, count(*) AS cnt, count(*) FILTER (WHERE NOT coalesce(alive, false)) AS orphans FROM fi JOIN ac USING (pid) LEFT JOIN ow ON p = user_id GROUP BY 1""")
def _(t):
    a = activity(t)
    return T.session_summary(T.sessions_with_owner(T.session_findings(a, 60, 80, 20), a, T.session_owners(*owners(t), AT), AT, 9000))


@query("queue_classify", f"""WITH m AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem), x AS (SELECT m.*, o_orderstatus AS st, o_orderkey IS NOT NULL AS known, o_custkey FROM m LEFT JOIN orders ON o_orderkey = k AND o_orderkey % 7 <> 0 AND p % 11 <> 0)
SELECT s % 2 = 0 AND known AS id_mismatch, p % 11 = 0 OR (known AND st <> 'F') AS live, CASE WHEN p % 11 = 0 THEN 'unreadable' WHEN NOT known THEN 'no such task' WHEN st = 'F' THEN 'already success' WHEN st = 'O' THEN 'task queued' ELSE 'task without state' END AS reason, count(*) AS cnt FROM x GROUP BY ALL""")
def _(t):
    st = F.col("o_orderstatus")
    m = t.lineitem.select(F.when(F.col("l_partkey") % 11 != 0, F.col("l_orderkey")).alias("task_key"), F.when(F.col("l_suppkey") % 2 == 0, "a").otherwise("b").alias("msg_id"))
    s = t.orders.filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("task_key"), F.when(st == "F", "success").when(st == "O", "queued").alias("state"), F.lit("b").alias("executor_id"))
    return T.queue_classify(m, s).groupBy("live", "reason", "id_mismatch").agg(F.count("*").alias("cnt"))


@query("queue_summary", f"""WITH x AS (SELECT l_suppkey AS s, o_orderstatus AS st, o_orderkey IS NOT NULL AS known FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 7 <> 0)
SELECT known AND st <> 'F' AS live, CASE WHEN NOT known THEN 'no such task' WHEN st = 'F' THEN 'already success' WHEN st = 'O' THEN 'task queued' ELSE 'task without state' END AS reason, count(*) AS cnt, count(*) FILTER (WHERE s % 2 = 0 AND known) AS id_mismatch FROM x GROUP BY ALL""")
def _(t):
    st = F.col("o_orderstatus")
    m = t.lineitem.select(F.col("l_orderkey").alias("task_key"), F.when(F.col("l_suppkey") % 2 == 0, "a").otherwise("b").alias("msg_id"))
    s = t.orders.filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("task_key"), F.when(st == "F", "success").when(st == "O", "queued").alias("state"), F.lit("b").alias("executor_id"))
    return T.queue_summary(T.queue_classify(m, s))


def _waiting(t):
    p = F.col("l_partkey")
    w = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.max("l_shipdate").alias("at")).select(
        (F.col("l_orderkey") % 50).alias("dag_id"), F.col("l_linenumber").alias("task_id"), F.col("l_orderkey").alias("run_id"), F.concat(F.lit("p"), (p % 4).cast("string")).alias("pool"), (p % 9).alias("priority_weight"),
        F.col("at").alias("updated_at"), (p % 13 == 0).alias("is_paused"), F.when(p % 7 == 0, "queued").otherwise("running").alias("run_state"), F.when(F.col("l_orderkey") % 50 < 10, 3).alias("max_active_tasks"), F.col("at").alias("logical_date"))
    active = t.nation.select(F.col("n_nationkey").cast("bigint").alias("dag_id"), F.col("n_regionkey").alias("active"))
    pools = t.region.select(F.concat(F.lit("p"), F.col("r_regionkey").cast("string")).alias("pool"), F.lit(2).alias("slots"), F.col("r_regionkey").alias("used"))
    return w, active, pools, t.part.select((F.col("p_size") % 12).alias("weight"))


_WC = """w AS (SELECT l_orderkey % 50 AS dag_id, l_linenumber::BIGINT AS task_id, l_orderkey AS run_id, min(l_partkey) AS p, max(l_shipdate) AS at1 FROM lineitem GROUP BY l_orderkey, l_linenumber),
lv AS (SELECT w.*, 'p' || (p % 4) AS pool, p % 9 AS pw, dag_id < 10 AND coalesce(n_regionkey, 0) >= 3 AS full1 FROM w LEFT JOIN nation ON n_nationkey = dag_id WHERE p % 13 <> 0 AND p % 7 <> 0),
hd AS (SELECT * FROM lv ORDER BY pw DESC, at1, dag_id, task_id, run_id LIMIT 60), md AS (SELECT quantile_cont(p_size % 12, 0.5) AS m FROM part),
cs AS (SELECT lv.dag_id, lv.task_id, lv.run_id, CAST(epoch(TIMESTAMP '2001-08-02' - lv.at1) // 60 AS BIGINT) AS wait_min, CASE WHEN lv.full1 THEN 'dag limit' WHEN lv.p % 4 >= 2 THEN 'pool ' || lv.pool WHEN hd.run_id IS NULL AND (SELECT count(*) FROM hd WHERE full1) > 0 THEN 'window'
  WHEN lv.pw < m THEN 'priority' ELSE 'other' END AS cause FROM lv CROSS JOIN md LEFT JOIN hd ON hd.task_id = lv.task_id AND hd.run_id = lv.run_id WHERE lv.at1 < TIMESTAMP '2001-08-02' - INTERVAL 30 MINUTE)"""


@query("wait_causes", f"WITH {_WC} SELECT * FROM cs")
def _(t):
    return T.wait_causes(*_waiting(t), AS_OF, 30, 60).select("dag_id", "task_id", "run_id", "wait_min", "cause")


@query("wait_board", f"WITH {_WC} SELECT dag_id, cause, count(*) AS stale, max(wait_min) AS oldest_min FROM cs GROUP BY ALL")
def _(t):
    return T.wait_board(T.wait_causes(*_waiting(t), AS_OF, 30, 60))


@query("queue_board", f"""WITH {_WC}, b AS (SELECT dag_id, count(*) AS blocked FROM hd WHERE full1 GROUP BY 1)
SELECT lv.dag_id, count(*) AS waiting, count(*) FILTER (WHERE at1 < TIMESTAMP '2001-08-02' - INTERVAL 30 MINUTE) AS stale, coalesce(max(CAST(epoch(TIMESTAMP '2001-08-02' - at1) // 60 AS BIGINT)) FILTER (WHERE at1 < TIMESTAMP '2001-08-02' - INTERVAL 30 MINUTE), 0) AS oldest_min,
  max(coalesce(n_regionkey, 0))::BIGINT AS active, max(CASE WHEN lv.dag_id < 10 THEN 3 END)::BIGINT AS max_active_tasks, min(pw) AS weight_low, max(pw) AS weight_high, coalesce(max(blocked), 0) AS blocked
FROM lv LEFT JOIN nation ON n_nationkey = lv.dag_id LEFT JOIN b USING (dag_id) GROUP BY lv.dag_id""")
def _(t):
    w, active, _, _ = _waiting(t)
    return T.queue_board(w, active, AS_OF, 30, 60)


@query("queue_totals", f"""WITH {_WC} SELECT count(*) AS live, (SELECT count(*) FROM w) - count(*) AS parked, count(*) FILTER (WHERE at1 < TIMESTAMP '2001-08-02' - INTERVAL 30 MINUTE) AS stale, (SELECT count(*) FROM part) AS dispatched,
  (SELECT m FROM md) AS median_dispatched, 60::BIGINT AS window, (SELECT count(*) FROM hd WHERE full1) AS blocked, greatest(count(*) - 60, 0) AS behind FROM lv""")
def _(t):
    w, active, _, sent = _waiting(t)
    return T.queue_totals(w, active, sent, AS_OF, 30, 60)


@query("retention_select", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'")
def _(t):
    return T.retention_select(t.orders, "o_orderdate", "1997-01-01").select("o_orderkey")


@query("retention_children", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')")
def _(t):
    p = t.orders.withColumnRenamed("o_orderkey", "l_orderkey")
    return T.retention_children(t.lineitem, p, ["l_orderkey"], "o_orderdate", "1997-01-01").select("l_orderkey", "l_linenumber", "l_partkey")


@query("retention_orphans", """WITH p AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM p)
  AND l_partkey < (SELECT min(l_partkey) FROM lineitem JOIN p ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '2001-06-01' AND o_custkey % 5 = 0)""")
def _(t):
    old = F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderdate")).otherwise(F.lit("1990-01-01").cast("timestamp"))
    p = t.orders.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), old.alias("o_orderdate"))
    return T.retention_orphans(t.lineitem, p, ["l_orderkey"], "l_partkey", "o_orderdate", "2001-06-01").select("l_orderkey", "l_partkey")


@query("duplicate_groups", "SELECT p_name AS definition, p_partkey AS name, count(*) OVER (PARTITION BY p_name, p_brand, p_size % 5) AS copies, min(p_partkey) OVER (PARTITION BY p_name, p_brand, p_size % 5) AS keep FROM part QUALIFY copies > 1")
def _(t):
    c = t.part.select(F.concat_ws("|", "p_name", "p_brand", F.col("p_size") % 5).alias("definition"), F.col("p_partkey").alias("name"))
    return T.duplicate_groups(c, "definition", "name").withColumn("definition", F.substring_index("definition", "|", 1))


@query("codes_without_parent", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 5 <> 0)")
def _(t):
    return T.codes_without_parent(t.customer, t.orders.filter("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("health_rollup", """WITH c AS (SELECT p_brand, p_partkey, CASE WHEN p_size % 17 = 0 THEN 4 WHEN p_size % 5 = 0 THEN 3 WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS r FROM part), w AS (SELECT p_brand, max(r) AS r, count(*) AS checks FROM c GROUP BY 1)
SELECT w.p_brand AS node, ['healthy', 'skip', 'warn', 'error'][w.r] AS status, any_value(checks) AS checks, count(*) AS affected, min(p_partkey) AS first_name FROM w JOIN c USING (p_brand, r) GROUP BY w.p_brand, w.r""")
def _(t):
    s = F.col("p_size")
    c = t.part.select(F.col("p_brand").alias("node"), F.col("p_partkey").alias("name"), F.when(s % 17 == 0, "error").when(s % 5 == 0, "warn").when(s % 3 == 0, "skip").otherwise("healthy").alias("status"))
    return T.health_rollup(c, "node")


@query("failing_checks", """WITH c AS (SELECT p_brand, p_partkey, CASE WHEN p_size % 17 = 0 THEN 4 WHEN p_size % 5 = 0 THEN 3 WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS r FROM part), w AS (SELECT p_brand, max(r) AS r FROM c GROUP BY 1)
SELECT p_brand AS node, ['healthy', 'skip', 'warn', 'error'][r] AS status, p_partkey AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth FROM w JOIN c USING (p_brand, r) WHERE r > 1""")
def _(t):
    s = F.col("p_size")
    c = t.part.select(F.col("p_brand").alias("node"), F.col("p_partkey").alias("name"), F.when(s % 17 == 0, "error").when(s % 5 == 0, "warn").when(s % 3 == 0, "skip").otherwise("healthy").alias("status"))
    return T.failing_checks(c, "node")


@query("folder_sweep", """WITH l AS (SELECT source AS folder, lang AS type, n_chars AS size, TIMESTAMP '2024-01-01' - to_days(CAST(doc_id % 60 AS INT)) AS m FROM documents), g AS (SELECT folder, type, count(*) AS n FROM l GROUP BY ALL)
SELECT folder, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, min(m)::VARCHAR AS oldest, max(m)::VARCHAR AS newest, (SELECT '{' || string_agg('"' || type || '":' || n, ',' ORDER BY type) || '}' FROM g WHERE g.folder = l.folder) AS types,
  count(*) FILTER (WHERE m < TIMESTAMP '2023-12-02') AS old_objects, CAST(coalesce(sum(size) FILTER (WHERE m < TIMESTAMP '2023-12-02'), 0) AS BIGINT) AS old_bytes FROM l GROUP BY folder""")
def _(t):
    l = t.documents.select(F.concat(F.col("source"), F.lit("/x/"), F.col("doc_id").cast("string"), F.lit("."), F.upper("lang")).alias("key"), F.col("n_chars").alias("size"),  # noqa: E741
                           F.expr("timestamp'2024-01-01' - make_dt_interval(cast(doc_id % 60 as int))").alias("last_modified"))
    return T.folder_sweep(l, "2024-01-01", 30)


@query("broker_deltas", """WITH c AS (SELECT user_id AS node, max(ts) AS at1, max(event_id) AS a, CAST(max(user_id) % 5 * 86400 AS BIGINT) AS up FROM events WHERE event_type <> 'view' GROUP BY 1), p AS (SELECT user_id AS node, min(ts) AS at0, min(event_id) AS a0 FROM events WHERE user_id % 7 <> 0 GROUP BY 1)
SELECT node, CAST(round((epoch_us(at1) - epoch_us(at0)) / 1000000.0::DOUBLE) AS BIGINT) AS delta_sec, CASE WHEN up * 4 >= (epoch_us(at1) - epoch_us(at0)) / 1000000.0::DOUBLE THEN a - a0 END AS evicted_delta FROM c LEFT JOIN p USING (node)""")
def _(t):
    cur = t.events.filter("event_type <> 'view'").groupBy(F.col("user_id").alias("node")).agg(F.max("ts").alias("at"), F.max("event_id").alias("evicted"), (F.max("user_id") % 5 * 86400 * 4).alias("uptime_s"))
    prev = t.events.filter("user_id % 7 <> 0").groupBy(F.col("user_id").alias("node")).agg(F.min("ts").alias("at"), F.min("event_id").alias("evicted"))
    return T.broker_deltas(prev, cur, ["evicted"])


@query("start_delays", f"""WITH {_FR}, x AS (SELECT *, lag(end_date) OVER (PARTITION BY dag_id, run_id ORDER BY q, task_id) AS pe FROM ti)
SELECT run_id, task_id, (epoch_us(q) - epoch_us(pe)) / 1000000.0::DOUBLE AS scheduler_s, 5.0::DOUBLE AS queue_s FROM x""")
def _(t):
    return T.start_delays(tasks(t)).select("run_id", "task_id", "scheduler_s", "queue_s")
