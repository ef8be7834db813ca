"""Control decision queries."""

from pyspark.sql import functions as F


from tidewatch.operators import control as C
from tidewatch.operators import journal as J
from tidewatch.plans import inputs as I
from tidewatch.plans.registry import query

AS_OF = I.ORDERS_AS_OF


def last_stat(t):
    """Last publication per (profile, entity, statistic): orders of a customer by status."""
    return t.orders.groupBy(F.col("o_orderstatus").alias("profile"), F.col("o_custkey").alias("entity_id"), (F.col("o_custkey") % 3).alias("stat_id")).agg(
        F.max(F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)")).alias("published"), F.max_by("o_orderkey", "o_orderkey").alias("loading_id"))


_STAT = "ls AS (SELECT o_orderstatus AS profile, o_custkey AS entity_id, max(o_orderdate + to_seconds(o_orderkey % 86400)) AS published, max(o_orderkey) AS loading_id FROM orders GROUP BY ALL)"
_NOW = "2001-07-25 06:00:00"


def waits(t):
    """Customers as waiting loads with an event per order status; some events are off, some lists empty."""
    k = F.col("c_custkey")
    ev = lambda p, a: F.struct(F.lit(p).alias("profile"), k.alias("entity_id"), (k % 3).alias("stat_id"), a.alias("active"))
    events = F.array(ev("O", k % 4 != 0), ev("F", F.lit(None).cast("boolean")), ev("P", k % 5 != 0))
    return t.customer.select(
        k.alias("load_id"), F.when(k % 2 == 0, "and").alias("strategy"), F.expr("timestamp'2001-03-01' + make_dt_interval(c_custkey % 100)").alias("start_ts"),
        F.when(k % 11 == 0, F.array().cast("array<struct<profile:string,entity_id:bigint,stat_id:bigint,active:boolean>>")).otherwise(events).alias("events"),
        F.when(k % 7 != 0, F.expr("timestamp'2000-06-01' + make_dt_interval(c_custkey % 100)")).alias("expire_at"), F.when(k % 3 == 0, "MANUAL").otherwise("EVENT-WAIT").alias("run_type"))


_WAITS = f"""{_STAT}, w AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS an, TIMESTAMP '2001-03-01' + to_days(CAST(c_custkey % 100 AS INT)) AS st, TIMESTAMP '2000-06-01' + to_days(CAST(c_custkey % 100 AS INT)) AS ex FROM customer),
e AS (SELECT w.*, x.pos, x.p, CASE x.p WHEN 'O' THEN k % 4 <> 0 WHEN 'P' THEN k % 5 <> 0 ELSE true END AS act, ls.published AS pub FROM w CROSS JOIN (VALUES (1, 'O'), (2, 'F'), (3, 'P')) x(pos, p)
  LEFT JOIN ls ON ls.profile = x.p AND ls.entity_id = k WHERE k % 11 <> 0)"""


@query("event_ready", f"""WITH {_WAITS}, o AS (SELECT *, CASE WHEN NOT act THEN NULL WHEN pub > TIMESTAMP '{_NOW}' - INTERVAL 30 MINUTE THEN 'wait' WHEN an AND (pub IS NULL OR pub < st) THEN 'wait' WHEN NOT an AND pub >= st THEN 'ready' END AS oc FROM e)
SELECT k AS load_id, coalesce((SELECT oc FROM o WHERE o.k = w.k AND oc IS NOT NULL ORDER BY pos LIMIT 1), CASE WHEN an AND k % 11 <> 0 THEN 'ready' ELSE 'wait' END) AS decision FROM w""")
def _(t):
    return C.event_ready(waits(t), last_stat(t), _NOW)


@query("event_expire", f"""WITH {_WAITS}, g AS (SELECT k, bool_or(act AND (pub IS NULL OR pub < ex)) AS late, bool_or(act AND pub >= ex) AS rdy FROM e GROUP BY k),
r AS (SELECT w.k, CASE WHEN NOT (an AND k % 7 <> 0 AND k % 3 <> 0) THEN 'ok' WHEN late AND rdy THEN 'EVENT-WAIT' WHEN late THEN 'ERROR' ELSE 'ok' END AS status FROM w LEFT JOIN g USING (k))
SELECT k AS load_id, status, CAST(CASE WHEN status = 'ERROR' THEN -99 END AS BIGINT) AS res FROM r""")
def _(t):
    return C.event_expire(waits(t), last_stat(t))


def condition_nodes(t):
    """Order = tree: root, an inner node per line status, lines as leaves."""
    li = t.lineitem.groupBy(F.col("l_orderkey").alias("loading"), "l_linenumber", "l_linestatus").agg(
        F.max("l_shipdate").alias("at"), F.min("l_suppkey").alias("s"))
    none = F.lit(None)
    leaf = li.select(
        "loading", F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("node"), F.col("l_linestatus").alias("parent"), F.lit(2).alias("depth"),
        F.when(F.col("s") % 6 == 0, "cronExpression").otherwise("statVal").alias("type"), (F.col("s") % 3 != 0).alias("satisfied"), F.col("at").alias("satisfied_at"),
        F.when(F.col("s") % 5 == 0, F.unix_timestamp("at") * F.when(F.col("s") % 2 == 0, 1000).otherwise(1)).alias("valid_till"), F.expr("at + interval 1 day").alias("next_at"))
    inner = li.select("loading", F.col("l_linestatus").alias("node")).distinct().select(
        "loading", "node", F.lit("root").alias("parent"), F.lit(1).alias("depth"), F.when(F.col("node") == "O", "or").otherwise("and").alias("type"),
        none.cast("boolean").alias("satisfied"), none.cast("timestamp").alias("satisfied_at"), none.cast("bigint").alias("valid_till"), none.cast("timestamp").alias("next_at"))
    root = inner.select("loading").distinct().select(
        "loading", F.lit("root").alias("node"), none.cast("string").alias("parent"), F.lit(0).alias("depth"), F.when(F.col("loading") % 2 == 0, "or").otherwise("and").alias("type"),
        none.cast("boolean").alias("satisfied"), none.cast("timestamp").alias("satisfied_at"), none.cast("bigint").alias("valid_till"), none.cast("timestamp").alias("next_at"))
    return leaf.unionByName(inner).unionByName(root)


@query("condition_ready", """WITH li AS (SELECT l_orderkey AS k, l_linenumber, l_linestatus AS st, max(l_shipdate) AS at1, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
lf AS (SELECT k, st, CASE WHEN s % 3 <> 0 THEN CASE WHEN s % 5 = 0 AND at1 < TIMESTAMP '2001-08-02' THEN NULL ELSE at1 END WHEN s % 6 = 0 THEN at1 + INTERVAL 1 DAY END AS at2 FROM li),
nd AS (SELECT k, st, CASE WHEN st = 'O' THEN lo WHEN c = n THEN hi END AS at3 FROM (SELECT k, st, min(at2) AS lo, max(at2) AS hi, count(at2) AS c, count(*) AS n FROM lf GROUP BY k, st))
SELECT k AS loading, (CASE WHEN k % 2 = 0 THEN lo WHEN c = n THEN hi END)::VARCHAR AS ready_at FROM (SELECT k, min(at3) AS lo, max(at3) AS hi, count(at3) AS c, count(*) AS n FROM nd GROUP BY k)""")
def _(t):
    return C.condition_ready(condition_nodes(t), AS_OF)


def _wait_log():
    k = F.col("o_orderkey")
    at = I.sec(F.col("o_orderdate"))
    return (F.when(k % 5 == 0, F.concat(F.lit("{'time': '"), at, F.lit("', 'retry': {'try': 2, 'left': 3, 'delay': 'hours=+1'}}"))).when(k % 5 == 1, F.concat(F.lit("Start scheduled on "), at))
            .when(k % 5 == 2, F.lit("waiting")))


@query("wait_until", """SELECT o_orderkey, (CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate WHEN o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL 2 DAY WHEN o_orderkey % 5 = 1 THEN o_orderdate
  WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 9 DAY END)::VARCHAR AS at FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    cond = F.when(k % 7 == 0, F.expr("o_orderdate + interval 2 days"))
    at = C.wait_until(_wait_log(), cond, (k % 3 == 0) | (k % 7 == 0), F.expr("o_orderdate + interval 9 days"))
    return t.orders.select("o_orderkey", at.alias("at"))


@query("ready_to_start", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN 'ok' WHEN o_orderkey % 5 > 1 THEN 'fail' WHEN o_orderdate <= TIMESTAMP '1999-01-01' THEN 'ok' ELSE 'skip' END AS decision, o_orderstatus <> 'P' AS is_new,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 AND o_orderdate <= TIMESTAMP '1999-01-01' THEN 3::BIGINT END AS try, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 AND o_orderdate <= TIMESTAMP '1999-01-01' THEN 2::BIGINT END AS left FROM orders""".replace("AS left", 'AS "left"').replace("AS try", 'AS "try"'))
def _(t):
    loads = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "TIME-WAIT").otherwise("RUNNING").alias("status"), _wait_log().alias("log"))
    return C.ready_to_start(loads, "1999-01-01").select("id", "decision", "is_new", "try", "left")


def retry_inputs(t):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    return t.orders.select(
        k.alias("id"), (k % 5 - 2).cast("int").alias("res"), F.when(k % 10 == 0, '{"try": 1, "left": 5, "delay": "minutes=+5"}').alias("explicit"),
        F.when(k % 10 == 1, "{'try': 2, 'left': 4, 'delay': 'hours=+1', 'add': 'minutes=+30', 'on': ['no', '-1']}").when(k % 10 == 0, "{'try': 9}").alias("wfp_retry"),
        F.when(k % 10 == 2, "RUN {'retry': {'try': 3, 'left': 2, 'add': '10 minutes'}} end").alias("log"),
        F.when(k % 10 == 3, "3").when(k % 10 == 4, "").alias("wf_retry_cnt"), F.when(k % 10 == 3, "00:20:00").alias("wf_retry_delay"), none.alias("wf_retry_add"),
        F.when(k % 10 == 3, " Error, no ,").alias("wf_retry_on"), F.when(k % 10 == 4, 4).cast("int").alias("num_attempts"), F.when(k % 10 == 4, 90500).alias("retry_delay_ms"), (k % 4 == 0).alias("abort_on_failure"))


_RETRY = """rt AS (SELECT o_orderkey AS id, o_orderkey % 4 = 0 AS ab, CAST(o_orderkey % 5 - 2 AS BIGINT) AS res, v.* FROM orders LEFT JOIN (VALUES (0, 'explicit', 1, 5, 300, 0, ['error']), (1, 'params', 2, 4, 3600, 1800, ['no', '-1']), (2, 'log', 3, 2, 0, 600, ['error']),
  (3, 'wf_retry', 1, 2, 1200, 0, ['error', 'no']), (4, 'faultTolerance', 1, 3, 90, 0, ['error'])) v(m, source, tr, lf, dl, ad, onn) ON o_orderkey % 10 = m)"""


@query("retry_config", f'WITH {_RETRY} SELECT id, source, CAST(tr AS BIGINT) AS "try", CAST(lf AS BIGINT) AS "left" FROM rt')
def _(t):
    return C.retry_config(retry_inputs(t)).select("id", "source", F.col("retry")["try"].alias("try"), F.col("retry")["left"].alias("left"))


@query("retry_schedule", f"""WITH {_RETRY}, k AS (SELECT *, CASE WHEN res > 0 THEN 'ok' WHEN res = 0 THEN 'no' ELSE 'error' END AS kind FROM rt),
a AS (SELECT *, coalesce(lf, 0) > 0 AND (list_contains(coalesce(onn, ['error']), kind) OR list_contains(coalesce(onn, ['error']), res::VARCHAR)) AS again FROM k)
SELECT id, kind, CASE WHEN again THEN 'TIME-WAIT' WHEN res >= 0 THEN 'SUCCESS' ELSE 'ERROR' END AS status, CASE WHEN again THEN 'retry' WHEN res >= 0 OR NOT ab THEN 'Completed' ELSE 'Aborted' END AS action,
  CASE WHEN again THEN (TIMESTAMP '2001-08-02' + to_seconds(dl + (tr - 1) * ad))::VARCHAR END AS next_at FROM a""")
def _(t):
    r = C.retry_config(retry_inputs(t)).withColumn("ok", F.lit(0)).withColumn("no", F.lit(0)).withColumn("err", F.lit(1))
    return C.retry_schedule(r, AS_OF).select("id", "kind", "status", "action", "next_at")


@query("shift_time", """SELECT o_orderkey, (CASE o_orderkey % 7 WHEN 0 THEN o_orderdate + INTERVAL 5 HOUR - INTERVAL 3 MINUTE WHEN 1 THEN o_orderdate + INTERVAL 1 DAY + INTERVAL 6 HOUR + INTERVAL 30 MINUTE
  WHEN 2 THEN o_orderdate + to_days(CAST(4 - (isodow(o_orderdate) - 1) AS INT)) + INTERVAL 23 HOUR WHEN 3 THEN TIMESTAMP '2020-02-05'
  WHEN 4 THEN o_orderdate + INTERVAL 90 MINUTE + INTERVAL 5 SECOND WHEN 5 THEN o_orderdate + INTERVAL 2 DAY ELSE o_orderdate END)::VARCHAR AS at FROM orders""")
def _(t):
    k = F.col("o_orderkey") % 7
    d = (F.when(k == 0, "hours=+5, minutes=-3").when(k == 1, "days=1,time=06:30").when(k == 2, "weekday=4,time=23").when(k == 3, "date=05.02.2020")
         .when(k == 4, "01:30:05").when(k == 5, "2 day"))
    return t.orders.select("o_orderkey", C.shift_time("o_orderdate", d).alias("at"))


def active_loads(t):
    v = J.loading_state(I.load_journal(t))
    return v.select("id", "alive", "profile", "wf_id", F.when(F.col("id") % 13 != 0, F.col("id")).alias("loading_id"), "status",
                    F.when(F.col("id") % 3 == 0, "RUN x").alias("log"))


@query("pick_loads", f"""WITH c AS (SELECT id, wf_id, CASE WHEN alive <> 'ACTIVE' THEN 'not active' WHEN profile <> 'p1' THEN 'not profile' WHEN id % 13 = 0 THEN 'no loading_id'
  WHEN status NOT IN ('RUNNING', 'TIME-WAIT', 'EVENT-WAIT') THEN 'not add status' WHEN status = 'RUNNING' AND id % 3 = 0 THEN 'already run' END AS r FROM {I.LAST_LOADS_SQL}),
f AS (SELECT wf_id, min(id) AS f FROM c WHERE r IS NULL GROUP BY 1), x AS (SELECT max(f) AS edge, count(*) AS n FROM (SELECT f FROM f ORDER BY f LIMIT 20))
SELECT id, CASE WHEN r IS NOT NULL THEN r WHEN n >= 20 AND id > edge THEN 'limit 20 exceeded' WHEN id <> f THEN 'already added' END AS reason FROM c LEFT JOIN f USING (wf_id), x""")
def _(t):
    return C.pick_loads(active_loads(t), "p1", 20).select("id", "reason")


def monitored(t):
    """Events as loads in every status the monitor knows."""
    u, k = F.col("user_id"), F.col("event_id")
    names = ["PREREQ", "ERRORCHECK", "ERROR", "SUCCESS", "ABORTING", "LOCK", "RUNNING", "TIME-WAIT", "EVENT-WAIT", "OTHER"]
    status = F.element_at(F.array(*[F.lit(n) for n in names]), (u % 10 + 1).cast("int"))
    log = F.when(k % 4 == 0, None).when(k % 4 == 1, "RUN x").when(k % 4 == 2, "Skipped by user").otherwise("text")
    return t.events.select(
        k.alias("id"), status.alias("status"), F.col("ts").alias("status_dttm"), log.alias("log"), (k % 3 == 0).alias("running"), (u % 4 == 0).alias("external"), (k % 5 == 0).alias("abort_on_failure"),
        F.when(k % 6 == 0, 36000).alias("exe_timeout_s"), F.when(k % 7 != 0, F.expr("ts + interval 2 hours")).alias("wait_until"), (k % 2 == 0).alias("events_ready"), F.when(k % 9 == 0, 7200).alias("interval_s"))


_MON_AT = "2024-01-10 00:00:00"
_MON = f"""m AS (SELECT event_id AS k, user_id % 10 AS s, user_id % 4 = 0 AS ext, event_id % 3 = 0 AS run, event_id % 5 = 0 AS ab, CASE WHEN event_id % 6 = 0 THEN 36000 END AS tmo, event_id % 2 = 0 AS ev,
  epoch(TIMESTAMP '{_MON_AT}') - epoch_us(ts) / 1000000.0::DOUBLE AS age, event_id % 7 <> 0 AS known, event_id % 4 AS lg, CASE WHEN event_id % 9 = 0 THEN 7200 ELSE 86400 END AS itv FROM events),
a AS (SELECT *, CASE WHEN lg = 2 THEN 'Skipped' ELSE 'Aborted' END AS asked, CASE WHEN ab THEN 'Aborted' ELSE 'Completed' END AS failed FROM m),
x AS (SELECT *, CASE WHEN age < 3600 THEN 'New'
  WHEN ext THEN CASE s WHEN 2 THEN failed WHEN 3 THEN 'Completed' WHEN 4 THEN asked WHEN 7 THEN CASE WHEN known AND age >= 9000 THEN 'reStarted' ELSE 'Skipped' END WHEN 8 THEN CASE WHEN ev THEN 'reStarted' ELSE 'Skipped' END
    WHEN 6 THEN CASE WHEN age >= coalesce(tmo, 86400) THEN 'reStarted' ELSE 'Skipped' END ELSE CASE WHEN age >= 86400 THEN 'reStarted' ELSE 'Skipped' END END
  ELSE CASE s WHEN 0 THEN 'reStarted' WHEN 1 THEN 'reRunned' WHEN 2 THEN failed WHEN 3 THEN 'Completed' WHEN 4 THEN asked WHEN 5 THEN CASE WHEN age >= 18000 THEN 'reStarted' ELSE 'Skipped' END
    WHEN 6 THEN CASE WHEN lg = 0 THEN 'Skipped' WHEN lg <> 1 THEN 'reRunned' WHEN age >= greatest(21600, coalesce(tmo, 15900) + 600) THEN 'reRunned' ELSE 'Skipped' END
    WHEN 7 THEN CASE WHEN NOT run AND known AND age >= 8100 THEN 'reStarted' ELSE 'Skipped' END WHEN 8 THEN CASE WHEN NOT run AND ev THEN 'reStarted' ELSE 'Skipped' END ELSE 'notFound' END END AS act FROM a),
y AS (SELECT k, ext, CASE WHEN act = 'Skipped' AND age >= itv THEN 'SLA' ELSE act END AS action FROM x)"""


@query("monitor_action", f"WITH {_MON} SELECT k AS id, action FROM y WHERE NOT ext")
def _(t):
    return C.monitor_action(monitored(t), _MON_AT).filter("not external").select("id", "action")


@query("ue_action", f"WITH {_MON} SELECT k AS id, action FROM y WHERE ext")
def _(t):
    return C.monitor_action(monitored(t), _MON_AT).filter("external").select("id", "action")


@query("sla_breach", f"WITH {_MON} SELECT k AS id FROM y WHERE action = 'SLA'")
def _(t):
    return C.sla_breach(C.monitor_action(monitored(t), _MON_AT)).select("id")


def run_frames(t):
    """Orders as runs of customer definitions, lines as their tasks."""
    runs = t.orders.select(
        F.col("o_custkey").alias("dag_id"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("success").alias("state"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("start_date"), F.col("o_orderdate").alias("queued_at"))
    n = F.col("l_linenumber")
    tasks = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), n.alias("task_id"), F.when(n == 1, "running").when(n == 2, "queued").otherwise("success").alias("state"),
        F.when(n > 2, F.col("l_shipdate")).alias("end_date")).join(t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("dag_id")), "run_id")
    dags = t.customer.select(F.col("c_custkey").alias("dag_id"), (F.col("c_nationkey") < 8).alias("is_paused"))
    return runs, tasks, dags, t.customer.filter("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("dag_id"))


@query("zombie_runs", """WITH tk AS (SELECT l_orderkey AS k, bool_or(l_linenumber <= 2) AS live, bool_or(l_linenumber = 1) AS wk, max(l_shipdate) FILTER (WHERE l_linenumber > 2) AS le FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey, o_orderstatus AS s, c_nationkey < 8 AS p, coalesce(live, false) AS live, coalesce(wk, false) AS wk, o_custkey % 10 = 3 AS nos, o_orderdate < TIMESTAMP '2001-01-01' AS old, coalesce(le, o_orderdate) < TIMESTAMP '2001-01-01' AS idle
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN tk ON k = o_orderkey WHERE o_orderstatus <> 'P'),
v AS (SELECT o_orderkey AS run_id, CASE WHEN old AND ((s = 'F' AND NOT p AND NOT live) OR nos) THEN 'dead' WHEN p AND ((s = 'O' AND old) OR (s = 'F' AND NOT wk AND idle)) THEN 'paused' END AS verdict FROM r)
SELECT * FROM v WHERE verdict IS NOT NULL""")
def _(t):
    return C.zombie_runs(*run_frames(t), "2001-01-02", 86400).select("run_id", "verdict")


@query("new_events", f"""WITH {_STAT}, ev AS (SELECT *, CASE WHEN entity_id % 9 = 0 THEN 0 ELSE loading_id END AS lid, CASE WHEN entity_id % 2 = 0 THEN published - to_minutes(entity_id % 5 - 2) END AS em FROM ls WHERE entity_id % 6 <> 0)
SELECT profile, entity_id, lid AS loading_id, published::VARCHAR AS published FROM ev WHERE (em IS NULL OR published >= em - INTERVAL 1 MINUTE)
  AND NOT (CASE WHEN lid > 0 THEN lid % 4 = 0 ELSE entity_id % 18 = 9 END)""")
def _(t):
    ls = last_stat(t).withColumn("loading_id", F.when(F.col("entity_id") % 9 == 0, None).otherwise(F.col("loading_id")))
    ev = ls.select(*C.STAT_KEY, (F.col("entity_id") % 6 == 0).alias("scheduled"),
                   F.when(F.col("entity_id") % 2 == 0, F.expr("published - make_dt_interval(0, 0, cast(entity_id % 5 - 2 as int))")).alias("last_emitted"))
    sent = ls.filter("loading_id % 4 = 0 or (loading_id is null and entity_id % 18 = 9)").select(*C.STAT_KEY, "loading_id", "published")
    return C.new_events(ev, ls, sent).select("profile", "entity_id", "loading_id", "published")


@query("subtree", """SELECT 'r1' AS id, 0::BIGINT AS level UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
UNION ALL SELECT 'o' || o_orderkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def _(t):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = (
        t.region.select(tag("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
        .unionByName(t.nation.select(tag("n", "n_nationkey").alias("id"), tag("r", "n_regionkey").alias("parent")))
        .unionByName(t.customer.select(tag("c", "c_custkey").alias("id"), tag("n", "c_nationkey").alias("parent")))
        .unionByName(t.orders.select(tag("o", "o_orderkey").alias("id"), tag("c", "o_custkey").alias("parent"))))
    return C.subtree(edges, "r1")


@query("next_run", """WITH x AS (SELECT o_orderkey, TIMESTAMP '1996-01-01' + to_hours(o_custkey % 100) AS f, 3600 * (1 + o_custkey % 50) AS i, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS l, CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '1999-01-01' END AS e FROM orders),
y AS (SELECT *, CASE WHEN l IS NULL OR l + to_seconds(i) < f THEN f ELSE f + to_seconds(CAST(floor((epoch(l) + i - epoch(f)) / i) AS BIGINT) * i) END AS n FROM x)
SELECT o_orderkey, (CASE WHEN n > e THEN NULL ELSE n END)::VARCHAR AS next_at FROM y""")
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = t.orders.select("o_orderkey", F.expr("timestamp'1996-01-01' + make_dt_interval(0, cast(o_custkey % 100 as int))").alias("f"), (3600 * (1 + c % 50)).alias("i"),
                        F.when(k % 9 != 0, F.col("o_orderdate")).alias("l"), F.when(k % 4 == 0, F.lit("1999-01-01").cast("timestamp")).alias("e"))
    return x.select("o_orderkey", C.next_run("f", "i", "l", "e").alias("next_at"))


def calendar(t):
    """Parts as calendar rules."""
    s = F.col("p_size")
    kinds = ["daily", "workdays", "weekly", "monthly", "quarterly", "yearly", "", "fortnight"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (s % 8 + 1).cast("int"))
    one = lambda v: F.array(v.cast("int"))
    return t.part.select(
        F.col("p_partkey").alias("rule_id"), kind.alias("kind"), F.when((s % 8 == 6) & (s % 3 == 0), one(s % 7 + 1)).alias("dow"), F.when((s % 8 == 3) & (s % 3 == 1), one(s % 31 + 1)).alias("day"),
        F.when((s % 8 == 5) & (s % 2 == 1), one(s % 12 + 1)).alias("month"), F.when((s % 8 == 3) & (s % 3 == 2), True).alias("last"), F.when(s % 5 != 0, F.concat(F.lpad((s % 24).cast("string"), 2, "0"), F.lit(":30"))).alias("at"),
        F.col("p_partkey").alias("wf_id"))


_CAL_AT = "2001-07-25 06:00:00"
_CAL = f"""ru AS (SELECT p_partkey AS id, p_size AS s, p_size % 8 AS g, CASE WHEN p_size % 5 <> 0 THEN (p_size % 24) * 3600 + 1800 ELSE 86399 END AS ats FROM part WHERE p_size % 8 <> 7),
dy AS (SELECT unnest(generate_series(DATE '2001-07-25' - 800, DATE '2001-07-25', INTERVAL 1 DAY))::DATE AS d),
dl AS (SELECT id, s, g, d::TIMESTAMP + to_seconds(ats) AS dl FROM ru CROSS JOIN dy WHERE d::TIMESTAMP + to_seconds(ats) <= TIMESTAMP '{_CAL_AT}' AND CASE g
  WHEN 0 THEN true WHEN 1 THEN isodow(d) <= 5 WHEN 2 THEN isodow(d) = 1 WHEN 3 THEN CASE s % 3 WHEN 0 THEN day(d) = 1 WHEN 1 THEN day(d) = s % 31 + 1 ELSE d = last_day(d) END
  WHEN 4 THEN month(d) % 3 = 0 AND d = last_day(d) WHEN 5 THEN day(d) = 1 AND month(d) = CASE WHEN s % 2 = 1 THEN s % 12 + 1 ELSE 1 END ELSE s % 3 <> 0 OR isodow(d) = s % 7 + 1 END),
de AS (SELECT id, s, g, max(dl) AS deadline, max(dl) FILTER (WHERE rn = 2) AS previous FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dl DESC) AS rn FROM dl) GROUP BY ALL)"""
_KIND = "CASE g WHEN 0 THEN 'daily' WHEN 1 THEN 'workdays' WHEN 2 THEN 'weekly' WHEN 3 THEN 'monthly' WHEN 4 THEN 'quarterly' WHEN 5 THEN 'yearly' WHEN 7 THEN 'fortnight' ELSE CASE WHEN s % 3 = 0 THEN 'weekly' ELSE 'daily' END END"


@query("calendar_deadlines", f"""WITH {_CAL} SELECT p_partkey AS rule_id, kind, deadline::VARCHAR AS deadline, previous::VARCHAR AS previous, CASE WHEN kind = 'fortnight' THEN 'unknown word' WHEN deadline IS NULL THEN 'no deadline' END AS problem
FROM (SELECT p_partkey, {_KIND} AS kind FROM (SELECT p_partkey, p_size % 8 AS g, p_size AS s FROM part)) LEFT JOIN de ON id = p_partkey""")
def _(t):
    return C.calendar_deadlines(calendar(t), _CAL_AT, 800).select("rule_id", "kind", "deadline", "previous", "problem")


def last_at(t):
    return t.orders.filter("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").alias("wf_id")).agg(F.max(F.expr("o_orderdate + interval 7 hours")).alias("last_at"))


_LAST = "la AS (SELECT o_custkey AS wf_id, max(o_orderdate + INTERVAL 7 HOUR) AS last_at FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1)"


@query("alert_interval", f"""WITH {_LAST}, r AS (SELECT c_custkey AS wf_id, (1 + c_custkey % 40) * 21600 AS ev, CASE WHEN c_nationkey % 2 = 0 THEN 5 * 3600 END AS ats FROM customer),
x AS (SELECT r.*, last_at, ats IS NULL OR ev < 86400 AS roll, CASE WHEN ats IS NULL OR ev < 86400 THEN make_timestamp(CAST(epoch(TIMESTAMP '{_CAL_AT}') AS BIGINT) // ev * ev * 1000000) ELSE coalesce(date_trunc('day', last_at + to_seconds(ev)) + to_seconds(ats), TIMESTAMP '2001-07-25') END AS per FROM r LEFT JOIN la USING (wf_id))
SELECT wf_id, roll AS rolling, per::VARCHAR AS period_ts FROM x WHERE last_at IS NULL OR CASE WHEN roll THEN last_at + to_seconds(ev) < TIMESTAMP '{_CAL_AT}' ELSE per <= TIMESTAMP '{_CAL_AT}' END""")
def _(t):
    r = t.customer.select(F.col("c_custkey").alias("wf_id"), ((1 + F.col("c_custkey") % 40) * 21600).alias("every_s"), F.when(F.col("c_nationkey") % 2 == 0, "05:00").alias("at"))
    return C.alert_interval(r, last_at(t), _CAL_AT).select("wf_id", "rolling", "period_ts")


@query("alert_event", f"WITH {_CAL}, {_LAST} SELECT id AS rule_id, deadline::VARCHAR AS deadline FROM de LEFT JOIN la ON wf_id = id WHERE last_at IS NULL OR last_at::DATE < (deadline - INTERVAL 1 SECOND)::DATE")
def _(t):
    return C.alert_event(C.calendar_deadlines(calendar(t), _CAL_AT, 800), last_at(t)).select("rule_id", "deadline")


@query("alert_data", f"""WITH {_CAL}, st AS (SELECT o_orderpriority AS obj, max(o_orderdate) AS m FROM orders WHERE o_custkey % 5 <> 0 AND o_orderdate < TIMESTAMP '2001-07-20' GROUP BY 1)
SELECT id AS rule_id, (deadline - to_days(CAST(s % 10 AS INT)))::DATE::VARCHAR AS need FROM de LEFT JOIN st ON left(obj, 1) = (s % 7)::VARCHAR WHERE m IS NULL OR m::DATE < (deadline - to_days(CAST(s % 10 AS INT)))::DATE""")
def _(t):
    size = t.part.select(F.col("p_partkey").alias("rule_id"), (F.col("p_size") % 7).cast("string").alias("obj"), (F.col("p_size") % 10 * 86400).alias("lag_s"))
    d = C.calendar_deadlines(calendar(t), _CAL_AT, 800).join(size, "rule_id")
    st = t.orders.filter((F.col("o_custkey") % 5 != 0) & (F.col("o_orderdate") < F.lit("2001-07-20").cast("timestamp"))).select(F.substring("o_orderpriority", 1, 1).alias("obj"), F.col("o_orderdate").alias("data_max"))
    return C.alert_data(d, st).select("rule_id", "need")


@query("data_alerts", f"""WITH {_CAL}, st AS (SELECT left(o_orderpriority, 1) AS obj, max(o_orderdate) AS m FROM orders WHERE o_custkey % 5 <> 0 AND o_orderdate < TIMESTAMP '2001-07-20' GROUP BY 1),
v AS (SELECT de.id AS rule_id, s % 6 AS k, (deadline - to_days(CAST(s % 10 AS INT)))::DATE AS need, CASE s % 6 WHEN 0 THEN (SELECT max(o_orderdate) FROM orders) WHEN 1 THEN (SELECT max(l_shipdate) - INTERVAL 30 DAY FROM lineitem)
  WHEN 2 THEN m - INTERVAL 2 DAY END AS last_at FROM de LEFT JOIN st ON obj = '2')
SELECT rule_id, need::VARCHAR AS need, date_trunc('second', last_at)::VARCHAR AS last_at, CASE k WHEN 3 THEN 'bad' WHEN 4 THEN 'unresolved' WHEN 5 THEN 'unknown' END AS problem FROM v WHERE k > 2 OR last_at IS NULL OR last_at::DATE < need""")
def _(t):
    """Rules by two expressions, by a field, with a statement in the name, with an unknown column and with an unknown field."""
    k = F.col("p_size") % 6
    at = lambda *texts: F.element_at(F.array(*[F.lit(x) for x in texts]), k.cast("int") + 1)
    rules = t.part.select(F.col("p_partkey").alias("rule_id"), at("orders", "lineitem", "2", "orders; drop", "orders", "2").alias("name"), (F.col("p_size") % 10 * 86400).alias("lag_s"),
                          at("max(o_orderdate)", "max(l_shipdate) - interval 30 days", "", "", "max(no_such_column)", "").alias("expr"), at("", "", "seen_max", "", "", "no_such_field").alias("field"))
    rules = rules.withColumn("obj", F.when(F.col("name") == "2", "p_2").otherwise(F.col("name")))
    d = C.calendar_deadlines(calendar(t), _CAL_AT, 800).join(rules, "rule_id")
    st = t.orders.filter((F.col("o_custkey") % 5 != 0) & (F.col("o_orderdate") < F.lit("2001-07-20").cast("timestamp"))).select(
        F.concat(F.lit("p_"), F.substring("o_orderpriority", 1, 1)).alias("obj"), F.col("o_orderdate").alias("data_max"), (F.col("o_orderdate") - F.expr("interval 2 days")).alias("seen_max"))
    out = C.data_alerts(d, st, {"orders": t.orders, "lineitem": t.lineitem}, 10)
    problem = F.when(F.col("problem").startswith("bad name"), "bad").when(F.col("problem").startswith("[UNRESOLVED_COLUMN"), "unresolved").when(F.col("problem").startswith("unknown field"), "unknown")
    return out.select("rule_id", "need", F.date_trunc("second", "last_at").alias("last_at"), problem.alias("problem"))


@query("last_success", f"SELECT wf_id, date_trunc('second', max(ts + INTERVAL 1 MINUTE))::VARCHAR AS last_at FROM {I.LAST_LOADS_SQL} WHERE alive = 'COMPLETED' AND status = 'SUCCESS' GROUP BY 1")
def _(t):
    return C.last_success(J.loading_state(I.load_journal(t)))


@query("last_publication", f"SELECT wf_id, max(e.ts)::VARCHAR AS last_at FROM {I.LAST_LOADS_SQL} l JOIN events e ON e.event_id // 4 = l.id WHERE e.user_id % 5 = 2 GROUP BY 1")
def _(t):
    pub = t.events.select(F.floor(F.col("event_id") / 4).cast("bigint").alias("loading_id"), (F.col("user_id") % 5).alias("stat_id"), "ts")
    return C.last_success(J.loading_state(I.load_journal(t)), pub, 2)


def alerts(t):
    """Customers as alerts: new ones, and a stored copy of some with another time or state."""
    k = F.col("c_custkey")
    base = t.customer.select(k.alias("wf_id"), F.concat(F.lit("k"), (k % 3).cast("string")).alias("alert_key"), F.date_trunc("day", F.expr("timestamp'2001-07-01' + make_dt_interval(cast(c_custkey % 20 as int))")).alias("period_ts"))
    new = base.filter("wf_id % 2 = 0")
    stored = base.filter("wf_id % 5 <> 0").select("*", F.when(F.col("wf_id") % 4 == 0, F.expr("timestamp'2001-07-24 20:00:00'")).otherwise(F.expr("timestamp'2001-07-20'")).alias("ts"),
                                                 F.when(F.col("wf_id") % 7 == 0, F.expr("timestamp'2001-07-21'")).alias("close_ts"))
    return new, stored


@query("alert_open", "SELECT c_custkey AS wf_id FROM customer WHERE c_custkey % 2 = 0 AND NOT (c_custkey % 5 <> 0 AND c_custkey % 4 = 0)")
def _(t):
    new, stored = alerts(t)
    return C.alert_open(new, stored, _CAL_AT).select("wf_id")


@query("alert_close", "SELECT c_custkey AS wf_id, 'k' || (c_custkey % 3) AS alert_key FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_nationkey < 12 AND c_custkey % 2 <> 0")
def _(t):
    new, stored = alerts(t)
    return C.alert_close(stored, t.customer.filter("c_nationkey < 12").select(F.col("c_custkey").alias("wf_id")), new).select("wf_id", "alert_key")


@query("alert_rules", "SELECT p_partkey AS wf_id, p_size % 4 <> 1 AND p_size % 4 <> 3 AS valid, p_size % 4 = 1 AS data_only FROM part WHERE p_size % 11 <> 0 AND p_size % 4 <> 2 AND p_size % 3 = 0")
def _(t):
    s = F.col("p_size")
    p = lambda n, v: F.struct(F.lit(n).alias("param"), v.alias("value"))
    rule = F.when(s % 4 == 0, '{"kind": "daily"}').when(s % 4 == 3, '{"kind": "daily"')
    cat = t.part.select(F.col("p_partkey").alias("wf_id"), (s % 11 == 0).alias("deleted"), F.array(
        p("wf_alert", rule), p("wf_alert_data", F.when(s % 4 == 1, F.lit('{"obj": "stg.x"}'))), p("wf_alert_group", F.when(s % 3 != 0, F.lit("g")))).alias("params"))
    r = C.alert_rules(cat, "", _CAL_AT, "03:00:00")
    return r.select("wf_id", "valid", (F.col("rule").isNull() & F.col("data").isNotNull()).alias("data_only"))


@query("dependency_edges", """WITH w AS (SELECT p_partkey AS k, p_size AS s, p_brand AS b, p_size % 2 = 0 AS sc FROM part),
x AS (SELECT *, NOT sc AS owns, s % 3 = 0 AS ev, s % 5 = 0 AS ti, s % 13 = 0 AS fed, CASE WHEN s % 3 = 0 THEN 'event' WHEN s % 5 = 0 THEN 'time' WHEN s % 7 = 0 THEN 'condition' ELSE 'manual' END AS kind FROM w),
y AS (SELECT *, CASE WHEN b = 'Brand#1' THEN 'ARCHIVE' WHEN fed THEN 'inbound' ELSE CASE WHEN owns THEN 'own_' ELSE 'engine_' END || kind END AS tag FROM x)
SELECT k AS wf_id, tag, CASE WHEN tag = 'ARCHIVE' THEN NULL WHEN fed THEN 'files/a/' || s WHEN owns AND ev THEN 'events/p/' || d WHEN owns AND ti THEN 'cron 0 1 * * *' END AS dependency
FROM y LEFT JOIN (VALUES (1), (2), (3)) v(d) ON tag <> 'ARCHIVE' AND NOT fed AND owns AND ev AND (d <> 2 OR s % 4 = 1)""")
def _(t):
    s = F.col("p_size")
    e = lambda i, a: F.struct(F.lit("p").alias("profile"), F.lit(i).alias("entity_id"), a.alias("active"))
    none = F.lit(None).cast("boolean")
    w = t.part.select(
        F.col("p_partkey").alias("wf_id"), F.col("p_brand").alias("category"), (s % 2 == 0).alias("scheduled"), F.when(s % 3 == 0, F.array(e(1, none), e(2, s % 4 == 1), e(3, F.lit(True)))).alias("events"),
        F.when(s % 5 == 0, "0 1 * * *").alias("sched"), (s % 7 == 0).alias("has_condition"), F.when(s % 13 == 0, F.concat(F.lit("//a/"), s.cast("string"))).alias("inbound_path"))
    return C.dependency_edges(w, "mixed", "Brand#1", "own", "engine", "inbound", "files", "events").select("wf_id", "tag", "dependency")


@query("publish_stats", """WITH r AS (SELECT o_orderkey AS k, o_custkey AS e, o_orderkey % 4 - 1 AS res FROM orders)
SELECT k AS loading_id, e AS entity_id, 11::BIGINT AS stat_id, '2001-08-02 00:00:00' AS value FROM r UNION ALL SELECT k, e, 2, '1' FROM r WHERE res > 0 UNION ALL SELECT k, e, 1, 'c' || k FROM r WHERE res > 0 AND k % 3 = 0
UNION ALL SELECT k, e, 56, '{"dataBusiness":"' || k || '"}' FROM r WHERE res > 0 AND k % 5 = 0 UNION ALL SELECT k, e, 55, '{"dataBusiness":"' || k || '"}' FROM r WHERE res > 0 AND k % 5 = 0 UNION ALL SELECT k, e, 77, 'x' FROM r WHERE k % 2 = 0""")
def _(t):
    k = F.col("o_orderkey")
    r = t.orders.select(
        k.alias("loading_id"), F.col("o_custkey").alias("entity_id"), (k % 4 - 1).alias("res"), F.when(k % 3 == 0, F.concat(F.lit("c"), k.cast("string"))).alias("cdc"),
        F.when(k % 5 == 0, F.to_json(F.struct(k.cast("string").alias("dataBusiness")))).alias("hub"), F.when(k % 2 == 0, F.create_map(F.lit("77"), F.lit("x"))).alias("stat"))
    return C.publish_stats(r, AS_OF)
