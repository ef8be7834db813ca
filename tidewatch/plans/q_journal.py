"""Journal queries."""

from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import journal as J
from tidewatch.plans import inputs as I
from tidewatch.plans.registry import query


@query("latest_by_key", """
SELECT user_id, event_type, event_id, ts::VARCHAR AS ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def _(t):
    from tidewatch.operators.common import latest_by_key

    e = t.events.select("user_id", "event_type", "event_id", "ts", "value")
    return latest_by_key(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


@query("replacing_latest", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate::VARCHAR AS l_shipdate FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1""")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return J.replacing_latest(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"])


@query("state_current", """
SELECT o_orderpriority, o_orderstatus, count(*) AS states, max(o_orderkey) AS o_orderkey,
  arg_max(o_custkey, o_orderkey) AS o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice
FROM orders GROUP BY ALL""")
def _(t):
    return J.state_current(t.orders, ["o_orderpriority", "o_orderstatus"], "o_orderkey", ["o_custkey", "o_totalprice"])


_CHANGED = """
WITH d AS (SELECT user_id AS id, event_type, ts, event_id, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events),
old AS (SELECT id, event_type, k FROM d WHERE ts < TIMESTAMP '2024-01-16'
  QUALIFY row_number() OVER (PARTITION BY id, event_type ORDER BY ts DESC, k DESC) = 1),
new AS (SELECT * FROM d WHERE ts >= TIMESTAMP '2024-01-16')"""


def _changed(t):
    e = t.events.select(
        "ts", F.col("user_id").alias("id"), F.col("event_type").alias("obj"),
        F.concat(F.lit("/"), F.col("event_type")).alias("url"), F.col("props").alias("msg"), "event_id",
    )
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    # The stored side spells the same documents with other spacing.
    stored = e.filter(F.col("ts") < cut).withColumn("msg", F.regexp_replace("msg", " ", "")).drop("event_id")
    return J.append_changed(e.filter(F.col("ts") >= cut), stored)


@query("append_changed", _CHANGED + """
SELECT n.id, n.event_type AS obj, n.event_id, n.k FROM new n
WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.id = n.id AND o.event_type = n.event_type AND o.k = n.k)""")
def _(t):
    return _changed(t).select("id", "obj", "event_id", S.field("msg", "k").cast("bigint").alias("k"))


@query("append_result", _CHANGED + """
SELECT 'Ok ' || count(*) AS result FROM new n
WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.id = n.id AND o.event_type = n.event_type AND o.k = n.k)""")
def _(t):
    return J.append_result(_changed(t))


@query("explode_documents", """
SELECT o_orderkey AS id, 'wf' AS obj, o_custkey AS custkey, CAST(l_linenumber AS BIGINT) AS n_params,
  'v' || o_custkey AS wf_a, 'w' || o_orderstatus AS wf_b
FROM orders JOIN (SELECT l_orderkey, count(*) AS l_linenumber FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
UNION ALL SELECT p_partkey, 'statval', p_size, NULL, NULL, NULL FROM part
UNION ALL SELECT c_custkey, 'category', c_nationkey, NULL, NULL, NULL FROM customer""")
def _(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    param = lambda n, v, p: F.struct(F.lit(n).alias("param"), v.alias("value"), p.alias("prior_value"))
    none = F.lit(None).cast("string")
    params = F.array(
        param("wf_a", none, F.concat(F.lit("v"), F.col("o_custkey").cast("string"))),
        param("wf_b", F.concat(F.lit("w"), F.col("o_orderstatus")), F.lit("x")),
        param("wf_id", F.lit("1"), none), param("other", F.lit("2"), none),
    )
    one = t.orders.join(lines, "o_orderkey").select(
        F.lit("/wf/start?x=1").alias("url"), F.col("o_orderdate").alias("ts"),
        F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("custkey"), F.col("n"), params.alias("params"))).alias("msg"),
    )
    item = F.struct(F.col("p_partkey").alias("loading_id"), F.col("p_size").alias("custkey"))
    # Messages of one item list per part, with a non-object element that must fall out.
    parts = t.part.select(
        F.lit("/statval").alias("url"), F.lit(I.ORDERS_AS_OF).cast("timestamp").alias("ts"),
        F.concat(F.lit('[7, "x", '), F.to_json(item), F.lit("]")).alias("msg"),
    )
    pairs = t.customer.select(
        F.lit("/category/tree").alias("url"), F.lit(I.ORDERS_AS_OF).cast("timestamp").alias("ts"),
        F.concat(F.lit("["), F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("custkey"))), F.lit("]")).alias("msg"),
    )
    bad = t.region.select(F.lit("/wf").alias("url"), F.lit(I.ORDERS_AS_OF).cast("timestamp").alias("ts"), F.col("r_name").alias("msg"))
    out = J.explode_documents(one.unionByName(parts).unionByName(pairs).unionByName(bad))
    doc = F.from_json("msg", "custkey bigint, n bigint, params array<map<string,string>>")
    return out.withColumn("d", doc).select(
        "id", "obj", F.col("d.custkey"), F.col("d.n").alias("n_params"),
        F.col("d.params")[0]["wf_a"].alias("wf_a"), F.col("d.params")[1]["wf_b"].alias("wf_b"),
    )


@query("journal_latest", f"SELECT id, 'loading' AS obj, ts::VARCHAR AS ts, alive, status FROM {I.LAST_LOADS_SQL}")
def _(t):
    return J.journal_latest(I.load_journal(t)).select(
        "id", "obj", "ts", S.field("msg", "alive").alias("alive"), S.field("msg", "status").alias("status"))


@query("pair_start_end", f"SELECT beg_id, beg_ts::VARCHAR AS beg_ts, wf, loading_id, end_id, end_ts::VARCHAR AS end_ts, end_action, duration, CAST(res AS BIGINT) AS res, wf_id, msg FROM {I.RUNS_SQL}")
def _(t):
    return J.control_log(I.run_journal(t)).select(
        "beg_id", "beg_ts", "wf", "loading_id", "end_id", "end_ts", "end_action", "duration", "res", "wf_id", "msg")


@query("check_log", f"SELECT beg_id, obj, sch, end_id, CAST(res AS BIGINT) AS res, msg, date_trunc('second', end_ts)::VARCHAR AS last FROM {I.RUNS_SQL}")
def _(t):
    return J.check_log(I.run_journal(t)).select("beg_id", "obj", "sch", "end_id", "res", "msg", "last")


@query("loading_state", f"""
SELECT id, ts::VARCHAR AS ts, alive, auto, profile, wf_id,
  date_trunc('second', ts - INTERVAL 1 HOUR)::VARCHAR AS start_dttm, date_trunc('second', ts + INTERVAL 1 MINUTE)::VARCHAR AS end_dttm,
  date_trunc('second', CASE WHEN alive = 'ABORTED' THEN ts + INTERVAL 1 MINUTE ELSE ts END)::VARCHAR AS status_dttm,
  CASE WHEN alive = 'ABORTED' THEN 'ABORTED' ELSE status END AS status FROM {I.LAST_LOADS_SQL}""")
def _(t):
    return J.loading_state(I.load_journal(t)).select(
        "id", "ts", "alive", "auto", "profile", "wf_id", "start_dttm", "end_dttm", "status_dttm", "status")


def entity_journal(t):
    """Nations as entities below regions, two versions each."""
    n = t.nation.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    return n.select(
        (F.lit(I.ORDERS_AS_OF).cast("timestamp") + F.make_interval(days=F.col("v"))).alias("ts"),
        F.col("n_nationkey").cast("bigint").alias("id"), F.lit("entity").alias("obj"), F.lit("/entity").alias("url"),
        F.to_json(F.struct(
            F.concat("n_name", F.lit("_"), F.col("v").cast("string")).alias("name"),
            F.concat(F.lit("/"), "n_name").alias("path"), F.lit("dfs").alias("storage"), F.col("n_regionkey").alias("parentId"),
        )).alias("msg"),
    )


@query("entity_state", """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name || '_1' AS name, '/' || n_name AS path, 'dfs' AS storage, CAST(n_regionkey AS BIGINT) AS parentid FROM nation""")
def _(t):
    return J.entity_state(entity_journal(t)).select("id", "name", "path", "storage", "parentid")


def workflow_journal(t):
    """Parts as workflows in both document shapes, with entities, values and loads."""
    day = F.lit(I.ORDERS_AS_OF).cast("timestamp")
    none = F.lit(None).cast("string")
    ev = lambda e, s, a: F.struct(
        F.lit("p1").alias("profile"), F.lit(s).alias("stat_id"), e.cast("string").alias("entity_id"), a.alias("active"))
    size = F.col("p_size")
    doc = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("p"), (size % 3).cast("string")).alias("profile"),
        F.concat(F.when(size % 7 == 0, F.lit("z.")).otherwise(F.lit("dep.")), F.col("p_brand")).alias("category"),
        (size % 2 == 0).alias("scheduled"), (size % 11 == 0).alias("deleted"), F.lit(True).alias("singleLoading"),
        F.lit("dummy").alias("engine"), F.col("p_type").alias("type"),
        F.when(size % 2 == 0, F.lit("and")).alias("eventAwaitStrategy"),
        F.struct(F.lit("0 5 * * *").alias("sched")).alias("wf_time_sched"),
        F.array(ev(F.col("p_partkey") % 25, "1", F.lit(True)), ev((F.col("p_partkey") + 7) % 25, "1", size % 3 == 0),
                ev((F.col("p_partkey") + 3) % 25, "2", F.lit(True))).alias("wf_event_sched"),
        F.array(F.struct(F.lit("wf_interval").alias("param"), F.when(size % 5 == 0, F.lit("2 hours")).alias("prior_value")),
                F.struct(F.lit("wf_x").alias("param"), F.concat(F.lit("$"), size.cast("string")).alias("prior_value"))).alias("param"),
    )
    ent = F.array(F.col("p_partkey") % 25, F.lit(24).cast("bigint"))
    extended = t.part.select(
        day.alias("ts"), F.col("p_partkey").alias("id"), F.lit("wf").alias("obj"), F.lit("/wf/extended").alias("url"),
        F.to_json(F.struct(doc.alias("wf"), ent.alias("connectedEntities"))).alias("msg"))
    # Every third workflow is newer inside a load document, its entities come from a listing.
    carried = t.part.filter("p_partkey % 3 = 0").select(
        (day + F.expr("interval 1 hour")).alias("ts"), (F.col("p_partkey") + 1000000).alias("id"), F.lit("loading").alias("obj"),
        F.concat(F.lit("/loading/"), (F.col("p_partkey") + 1000000).cast("string")).alias("url"),
        F.to_json(F.struct(doc.alias("workflow"), F.lit("COMPLETED").alias("alive"), F.lit("2001-08-01 10:00:00").alias("end_dttm"))).alias("msg"))
    listing = t.part.filter("p_partkey % 3 = 0").select(
        day.alias("ts"), (F.col("p_partkey") % 20).alias("id"), F.lit("listing").alias("obj"),
        F.concat(F.lit("/entity/wf/"), F.col("p_partkey").cast("string")).alias("url"), F.lit("{}").alias("msg"))
    vals = t.nation.select(
        day.alias("ts"), (F.col("n_nationkey") + 1000000).cast("bigint").alias("id"), F.lit("statval").alias("obj"), F.lit("/statval").alias("url"),
        F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("entity_id"), F.lit("1").alias("stat_id"), F.lit("p1").alias("profile"))).alias("msg"))
    return extended.unionByName(carried).unionByName(listing).unionByName(vals).unionByName(entity_journal(t))


@query("workflow_catalog", """
WITH p AS (SELECT *, p_partkey % 25 AS e1, (p_partkey + 7) % 25 AS e2, (p_partkey + 3) % 25 AS e3 FROM part WHERE p_size % 7 <> 0),
val AS (SELECT n_nationkey AS e, CAST(n_nationkey + 1000000 AS VARCHAR) AS lid,
  CASE WHEN n_nationkey % 3 = 0 AND n_nationkey IN (SELECT p_partkey FROM part) THEN '2001-08-01 10:00:00' END AS done FROM nation),
ev AS (SELECT p_partkey, e1 AS e, 1 AS stat FROM p UNION ALL SELECT p_partkey, e2, 1 FROM p WHERE p_size % 3 = 0
  UNION ALL SELECT p_partkey, e3, 2 FROM p),
txt AS (SELECT p_partkey, stat, string_agg(e || ' (' || coalesce(CASE WHEN stat = 1 THEN coalesce(done, lid) END, ''), '), '
    ORDER BY CASE WHEN stat = 1 THEN done END NULLS FIRST, CASE WHEN stat = 1 THEN lid END NULLS FIRST, e) AS l
  FROM ev JOIN val USING (e) GROUP BY ALL),
evs AS (SELECT p_partkey, string_agg('p1 [' || stat || '] {' || l || ')}', ', ' ORDER BY stat) AS s FROM txt GROUP BY 1),
con AS (SELECT p_partkey, x AS e FROM (SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 = 0 THEN [p_partkey % 20] ELSE [e1, 24] END) AS x FROM p)),
cn AS (SELECT p_partkey, string_agg(e || ': ' || n_name || '_1', ', ' ORDER BY e || ': ' || n_name || '_1') AS c FROM con JOIN nation ON n_nationkey = e GROUP BY 1)
SELECT p_partkey AS id, 'dep.' || p_brand AS category, p_name AS name, p_size % 2 = 0 AS scheduled, p_size % 11 = 0 AS deleted, c AS connected,
  CASE WHEN p_size % 2 = 0 THEN 'and: ' || s ELSE 'sched: 0 5 * * *' END AS wf_sched,
  'wf_interval: ' || CASE WHEN p_size % 5 = 0 THEN '2 hours' ELSE '' END || '; wf_x: %' || p_size AS param,
  CASE WHEN p_size % 5 = 0 THEN '2 hours' ELSE '1 day' END AS wf_interval
FROM p LEFT JOIN evs USING (p_partkey) LEFT JOIN cn USING (p_partkey)""")
def _(t):
    return J.workflow_catalog(workflow_journal(t), "dep").select(
        "id", "category", "name", "scheduled", "deleted", "connected", "wf_sched", "param", "wf_interval")


def ptable(t):
    """Tail probabilities by score in steps of 0.1, from the line numbers of the smallest orders."""
    return t.spark.range(0, 51).select((F.col("id") / 10.0).alias("zscore"), F.round(0.5 * F.exp(-F.col("id") / 10.0), 4).alias("p_value"))


@query("workflow_log", f"""
WITH z AS (SELECT event_id AS end_id, 'tb_' || (user_id % 20) AS object, round((value - 60) / 30, 4) AS zscore, DATE '2024-01-01' + CAST(user_id % 30 AS INT) AS key_date, user_id
  FROM events WHERE event_type IN ('error', 'purchase'))
SELECT r.beg_id AS start_id, r.end_id, r.duration, CASE WHEN r.end_id IS NOT NULL THEN r.end_id * 10 END AS rows_count, zscore,
  zscore BETWEEN CASE WHEN user_id % 20 < 5 THEN -1.0 ELSE -3.0 END AND 3.0 AS ztest_ok,
  CASE WHEN zscore IS NULL THEN NULL ELSE key_date = DATE '2024-01-05' END AS is_except,
  CASE WHEN round(abs(zscore)::DECIMAL(20,6), 1) <= 5.0 THEN CAST(round(round(0.5 * exp(-round(abs(zscore)::DECIMAL(20,6), 1)::DOUBLE), 4) * 2 * 100) AS BIGINT) ELSE 0 END AS confidence
FROM {I.RUNS_SQL} r LEFT JOIN z ON z.end_id = r.end_id""")
def _(t):
    ends = t.events.filter("event_type in ('error', 'purchase')")
    stats = ends.select(F.col("event_id").alias("log_id"), (F.col("event_id") * 10).alias("rows_count"), F.lit("a").alias("key_min"), F.lit("b").alias("key_max"))
    obj = F.concat(F.lit("tb_"), (F.col("user_id") % 20).cast("string"))
    z = ends.select(
        F.col("event_id").alias("log_id"), "ts", obj.alias("object"), F.round((F.col("value") - 60) / 30, 4).alias("zscore"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("user_id") % 30).cast("int")).alias("key_date"),
        F.lit(1).alias("rows_count"), F.lit(4).alias("avg"), F.lit(2).alias("std"))
    older = z.withColumn("ts", F.col("ts") - F.expr("interval 1 hour")).withColumn("zscore", F.lit(99.0))
    cfg = t.events.select(obj.alias("object")).distinct().select(
        "object", F.when(F.substring_index("object", "_", -1).cast("int") < 5, F.lit(-1.0)).alias("z_min"),
        F.lit(None).cast("double").alias("z_max"), F.array(F.lit("2024-01-05").cast("date")).alias("z_except"))
    # Event 0 is a row like any other, but in this journal parent 0 means none: ids count from 2 inside, parents from 1.
    up = lambda c: (F.col(c) + 2).alias(c)
    runs = I.run_journal(t).select(up("id"), "ts", up("parent"), "wf_action", "wf_message")
    stats, z, older = (d.withColumn("log_id", F.col("log_id") + 2) for d in (stats, z, older))
    out = J.workflow_log(runs, stats, z.unionByName(older), cfg, ptable(t))
    down = lambda c: (F.col(c) - 2).alias(c)
    return out.select(down("start_id"), down("end_id"), "duration", "rows_count", "zscore", "ztest_ok", "is_except", "confidence")


@query("error_call_chain", """
SELECT event_id AS log_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'srv.f_' || (user_id % 20) END AS last_call,
  CASE WHEN event_id % 3 = 0 THEN 'select->' ELSE '' END || 'g_' || event_type || CASE WHEN event_id % 4 = 0 THEN '' ELSE '->srv.f_' || (user_id % 20) END AS calls FROM events""")
def _(t):
    ctx = F.concat(
        F.when(F.col("event_id") % 4 == 0, F.lit("at character 12\n")).otherwise(
            F.concat(F.lit('PL/pgSQL function srv.f_'), (F.col("user_id") % 20).cast("string"), F.lit("(text) line 7 at EXECUTE\n"))),
        F.lit('PL/pgSQL function "g_'), F.col("event_type"), F.lit('" line 3 at assignment'),
        F.when(F.col("event_id") % 3 == 0, F.lit('\nSQL statement "select f()" in loop')).otherwise(F.lit("")),
    )
    return J.error_call_chain(t.events.select(F.col("event_id").alias("log_id"), ctx.alias("context"))).drop("context")


@query("loading_normalize", f"""
SELECT id, CASE WHEN NOT auto THEN 'MANUAL' ELSE 'NO-WAIT' END AS run_type, 'v' || id AS wf_a, 'q' AS x_loading, CAST(2 AS BIGINT) AS n_params,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_of_status, strftime(ts - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS last_of_start,
  status || ' now' AS log_text FROM {I.LAST_LOADS_SQL}""")
def _(t):
    last = J.journal_latest(I.load_journal(t))
    doc = F.from_json("msg", "struct<id:bigint,auto:boolean,status:string,start_dttm:string,loading_status:array<struct<effective_from:string,status:string,log:string>>>")
    d = last.select(doc.alias("d")).select("d.*")
    pair = lambda k, v: F.struct(F.lit(k).alias("param"), v.alias("value"))
    params = F.array(pair("wf_a", F.lit("old")), pair("zz", F.lit("1")), pair("x_loading", F.lit("q")), pair("wf_a", F.concat(F.lit("v"), F.col("id").cast("string"))))
    st = F.array(F.struct(F.lit("7").alias("stat_id"), F.lit("1").alias("value"), F.col("id").cast("string").alias("loading_id"), F.lit("p").alias("profile"), F.lit("5").alias("entity_id")))
    n = J.loading_normalize(d.withColumn("params", params).withColumn("stats", st)).join(d.select("id", "status"), "id")
    at = F.element_at("status_last", F.col("status"))
    return n.select("id", "run_type", F.element_at("params", "wf_a").alias("wf_a"), F.element_at("params", "x_loading").alias("x_loading"),
                    F.size("params").cast("bigint").alias("n_params"), at.alias("last_of_status"),
                    F.element_at("status_last", F.lit("START")).alias("last_of_start"), F.element_at("status_log", at).alias("log_text"))


@query("workflow_normalize", """
SELECT p_partkey AS id, 'b' AS wf_a, p_brand AS mail, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n_events,
  CASE WHEN p_size % 2 = 0 THEN p_size % 3 = 0 ELSE NULL END AS first_on, CASE WHEN p_size % 2 = 0 THEN NULL ELSE true END AS text_on FROM part""")
def _(t):
    two = lambda a, b, x, y: F.struct(x.alias(a), y.alias(b))
    size = F.col("p_size")
    ev = F.array(
        F.struct(F.lit("p").alias("profile"), F.lit("1").alias("entity_id"), F.lit("2").alias("stat_id"), (size % 3 == 0).alias("active")),
        F.struct(F.lit("p").alias("profile"), F.lit("3").alias("entity_id"), F.lit("2").alias("stat_id"), F.lit(None).cast("boolean").alias("active")))
    docs = t.part.select(
        F.col("p_partkey").alias("id"),
        F.array(two("param", "prior_value", F.lit("wf_a"), F.lit("a")), two("param", "prior_value", F.lit("wf_event_sched"), F.lit("t/9/9, ,")),
                two("param", "prior_value", F.lit("wf_a"), F.lit("b"))).alias("param"),
        F.array(two("status", "emails", F.lit("ERROR"), F.col("p_brand"))).alias("statusNotifications"),
        F.when(size % 2 == 0, ev).alias("wf_event_sched"))
    n = J.workflow_normalize(docs)
    return n.select("id", F.element_at("params", "wf_a").alias("wf_a"), F.element_at("notifications", "ERROR").alias("mail"),
                    F.size("events").cast("bigint").alias("n_events"), F.element_at("events", "p/1/2").alias("first_on"), F.element_at("events", "t/9/9").alias("text_on"))


@query("journal_lookup", f"""
SELECT loading_id, beg_ts::VARCHAR AS beg_ts, end_id, msg FROM {I.RUNS_SQL} WHERE end_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY loading_id ORDER BY beg_ts DESC, end_id DESC) = 1""")
def _(t):
    return J.journal_lookup(J.control_log(I.run_journal(t))).select("loading_id", "beg_ts", "end_id", S.field("end_msg", "msg").alias("msg"))


@query("safe_casts", """
SELECT event_id, TRY_CAST(nullif(x, '') AS BIGINT) AS as_int, TRY_CAST(nullif(y, '') AS TIMESTAMP)::VARCHAR AS as_ts,
  json_valid(z) AS is_json, CASE WHEN json_valid(z) THEN CAST(z->>'k' AS BIGINT) END AS k
FROM (SELECT event_id, CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'n' || user_id ELSE CAST(user_id AS VARCHAR) END AS x,
  CASE user_id % 2 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'never' END AS y,
  CASE event_type WHEN 'error' THEN substr(props, 2) ELSE props END AS z FROM events)""")
def _(t):
    u = F.col("user_id")
    e = t.events.select(
        "event_id", F.when(u % 3 == 0, "").when(u % 3 == 1, F.concat(F.lit("n"), u.cast("string"))).otherwise(u.cast("string")).alias("x"),
        F.when(u % 2 == 0, I.sec(F.col("ts"))).otherwise("never").alias("y"),
        F.when(F.col("event_type") == "error", F.expr("substring(props, 2)")).otherwise(F.col("props")).alias("z"))
    return e.select("event_id", S.try_int("x").alias("as_int"), S.try_timestamp("y").alias("as_ts"), S.is_valid_json("z").alias("is_json"),
                    F.try_variant_get(S.try_json("z"), "$.k", "bigint").alias("k"))
