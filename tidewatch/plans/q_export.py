"""Delta export queries."""

from pyspark.sql import functions as F

from tidewatch.operators import export as E
from tidewatch.plans import inputs as I
from tidewatch.plans.registry import query

AS_OF = I.ORDERS_AS_OF


def history(t):
    """One state per order: customer = extract, order date = reached time, a second version for some."""
    o = t.orders.select(
        F.concat(F.lit("r"), (F.col("o_custkey") % 3).cast("string")).alias("replica"), F.substring("o_orderpriority", 1, 1).alias("schema_name"),
        F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("extract_name"), F.col("o_orderdate").alias("extract_time"), "o_orderkey",
        F.col("o_orderkey").alias("extract_count"), F.col("o_orderdate").alias("loaded"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("sent"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("confirmed"),
        (F.col("o_custkey") % 4 * 60).alias("increment"), (F.col("o_custkey") % 5 * 30).alias("overlap"), F.col("o_orderdate").alias("updated_at"))
    # Orders of one day are versions of one state: the highest order number is the newest.
    return o.withColumn("updated_at", F.expr("updated_at + make_dt_interval(0, 0, 0, o_orderkey / 1000000.0)")).drop("o_orderkey")


_HIST = """h AS (SELECT 'r' || (o_custkey % 3) AS replica, substr(o_orderpriority, 1, 1) AS schema_name, 't' || o_custkey AS extract_name, o_orderdate AS extract_time, o_orderkey AS extract_count,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS sent, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS confirmed, o_custkey % 4 * 60 AS increment, o_custkey % 5 * 30 AS overlap FROM orders),
vr AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY replica, schema_name, extract_name, extract_time ORDER BY extract_count DESC) = 1),
st AS (SELECT *, count(*) OVER (PARTITION BY replica, schema_name, extract_name) AS states FROM vr QUALIFY row_number() OVER (PARTITION BY replica, schema_name, extract_name ORDER BY extract_time DESC) = 1)"""


@query("export_state", f"WITH {_HIST} SELECT replica, schema_name, extract_name, states, extract_time::VARCHAR AS extract_time, extract_count, sent::VARCHAR AS sent, confirmed::VARCHAR AS confirmed, increment FROM st")
def _(t):
    return E.export_state(history(t)).drop("loaded", "overlap")


_WIN = """w AS (SELECT *, extract_time - to_seconds(overlap) AS tf, CASE WHEN increment > 0 THEN extract_time + to_minutes(increment) ELSE TIMESTAMP '2001-08-01 02:00:00' END AS edge FROM st)"""


@query("next_window", f"WITH {_HIST}, {_WIN} SELECT replica, schema_name, extract_name, tf::VARCHAR AS time_from, least(edge, TIMESTAMP '2001-08-01 02:00:00')::VARCHAR AS time_to, edge >= TIMESTAMP '2001-08-01 02:00:00' AS is_current FROM w")
def _(t):
    return E.next_window(E.export_state(history(t)), "2001-08-01 02:00:00").select(*E.STATE_KEY, "time_from", "time_to", "is_current")


@query("delta_filter", "SELECT o_orderkey, o_custkey, o_orderdate::VARCHAR AS o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01' AND o_orderdate <= TIMESTAMP '2000-04-01'")
def _(t):
    return E.delta_filter(t.orders, "o_orderdate", "2000-01-01", "2000-04-01").select("o_orderkey", "o_custkey", "o_orderdate")


@query("delta_by_window", """SELECT o_orderkey, o_orderpriority FROM orders JOIN (SELECT o_orderpriority AS p, TIMESTAMP '2000-01-01' + to_days(30 * CAST(substr(o_orderpriority, 1, 1) AS INT)) AS f FROM orders GROUP BY ALL) ON p = o_orderpriority AND o_orderdate > f AND o_orderdate <= f + INTERVAL 30 DAY""")
def _(t):
    start = F.expr("timestamp'2000-01-01' + make_dt_interval(30 * cast(substr(o_orderpriority, 1, 1) as int))")
    w = t.orders.select("o_orderpriority").distinct().withColumn("time_from", start).withColumn("time_to", F.expr("time_from + interval 30 days"))
    return E.delta_by_window(t.orders, "o_orderdate", w, "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query("recent_window", "SELECT event_id, ts::VARCHAR AS ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-15 00:00:00' AND TIMESTAMP '2024-01-16 12:00:00'")
def _(t):
    return E.recent_rows(t.events, "ts", "2024-01-16 12:00:00", 36).select("event_id", "ts")


@query("period_window", """SELECT o_orderkey, e AS error, e IS NULL AND s AS writes_state, CASE WHEN e IS NULL THEN t::VARCHAR END AS new_extract_time
FROM (SELECT *, CASE WHEN f IS NULL THEN 'both bounds are needed' WHEN t <= f THEN 'end is not after start' WHEN s AND t <= o_orderdate THEN 'state may only move forward' WHEN s AND t > TIMESTAMP '2001-08-02' THEN 'state may not move into the future' END AS e
  FROM (SELECT o_orderkey, o_orderdate, o_custkey % 2 = 0 AND o_orderstatus <> 'P' AS s, CASE WHEN o_custkey % 7 <> 0 THEN o_orderdate - INTERVAL 40 DAY END AS f, o_orderdate + to_days(CAST(o_custkey % 100 - 45 AS INT)) AS t FROM orders))""")
def _(t):
    r = t.orders.select(
        "o_orderkey", F.col("o_orderdate").alias("extract_time"), (F.col("o_custkey") % 2 == 0).alias("shift_state"),
        F.when(F.col("o_orderstatus") == "P", "full").otherwise("delta").alias("mode"),
        F.when(F.col("o_custkey") % 7 != 0, F.expr("o_orderdate - interval 40 days")).alias("date_from"),
        F.expr("o_orderdate + make_dt_interval(cast(o_custkey % 100 - 45 as int))").alias("date_to"))
    return E.period_window(r, AS_OF).select("o_orderkey", "error", "writes_state", "new_extract_time")


@query("source_start", """SELECT c_custkey, count(o_orderkey) AS rows, (min(o_orderdate) FILTER (WHERE year(o_orderdate) >= 2000) - INTERVAL 1 SECOND)::VARCHAR AS start,
  CASE WHEN max(o_orderdate) >= TIMESTAMP '2000-01-01' THEN 'ok' ELSE 'error' END AS status FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def _(t):
    return E.source_start(t.orders.withColumnRenamed("o_custkey", "c_custkey"), "o_orderdate", ["c_custkey"])


@query("history_append", f"""WITH {_HIST}, {_WIN} SELECT replica, schema_name, extract_name, least(edge, TIMESTAMP '2001-08-01 02:00:00')::VARCHAR AS extract_time, length(extract_name) AS extract_count,
  CASE WHEN length(extract_name) % 2 = 0 THEN '2001-08-01 02:00:00' END AS sent, tf::VARCHAR AS time_from FROM w WHERE schema_name <> '1'""")
def _(t):
    w = E.next_window(E.export_state(history(t)), "2001-08-01 02:00:00")
    n = F.length("extract_name")
    res = w.filter("schema_name <> '1'").select(*E.STATE_KEY, n.alias("extract_count"), (n % 2 == 0).alias("sent_ok"))
    return E.history_append(w, res, "2001-08-01 02:00:00").select(*E.STATE_KEY, "extract_time", "extract_count", "sent", "time_from")


def config(t):
    """Export settings from parts: brand = replica, size = group, part = extract; one default row per group from the small keys."""
    s = F.col("p_size")
    ext = t.part.select(
        F.col("p_brand").alias("replica"), F.when(s % 6 == 0, F.lit(" ")).otherwise((s % 6).cast("string")).alias("dag_group"), F.lit("sch").alias("schema_name"),
        F.concat(F.lit("t"), (F.col("p_partkey") % 40).cast("string")).alias("extract_name"), (s % 9 != 0).alias("is_active"), (s % 4 == 0).alias("is_paused"),
        F.when(s % 10 == 0, F.lit("0 1 * * *")).alias("schedule"))
    g = t.part.groupBy(F.col("p_brand").alias("replica"), (s % 6).alias("g")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("k"))
    d = g.filter("n % 5 <> 1").select(
        "replica", F.when(F.col("g") == 0, F.lit(None).cast("string")).otherwise(F.col("g").cast("string")).alias("dag_group"), F.when(F.col("n") % 5 == 2, F.lit("x")).alias("schema_name"),
        F.lit(None).cast("string").alias("extract_name"), (F.col("k") % 7 != 0).alias("is_active"), (F.col("k") % 3 == 0).alias("is_paused"),
        F.when(F.col("k") % 4 == 0, F.lit(None).cast("string")).when(F.col("k") % 4 == 1, F.lit("every day")).when(F.col("k") % 4 == 2, F.lit("@daily")).otherwise(F.lit("30 2 * * *")).alias("schedule"))
    return ext.unionByName(d)


_CONF = """x AS (SELECT p_brand AS replica, (p_size % 6)::VARCHAR AS dag_group, 't' || (p_partkey % 40) AS extract_name, p_size % 4 = 0 AS paused, p_size % 10 = 0 AS own FROM part WHERE p_size % 9 <> 0),
gg AS (SELECT p_brand AS replica, (p_size % 6)::VARCHAR AS dag_group, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY ALL),
dd AS (SELECT *, k % 7 <> 0 AS active, k % 3 = 0 AS gp FROM gg WHERE n % 5 <> 1),
r AS (SELECT x.*, d.n, d.k, coalesce(d.gp, false) AS gp FROM x LEFT JOIN dd d USING (replica, dag_group) WHERE coalesce(d.active, true)),
own_err AS (SELECT DISTINCT replica, dag_group, CASE WHEN n IS NULL THEN 'no default row' WHEN n % 5 = 2 THEN 'schema on the default row' WHEN k % 4 = 0 THEN 'no schedule' WHEN k % 4 = 1 THEN 'invalid schedule' END AS error FROM r),
lv AS (SELECT replica, extract_name, dag_group, bool_and(paused OR gp) AS p FROM r GROUP BY ALL),
cf AS (SELECT replica, extract_name, count(*) AS groups, count(*) FILTER (WHERE NOT p) AS active, array_to_string(list(dag_group ORDER BY dag_group), ',') AS names FROM lv GROUP BY ALL HAVING count(*) > 1),
er AS (SELECT * FROM own_err WHERE error IS NOT NULL UNION ALL SELECT DISTINCT r.replica, r.dag_group, 'extract active in several groups' FROM r JOIN cf ON cf.replica = r.replica AND cf.extract_name = r.extract_name AND active > 1 WHERE NOT (paused OR gp))"""


@query("resolve_groups", f"WITH {_CONF} SELECT replica, dag_group, extract_name, paused AS is_paused, gp AS group_paused FROM r")
def _(t):
    return E.resolve_groups(config(t)).select("replica", "dag_group", "extract_name", "is_paused", F.coalesce("group_paused", F.lit(False)).alias("group_paused"))


@query("state_conflicts", f"WITH {_CONF} SELECT replica, extract_name, groups, active, names, CASE WHEN active > 1 THEN 'error' ELSE 'warning' END AS level FROM cf")
def _(t):
    r = E.resolve_groups(config(t)).withColumn("is_paused", F.col("is_paused") | F.coalesce("group_paused", F.lit(False)))
    return E.state_conflicts(r).drop("schema_name").withColumn("names", F.array_join("names", ","))


@query("group_errors", f"WITH {_CONF} SELECT * FROM er")
def _(t):
    return E.group_errors(E.resolve_groups(config(t)))


@query("group_warnings", f"WITH {_CONF} SELECT replica, dag_group, extract_name FROM r WHERE own")
def _(t):
    return E.group_warnings(E.resolve_groups(config(t))).drop("warning")


@query("runnable_extracts", f"WITH {_CONF} SELECT replica, dag_group, extract_name FROM r WHERE (replica, dag_group) NOT IN (SELECT (replica, dag_group) FROM er)")
def _(t):
    return E.runnable(E.resolve_groups(config(t))).select("replica", "dag_group", "extract_name")


@query("layered_params", """SELECT p_partkey, p_size::BIGINT AS own, CASE WHEN p_size % 2 = 0 THEN 'gzip' ELSE p_type END AS compression, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS file_size FROM part""")
def _(t):
    s = F.col("p_size")
    name = F.concat(F.lit("e"), F.col("p_partkey").cast("string"))
    rows = t.part.select(name.alias("name"), "p_partkey", s.alias("own"), F.when(s % 2 == 0, F.lit("Default")).otherwise(F.col("p_type")).alias("compression"),
                         F.when(s % 3 == 0, F.lit("default")).otherwise(F.col("p_brand")).alias("file_size"))
    base = t.region.filter("r_regionkey = 0").select(F.lit("default").alias("name"), F.lit(0).cast("bigint"), F.lit(0), F.lit("gzip"), F.lit("DEFAULT"))
    return E.layered_params(rows.union(base), "name", ["p_partkey", "own"], ["compression", "file_size"]).drop("name")


@query("group_params", f"WITH {_CONF} SELECT replica, dag_group, extract_name, CASE WHEN own THEN '0 1 * * *' ELSE CASE k % 4 WHEN 1 THEN 'every day' WHEN 2 THEN '@daily' WHEN 3 THEN '30 2 * * *' END END AS schedule FROM r")
def _(t):
    c = E._normal_groups(config(t))
    d = c.filter("_default")
    return E.group_params(E.resolve_groups(config(t)).select("replica", "dag_group", "extract_name", "schedule"), d, ["schedule"])


@query("auto_confirm", f"WITH {_HIST} SELECT replica, schema_name, extract_name, extract_time::VARCHAR AS extract_time, '2001-08-02 00:00:00' AS confirmed FROM vr WHERE sent IS NOT NULL AND confirmed IS NULL")
def _(t):
    return E.auto_confirm(history(t), [*E.STATE_KEY, "extract_time"], AS_OF).select(*E.STATE_KEY, "extract_time", "confirmed")


@query("config_diff", """SELECT p_partkey, f AS field, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN f = 'p_size' THEN p_size::VARCHAR ELSE p_brand END AS was, CASE f WHEN 'p_size' THEN (p_size + (p_partkey % 2))::VARCHAR ELSE CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END END AS now
FROM part CROSS JOIN (SELECT unnest(['p_size', 'p_brand']) AS f) WHERE p_partkey % 10 = 0 OR (f = 'p_size' AND p_partkey % 2 = 1) OR (f = 'p_brand' AND p_partkey % 3 = 0)""")
def _(t):
    k = F.col("p_partkey")
    new = t.part.select("p_partkey", (F.col("p_size") + (k % 2).cast("int")).alias("p_size"), F.when(k % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("p_brand"))
    return E.config_diff(t.part.filter("p_partkey % 10 <> 0"), new, "p_partkey", ["p_size", "p_brand", "p_type"])


@query("stuck_state", f"WITH {_HIST} SELECT replica, schema_name, extract_name, extract_time::VARCHAR AS extract_time FROM st WHERE length(extract_name) <> 3 AND extract_time < TIMESTAMP '2000-01-01'")
def _(t):
    st = E.export_state(history(t))
    cfg = st.select(*E.STATE_KEY, (F.length("extract_name") == 3).alias("full_export"), F.lit(None).cast("boolean").alias("is_recent"))
    return E.stuck_state(cfg, st).select(*E.STATE_KEY, "extract_time")


@query("service_columns", "SELECT '2001-08-02 00:00:00' AS export_time, n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, 'I' AS ctl_action, '2001-08-02 00:00:00' AS ctl_validfrom FROM nation")
def _(t):
    return E.service_columns(t.nation, AS_OF)


@query("row_limit", "SELECT CAST(12 AS BIGINT) AS test_rows, (SELECT count(*) FROM orders) AS prod_rows, (SELECT count(*) FROM orders) AS unlimited_rows")
def _(t):
    n = lambda df, a: df.agg(F.count("*").alias(a))
    return n(E.row_limit(t.orders, "test", 12), "test_rows").crossJoin(n(E.row_limit(t.orders, "prod", 12), "prod_rows")).crossJoin(n(E.row_limit(t.orders, "test", 0), "unlimited_rows"))


@query("lag_report", f"WITH {_HIST} SELECT replica, schema_name, extract_name, CAST(epoch(TIMESTAMP '2001-08-01' - extract_time) // 60 AS BIGINT) AS lag_min, sent IS NOT NULL AND confirmed IS NULL AS waits_receipt, confirmed::DATE = DATE '2001-08-01' AS confirmed_today FROM st")
def _(t):
    return E.lag_report(E.export_state(history(t)), "2001-08-01").drop("extract_time")
