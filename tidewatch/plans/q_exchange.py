"""Package exchange queries."""

from pyspark.sql import functions as F, types as T

from tidewatch.operators import exchange as X
from tidewatch.plans import inputs as I
from tidewatch.plans.registry import query
from tidewatch.session import scratch_dir
from tidewatch.sources import flows as L
from tidewatch.operators.common import CheckFailed


def _src(t):
    """Orders with integer and text fields only, so that documents have one spelling."""
    return t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").alias("ts"))


_DUE_SQL = """due AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE o_orderdate::DATE > DATE '2000-01-01' OR o_orderdate > TIMESTAMP '2001-07-30'
  UNION SELECT o_orderdate::DATE FROM orders WHERE o_custkey % 100 = 1)"""
_BODY_SQL = "body AS (SELECT DISTINCT 'orders' AS wf_name, o_orderdate::DATE::VARCHAR AS wf_key, '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\",\"o_orderpriority\":\"' || o_orderpriority || '\"}' AS wf_data FROM orders WHERE o_orderdate::DATE IN (SELECT d FROM due))"


def _increment(t):
    retry = t.orders.filter("o_custkey % 100 = 1").select(F.lit("orders").alias("wf_name"), F.to_date("o_orderdate").cast("string").alias("wf_key"))
    inc = X.exchange_increment(_src(t), "orders", "ts", "2000-01-01", "2001-07-30", retry)
    # The time column is the key already.
    doc = F.from_json("wf_data", "struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>")
    return inc.withColumn("wf_data", F.to_json(doc))


@query("exchange_increment", f"WITH {_DUE_SQL}, {_BODY_SQL} SELECT * FROM body")
def _(t):
    return _increment(t)


@query("exchange_package", f"""WITH {_DUE_SQL}, {_BODY_SQL},
srv AS (SELECT '_exchange_log' AS wf_name, '0000000042' AS wf_key, '{{"type":"count","wf_name":"orders","cnt":' || count(*) || ',"key_min":"' || min(o_orderdate)::DATE || '","key_max":"' || max(o_orderdate)::DATE || '"}}' AS wf_data FROM orders
  UNION ALL SELECT '_exchange_log', '0000000042', '{{"type":"config","wf_name":"' || r_name || '"}}' FROM region),
al AS (SELECT * FROM body UNION ALL SELECT * FROM srv),
m AS (SELECT wf_name, wf_key, count(*) AS cnt, sum(length(wf_data)) AS sl, min(length(wf_data)) AS mn, max(length(wf_data)) AS mx FROM al GROUP BY ALL),
x AS (SELECT 'OUT' AS type, * FROM m UNION ALL SELECT 'SUM', '_exchange_log', '0000000042', count(*), sum(sl), min(mn), max(mx) FROM m)
SELECT * FROM al UNION ALL SELECT '_exchange_log', '0000000042', '{{"type":"' || type || '","wf_name":"' || wf_name || '","wf_key":"' || wf_key || '","cnt":' || cnt || ',"sum_len":' || sl || ',"min_len":' || mn || ',"max_len":' || mx || '}}' FROM x""")
def _(t):
    counts = X.source_count(_src(t), "orders", "ts")
    config = t.region.select(F.col("r_name").alias("wf_name"))
    return X.exchange_package([_increment(t)], counts, config, 42)


# --- exchange journal: packages of orders by (priority, package, year), sent and received entries ---

def _journal(t):
    """Two entries per (flow, id, key): what was sent and what arrived; some differ or are missing."""
    g = t.orders.groupBy(
        F.concat(F.lit("vw_"), F.substring("o_orderpriority", 1, 1)).alias("wf_name"), (F.col("o_custkey") % 40).alias("id"),
        F.year("o_orderdate").cast("string").alias("wf_key")).agg(F.count("*").alias("cnt"), F.sum("o_orderkey").alias("sum_len"))
    both = g.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    both = both.filter("not (side = 1 and cnt % 7 = 0)")
    cnt = F.col("cnt") + F.when((F.col("side") == 1) & (F.col("cnt") % 5 == 0), 1).otherwise(0)
    kind = F.when((F.col("id") == 3) & (F.col("side") == 1), "IN").otherwise("OUT")
    ts = F.lit("2001-08-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"), mins=F.col("side"))
    data = F.to_json(F.struct(kind.alias("type"), cnt.alias("cnt"), "sum_len", F.when(F.col("id") % 2 == 0, F.lit(1)).alias("min_len"),
                              F.lit(9).alias("max_len"), F.lit(1.5).alias("time")))
    return X.log_rows(both.select("id", ts.alias("ts"), "wf_name", "wf_key", data.alias("wf_data")))


_LOG_SQL = """
raw AS (SELECT * FROM (SELECT 'vw_' || substr(o_orderpriority, 1, 1) AS wf_name, o_custkey % 40 AS id, year(o_orderdate)::VARCHAR AS wf_key, count(*) AS c, sum(o_orderkey) AS sum_len FROM orders GROUP BY ALL)
  CROSS JOIN (SELECT unnest([0, 1]) AS side) WHERE NOT (side = 1 AND c % 7 = 0)),
ent AS (SELECT wf_name, id, wf_key, c + CASE WHEN side = 1 AND c % 5 = 0 THEN 1 ELSE 0 END AS cnt, sum_len, CASE WHEN id = 3 AND side = 1 THEN 'IN' ELSE 'OUT' END AS type,
  TIMESTAMP '2001-08-01' + to_hours(id) + to_minutes(side) AS ts FROM raw),
lg AS (SELECT wf_name, id, wf_key, type, min(cnt) AS cnt, CAST(min(sum_len) AS BIGINT) AS sum_len, count(*) * 1.5::DOUBLE AS time, min(ts) AS ts, count(*) = 2 AND min(cnt) = max(cnt) AS completed, max(cnt) AS hi, count(*) AS n FROM ent GROUP BY ALL)"""


@query("exchange_log", f"WITH {_LOG_SQL} SELECT wf_name, id, wf_key, type, cnt, sum_len, time, ts::VARCHAR AS ts, completed, CASE WHEN hi <> cnt THEN hi END AS other_cnt, CASE WHEN n <> 2 THEN n END AS entries FROM lg")
def _(t):
    lg = X.exchange_log(_journal(t))
    doc = F.from_json("wf_data", "struct<cnt:bigint,count:bigint>")
    return lg.select("wf_name", "id", "wf_key", "type", "cnt", "sum_len", "time", "ts", "completed", doc["cnt"].alias("other_cnt"), doc["count"].alias("entries"))


@query("last_completed", f"WITH {_LOG_SQL} SELECT wf_name, wf_key AS last_key FROM lg WHERE type = 'OUT' AND completed QUALIFY row_number() OVER (PARTITION BY wf_name ORDER BY id DESC, wf_key DESC) = 1")
def _(t):
    return X.last_completed(X.exchange_log(_journal(t)))


def _loadings(t):
    """State of the loads behind the packages, one per package number."""
    g = t.orders.select((F.col("o_custkey") % 40).alias("id")).distinct().filter("id % 4 <> 2")
    return g.select("id", F.when(F.col("id") % 4 == 0, "ACTIVE").otherwise("COMPLETED").alias("alive"), F.when(F.col("id") % 3 == 0, "ERROR").otherwise("SUCCESS").alias("status"),
                    F.lit("2001-08-01 00:00:00").cast("timestamp").alias("status_dttm"), F.lit(True).alias("auto"), F.lit("x").alias("status_log"))


_ALIVE = "CASE id % 4 WHEN 2 THEN NULL WHEN 0 THEN 'ACTIVE' ELSE 'COMPLETED' END"
_STATUS = "CASE WHEN id % 4 = 2 THEN NULL WHEN id % 3 = 0 THEN 'ERROR' ELSE 'SUCCESS' END"
_RETRY_SQL = f"""(nullif({_ALIVE}, 'ACTIVE') IN ('COMPLETED', 'ABORTED') AND ({_STATUS} <> 'SUCCESS' OR NOT completed)) OR (NOT completed AND ts < TIMESTAMP '2001-08-01 23:30:00')"""


@query("exchange_log_ids", f"""WITH {_LOG_SQL}, g AS (SELECT wf_name, id, bool_and(completed) AS completed, max(ts) AS ts, count(*) AS keys_cnt, CAST(sum(cnt) AS BIGINT) AS cnt,
  array_to_string(list(wf_key ORDER BY wf_key DESC), ',') AS wf_keys FROM lg GROUP BY ALL)
SELECT wf_name, id, completed, ts::VARCHAR AS ts, keys_cnt, cnt, wf_keys, {_RETRY_SQL} AS retry FROM g""")
def _(t):
    g = X.exchange_log_ids(X.exchange_log(_journal(t)), _loadings(t), I.ORDERS_AS_OF)
    return g.select("wf_name", "id", "completed", "ts", "keys_cnt", "cnt", F.array_join("wf_keys", ",").alias("wf_keys"), "retry")


_PACKAGES_SQL = f"r AS (SELECT *, {_RETRY_SQL} AS retry FROM lg QUALIFY row_number() OVER (PARTITION BY wf_name, id, wf_key ORDER BY ts DESC, type) = 1)"


@query("exchange_log_keys", f"""WITH {_LOG_SQL}, {_PACKAGES_SQL}, i AS (SELECT wf_name, wf_key, count(*) AS ids_cnt, min(id) AS first_id FROM r GROUP BY ALL)
SELECT wf_name, wf_key, completed, retry, ts::VARCHAR AS last_ts, id AS last_id, ids_cnt, first_id, cnt FROM r JOIN i USING (wf_name, wf_key) WHERE completed OR retry IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY wf_name, wf_key ORDER BY id DESC) = 1""")
def _(t):
    k = X.exchange_log_keys(X.exchange_log(_journal(t)), _loadings(t), I.ORDERS_AS_OF)
    return k.select("wf_name", "wf_key", "completed", "retry", "last_ts", "last_id", "ids_cnt", "first_id", "cnt")


@query("exchange_key_packages", f"WITH {_LOG_SQL}, {_PACKAGES_SQL} SELECT wf_name, wf_key, id, completed, retry FROM r")
def _(t):
    return X.exchange_key_packages(X.exchange_log(_journal(t)), _loadings(t), I.ORDERS_AS_OF)


# --- received envelope: events and parts as JSON documents ----------------------------------------

def envelope(t):
    """(_gp_id, _gp_name, _gp_key, _gp_data); one field changes type, one is only ever null."""
    mixed = F.when(F.col("event_id") % 2 == 0, F.parse_json(F.col("user_id").cast("string"))).otherwise(F.parse_json(F.concat(F.lit('"u'), F.col("user_id").cast("string"), F.lit('"'))))
    ev = t.events.select(
        F.floor(F.col("event_id") / 100).cast("bigint").alias("_gp_id"), F.concat(F.lit("ev_"), "event_type").alias("_gp_name"), F.to_date("ts").cast("string").alias("_gp_key"),
        F.to_json(F.struct("event_id", I.sec(F.col("ts")).alias("ts"), mixed.alias("mixed"), F.lit(None).cast("string").alias("never"),
                           (F.col("user_id") % 2 == 0).alias("even"), F.array("user_id").alias("list")), {"ignoreNullFields": "false"}).alias("_gp_data"))
    pt = t.part.select(
        (F.col("p_size") % 9).cast("bigint").alias("_gp_id"), F.lit("parts").alias("_gp_name"), F.col("p_brand").alias("_gp_key"),
        F.to_json(F.struct(F.col("p_partkey"), F.col("p_name"), F.col("p_size").alias("bad name"))).alias("_gp_data"))
    log = t.region.select(F.lit(5).cast("bigint").alias("_gp_id"), F.lit("_exchange_log").alias("_gp_name"), F.lit("0000000005").alias("_gp_key"),
                          F.to_json(F.struct("r_name")).alias("_gp_data"))
    return ev.unionByName(pt).unionByName(log)


_ENV_SQL = """env AS (SELECT event_id // 100 AS _gp_id, 'ev_' || event_type AS _gp_name, ts::DATE::VARCHAR AS _gp_key, event_id AS row_id FROM events
  UNION ALL SELECT p_size % 9, 'parts', p_brand, p_partkey FROM part UNION ALL SELECT 5, '_exchange_log', '0000000005', r_regionkey FROM region)"""


@query("infer_flow_schema", f"""WITH {_ENV_SQL}, m AS (SELECT _gp_name, max(_gp_id) AS last_id FROM env GROUP BY 1),
f(kind, field, position, type) AS (VALUES ('ev', 'event_id', 1, 'Int64'), ('ev', 'ts', 2, 'String'), ('ev', 'mixed', 3, 'String'), ('ev', 'even', 5, 'Bool'), ('ev', 'list', 6, 'String'),
  ('pa', 'p_partkey', 1, 'Int64'), ('pa', 'p_name', 2, 'String'), ('pa', 'bad name', 3, 'Int64'), ('_e', 'r_name', 1, 'String'))
SELECT _gp_name, field, CAST(position AS BIGINT) AS position, type, last_id FROM m JOIN f ON substr(_gp_name, 1, 2) = kind""")
def _(t):
    return X.infer_flow_schema(envelope(t))


def _quoted(t):
    """The envelope as it lands: documents as JSON strings, everything twice, some in an older package."""
    e = envelope(t)
    q = F.replace(F.replace("_gp_data", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    land = e.withColumn("_gp_data", F.concat(F.lit('"'), q, F.lit('"')))
    return land.unionByName(land).unionByName(land.withColumn("_gp_id", F.col("_gp_id") - 1000))


@query("exchange_normalize", f"WITH {_ENV_SQL} SELECT _gp_name, _gp_key, _gp_id, '2001-08-02 00:00:00' AS _gp_ts, row_id FROM env")
def _(t):
    n = X.exchange_normalize(_quoted(t), I.ORDERS_AS_OF)
    region = F.regexp_extract("_gp_data", '"r_name":"([A-Z ]+)"', 1)
    names = t.region
    d = n.join(names, names.r_name == region, "left")
    doc = F.from_json("_gp_data", "struct<event_id:bigint,p_partkey:bigint>")
    return d.select("_gp_name", "_gp_key", "_gp_id", "_gp_ts", F.coalesce(doc["event_id"], doc["p_partkey"], F.col("r_regionkey").cast("bigint")).alias("row_id"))


def _load_entries(t):
    """Load journal: clicks were loaded up to the package with 5 in it, parts once long ago."""
    c = t.events.filter("event_type = 'click'").select(
        F.lit("ev_click").alias("wf_name"), F.to_timestamp(F.lit("2001-01-01")).alias("ts"), F.lit("IN_log").alias("wf_type"), (F.col("event_id") % 6).cast("string").alias("wf_key"))
    p = t.part.select(F.lit("parts").alias("wf_name"), F.to_timestamp(F.lit("2001-01-01")) + F.make_dt_interval(days=F.col("p_size")), F.lit("IN_log"), (F.col("p_size") % 4).cast("string"))
    return c.union(p)


@query("route_flows", f"""WITH {_ENV_SQL}, lst AS (SELECT 'ev_click' AS n, (SELECT max(event_id % 6) FROM events WHERE event_type = 'click') AS last_id
  UNION ALL SELECT 'parts', (SELECT max(p_size) % 4 FROM part)),
fr AS (SELECT env.* FROM env LEFT JOIN lst ON n = _gp_name WHERE _gp_id > coalesce(last_id, 0)),
sm AS (SELECT _gp_name, array_to_string(list_slice(list_sort(list(DISTINCT _gp_id)), 1, 10), ',') AS ids FROM fr GROUP BY 1)
SELECT _gp_name, count(*) AS row_cnt, min(_gp_id) AS min_id, max(_gp_id) AS max_id, count(DISTINCT _gp_id) AS cnt_id, min(_gp_key) AS min_key, max(_gp_key) AS max_key,
  count(DISTINCT _gp_key) AS cnt_key, any_value(ids) AS ids, CASE WHEN _gp_name LIKE '\\_%' ESCAPE '\\' THEN '_ignored' WHEN _gp_name IN ('ev_click', 'parts') THEN 'process_' || _gp_name ELSE '_other' END AS route
FROM fr JOIN sm USING (_gp_name) GROUP BY _gp_name""")
def _(t):
    r = X.route_flows(envelope(t), _load_entries(t), ["ev_click", "parts"], 10)
    return r.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("route_branches", "SELECT * FROM (SELECT DISTINCT CASE WHEN event_type = 'click' THEN 'process_ev_click' ELSE '_other' END AS route FROM events WHERE event_id // 100 > 5) UNION SELECT 'process_parts' FROM part")
def _(t):
    return X.route_branches(X.route_flows(envelope(t), _load_entries(t), ["ev_click", "parts"], 10))


_EV_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("even", T.BooleanType()), T.StructField("list", T.ArrayType(T.LongType()))])


def _target(t):
    env = envelope(t).filter("_gp_name = 'ev_view'").withColumn("_gp_ts", F.lit("2001-08-01 00:00:00").cast("timestamp")).withColumn("_gp_hash", F.md5("_gp_data"))
    old = X.typed_flow(env.filter("_gp_id < 5"), "ev_view", _EV_SCHEMA)
    return env.withColumn("_gp_ts", F.lit(I.ORDERS_AS_OF).cast("timestamp")), old


@query("process_flow", """SELECT event_id, date_trunc('second', ts)::VARCHAR AS ts, user_id % 2 = 0 AS even, user_id AS first, event_id // 100 AS _gp_id FROM events
WHERE event_type = 'view' AND event_id // 100 > (SELECT coalesce(max(event_id // 100), 0) FROM events WHERE event_type = 'view' AND event_id // 100 < 5)""")
def _(t):
    env, old = _target(t)
    return X.process_flow(env, "ev_view", _EV_SCHEMA, old).select("event_id", "ts", "even", F.col("list")[0].alias("first"), "_gp_id")


@query("apply_load", """WITH v AS (SELECT event_id, ts::DATE::VARCHAR AS k, event_id // 100 AS p FROM events WHERE event_type = 'view')
SELECT event_id, k AS _gp_key, p AS _gp_id FROM v WHERE p >= 5 OR k NOT IN (SELECT k FROM v WHERE p >= 5)""")
def _(t):
    env, old = _target(t)
    return X.apply_load(old, X.process_flow(env, "ev_view", _EV_SCHEMA, old), "delete").select("event_id", "_gp_key", "_gp_id")


# --- whole loads: a table with the first five packages, then a second run ----------------------------

FIRST, SECOND = "2001-08-01 00:00:00", I.ORDERS_AS_OF
_VIEWS_SQL = """v AS (SELECT event_id, ts::DATE::VARCHAR AS k, event_id // 100 AS p FROM events WHERE event_type = 'view'),
old AS (SELECT * FROM v WHERE p < 5), env AS (SELECT * FROM v WHERE p >= 3)"""


def _views(t, run_ts):
    return envelope(t).filter("_gp_name = 'ev_view'").withColumn("_gp_ts", F.lit(run_ts).cast("timestamp")).withColumn("_gp_hash", F.md5("_gp_data"))


def _announced(env, run_ts):
    """What the sender says about the rows of each package and key."""
    return env.groupBy(F.col("_gp_id").alias("id"), F.col("_gp_name").alias("name"), F.col("_gp_key").alias("key")).agg(F.count("*").alias("cnt")).withColumn(
        "type", F.lit("OUT")).withColumn("ts", F.lit(run_ts).cast("timestamp"))


def _loaded(t, clear=None, second=None, announced=None, schema="*"):
    """The table after both runs; the second one gets packages from 3 on unless told otherwise."""
    table = L.FlowTable(t.spark, scratch_dir(t.spark, "flow"))
    L.load_flow(_views(t, FIRST).filter("_gp_id < 5"), "ev_view", table, FIRST, _EV_SCHEMA)
    env = second if second is not None else _views(t, SECOND).filter("_gp_id >= 3")
    L.load_flow(env, "ev_view", table, SECOND, schema, clear, announced=announced, unique=["event_id"])
    return table


def _view_columns(df):
    return df.select("event_id", "ts", F.col("list")[0].alias("first"), "_gp_key", "_gp_id", "_gp_ts")


def _views_out(inner):
    return f"""SELECT o.event_id, date_trunc('second', e.ts)::VARCHAR AS ts, e.user_id AS first, k AS _gp_key, p AS _gp_id, run AS _gp_ts FROM ({inner}) o JOIN events e ON e.event_id = o.event_id"""


_GONE_SQL = f"""WITH {_VIEWS_SQL}, kept AS (SELECT * FROM old WHERE k NOT IN (SELECT k FROM env)) """ + _views_out(f"""SELECT *, '{FIRST}' AS run FROM kept
  UNION ALL SELECT *, '{SECOND}' FROM env WHERE p > coalesce((SELECT max(p) FROM kept), 0)""")


@query("load_flow_append", f"WITH {_VIEWS_SQL} " + _views_out(f"SELECT *, '{FIRST}' AS run FROM old UNION ALL SELECT *, '{SECOND}' FROM env WHERE p > (SELECT max(p) FROM old)"))
def _(t):
    env = _views(t, SECOND).filter("_gp_id >= 3")
    return _view_columns(_loaded(t, announced=_announced(env, SECOND)).read())


@query("load_flow_drop", _GONE_SQL)
def _(t):
    return _view_columns(_loaded(t, "drop").read())


@query("load_flow_delete", _GONE_SQL)
def _(t):
    return _view_columns(_loaded(t, "delete").read())


@query("load_flow_truncate", f"WITH {_VIEWS_SQL} " + _views_out(f"SELECT *, '{SECOND}' AS run FROM env WHERE p > 0"))
def _(t):
    return _view_columns(_loaded(t, "truncate").read())


@query("load_flow_final", f"WITH {_VIEWS_SQL} " + _views_out(f"""SELECT event_id, k, CASE WHEN p < 5 AND event_id % 2 = 0 THEN p + 100000 ELSE p END AS p,
  CASE WHEN p < 5 AND event_id % 2 = 1 THEN '{FIRST}' ELSE '{SECOND}' END AS run FROM v WHERE p <> 5"""))
def _(t):
    env = _views(t, SECOND)
    again = env.filter("_gp_id < 5").filter(F.get_json_object("_gp_data", "$.event_id").cast("bigint") % 2 == 0).withColumn("_gp_id", F.col("_gp_id") + 100000)
    return _view_columns(_loaded(t, "final", env.filter("_gp_id > 5").unionByName(again)).read())


@query("load_flow_refused", f"WITH {_VIEWS_SQL} " + _views_out(f"SELECT *, '{FIRST}' AS run FROM old"))
def _(t):
    """Counts and keys that a gate refuses leave the table as it was."""
    table = _loaded(t, second=_views(t, SECOND).filter("_gp_id < 3"))
    env = _views(t, SECOND).filter("_gp_id >= 3")
    for change in ({"announced": _announced(env, SECOND).withColumn("cnt", F.col("cnt") + 1)}, {"announced": _announced(env, FIRST)}, {"unique": ["even"]}):
        try:
            L.load_flow(env, "ev_view", table, SECOND, "*", "drop", **change)
        except CheckFailed:
            continue
        raise AssertionError("a gate let a wrong load pass")
    return _view_columns(table.read())


@query("load_flow_inferred", """SELECT p_partkey, p_name, p_size AS "bad name", p_brand AS _gp_key, CAST(p_size % 9 AS BIGINT) AS _gp_id FROM part""")
def _(t):
    table = L.FlowTable(t.spark, scratch_dir(t.spark, "flow"))
    env = envelope(t).withColumn("_gp_ts", F.lit(SECOND).cast("timestamp")).withColumn("_gp_hash", F.md5("_gp_data"))
    L.load_flow(env, "parts", table, SECOND)
    return table.read().drop("_gp_ts", "_gp_hash")


@query("load_flow_log", f"""WITH {_VIEWS_SQL}, n AS (SELECT * FROM env WHERE p > (SELECT max(p) FROM old)), al AS (SELECT * FROM old UNION ALL SELECT * FROM n)
SELECT 'ev_view' AS wf_name, 'IN_log' AS wf_type, p AS _gp_id, k AS _gp_key, count(*) AS cnt FROM n GROUP BY ALL
UNION ALL SELECT 'all', NULL, max(p), min(p)::VARCHAR, count(*) FROM al UNION ALL SELECT 'now', NULL, max(p), min(p)::VARCHAR, count(*) FROM n""")
def _(t):
    table = L.FlowTable(t.spark, scratch_dir(t.spark, "flow"))
    L.load_flow(_views(t, FIRST).filter("_gp_id < 5"), "ev_view", table, FIRST, _EV_SCHEMA)
    done = L.load_flow(_views(t, SECOND), "ev_view", table, SECOND)
    totals = done.totals.select(F.col("type").alias("wf_name"), F.lit(None).cast("string").alias("wf_type"), F.col("max_id").alias("_gp_id"), F.col("min_id").cast("string").alias("_gp_key"), F.col("row_cnt").alias("cnt"))
    return done.log.unionByName(totals)


@query("load_log", """SELECT 'ev_view' AS wf_name, 'IN_log' AS wf_type, event_id // 100 AS _gp_id, ts::DATE::VARCHAR AS _gp_key, count(*) AS cnt FROM events WHERE event_type = 'view' AND event_id // 100 >= 5 GROUP BY ALL""")
def _(t):
    env, old = _target(t)
    return X.load_log(X.apply_load(old, X.process_flow(env, "ev_view", _EV_SCHEMA, old)), "ev_view", I.ORDERS_AS_OF)


@query("load_totals", """WITH v AS (SELECT event_id // 100 AS p FROM events WHERE event_type = 'view')
SELECT 'all' AS type, count(*) AS row_cnt, min(p) AS min_id, max(p) AS max_id, '2001-08-01 00:00:00' AS min_ts, '2001-08-02 00:00:00' AS max_ts FROM v
UNION ALL SELECT 'now', count(*), min(p), max(p), '2001-08-02 00:00:00', '2001-08-02 00:00:00' FROM v WHERE p >= 5""")
def _(t):
    env, old = _target(t)
    return X.load_totals(X.apply_load(old, X.process_flow(env, "ev_view", _EV_SCHEMA, old)), I.ORDERS_AS_OF)


@query("sample_unknown", """SELECT CAST(s % 9 AS BIGINT) AS _gp_id, b AS _gp_key, f AS field, CASE f WHEN 'p_name' THEN 'String' ELSE 'Int64' END AS type, CASE f WHEN 'p_name' THEN n ELSE k::VARCHAR END AS value
FROM (SELECT p_size AS s, p_brand AS b, p_name AS n, p_partkey AS k FROM part ORDER BY p_size % 9, p_brand, '{"p_partkey":' || p_partkey || ',' LIMIT 15) CROSS JOIN (SELECT unnest(['p_partkey', 'p_name']) AS f)""")
def _(t):
    return X.sample_unknown(envelope(t), "parts", 15)


@query("drop_transferred", f"WITH {_ENV_SQL} SELECT _gp_name, _gp_id, count(*) AS n FROM env WHERE _gp_id NOT IN (SELECT p_size FROM part WHERE p_size % 2 = 0) GROUP BY ALL")
def _(t):
    main = t.part.filter("p_size % 2 = 0").select(F.col("p_size").cast("bigint").alias("_gp_id"))
    return X.drop_transferred(envelope(t), main).groupBy("_gp_name", "_gp_id").agg(F.count("*").alias("n"))


@query("transferred_packages", f"WITH {_ENV_SQL} SELECT DISTINCT _gp_id FROM env WHERE _gp_id IN (SELECT p_size FROM part WHERE p_size % 2 = 0)")
def _(t):
    return X.transferred_packages(envelope(t), t.part.filter("p_size % 2 = 0").select(F.col("p_size").cast("bigint").alias("_gp_id")))
