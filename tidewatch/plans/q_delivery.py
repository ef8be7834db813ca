"""Delivery queue and receipt queries."""

from pyspark.sql import functions as F

from tidewatch.operators import delivery as D
from tidewatch.plans.registry import query

AS_OF = "2001-08-01 12:00:00"
RECEIPT = "Receipt"


def sent(t):
    """Orders as files of monthly packages, each in two versions."""
    k = F.col("o_orderkey")
    at = F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)")
    base = t.orders.select(
        F.concat(F.lit("u"), k.cast("string")).alias("rq_uid"), F.concat(F.lit("f"), k.cast("string"), F.when(k % 50 == 0, ".TKT").otherwise(".zip")).alias("file_name"),
        F.when(F.col("o_custkey") % 11 != 0, F.concat(F.lit("r"), (F.col("o_custkey") % 5).cast("string"))).alias("replica"), F.substring("o_orderpriority", 1, 1).alias("scenario_id"),
        F.when(k % 13 != 0, F.date_trunc("month", "o_orderdate")).alias("package_ts"), at.alias("created_at"), F.lit(None).cast("timestamp").alias("notified_at"), at.alias("updated_at"), "o_orderkey")
    done = base.filter("o_orderkey % 3 <> 0").withColumn("notified_at", F.expr("created_at + interval 5 minutes")).withColumn("updated_at", F.expr("created_at + interval 5 minutes"))
    return base.unionByName(done).drop("o_orderkey")


_SENT = """s AS (SELECT 'u' || o_orderkey AS rq_uid, 'f' || o_orderkey || CASE WHEN o_orderkey % 50 = 0 THEN '.TKT' ELSE '.zip' END AS file_name, CASE WHEN o_custkey % 11 <> 0 THEN 'r' || (o_custkey % 5) END AS replica, substr(o_orderpriority, 1, 1) AS scenario_id,
  CASE WHEN o_orderkey % 13 <> 0 THEN date_trunc('month', o_orderdate)::TIMESTAMP END AS package_ts, o_orderdate + to_seconds(o_orderkey % 86400) AS created_at,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + to_seconds(o_orderkey % 86400) + INTERVAL 5 MINUTE END AS notified_at, o_orderkey, o_custkey FROM orders),
p AS (SELECT * FROM s WHERE notified_at IS NULL)"""


@query("queue_pending", f"WITH {_SENT} SELECT rq_uid, file_name, replica, scenario_id, created_at::VARCHAR AS created_at FROM p")
def _(t):
    return D.queue_pending(sent(t)).select("rq_uid", "file_name", "replica", "scenario_id", "created_at")


def rules(t):
    """Pause rules by region number: one replica, one route, packages of two months, one that ran out."""
    r = F.col("r_regionkey")
    ts = lambda x: F.lit(x).cast("timestamp")
    return t.region.select(
        F.when(r == 0, "replicas").when(r == 1, "scenarios").when(r < 4, "packages").otherwise("scenarios").alias("scope"),
        F.when(r == 0, "r1").when(r == 1, "3").when(r == 2, "r2__20010701000000").when(r == 3, "r1__20000101000000").otherwise("4").alias("key"),
        (ts(AS_OF) - F.make_dt_interval(hours=r * 3 + 1)).alias("since"), F.when(r == 1, ts("2001-09-01 00:00:00")).when(r == 4, ts("2001-01-01 00:00:00")).alias("until"),
        F.when(r != 3, F.col("r_name")).alias("reason"), F.when(r == 2, 4).otherwise(0).alias("alerted_h"))


_PAUSE = """CASE WHEN replica = 'r2' AND package_ts = TIMESTAMP '2001-07-01' THEN 'пакет r2__20010701000000 на паузе — ' || (SELECT r_name FROM region WHERE r_regionkey = 2)
  WHEN replica = 'r1' AND package_ts = TIMESTAMP '2000-01-01' THEN 'пакет r1__20000101000000 на паузе'
  WHEN replica = 'r1' THEN 'реплика r1 на паузе — ' || (SELECT r_name FROM region WHERE r_regionkey = 0)
  WHEN scenario_id = '3' THEN 'маршрут 3 на паузе до 2001-09-01 00:00:00 — ' || (SELECT r_name FROM region WHERE r_regionkey = 1) END"""


def _split(t):
    return D.split_paused(D.queue_pending(sent(t)), rules(t), AS_OF)


@query("split_paused", f"WITH {_SENT} SELECT rq_uid, {_PAUSE} AS pause_reason FROM p")
def _(t):
    return _split(t).select("rq_uid", "pause_reason")


@query("pause_summary", f"WITH {_SENT} SELECT pause_reason, count(*) AS held FROM (SELECT {_PAUSE} AS pause_reason FROM p) WHERE pause_reason IS NOT NULL GROUP BY 1")
def _(t):
    return D.pause_summary(_split(t)).select("pause_reason", "held")


@query("pause_active", "SELECT r_regionkey::BIGINT AS r_regionkey FROM region WHERE r_regionkey < 4")
def _(t):
    a = D.pause_active(rules(t), AS_OF)
    return a.select(
        F.when(F.col("key") == "r1", 0).when(F.col("scope") == "scenarios", 1).when(F.col("reason").isNull(), 3).otherwise(2).alias("r_regionkey"))


@query("pause_alerts", f"""WITH {_SENT}, h AS (SELECT CASE left({_PAUSE}, 5) WHEN 'пакет' THEN CASE replica WHEN 'r2' THEN 2 ELSE 3 END WHEN 'репли' THEN 0 WHEN 'маршр' THEN 1 END AS k, count(*) AS held FROM p GROUP BY 1)
SELECT key, hours, threshold::BIGINT AS threshold, hard, coalesce(held, 0) AS held FROM (VALUES (0, 'r1', 1.0::DOUBLE, 1, true), (1, '3', 4.0::DOUBLE, 4, false), (3, 'r1__20000101000000', 10.0::DOUBLE, 8, true)) v(k, key, hours, threshold, hard) LEFT JOIN h USING (k)""")
def _(t):
    return D.pause_alerts(rules(t), D.pause_summary(_split(t)), AS_OF).drop("scope")


@query("order_queue", f"""WITH {_SENT}, o AS (SELECT rq_uid, replica, package_ts, created_at, file_name LIKE '%.TKT' AS is_ticket, min(created_at) OVER (PARTITION BY replica, package_ts) AS package_start FROM p)
SELECT rq_uid, replica, is_ticket, package_start::VARCHAR AS package_start, row_number() OVER (PARTITION BY replica, package_ts ORDER BY is_ticket, created_at, rq_uid) AS position FROM o""")
def _(t):
    return D.order_queue(D.queue_pending(sent(t))).select("rq_uid", "replica", "is_ticket", "package_start", "position")


_COUNT_AT = "2001-07-20 23:00:00"
_COUNTS = f"""c AS (SELECT scenario_id, count(*) FILTER (WHERE notified_at > TIMESTAMP '{_COUNT_AT}' - INTERVAL 1 SECOND) AS sec, count(*) FILTER (WHERE notified_at > TIMESTAMP '{_COUNT_AT}' - INTERVAL 1 MINUTE) AS min,
  count(*) FILTER (WHERE notified_at > TIMESTAMP '{_COUNT_AT}' - INTERVAL 1 HOUR) AS hour, count(*) AS day FROM s WHERE notified_at > TIMESTAMP '{_COUNT_AT}' - INTERVAL 1 DAY AND notified_at <= TIMESTAMP '{_COUNT_AT}' GROUP BY 1)"""
_LIMITS = {"sec": 5, "min": 4, "hour": 3, "day": 3}


def _counts(t):
    return D.sent_counts(sent(t), _COUNT_AT)


@query("sent_counts", f"WITH {_SENT}, {_COUNTS} SELECT * FROM c")
def _(t):
    return _counts(t)


_BUDGET = "b AS (SELECT *, least(5 - sec, 4 - min, 3 - hour, 3 - day) AS free FROM c)"
_BLOCK = "CASE WHEN free > 0 THEN '' WHEN 5 - sec = free THEN 'sec' WHEN 4 - min = free THEN 'min' WHEN 3 - hour = free THEN 'hour' ELSE 'day' END"


@query("send_budget", f"WITH {_SENT}, {_COUNTS}, {_BUDGET} SELECT scenario_id, greatest(free, 0) AS allowed, {_BLOCK} AS blocked FROM b")
def _(t):
    return D.send_budget(_counts(t), _LIMITS).select("scenario_id", "allowed", "blocked")


@query("plan_batch", f"""WITH {_SENT}, {_COUNTS}, {_BUDGET}, o AS (SELECT *, min(created_at) OVER (PARTITION BY replica, package_ts) AS package_start FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY package_ts NULLS FIRST, package_start NULLS FIRST, replica NULLS FIRST, file_name LIKE '%.TKT', created_at, rq_uid) AS position FROM o)
SELECT scenario_id, rq_uid, position FROM r LEFT JOIN b USING (scenario_id) WHERE position <= CASE WHEN free IS NULL THEN 3 ELSE greatest(free, 0) END""")
def _(t):
    return D.plan_batch(D.queue_pending(sent(t)), _counts(t), _LIMITS).select("scenario_id", "rq_uid", "position")


@query("queue_stall", f"""WITH {_SENT}, {_COUNTS}, {_BUDGET}, f AS (SELECT scenario_id, min(created_at) AS oldest, count(*) AS waiting FROM (SELECT *, {_PAUSE} AS pr FROM p) WHERE pr IS NULL GROUP BY 1)
SELECT scenario_id, oldest::VARCHAR AS oldest, waiting, CAST(floor(epoch(TIMESTAMP '{AS_OF}' - oldest) / 60) AS BIGINT) AS wait_min, coalesce(CASE WHEN free IS NULL THEN '' ELSE {_BLOCK} END, '') AS blocked FROM f LEFT JOIN b USING (scenario_id)""")
def _(t):
    return D.queue_stall(_split(t), _counts(t), AS_OF, 30, _LIMITS)


@query("unknown_routes", f"WITH {_SENT} SELECT CASE WHEN scenario_id = '5' THEN '' ELSE scenario_id END AS scenario_id, count(*) AS rows FROM p WHERE scenario_id NOT IN ('1', '3') GROUP BY 1")
def _(t):
    q = D.queue_pending(sent(t)).withColumn("scenario_id", F.when(F.col("scenario_id") != "5", F.col("scenario_id")))
    known = q.filter("scenario_id in ('1', '3')")
    return D.unknown_routes(q, known)


# --- receipts: line items as files of an order ----------------------------------------------------

def messages(t, lay=lambda lines: lines):
    """XML receipts from order lines: plain, with prefixes, two documents in one, without files, broken; files at several depths, closing tags in comments and CDATA, additional statuses.

    ``lay`` deals and orders the lines before they become texts, which are ten times as long.
    """
    li = lay(t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.max("l_shipdate").alias("at")))
    s = lambda c: F.col(c).cast("string")
    name = F.when(F.col("p") % 15 == 0, F.concat(F.lit("<![CDATA[a&"), s("l_linenumber"), F.lit("]]>"))).otherwise(F.concat(F.lit("a&amp;"), s("l_linenumber")))
    aside = F.when(F.col("p") % 3 == 0, f"<!-- </{RECEIPT}> <{RECEIPT}> -->").when(F.col("p") % 3 == 1, f"<Note><![CDATA[</{RECEIPT}>]]></Note>").otherwise("")
    doc = lambda files, p: F.concat(
        F.lit(f"<{p}{RECEIPT} xmlns{':' + p[:-1] if p else ''}=\"urn:x\"><{p}RqUID>u"), s("l_orderkey"), F.lit(f"</{p}RqUID><{p}RqTm>"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit(f".123456789+03:00</{p}RqTm><{p}ScenarioInfo><{p}ScenarioId>s1</{p}ScenarioId></{p}ScenarioInfo>"), aside, files, F.lit(f"</{p}{RECEIPT}>"))
    more = lambda p: F.when(F.col("p") % 4 == 0, f"<{p}AdditionalStatus><{p}StatusCode>601</{p}StatusCode><{p}StatusDesc>e</{p}StatusDesc></{p}AdditionalStatus>").otherwise("")
    deep = lambda p, f: F.when(F.col("p") % 6 == 0, F.concat(F.lit(f"<{p}Files><{p}Part>"), f, F.lit(f"</{p}Part></{p}Files>"))).otherwise(f)
    file = lambda p, n: deep(p, F.concat(
        F.lit(f"<{p}File><{p}FileInfo><{p}Name>"), n, F.lit(f"</{p}Name></{p}FileInfo><{p}Status><{p}StatusCode>"), F.when(F.col("p") % 50 == 0, "7").otherwise("0"),
        F.lit(f"</{p}StatusCode><{p}StatusDesc>d</{p}StatusDesc>"), more(p), F.lit(f"</{p}Status></{p}File>")))
    two = F.concat(file("", name), file("", F.concat(name, F.lit("b"))))
    kind = F.col("p") % 5
    xml = (F.when(kind == 0, F.concat(F.lit("<?xml version=\"1.0\"?>"), doc(two, ""))).when(kind == 1, doc(file("n:", name), "n:"))
           .when(kind == 2, F.concat(doc(file("", name), ""), F.lit("\n"), doc(file("", F.concat(name, F.lit("c"))), ""))).when(kind == 3, doc(F.lit("<!-- <File><Name>no</Name></File> -->"), ""))
           .when(F.col("p") % 2 == 0, doc(F.concat(file("", name), F.lit("<Bad>")), "")).otherwise(F.lit("<broken")))
    return li.select(F.col("l_orderkey").alias("msg_id"), F.col("l_linenumber").alias("part_no"), F.col("at").alias("received_at"), xml.alias("raw_xml"))


_MSG = """g AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, max(l_shipdate) AS rcv FROM lineitem GROUP BY ALL),
rc AS (SELECT l_orderkey AS msg_id, l_linenumber::BIGINT AS part_no, rcv, CASE WHEN p % 5 = 4 THEN '' ELSE 'u' || l_orderkey END AS rq_uid, CASE WHEN p % 5 < 3 THEN 'a&' || l_linenumber || sfx ELSE '' END AS file_name,
  CASE WHEN p % 5 > 2 THEN -1 WHEN p % 50 = 0 THEN 7 ELSE 0 END AS status_code, CASE WHEN p % 5 < 3 THEN CASE WHEN p % 4 = 0 THEN 'd | [601] e' ELSE 'd' END ELSE '' END AS status_desc, CASE WHEN p % 5 < 4 THEN rcv - INTERVAL 3 HOUR + INTERVAL 123456 MICROSECOND END AS rq_tm
  FROM (SELECT *, unnest(CASE p % 5 WHEN 0 THEN ['', 'b'] WHEN 2 THEN ['', 'c'] ELSE [''] END) AS sfx FROM g))"""


@query("parse_receipt", f"WITH {_MSG} SELECT msg_id, part_no, rq_uid, file_name, CAST(status_code AS BIGINT) AS status_code, status_desc, rq_tm::VARCHAR AS rq_tm FROM rc")
def _(t):
    return D.parse_receipt(messages(t), RECEIPT).select("msg_id", "part_no", "rq_uid", "file_name", "status_code", "status_desc", "rq_tm")


_LATEST = "rl AS (SELECT * FROM rc QUALIFY row_number() OVER (PARTITION BY rq_uid, file_name ORDER BY rcv DESC, status_code DESC) = 1)"


@query("receipts_upsert", f"WITH {_MSG}, {_LATEST} SELECT rq_uid, file_name, CAST(status_code AS BIGINT) AS status_code, rcv::VARCHAR AS received_at FROM rl")
def _(t):
    return D.receipts_latest(D.parse_receipt(messages(t), RECEIPT)).select("rq_uid", "file_name", "status_code", "received_at")


@query("package_confirm", f"""WITH {_SENT}, {_MSG}, {_LATEST}, b AS (SELECT rq_uid, bool_or(status_code <> 0) AS bad FROM rl GROUP BY 1),
x AS (SELECT replica, package_ts, count(*) AS files, count(*) FILTER (WHERE bad) AS bad, count(bad) AS answered, count(*) FILTER (WHERE bad IS NULL AND notified_at IS NULL) AS not_sent, count(*) FILTER (WHERE bad IS NULL AND notified_at IS NOT NULL) AS no_answer
  FROM s LEFT JOIN b USING (rq_uid) GROUP BY ALL)
SELECT replica, package_ts::VARCHAR AS package_ts, files, bad, answered, not_sent, no_answer, CASE WHEN bad > 0 THEN 'rejected' WHEN answered = files THEN 'confirmed' WHEN not_sent > 0 THEN 'not_sent' ELSE 'no_answer' END AS state FROM x""")
def _(t):
    s = sent(t)
    files = s.select("replica", "package_ts", "rq_uid").distinct()
    return D.package_confirm(files, s, D.parse_receipt(messages(t), RECEIPT), ["replica", "package_ts"])


@query("stale_sent", f"""WITH {_SENT}, {_MSG} SELECT rq_uid, file_name, CAST(floor(epoch(TIMESTAMP '{AS_OF}' - notified_at) / 60) AS BIGINT) AS waiting_min FROM s
WHERE notified_at < TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTE AND rq_uid NOT IN (SELECT rq_uid FROM rc)""")
def _(t):
    return D.stale_sent(sent(t), D.parse_receipt(messages(t), RECEIPT), AS_OF, 60).select("rq_uid", "file_name", "waiting_min")


@query("missing_objects", f"WITH {_SENT} SELECT scenario_id, file_name FROM s WHERE (scenario_id, o_orderkey) NOT IN (SELECT (substr(o_orderpriority, 1, 1), o_orderkey) FROM orders WHERE o_custkey % 2 = 0)")
def _(t):
    names = sent(t).select("scenario_id", "file_name").distinct()
    k = F.col("o_orderkey")
    listing = t.orders.filter("o_custkey % 2 = 0").select(F.substring("o_orderpriority", 1, 1).alias("scenario_id"),
                                                          F.concat(F.lit("f"), k.cast("string"), F.when(k % 50 == 0, ".TKT").otherwise(".zip")).alias("file_name"))
    return D.missing_objects(names, listing, ["scenario_id", "file_name"])


@query("multi_file_receipts", f"WITH {_MSG} SELECT rq_uid, count(DISTINCT file_name) AS files FROM rc GROUP BY 1 HAVING count(DISTINCT file_name) > 1")
def _(t):
    return D.multi_file_receipts(D.parse_receipt(messages(t), RECEIPT))
