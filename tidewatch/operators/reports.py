"""Report sections over the control log, the load states and the size samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.scalars import col, readable, seconds_between
from tidewatch.operators.common import as_date, as_ts, latest_by_key, with_total

# Result codes with their counter and label.
RESULT_COUNTERS = {1: "cnt_ok", 0: "cnt_no_data", -1: "cnt_empty", -2: "cnt_canceled", -3: "cnt_expired", -4: "cnt_uniq",
                   -5: "cnt_ztest", -7: "cnt_ctl_err", -8: "cnt_pxf_err", -9: "cnt_error"}
RESULT_LABELS = {1: "Ok", 0: "No new", -1: "Empty", -2: "Canceled", -3: "Expire", -4: "Uniq", -5: "Ztest", -7: "CTL error", -8: "PXF error"}
PARTITION_NAME = "%_1_prt_%"
STORAGE_NAMES = {"a": "row", "c": "column", "h": "uncompress"}


def _mapped(c, names: dict, other: Column) -> Column:
    out = None
    for k, v in names.items():
        out = F.when(col(c) == k, v) if out is None else out.when(col(c) == k, v)
    return out.otherwise(other)


def storage_name(c) -> Column:
    return _mapped(c, STORAGE_NAMES, col(c))


def day_range(df: DataFrame, c: str, as_of, first: int, last: int) -> DataFrame:
    """Rows from day ``as_of + first`` up to, not including, day ``as_of + last``."""
    day = as_date(as_of)
    return df.filter((F.col(c) >= F.date_add(day, first).cast("timestamp")) & (F.col(c) < F.date_add(day, last).cast("timestamp")))


# --- sizes --------------------------------------------------------------------------------------------


def growth_stats(sizes: DataFrame, skew: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Newest against oldest sample of the last days per table: size and row growth per day, share of all.

    ``sizes``: tbl, load_date, size, rows, storage. ``skew``: tbl, ts, skew.
    """
    skew = skew.filter(~F.col("tbl").like(PARTITION_NAME))
    recent = day_range(sizes, "load_date", as_of, -days, 2)
    rec = F.struct("load_date", "size", "rows", "storage")
    g = recent.groupBy("tbl").agg(F.max(rec).alias("n"), F.min(rec).alias("o"))
    total = g.agg(F.sum("n.size").alias("total"))
    s = latest_by_key(skew, ["tbl"], [F.desc("ts"), F.desc("skew")]).select("tbl", F.round("skew", 2).alias("skew"))
    d = F.nullif(F.datediff("n.load_date", "o.load_date"), F.lit(0))
    g = g.crossJoin(F.broadcast(total)).join(s, "tbl", "left").select(
        "tbl", F.col("n.load_date").alias("load_date"), F.col("n.size").alias("size"), F.col("n.rows").alias("rows"), storage_name("n.storage").alias("storage"),
        (F.col("n.size") - F.col("o.size")).alias("size_delta"), (F.col("n.rows") - F.col("o.rows")).alias("rows_delta"), d.alias("days"), "total", "skew")
    return g.select(
        "*", F.expr("size_delta div days").alias("size_speed"), F.expr("rows_delta div days").alias("rows_speed"),
        F.round(F.col("size_delta") * 100.0 / F.col("days") / F.col("total"), 4).alias("speed_percent"),
        F.round(F.col("size") * 100.0 / F.col("total"), 4).alias("size_percent"), readable("size").alias("size_text"), readable("rows", 1000).alias("rows_text"))


def _last_samples(skew: DataFrame, as_of) -> DataFrame:
    # Both ends of the period belong to it.
    day = as_date(as_of)
    recent = skew.filter(~F.col("tbl").like(PARTITION_NAME) & F.col("ts").between(F.date_add(day, -30).cast("timestamp"), F.date_add(day, 1).cast("timestamp")))
    ratio = F.col("tbl_size") / F.nullif(F.col("data_size").cast("double"), F.lit(0.0))
    return latest_by_key(recent, ["tbl"], [F.desc("ts"), F.desc("tbl_size")]).withColumn("size_ratio", F.round(ratio, 2)).withColumn("storage", storage_name("storage"))


def skew_report(skew: DataFrame, as_of, top: int) -> DataFrame:
    """Tables with the largest size x skew^2 by their latest sample (top-k)."""
    weight = F.col("tbl_size") * F.coalesce(F.col("skew") * F.col("skew"), F.lit(1.0))
    return _last_samples(skew, as_of).withColumn("weight", weight).orderBy(F.desc("weight"), "tbl").limit(top)


def ratio_report(skew: DataFrame, as_of, top: int) -> DataFrame:
    """Tables that waste most space over their data (top-k)."""
    waste = F.col("tbl_size") - F.col("data_size")
    return _last_samples(skew, as_of).filter("data_size > 0").withColumn("waste", waste).orderBy(F.desc("waste"), "tbl").limit(top)


def uncompressed_report(skew: DataFrame, as_of, top: int) -> DataFrame:
    """Largest tables stored without compression (top-k)."""
    return _last_samples(skew, as_of).filter("storage = 'uncompress'").orderBy(F.desc("tbl_size"), "tbl").limit(top)


# --- control log --------------------------------------------------------------------------------------
# ``log``: beg_id, beg_ts, end_ts, duration (s), wf, category, loading_id, res, msg.


def day_summary(log: DataFrame, as_of, keys: list[str] = ["category"], first: int = -1, last: int = 0) -> DataFrame:  # noqa: B006
    """Loads of a day per category with a counter per result code (empty counters are NULL) and a total."""
    rows = day_range(log.filter(F.lower("wf").rlike("[a-z0-9]+_")), "beg_ts", as_of, first, last)
    counters = [F.nullif(F.count_if(F.col("res") == code), F.lit(0)).alias(name) for code, name in RESULT_COUNTERS.items()]
    return with_total(rows, keys, [F.count("*").alias("wf_cnt"), F.round(F.sum("duration"), 3).alias("sum_time"), F.round(F.max("duration"), 3).alias("max_dur"), *counters], "All")


def done_board(log: DataFrame, as_of) -> DataFrame:
    """Today's results by code, category and name prefix, with a total row."""
    rows = log.filter((F.col("beg_ts") >= as_date(as_of).cast("timestamp")) & (F.col("beg_ts") <= as_ts(as_of)) & F.col("wf").isNotNull() & F.col("res").isNotNull())
    rows = rows.withColumn("wf_prefix", F.regexp_extract(F.lower("wf"), "([a-zA-Z0-9]+)_", 1)).withColumn("res_msg", _mapped("res", RESULT_LABELS, F.lit("Error")))
    return with_total(rows, ["res_msg", "category", "wf_prefix"], [
        F.count("*").alias("cnt"), F.min("beg_ts").alias("min_beg"), F.max("end_ts").alias("max_end"), F.round(F.max("duration"), 3).alias("max_duration"),
        F.round(F.sum("duration"), 3).alias("sum_duration")])


def errors_merged(errors: DataFrame, as_of) -> DataFrame:
    """Error rows that were summed up earlier and raw ones summed up here.

    ``errors``: ts, obj, msg, first_ts, last_ts, cnt (NULL first_ts = raw row).
    """
    rows = day_range(errors, "ts", as_of, -1, 1)
    ready = rows.filter("first_ts is not null").select(F.lit("log").alias("src"), "first_ts", "last_ts", "cnt", "obj", "msg")
    raw = rows.filter("first_ts is null").groupBy("obj", "msg").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("cnt")).select(F.lit("tbl").alias("src"), "first_ts", "last_ts", "cnt", "obj", "msg")
    return ready.unionByName(raw)


SLOT_SECONDS = 600


def workload_slots(log: DataFrame, as_of) -> DataFrame:
    """Yesterday in 10-minute slots: distinct workflows and busy seconds.

    Each load is spread over the slots it touches, so slots and loads are never joined by range.
    """
    day = as_date(as_of)
    lo, hi = F.date_add(day, -1).cast("timestamp"), day.cast("timestamp")
    step = F.expr(f"interval {SLOT_SECONDS} seconds")
    rows = log.filter(F.col("loading_id").isNotNull() & F.col("end_ts").isNotNull() & (F.col("beg_ts") < hi) & (F.col("end_ts") > lo))
    floor = lambda t: F.timestamp_seconds(F.floor(F.unix_timestamp(t) / SLOT_SECONDS) * SLOT_SECONDS)
    rows = rows.withColumn("slot", F.explode(F.sequence(floor(F.greatest("beg_ts", lo)), floor(F.least("end_ts", hi - F.expr("interval 1 second"))), step)))
    rows = rows.filter((F.col("end_ts") > F.col("slot")) & (F.col("beg_ts") < F.col("slot") + step))
    busy = seconds_between(F.least(F.col("end_ts"), F.col("slot") + step), F.greatest("beg_ts", "slot"))
    per_wf = rows.withColumn("busy", busy).groupBy("slot", "wf").agg(F.sum("busy").alias("busy"))
    return per_wf.groupBy("slot").agg(F.count("wf").alias("wf"), F.sum("busy").alias("busy"))


def workload_10min(log: DataFrame, processes: DataFrame, as_of) -> DataFrame:
    """Yesterday's load as hours x six slots: distinct workflows and share of the busy processes.

    ``processes`` (beg_ts, processes): the number of parallel processes announced during the day.
    """
    hi = day_range(processes, "beg_ts", as_of, -1, 0).agg(F.max("processes").alias("most"))
    s = workload_slots(log, as_of).crossJoin(F.broadcast(hi))
    s = s.withColumn("rate", F.col("busy") / (SLOT_SECONDS * F.col("most")))
    out = []
    for m in range(0, 60, 10):
        here = F.minute("slot") == m
        out += [F.coalesce(F.max(F.when(here, F.col("wf"))), F.lit(0)).alias(f"cnt_{m:02d}"), F.round(F.coalesce(F.max(F.when(here, F.col("rate"))), F.lit(0.0)), 4).alias(f"rate_{m:02d}")]
    return s.groupBy(F.hour("slot").alias("hour")).agg(*out)


def workload_categories(log: DataFrame, as_of) -> DataFrame:
    """Categories at work in each hour of yesterday."""
    day = as_date(as_of)
    lo, hi = F.date_add(day, -1).cast("timestamp"), day.cast("timestamp")
    rows = log.filter(F.col("loading_id").isNotNull() & (F.col("beg_ts") < hi) & (F.col("end_ts") > lo))
    hours = F.explode(F.sequence(F.date_trunc("hour", F.greatest("beg_ts", lo)), F.date_trunc("hour", F.least("end_ts", hi - F.expr("interval 1 second"))), F.expr("interval 1 hour")))
    return rows.select("category", hours.alias("h")).distinct().groupBy(F.hour("h").alias("hour")).agg(F.array_sort(F.collect_set("category")).alias("categories"))


def with_last_ok(rows: DataFrame, log: DataFrame, skip_category: str | None = None) -> DataFrame:
    """Add the start of the last successful run of the same workflow."""
    good = log.filter("res = 1")
    if skip_category:
        good = good.filter(F.col("category") != skip_category)
    last = good.groupBy("wf").agg(F.max("beg_ts").alias("last_ok"))
    return rows.join(last, "wf", "left")


def errors_with_last_ok(log: DataFrame, as_of, skip_category: str | None = None) -> DataFrame:
    """Failures of yesterday with the last success of the workflow."""
    return with_last_ok(day_range(log, "end_ts", as_of, -1, 0).filter("res not in (1, 0)"), log, skip_category)


def _since_report_day(log: DataFrame, as_of) -> DataFrame:
    # Reports of the first hour still show the day before.
    return log.filter((F.col("end_ts") >= (as_ts(as_of) - F.expr("interval 1 hour")).cast("date").cast("timestamp")) & (F.col("end_ts") <= as_ts(as_of)))


def today_errors(log: DataFrame, as_of, skip_category: str | None = None) -> DataFrame:
    return with_last_ok(_since_report_day(log, as_of).filter("res not in (1, 0)"), log, skip_category)


def no_data(log: DataFrame, as_of, skip_category: str | None = None) -> DataFrame:
    """Loads without new data today with the last success."""
    return with_last_ok(_since_report_day(log, as_of).filter("res = 0"), log, skip_category)


def long_runs(log: DataFrame, as_of, minutes: int = 30, today: bool = False) -> DataFrame:
    """Loads of yesterday (or good ones of today) that took half an hour or more."""
    rows = _since_report_day(log, as_of).filter("res = 1") if today else day_range(log.filter("loading_id is not null"), "end_ts", as_of, -1, 0)
    return rows.filter(F.col("duration") >= minutes * 60)


def finished(log: DataFrame, as_of, first: int, last: int, res: list[int] | None = None, category: str | None = None) -> DataFrame:
    """Plain listing of finished loads of some days, by result and category."""
    rows = day_range(log.filter("loading_id is not null"), "end_ts", as_of, first, last)
    if res is not None:
        rows = rows.filter(F.col("res").isin(*res))
    return rows if category is None else rows.filter(F.col("category") == category)


def ok_today(log: DataFrame, as_of) -> DataFrame:
    return finished(log, as_of, 0, 1, [1])


def facts_today(log: DataFrame, as_of, category: str) -> DataFrame:
    return finished(log, as_of, 0, 1, None, category)


def all_today(log: DataFrame, as_of) -> DataFrame:
    return finished(log, as_of, 0, 1)


def all_yesterday(log: DataFrame, as_of) -> DataFrame:
    return finished(log, as_of, -1, 0)


# --- loads and catalog -----------------------------------------------------------------------------
# ``loads``: id, alive, status, status_dttm, start_dttm, end_dttm, profile, wf_id, status_log, auto, msg.
# ``catalog``: wf_id, name, category, wf_profile, scheduled, deleted, interval_s.


def with_catalog(loads: DataFrame, catalog: DataFrame) -> DataFrame:
    return loads.join(catalog, "wf_id", "left")


def day_board(loads: DataFrame, catalog: DataFrame, as_of) -> DataFrame:
    """Distinct workflows per category: active, done, by result, waited, late by one or two intervals, and a total."""
    since = (as_ts(as_of) - F.expr("interval 1 hour")).cast("date").cast("timestamp")
    rows = with_catalog(loads.filter((F.col("status_dttm") >= since) | (F.col("alive") == "ACTIVE")), catalog).filter("not deleted")
    age = seconds_between(as_ts(as_of), "status_dttm")
    res = F.try_variant_get(F.try_parse_json(F.when(F.col("status_log").startswith("{"), F.col("status_log"))), "$.res", "int")
    active = F.col("alive") == "ACTIVE"
    step = F.coalesce("interval_s", F.lit(86400))
    flags = {
        "active": active, "completed": F.col("alive") == "COMPLETED", "cnt_ok": res > 0, "cnt_no": res == 0, "cnt_err": res < 0,
        "seen": F.col("alive").isin("ACTIVE", "COMPLETED"), "delayed": active & age.between(step, step * 2), "expired": active & (age > step * 2)}
    # One row per (category, workflow) first: distinct counting without expanding rows per measure.
    per_wf = rows.groupBy("category", "wf_id").agg(*[F.bool_or(F.coalesce(f, F.lit(False))).alias(n) for n, f in flags.items()])
    per_cat = per_wf.groupBy("category").agg(*[F.count_if(n).alias(n) for n in flags]).withColumn("waited", F.col("seen") - F.col("completed")).drop("seen")
    measures = [c for c in per_cat.columns if c != "category"]
    empty = lambda c: F.nullif(F.col(c), F.lit(0)).alias(c)
    shown = per_cat.select("category", *[empty(c) for c in measures])
    # The total adds up the categories, which are few.
    return with_total(shown, ["category"], [F.sum(c).alias(c) for c in measures])


WAITING = ("EVENT-WAIT", "TIME-WAIT")


def old_and_working(loads: DataFrame, catalog: DataFrame, as_of, profile: str) -> DataFrame:
    """Active loads older than their interval, or doing something else than waiting."""
    rows = with_catalog(loads.filter("alive = 'ACTIVE'"), catalog).filter(F.col("wf_profile") == profile)
    age = seconds_between(as_ts(as_of), "start_dttm")
    return rows.filter((age > F.coalesce("interval_s", F.lit(86400))) | ~F.col("status").isin(*WAITING)).withColumn("status_age", seconds_between(as_ts(as_of), "status_dttm"))


def not_scheduled(catalog: DataFrame, archive: str) -> DataFrame:
    """Workflows off schedule that are neither deleted nor archived."""
    return catalog.filter(~F.coalesce("scheduled", F.lit(False)) & ~F.coalesce("deleted", F.lit(False)) & (F.coalesce("category", F.lit("")) != archive))


def catalog_board(catalog: DataFrame, loads: DataFrame) -> DataFrame:
    """Flows per category and profile: scheduled, not, deleted, waiting and running ones."""
    live = loads.filter("alive = 'ACTIVE'").groupBy("wf_id").agg(
        F.bool_or(F.col("status").isin(*WAITING)).alias("waiting"), F.bool_or(~F.col("status").isin(*WAITING)).alias("running"))
    gone, on = F.coalesce("deleted", F.lit(False)), F.coalesce("scheduled", F.lit(False))
    return catalog.join(live, "wf_id", "left").groupBy("category", "wf_profile").agg(
        F.count("*").alias("flows"), F.count_if(on & ~gone).alias("scheduled"), F.count_if(~on & ~gone).alias("not_scheduled"), F.count_if(gone).alias("deleted"),
        F.count_if("waiting").alias("waiting"), F.count_if("running").alias("running"))


def active_loads(loads: DataFrame, catalog: DataFrame, as_of) -> DataFrame:
    """Active loads that do not just wait for an event, with their age."""
    return with_catalog(loads.filter("alive = 'ACTIVE' and status <> 'EVENT-WAIT'"), catalog).withColumn("status_age", seconds_between(as_ts(as_of), "status_dttm"))


STATUS_ENTRIES = "struct<loading_status:array<struct<effective_from:string,status:string,log:string>>>"


def _entries(loads: DataFrame) -> Column:
    return F.from_json("msg", STATUS_ENTRIES)["loading_status"]


def event_trace(loads: DataFrame, catalog: DataFrame, as_of) -> DataFrame:
    """Status entries of the loads finished yesterday, numbered per load."""
    rows = with_catalog(day_range(loads.filter("alive <> 'ACTIVE'"), "status_dttm", as_of, -1, 0), catalog)
    # Sorting the short list inside the row numbers the entries without a window.
    return rows.select("id", "alive", "wf_id", "name", F.posexplode(F.array_sort(_entries(rows))).alias("p", "e")).select(
        "id", "alive", "wf_id", "name", (F.col("p") + 1).alias("nn"), F.col("e.effective_from").cast("timestamp").alias("status_dttm"), F.col("e.status").alias("status"), F.col("e.log").alias("log"))


def first_running(loads: DataFrame) -> Column:
    """Earliest RUNNING entry of a load."""
    running = F.filter(_entries(loads), lambda e: e["status"] == "RUNNING")
    return F.array_min(F.transform(running, lambda e: e["effective_from"])).try_cast("timestamp")


def _timed(rows: DataFrame) -> DataFrame:
    run = first_running(rows)
    return rows.withColumn("wait_s", seconds_between(run, "start_dttm")).withColumn("run_s", seconds_between("status_dttm", run))


def flow_last(loads: DataFrame, catalog: DataFrame, packages: DataFrame, as_of, category: str) -> DataFrame:
    """Newest finished load per exchange flow with waiting and running time and its package totals.

    ``packages``: id, keys_cnt, cnt, sum_len, completed, retry.
    """
    rows = day_range(loads.filter(~F.col("status").isin(*WAITING, "ABORTED") & (F.col("alive") != "ACTIVE")), "status_dttm", as_of, -7, 1)
    rows = rows.join(catalog.filter(F.col("category") == category), "wf_id")
    return _timed(latest_by_key(rows, ["wf_id"], [F.desc("id")])).join(packages, "id", "left")


def flow_errors(loads: DataFrame, catalog: DataFrame, packages: DataFrame, as_of, category: str) -> DataFrame:
    """Loads of exchange flows within a week that failed or left a package incomplete."""
    rows = day_range(loads.filter("alive <> 'ACTIVE'"), "status_dttm", as_of, -7, 1).join(catalog.filter(F.col("category") == category), "wf_id")
    rows = _timed(rows).join(packages, "id", "left")
    return rows.filter((F.col("status") != "SUCCESS") | ~F.coalesce("completed", F.lit(True)))


def logged_last(packages: DataFrame, as_of) -> DataFrame:
    """Newest package per flow within a week. ``packages``: wf_name, id, ts, completed, retry ..."""
    return latest_by_key(day_range(packages, "ts", as_of, -7, 1), ["wf_name"], [F.desc("ts"), F.desc("id")])


def logged_errors(packages: DataFrame, as_of) -> DataFrame:
    """Packages within a week that are incomplete or wait for a retry."""
    return day_range(packages, "ts", as_of, -7, 1).filter(~F.col("completed") | F.coalesce("retry", F.lit(False)))


def external_last(log: DataFrame) -> DataFrame:
    """Newest run per (workflow, start action, end action) of an external tool."""
    return latest_by_key(log, ["workflow", "start_action", "end_action"], [F.desc("start_ts"), F.desc("start_id")])


def external_log(log: DataFrame, as_of, days: int = 7) -> DataFrame:
    return day_range(log, "start_ts", as_of, -days, 1)


def external_day_errors(loads: DataFrame, catalog: DataFrame, as_of, category: str) -> DataFrame:
    """Failed loads of an external category: ended within a day, or still open within a month."""
    rows = loads.filter("status = 'ERROR'").join(catalog.filter(F.col("category") == category), "wf_id")
    ended = seconds_between(as_ts(as_of), "end_dttm") < 86400
    open_ = (F.col("alive") == "ACTIVE") & (F.col("status_dttm") > F.add_months(as_ts(as_of), -1))
    return rows.filter(ended | open_)


def external_yesterday(loads: DataFrame, catalog: DataFrame, as_of, category: str) -> DataFrame:
    return day_range(loads, "status_dttm", as_of, -1, 0).join(catalog.filter(F.col("category") == category), "wf_id")


def ztest_errors(view: DataFrame, as_of) -> DataFrame:
    """Newest z-test per object when it failed within the last day."""
    rows = view.filter((F.col("ts") > as_ts(as_of) - F.expr("interval 1 day")) & (F.col("ts") <= as_ts(as_of)))
    return latest_by_key(rows, ["object"], [F.desc("ts"), F.desc("key_date")]).filter("not ztest_ok")


def engine_errors(errors: DataFrame, as_of, skip_call: str) -> DataFrame:
    """Error call chains of yesterday but those of the logger itself. ``errors``: dt, last_call, ..."""
    return day_range(errors, "dt", as_of, -1, 0).filter(F.coalesce("last_call", F.lit("")) != skip_call)


# Grading thresholds per measure, the strictest first (label, lower bound).
GRADES = {
    "duration": [("red", 7200), ("pink", 3600), ("LemonChiffon", 1800)],
    "event_age": [("salmon", 172800), ("pink", 43200), ("LemonChiffon", 21600)],
    "status_age": [("salmon", 172800), ("pink", 86400), ("gold", 43200), ("yellow", 21600), ("LemonChiffon", 10800)],
    "rate": [("salmon", 0.75), ("orange", 0.60), ("gold", 0.45), ("yellow", 0.30), ("LemonChiffon", 0.15)],
}
OPEN_GRADES = {"event_age", "status_age"}


def grade(measure: str, value) -> Column:
    """Threshold label of a value; ages in seconds must exceed the bound, the others may equal it."""
    v = col(value)
    out = None
    for label, bound in GRADES[measure]:
        hit = v > bound if measure in OPEN_GRADES else v >= bound
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def freshness_grade(df: DataFrame, ts_col: str, as_of, measure: str = "event_age") -> DataFrame:
    return df.withColumn("grade", grade(measure, seconds_between(as_ts(as_of), ts_col)))
