"""Decisions about loads: readiness, retries, monitoring, alerts - for all loads in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.scalars import best_effort_timestamp, col, is_valid_json, try_int
from tidewatch.operators.common import as_date, as_ts
from tidewatch.operators.rules import Rule, rule_values
from tidewatch.session import truncate_lineage

STAT_KEY = ["profile", "entity_id", "stat_id"]
FRESH_MINUTES = 30


def minutes(n) -> Column:
    return F.make_dt_interval(mins=F.lit(n) if not isinstance(n, Column) else n)


def plus_seconds(ts, seconds) -> Column:
    return F.timestamp_micros(F.unix_micros(col(ts)) + col(seconds).cast("bigint") * 1_000_000)


# --- waiting for events -----------------------------------------------------------------------------


def _events(waits: DataFrame, last_stat: DataFrame) -> DataFrame:
    """Waits (load_id, strategy, start_ts, events) as one row per event with its last publication."""
    e = waits.select(
        *[c for c in waits.columns if c != "events"], F.posexplode_outer("events").alias("pos", "e"))
    e = e.withColumn("profile", F.col("e.profile")).withColumn("entity_id", F.col("e.entity_id")).withColumn(
        "stat_id", F.col("e.stat_id")).withColumn("active", F.col("e.profile").isNotNull() & F.coalesce(F.col("e.active"), F.lit(True))).drop("e")
    return e.join(last_stat.select(*STAT_KEY, "published"), STAT_KEY, "left")


def event_ready(waits: DataFrame, last_stat: DataFrame, as_of) -> DataFrame:
    """Does a waiting load start: events are read in list order and the first decisive one wins.

    A value younger than half an hour means "still changing, wait". Nothing decisive: all-of
    starts, any-of keeps waiting; without active events a load waits.
    """
    is_and = F.col("strategy") == "and"
    published, start = F.col("published"), F.col("start_ts")
    outcome = (
        F.when(~F.col("active"), None)
        .when(published > as_ts(as_of) - minutes(FRESH_MINUTES), "wait")
        .when(is_and & (published.isNull() | (published < start)), "wait")
        .when(~is_and & (published >= start), "ready"))
    e = _events(waits.fillna({"strategy": "or"}), last_stat).withColumn("outcome", outcome)
    # Few events per load: one small group each, combined map-side.
    g = e.groupBy("load_id", "strategy").agg(
        F.min_by("outcome", F.when(F.col("outcome").isNotNull(), F.col("pos"))).alias("first"), F.bool_or("active").alias("any_active"))
    default = F.when(is_and, "ready").otherwise("wait")
    return g.select("load_id", F.when(~F.col("any_active"), "wait").otherwise(F.coalesce("first", default)).alias("decision"))


def event_expire(waits: DataFrame, last_stat: DataFrame) -> DataFrame:
    """All-of waits with an expiry: ``expire_at`` is the oldest publication that still counts.

    Some expired and some ready: wait on; all expired: abort with -99; otherwise go.
    """
    applies = F.col("expire_at").isNotNull() & (F.col("strategy") == "and") & F.col("run_type").isin("EVENT-WAIT", "AF-EVENT")
    e = _events(waits.fillna({"strategy": "or"}).withColumn("applies", applies), last_stat)
    late = F.col("published").isNull() | (F.col("published") < F.col("expire_at"))
    g = e.groupBy("load_id", "applies").agg(
        F.bool_or(F.col("active") & late).alias("expired"), F.bool_or(F.col("active") & ~late).alias("ready"))
    status = F.when(~F.col("applies"), "ok").when(F.col("expired") & F.col("ready"), "EVENT-WAIT").when(F.col("expired"), "ERROR").otherwise("ok")
    return g.select("load_id", status.alias("status"), F.when(status == "ERROR", -99).alias("res"))


def condition_ready(nodes: DataFrame, as_of, max_depth: int | None = None) -> DataFrame:
    """Time a condition tree became (or becomes) true, per load.

    ``nodes``: loading, node, parent, depth, type (and / or / leaf kinds), satisfied, satisfied_at,
    valid_till (epoch in seconds or milliseconds), next_at (known next time of a schedule leaf).
    Trees are folded level by level from the deepest; there are as many steps as levels.
    """
    till = F.when(F.col("valid_till") > 100_000_000_000, F.col("valid_till") / 1000).otherwise(F.col("valid_till"))
    closed = F.coalesce(till < F.unix_timestamp(as_ts(as_of)), F.lit(False))
    leaf = F.when(F.col("satisfied"), F.when(~closed, F.col("satisfied_at"))).otherwise(
        F.when(F.col("type") == "cronExpression", F.col("next_at")))
    inner = F.col("type").isin("and", "or")
    values = nodes.select("loading", "node", "parent", "depth", "type", F.when(~inner, leaf).alias("at"))
    if max_depth is None:
        # One number from a map-side aggregate.
        max_depth = values.agg(F.max("depth")).first()[0] or 0
    done = values.filter(F.col("depth") == max_depth)
    for depth in range(max_depth, 0, -1):
        up = done.groupBy("loading", "parent").agg(
            F.count("*").alias("_n"), F.count("at").alias("_k"), F.max("at").alias("_last"), F.min("at").alias("_first")
        ).withColumnRenamed("parent", "node")
        level = values.filter(F.col("depth") == depth - 1).join(up, ["loading", "node"], "left")
        at = (
            F.when(F.col("type") == "and", F.when(F.col("_n") == F.col("_k"), F.col("_last")))
            .when(F.col("type") == "or", F.col("_first")).otherwise(F.col("at")))
        done = level.withColumn("at", at).select(*values.columns)
    return done.filter("depth = 0").select("loading", F.col("at").alias("ready_at"))


def wait_until(log, condition_time=None, has_condition=None, schedule_next=None) -> Column:
    """When a sleeping load starts: own log, condition, old text form, schedule (without condition)."""
    text = F.trim(F.coalesce(col(log), F.lit("")))
    own = F.when(text.startswith("{"), F.substring(F.nullif(F.regexp_extract(text, r"""['"]time['"]\s*:\s*['"]([^'"]+)['"]""", 1), F.lit("")), 1, 19))
    old = F.substring(F.nullif(F.regexp_extract(text, r"^Start scheduled on (.+)", 1), F.lit("")), 1, 19)
    tries = [best_effort_timestamp(own)]
    if condition_time is not None:
        tries.append(col(condition_time))
    tries.append(best_effort_timestamp(old))
    if schedule_next is not None:
        tries.append(F.when(~F.coalesce(col(has_condition), F.lit(False)), col(schedule_next)))
    return F.coalesce(*tries)


RETRY = "struct<`try`:int,left:int,delay:string,add:string,on:array<string>>"


def _retry_doc(text) -> Column:
    """Retry settings inside a text: JSON or single-quoted, bare or under "retry"."""
    body = F.replace(F.regexp_extract(F.coalesce(col(text), F.lit("")), r"(?s)(\{.*\})", 1), F.lit("'"), F.lit('"'))
    # An empty document, not an empty text: parsing must always give a struct.
    body = F.when(body == "", F.lit("{}")).otherwise(body)
    doc = F.from_json(body, f"struct<retry:{RETRY},`try`:int,left:int,delay:string,add:string,on:array<string>>")
    bare = F.struct(doc["try"].alias("try"), doc["left"].alias("left"), doc["delay"].alias("delay"), doc["add"].alias("add"), doc["on"].alias("on"))
    chosen = F.when(doc["retry"].isNotNull(), doc["retry"]).otherwise(bare)
    return F.when(F.coalesce(chosen["try"], F.lit(0)) > 0, chosen)


def ready_to_start(loads: DataFrame, as_of) -> DataFrame:
    """Loads (id, status, log): a due sleeper starts with try+1 and left-1, a future one is skipped."""
    at = wait_until("log")
    sleeping = F.col("status") == "TIME-WAIT"
    retry = _retry_doc("log")
    decision = F.when(~sleeping, "ok").when(at.isNull(), "fail").when(at <= as_ts(as_of), "ok").otherwise("skip")
    out = loads.withColumn("wait_until", at).withColumn("decision", decision).withColumn("is_new", ~sleeping)
    resumed = (F.col("decision") == "ok") & sleeping
    return out.withColumn("try", F.when(resumed, retry["try"] + 1)).withColumn(
        "left", F.when(resumed & retry.isNotNull(), F.greatest(F.coalesce(retry["left"], F.lit(0)) - 1, F.lit(0))))


def retry_config(loads: DataFrame) -> DataFrame:
    """Retry settings of a load: explicit, parameter, log text, built from numbers, fault tolerance.

    Columns: explicit, wfp_retry, log (texts), wf_retry_cnt, wf_retry_delay, wf_retry_add, wf_retry_on,
    num_attempts, retry_delay_ms.
    """
    none = F.lit(None).cast("string")
    on = F.filter(F.transform(F.split(F.lower("wf_retry_on"), ","), lambda x: F.trim(x)), lambda x: x != "")
    make = lambda left, delay, add: F.struct(F.lit(1).alias("try"), left.cast("int").alias("left"), delay.alias("delay"), add.alias("add"), on.alias("on"))
    cnt = F.coalesce(try_int("wf_retry_cnt"), F.lit(1))
    built = F.when(cnt > 1, make(cnt - 1, F.col("wf_retry_delay"), F.col("wf_retry_add")))
    ms = F.col("retry_delay_ms")
    delay = F.when(F.coalesce(ms, F.lit(0)) > 0, F.concat(F.lit("seconds=+"), F.expr("retry_delay_ms div 1000").cast("string")))
    tolerant = F.when(F.coalesce("num_attempts", F.lit(1)) > 1, make(F.col("num_attempts") - 1, delay, none))
    tries = [_retry_doc("explicit"), _retry_doc("wfp_retry"), _retry_doc("log"), built, tolerant]
    source = F.when(tries[0].isNotNull(), "explicit").when(tries[1].isNotNull(), "params").when(tries[2].isNotNull(), "log").when(
        built.isNotNull(), "wf_retry").when(tolerant.isNotNull(), "faultTolerance")
    return loads.withColumn("retry", F.coalesce(*tries)).withColumn("source", source)


def retry_schedule(results: DataFrame, as_of) -> DataFrame:
    """Counters and next state after a result ``res``; ``retry`` as from :func:`retry_config`.

    A retry waits for the delay plus (try - 1) times the addition. A delay that can't be read leaves no time to wait
    for: the load ends as an error, and ``problem`` names the text.
    """
    r = F.col("retry")
    kind = F.when(F.col("res") > 0, "ok").when(F.col("res") == 0, "no").otherwise("error")
    on = F.coalesce(r["on"], F.array(F.lit("error")))
    again = (F.coalesce(r["left"], F.lit(0)) > 0) & (F.array_contains(on, F.col("kind")) | F.array_contains(on, F.col("res").cast("string")))
    out = results.withColumn("res", F.coalesce("res", F.lit(-99))).withColumn("kind", kind).withColumn("again", F.coalesce(again, F.lit(False)))
    added = F.when(F.coalesce(r["try"], F.lit(1)) > 1, unreadable_shift(r["add"]))
    out = out.withColumn("problem", F.when(F.col("again"), F.coalesce(unreadable_shift(r["delay"]), added))).withColumn("again", F.col("again") & F.col("problem").isNull())
    ok = F.coalesce("ok", F.lit(0)) + (F.col("kind") == "ok").cast("int")
    no = F.coalesce("no", F.lit(0)) + (F.col("kind") == "no").cast("int")
    out = out.withColumn("ok", ok).withColumn("no", no).withColumn("err", F.coalesce("err", F.lit(0)) + (F.col("kind") == "error").cast("int"))
    success = (F.col("ok") > 0) | (F.col("no") > 0)
    first = shift_time(as_ts(as_of), r["delay"])
    extra = F.sequence(F.lit(1), F.coalesce(r["try"], F.lit(1)))
    at = F.aggregate(F.slice(extra, 2, F.size(extra)), first, lambda acc, _: shift_time(acc, r["add"]))
    return (
        out.withColumn("status", F.when(F.col("again"), "TIME-WAIT").when(success & F.col("problem").isNull(), "SUCCESS").otherwise("ERROR"))
        .withColumn("action", F.when(F.col("again"), "retry").when(success | ~F.coalesce("abort_on_failure", F.lit(False)), "Completed").otherwise("Aborted"))
        .withColumn("next_at", F.when(F.col("again"), at)).drop("again")
    )


# Units of the time shift language, in seconds.
SHIFT_UNITS = {"weeks": 604800, "days": 86400, "hours": 3600, "minutes": 60, "seconds": 1}


def shift_time(ts, delta) -> Column:
    """Apply a comma separated shift text from left to right.

    Pieces: time=HH:MM:SS, date=YYYY-MM-DD or DD.MM.YYYY, weekday=N (0 is Monday), hours=+N and other
    units, "N hours", and a bare HH:MM:SS that is added.
    """
    part = lambda text, sep, i: F.try_element_at(F.split(text, sep), F.lit(i)).try_cast("int")
    clock = lambda text: F.coalesce(part(text, ":", 1), F.lit(0)) * 3600 + F.coalesce(part(text, ":", 2), F.lit(0)) * 60 + F.coalesce(part(text, ":", 3), F.lit(0))

    def step(acc: Column, raw: Column) -> Column:
        text = F.trim(raw)
        pair = F.contains(text, F.lit("="))
        spoken = ~pair & F.contains(text, F.lit(" "))
        unit = F.regexp_replace(F.concat(F.substring_index(text, " ", -1), F.lit("s")), "ss$", "s")
        key = F.when(pair, F.trim(F.substring_index(text, "=", 1))).when(spoken, unit).otherwise(F.lit(""))
        value = F.when(pair, F.trim(F.substring_index(text, "=", -1))).when(spoken, F.substring_index(text, " ", 1)).otherwise(text)
        day = F.date_trunc("day", acc)
        rest = F.unix_micros(acc) - F.unix_micros(day)
        dots = F.contains(value, F.lit("."))
        date = F.make_date(
            F.coalesce(F.when(dots, part(value, r"\.", 3)).otherwise(part(value, "-", 1)), F.year(acc)),
            F.coalesce(F.when(dots, part(value, r"\.", 2)).otherwise(part(value, "-", 2)), F.month(acc)),
            F.coalesce(F.when(dots, part(value, r"\.", 1)).otherwise(part(value, "-", 3)), F.dayofmonth(acc)))
        n = value.try_cast("bigint")
        out = (
            F.when((text == "") | (value == ""), acc)
            .when(key == "time", plus_seconds(day, clock(value)))
            .when(key == "date", F.timestamp_micros(F.unix_micros(date.cast("timestamp")) + rest))
            .when(key == "weekday", plus_seconds(acc, (n - F.weekday(acc)) * 86400))
            .when(key == "", plus_seconds(acc, clock(value))))
        for name, seconds in SHIFT_UNITS.items():
            out = out.when(key == name, plus_seconds(acc, n * seconds))
        return out

    pieces = F.split(F.lower(col(delta)), ",")
    return F.when(col(delta).isNull(), col(ts)).otherwise(F.aggregate(pieces, col(ts), step))


def unreadable_shift(delta) -> Column:
    """The shift text if :func:`shift_time` can't read a piece of it, else NULL."""
    moved = shift_time(F.lit("2000-01-03 00:00:00").cast("timestamp"), delta)
    return F.when(moved.isNull(), col(delta))


# --- choosing and monitoring loads ----------------------------------------------------------------


def pick_loads(active: DataFrame, profile: str, limit: int) -> DataFrame:
    """Candidates with the reason why a load is or is not taken: lowest id first, one per workflow."""
    reason = (
        F.when(F.col("alive") != "ACTIVE", "not active").when(F.col("profile") != profile, "not profile")
        .when(F.col("wf_id").isNull(), "no wf_id").when(F.col("loading_id").isNull(), "no loading_id")
        .when(~F.col("status").isin("RUNNING", "TIME-WAIT", "EVENT-WAIT"), "not add status")
        .when((F.col("status") == "RUNNING") & (F.coalesce("log", F.lit("")) != ""), "already run"))
    c = active.withColumn("reason", reason)
    first = c.filter("reason is null").groupBy("wf_id").agg(F.min("id").alias("_first"))
    top = first.orderBy("_first").limit(limit)
    edge = top.agg(F.max("_first").alias("_edge"), F.count("*").alias("_n"))
    j = c.join(first, "wf_id", "left").crossJoin(F.broadcast(edge))
    full = (F.col("_n") >= limit) & (F.col("id") > F.col("_edge"))
    why = F.when(F.col("reason").isNotNull(), F.col("reason")).when(full, F.lit(f"limit {limit} exceeded")).when(F.col("id") != F.col("_first"), "already added")
    return j.withColumn("reason", why).withColumn("picked", F.col("reason").isNull()).drop("_first", "_edge", "_n")


# Actions a status text may ask for.
ACTIONS = ("reRunned", "Aborted", "Completed", "reStarted", "Stopped", "notFound", "New", "Skipped", "SLA", "Started")


def _asked(log: Column) -> Column:
    word = F.substring_index(F.trim(F.coalesce(log, F.lit(""))), " ", 1)
    return F.when(word.isin(*ACTIONS), word).otherwise("Aborted")


def _failed() -> Column:
    return F.when(F.coalesce("abort_on_failure", F.lit(False)), "Aborted").otherwise("Completed")


def _time_wait(as_of, grace_min: int) -> Column:
    due = F.col("wait_until") + minutes(grace_min) <= as_ts(as_of)
    return F.when(F.coalesce(due, F.lit(False)), "reStarted").otherwise("Skipped")


def _event_wait() -> Column:
    return F.when(F.coalesce("events_ready", F.lit(False)), "reStarted").otherwise("Skipped")


def _older(as_of, seconds) -> Column:
    return plus_seconds("status_dttm", seconds if isinstance(seconds, Column) else F.lit(seconds)) <= as_ts(as_of)


def external_action(as_of, grace_min: int = 30, stale_s: int = 86400, run_max_s: int = 86400) -> Column:
    """Action on a load someone else executes: running is work, so the limits are long."""
    s = F.col("status")
    limit = F.coalesce("exe_timeout_s", F.lit(run_max_s))
    return (
        F.when(s == "ERROR", _failed()).when(s == "SUCCESS", "Completed").when(s == "ABORTING", _asked(F.col("log")))
        .when(s == "TIME-WAIT", _time_wait(as_of, grace_min)).when(s == "EVENT-WAIT", _event_wait())
        .when(s == "RUNNING", F.when(_older(as_of, limit), "reStarted").otherwise("Skipped"))
        .otherwise(F.when(_older(as_of, stale_s), "reStarted").otherwise("Skipped")))


EXE_MARGIN_S = 600


def own_action(as_of, wait_grace_min: int = 15, lock_stale_s: int = 18000, run_stale_s: int = 21600, default_timeout_s: int = 15900) -> Column:
    """Action on a load of our own, from its status, log, age and whether a run exists."""
    s, log = F.col("status"), F.coalesce("log", F.lit(""))
    running = F.coalesce("running", F.lit(False))
    stale = F.greatest(F.lit(run_stale_s), F.coalesce("exe_timeout_s", F.lit(default_timeout_s)) + EXE_MARGIN_S)
    return (
        F.when(s.isin("TIME-WAIT", "EVENT-WAIT") & running, "Skipped").when(s.isin("PREREQ", "PARAM", "START"), "reStarted")
        .when(s == "ERRORCHECK", "reRunned").when(s == "ERROR", _failed()).when(s == "SUCCESS", "Completed").when(s == "ABORTING", _asked(log))
        .when(s.isin("LOCK-WAIT", "LOCK"), F.when(_older(as_of, lock_stale_s), "reStarted").otherwise("Skipped"))
        .when((s == "RUNNING") & (log == ""), "Skipped").when((s == "RUNNING") & ~log.startswith("RUN"), "reRunned")
        .when(s == "RUNNING", F.when(_older(as_of, stale), "reRunned").otherwise("Skipped"))
        .when(s == "TIME-WAIT", _time_wait(as_of, wait_grace_min)).when(s == "EVENT-WAIT", _event_wait())
        .otherwise("notFound"))


def monitor_action(loads: DataFrame, as_of, new_grace_s: int = 3600) -> DataFrame:
    """Action per load, with overdue skipped loads turned into SLA breaches.

    ``loads``: id, status, status_dttm, log, running, external, abort_on_failure, exe_timeout_s,
    wait_until, events_ready, interval_s.
    """
    act = F.when(~_older(as_of, new_grace_s), "New").when(F.coalesce("external", F.lit(False)), external_action(as_of)).otherwise(own_action(as_of))
    out = loads.withColumn("action", act)
    return out.withColumn("action", F.when((F.col("action") == "Skipped") & _older(as_of, F.coalesce("interval_s", F.lit(86400))), "SLA").otherwise(F.col("action")))


def sla_breach(monitored: DataFrame) -> DataFrame:
    return monitored.filter("action = 'SLA'")


# States of a task that is still alive.
LIVE_TASKS = ("running", "queued", "scheduled", "restarting", "up_for_retry", "up_for_reschedule", "deferred")


def zombie_runs(runs: DataFrame, tasks: DataFrame, dags: DataFrame, serialized: DataFrame, as_of, seconds: int) -> DataFrame:
    """Active runs nobody works on: no live task, no definition, or stuck on a paused definition."""
    t = tasks.groupBy("dag_id", "run_id").agg(
        F.bool_or(F.col("state").isin(*LIVE_TASKS)).alias("live"), F.bool_or(F.col("state") == "running").alias("working"), F.max("end_date").alias("last_end"))
    r = runs.filter("state in ('running', 'queued')").join(t, ["dag_id", "run_id"], "left").join(
        dags.select("dag_id", "is_paused"), "dag_id", "left").join(serialized.select("dag_id").distinct().withColumn("_s", F.lit(1)), "dag_id", "left")
    no = F.lit(False)
    paused, live, working = F.coalesce("is_paused", no), F.coalesce("live", no), F.coalesce("working", no)
    border = as_ts(as_of) - F.make_dt_interval(secs=F.lit(seconds))
    old = F.coalesce("start_date", "queued_at") < border
    idle = F.coalesce("last_end", "start_date", "queued_at") < border
    running, queued = F.col("state") == "running", F.col("state") == "queued"
    dead = old & ((running & ~paused & ~live) | F.col("_s").isNull())
    stuck = paused & ((queued & old) | (running & ~working & idle))
    return r.withColumn("verdict", F.when(dead, "dead").when(stuck, "paused")).filter("verdict is not null").drop("_s")


def new_events(events: DataFrame, last_stat: DataFrame, sent: DataFrame) -> DataFrame:
    """Publications to emit: not scheduled elsewhere, newer than the last emission, not emitted yet.

    ``events``: STAT_KEY, scheduled, last_emitted. ``last_stat``: STAT_KEY, loading_id, published, value.
    ``sent``: STAT_KEY, loading_id, published; loads are known by number, others by time.
    """
    e = events.filter("not coalesce(scheduled, false)").join(last_stat, STAT_KEY)
    fresh = F.col("last_emitted").isNull() | (F.col("published") >= F.col("last_emitted") - minutes(1))
    e = e.filter(fresh).withColumn("loading_id", F.coalesce("loading_id", F.lit(0)))
    by_load = sent.filter("coalesce(loading_id, 0) > 0").select(*STAT_KEY, "loading_id")
    by_time = sent.filter("coalesce(loading_id, 0) = 0").select(*STAT_KEY, "published")
    a = e.filter("loading_id > 0").join(by_load, [*STAT_KEY, "loading_id"], "left_anti")
    b = e.filter("loading_id = 0").join(by_time, [*STAT_KEY, "published"], "left_anti")
    return a.select(*e.columns).unionByName(b.select(*e.columns))


def subtree(edges: DataFrame, root: str) -> DataFrame:
    """All nodes below and including ``root`` with their level, the shortest way counting. ``edges``: id, parent.

    Level by level until no new node is found; nodes seen before are left out, so several ways to a node and cycles
    do no harm. Each level is written to the shared folder.
    """
    spark = edges.sparkSession
    edges = edges.select("id", "parent")
    seen = level = truncate_lineage(edges.filter(F.col("id") == root).select("id").distinct().withColumn("level", F.lit(0)), "subtree")
    depth = 0
    while not level.isEmpty():
        depth += 1
        below = edges.join(level.select(F.col("id").alias("parent")), "parent").select("id").distinct()
        level = truncate_lineage(below.join(seen.select("id"), "id", "left_anti").withColumn("level", F.lit(depth)), "subtree")
        seen = seen.unionByName(level)
        if depth % 20 == 0:
            seen = truncate_lineage(seen, "subtree")
    return seen if depth else spark.createDataFrame([], "id string, level int")


def next_run(first, interval_s, last, end=None) -> Column:
    """Next point of the grid ``first + k * interval`` after ``last``; NULL past the end."""
    step = col(interval_s) * 1_000_000
    a, b = F.unix_micros(col(first)), F.unix_micros(col(last))
    k = F.floor((b + step - a) / step)
    at = F.coalesce(F.when(k >= 0, F.timestamp_micros((a + k * step).cast("bigint"))), col(first))
    return at if end is None else F.when(F.coalesce(at > col(end), F.lit(False)), None).otherwise(at)


# --- alerts ----------------------------------------------------------------------------------------

# Calendar words.
WORDS = ("daily", "workdays", "weekly", "monthly", "quarterly", "yearly")


def calendar_rules(rules: DataFrame) -> DataFrame:
    """Fill in what a calendar word implies where a rule does not say it itself.

    ``rules``: rule_id, kind, dow, day, month (arrays), last (boolean), at (text).
    """
    k = F.coalesce("kind", F.lit(""))
    ints = lambda *v: F.array(*[F.lit(x) for x in v])
    last = F.coalesce("last", F.lit(False))
    word = F.when(k != "", k).when(F.col("month").isNotNull(), "yearly").when(F.col("day").isNotNull() | last, "monthly").when(
        F.col("dow").isNotNull(), "weekly").otherwise("daily")
    dow = F.when(k == "workdays", F.coalesce("dow", ints(1, 2, 3, 4, 5))).when(k == "weekly", F.coalesce("dow", ints(1))).otherwise(F.col("dow"))
    day = F.when(k.isin("monthly", "yearly") & ~last, F.coalesce("day", ints(1))).otherwise(F.col("day"))
    month = F.when(k == "yearly", F.coalesce("month", ints(1))).when(k == "quarterly", F.coalesce("month", ints(3, 6, 9, 12))).otherwise(F.col("month"))
    return rules.select(
        *[c for c in rules.columns if c not in ("kind", "dow", "day", "month", "last", "at")], word.alias("kind"), dow.alias("dow"), day.alias("day"), month.alias("month"),
        (last | ((k == "quarterly") & F.col("day").isNull())).alias("last"), F.coalesce(F.nullif("at", F.lit("")), F.lit("23:59:59")).alias("at"))


def clock_seconds(text) -> Column:
    p = lambda i: F.coalesce(F.try_element_at(F.split(col(text), ":"), F.lit(i)).cast("int"), F.lit(0))
    return p(1) * 3600 + p(2) * 60 + p(3)


def calendar_deadlines(rules: DataFrame, as_of, days: int) -> DataFrame:
    """Last and previous deadline of every calendar rule within ``days`` back; every rule comes back.

    ``problem`` says where there is none: a word nobody knows, or no day of the period that fits.
    """
    known = F.col("kind").isin(*WORDS)
    all_rules = calendar_rules(rules).withColumn("_at", clock_seconds("at"))
    r = all_rules.filter(known)
    # Rules share few calendars: each is worked out once, on one row per calendar and day.
    parts = ["dow", "day", "month", "last", "_at"]
    today, day = as_date(as_of), F.col("d")
    fits = lambda c, value: F.col(c).isNull() | F.array_contains(c, value)
    c = r.select(*parts).distinct().withColumn("d", F.explode(F.sequence(F.date_sub(today, days), today)))
    c = c.filter(
        fits("dow", F.weekday("d") + 1) & fits("day", F.dayofmonth("d")) & fits("month", F.month("d")) & (~F.col("last") | (day == F.last_day("d")))
        & (plus_seconds(day.cast("timestamp"), F.col("_at")) <= as_ts(as_of)))
    # At most one row per day of the period and calendar.
    two = c.groupBy(*parts).agg(F.max("d").alias("_d1"), F.reverse(F.array_sort(F.collect_list("d"))).alias("_all"))
    at = lambda c: plus_seconds(c.cast("timestamp"), F.col("_at"))
    two = two.select(*[F.col(p).alias(f"_c_{p}") for p in parts], at(F.col("_d1")).alias("deadline"), at(F.try_element_at("_all", F.lit(2))).alias("previous"))
    on = F.lit(True)
    for p in parts:
        on = on & F.col(p).eqNullSafe(F.col(f"_c_{p}"))
    problem = F.when(~known, "unknown word").when(F.col("deadline").isNull(), "no deadline")
    return all_rules.join(two, on & known, "left").withColumn("problem", problem).drop("_at", *[f"_c_{p}" for p in parts])


def alert_interval(rules: DataFrame, last: DataFrame, as_of) -> DataFrame:
    """Interval rules (wf_id, every_s, at) that fire: nothing within the window, or past the deadline."""
    now = as_ts(as_of)
    r = rules.join(last, "wf_id", "left")
    every = F.col("every_s")
    rolling = F.col("at").isNull() | (F.col("at") == "") | (every < 86400)
    grid = F.timestamp_seconds(F.floor(F.unix_timestamp(now) / every) * every)
    day = F.date_trunc("day", plus_seconds("last_at", every))
    due = F.coalesce(plus_seconds(day, clock_seconds("at")), F.date_trunc("day", now))
    r = r.withColumn("rolling", rolling).withColumn("period_ts", F.when(rolling, grid).otherwise(due))
    silent = F.col("last_at").isNull() | F.when(F.col("rolling"), plus_seconds("last_at", every) < now).otherwise(F.col("period_ts") <= now)
    return r.filter(silent)


def alert_event(deadlines: DataFrame, last: DataFrame) -> DataFrame:
    """Calendar rules whose last success lies before the deadline day (midnight counts to the day before)."""
    d = deadlines.filter("deadline is not null").join(last, "wf_id", "left")
    need = F.to_date(plus_seconds("deadline", F.lit(-1)))
    return d.filter(F.col("last_at").isNull() | (F.to_date("last_at") < need))


def alert_data(deadlines: DataFrame, stats: DataFrame) -> DataFrame:
    """Calendar rules with data: the newest business date must reach deadline minus lag.

    ``deadlines``: ..., obj, lag_s, deadline. ``stats``: obj, data_max.
    """
    newest = stats.groupBy("obj").agg(F.max("data_max").alias("last_at"))
    d = deadlines.filter("deadline is not null").join(newest, "obj", "left").withColumn("need", F.to_date(plus_seconds("deadline", -F.coalesce("lag_s", F.lit(0)))))
    return d.filter(F.col("last_at").isNull() | (F.to_date("last_at") < F.col("need")))


# How an object is named in a rule.
OBJECT_NAME = r"^[a-z_][a-z0-9_]*(\.[a-z_][a-z0-9_]*)?$"


def data_alerts(deadlines: DataFrame, stats: DataFrame, tables: dict[str, DataFrame], most_expressions: int) -> DataFrame:
    """Calendar rules with data, by a statistic or by an expression over the object itself.

    ``deadlines``: ..., obj, lag_s, deadline, expr, field. A rule with ``expr`` compares that aggregate of the table ``obj``, others the
    newest value of the column ``field`` (``data_max`` if empty) in ``stats`` (obj, time columns). Rules that fire come back with
    ``need`` and ``last_at``, unreadable ones with the reason in ``problem``. Different expressions are settings: more
    than ``most_expressions`` are an error. Each table is read once, whatever the number of rules on it.
    """
    d = deadlines.filter("deadline is not null").withColumn("expr", F.nullif("expr", F.lit(""))).withColumn("field", F.coalesce(F.nullif("field", F.lit("")), F.lit("data_max")))
    named = F.coalesce(F.col("obj").rlike(OBJECT_NAME), F.lit(False))
    asked = d.filter(named & F.col("expr").isNotNull()).select("obj", "expr").distinct().limit(most_expressions + 1).collect()
    if len(asked) > most_expressions:
        raise ValueError(f"more than {most_expressions} expressions")
    rules = {(r.obj, r.expr): str(i) for i, r in enumerate(asked)}
    values = rule_values(deadlines.sparkSession, tables, [Rule(i, obj, expr) for (obj, expr), i in rules.items()], "timestamp")
    known = deadlines.sparkSession.createDataFrame([(i, obj, expr) for (obj, expr), i in rules.items()], "rule string, obj string, expr string")
    values = values.join(F.broadcast(known), "rule").select("obj", "expr", F.col("value").alias("_value"), F.col("problem").alias("_reason"))
    fields = [c for c in stats.columns if c != "obj"]
    newest = stats.groupBy("obj").agg(F.map_from_arrays(F.array(*[F.lit(c) for c in fields]), F.array(*[F.max(c).cast("timestamp") for c in fields])).alias("_stats"))
    j = d.join(F.broadcast(values), ["obj", "expr"], "left").join(newest, "obj", "left")
    problem = (
        F.when(~named, "bad name of an object").when(F.col("expr").isNotNull(), F.col("_reason"))
        .when(~F.col("field").isin(*fields), F.concat(F.lit("unknown field "), "field")))
    last = F.when(F.col("expr").isNotNull(), F.col("_value")).otherwise(F.element_at("_stats", F.col("field")))
    out = j.withColumn("problem", problem).withColumn("last_at", F.when(F.col("problem").isNull(), last)).withColumn("need", F.to_date(plus_seconds("deadline", -F.coalesce("lag_s", F.lit(0)))))
    fires = F.col("last_at").isNull() | (F.to_date("last_at") < F.col("need"))
    return out.filter(F.col("problem").isNotNull() | fires).drop("_value", "_reason", "_stats")


def last_success(loads: DataFrame, publications: DataFrame | None = None, stat_id: int | None = None) -> DataFrame:
    """Last successful end per workflow, or the last publication of one statistic.

    ``publications``: loading_id, stat_id, ts.
    """
    if stat_id is None:
        return loads.filter("alive = 'COMPLETED' and status = 'SUCCESS'").groupBy("wf_id").agg(F.max("end_dttm").alias("last_at"))
    p = publications.filter(F.col("stat_id") == stat_id)
    return p.join(loads.select(F.col("id").alias("loading_id"), "wf_id"), "loading_id").groupBy("wf_id").agg(F.max("ts").alias("last_at"))


ALERT_KEY = ["wf_id", "alert_key", "period_ts"]


def alert_open(new: DataFrame, alerts: DataFrame, as_of) -> DataFrame:
    """New alerts that were not reported for the same period within a day."""
    told = alerts.filter(F.col("ts") > as_ts(as_of) - F.expr("interval 1 day")).select(*ALERT_KEY)
    return new.join(told, ALERT_KEY, "left_anti")


def alert_close(alerts: DataFrame, checked: DataFrame, new: DataFrame) -> DataFrame:
    """Open alerts of checked workflows that do not fire now; unchecked rules close nothing."""
    return (
        alerts.filter("close_ts is null").join(checked.select("wf_id").distinct(), "wf_id", "left_semi")
        .join(new.select("wf_id", "alert_key").distinct(), ["wf_id", "alert_key"], "left_anti"))


def alert_rules(catalog: DataFrame, group: str | None, as_of, backup_until: str = "00:00:00") -> DataFrame:
    """Alert settings out of the workflow parameters (wf_id, deleted, params array<struct<param, value>>).

    Only workflows with a rule, of one group if asked; ``valid`` tells unreadable rules apart. During
    the backup window on Sunday nothing is returned.
    """
    get = lambda name: F.try_element_at(F.filter("params", lambda p: p["param"] == name), F.lit(1))["value"]
    r = catalog.filter("not coalesce(deleted, false)").select(
        "wf_id", get("wf_alert").alias("rule"), get("wf_alert_data").alias("data"), F.coalesce(get("wf_alert_group"), F.lit("")).alias("alert_grp"))
    r = r.filter("rule is not null or data is not null")
    if group is not None:
        r = r.filter(F.col("alert_grp") == group)
    now = as_ts(as_of)
    muted = (F.weekday(now) == 6) & (F.unix_timestamp(now) - F.unix_timestamp(F.date_trunc("day", now)) < clock_seconds(F.lit(backup_until)))
    ok = is_valid_json("rule") & (F.col("data").isNull() | is_valid_json("data"))
    return r.filter(~muted).withColumn("valid", F.coalesce(ok, F.lit(False)))


# --- dependencies and publications ------------------------------------------------------------------


def dependency_edges(workflows: DataFrame, mode: str, archive: str, own: str, engine: str, inbound: str, file_root: str, event_root: str) -> DataFrame:
    """Who owns the schedule of a workflow, its kind, and one row per active dependency.

    ``workflows``: wf_id, category, scheduled, events array<struct<profile, entity_id, active>>, sched,
    has_condition, inbound_path. ``mode``: own, mixed or engine. Tags are ``own`` or ``engine`` with the kind, ``inbound``
    for workflows fed by files, or ARCHIVE; dependencies are paths below ``file_root`` or ``event_root``, or a schedule.
    """
    owns = F.lit(mode == "own") | (F.lit(mode == "mixed") & ~F.coalesce("scheduled", F.lit(False)))
    some = F.coalesce(F.size("events"), F.lit(0)) > 0
    fed = F.col("inbound_path").isNotNull()
    kind = F.when(some, "event").when(F.col("sched").isNotNull(), "time").when(F.coalesce("has_condition", F.lit(False)), "condition").otherwise("manual")
    tag = F.when(F.col("category") == archive, "ARCHIVE").when(fed, inbound).otherwise(F.concat_ws("_", F.when(owns, own).otherwise(engine), kind))
    w = workflows.withColumn("owns", owns).withColumn("tag", tag)
    path = F.concat_ws("/", F.lit(file_root), F.regexp_replace("inbound_path", "^/+", ""))
    active = F.transform(F.filter("events", lambda e: F.coalesce(e["active"], F.lit(True))), lambda e: F.concat_ws("/", F.lit(event_root), e["profile"], e["entity_id"].cast("string")))
    none = F.array().cast("array<string>")
    deps = (
        F.when(F.col("tag") == "ARCHIVE", none).when(fed, F.array(path)).when(F.col("owns") & some, active)
        .when(F.col("owns") & F.col("sched").isNotNull(), F.array(F.concat(F.lit("cron "), F.col("sched")))).otherwise(none))
    return w.select("wf_id", "owns", "tag", F.explode_outer(deps).alias("dependency"))


# Statistic numbers of a finished load.
STAT_END, STAT_OK, STAT_CHANGE, STAT_QUALITY, STAT_BUSINESS_DATE = 11, 2, 1, 56, 55


def publish_stats(results: DataFrame, as_of) -> DataFrame:
    """Statistics a result publishes: end time always, the others on success, custom ones as given.

    ``results``: loading_id, entity_id, res, cdc, hub (JSON text), stat map<string,string>.
    """
    ok = F.coalesce("res", F.lit(-99)) > 0
    row = lambda stat, value, cond: F.when(cond, F.struct(F.lit(stat).alias("stat_id"), value.cast("string").alias("value")))
    date = F.get_json_object("hub", "$.dataBusiness")
    fixed = F.array(
        row(STAT_END, F.date_format(as_ts(as_of), "yyyy-MM-dd HH:mm:ss"), F.lit(True)), row(STAT_OK, F.lit("1"), ok),
        row(STAT_CHANGE, F.col("cdc"), ok & F.col("cdc").isNotNull()), row(STAT_QUALITY, F.col("hub"), ok & F.col("hub").isNotNull()),
        row(STAT_BUSINESS_DATE, F.to_json(F.struct(date.alias("dataBusiness"))), ok & date.isNotNull()))
    custom = F.transform(F.map_entries(F.coalesce("stat", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].cast("int").alias("stat_id"), e["value"].alias("value")))
    rows = F.concat(F.filter(fixed, lambda s: s.isNotNull()), custom)
    return results.select("loading_id", "entity_id", F.explode(rows).alias("s")).select("loading_id", "entity_id", "s.stat_id", "s.value")
