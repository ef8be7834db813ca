"""Platform telemetry: failures, waiting causes, health counters, retention, sessions, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.scalars import seconds_between
from tidewatch.operators.common import as_ts, bucketed_lag, exact_quantile, share

LOCAL_SHIFT = "interval 3 hours"
ATTEMPT = ["dag_id", "task_id", "run_id", "map_index", "try_number"]
STARTS = "running"

# Incident names, and the parts of names that look like incidents.
INCIDENTS = ("stuck in queued reschedule", "stuck in queued tries exceeded", "heartbeat timeout", "state mismatch")
SIMILAR = r"(?i)stuck|heartbeat|mismatch|zombie"


def since(df: DataFrame, c: str, as_of, hours: int) -> DataFrame:
    """Rows of the last hours; both ends are plain comparisons that reach the scan."""
    return df.filter((F.col(c) > as_ts(as_of) - F.make_dt_interval(hours=F.lit(hours))) & (F.col(c) <= as_ts(as_of)))


def local_day(c: str) -> Column:
    return F.to_date(F.col(c) + F.expr(LOCAL_SHIFT))


def _count_attempts(rows: DataFrame, keys: list[str], extra: list[Column] = []) -> DataFrame:  # noqa: B006
    """Events and distinct attempts per key.

    Events are first summed per attempt, which also splits a key that holds most events.
    """
    per = rows.groupBy(*keys, *[c for c in ATTEMPT if c not in keys]).agg(F.count("*").alias("_n"), *[e.alias(f"_x{i}") for i, e in enumerate(extra)])
    return per.groupBy(*keys).agg(F.sum("_n").alias("cnt"), F.count("*").alias("tasks"), *[F.max(f"_x{i}").alias(f"x{i}") for i in range(len(extra))])


def failures_by_event(log: DataFrame, as_of, hours: int, events) -> DataFrame:
    return _count_attempts(since(log, "dttm", as_of, hours).filter(F.col("event").isin(*events)), ["event"])


def failures_by_task(log: DataFrame, as_of, hours: int, events, top: int) -> DataFrame:
    """The (dag, task) pairs with most events (top-k), kinds of events and last time in local days."""
    rows = since(log, "dttm", as_of, hours).filter(F.col("event").isin(*events))
    per = rows.groupBy("dag_id", "task_id", "run_id", "map_index", "try_number", "event").agg(F.count("*").alias("n"), F.max("dttm").alias("at"))
    attempt = per.groupBy(*ATTEMPT).agg(F.sum("n").alias("n"), F.max("at").alias("at"))
    kinds = per.groupBy("dag_id", "task_id", "event").agg(F.lit(1).alias("one")).groupBy("dag_id", "task_id").agg(F.count("*").alias("kinds"))
    g = attempt.groupBy("dag_id", "task_id").agg(F.sum("n").alias("cnt"), F.count("*").alias("tasks"), F.max("at").alias("at"))
    k = kinds.select(F.col("dag_id").alias("_d"), F.col("task_id").alias("_t"), "kinds")
    g = g.orderBy(F.desc("cnt"), "dag_id", "task_id").limit(top)
    return g.join(k, g.dag_id.eqNullSafe(F.col("_d")) & g.task_id.eqNullSafe(F.col("_t"))).select(
        F.coalesce("dag_id", F.lit("—")).alias("dag_id"), F.coalesce("task_id", F.lit("—")).alias("task_id"), "cnt", "kinds", "tasks", (F.col("at") + F.expr(LOCAL_SHIFT)).alias("last_seen"))


def failures_by_day(log: DataFrame, as_of, days: int, events) -> DataFrame:
    rows = since(log, "dttm", as_of, days * 24).filter(F.col("event").isin(*events))
    return _count_attempts(rows.withColumn("day", local_day("dttm")), ["day"])


def delivery_failures(log: DataFrame, as_of, hours: int, events) -> DataFrame:
    """Totals of a window: events, distinct attempts, starts and the share of failed starts (NULL without starts)."""
    rows = since(log, "dttm", as_of, hours).filter(F.col("event").isin(*events, STARTS))
    hit = F.col("event").isin(*events)
    per = rows.groupBy(*ATTEMPT).agg(F.count_if(hit).alias("n"), F.count_if(F.col("event") == STARTS).alias("starts"))
    g = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(F.col("n") > 0).alias("tasks"), F.coalesce(F.sum("starts"), F.lit(0)).alias("runs"))
    return g.withColumn("share_pct", share("tasks", "runs"))


def unknown_events(log: DataFrame, as_of, hours: int, incidents=INCIDENTS, others=(STARTS,)) -> DataFrame:
    """Names that look like incidents but are on no list - shown only when no known incident occurred."""
    rows = since(log, "dttm", as_of, hours)
    found = rows.agg(F.count_if(F.col("event").isin(*incidents)).alias("_n")).filter("_n = 0")
    similar = rows.filter(F.col("event").rlike(SIMILAR) & ~F.col("event").isin(*incidents, *others)).groupBy("event").agg(F.count("*").alias("cnt"))
    return similar.crossJoin(F.broadcast(found)).drop("_n")


# --- runs, tasks, definitions -----------------------------------------------------------------------
# ``runs``: dag_id, run_id, state, queued_at, start_date, execution_date. ``tasks``: dag_id, run_id,
# task_id, state, start_date, end_date, queued_dttm, updated_at, pid. ``dags``: dag_id, is_paused,
# is_active, fileloc, last_parsed_time, max_active_tasks.

ACTIVE_RUNS = ("queued", "running")


def stuck_runs(runs: DataFrame, tasks: DataFrame, as_of, hours: float) -> DataFrame:
    """Age of active runs from their last sign of life: busy, to close, or young."""
    t = tasks.groupBy("dag_id", "run_id").agg(F.max("end_date").alias("last_end"), F.count_if(F.col("state") == "running").alias("working"))
    r = runs.filter(F.col("state").isin(*ACTIVE_RUNS)).join(t, ["dag_id", "run_id"], "left")
    at = F.when(F.col("state") == "queued", F.coalesce("queued_at", "execution_date")).otherwise(F.coalesce("last_end", "start_date", "queued_at"))
    age = F.coalesce(seconds_between(as_ts(as_of), "since"), F.lit(0.0)) / 3600
    busy = (F.col("state") == "running") & (F.coalesce("working", F.lit(0)) > 0)
    return r.withColumn("since", at).withColumn("age_h", F.round(age, 2)).withColumn(
        "verdict", F.when(busy, "busy").when(age >= hours, "close").otherwise("young"))


def task_health(tasks: DataFrame, as_of, stale_s: int, queued_timeout_s: int) -> DataFrame:
    """Counters per state and staleness in one pass, with the age of the oldest queued task."""
    older = lambda c, s: F.col(c) < as_ts(as_of) - F.make_dt_interval(secs=F.lit(s))
    st = lambda s: F.col("state") == s
    return tasks.filter(F.col("state").isin("queued", "running", "scheduled")).agg(
        F.count_if(st("queued")).alias("queued"), F.count_if(st("queued") & older("queued_dttm", stale_s)).alias("queued_stale"), F.count_if(st("running")).alias("running"),
        F.count_if(st("scheduled")).alias("scheduled"), F.count_if(st("scheduled") & older("updated_at", stale_s)).alias("scheduled_stale"),
        F.count_if(st("running") & F.col("pid").isNull() & older("start_date", stale_s)).alias("running_no_pid"),
        F.coalesce(F.max(F.when(st("queued"), seconds_between(as_ts(as_of), "queued_dttm"))), F.lit(0.0)).alias("oldest_queued_sec"),
        F.count_if(st("queued") & older("queued_dttm", queued_timeout_s)).alias("queued_over_timeout"))


def parse_health(dags: DataFrame, errors: DataFrame, as_of) -> DataFrame:
    """Files, age of the oldest, newest and median parse, import errors."""
    files = dags.filter("is_active").groupBy("fileloc").agg(F.max("last_parsed_time").alias("parsed")).withColumn("age", seconds_between(as_ts(as_of), "parsed"))
    g = files.agg(F.count("*").alias("files"), F.max("age").alias("oldest_sec"), F.min("age").alias("newest_sec"))
    median = exact_quantile(files, "age", 0.5, F.floor(F.col("_v") / 3600)).select(F.col("quantile").alias("median_sec"))
    return g.crossJoin(median).crossJoin(errors.agg(F.count("*").alias("import_errors")))


def stale_files(dags: DataFrame, as_of, age_s: int) -> DataFrame:
    files = dags.filter("is_active").groupBy("fileloc").agg(F.max("last_parsed_time").alias("parsed"))
    return files.withColumn("age", seconds_between(as_ts(as_of), "parsed")).filter(F.col("age") > age_s).drop("parsed")


def not_serialized(dags: DataFrame, serialized: DataFrame) -> DataFrame:
    return dags.filter("is_active").join(serialized.select("dag_id"), "dag_id", "left_anti").select("dag_id")


def new_errors(errors: DataFrame, since_id: int) -> DataFrame:
    """Import errors above the remembered number."""
    return errors.filter(F.col("id") > since_id)


def run_health(runs: DataFrame, dags: DataFrame, as_of, stale_s: int) -> DataFrame:
    """Stale queued runs, active runs of paused and of vanished definitions."""
    r = runs.filter(F.col("state").isin(*ACTIVE_RUNS)).join(dags.select("dag_id", "is_paused", "is_active"), "dag_id")
    stale = (F.col("state") == "queued") & (F.coalesce("queued_at", "execution_date") < as_ts(as_of) - F.make_dt_interval(secs=F.lit(stale_s)))
    return r.agg(F.count_if(stale).alias("queued_stale"), F.count_if("is_paused").alias("paused_active"), F.count_if(~F.col("is_active")).alias("inactive_active"))


def paused_runs(runs: DataFrame, dags: DataFrame, as_of, top: int) -> DataFrame:
    """Oldest active runs of paused definitions (top-k)."""
    r = runs.filter(F.col("state").isin(*ACTIVE_RUNS)).join(dags.filter("is_paused").select("dag_id"), "dag_id", "left_semi")
    at = F.when((F.col("state") == "running") & F.col("start_date").isNotNull(), F.col("start_date")).otherwise(F.coalesce("queued_at", "execution_date"))
    return r.withColumn("age_sec", seconds_between(as_ts(as_of), at).cast("bigint")).orderBy(F.desc("age_sec"), "dag_id", "run_id").limit(top)


def scheduled_waits(tasks: DataFrame, runs: DataFrame, dags: DataFrame, as_of, stale_s: int, recent_s: int) -> DataFrame:
    """Tasks waiting long in ``scheduled`` per definition against its limit, with current and recent work."""
    edge = lambda s: as_ts(as_of) - F.make_dt_interval(secs=F.lit(s))
    live = runs.filter("state = 'running'").select("dag_id", "run_id")
    t = tasks.join(live.withColumn("_live", F.lit(True)), ["dag_id", "run_id"], "left")
    inrun = F.coalesce("_live", F.lit(False))
    waits = (F.col("state") == "scheduled") & (F.col("updated_at") < edge(stale_s)) & inrun
    g = t.groupBy("dag_id").agg(
        F.count_if(waits).alias("scheduled"), F.min(F.when(waits, F.col("updated_at"))).alias("since"), F.count_if(F.col("state").isin("queued", "running")).alias("active"),
        F.count_if(inrun & (F.col("end_date") > edge(recent_s))).alias("recent"))
    return g.filter("scheduled > 0").join(dags.filter("not is_paused").select("dag_id", "max_active_tasks"), "dag_id").withColumn(
        "oldest_sec", seconds_between(as_ts(as_of), "since").cast("bigint")).drop("since")


def frozen_runs(runs: DataFrame, dags: DataFrame, errors: DataFrame, as_of, top: int) -> DataFrame:
    """Active runs of definitions that are gone, with the last import error of their file (top-k)."""
    r = runs.filter(F.col("state").isin(*ACTIVE_RUNS)).join(dags.filter("not is_active").select("dag_id", "fileloc"), "dag_id")
    last = errors.groupBy(F.col("filename").alias("fileloc")).agg(F.max_by("stacktrace", "id").alias("stacktrace"))
    frozen = seconds_between(as_ts(as_of), F.coalesce("last_scheduling_decision", "start_date", "queued_at", "execution_date")).cast("bigint")
    r = r.withColumn("frozen_sec", frozen).orderBy(F.desc("frozen_sec"), "dag_id", "run_id").limit(top)
    return r.join(last, "fileloc", "left").withColumn("error", F.trim("stacktrace")).drop("stacktrace")


def size_class(n: Column, edges: list[int]) -> Column:
    """Name of the interval of whole numbers that holds ``n``; ``edges`` are the upper ends, ascending."""
    starts = [1, *(e + 1 for e in edges)]
    names = [str(b) if a == b else f"{a}–{b}" for a, b in zip(starts, edges)] + [f">{edges[-1]}"]
    passed = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < n))
    return F.element_at(F.array(*map(F.lit, names)), passed + 1)


def dag_size(dags: DataFrame, definitions: DataFrame, runs: DataFrame, tasks: DataFrame, edges: list[int]) -> DataFrame:
    """Tasks in the definition and in the last run of every active definition, with class and alert."""
    last = runs.groupBy("dag_id").agg(F.max_by("run_id", F.struct("execution_date", "run_id")).alias("run_id"))
    done = tasks.join(last, ["dag_id", "run_id"]).groupBy("dag_id").agg(F.count("*").alias("max_ti"))
    d = dags.filter("is_active").select("dag_id", "is_paused").join(definitions, "dag_id", "left").join(done, "dag_id", "left")
    d = d.withColumn("max_ti", F.coalesce("max_ti", F.lit(0))).withColumn("size", F.greatest(F.coalesce("tasks", F.lit(0)), F.col("max_ti")))
    return d.withColumn("class", F.when(F.col("size") == 0, "unknown").otherwise(size_class(F.col("size"), edges))).withColumn("alert", F.col("size") > edges[-1])


# Periods of the change report.
PERIODS = {"year": "1 year", "quarter": "3 months", "month": "1 month", "week": "7 days", "day": "1 day", "hour": "1 hour"}


def change_activity(serialized: DataFrame, as_of, parse_window_s: int = 0) -> DataFrame:
    """How many definitions changed within each period, and right at the last parse or shortly before.

    ``serialized``: dag_id, last_updated, last_parsed_time.
    """
    changed = lambda period: F.count_if(F.col("last_updated") > as_ts(as_of) - F.expr(f"interval {period}"))
    at_parse = F.col("last_updated") >= F.col("last_parsed_time") - F.make_dt_interval(secs=F.lit(parse_window_s))
    return serialized.agg(F.count("*").alias("dags"), *[changed(p).alias(n) for n, p in PERIODS.items()], F.count_if(at_parse).alias("at_parse"))


# --- sessions ---------------------------------------------------------------------------------------


def session_findings(activity: DataFrame, idle_s: int, query_s: int, wait_s: int) -> DataFrame:
    """Kinds of trouble per session: open transaction, long query, blocked, and who blocks.

    ``activity``: pid, application_name, state, tx_age, query_age, state_age, blocking_pids.
    """
    a = activity.withColumn("_blocked", F.coalesce(F.size("blocking_pids"), F.lit(0)) > 0)
    waits = F.col("_blocked") & (F.coalesce("query_age", F.lit(0)) >= wait_s)
    own = F.array_compact(F.array(
        F.when(F.col("state").startswith("idle in transaction") & (F.coalesce("state_age", F.lit(0)) >= idle_s), "idle in transaction"),
        F.when((F.col("state") == "active") & (F.coalesce("query_age", F.lit(0)) >= query_s), "long query"), F.when(waits, "blocked")))
    rows = a.select("pid", F.explode(own).alias("kind"))
    blockers = a.filter(waits).select(F.explode("blocking_pids").alias("pid"), F.lit("blocker").alias("kind")).distinct()
    known = blockers.join(a.select("pid"), "pid", "left_semi")
    return rows.unionByName(known)


def session_owners(tasks: DataFrame, jobs: DataFrame, as_of, heartbeat_h: int = 6) -> DataFrame:
    """Tasks that may own a session: running ones, or with a heartbeat within some hours."""
    t = tasks.filter("pid is not null").join(jobs.withColumnRenamed("state", "job_state"), "job_id", "left")
    fresh = F.col("latest_heartbeat") > as_ts(as_of) - F.make_dt_interval(hours=F.lit(heartbeat_h))
    return t.filter((F.col("state") == "running") | F.coalesce((F.col("job_type") == "LocalTaskJob") & fresh, F.lit(False)))


def sessions_with_owner(findings: DataFrame, activity: DataFrame, owners: DataFrame, as_of, zombie_s: int) -> DataFrame:
    """Findings with the owning task by the process number in the application name; alive = running and beating."""
    app = activity.select("pid", F.try_to_number(F.nullif(F.regexp_extract("application_name", r"_?(\d+)$", 1), F.lit("")), F.lit("9999999999")).cast("bigint").alias("app_pid"))
    beat = seconds_between(as_ts(as_of), "latest_heartbeat") <= zombie_s
    alive = F.coalesce((F.col("state") == "running") & beat, F.lit(False))
    best = owners.withColumn("alive", alive).groupBy(F.col("pid").alias("app_pid")).agg(
        F.bool_or("alive").alias("alive"), F.min("task_key").alias("owner"))
    return findings.join(app, "pid").join(best, "app_pid", "left")


def session_summary(rows: DataFrame) -> DataFrame:
    """Sessions and orphans (no living owner) per kind."""
    return rows.groupBy("kind").agg(F.count("*").alias("cnt"), F.count_if(~F.coalesce("alive", F.lit(False))).alias("orphans"))


# --- queues -----------------------------------------------------------------------------------------

TERMINAL = ("success", "failed", "skipped", "upstream_failed", "removed")


def queue_classify(msgs: DataFrame, states: DataFrame) -> DataFrame:
    """Messages as live or junk by the state of their task. ``msgs``: msg_id, task_key; ``states``: task_key, state, executor_id."""
    j = msgs.join(states.withColumn("_known", F.lit(True)), "task_key", "left")
    unreadable, missing, done = F.col("task_key").isNull(), F.col("_known").isNull(), F.col("state").isin(*TERMINAL)
    reason = F.when(unreadable, "unreadable").when(missing, "no such task").when(done, F.concat(F.lit("already "), F.col("state"))).otherwise(
        F.concat(F.lit("task "), F.coalesce("state", F.lit("without state"))))
    return j.withColumn("live", unreadable | (~missing & ~F.coalesce(done, F.lit(False)))).withColumn("reason", reason).withColumn(
        "id_mismatch", F.coalesce(F.col("executor_id") != F.col("msg_id"), F.lit(False))).drop("_known")


def queue_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("live", "reason").agg(F.count("*").alias("cnt"), F.count_if("id_mismatch").alias("id_mismatch"))


WAIT_KEY = ["dag_id", "task_id", "run_id"]


def wait_causes(waiting: DataFrame, active: DataFrame, pools: DataFrame, dispatched: DataFrame, as_of, stale_min: int, window: int | None = None) -> DataFrame:
    """One cause per task that waits long: definition limit, pool, window, priority, other.

    ``waiting``: WAIT_KEY, pool, priority_weight, updated_at, is_paused, run_state, max_active_tasks,
    logical_date. ``active``: dag_id, active. ``pools``: pool, slots, used. ``dispatched``: weight.
    """
    live = waiting.filter(~F.coalesce("is_paused", F.lit(False)) & (F.col("run_state") == "running")).join(active, "dag_id", "left")
    live = live.withColumn("active", F.coalesce("active", F.lit(0))).withColumn("_full", F.coalesce(F.col("active") >= F.col("max_active_tasks"), F.lit(False)))
    # Weights are small numbers: few distinct values whatever the row count.
    median = dispatched.agg(F.percentile("weight", F.lit(0.5)).alias("_median"))
    stale = live.filter(F.col("updated_at") < as_ts(as_of) - F.make_dt_interval(mins=F.lit(stale_min)))
    j = stale.join(pools, "pool", "left").crossJoin(F.broadcast(median))
    if window:
        # The head holds ``window`` rows, a fixed small number.
        head = live.orderBy(F.desc(F.coalesce("priority_weight", F.lit(0))), F.asc_nulls_first("logical_date"), *WAIT_KEY).limit(window)
        j = j.join(F.broadcast(head.select(*WAIT_KEY).withColumn("_head", F.lit(True))), WAIT_KEY, "left")
        j = j.crossJoin(F.broadcast(head.agg(F.count_if("_full").alias("_blocked"))))
        behind = F.col("_head").isNull() & (F.col("_blocked") > 0)
    else:
        behind = F.lit(False)
    full_pool = F.coalesce((F.col("slots") >= 0) & (F.col("used") >= F.col("slots")), F.lit(False))
    light = F.coalesce(F.coalesce("priority_weight", F.lit(0)) < F.col("_median"), F.lit(False))
    cause = F.when(F.col("_full"), "dag limit").when(full_pool, F.concat(F.lit("pool "), F.col("pool"))).when(behind, "window").when(light, "priority").otherwise("other")
    return j.withColumn("wait_min", F.floor(seconds_between(as_ts(as_of), "updated_at") / 60).cast("bigint")).withColumn("cause", cause).select(
        *WAIT_KEY, "pool", "priority_weight", "wait_min", "cause")


def wait_board(causes: DataFrame) -> DataFrame:
    """Waiting tasks and the longest wait per definition and cause."""
    return causes.groupBy("dag_id", "cause").agg(F.count("*").alias("stale"), F.max("wait_min").alias("oldest_min"))


def _alive(waiting: DataFrame, active: DataFrame) -> DataFrame:
    """Waiting tasks that the scheduler considers: not paused, in a run that runs; with the load of their definition."""
    live = waiting.filter(~F.coalesce("is_paused", F.lit(False)) & F.coalesce(F.col("run_state") == "running", F.lit(False)))
    live = live.join(active, "dag_id", "left").withColumn("active", F.coalesce("active", F.lit(0)))
    return live.withColumn("_full", F.coalesce(F.col("active") >= F.col("max_active_tasks"), F.lit(False)))


def _head(live: DataFrame, window: int) -> DataFrame:
    """What the scheduler takes in one cycle: ``window`` rows by weight, then date."""
    return live.orderBy(F.desc(F.coalesce("priority_weight", F.lit(0))), F.asc_nulls_first("logical_date"), *WAIT_KEY).limit(window)


def queue_board(waiting: DataFrame, active: DataFrame, as_of, stale_min: int, window: int) -> DataFrame:
    """Per definition: tasks waiting and waiting long, the longest wait, load and limit, the span of weights, and tasks of the scheduler's window that its limit blocks."""
    live = _alive(waiting, active)
    stale = F.col("updated_at") < as_ts(as_of) - F.make_dt_interval(mins=F.lit(stale_min))
    minutes = F.floor(seconds_between(as_ts(as_of), "updated_at") / 60).cast("bigint")
    board = live.groupBy("dag_id").agg(
        F.count("*").alias("waiting"), F.count_if(stale).alias("stale"), F.coalesce(F.max(F.when(stale, minutes)), F.lit(0)).alias("oldest_min"), F.max("active").alias("active"),
        F.max("max_active_tasks").alias("max_active_tasks"), F.min("priority_weight").alias("weight_low"), F.max("priority_weight").alias("weight_high"))
    blocked = _head(live, window).filter("_full").groupBy("dag_id").agg(F.count("*").alias("blocked"))
    return board.join(F.broadcast(blocked), "dag_id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(0)))


def queue_totals(waiting: DataFrame, active: DataFrame, dispatched: DataFrame, as_of, stale_min: int, window: int) -> DataFrame:
    """One row: live, parked and long-waiting tasks, what was dispatched and its median weight, and the scheduler's window: blocked in it, behind it."""
    live = _alive(waiting, active)
    stale = F.col("updated_at") < as_ts(as_of) - F.make_dt_interval(mins=F.lit(stale_min))
    n = live.agg(F.count("*").alias("live"), F.count_if(stale).alias("stale"))
    total = waiting.agg(F.count("*").alias("_all"))
    sent = dispatched.agg(F.count("*").alias("dispatched"), F.percentile("weight", F.lit(0.5)).alias("median_dispatched"))
    head = _head(live, window).agg(F.count_if("_full").alias("blocked"))
    one = n.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(sent)).crossJoin(F.broadcast(head))
    return one.select("live", (F.col("_all") - F.col("live")).alias("parked"), "stale", "dispatched", "median_dispatched", F.lit(window).cast("bigint").alias("window"), "blocked", F.greatest(F.col("live") - window, F.lit(0)).alias("behind"))


# --- retention, folders, health -----------------------------------------------------------------------


def retention_select(table: DataFrame, time_col: str, cutoff) -> DataFrame:
    return table.filter(F.col(time_col) < as_ts(cutoff))


def retention_children(child: DataFrame, parent: DataFrame, keys: list[str], time_col: str, cutoff) -> DataFrame:
    """Rows whose parent is old enough to go."""
    return child.join(retention_select(parent, time_col, cutoff).select(*keys), keys, "left_semi")


def retention_orphans(child: DataFrame, parent: DataFrame, keys: list[str], id_col: str, time_col: str, cutoff) -> DataFrame:
    """Rows without a parent, as far as their number lies below every row of a fresh parent."""
    fresh = child.join(parent.filter(F.col(time_col) >= as_ts(cutoff)).select(*keys), keys, "left_semi").agg(F.min(id_col).alias("_low"))
    return child.join(parent.select(*keys), keys, "left_anti").crossJoin(F.broadcast(fresh)).filter(F.col(id_col) < F.col("_low")).drop("_low")


def duplicate_groups(catalog: DataFrame, definition: str, name: str) -> DataFrame:
    """Definitions listed more than once, one row per name."""
    g = catalog.groupBy(definition).agg(F.count("*").alias("copies"), F.min(name).alias("keep"))
    return catalog.select(definition, name).join(g.filter("copies > 1"), definition)


def codes_without_parent(codes: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    return codes.join(refs.select(*keys), keys, "left_anti")


# States of a check from good to bad.
STATUS_RANK = ("healthy", "skip", "warn", "error")


def health_rollup(checks: DataFrame, key: str) -> DataFrame:
    """Worst state of many checks per key and how many are in it."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_RANK]), F.col("status"))
    c = checks.withColumn("_r", rank)
    worst = c.groupBy(key).agg(F.max("_r").alias("_r"), F.count("*").alias("checks"))
    j = c.join(worst.select(F.col(key).alias("_k"), F.col("_r").alias("_w")), (F.col(key) == F.col("_k")) & (F.col("_r") == F.col("_w")))
    n = j.groupBy(key).agg(F.count("*").alias("affected"), F.min("name").alias("first_name"))
    return worst.join(n, key).select(key, F.element_at(F.array(*[F.lit(s) for s in STATUS_RANK]), F.col("_r").cast("int")).alias("status"), "checks", "affected", "first_name")


def failing_checks(checks: DataFrame, key: str) -> DataFrame:
    """The checks in the worst state of their key, a row each: (key, status, name, nth), numbered by name; healthy keys have none.

    Names have no bound, so they are rows; whoever shows some of them takes the first ones by ``nth``.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_RANK]), F.col("status"))
    c = checks.select(key, "status", "name", rank.alias("_r")).filter("_r > 1")
    worst = c.groupBy(key).agg(F.max("_r").alias("_w")).withColumnRenamed(key, "_k")
    j = c.join(worst, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_r") == F.col("_w")))
    return j.select(key, "status", "name", F.row_number().over(Window.partitionBy(key).orderBy("name")).alias("nth"))


def folder_sweep(listing: DataFrame, as_of, days: int) -> DataFrame:
    """Per top folder: objects, bytes, age bounds, objects per file type, and what is over the time limit.

    ``listing``: key, size, last_modified.
    """
    old = F.col("last_modified") < as_ts(as_of) - F.make_dt_interval(days=F.lit(days))
    rows = listing.withColumn("folder", F.substring_index("key", "/", 1)).withColumn("type", F.lower(F.regexp_extract("key", r"\.([A-Za-z0-9]+)$", 1)))
    per_type = rows.groupBy("folder", "type").agg(
        F.count("*").alias("objects"), F.sum("size").alias("bytes"), F.min("last_modified").alias("oldest"), F.max("last_modified").alias("newest"),
        F.count_if(old).alias("old_objects"), F.coalesce(F.sum(F.when(old, F.col("size"))), F.lit(0)).alias("old_bytes"))
    return per_type.groupBy("folder").agg(
        F.sum("objects").alias("objects"), F.sum("bytes").alias("bytes"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "objects")))).alias("types"), F.sum("old_objects").alias("old_objects"), F.sum("old_bytes").alias("old_bytes"))


def broker_deltas(prev: DataFrame, cur: DataFrame, counters: list[str]) -> DataFrame:
    """Counter growth between two samples per node; none where the node restarted in between.

    Both frames: node, at, uptime_s and the counters.
    """
    p = prev.select("node", F.col("at").alias("_at"), *[F.col(c).alias(f"_p_{c}") for c in counters])
    j = cur.join(p, "node", "left")
    elapsed = seconds_between("at", "_at")
    same = F.coalesce(F.col("uptime_s") >= elapsed, F.lit(False))
    return j.select("node", F.round(elapsed).cast("bigint").alias("delta_sec"), *[F.when(same, F.col(c) - F.col(f"_p_{c}")).alias(f"{c}_delta") for c in counters])


def start_delays(tasks: DataFrame) -> DataFrame:
    """Scheduler wait (previous end to queued) and queue wait (queued to start) per task of a run."""
    t = bucketed_lag(tasks, ["dag_id", "run_id"], ["start_date", "task_id"], "end_date", F.date_trunc("hour", "start_date"), "prev_end")
    return t.withColumn("scheduler_s", seconds_between("queued_dttm", "prev_end")).withColumn("queue_s", seconds_between("start_date", "queued_dttm"))
