"""Delta export: windows, state history, layered settings and checks of the export configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.scalars import col
from tidewatch.operators.common import as_ts, latest_by_key

STATE_KEY = ["replica", "schema_name", "extract_name"]


def shift_seconds(ts, seconds) -> Column:
    return F.timestamp_micros(F.unix_micros(col(ts)) + col(seconds).cast("bigint") * 1_000_000)


def next_window(state: DataFrame, as_of, reached="extract_time", increment_min="increment", overlap_sec="overlap") -> DataFrame:
    """Window of the next export: overlap back from the reached time, forward by the increment or to now."""
    now = as_ts(as_of)
    edge = F.when(F.col(increment_min) > 0, shift_seconds(reached, F.col(increment_min) * 60)).otherwise(now)
    return (
        state.withColumn("time_from", shift_seconds(reached, -F.col(overlap_sec)))
        .withColumn("time_to", F.least(edge, now)).withColumn("is_current", edge >= now)
    )


def delta_filter(df: DataFrame, time_col: str, time_from, time_to) -> DataFrame:
    """Half-open window ``from < t <= to``; plain comparisons, so they reach the scan."""
    return df.filter((F.col(time_col) > as_ts(time_from)) & (F.col(time_col) <= as_ts(time_to)))


def delta_by_window(df: DataFrame, time_col: str, windows: DataFrame, key: str) -> DataFrame:
    """Rows of every extract that fall into its own window, all extracts in one pass."""
    w = windows.select(F.col(key).alias("_k"), "time_from", "time_to")
    return df.join(w, (F.col(key) == F.col("_k")) & (F.col(time_col) > F.col("time_from")) & (F.col(time_col) <= F.col("time_to"))).drop("_k")


def recent_window(as_of, hours: int) -> tuple[Column, Column]:
    """Window of the last hours, without state."""
    now = as_ts(as_of)
    return now - F.make_dt_interval(hours=F.lit(hours)), now


def recent_rows(df: DataFrame, time_col: str, as_of, hours: int) -> DataFrame:
    lo, hi = recent_window(as_of, hours)
    return df.filter(F.col(time_col).between(lo, hi))


def period_window(requests: DataFrame, as_of) -> DataFrame:
    """Ad-hoc periods (date_from, date_to, shift_state, extract_time, mode) with their verdict.

    Both bounds are needed and must be in order; the state may only move forward and not into the future.
    """
    a, b = F.col("date_from"), F.col("date_to")
    shift = F.coalesce(F.col("shift_state"), F.lit(False)) & (F.col("mode") == "delta")
    error = (
        F.when(a.isNull() | b.isNull(), "both bounds are needed").when(b <= a, "end is not after start")
        .when(shift & (b <= F.col("extract_time")), "state may only move forward")
        .when(shift & (b > as_ts(as_of)), "state may not move into the future")
    )
    out = requests.withColumn("error", error)
    # The reached time moves to the end of the period either way; only a shift is written to the history.
    return out.withColumn("writes_state", F.col("error").isNull() & shift).withColumn("new_extract_time", F.when(F.col("error").isNull(), b))


FIRST_YEAR = 2000


def source_start(df: DataFrame, time_col: str, keys: list[str] | None = None) -> DataFrame:
    """Start of the first window: earliest time not before 2000, minus one second.

    No rows at all means "wait"; rows with only older times are an error.
    """
    usable = F.when(F.year(time_col) >= FIRST_YEAR, F.col(time_col))
    g = (df.groupBy(*keys) if keys else df.groupBy()).agg(F.min(usable).alias("_min"), F.count("*").alias("rows"))
    status = F.when(F.col("_min").isNotNull(), "ok").when(F.col("rows") > 0, "error").otherwise("skip")
    return g.select(*(keys or []), "rows", shift_seconds(F.date_trunc("second", "_min"), F.lit(-1)).alias("start"), status.alias("status"))


def history_append(windows: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """State rows after an export: one per exported table, reached time = end of its window."""
    w = windows.drop("extract_time", "extract_count")
    return w.join(results, STATE_KEY).select(
        *STATE_KEY, F.col("time_to").alias("extract_time"), "extract_count", as_ts(as_of).alias("loaded"),
        F.when(F.col("sent_ok"), as_ts(as_of)).alias("sent"), F.lit(None).cast("timestamp").alias("confirmed"),
        "time_from", "time_to", "increment", "overlap", as_ts(as_of).alias("updated_at"))


def state_conflicts(rows: DataFrame) -> DataFrame:
    """Extracts configured in several groups: two active ones conflict, active next to paused is a warning.

    ``rows``: STATE_KEY, dag_group, is_active, is_paused (own or of the group).
    """
    live = rows.filter("coalesce(is_active, true)").groupBy(*STATE_KEY, "dag_group").agg(F.bool_and(F.coalesce("is_paused", F.lit(False))).alias("paused"))
    g = live.groupBy(*STATE_KEY).agg(F.count("*").alias("groups"), F.count_if(~F.col("paused")).alias("active"),
                                     F.array_sort(F.collect_list("dag_group")).alias("names"))
    return g.filter("groups > 1").withColumn("level", F.when(F.col("active") > 1, "error").otherwise("warning"))


def layered_params(registry: DataFrame, name: str, own: list[str], shared: list[str], default: str = "default") -> DataFrame:
    """Settings of every extract: own columns as they are, shared ones fall back to the default row."""
    # Several default rows: the smallest value of each column counts, whatever their order.
    base = registry.filter(F.col(name) == default).agg(*[F.min(c).alias(f"_d_{c}") for c in shared])
    real = lambda c: F.when(F.lower(c) != default, c)
    rows = registry.filter(F.col(name) != default).join(F.broadcast(base), F.lit(True), "left")
    return rows.select(name, *own, *[F.coalesce(real(F.col(c)), real(F.col(f"_d_{c}"))).alias(c) for c in shared])


def group_params(rows: DataFrame, defaults: DataFrame, columns: list[str]) -> DataFrame:
    """Settings of an extract over those of its group's default row."""
    d = defaults.select("replica", "dag_group", *[F.col(c).alias(f"_g_{c}") for c in columns])
    j = rows.join(d, ["replica", "dag_group"], "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_g_{c}")) for c in columns}).drop(*[f"_g_{c}" for c in columns])


def auto_confirm(history: DataFrame, keys: list[str], as_of) -> DataFrame:
    """New versions of states that were sent but never confirmed."""
    cur = latest_by_key(history, keys, [F.desc("updated_at")])
    return cur.filter("sent is not null and confirmed is null").withColumn("confirmed", as_ts(as_of)).withColumn("updated_at", as_ts(as_of))


CRON = r"^\s*(@(hourly|daily|weekly|monthly|yearly|once)|(\S+\s+){4}\S+)\s*$"


def _normal_groups(config: DataFrame) -> DataFrame:
    group = F.coalesce(F.nullif(F.trim("dag_group"), F.lit("")), F.lit("0"))
    return config.withColumn("dag_group", group).withColumn("_default", F.coalesce(F.col("extract_name"), F.lit("")) == "")


def resolve_groups(config: DataFrame) -> DataFrame:
    """Active extracts of active groups with the schedule and pause of their group.

    A row without extract name is the default row of its group; switching it off removes the
    whole group, so that extracts never fall back to built-in settings.
    """
    c = _normal_groups(config)
    defaults = c.filter("_default").select(
        "replica", "dag_group", F.col("is_active").alias("_on"), F.col("schedule").alias("group_schedule"),
        F.col("is_paused").alias("group_paused"), F.col("schema_name").alias("_d_schema"), F.lit(1).alias("_d"))
    rows = c.filter("not _default and coalesce(is_active, true)").join(defaults, ["replica", "dag_group"], "left")
    return rows.filter("coalesce(_on, true)").drop("_on", "_default")


def group_errors(resolved: DataFrame) -> DataFrame:
    """Groups that cannot run, with the reason; they stay visible next to the healthy ones."""
    g = resolved.groupBy("replica", "dag_group").agg(
        F.max("_d").alias("d"), F.max(F.nullif("_d_schema", F.lit(""))).alias("s"), F.max(F.nullif(F.trim("group_schedule"), F.lit(""))).alias("sched"))
    reason = (
        F.when(F.col("d").isNull(), "no default row").when(F.col("s").isNotNull(), "schema on the default row")
        .when(F.col("sched").isNull(), "no schedule").when(~F.col("sched").rlike(CRON), "invalid schedule"))
    own = g.select("replica", "dag_group", reason.alias("error")).filter("error is not null")
    paused = resolved.withColumn("is_paused", F.coalesce("is_paused", F.lit(False)) | F.coalesce("group_paused", F.lit(False)))
    clash = state_conflicts(paused.select(*STATE_KEY, "dag_group", "is_active", "is_paused")).filter("level = 'error'")
    hit = paused.filter("not is_paused").join(clash.select(*STATE_KEY), STATE_KEY, "left_semi")
    return own.unionByName(hit.select("replica", "dag_group", F.lit("extract active in several groups").alias("error")).distinct())


def group_warnings(resolved: DataFrame) -> DataFrame:
    """Settings that are ignored: a schedule on an extract instead of its group."""
    return resolved.filter(F.coalesce(F.trim("schedule"), F.lit("")) != "").select(
        "replica", "dag_group", "extract_name", F.lit("schedule of an extract is ignored").alias("warning"))


def runnable(resolved: DataFrame) -> DataFrame:
    """Extracts of groups without errors."""
    return resolved.join(group_errors(resolved).select("replica", "dag_group").distinct(), ["replica", "dag_group"], "left_anti")


def config_diff(old: DataFrame, new: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Field-level changes of configuration rows; unknown fields are refused."""
    unknown = [c for c in new.columns if c != key and c not in allowed]
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    fields = [c for c in allowed if c in new.columns]
    o = old.select(key, *[F.col(c).cast("string").alias(f"o_{c}") for c in fields], F.lit(True).alias("_known"))
    j = new.select(key, *[F.col(c).cast("string").alias(f"n_{c}") for c in fields]).join(o, key, "left")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").alias("was"), F.col(f"n_{c}").alias("now")) for c in fields]))
    return j.select(key, "_known", cells.alias("c")).select(key, "_known", "c.*").filter(
        F.col("_known").isNull() | ~F.col("was").eqNullSafe(F.col("now"))).drop("_known")


def stuck_state(config: DataFrame, state: DataFrame) -> DataFrame:
    """Delta extracts whose reached time is before 2000: they export empty windows for years."""
    delta = config.filter("not coalesce(full_export, false) and not coalesce(is_recent, false)")
    return delta.join(state.select(*STATE_KEY, "extract_time"), STATE_KEY).filter(F.year("extract_time") < FIRST_YEAR)


def service_columns(df: DataFrame, export_time) -> DataFrame:
    """Export time in front, change action and validity at the end."""
    return df.select(as_ts(export_time).alias("export_time"), "*", F.lit("I").alias("ctl_action"), as_ts(export_time).alias("ctl_validfrom"))


def row_limit(df: DataFrame, stand: str, limit: int, production: str = "prod") -> DataFrame:
    """Fewer rows outside production; 0 means no limit."""
    return df if stand == production or not limit else df.limit(limit)


def lag_report(state: DataFrame, as_of) -> DataFrame:
    """Minutes behind per extract and whether its last package waits for an answer."""
    lag = F.floor((F.unix_timestamp(as_ts(as_of)) - F.unix_timestamp("extract_time")) / 60).cast("bigint")
    return state.select(
        *STATE_KEY, "extract_time", lag.alias("lag_min"),
        (F.col("sent").isNotNull() & F.col("confirmed").isNull()).alias("waits_receipt"),
        (F.to_date("confirmed") == as_ts(as_of).cast("date")).alias("confirmed_today"))


def export_state(history: DataFrame) -> DataFrame:
    """Current state per extract: versions collapsed, then the newest window."""
    versions = latest_by_key(history, [*STATE_KEY, "extract_time"], [F.desc("updated_at")])
    return versions.groupBy(*STATE_KEY).agg(
        F.count("*").alias("states"), F.max("extract_time").alias("extract_time"),
        *[F.max_by(c, "extract_time").alias(c) for c in ("extract_count", "loaded", "sent", "confirmed", "increment", "overlap")])
