"""Data-quality checks: growth z-test, uniqueness, count deltas, fingerprints, comparisons."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidewatch.functions.scalars import col, grouped, try_timestamp
from tidewatch.operators.common import as_date, as_ts, bucketed_running, latest_by_key
from tidewatch.operators.rules import Rule, rule_values, safe_expr
from tidewatch.session import scratch_dir, truncate_lineage

# --- statistics of a load --------------------------------------------------------------------


def load_stats(df: DataFrame, name: str, period=None, load=None, key=None) -> DataFrame:
    """Row count and bounds of the business, load and key columns of one object."""
    none = F.lit(None).cast("string")
    pick = lambda c: none if c is None else col(c)
    return df.agg(
        F.count("*").alias("rows_count"),
        F.min(pick(period)).alias("data_min"), F.max(pick(period)).alias("data_max"),
        F.min(pick(load)).alias("load_min"), F.max(pick(load)).alias("load_max"),
        F.min(pick(key)).cast("string").alias("key_min"), F.max(pick(key)).cast("string").alias("key_max"),
    ).select(F.lit(name).alias("object"), "*")


def candidate_dates(stats: DataFrame, as_of) -> DataFrame:
    """Candidate key dates of a load in order of trust: key, load, business date, today."""
    day = lambda c: try_timestamp(F.col(c).cast("string")).cast("date")
    return stats.withColumn(
        "key_dates", F.array(day("key_max"), day("load_max"), day("data_max"), as_date(as_of))
    )


def ztest_key_date(dates, key_index, as_of) -> Column:
    """The configured position, else the first known date not in the future; never after today."""
    arr, idx, today = col(dates), col(key_index), as_date(as_of)
    first = F.try_element_at(F.filter(arr, lambda d: d <= today), F.lit(1))
    # Nothing fits: the walk ends on the last candidate.
    scanned = F.coalesce(first, F.try_element_at(arr, F.lit(-1)))
    by_index = F.when(idx.isNotNull() & (F.size(arr) >= idx), F.try_element_at(arr, idx))
    return F.least(F.when(idx.isNull() | (F.size(arr) < idx), scanned).otherwise(by_index), today)


# --- z-test of daily growth ------------------------------------------------------------------

CONFIG_DEFAULT_DOTS = 90
WIDE_BAND, BAND = 10.0, 5.0
FAR_PAST = "1900-01-01"


def ztest_cases(measurements: DataFrame, config: DataFrame, as_of) -> DataFrame:
    """Measurements (object, key_date | key_dates, rows_count, ts, log_id) with their settings."""
    cfg = config.withColumnRenamed("min", "z_min").withColumnRenamed("max", "z_max")
    m = measurements.join(cfg, "object", "left").filter("coalesce(active, true)")
    if "key_dates" in measurements.columns:
        m = m.withColumn("key_date", ztest_key_date("key_dates", F.col("key"), as_of)).drop("key_dates")
    else:
        m = m.withColumn("key_date", F.least(F.col("key_date"), as_date(as_of)))
    small = F.col("rows_count") <= F.col("hist")
    return (
        m.withColumn("row_min", F.when(~small, F.col("hist") + 1).otherwise(F.lit(0)))
        .withColumn("row_max", F.when(small, F.col("hist")).otherwise(F.lit(2**63 - 1)))
        .fillna({"skip": True})
    )


def _nulls_top(*columns: str) -> Column:
    """Ordering key in which a NULL beats every value, as descending order has it in the source engine."""
    return F.struct(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


LAST_COLUMNS = ("key_date", "rows_count", "avg", "std", "cnt", "min", "max")


def ztest_state(history: DataFrame, cases: DataFrame) -> DataFrame:
    """What the history says about every measurement (object, log_id): the last usable record and the newest values.

    The history is joined and shuffled once. Versions of a key date collapse map-side to one row
    per (measurement, key date), so the ranking below runs over at most one row per calendar day.

    The baseline may be a record without a value; the statistics may not.
    """
    h = history.select("object", *[F.col(c).alias(f"h_{c}") for c in history.columns if c != "object"])
    keep = ["object", "key_date", "interval_days", "skip", "beg", "dots", "z_except", "z_error", "row_min", "row_max", "z_min", "z_max"]
    listed = lambda c: F.coalesce(F.array_contains(c, F.col("h_key_date")), F.lit(False))
    value = F.col("h_value")
    low, high = F.coalesce("z_min", F.lit(-(2**63 - 1))), F.coalesce("z_max", F.lit(2**63 - 1))
    j = h.join(cases.select("log_id", *keep), "object").filter(
        (F.col("h_key_date") < F.col("key_date")) & ~listed("z_error")
        & (F.col("h_key_date") >= F.coalesce("beg", F.lit(FAR_PAST).cast("date")))
        & F.col("h_rows_count").between(F.col("row_min"), F.col("row_max"))
        & (value.isNull() | (value.between(low, high) & ~(F.col("skip") & (value == 0)))))
    is_base = F.col("h_key_date") <= F.date_sub("key_date", F.coalesce("interval_days", F.lit(1)))
    is_point = value.isNotNull() & (F.coalesce("h_ztest", F.lit(True)) | listed("z_except"))
    newest = _nulls_top("h_ztest", "h_ts", "h_log_id")
    record = F.struct(*[F.col(f"h_{c}").alias(c) for c in LAST_COLUMNS])
    per_date = j.groupBy("object", "log_id", "h_key_date").agg(
        F.max_by(F.when(is_base, record), F.when(is_base, newest)).alias("base"),
        F.max_by(F.when(is_point, value), F.when(is_point, newest)).alias("point"),
        F.max(F.coalesce("dots", F.lit(CONFIG_DEFAULT_DOTS))).alias("dots"))
    nth = F.count("point").over(Window.partitionBy("object", "log_id").orderBy(F.desc("h_key_date")).rowsBetween(Window.unboundedPreceding, 0))
    per_date = per_date.withColumn("n", nth)
    # The list holds at most ``dots`` values.
    return per_date.groupBy("object", "log_id").agg(
        F.max_by("base", F.when(F.col("base").isNotNull(), F.col("h_key_date"))).alias("last"),
        F.collect_list(F.when(F.col("n") <= F.col("dots"), F.col("point"))).alias("points"))


def ztest_baseline(history: DataFrame, cases: DataFrame) -> DataFrame:
    """Last usable record of an object before each of its measurements."""
    return ztest_state(history, cases).filter("last is not null").select(
        "object", "log_id", *[F.col("last")[c].alias(f"last_{c}") for c in LAST_COLUMNS])


def ztest_score(history: DataFrame, cases: DataFrame) -> DataFrame:
    """z-score of the newest daily growth of every object against its history plus itself."""
    c = cases.join(ztest_state(history, cases), ["object", "log_id"], "left")
    c = c.select(*cases.columns, *[F.col("last")[x].alias(f"last_{x}") for x in LAST_COLUMNS], "points")
    have = F.col("last_key_date").isNotNull()
    c = c.withColumn("key_diff", F.datediff("key_date", "last_key_date")).withColumn(
        "value", F.expr("(rows_count - last_rows_count) div nullif(key_diff, 0)"))
    c = c.withColumn("_p", F.when(have, F.transform(F.concat("points", F.array("value")), lambda x: x.cast("double"))))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    c = c.withColumn("cnt", F.when(have, F.size("_p").cast("bigint"))).withColumn("avg", total(F.col("_p")) / F.col("cnt"))
    c = c.withColumn("std", F.sqrt(total(F.transform("_p", lambda x: (x - F.col("avg")) * (x - F.col("avg")))) / F.col("cnt")))
    std = F.coalesce(F.nullif(F.col("std"), F.lit(0.0)), F.lit(1.0))
    return (
        c.withColumn("min", F.array_min("_p").cast("bigint")).withColumn("max", F.array_max("_p").cast("bigint"))
        .withColumn("zscore", F.when(have, (F.col("value") - F.col("avg")) / std).otherwise(F.lit(0.0)))
        .withColumn("stability", F.when(have, F.col("std") / F.nullif(F.col("avg"), F.lit(0.0)))).drop("_p", "points")
    )


def _verdict_rules(c) -> list[tuple[Column, Column, Column]]:
    """(condition, verdict, text) in the order they are tried."""
    yes, no, unknown = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    day = F.col("key_date")
    within = lambda band: F.col("zscore").between(
        F.coalesce("zfr", F.lit(-band)), F.coalesce("zto", F.lit(band)))
    txt = lambda x: F.col(x).cast("string")
    span = lambda op, edge: F.concat(F.lit("Key_date ("), txt("key_date"), F.lit(f") {op} {edge} ("), txt(edge), F.lit(")"))
    bound = lambda op, edge: F.concat(F.lit(f"No {op} {edge} ("), txt("z_" + edge), F.lit(")"))
    return [
        (F.array_contains("z_except", day), yes, F.lit("Ok z_except")),
        (F.array_contains("z_error", day), no, F.lit("No z_error")),
        (day > F.col("end"), unknown, span(">", "end")),
        (day < F.col("beg"), unknown, span("<", "beg")),
        (F.col("last_key_date").isNull(), yes, F.lit("Ok first")),
        (F.col("value") < F.col("z_min"), no, bound("<", "min")),
        (F.col("value") > F.col("z_max"), no, bound(">", "max")),
        ((F.abs("stability") < 0.01) & within(WIDE_BAND), yes, F.lit("Ok")),
        (within(BAND), yes, F.lit("Ok")),
    ]


def ztest_verdict(scored: DataFrame) -> DataFrame:
    """Verdict and message; a failing point keeps the statistics of the previous record."""
    ok = text = None
    for cond, verdict, words in _verdict_rules(scored):
        ok = F.when(cond, verdict) if ok is None else ok.when(cond, verdict)
        text = F.when(cond, words) if text is None else text.when(cond, words)
    out = scored.withColumn("ztest", ok.otherwise(F.lit(False))).withColumn("verdict", text.otherwise(F.lit("No")))
    failed = F.col("ztest").isNotNull() & ~F.col("ztest") & F.col("last_key_date").isNotNull()
    for c in ("avg", "std"):
        out = out.withColumn(c, F.when(failed, F.col("last_" + c).cast("double")).otherwise(F.col(c)))
    for c in ("cnt", "min", "max"):
        out = out.withColumn(c, F.when(failed, F.col("last_" + c)).otherwise(F.col(c)))
    number = lambda c: F.coalesce(F.format_number(c, 2), F.lit(""))
    msg = F.concat(
        F.col("verdict"), F.lit(" "), F.col("key_date").cast("string"), F.lit(" "), number("zscore"), F.lit(" ("),
        number("stability"), F.lit(") value "),
        F.coalesce(F.concat(F.when(F.col("value") < 0, "").otherwise("+"), grouped("value")), F.lit("")),
        F.lit(" * "), F.coalesce(F.col("key_diff").cast("string"), F.lit("")), F.lit(" rows "), grouped("rows_count"),
        F.when(F.col("hist").isNotNull(), " hist").otherwise(" "),
    )
    return out.withColumn("msg", msg)


RESULT_COLUMNS = ["object", "key_date", "rows_count", "key_diff", "value", "avg", "std", "cnt", "min", "max",
                  "zscore", "ztest", "verdict", "msg", "rollback", "ts", "log_id"]


def ztest_run(history: DataFrame, config: DataFrame, measurements: DataFrame, as_of) -> DataFrame:
    """One result row per measured object, ready to be appended to the history."""
    out = ztest_verdict(ztest_score(history, ztest_cases(measurements, config, as_of)))
    whole = lambda c: F.round(F.col(c)).cast("bigint").alias(c)
    return out.select(*[whole(c) if c in ("avg", "std") else c for c in RESULT_COLUMNS])


def ztest_blocking(results: DataFrame) -> DataFrame:
    """Failed results of objects whose settings ask for a rollback; feed to ``gate``."""
    return results.filter("not ztest and rollback and log_id >= 0")


REPLAY_SCHEMA = ("object string, key_date date, rows_count bigint, key_diff int, value bigint, avg double, "
                 "std double, cnt bigint, zscore double, ztest boolean")


class _Series:
    """What later days need of one object's replay: usable records and the newest values, apart for small and large loads if `hist` splits them."""

    def __init__(self, setting: dict, state: str | None, dots: int):
        unset = lambda x: x is None or x is pd.NaT or (isinstance(x, float) and x != x)
        self.cfg = {k: v for k, v in setting.items() if k in ("z_except", "z_error") or not unset(v)}
        self.dots, self.gap = int(self.cfg.get("dots", dots)), int(self.cfg.get("interval_days", 1))
        self.excepted, self.wrong = ({str(d)[:10] for d in self.cfg.get(k)} if self.cfg.get(k) is not None else set() for k in ("z_except", "z_error"))
        held = json.loads(state) if state else {}
        self.records, self.points = held.get("records", {}), held.get("points", {})

    def state(self) -> str:
        return json.dumps({"records": self.records, "points": self.points})

    def add(self, day, rows: int) -> dict:
        """The result of the next day; it is remembered as far as later days may use it."""
        cfg, text = self.cfg, str(day)[:10]
        part = "all" if "hist" not in cfg else "small" if rows <= cfg["hist"] else "large"
        number, records, points = day.toordinal(), self.records.setdefault(part, []), self.points.setdefault(part, [])
        before = [r for r in records if r[0] <= number - self.gap]
        last = before[-1] if before else None
        out = dict(key_date=day, rows_count=rows, zscore=0.0)
        value = stable = None
        if last is not None:
            gap, grown = number - last[0], int(rows - last[1])
            value = grown // gap if grown >= 0 else -(-grown // gap)
            pts = np.array([*points, value], dtype=float)
            avg, std = float(pts.mean()), float(pts.std())
            stable = bool(avg) and abs(std / avg) < 0.01
            out.update(key_diff=gap, value=value, avg=avg, std=std, cnt=len(pts), zscore=(value - avg) / (std or 1.0))
        ok = self._verdict(day, text, value, stable, out["zscore"])
        if ok is False and last is not None:
            out.update(avg=last[2], std=last[3], cnt=last[4])
        low, high = cfg.get("min", -(2**63)), cfg.get("max", 2**63)
        usable = text not in self.wrong and not ("beg" in cfg and text < str(cfg["beg"])[:10]) and (value is None or low <= value <= high and not (cfg.get("skip", True) and value == 0))
        if usable:
            records.append([number, int(rows), out.get("avg"), out.get("std"), out.get("cnt")])
            del records[: max(0, len([r for r in records if r[0] <= number + 1 - self.gap]) - 1)]
            if value is not None and (ok is not False or text in self.excepted):
                points.append(value)
                del points[: -self.dots]
        return out | {"ztest": ok}

    def _verdict(self, day, text: str, value: int | None, stable: bool | None, z: float) -> bool | None:
        cfg = self.cfg
        if text in self.excepted or text in self.wrong:
            return text in self.excepted
        if "end" in cfg and text > str(cfg["end"])[:10] or "beg" in cfg and text < str(cfg["beg"])[:10]:
            return None
        if value is None:
            return True
        if value < cfg.get("min", value) or value > cfg.get("max", value):
            return False
        within = lambda band: cfg.get("zfr", -band) <= z <= cfg.get("zto", band)
        return bool(stable and within(WIDE_BAND) or within(BAND))


SETTINGS = ["hist", "min", "max", "interval_days", "skip", "beg", "end", "dots", "zfr", "zto", "z_except", "z_error"]


def ztest_replay_run(measurements: DataFrame, config: DataFrame | None = None, state: DataFrame | None = None, dots: int = CONFIG_DEFAULT_DOTS) -> tuple[DataFrame, DataFrame]:
    """Replay whole series in key order with all settings: the results, and the state (object, state) to go on from.

    Verdicts depend on earlier verdicts: a failed point leaves the baseline of later ones. An object is replayed by one task, over the
    newest measurement per key date, at most one row per calendar day. Given the ``state`` of an earlier run, only
    later days are worked out, with the same results as in one run; it holds ``dots`` values and the records of one
    interval per object, however long the series. Objects that are not ``active`` are left out.
    """
    daily = latest_by_key(measurements.select("object", "key_date", "rows_count", "ts"), ["object", "key_date"],
                          [F.desc("ts"), F.desc("rows_count")]).drop("ts").filter("key_date is not null and rows_count is not null")
    empty = measurements.sparkSession.createDataFrame([], "object string, state string")
    held = state if state is not None else empty
    columns = [F.lit(None).alias(c) for c in SETTINGS] if config is None else [F.col(c) for c in SETTINGS]
    rules = (empty.select("object", F.lit(True).alias("active"), *columns) if config is None else config.select("object", F.coalesce("active", F.lit(True)).alias("active"), *columns))
    known = held.join(rules, "object", "full").filter("coalesce(active, true)").select("object", "state", *SETTINGS)
    off = rules.filter("not active").select("object")
    daily = daily.join(off, "object", "left_anti")

    def replay(rows: pd.DataFrame, settings: pd.DataFrame) -> pd.DataFrame:
        own = settings.iloc[0].to_dict() if len(settings) else {}
        series = _Series({k: own.get(k) for k in SETTINGS}, own.get("state"), dots)
        name = (rows if len(rows) else settings)["object"].iloc[0]
        days = rows.sort_values("key_date")
        out = [series.add(d, n) for d, n in zip(days.key_date, days.rows_count, strict=True)]
        out.append({"state": series.state()})
        res = pd.DataFrame(out, columns=["key_date", "rows_count", "key_diff", "value", "avg", "std", "cnt", "zscore", "ztest", "state"])
        res.insert(0, "object", name)
        for c in ("rows_count", "key_diff", "value", "cnt"):
            res[c] = res[c].astype("Int64")
        return res

    both = truncate_lineage(daily.groupBy("object").cogroup(known.groupBy("object")).applyInPandas(replay, REPLAY_SCHEMA + ", state string"), "replay")
    return both.filter("state is null").drop("state"), both.filter("state is not null").select("object", "state")


def ztest_replay(measurements: DataFrame, dots: int = CONFIG_DEFAULT_DOTS) -> DataFrame:
    """Results of :func:`ztest_replay_run` with the usual settings."""
    return ztest_replay_run(measurements, dots=dots)[0]


def ztest_config_set(old: DataFrame, patch: DataFrame) -> DataFrame:
    """Upsert of settings: each field is the new value, else the stored one, else the default."""
    dates = F.array().cast("array<date>")
    default = {"active": F.lit(True), "rollback": F.lit(False), "z_cfg": F.lit(None).cast("string"),
               "z_except": dates, "z_error": dates}
    a, b = old.alias("a"), patch.alias("b")
    return a.join(b, F.col("a.object") == F.col("b.object"), "full").select(
        F.coalesce("b.object", "a.object").alias("object"),
        *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"), d).alias(c) for c, d in default.items()],
    )


def ztest_view(history: DataFrame, config: DataFrame) -> DataFrame:
    """Results with verdict, list membership, confidence and stability."""
    cfg = config.filter("active").select(
        "object", F.col("zfr").alias("_fr"), F.col("zto").alias("_to"), "z_except", "z_error", "rollback")
    z = F.col("zscore")
    return history.join(cfg, "object", "left").select(
        *history.columns,
        F.coalesce("ztest", z.between(F.coalesce("_fr", F.lit(-BAND)), F.coalesce("_to", F.lit(BAND)))).alias("ztest_ok"),
        F.array_contains("z_except", F.col("key_date")).alias("is_except"),
        F.array_contains("z_error", F.col("key_date")).alias("is_error"),
        F.coalesce(F.round(F.lit(100) - F.abs(z.cast("decimal(20,6)")) * 2).cast("int"), F.lit(0)).alias("confidence"),
        (F.col("std") / F.nullif(F.col("avg").cast("double"), F.lit(0.0))).alias("stable"),
        "rollback",
    )


# --- uniqueness, counts, fingerprints ---------------------------------------------------------

INDEX_BUCKET = 4096
MOMENT_BUCKETS = 128


def chk_uniq(df: DataFrame, keys: list[str], from_col: str | None = None, to_col: str | None = None,
             limit: int | None = None) -> DataFrame:
    """Keys that occur more than once at the same moment, with their total count and first moment.

    A moment is any boundary of any validity range. Instead of joining every moment with every
    range, boundaries get a dense number; each range becomes +1/-1 at its ends, summed per
    (keys, number), and the running sum gives the number of rows valid on each stretch.
    """
    if from_col is None or to_col is None:
        dup = df.groupBy(*keys).agg(F.count("*").alias("cnt")).filter("cnt > 1")
        return dup if limit is None else dup.orderBy(F.desc("cnt"), *keys).limit(limit)

    rows = df.select(*keys, F.col(from_col).cast("timestamp").alias("f"), F.col(to_col).cast("timestamp").alias("t"))
    moments = rows.select(F.explode(F.array("f", "t")).alias("cd")).filter("cd is not null").distinct()
    # Buckets of nearly equal size whatever the dates: each moment's place among quantiles of all moments.
    cuts = moments.agg(F.percentile_approx(F.unix_micros("cd"), [i / MOMENT_BUCKETS for i in range(1, MOMENT_BUCKETS)], 10_000).alias("_cuts"))
    placed = moments.crossJoin(F.broadcast(cuts)).withColumn("_place", F.size(F.filter("_cuts", lambda c: c <= F.unix_micros("cd")))).drop("_cuts")
    numbered = bucketed_running(placed.withColumn("_one", F.lit(1).cast("bigint")), [], "cd", "_one", F.col("_place"), "pos").select("cd", "pos")
    steps = (
        rows.filter("f <= t")
        .select(*keys, F.explode(F.array(
            F.struct(F.col("f").alias("cd"), F.lit(0).alias("shift"), F.lit(1).cast("bigint").alias("d")),
            F.struct(F.col("t").alias("cd"), F.lit(1).alias("shift"), F.lit(-1).cast("bigint").alias("d")),
        )).alias("s"))
        .select(*keys, "s.cd", "s.shift", "s.d")
        # Built per partition: a moment shared by many rows is split by the skew handling.
        .join(numbered, "cd")
        .groupBy(*keys, (F.col("pos") + F.col("shift")).alias("pos")).agg(F.sum("d").alias("d"))
    )
    spans = bucketed_running(steps, keys, "pos", "d", F.expr(f"pos div {INDEX_BUCKET}"), "valid", "next_pos")
    bad = (
        spans.filter("valid > 1")
        .groupBy(*keys).agg(F.sum(F.col("valid") * (F.col("next_pos") - F.col("pos"))).alias("cnt"), F.min("pos").alias("pos"))
    )
    out = bad.join(numbered, "pos").drop("pos")
    return out if limit is None else out.orderBy(F.desc("cnt"), *keys).limit(limit)


def chk_cnt_delta(df: DataFrame, date_col: str, key: str | None = None, pct: float = 10, from_date=None,
                  load_col: str | None = None, load_value=None) -> tuple[DataFrame, DataFrame]:
    """Dates whose count differs from the previous date by more than ``pct`` percent.

    Returns the violations and a one-row summary with the number of dates checked: zero dates
    means nothing was checked.
    """
    rows = df.filter(F.col(date_col).isNotNull())
    if from_date is not None:
        rows = rows.filter(F.col(date_col) >= F.lit(str(from_date)).cast("date"))
    if load_col is not None:
        rows = rows.filter(F.col(load_col) == as_ts(load_value))
    counted = F.count("*") if key is None else F.countDistinct(key)
    per_date = rows.groupBy(F.to_date(date_col).alias("cd")).agg(counted.alias("cnt"))
    # From here on there is one row per calendar date.
    over = Window.orderBy("cd")
    seq = per_date.withColumn("prev_cd", F.lag("cd").over(over)).withColumn("prev_cnt", F.lag("cnt").over(over))
    change = F.abs(F.col("cnt") - F.col("prev_cnt")) * 100
    broken = F.when(F.col("prev_cnt") == 0, F.col("cnt") != 0).otherwise(change > F.lit(float(pct)) * F.col("prev_cnt"))
    seq = seq.withColumn("broken", F.coalesce(F.col("prev_cnt").isNotNull() & broken, F.lit(False)))
    delta = (F.col("cnt") - F.col("prev_cnt")).cast("decimal(20,0)") * 100 / F.nullif(F.col("prev_cnt"), F.lit(0)).cast("decimal(20,0)")
    violations = seq.filter("broken").select(
        "cd", "prev_cd", "cnt", "prev_cnt", F.round(delta, 2).alias("delta_pct"), F.lit(float(pct)).alias("limit_pct"))
    summary = seq.agg(F.count_if("broken").alias("err"), F.count("*").alias("dates"))
    return violations, summary


def row_text(columns: list[str]) -> Column:
    """Text of a row in which NULL, an empty string and column borders stay apart."""
    return F.concat_ws("|", *[
        F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
        for c in columns])


def table_fingerprint(df: DataFrame, columns: list[str], dates: dict[str, str] | None = None) -> DataFrame:
    """Content hash that does not depend on row order, with count and bounds of date columns.

    Row hashes are combined by sum and xor of two halves, which add up map-side: no sort and no
    concatenation of all hashes.
    """
    h = F.md5(row_text(columns))
    half = lambda start: F.conv(F.substring(h, start, 15), 16, 10).cast("bigint")
    rows = df.select(half(1).alias("a"), half(17).alias("b"), *[F.col(c) for c in (dates or {}).values()])
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    bounds = []
    for name, c in (dates or {}).items():
        bounds += [F.min(c).alias(name + "min"), F.max(c).alias(name + "max")]
    return rows.agg(
        F.md5(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(wide("a"), F.lit(0)).cast("string"),
                          F.coalesce(wide("b"), F.lit(0)).cast("string"),
                          F.coalesce(F.bit_xor("a"), F.lit(0)).cast("string"),
                          F.coalesce(F.bit_xor("b"), F.lit(0)).cast("string"))).alias("hash"),
        F.count("*").alias("cnt"), *bounds)


def change_status(current: DataFrame, last_ok: DataFrame, keys: list[str], expire, allow_empty: bool = False) -> DataFrame:
    """Compare the current value with the last accepted one: -1 empty, 0 same, -2 same but too old, 1 new.

    ``current`` has ``keys, cnt, value``; ``last_ok`` has ``keys, value, ts``.
    """
    prev = last_ok.select(*keys, F.col("value").alias("last_value"), F.col("ts").alias("last_ts"))
    empty = F.lit(not allow_empty) & (F.coalesce("cnt", F.lit(0)) == 0)
    same = F.coalesce(F.col("value") == F.col("last_value"), F.lit(False))
    recent = F.col("last_ts") >= as_ts(expire)
    res = F.when(empty, -1).when(same & recent, 0).when(same, -2).otherwise(1)
    text = F.when(empty, "Empty").when(same & recent, "No new").when(same, "Expire").otherwise("Ok")
    return current.join(prev, keys, "left").withColumn("res", res).withColumn("msg", text)


# Column names recognised as key, load and report dates.
DATE_ROLES = {"kdt": "actual_date", "ldt": "load_date", "rdt": "report_date"}


def detect_date_columns(schema: T.StructType, roles: dict[str, str] = DATE_ROLES) -> dict[str, str]:
    """Known date columns present in a schema with a date or timestamp type."""
    typed = {f.name for f in schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))}
    return {role: name for role, name in roles.items() if name in typed}


COMPARISONS = {"=", "<", ">", "<=", ">=", "<>", "!="}


def business_date_check(tables: dict[str, DataFrame], rules: list[dict]) -> DataFrame:
    """One row per rule: does the aggregate business date satisfy its condition; each table is read once.

    A rule that can't be worked out has no result and the reason in ``problem``.
    """
    spark = next(iter(tables.values())).sparkSession
    values = rule_values(spark, tables, [Rule(str(i), r["tbl"], r["bdate"], r.get("whr")) for i, r in enumerate(rules)], "date")
    shown, conditions = [], []
    for i, r in enumerate(rules):
        bad = None if r["operation"] in COMPARISONS else f"unknown comparison {r['operation']}"
        try:
            spark.range(1).select(condition := safe_expr(r["condition"]).cast("date"))
        except (ValueError, ParseException, AnalysisException) as e:
            bad, condition = bad or str(e).strip().split("\n")[0], F.lit(None).cast("date")
        conditions.append(F.struct(F.lit(str(i)).alias("rule"), F.lit(r["tbl"]).alias("tbl"), F.lit(r["operation"]).alias("operation"), condition.alias("condition"), F.lit(bad).cast("string").alias("bad")))
        if not bad:
            shown.append(F.when(F.col("rule") == str(i), F.expr(f"value {r['operation']} condition")))
    listed = spark.range(1).select(F.explode(F.array(*conditions)).alias("c")).select("c.*")
    res = F.coalesce(*shown, F.lit(None).cast("boolean")) if shown else F.lit(None).cast("boolean")
    joined = values.join(F.broadcast(listed), "rule").withColumn("problem", F.coalesce("problem", "bad"))
    return joined.select("tbl", F.col("value").alias("bdate"), "operation", "condition", F.when(F.col("problem").isNull(), res).alias("res"), "problem")


def business_date_status(checked: DataFrame, last_min: DataFrame) -> DataFrame:
    """-3 when any rule fails, 0 when the minimum date did not move, else 1."""
    checked = checked.filter("problem is null") if "problem" in checked.columns else checked
    worst = checked.orderBy(F.asc_nulls_last("res"), F.asc_nulls_last("bdate"), "operation", "condition").limit(1)
    same = F.coalesce(F.col("bdate") == F.col("last_bdate"), F.lit(False))
    return worst.crossJoin(F.broadcast(last_min.select(F.max("bdate").alias("last_bdate")))).select(
        F.when(~F.col("res"), -3).when(same, 0).otherwise(1).alias("code"),
        F.when(~F.col("res"), "Error").when(same, "No new").otherwise("Ok").alias("msg"),
        F.col("bdate").alias("min_bd"))


def reconcile_counts(meta: DataFrame, target: DataFrame, how: str = "full", with_key: bool = True, with_id: bool = True,
                     last_source_id: bool = False, last_target_id: bool = False, not_empty: bool = False, only_errors: bool = False,
                     now=None) -> DataFrame:
    """Announced count per (id, name, key) against the rows that arrived.

    ``last_source_id`` and ``last_target_id`` keep the newest package of the whole source and of the whole target; ``now``
    keeps rows of that load time (column ``ts`` of both sides). ``not_empty`` turns missing and empty results into errors.
    """
    keys = [k for k, on in (("id", with_id), ("name", True), ("key", with_key)) if on]
    announced, arrived = meta.filter("type in ('OUT', 'SUM')"), target
    newest = lambda d, of: d.join(F.broadcast(of.agg(F.max("id").alias("id"))), "id", "left_semi")
    if last_source_id:
        announced = newest(announced, meta)
    if last_target_id:
        arrived = newest(arrived, target)
    if now is not None:
        announced, arrived = (d.filter(F.col("ts") == as_ts(now)) for d in (announced, arrived))
    # The summary row of a package counts itself.
    cnt = F.col("cnt") + F.when(F.col("type") == "SUM", 1).otherwise(0)
    announced = announced.groupBy(*keys).agg(F.sum(cnt).alias("expected"))
    actual = arrived.groupBy(*keys).agg(F.count("*").alias("actual"))
    out = announced.join(actual, keys, how)
    ok = F.col("expected").eqNullSafe(F.col("actual"))
    if not_empty:
        ok = ok & (F.coalesce("actual", F.lit(0)) > 0)
    out = out.withColumn("is_ok", ok)
    return out.filter("not is_ok") if only_errors else out


def unique_check(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    out = df.groupBy(*columns).agg(F.count("*").alias("cnt")).filter("cnt > 1")
    return out if limit is None else out.orderBy(F.desc("cnt"), *columns).limit(limit)


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows found on one side only.

    Both sides are grouped by whole row in one pass instead of two set differences.
    """
    cols = a.columns
    both = a.withColumn("_s", F.lit(1)).unionByName(b.select(*cols).withColumn("_s", F.lit(2)))
    sides = both.groupBy(*cols).agg(F.bit_or("_s").alias("_s"))
    return sides.agg(F.count_if(F.col("_s") == 1).alias("only_left"), F.count_if(F.col("_s") == 2).alias("only_right"))


# --- repeated values and failures ---------------------------------------------------------------


def _one_decimal(x: Column) -> Column:
    """One decimal, halves away from zero after scaling: 3 / (20 / 3.0), a little below 0.45, is 0.5 and not 0.4."""
    return F.round(x * 10) / 10


def repeat_runs(units: DataFrame, as_of, only_long: bool) -> DataFrame:
    """How many newest units (days) in a row an object kept the same value.

    ``units`` has one row per (object, unit): ``object, unit, value, ts``; all windows run over
    the distinct values of one object within the report period.
    """
    g = units.groupBy("object", "value").agg(
        F.max("unit").alias("last"), F.min("unit").alias("first"), F.max("ts").alias("ts"),
        F.count("*").alias("row_cnt"), F.array_sort(F.collect_list("unit")).alias("keys"))
    per = Window.partitionBy("object")
    newest_first = per.orderBy(F.desc("last"))
    g = (
        g.withColumn("rn", F.row_number().over(newest_first)).withColumn("next", F.lead("last").over(newest_first))
        .withColumn("cnt", F.sum("row_cnt").over(per)).withColumn("cnt_uniq", F.count("value").over(per))
        .withColumn("max_days", F.max("row_cnt").over(per))
    )
    since = F.date_sub((as_ts(as_of) - F.expr("interval 6 hours")).cast("date"), 1)
    g = g.filter((F.col("rn") == 1) & (F.col("row_cnt") > 1) & (F.col("ts") >= since))
    border = F.coalesce("next", F.date_sub("first", 1))
    g = g.withColumn("kept", F.filter("keys", lambda k: k > border))
    # Average length of the other runs.
    others = (F.col("cnt") - F.col("days")) / F.nullif(F.col("cnt_uniq") - 1, F.lit(0))
    g = g.withColumn("days", F.size("kept").cast("bigint")).filter("days > 1 and cnt_uniq > 1")
    g = g.withColumn("_avg", others)
    if only_long:
        g = g.filter("days > _avg")
    return g.select(
        "object", "value", "days", _one_decimal(F.col("days") / F.nullif(F.col("_avg"), F.lit(0.0))).alias("ratio"),
        "last", F.array_min("kept").alias("key_from"), "cnt", "cnt_uniq", (F.col("cnt") - F.col("cnt_uniq")).alias("not_uniq"),
        _one_decimal(F.col("_avg")).alias("avg_uniq"), "max_days",
        F.sort_array("kept", asc=False).alias("key_dates"))


def repeat_business_date(log: DataFrame, as_of, days: int = 100) -> DataFrame:
    """Objects whose business date stayed the same over several load days.

    ``log`` has ``object, ts, key_date, rows_count``.
    """
    rows = log.filter(F.col("ts") > F.date_sub(as_date(as_of), days)).withColumn("unit", F.to_date("ts"))
    newest = latest_by_key(rows, ["object", "unit"], [F.desc_nulls_first("key_date"), F.desc("ts")])
    return repeat_runs(newest.select("object", "unit", F.col("key_date").alias("value"), "ts"), as_of, False)


def repeat_row_count(log: DataFrame, as_of, days: int = 100) -> DataFrame:
    """Objects whose row count stayed the same over several business dates."""
    rows = log.filter((F.col("ts") > F.date_sub(as_date(as_of), days)) & F.col("key_date").isNotNull())
    newest = latest_by_key(rows, ["object", "key_date"], [F.desc("ts"), F.desc("rows_count")])
    return repeat_runs(newest.select("object", F.col("key_date").alias("unit"), F.col("rows_count").alias("value"), "ts"), as_of, True)


def report_start(as_of) -> Column:
    """Reports look back to the day it was six hours ago."""
    return (as_ts(as_of) - F.expr("interval 6 hours")).cast("date")


def ztest_fail_summary(view: DataFrame, as_of) -> DataFrame:
    """Failing tests, newest per (object, key date, settings), with the number of fails and the first one."""
    bad = view.filter((F.col("ts") >= report_start(as_of)) & ~F.col("ztest_ok"))
    keys = ["object", "key_date", "cfg"]
    carry = ["zscore", "rows_count", "value", "avg", "std", "cnt", "min", "max", "stable"]
    return bad.groupBy(*keys).agg(
        F.count("*").alias("fails"), F.min("ts").alias("first_ts"), F.max("ts").alias("ts"),
        F.max_by(F.struct(*carry), F.struct("ts", "log_id")).alias("r"),
    ).select(*keys, "fails", "first_ts", "ts", F.greatest(F.round(100 - F.abs("r.zscore"), 1), F.lit(0.0)).alias("hub_val"), "r.*")


def ztest_details(view: DataFrame, as_of, objects: int, points: int) -> DataFrame:
    """The newest points of the last failing objects (a top-k report)."""
    bad = view.filter((F.col("ts") >= report_start(as_of)) & ~F.col("ztest_ok"))
    top = bad.groupBy("object").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "object").limit(objects)
    # At most ``objects`` rows.
    rows = view.join(F.broadcast(top), "object")
    nn = F.dense_rank().over(Window.partitionBy("object").orderBy(F.desc("ts")))
    return rows.withColumn("nn", nn).filter(F.col("nn") <= points)


def outlier_3sigma(df: DataFrame, value: str, sigmas: float = 3, min_rows: int = 5, timeout: float | None = None) -> DataFrame:
    """Rows above mean + 3 sample deviations when there are enough rows, or near the timeout."""
    stats = df.agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"), F.count("*").alias("_n"))
    limit = F.col("_mean") + sigmas * F.col("_std")
    out = df.crossJoin(F.broadcast(stats)).withColumn(
        "is_outlier", F.coalesce((F.col("_n") > min_rows) & (F.col("_std") > 0) & (F.col(value) > limit), F.lit(False)))
    near = F.lit(False) if timeout is None else F.col(value) > timeout / 2
    return out.withColumn("near_limit", near).filter("is_outlier or near_limit").withColumn(
        "threshold", limit).drop("_mean", "_std", "_n")


def fields_match(expected: DataFrame, actual: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Differences between configured and returned column lists.

    ``expected`` (key, position, name; NULL name = expression without alias), ``actual`` (key,
    position, name), ``descriptions`` (key, name).
    """
    e, a = expected.withColumnRenamed("name", "expected"), actual.withColumnRenamed("name", "actual")
    j = e.withColumn("_e", F.lit(1)).join(a.withColumn("_a", F.lit(1)), ["key", "position"], "full")
    sizes = j.groupBy("key").agg(F.count("_e").alias("n_e"), F.count("_a").alias("n_a"))
    text = lambda c: F.col(c).cast("string")
    count = sizes.filter("n_e <> n_a").select(
        "key", F.lit("count").alias("issue"), F.lit(None).cast("int").alias("position"),
        text("n_e").alias("expected"), text("n_a").alias("actual"))
    same = j.join(sizes.filter("n_e = n_a"), "key", "left_semi")
    name = same.filter("expected <> actual").select("key", F.lit("name").alias("issue"), "position", "expected", "actual")
    unnamed = j.filter("_e = 1 and expected is null").select("key", F.lit("unnamed").alias("issue"), "position", "expected", "actual")
    out = count.unionByName(name).unionByName(unnamed)
    if descriptions is not None:
        lost = descriptions.join(actual, ["key", "name"], "left_anti").select(
            "key", F.lit("description").alias("issue"), F.lit(None).cast("int").alias("position"),
            F.col("name").alias("expected"), F.lit(None).cast("string").alias("actual"))
        out = out.unionByName(lost)
    return out


def _kind(v: str, text: str) -> Column:
    """Kind of the JSON value in column ``v`` printed in column ``text``: object, array, text, whole, number, flag or null."""
    first, t = F.left(F.col(text), F.lit(1)), F.schema_of_variant(v)
    return (
        F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "text").when(first.isin("t", "f"), "flag").when(first == "n", "null")
        .when(t.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$"), "whole").otherwise("number"))


_DIFFERENCE = "path string, kind string, was string, now string, x variant, y variant"


def _compared(pairs: DataFrame) -> DataFrame:
    """One level: pairs of values (key, path, x, y) to differences, and to the pairs below that aren't the same text.

    Documents come with their texts (_x, _y), and may be unreadable.
    """
    entry = lambda path, kind, was, now, x=None, y=None: F.struct(
        path.alias("path"), F.lit(kind).cast("string").alias("kind") if kind is None or isinstance(kind, str) else kind.alias("kind"),
        was.alias("was"), now.alias("now"), (x if x is not None else F.lit(None).cast("variant")).alias("x"), (y if y is not None else F.lit(None).cast("variant")).alias("y"))
    none = F.lit(None).cast("string")
    p = pairs.withColumn("_tx", F.to_json("x")).withColumn("_ty", F.to_json("y")).withColumn("_j", _kind("x", "_tx")).withColumn("_k", _kind("y", "_ty"))
    for v, side in (("x", "a"), ("y", "b")):
        p = p.withColumn(f"_list_{side}", F.when(F.col("_j") == "array", F.try_variant_get(v, "$", "array<variant>")))
        p = p.withColumn(f"_map_{side}", F.when(F.col("_j") == "object", F.try_variant_get(v, "$", "map<string,variant>")))
    number = lambda c: F.try_variant_get(F.col(c), "$", "double")
    shown = F.when(F.col("path") == "", ".").otherwise(F.col("path"))
    changed = F.when(F.col("_j") == "number", ~number("x").eqNullSafe(number("y"))).otherwise(F.col("_tx") != F.col("_ty"))
    here = lambda kind: F.array(entry(shown, kind, F.col("_tx"), F.col("_ty")))
    size = lambda c: F.size(c).cast("string")
    length = F.when(F.size("_list_a") != F.size("_list_b"), F.array(entry(F.concat("path", F.lit("[]")), "length", size("_list_a"), size("_list_b")))).otherwise(
        F.expr(f"cast(array() as array<struct<{_DIFFERENCE.replace(' ', ':').replace(',:', ',')}>>)"))
    held = lambda v: F.coalesce(v, F.parse_json(F.lit("null")))
    places = F.slice(F.sequence(F.lit(0), F.greatest(F.size("_list_a"), F.size("_list_b"))), F.lit(1), F.least(F.size("_list_a"), F.size("_list_b")))
    items = F.transform(places, lambda i: entry(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")), None, none, none, held(F.get("_list_a", i)), held(F.get("_list_b", i))))
    lone = lambda k: F.when(~F.map_contains_key("_map_a", k) | ~F.map_contains_key("_map_b", k), "key")
    value = lambda side, k: F.when(F.map_contains_key(f"_map_{side}", k), held(F.element_at(f"_map_{side}", k)))
    members = F.transform(F.array_union(F.map_keys("_map_a"), F.map_keys("_map_b")), lambda k: entry(
        F.concat("path", F.lit("."), k), lone(k), F.when(lone(k).isNotNull(), F.to_json(value("a", k))), F.when(lone(k).isNotNull(), F.to_json(value("b", k))),
        F.when(lone(k).isNull(), value("a", k)), F.when(lone(k).isNull(), value("b", k))))
    found = (
        F.when(F.col("_j") != F.col("_k"), here("type")).when(F.col("_j") == "array", F.concat(length, items)).when(F.col("_j") == "object", members)
        .when(changed, here("value")))
    if "_x" in pairs.columns:
        found = F.when(F.col("x").isNull() | F.col("y").isNull(), F.array(entry(shown, "unreadable", F.col("_x"), F.col("_y")))).otherwise(found)
    # An inner explode would put a check of the list's size before it, and so compare every pair twice.
    out = p.select("key", F.explode_outer(found).alias("e")).select("key", "e.*")
    return out.filter("kind is not null or to_json(x) <> to_json(y)")


def json_diff(df: DataFrame, key: str, before: str = "before", after: str = "after") -> DataFrame:
    """Path-wise differences of two JSON documents per row, as (key, path, kind, was, now); keys are unique.

    Kinds: ``type``, ``value``, ``length`` of lists, ``key`` for members of one object only, and ``unreadable`` where one of
    the documents is missing or no JSON. Values below a difference of kind or a lone member are not listed. 1 and 1.0 are
    the same number.

    Both documents are walked together, a level a pass; only pairs that still differ go on, and what a pass finds is
    written to the shared folder. So the number of passes is the depth of the deepest difference, and no plan grows with it.
    Equal texts are dropped first, the others are dealt over all cores: a file of few row groups would be compared by as few tasks.
    """
    spark = df.sparkSession
    texts = df.select(F.col(key).alias("key"), F.lit("").alias("path"), F.col(before).alias("_x"), F.col(after).alias("_y")).filter("not (_x <=> _y)")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = texts.repartition(parts).withColumn("x", F.try_parse_json("_x")).withColumn("y", F.try_parse_json("_y"))
    root, level = scratch_dir(spark, "json-diff"), 0
    shape = f"key {pairs.schema['key'].dataType.simpleString()}, {_DIFFERENCE}"
    while True:
        _compared(pairs).write.parquet(f"{root}/level={level}")
        pairs = spark.read.schema(shape).parquet(f"{root}/level={level}").filter("kind is null").select("key", "path", "x", "y")
        if pairs.isEmpty():
            break
        level += 1
    found = spark.read.schema(shape).parquet(f"{root}/level=*").filter("kind is not null")
    return found.select(F.col("key").alias(key), "path", "kind", "was", "now")


# --- group results and catalog checks -------------------------------------------------------------


def group_result(groups: DataFrame) -> DataFrame:
    """Fold the step results of a group (``results`` array<int>, ``relations`` array<array<int>>).

    A step may run when any step it lists went well; the group follows the list of its last step,
    or needs all steps when that list is empty.
    """
    at = lambda i: F.try_element_at("results", i)
    any_of = lambda rel, v: F.coalesce(F.exists(rel, lambda i: at(i) == v), F.lit(False))
    last = F.try_element_at("relations", F.lit(-1))
    free = F.coalesce(F.size(last), F.lit(0)) == 0
    ok = F.when(free, F.forall("results", lambda r: r == 1)).otherwise(any_of(last, 1))
    err = F.when(free, F.exists("results", lambda r: r == -1)).otherwise(any_of(last, -1))
    runs = F.transform("relations", lambda rel: (F.coalesce(F.size(rel), F.lit(0)) == 0) | any_of(rel, 1))
    return groups.withColumn("runs", runs).withColumn(
        "result", F.when(err, "Error").when(ok, "Ok").otherwise("No"))


DANGLING_MAX_SHARE = 0.25


def dangling_refs(events: DataFrame, entities: DataFrame, profiles: DataFrame) -> DataFrame:
    """Event keys whose profile or entity is unknown; too many of them means the lists are wrong.

    ``events`` (key, profile, entity_id), ``entities`` (entity_id), ``profiles`` (profile).
    """
    ev = events.join(profiles.select("profile").distinct().withColumn("_p", F.lit(1)), "profile", "left").join(
        entities.select("entity_id").distinct().withColumn("_e", F.lit(1)), "entity_id", "left")
    ev = ev.withColumn("reason", F.when(F.col("_p").isNull(), "profile").when(F.col("_e").isNull(), "entity")).drop("_p", "_e")
    part = ev.agg((F.count("reason") / F.count("*")).alias("_share"))
    return ev.filter("reason is not null").crossJoin(F.broadcast(part)).filter(F.col("_share") <= DANGLING_MAX_SHARE).drop("_share")


def shrink_guard(new: DataFrame, old: DataFrame, pct: float = 10) -> DataFrame:
    """Refuse a list that came empty or lost more than ``pct`` percent of its rows."""
    n, o = new.agg(F.count("*").alias("came")), old.agg(F.count("*").alias("was"))
    small = (F.col("was") > 0) & (F.col("came") < F.col("was") * (100 - pct) / 100)
    return n.crossJoin(o).withColumn("accepted", ~((F.col("came") == 0) | small))


def coverage(workflows: DataFrame, external: DataFrame, archive: DataFrame, profile: str, engine: str) -> DataFrame:
    """Who runs each live workflow: ours, external, both or nobody; archived ones that still run.

    ``external`` and ``archive`` hold the category names of two subtrees.
    """
    w = workflows.filter("not coalesce(deleted, false)")
    w = w.join(external.select("category").distinct().withColumn("_x", F.lit(1)), "category", "left").join(
        archive.select("category").distinct().withColumn("_a", F.lit(1)), "category", "left")
    own = (F.col("profile") == profile) & (F.col("engine") == engine)
    owner = (
        F.when(F.col("_a").isNotNull(), F.when(F.col("scheduled"), F.lit("archive_live")).otherwise("archive"))
        .when(own & F.col("_x").isNotNull(), "double").when(own, "af").when(F.col("_x").isNotNull(), "ue").otherwise("orphan")
    )
    return w.withColumn("owner", owner).drop("_x", "_a")
