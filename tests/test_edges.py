"""Literal cases: clocks, NULLs, ties, hot keys, broken input, and brute force where SQL has no say."""

import datetime as dt
import io
import json
import os
import pathlib
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import blocks, common, control, delivery, exchange, export, journal, quality, reports, rules
from tidewatch.sources import files, ingest, sinks
from tidewatch.streaming import latest, messages, streams


def rows(df):
    return [tuple(r) for r in df.collect()]


def ts(x):
    return dt.datetime.fromisoformat(x)


# --- building blocks ---------------------------------------------------------------------------------


def test_latest_by_key_null_order(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("b", 1, 7)], "k string, v int, t int")
    first = {r.k: r.v for r in common.latest_by_key(df, ["k"], [F.desc_nulls_first("t")]).collect()}
    last = {r.k: r.v for r in common.latest_by_key(df, ["k"], [F.desc_nulls_last("t")]).collect()}
    assert first == {"a": 1, "b": 1} and last == {"a": 2, "b": 1}


def test_latest_by_key_is_cut_before_the_shuffle(spark):
    plan = common.latest_by_key(spark.range(100).selectExpr("id % 3 k", "id v"), ["k"], [F.desc("v")])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_bucketed_running_and_lag_on_a_hot_key(spark):
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(5)}", i, rnd.randrange(10)) for i in range(2000)]
    df = spark.createDataFrame(data, "k string, o bigint, v bigint")
    out = common.bucketed_running(df, ["k"], "o", "v", F.expr("o div 64"), "total", "nxt").collect()
    total, order = {}, {}
    for k, o, v in data:
        order.setdefault(k, []).append(o)
    want = {}
    for k, o, v in data:
        total[k] = total.get(k, 0) + v
        i = order[k].index(o)
        want[(k, o)] = (total[k], order[k][i + 1] if i + 1 < len(order[k]) else None)
    assert {(r.k, r.o): (r.total, r.nxt) for r in out} == want
    lag = common.bucketed_lag(df, ["k"], ["o"], "v", F.expr("o div 64"), "before").collect()
    prev, want = {}, {}
    for k, o, v in data:
        want[(k, o)] = prev.get(k)
        prev[k] = v
    assert {(r.k, r.o): r.before for r in lag} == want


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0, 1.0, 9.0], [1.0, 1.0, 1.0, 8.0], []])
def test_exact_quantile(spark, values):
    import statistics

    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = common.exact_quantile(df, "v", 0.5, F.floor(F.col("_v") / 2)).first()
    assert r.rows == len(values) and r.quantile == (statistics.median(values) if values else None)


def test_gate(spark):
    common.gate(spark.range(0), "fine")
    with pytest.raises(common.CheckFailed, match="broken"):
        common.gate(spark.range(3), "broken")


def test_with_total(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5)], "k string, v int")
    assert sorted(rows(common.with_total(df, ["k"], [F.sum("v").alias("v")])), key=str) == [("a", 3), ("total", 8), (None, 5)]


# --- scalars -------------------------------------------------------------------------------------------


def test_result_codes(spark):
    cases = {"Ok 5": 1, "ok": 1, "": 1, None: 1, "okay": -9, "no": 0, "Empty": -1, "expire at": -3, "x QUERY_CANCELED or statement_timeout": -2, "Uniq check errors": -4,
             "Ошибка качества данных. Проверка": -5, "PXF server error": -8, '{"res": 4}': 4, '{"result": "0", "res": 4}': 0, "{broken": -9}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in df.select("t", S.result_code("t").alias("c")).collect()} == cases


def test_json_is_read_strictly(spark):
    cases = {"{}": True, "[1]": True, "1": True, "null": True, '{"a":1} x': False, "1,2": False, "1] , [2": False, '1} {"v":2': False, "{": False, "": False, None: False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in df.select("t", S.is_valid_json("t").alias("c")).collect()} == cases


def test_canonical_json_ignores_key_order(spark):
    df = spark.createDataFrame([('{"b": 1, "a": [1, {"y": 2, "x": 1}]}', '{"a":[1,{"x":1,"y":2}],"b":1}')], "a string, b string")
    assert df.select(S.canonical_json("a") == S.canonical_json("b")).first()[0]


def test_readable(spark):
    df = spark.createDataFrame([(0,), (None,), (1023,), (1024,), (-1536,), (1048576,), (10**18,)], "x bigint")
    assert [r[0] for r in df.select(S.readable("x")).collect()] == ["0 B", "0 B", "1023.0 B", "1.0 KB", "-1.5 KB", "1.0 MB", "888.2 PB"]


def test_times(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05.123456789+03:00",), ("2024-01-02 03:04:05",), ("02.01.2024 03:04:05",), ("12",), ("",), ("nope",)], "t string")
    assert [r[0] for r in df.select(S.best_effort_timestamp("t")).collect()] == [ts("2024-01-02 00:04:05.123456"), ts("2024-01-02 03:04:05"), ts("2024-01-02 03:04:05"), None, None, None]
    assert [r[0] for r in df.select(S.try_timestamp("t")).collect()][3:] == [None, None, None]


@pytest.mark.parametrize("delta,want", [
    ("hours=+5, minutes=-3", "2024-01-31 15:57:00"), ("weekday=0", "2024-01-29 11:00:00"), ("date=2023-02-05,time=06:07:08", "2023-02-05 06:07:08"), ("date=05.02.2023", "2023-02-05 11:00:00"),
    ("01:30", "2024-01-31 12:30:00"), ("2 hours", "2024-01-31 13:00:00"), ("1 day", "2024-02-01 11:00:00"), ("weeks=1", "2024-02-07 11:00:00"), ("", "2024-01-31 11:00:00"), (None, "2024-01-31 11:00:00")])
def test_shift_time(spark, delta, want):
    df = spark.createDataFrame([(ts("2024-01-31 11:00:00"), delta)], "t timestamp, d string")
    assert df.select(control.shift_time("t", "d").cast("string")).first()[0] == want


def test_unreadable_shift_is_null(spark):
    df = spark.createDataFrame([(ts("2024-01-31 11:00:00"), "sometime=5")], "t timestamp, d string")
    assert df.select(control.shift_time("t", "d")).first()[0] is None


# --- quality ---------------------------------------------------------------------------------------------


def naive_uniq(data):
    moments = sorted({x for _, f, t in data for x in (f, t) if x is not None})
    out = {}
    for key in {k for k, _, _ in data}:
        hits = [(m, sum(1 for k, f, t in data if k == key and f is not None and t is not None and f <= m <= t)) for m in moments]
        hits = [(m, n) for m, n in hits if n > 1]
        if hits:
            out[key] = (sum(n for _, n in hits), hits[0][0])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_chk_uniq_brute_force(spark, seed):
    rnd = random.Random(seed)
    base = ts("2024-01-01 00:00:00")
    data = []
    for _ in range(120):
        f = base + dt.timedelta(hours=rnd.randrange(200))
        t = f + dt.timedelta(hours=rnd.randrange(-3, 30))
        data.append((0 if rnd.random() < 0.4 else rnd.randrange(12), None if rnd.random() < 0.05 else f, None if rnd.random() < 0.05 else t))
    df = spark.createDataFrame(data, "k int, f timestamp, t timestamp")
    got = {r.k: (r.cnt, r.cd) for r in quality.chk_uniq(df, ["k"], "f", "t").collect()}
    assert got == naive_uniq(data)


def test_cnt_delta_zero_and_nothing_checked(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), None), (dt.date(2024, 1, 3), 2)], "d date, k int")
    v, s = quality.chk_cnt_delta(df, "d", "k")
    assert [(r.cd, r.cnt, r.prev_cnt, r.delta_pct) for r in v.collect()] == [(dt.date(2024, 1, 2), 0, 1, -100), (dt.date(2024, 1, 3), 1, 0, None)]
    assert rows(s) == [(2, 3)]
    v, s = quality.chk_cnt_delta(df.filter("false"), "d")
    assert rows(v) == [] and rows(s) == [(0, 0)]


def naive_replay(series, dots=90):
    """Straight reading of the rules, one point at a time."""
    import statistics

    done, out = [], []
    for day, n in series:
        before = [p for p in done if p["value"] is None or p["value"] != 0]
        if not before:
            p = dict(day=day, rows=n, value=None, ok=True, z=0.0)
        else:
            last = before[-1]
            value = int((n - last["rows"]) / (day - last["day"]).days)
            pts = [q["value"] for q in done if q["value"] not in (None, 0) and q["ok"]][-dots:] + [value]
            avg, std = statistics.fmean(pts), statistics.pstdev(pts)
            z = (value - avg) / (std or 1.0)
            band = 10 if avg and abs(std / avg) < 0.01 else 5
            p = dict(day=day, rows=n, value=value, ok=-band <= z <= band, z=z)
        done.append(p)
        out.append((p["day"], p["value"], p["ok"], round(p["z"], 6)))
    return out


def test_ztest_replay_brute_force(spark):
    rnd = random.Random(1)
    data = []
    for obj in ("a", "b"):
        n, day = 1000, dt.date(2024, 1, 1)
        for i in range(120):
            day += dt.timedelta(days=rnd.choice([1, 1, 1, 2]))
            n += 0 if i % 17 == 3 else 100_000 if i in (60, 61) else -5 if i == 80 else 50 + rnd.randrange(5)
            data.append((obj, day, n, ts("2024-01-01 00:00:00")))
    df = spark.createDataFrame(data, "object string, key_date date, rows_count bigint, ts timestamp")
    got = quality.ztest_replay(df).orderBy("object", "key_date").collect()
    for obj in ("a", "b"):
        want = naive_replay([(d, n) for o, d, n, _ in data if o == obj])
        assert [(r.key_date, r.value, r.ztest, round(r.zscore, 6)) for r in got if r.object == obj] == want
    assert any(not r.ztest for r in got)


CFG = ("object string, active boolean, rollback boolean, key int, hist bigint, min bigint, max bigint, interval_days int, skip boolean, beg date, end date, dots int, zfr double, zto double, "
       "z_except array<date>, z_error array<date>")
HIST = "object string, key_date date, rows_count bigint, key_diff int, value bigint, avg bigint, std bigint, cnt bigint, min bigint, max bigint, ztest boolean, zscore double, ts timestamp, log_id bigint"


def run_ztest(spark, cfg, rows_count, day=dt.date(2024, 2, 1), hist=None):
    h = hist if hist is not None else [
        ("o", dt.date(2024, 1, d), 100 * d, 1, 100 if d > 1 else None, 7, 8, 9, 1, 2, True, 0.0, ts(f"2024-01-{d:02d} 05:00:00"), d) for d in range(1, 32)]
    full = dict(object="o", active=True, rollback=True, key=None, hist=None, min=None, max=None, interval_days=None, skip=None, beg=None, end=None, dots=None, zfr=None, zto=None, z_except=None, z_error=None)
    c = spark.createDataFrame([tuple({**full, **cfg}.values())], CFG)
    m = spark.createDataFrame([("o", day, rows_count, ts("2024-02-01 06:00:00"), 77)], "object string, key_date date, rows_count bigint, ts timestamp, log_id bigint")
    return quality.ztest_run(spark.createDataFrame(h, HIST), c, m, "2024-02-02 00:00:00")


def test_ztest_verdicts(spark):
    first = lambda **k: (lambda r: (r.ztest, r.verdict))(run_ztest(spark, k.pop("cfg", {}), k.pop("rows", 3200), **k).first())
    assert first() == (True, "Ok")
    assert first(rows=13200) == (False, "No")
    assert first(cfg={"max": 50}) == (False, "No > max (50)")
    assert first(cfg={"z_except": [dt.date(2024, 2, 1)]}, rows=99999) == (True, "Ok z_except")
    assert first(cfg={"z_error": [dt.date(2024, 2, 1)]}) == (False, "No z_error")
    assert first(cfg={"end": dt.date(2024, 1, 31)}) == (None, "Key_date (2024-02-01) > end (2024-01-31)")
    assert first(cfg={"beg": dt.date(2024, 3, 1)}) == (None, "Key_date (2024-02-01) < beg (2024-03-01)")
    assert first(hist=[]) == (True, "Ok first")
    failed = run_ztest(spark, {}, 13200).first()
    assert (failed.avg, failed.std, failed.cnt, failed.min, failed.max) == (7, 8, 9, 1, 2)
    with pytest.raises(common.CheckFailed):
        common.gate(quality.ztest_blocking(run_ztest(spark, {}, 13200)), "z-test")
    assert run_ztest(spark, {"active": False}, 3200).count() == 0


def test_baseline_prefers_newest_key_date_even_when_it_failed(spark):
    h = [("o", dt.date(2024, 1, 30), 10, 1, None, 1, 1, 1, 1, 1, None, 0.0, ts("2024-01-30 00:00:00"), 1),
         ("o", dt.date(2024, 1, 31), 30, 1, 20, 1, 1, 1, 1, 1, False, 0.0, ts("2024-01-31 00:00:00"), 2),
         ("o", dt.date(2024, 1, 31), 40, 1, 30, 1, 1, 1, 1, 1, True, 0.0, ts("2024-01-31 01:00:00"), 3)]
    r = run_ztest(spark, {}, 100, hist=h).first()
    assert (r.key_diff, r.value, r.cnt) == (1, 60, 2)


def test_fingerprint_sees_nulls_and_ignores_order(spark):
    fp = lambda data: quality.table_fingerprint(spark.createDataFrame(data, "a string, b string").repartition(3), ["a", "b"]).first().hash
    assert fp([("1", "2"), ("3", None)]) == fp([("3", None), ("1", "2")])
    assert len({fp([("1", None)]), fp([("1", "")]), fp([("1", "-")]), fp([("1", None), ("1", None)]), fp([("1|1:", "x")]), fp([("1", "|1:x")])}) == 6


def test_json_diff_by_kind(spark):
    pairs = [
        ('{"a":{"b":[1,{"c":2}]}}', '{"a":{"b":[1,{"c":3,"d":null}]}}'), ('[1,2]', '[1,2,3]'), ('{"a":1}', '{"a":1.0}'), ('{"a.b":1}', '{"a":{"b":1}}'),
        (None, "{}"), ("{", "{}"), (None, None), ("1.50", "1.5"), ('"x]"', '"y["'), ("{}", "{}"), ('{"a":[{"k":1}]}', '{"a":{"k":1}}'), ("null", "0"), ('{"t":true}', '{"t":false}')]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "id int, before string, after string")
    got = sorted((r.id, r.path, r.kind, r.was, r.now) for r in quality.json_diff(df, "id").collect())
    got = sorted(got, key=str)
    want = [(0, ".a.b[1].c", "value", "2", "3"), (0, ".a.b[1].d", "key", None, "null"), (1, "[]", "length", "2", "3"),
            (3, ".a", "key", None, '{"b":1}'), (3, ".a.b", "key", "1", None), (4, ".", "unreadable", None, "{}"), (5, ".", "unreadable", "{", "{}"),
            (8, ".", "value", '"x]"', '"y["'), (10, ".a", "type", '[{"k":1}]', '{"k":1}'), (11, ".", "type", "null", "0"), (12, ".t", "value", "true", "false")]
    assert got == sorted(want, key=str)


def test_subtree_with_two_ways_cycles_and_depth(spark):
    edges = [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "d"), ("s", "s")] + [(f"n{i}", f"n{i - 1}" if i else "a") for i in range(45)]
    df = spark.createDataFrame(edges, "id string, parent string")
    got = {r.id: r.level for r in control.subtree(df, "a").collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2} | {f"n{i}": i + 1 for i in range(45)}
    assert [tuple(r) for r in control.subtree(df, "s").collect()] == [("s", 0)]
    assert control.subtree(df, "none").count() == 0


def test_reconcile_newest_package_on_both_sides(spark):
    meta = spark.createDataFrame([(1, "f", "k", "OUT", 2), (2, "f", "k", "OUT", 3)], "id long, name string, key string, type string, cnt long")
    target = spark.createDataFrame([(1, "f", "k")] * 2 + [(2, "f", "k")] * 3, "id long, name string, key string")
    run = lambda **o: sorted((r.expected, r.actual, r.is_ok) for r in quality.reconcile_counts(meta, target, with_id=False, **o).collect())
    assert run(last_source_id=True, last_target_id=True) == [(3, 3, True)]
    assert run(last_source_id=True) == [(3, 5, False)]
    assert run(only_errors=True) == []


def test_reconcile_by_load_time_and_newest_package_of_all(spark):
    when, columns = "2024-01-02 00:00:00", "id long, name string, key string, type string, cnt long, ts string"
    meta = spark.createDataFrame([(1, "f", "k", "OUT", 2, "2024-01-01"), (2, "f", "k", "OUT", 3, when), (2, "s", "", "SUM", 1, when), (3, "x", "", "config", 9, when), (1, "g", "k", "OUT", 7, when)], columns).withColumn("ts", F.col("ts").cast("timestamp"))
    target = spark.createDataFrame([(1, "f", "k", "2024-01-01")] * 2 + [(2, "f", "k", when)] * 3 + [(2, "s", "", when)] * 2, "id long, name string, key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    run = lambda **o: sorted(((r.id, r.name, r.expected, r.actual, r.is_ok) for r in quality.reconcile_counts(meta, target, **o).collect()), key=str)
    assert run(now=when) == [(1, "g", 7, None, False), (2, "f", 3, 3, True), (2, "s", 2, 2, True)]
    assert run(now=when, how="right") == [(2, "f", 3, 3, True), (2, "s", 2, 2, True)]
    assert run(last_source_id=True) == [(1, "f", None, 2, False), (2, "f", None, 3, False), (2, "s", None, 2, False)]
    assert run(last_target_id=True, how="right") == [(2, "f", 3, 3, True), (2, "s", 2, 2, True)]


def test_json_diff(spark):
    df = spark.createDataFrame([(1, '{"a": [1, 2], "b": "1", "c": 1}', '{"a": [1], "b": 1, "d": 1}')], "id int, before string, after string")
    assert sorted((r.path, r.kind) for r in quality.json_diff(df, "id").collect()) == [(".a[]", "length"), (".b", "type"), (".c", "key"), (".d", "key")]


def plain_json_diff(x, y, path=""):
    kind = lambda v: "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "flag" if isinstance(v, bool) else type(v).__name__
    if kind(x) != kind(y):
        return [(path or ".", "type")]
    if isinstance(x, dict):
        both = [plain_json_diff(x[k], y[k], f"{path}.{k}") if k in x and k in y else [(f"{path}.{k}", "key")] for k in dict.fromkeys([*x, *y])]
        return [d for part in both for d in part]
    if isinstance(x, list):
        out = [(path + "[]", "length")] if len(x) != len(y) else []
        return out + [d for i, (p, q) in enumerate(zip(x, y)) for d in plain_json_diff(p, q, f"{path}[{i}]")]
    return [(path or ".", "value")] if x != y else []


def test_json_diff_at_any_depth(spark):
    rng = random.Random(6)

    def value(deep):
        kind = rng.randrange(8 if deep else 5)
        if kind < 5:
            return rng.choice([None, True, 1, "a", 'say "hi"', "]]]]]]\\\"", "{[", "é\\", 7])
        return [value(deep - 1) for _ in range(rng.randrange(4))] if kind < 6 else {rng.choice(["k", "a.b", 'q"', "[0]", "é", ""]): value(deep - 1) for _ in range(rng.randrange(4))}

    def shaken(v):
        if isinstance(v, dict):
            return {k: shaken(x) for k, x in v.items() if rng.random() > 0.1} | ({"new": 1} if rng.random() < 0.1 else {})
        if isinstance(v, list):
            return [shaken(x) for x in v][: None if rng.random() > 0.1 else 1]
        return value(0) if rng.random() < 0.2 else v

    pairs = [(x := {"r": value(4), "s": value(3)}, shaken(x)) for _ in range(120)] + [({"k": "]]]]]]\"", "a": {"b": {"c": 1}}}, {"k": "]]]]]]\"", "a": {"b": {"c": 2}}})]
    deep = lambda v, n=60: v if not n else ([deep(v, n - 1)] if n % 2 else {"d": deep(v, n - 1)})
    pairs.append((deep(1), deep(2)))
    df = spark.createDataFrame([(i, json.dumps(x), json.dumps(y)) for i, (x, y) in enumerate(pairs)], "id int, before string, after string")
    out = quality.json_diff(df, "id")
    got = sorted((r.id, r.path, r.kind) for r in out.collect())
    assert got == sorted((i, *d) for i, (x, y) in enumerate(pairs) for d in plain_json_diff(x, y))
    assert out._jdf.queryExecution().toString().count("\n") < 80


def test_expression_rules_refuse_statements(spark):
    with pytest.raises(ValueError):
        quality.safe_expr("max(x); drop table t")


# --- journal ---------------------------------------------------------------------------------------------


def test_append_changed(spark):
    old = spark.createDataFrame([(ts("2024-01-01 00:00:00"), 1, "wf", "/wf", '{"a":1,"b":2}'), (ts("2024-01-02 00:00:00"), 2, "wf", "/wf", '{"a":1}')], "ts timestamp, id bigint, obj string, url string, msg string")
    new = spark.createDataFrame([(1, "wf", "/wf", '{"b": 2, "a": 1}'), (2, "wf", "/wf", '{"a":2}'), (3, "wf", "/wf", "{}"), (None, "wf", "/wf", "{}"), (0, "info", "/info", "{}")], "id bigint, obj string, url string, msg string")
    assert sorted(r.id for r in journal.append_changed(new, old).collect()) == [0, 2, 3]
    assert journal.append_result(new.filter("false")).first()[0] == "No data"


def test_pairs_keep_unfinished_starts(spark):
    j = spark.createDataFrame([(1, ts("2024-01-01 00:00:00"), None, "start", "{}"), (2, ts("2024-01-01 00:00:30"), 1, "end", "{}"), (3, ts("2024-01-01 00:01:00"), None, "start", "{}")],
                              "id bigint, ts timestamp, parent bigint, wf_action string, wf_message string")
    assert sorted(rows(journal.pair_start_end(j).select("beg_id", "end_id", "duration"))) == [(1, 2, 30.0), (3, None, None)]


# --- exchange, export, delivery ----------------------------------------------------------------------------


def test_exchange_log_needs_two_equal_entries_of_one_type(spark):
    e = [(1, "f", "k1", "OUT", 5, None), (1, "f", "k1", "OUT", 5, None), (1, "f", "k2", "OUT", 5, 1), (1, "f", "k2", "IN", 5, 1), (1, "f", "k3", "OUT", 5, 1), (1, "f", "k3", "OUT", 5, 2), (1, "f", "k4", "OUT", 5, 1)]
    df = spark.createDataFrame([(i, ts("2024-01-01 00:00:00"), w, k, t, c, s, 1, 1, 1.0) for i, w, k, t, c, s in e],
                               "id bigint, ts timestamp, wf_name string, wf_key string, type string, cnt bigint, sum_len bigint, min_len bigint, max_len bigint, time double")
    assert {(r.wf_key, r.type): r.completed for r in exchange.exchange_log(df).collect()} == {("k1", "OUT"): True, ("k2", "OUT"): False, ("k2", "IN"): False, ("k3", "OUT"): False, ("k4", "OUT"): False}


def test_increment_deals_all_due_days_to_packages(spark):
    src = spark.range(250).selectExpr("id", "timestamp'2024-01-01' + make_dt_interval(cast(id as int)) as ts")
    assert exchange.exchange_increment(src, "f", "ts", "2024-01-02").count() == 248
    inc = exchange.exchange_increment(src, "f", "ts", "2024-01-02", days_per_package=100)
    assert sorted((r.package_no, r["n"]) for r in inc.groupBy("package_no").agg(F.count("*").alias("n")).collect()) == [(0, 100), (1, 100), (2, 48)]
    assert exchange.exchange_increment(src, "f", "ts", "2030-01-01").count() == 0


def test_next_window_edges(spark):
    df = spark.createDataFrame([(ts("2024-01-01 10:00:00"), 0, 60), (ts("2024-01-01 10:00:00"), 30, 0), (ts("2024-01-01 10:00:00"), 600, 0)], "extract_time timestamp, increment int, overlap int")
    got = rows(export.next_window(df, "2024-01-01 12:00:00").select(F.col("time_from").cast("string"), F.col("time_to").cast("string"), "is_current"))
    assert got == [("2024-01-01 09:59:00", "2024-01-01 12:00:00", True), ("2024-01-01 10:00:00", "2024-01-01 10:30:00", False), ("2024-01-01 10:00:00", "2024-01-01 12:00:00", True)]


def test_window_filter_reaches_the_scan(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = export.delta_filter(o, "o_orderdate", "2000-01-01", "2000-02-01").select("o_orderkey")._jdf.queryExecution().toString()
    assert "GreaterThan(o_orderdate" in plan and "LessThanOrEqual(o_ord" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp>" in plan


def test_unknown_config_field_is_refused(spark):
    df = spark.createDataFrame([(1, "x")], "id int, typo string")
    with pytest.raises(ValueError, match="typo"):
        export.config_diff(df, df, "id", ["name"])


def test_receipts(spark):
    ok = '<R:Receipt xmlns:R="u"><R:RqUID>1</R:RqUID><R:RqTm>2024-01-01T00:00:00Z</R:RqTm><R:File><R:FileInfo><R:Name>a</R:Name></R:FileInfo><R:Status><R:StatusCode>{}</R:StatusCode></R:Status></R:File></R:Receipt>'
    df = spark.createDataFrame([(1, ok.format(0)), (2, ok.format("x")), (3, ok.format(5) + "\n" + ok.format(6)), (4, "<a><b></a>"), (5, "")], "n int, raw_xml string")
    got = sorted((r.n, r.rq_uid, r.file_name, r.status_code) for r in delivery.parse_receipt(df, "Receipt").collect())
    assert got == [(1, "1", "a", 0), (2, "1", "a", -1), (3, "1", "a", 5), (3, "1", "a", 6), (4, "", "", -1), (5, "", "", -1)]


def test_receipts_are_read_as_xml(spark):
    doc = "<Receipt><RqUID>1</RqUID>{}</Receipt>"
    file = "<File><Name>{}</Name><Status><StatusCode>0</StatusCode></Status></File>"
    texts = [
        doc.format(file.format("a") + "<Bad>"), doc.format(file.format("<![CDATA[a<&>b]]>")), doc.format(file.format("a&#51;&lt;")),
        doc.format("<!-- " + file.format("no") + " -->" + file.format("yes")), doc.format(file.format("a")) + "<!-- end -->",
        doc.format(file.format("a")) + doc.format(file.format("b") + "<Bad>"), doc.format(file.format("a")) + " tail", None,
        "<Other><RqUID>1</RqUID><Status><StatusCode>4</StatusCode></Status></Other>"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, raw_xml string")
    got = sorted((r.n, r.file_name, r.status_code) for r in delivery.parse_receipt(df, "Receipt").collect())
    assert got == [(0, "", -1), (1, "a<&>b", 0), (2, "a3<", 0), (3, "yes", 0), (4, "a", 0), (5, "", -1), (5, "a", 0), (6, "a", 0), (7, "", -1), (8, "", 4)]


def test_receipts_hold_files_at_any_depth_and_closing_tags_in_comments(spark):
    status = "<Status><StatusCode>{}</StatusCode>{}</Status>"
    extra = "<AdditionalStatus><StatusCode>601</StatusCode><StatusDesc> no room </StatusDesc></AdditionalStatus>"
    file = lambda n, s: f"<File><Name>{n}</Name>{s}</File>"
    doc = lambda body: f'<x:Receipt xmlns:x="u" a="&gt;>"><RqUID>1</RqUID>{body}</x:Receipt>'
    texts = [
        doc("<!-- </x:Receipt> -->" + file("a", status.format(0, ""))), doc(f"<Files><Part>{file('a', status.format(0, extra))}</Part>{file('b', status.format(2, ''))}</Files>"),
        "junk " + doc("<![CDATA[</Receipt>]]>" + file("a", status.format(3, "<StatusDesc>d</StatusDesc>" + extra))) + " junk <Receipt>", doc("<Unfinished>") + doc(file("b", status.format(0, ""))),
        "<Receipt><RqUID>9" + doc(file("c", status.format(0, ""))), "<Receipt/>", "<Receipts>" + "</Receipts>" * 2, doc(file("a", status.format("99999999999", "")))]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, raw_xml string")
    got = sorted((r.n, r.rq_uid, r.file_name, r.status_code, r.status_desc) for r in delivery.parse_receipt(df, "Receipt").collect())
    assert got == [
        (0, "1", "a", 0, ""), (1, "1", "a", 0, "[601] no room"), (1, "1", "b", 2, ""), (2, "1", "a", 3, "d | [601] no room"), (3, "", "", -1, ""), (3, "1", "b", 0, ""),
        (4, "", "", -1, ""), (4, "1", "c", 0, ""), (5, "", "", -1, ""), (6, "", "", -1, ""), (7, "1", "a", -1, "")]


def test_queue_order_keeps_rows_without_package(spark):
    at = ts("2024-01-01 00:00:00")
    q = [(None, None, "a.zip", at, "1", "s"), ("r", None, "b.zip", at, "2", "s"), (None, at, "c.zip", at, "3", "s"), ("r", at, "d.zip", at, "4", "s")]
    df = spark.createDataFrame(q, "replica string, package_ts timestamp, file_name string, created_at timestamp, rq_uid string, scenario_id string")
    assert sorted(r.rq_uid for r in delivery.order_queue(df).collect()) == ["1", "2", "3", "4"]


def test_ticket_goes_last(spark):
    at = ts("2024-01-01 00:00:00")
    q = [("r", at, "p.tkt", at, "1"), ("r", at, "b.zip", at + dt.timedelta(seconds=5), "2"), ("r", at, "a.zip", at + dt.timedelta(seconds=2), "3"), ("q", at - dt.timedelta(days=1), "z.zip", at + dt.timedelta(days=9), "4")]
    df = spark.createDataFrame(q, "replica string, package_ts timestamp, file_name string, created_at timestamp, rq_uid string")
    assert [r.rq_uid for r in delivery.order_queue(df).collect()] == ["4", "3", "2", "1"]


def test_rate_window_edge_is_outside(spark):
    now = ts("2024-01-01 12:00:00")
    df = spark.createDataFrame([("s", now - dt.timedelta(seconds=x)) for x in (0, 1, 59, 60, 3600, 86399, 86400)], "scenario_id string, notified_at timestamp")
    assert rows(delivery.sent_counts(df, "2024-01-01 12:00:00").select("sec", "min", "hour", "day")) == [(1, 3, 4, 6)]


# --- control -------------------------------------------------------------------------------------------------


def test_first_decisive_event_wins(spark):
    ev = "array<struct<profile:string,entity_id:bigint,stat_id:bigint,active:boolean>>"
    e = lambda n, a=True: ("p", n, 1, a)
    w = spark.createDataFrame([
        (1, "or", [e(1), e(2)]), (2, "or", [e(2), e(1)]), (3, "and", [e(2)]), (4, "and", [e(3)]), (5, "or", [e(9)]), (6, "and", [e(2, False)]), (7, "and", [])], f"load_id int, strategy string, events {ev}").withColumn("start_ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    st = spark.createDataFrame([("p", 1, 1, ts("2024-01-01 11:45:00")), ("p", 2, 1, ts("2024-01-01 11:00:00")), ("p", 3, 1, ts("2024-01-01 09:00:00"))], "profile string, entity_id bigint, stat_id bigint, published timestamp")
    got = {r.load_id: r.decision for r in control.event_ready(w, st, "2024-01-01 12:00:00").collect()}
    assert got == {1: "wait", 2: "ready", 3: "ready", 4: "wait", 5: "wait", 6: "wait", 7: "wait"}


def test_midnight_deadline_counts_to_the_day_before(spark):
    d = spark.createDataFrame([(1, ts("2024-01-02 00:00:00")), (2, ts("2024-01-02 00:00:01"))], "wf_id int, deadline timestamp")
    last = spark.createDataFrame([(1, ts("2024-01-01 05:00:00")), (2, ts("2024-01-01 05:00:00"))], "wf_id int, last_at timestamp")
    assert [r.wf_id for r in control.alert_event(d, last).collect()] == [2]


def test_calendar_month_end(spark):
    r = spark.createDataFrame([(1, "quarterly", None, None, None, None, "10:00"), (2, "monthly", None, [31], None, None, None), (3, "monthly", None, [30], [2], None, None), (4, "", None, None, None, True, "")],
                              "rule_id int, kind string, dow array<int>, day array<int>, month array<int>, last boolean, at string")
    got = {x.rule_id: (str(x.deadline), str(x.previous)) for x in control.calendar_deadlines(r, "2024-03-31 09:00:00", 800).collect()}
    assert got.pop(3) == ("None", "None")
    assert got == {1: ("2023-12-31 10:00:00", "2023-09-30 10:00:00"), 2: ("2024-01-31 23:59:59", "2023-12-31 23:59:59"), 4: ("2024-02-29 23:59:59", "2024-01-31 23:59:59")}


def test_next_run(spark):
    df = spark.createDataFrame([(ts("2024-01-01 00:00:00"), 86400, ts("2024-01-03 05:00:00"), None), (ts("2024-01-01 00:00:00"), 86400, None, None), (ts("2024-05-01 00:00:00"), 86400, ts("2024-01-03 05:00:00"), None),
                                (ts("2024-01-01 00:00:00"), 86400, ts("2024-01-03 00:00:00"), ts("2024-01-03 12:00:00"))], "f timestamp, i bigint, l timestamp, e timestamp")
    assert [str(r[0]) for r in df.select(control.next_run("f", "i", "l", "e")).collect()] == ["2024-01-04 00:00:00", "2024-01-01 00:00:00", "2024-05-01 00:00:00", "None"]


def test_grades(spark):
    df = spark.createDataFrame([(21600.0,), (21601.0,), (200000.0,)], "s double")
    assert [r[0] for r in df.select(reports.grade("event_age", "s")).collect()] == [None, "LemonChiffon", "salmon"]


# --- files ---------------------------------------------------------------------------------------------------


def texts(spark, *docs):
    return spark.createDataFrame([(f"f{i}", d) for i, d in enumerate(docs)], "file_name string, text string")


def test_json_arrays_are_strict(spark):
    assert files.json_array_items(texts(spark, '[1, {"a": 2}]')).count() == 2
    assert [r.item for r in files.json_array_items(texts(spark, '{"data": [1]}'), "data").collect()] == ["1"]
    for bad in ('[1, 2] x', '[1 2]', '[1, 2', '{"data": 1}', '{"other": []}'):
        with pytest.raises(Exception, match="no JSON array"):
            files.json_array_items(texts(spark, bad), "data" if "{" in bad else None).collect()


def test_bad_line_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"a":1}\n\n{"a":\n{"a":3}\n', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('oops\n')
    items = files.read_jsonl(spark, str(tmp_path))
    assert sorted((r.file_name, r.line_no) for r in files.bad_lines(items).collect()) == [("a.jsonl", 3), ("b.jsonl", 1)]
    assert items.filter("item is not null").count() == 2


def test_line_numbers_across_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"{i}\n" for i in range(1, 20001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        n = files.numbered_lines(spark, str(tmp_path))
        assert n.filter("line_no <> cast(value as bigint)").count() == 0 and n.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def archive(members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return buf.getvalue()


def test_zip_members(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(archive([("dir/", b""), ("a.csv", "﻿один\r\nдва".encode()), ("b.csv", b"3\n")]))
    df = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted((r.member, r.line_no, r.line) for r in files.read_zip(df).collect()) == [("a.csv", 1, "один"), ("a.csv", 2, "два"), ("b.csv", 1, "3")]
    nested = spark.createDataFrame([("y.zip", bytearray(archive([("in.zip", archive([("a", b"1")]))])))], "path string, content binary")
    with pytest.raises(Exception, match="archive inside"):
        files.read_zip(nested).collect()


def test_old_zip_names_are_cp866(spark):
    raw = archive([("ABCD.txt", b"1\n")]).replace(b"ABCD.txt", "файл.txt".encode("cp866"))
    df = spark.createDataFrame([("z.zip", bytearray(raw))], "path string, content binary")
    assert files.read_zip(df).first().member == "файл.txt"


def test_csv_keeps_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"a\nb ""q"""\n2,\n')
    assert rows(files.read_copy_csv(spark, str(tmp_path), "id int, t string")) == [(1, 'a\nb "q"'), (2, None)]


def test_populate_refuses_colliding_keys(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    good = spark.createDataFrame([('{"A": 1}',), ('{"a": null, "x": 1}',)], "item string")
    assert rows(ingest.populate_record(good, schema, {"b": F.lit("d")})) == [(1, "d"), (None, "d")]
    with pytest.raises(common.CheckFailed):
        ingest.populate_record(spark.createDataFrame([('{"A": 1, "a": 2}',)], "item string"), schema)
    with pytest.raises(ValueError):
        ingest.populate_record(spark.createDataFrame([('{"z": 1}',)], "item string"), schema)


def test_items_are_read_once_and_counted(spark, tmp_path):
    """One scan of the source in all; good and rejected rows, types, unmapped and defaulted columns from the mapped copy."""
    from pyspark.sql import types as T

    source = str(tmp_path / "source")
    spark.createDataFrame([("f1", '{"A": 1, "x": true}'), ("f1", '{"a": "no", "X": null}'), ("f2", '{"a": 2.0, "b": {"c": 1}}'), ("f2", None)], "file_name string, item string").write.parquet(source)
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("c", T.StringType())])
    staged = ingest.stage_then_load(spark.read.parquet(source), schema, str(tmp_path / "target"), defaults={"c": F.lit("d")}, carry=["file_name"])
    assert sorted(rows(spark.read.parquet(str(tmp_path / "target"))), key=str) == sorted([("f1", 1, None, "d"), ("f2", 2, '{"c":1}', "d"), ("f2", None, None, "d")], key=str)
    assert rows(staged.rejected()) == [("f1", '{"a": "no", "X": null}', ["a"])]
    n = staged.counters(10).first()
    assert (n.rows_source, n.rows_loaded, n.rows_rejected, n.files, n.target, n.defaulted, n.source_truncated) == (4, 3, 1, 2, "a int,b string,c string", "c", False)
    assert (n.source, n.unmapped) == ("A number,X null,a string|number,b object,x boolean", "X,x")
    assert staged.counters(2).first().source_truncated
    assert source not in staged.counters(10)._jdf.queryExecution().toString() and source not in staged.good()._jdf.queryExecution().toString()


def test_json_array_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [\n{"x": "a\\nb"},\n 2 ]}')
    (tmp_path / "b.json").write_text('{"data": []}')
    assert sorted(rows(files.read_json_array(spark, str(tmp_path), "data"))) == [("a.json", 1, '{"x":"a\\nb"}'), ("a.json", 2, "2")]
    (tmp_path / "c.json").write_text('{"data": [1, 2')
    with pytest.raises(Exception, match="no JSON array in c.json"):
        files.read_json_array(spark, str(tmp_path), "data").collect()


def test_load_flow_refuses_and_keeps_the_table(spark, tmp_path):
    from pyspark.sql import types as T

    from tidewatch.sources import flows

    def env(*packages, run):
        data = [(p, "f", k, f'{{"a": {p}, "b": "{k}"}}', run) for p, k in packages]
        return spark.createDataFrame(data, "_gp_id long, _gp_name string, _gp_key string, _gp_data string, _gp_ts string").withColumn("_gp_ts", F.col("_gp_ts").cast("timestamp")).withColumn("_gp_hash", F.md5("_gp_data"))

    table, see = flows.FlowTable(spark, str(tmp_path / "t")), lambda: sorted(rows(table.read().select("a", "b", "_gp_key", "_gp_id")), key=str)
    one, two = "2024-01-01 00:00:00", "2024-01-02 00:00:00"
    with pytest.raises(common.CheckFailed, match="no fields"):
        flows.load_flow(env((1, "x"), run=one), "other", table, one)
    flows.load_flow(env((1, "x"), (2, None), (2, ""), run=one), "f", table, one)
    first = see()
    assert first == sorted([(1, "x", "x", 1), (2, "None", None, 2), (2, "", "", 2)], key=str)
    with pytest.raises(common.CheckFailed, match="rows repeat"):
        flows.load_flow(env((3, "x"), (3, "x"), run=two), "f", table, two, clear="drop", unique=["a"])
    assert see() == first
    said = spark.createDataFrame([(3, "f", "y", "OUT", 2, two)], "id long, name string, key string, type string, cnt long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for wrong in (said, said.withColumn("cnt", F.lit(1)).withColumn("name", F.lit("g"))):
        with pytest.raises(common.CheckFailed, match="counts differ"):
            flows.load_flow(env((3, "y"), run=two), "f", table, two, announced=wrong)
    with pytest.raises(common.CheckFailed, match="nothing arrived"):
        flows.load_flow(env((1, "y"), run=two), "f", table, two, announced=said)
    with pytest.raises(ValueError):
        flows.load_flow(env((1, "y"), run=two), "f", table, two, clear="burn")
    assert see() == first
    done = flows.load_flow(env((3, "x"), run=two), "f", table, two, clear="drop", announced=said.withColumn("cnt", F.lit(1)).withColumn("key", F.lit("x")))
    assert see() == sorted([(3, "x", "x", 3), (2, "None", None, 2), (2, "", "", 2)], key=str)
    assert rows(done.log) == [("f", "IN_log", 3, "x", 1)]
    flows.load_flow(env(run=two), "f", table, two, clear="truncate")
    assert see() == [] and table.schema().fieldNames()[:3] == ["_gp_ts", "a", "b"]
    flows.load_flow(env((1, "x"), run=two), "f", table, two, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())]))
    assert see() == [(1, "x", "x", 1)]


def test_profile_cap(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x", "c": []}',), ('{"a": "s", "b": null}',)], "item string")
    assert sorted(rows(ingest.source_profile(df).select("key", "kinds"))) == [("a", "string|number"), ("b", "string|null"), ("c", "array")]
    assert {(r.key, r.truncated) for r in ingest.source_profile(df, 2).collect()} == {("a", True), ("b", True)}


def test_local_day_boundary(spark):
    df = spark.createDataFrame([("a/1", 1, ts("2024-01-31 20:59:59")), ("a/2", 1, ts("2024-01-31 21:00:00")), ("a/", 0, ts("2024-01-31 21:00:00")), ("a/3.error", 1, ts("2024-01-31 21:00:00"))], "key string, size bigint, last_modified timestamp")
    assert [r.key for r in files.select_objects(df, "a/*", "2024-02-01", "2024-02-01").collect()] == ["a/2"]


def test_readers_keep_the_old_copy_until_the_flip(spark, tmp_path):
    t = sinks.two_slot_table(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        t.read()
    t.load(spark.range(3))
    old = t.read()
    t.load(spark.range(5))
    assert old.count() == 3 and t.read().count() == 5
    t.load(spark.range(7))
    assert t.version() == 2 and t.path(2).endswith("data_0")


def test_failed_load_keeps_the_raw_data(spark, tmp_path):
    from pyspark.sql import types as T

    items = spark.createDataFrame([('{"A": 1, "a": 2}',)], "item string")
    with pytest.raises(common.CheckFailed):
        ingest.stage_then_load(items, T.StructType([T.StructField("a", T.IntegerType())]), str(tmp_path / "target"), str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 1 and not (tmp_path / "target").exists()


def test_sanitized_round_trip(spark, tmp_path):
    data = [(1, 'q"u;o\tt\ne\\s Кириллица', ["a;b", None], dt.date(2024, 1, 1)), (2, None, None, None)]
    df = spark.createDataFrame(data, "id int, s string, arr array<string>, d date")
    sinks.write_export(df, str(tmp_path / "e"), removals=[(";", " "), ("\t", " "), ("\n", " "), ("\\", "/"), ('"', "'")], clean_arrays=True)
    back = files.read_copy_csv(spark, str(tmp_path / "e"), "id int, s string, arr string, d date", sep=";")
    assert sorted(rows(back)) == [(1, "q'u o t e/s Кириллица", "{a b,NULL}", dt.date(2024, 1, 1)), (2, None, None, None)]


# --- streams ---------------------------------------------------------------------------------------------------


def write_batches(spark, path, batches, schema):
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)


def test_replayed_and_shuffled_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(5)
    data = [(rnd.randrange(6), i, ts("2024-01-01 00:00:00") + dt.timedelta(minutes=rnd.randrange(500))) for i in range(300)]
    schema = "k int, n int, at timestamp"
    shuffled = data + data[:100]
    rnd.shuffle(shuffled)
    write_batches(spark, str(tmp_path / "s"), [shuffled[i::4] for i in range(4)], schema)
    s = streams.parquet_stream(spark, str(tmp_path / "s"), spark.createDataFrame(data, schema).schema, 1)
    got = streams.latest_written(streams.drain(streams.stream_latest(s, ["k"], "at", "n"), "t", "update"), ["k"])
    want = common.latest_by_key(spark.createDataFrame(data, schema), ["k"], [F.desc("at"), F.desc("n")])
    assert sorted(rows(got.select("k", "n", "at"))) == sorted(rows(want.select("k", "n", "at")))


def test_receipt_stream_resumes_from_its_checkpoint(spark, tmp_path):
    x = "<Receipt><RqUID>{0}</RqUID><File><Name>f</Name><Status><StatusCode>{1}</StatusCode></Status></File></Receipt>"
    schema = "raw_xml string, received_at timestamp"
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    write_batches(spark, src, [[(x.format(1, 5), ts("2024-01-01 00:00:00"))], [(x.format(2, 0), ts("2024-01-01 00:00:00"))]], schema)
    shape = spark.read.parquet(src).schema
    go = lambda: streams.drain(streams.stream_receipts(streams.parquet_stream(spark, src, shape, 1), "Receipt"), "r", target=out, checkpoint=chk)
    assert go().count() == 2
    write_batches(spark, src, [[(x.format(1, 0), ts("2024-01-01 01:00:00"))]], schema)
    assert go().count() == 3
    assert sorted((r.rq_uid, r.status_code) for r in streams.stored_receipts(go()).collect()) == [("1", 0), ("2", 0)]


def test_changed_documents_over_batches(spark, tmp_path):
    schema = "url string, id bigint, ts timestamp, msg string"
    at = lambda m: ts("2024-01-01 00:00:00") + dt.timedelta(minutes=m)
    src = str(tmp_path / "docs")
    write_batches(spark, src, [[("/u", 1, at(0), '{"a":1,"b":2}'), ("/u", 1, at(1), '{"b": 2, "a": 1}')], [("/u", 1, at(2), '{"a":1,"b":2}'), ("/u", 2, at(2), "{}")], [("/u", 1, at(3), '{"a":2}')]], schema)
    table = latest.documents_table(spark, str(tmp_path / "table"), fold_every=2)
    got = latest.drain_changed(streams.parquet_stream(spark, src, spark.read.parquet(src).schema, 1), table, str(tmp_path / "out"), F.to_date("ts"))
    assert sorted((r.id, r.ts) for r in got.collect()) == [(1, at(0)), (1, at(3)), (2, at(2))]


def test_changed_documents_of_a_repeated_batch_and_a_hot_key(spark, tmp_path):
    schema, rng = "url string, id bigint, ts timestamp, msg string", random.Random(3)
    at = lambda m: ts("2024-01-01 00:00:00") + dt.timedelta(minutes=m)
    docs = [("/hot", None if i % 2 else 1, at(7 * i), rng.choice(['{"a": 1}', '{"a": 2}', None])) for i in range(900)]
    table = latest.documents_table(spark, str(tmp_path / "table"), fold_every=2)
    got = []
    for batch in range(5):
        df = spark.createDataFrame(docs[batch * 180 : batch * 180 + 180], schema)
        first = rows(latest.changed(df, table.read(batch), F.to_date("ts")))
        table.merge(df.withColumn("h", F.coalesce(F.md5(F.replace("msg", F.lit(" "))), F.lit(""))), batch)
        assert sorted(rows(latest.changed(df, table.read(batch), F.to_date("ts"))), key=str) == sorted(first, key=str)  # the batch is repeated after its merge
        got += first
    want = [d for i, d in enumerate(docs) if i < 2 or docs[i - 2][3] != d[3]]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(rows(latest.changed(spark.createDataFrame([("/hot", 1, at(0), "{}")], schema), table.read(), F.to_date("ts")))) == []


def test_latest_table_equals_batch_and_forgets_old_keys(spark, tmp_path):
    rnd = random.Random(5)
    data = [(rnd.choice([None, *range(6)]), i, ts("2024-01-01 00:00:00") + dt.timedelta(minutes=rnd.randrange(500))) for i in range(300)]
    data += [(100 + i, i, ts("2023-12-01 00:00:00")) for i in range(4)]
    schema = "k int, n int, at timestamp"
    shuffled = data + data[:100]
    rnd.shuffle(shuffled)
    write_batches(spark, str(tmp_path / "s"), [shuffled[i::7] for i in range(7)], schema)
    shape = spark.createDataFrame(data, schema).schema
    want = sorted(rows(common.latest_by_key(spark.createDataFrame(data, schema), ["k"], [F.desc("at"), F.desc("n")])), key=str)
    for name, keep in (("whole", None), ("short", "10 days")):
        table = latest.LatestTable(spark, str(tmp_path / name), shape, ["k"], ["at", "n"], fold_every=3, keep=keep)
        latest.drain_latest(streams.parquet_stream(spark, str(tmp_path / "s"), shape, 1), table, str(tmp_path / f"{name}-checkpoint"))
        table.fold(7)
        kept = [r for r in want if keep is None or r[0] is None or r[0] < 100]
        assert sorted(rows(table.read()), key=str) == kept
        assert sorted(rows(table.folded.read().filter("not _mark").select("k", "n", "at")), key=str) == kept  # what is stored, not only what is shown
        table.merge(spark.createDataFrame([(1, 999, ts("2025-01-01 00:00:00"))], schema), 7)
        assert (1, 999, ts("2025-01-01 00:00:00")) in rows(table.read()) and (1, 999, ts("2025-01-01 00:00:00")) not in rows(table.read(7))
        with pytest.raises(ValueError):
            table.read(6)


def test_message_logs_resume_by_offset(spark, tmp_path):
    """Lines written in two halves, restarts, unreadable and very long lines: nothing is lost and nothing comes twice."""
    logs, out, mark = (str(tmp_path / n) for n in ("logs", "out", "mark"))
    os.makedirs(logs)
    line = lambda i: json.dumps({"ts": "2024-01-01T00:00:00+00:00", "value": f"m{i} é" + "x" * (5000 if i % 7 == 0 else 3)}, ensure_ascii=False) + "\n"
    run = lambda: streams.drain(messages.message_stream(spark, logs, 700), "m", target=out, checkpoint=mark)

    def append(name, text):
        with open(f"{logs}/{name}.log", "a", encoding="utf-8") as f:
            f.write(text)

    append("a", "".join(line(i) for i in range(20)) + line(20)[:9])
    append("b", "not json\n")
    assert run().count() == 21
    append("a", line(20)[9:] + line(21))
    append("c", line(22))
    first = run()
    assert first.count() == 24 and run().count() == 24
    got = sorted((r.partition, r.offset, r.raw_xml) for r in first.collect())
    assert [x[2] for x in got if x[0] == "a"] == [json.loads(line(i))["value"] for i in range(22)]
    assert [x for x in got if x[0] == "b"] == [("b", 0, "not json")] and len({x[:2] for x in got}) == 24


def test_export_parts_stay_within_the_limit(spark, tmp_path):
    rng = random.Random(2)
    df = spark.createDataFrame([(i % 50, i, "é" * rng.choice([0, 5, 300])) for i in range(600)], "k int, n int, t string").repartition(5)
    sinks.write_export(df, str(tmp_path / "e"), compression="none", max_size="2 KB", order=["k", "n"])
    sizes = [p.stat().st_size for p in (tmp_path / "e").rglob("*.csv")]
    assert max(sizes) <= 2048 and len(sizes) < 2.5 * sum(sizes) / 2048
    parts = spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "e")).select("_part", F.col("k").cast("int"), F.col("n").cast("int"), "t")
    assert [r[1:] for r in sorted((r._part, r.k, r.n) for r in parts.collect())] == sorted((i % 50, i) for i in range(600))
    with pytest.raises(Exception, match="longer than a part"):
        sinks.write_export(df, str(tmp_path / "f"), max_size="100 B", order=["n"])
    with pytest.raises(ValueError):
        sinks.size_limit("5 parsecs")


def test_block_diff_reads_differing_blocks_only(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(10_000).select("id", (F.col("id") % 7).cast("string").alias("v"), F.lit(None).cast("string").alias("w")).write.parquet(a)
    left = spark.read.parquet(a)
    left.filter("id <> 55").withColumns({"w": F.when(F.col("id") == 4321, F.col("v")), "v": F.when(F.col("id") != 4321, F.col("v"))}).unionByName(left.filter("id = 9000")).write.parquet(b)
    right = spark.read.parquet(b)
    known = {k: blocks.block_fingerprints(d, "id", ["v", "w"], 100) for k, d in (("known_a", left), ("known_b", right))}
    for most in (100, 1):
        out = blocks.block_diff(left, right, "id", ["v", "w"], 100, most_ranges=most, **known)
        assert sorted(rows(out)) == [(55, "only_left"), (4321, "changed"), (9000, "changed")]
    plan = blocks.block_diff(left, right, "id", ["v", "w"], 100, **known)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.count("GreaterThanOrEqual(id,4300)") == 2 and plan.count("LessThan(id,9100)") == 2


def test_rules_read_a_table_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", ts("2024-01-01")), (2, "b", ts("2024-01-05")), (3, None, ts("2024-01-09"))], "n int, k string, at timestamp").write.parquet(path)
    made = [rules.Rule("1", "t", "max(at)"), rules.Rule("2", "t", "max(at)", "k = 'a'"), rules.Rule("3", "t", "coalesce(max(at), date'1900-01-01')", "k = 'none'"), rules.Rule("4", "t", "min(at)", "k = 'a'"),
            rules.Rule("5", "t", "at"), rules.Rule("6", "t", "max(none)"), rules.Rule("7", "u", "max(at)"), rules.Rule("8", "t", "max(at); drop"), rules.Rule("9", "t", "max(at", "k = 'a'"), rules.Rule("10", "t", "count_if(k is null) * interval 1 day + date'2024-01-01'")]
    out = rules.rule_values(spark, {"t": spark.read.parquet(path)}, made, "timestamp")
    got = {r.rule: (str(r.value)[:10] if r.value else None, bool(r.problem)) for r in out.collect()}
    assert got == {"1": ("2024-01-09", False), "2": ("2024-01-01", False), "3": ("1900-01-01", False), "4": ("2024-01-01", False), "10": ("2024-01-02", False)} | {str(i): (None, True) for i in range(5, 10)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_part_tickets_are_numbered_by_several_tasks(spark):
    parts = spark.createDataFrame([(f"f{i * 7919 % 1000:04d}", i) for i in range(1000)], "file_name string, rows long")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sinks.part_tickets(parts, "B", "s", "1", "t").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert {r.file_name: (r.part, r.total) for r in got} == {f"f{i:04d}": (i + 1, 1000) for i in range(1000)}
    assert all(r.archive == f"b__s__1__t__{r.part}_1000_{r.rows}.zip" and r.ticket == f"{r.file_name};{r.rows}" for r in got)
    assert len({r.task for r in got}) > 1
    assert sinks.part_tickets(parts.limit(0), "B", "s", "1", "t").count() == 0


def test_journal_of_one_moment_takes_the_row_that_came_last(spark):
    doc = '{{"alive": "{0}", "status": "{0}", "profile": "p1", "wf_id": "1"}}'
    at = ts("2024-01-01 00:00:00")
    j = spark.createDataFrame(
        [(at, 7, 1, "loading", "/loading/1", doc.format("B")), (at, 8, 1, "loading", "/loading/1", doc.format("A"))],
        "ts timestamp, seq long, id long, obj string, url string, msg string")
    assert rows(journal.journal_latest(j).select("seq")) == [(8,)]
    assert rows(journal.loading_state(j).select("alive")) == [("A",)]
    new = j.filter("seq = 7").drop("seq")
    assert rows(journal.append_changed(new, j).select("msg")) == [(doc.format("B"),)]
    # Without the place in the journal the greatest text stands.
    assert rows(journal.loading_state(j.drop("seq")).select("alive")) == [("B",)]


def test_readable_up_to_a_unit(spark):
    x = spark.createDataFrame([(1 << 41,), (-3 << 40,), (5 << 20,), (1 << 60,)], "x long")
    assert rows(x.select(S.readable("x", largest="GB"))) == [("2048.0 GB",), ("-3072.0 GB",), ("5.0 MB",), ("1073741824.0 GB",)]
    assert rows(x.select(S.readable("x"))) == [("2.0 TB",), ("-3.0 TB",), ("5.0 MB",), ("1024.0 PB",)]


def test_repeat_ratio_of_a_division_just_below_a_half(spark):
    """3 days against runs of 20 / 3 days: 0.45, which doubles hold a little below."""
    day = dt.date(2024, 1, 1)
    values = [1] * 7 + [2] * 7 + [3] * 6 + [4] * 3
    units = spark.createDataFrame(
        [("o", day + dt.timedelta(i), v, dt.datetime(2024, 1, 23)) for i, v in enumerate(values)], "object string, unit date, value int, ts timestamp")
    assert rows(quality.repeat_runs(units, "2024-01-15 12:00:00", False).select("days", "cnt", "cnt_uniq", "ratio", "avg_uniq")) == [(3, 23, 4, 0.5, 6.7)]


def test_repeat_row_count_query_shows_the_newest_ten_dates(spark, tmp_path):
    """20 days of one count after 3 of another: the operator gives all dates, the query the newest ten, as its SQL."""
    from check import compare, connect

    days = [dt.datetime(2024, 1, 8) + dt.timedelta(i) for i in range(23)]
    ev = spark.createDataFrame([(i, d, 1, "view", 90.0 if i < 3 else 10.0, '{"k": 1}') for i, d in enumerate(days)],
                               "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    folder = _with_events(ev, tmp_path)
    ok, note = compare(spark, connect(folder), folder, "repeat_row_count")
    assert ok and note == "1 rows", note


@pytest.mark.parametrize("first, found", [("view", 2), ("error", 1)])
def test_workflow_log_where_event_0_has_an_end(spark, tmp_path, first, found):
    from check import compare, connect

    at = dt.datetime(2024, 1, 8)
    ev = spark.createDataFrame([(0, at, 1, first, 9.0, '{"k": 1}'), (1, at, 2, "error", 10.0, '{"k": 1}'), (2, at, 3, "view", 8.0, '{"k": 1}')],
                               "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    folder = _with_events(ev, tmp_path)
    ok, note = compare(spark, connect(folder), folder, "workflow_log")
    assert ok and note == f"{found} rows", note


def _with_events(events, path):
    """A data folder whose events are the given ones."""
    small = "/root/testdata/sf0.001"
    for name in os.listdir(small):
        if name != "events.parquet":
            os.symlink(f"{small}/{name}", path / name)
    events.coalesce(1).write.parquet(str(path / "written"))
    os.symlink(next((path / "written").glob("*.parquet")), path / "events.parquet")
    return str(path)


def test_stale_sent_joins_each_answered_file_once(spark):
    """Unreadable receipts share one empty id: they meet the join as one row."""
    at = ts("2024-01-01 00:00:00")
    sent = spark.createDataFrame([("u1", "f1", at, at), ("u2", "f2", at, at)], "rq_uid string, file_name string, notified_at timestamp, updated_at timestamp")
    receipts = spark.createDataFrame([("u1",)] + [("",)] * 50, "rq_uid string")
    df = delivery.stale_sent(sent, receipts, "2024-01-01 03:00:00", 60)
    assert rows(df.select("rq_uid", "waiting_min")) == [("u2", 180)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [rq_uid" in plan.split("Join LeftAnti")[1], plan


def test_receipts_keep_columns_and_order_of_files(spark):
    """Arrow columns of a batch: several files, none, missing text; the rows of a message stay its own."""
    two = '<n:R xmlns:n="x"><RqUID>u</RqUID><File><Name>a</Name><File><Name>b</Name><Status><StatusCode>3</StatusCode></Status></File></File></n:R>'
    df = spark.createDataFrame([(1, two), (2, None), (3, "<R><StatusCode>5</StatusCode></R>"), (4, two)], "n int, raw_xml string").coalesce(1)
    got = rows(delivery.parse_receipt(df, "R").select("n", "rq_uid", "file_name", "status_code", "status_desc", "rq_tm"))
    files = lambda n: [(n, "u", "a", 3, "", None), (n, "u", "b", 3, "", None)]
    assert got == [*files(1), (2, "", "", -1, "", None), (3, "", "", 5, "", None), *files(4)]


def test_stream_files_are_dealt_over_the_cores(spark, tmp_path):
    """Eight cores: a quarter of a frame is two files, and days of changed documents are no single task's."""
    from tidewatch.plans import catalog, q_streams

    cores = spark.sparkContext.defaultParallelism
    path = spark.conf.get("spark.checkpoint.dir")
    q_streams.as_stream(spark.range(1000), "dealt")
    assert len(spark.read.parquet(f"{path}/dealt-*").inputFiles()) == -(-cores // 4) * 4
    at = dt.datetime(2024, 1, 8)
    ev = spark.createDataFrame([(i, at + dt.timedelta(hours=i), i % 5, "view", 1.0, '{"k": %d}' % (i % 3)) for i in range(400)],
                               "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    assert catalog.run("stream_changed", spark, _with_events(ev, tmp_path)).count() == 400
    assert max(len(spark.read.parquet(f.as_posix()).inputFiles()) for f in pathlib.Path(path).glob("docs-*") if "table" not in f.name) == 4 * cores


def test_numbered_lines_are_not_shuffled(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.txt").write_text("\n".join(f"{n} {i}" for i in range(500)))
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = files.numbered_lines(spark, str(tmp_path))
        assert sorted(rows(df.select("value", "line_no"))) == sorted((f"{n} {i}", i + 1) for n in range(3) for i in range(500))
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_message_logs_are_written_by_all_cores(spark):
    """A log per core: the messages of a large table are not written by four tasks."""
    from tidewatch.plans import catalog

    catalog.run("stream_message_log", spark, "/root/testdata/sf0.001").count()
    newest = max((p for p in pathlib.Path(spark.conf.get("spark.checkpoint.dir")).glob("logs-*") if list(p.glob("*.log"))), key=lambda p: p.stat().st_mtime)
    assert len(list(newest.glob("*.log"))) == max(4, spark.sparkContext.defaultParallelism)


def _newest(spark, name):
    found = [p for p in pathlib.Path(spark.conf.get("spark.checkpoint.dir")).iterdir() if re.fullmatch(rf"{name}-[0-9a-f]{{12}}", p.name)]
    return max(found, key=lambda p: p.stat().st_mtime)


def _bytes(folder, pattern):
    return sum(f.stat().st_size for f in folder.rglob(pattern))


def test_message_logs_are_compressed(spark):
    """Logs and stored receipts of a run lie on disk in a fraction of the bytes of their messages, which are all there."""
    from tidewatch.plans import catalog

    catalog.run("stream_message_log", spark, "/root/testdata/sf0.001").count()
    logs, out = _newest(spark, "logs"), _newest(spark, "logs-out")
    stored = spark.read.parquet(str(out))
    texts = stored.select("partition", "offset", "raw_xml").distinct().agg(F.count("*").alias("n"), F.sum(F.length("raw_xml")).alias("size")).first()
    assert texts.n == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()
    assert _bytes(logs, "*.log") < texts.size / 5 and _bytes(out, "*.parquet") < texts.size / 3


def test_receipt_messages_are_written_once_and_streamed_twice(spark):
    from tidewatch.plans import catalog

    catalog.run("stream_receipts", spark, "/root/testdata/sf0.001").count()
    files, out = _newest(spark, "receipts"), spark.read.parquet(str(_newest(spark, "receipts-out")))
    given = spark.read.parquet(str(files))
    assert given.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()
    size = given.agg(F.sum(F.length("raw_xml"))).first()[0]
    assert _bytes(files, "*.parquet") < size / 5
    once = delivery.parse_receipt(given, "Receipt")
    same = [*once.columns]
    assert out.select("batch").distinct().count() == 2
    assert sorted(rows(out.groupBy(*same).count().filter("count % 2 = 0").select("msg_id", "part_no", "file_name", (F.col("count") / 2).alias("n"))), key=str) == sorted(
        rows(once.groupBy(*same).count().select("msg_id", "part_no", "file_name", F.col("count").cast("double"))), key=str)


def test_logs_of_blocks_resume_by_offset(spark, tmp_path, monkeypatch):
    """Blocks and plain lines side by side, a half-written block, another writer: nothing is lost, nothing comes twice, offsets are those of plain lines."""
    monkeypatch.setattr(messages, "BLOCK_BYTES", 900)
    logs, out, mark = (str(tmp_path / n) for n in ("logs", "out", "mark"))
    os.makedirs(logs)
    line = lambda i: json.dumps({"ts": "2024-01-01T00:00:00+00:00", "value": f"m{i} é" + "x" * (5000 if i % 7 == 0 else 30)}, ensure_ascii=False)
    run = lambda: streams.drain(messages.message_stream(spark, logs, 1500), "m", target=out, checkpoint=mark)
    path = f"{logs}/a{messages.BLOCKS}"
    messages.BlockWriter(path).append([line(i) for i in range(40)])
    (tmp_path / "logs/b.log").write_text("not json\n")
    whole = os.path.getsize(path)
    messages.BlockWriter(path).append([line(40)])
    with open(path, "r+b") as f:
        f.truncate(os.path.getsize(path) - 3)  # its writer stopped
    reader = messages.MessageLogReader({"path": logs, "stretchbytes": 1500})
    assert reader.latestOffset() == {f"a{messages.BLOCKS}": whole, "b.log": 9} and len(reader.partitions({}, reader.latestOffset())) > 8
    assert run().count() == 41
    writer = messages.BlockWriter(path)
    writer.append([line(40), "also not json"])
    writer.append([line(41)])
    assert run().count() == 44 and run().count() == 44
    got = sorted((r.partition, r.offset, r.raw_xml) for r in run().collect())
    want, at = [], 0
    for text in [*map(line, range(41)), "also not json", line(41)]:
        want.append(("a", at, json.loads(text)["value"] if text[0] == "{" else text))
        at += len(text.encode()) + 1
    assert got == [*want, ("b", 0, "not json")] and messages.text_bytes(logs) == at + 9


def test_stored_receipts_in_slices(spark):
    at = lambda m: ts("2024-01-01 00:00:00") + dt.timedelta(minutes=m)
    data = [(f"u{i % 40}" if i % 9 else None, f"f{i % 3}" if i % 7 else None, at(i % 50), i % 4, i // 60) for i in range(300)]
    written = spark.createDataFrame(data, "rq_uid string, file_name string, received_at timestamp, status_code int, batch long")
    names = ["rq_uid", "file_name", "received_at", "status_code"]
    whole = streams.stored_receipts(written, names)
    sliced = streams.stored_receipts(written, names, slice_rows=70)
    assert len({f for f in sliced.inputFiles() if "slice=" in f}) > 3 and not any("slice=" in f for f in whole.inputFiles())
    assert sorted(rows(sliced), key=str) == sorted(rows(whole), key=str) and sliced.columns == names


def test_explode_documents_inside_the_row(spark):
    msgs = [
        ("/loading?a=1", '[{"id":1,"a":1,"b":null},{"id":2},{"id":1,"a":null,"c":{"d":[1,2]}},7,"x",{},{"q":1},{"r":2,"q":null},null]'),
        ("/wf/extended", '{"wf":{"id":5},"params":[{"param":"wf_x","prior_value":"p"},{"param":"wf_id","value":"1"},{"param":"zz"}]}'),
        ("/info", '[{"a":1},{"b":2}]'), ("/info", '[{"a":1},{"b":2}]'), ("/wf", '{"id":1} x'), ("/wf", "[]"), ("/wf", None), ("/tmpl", '{"id":1}'), ("/category", '{"id":"no"}'),
        ("/long", json.dumps([{"id": i % 700, "n": i} for i in range(2000)]))]
    out = journal.explode_documents(spark.createDataFrame([(u, "2024-01-01", m) for u, m in msgs], "url string, ts string, msg string"))
    assert "Exchange" not in out._jdf.queryExecution().toString()
    got = [(r.id, r.obj, r.url, json.loads(r.msg)) for r in out.collect()]
    long = {r[0]: r[3]["n"] for r in got if r[1] == "long"}
    assert long == {i % 700: i for i in range(2000)} and len(got) == 7 + 700
    assert sorted((r for r in got if r[1] != "long"), key=str) == sorted([
        (0, "info", "/info", {"a": 1, "b": 2}), (0, "info", "/info", {"a": 1, "b": 2}), (1, "loading", "/loading", {"id": 1, "a": None, "b": None, "c": {"d": [1, 2]}}),
        (2, "loading", "/loading", {"id": 2}), (None, "loading", "/loading", {"q": None, "r": 2}), (None, "category", "/category", {"id": "no"}),
        (5, "wf", "/wf/extended", {"wf": {"id": 5}, "params": [{"wf_x": "p"}]})], key=str)


def test_json_diff_is_dealt_and_parsed_once(spark):
    texts = F.when(F.col("id") % 3 == 0, '{"a": [1, 2.50, -3]}').when(F.col("id") % 3 == 1, "{").otherwise('{"a": [1, 2.5, 4e0]}')
    out = quality.json_diff(spark.range(300).coalesce(1).select("id", F.lit('{"a": [1, 2.50, -3]}').alias("before"), texts.alias("after")), "id")
    assert "parse" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert len({os.path.basename(f) for f in out.inputFiles() if "level=0" in f}) >= spark.sparkContext.defaultParallelism
    got = sorted(rows(out))
    assert got == sorted([(i, ".", "unreadable", '{"a": [1, 2.50, -3]}', "{") for i in range(1, 300, 3)] + [
        (i, ".a[2]", "type", "-3", '4.0') for i in range(2, 300, 3)])


def test_export_by_bytes_is_read_back_by_one_reader(spark):
    from tidewatch.plans import catalog

    out = catalog.run("write_export_bytes", spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "modificationTime" not in plan and plan.count("Relation") == 2
    got = out.collect()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count() and all(r.fits and r.ordered for r in got)
