"""Incremental JSON packages: build, log, reconcile, infer schemas, route and load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidewatch.functions.scalars import best_effort_timestamp
from tidewatch.operators.common import as_ts, latest_by_key

LOG_NAME = "_exchange_log"


def package_key(package_id) -> Column:
    """Package number as a sortable key."""
    return F.lpad(F.lit(str(package_id)), 10, "0")


def exchange_increment(
    src: DataFrame, flow: str, ts_col: str, last_key=None, tail_from=None, retry: DataFrame | None = None,
    where: str | None = None, days_per_package: int | None = None,
) -> DataFrame:
    """Rows of all day keys that are due, as (wf_name, wf_key, wf_data).

    Due are days after the last completed key, days with rows newer than ``tail_from`` and days
    asked for again. With ``days_per_package`` a column ``package_no`` (from 0) deals the days, oldest first, to packages.
    """
    if where:
        src = src.filter(where)
    day = F.to_date(ts_col)
    fresh = day > F.coalesce(F.lit(last_key).cast("date"), F.lit("1900-01-01").cast("date"))
    if tail_from is not None:
        fresh = fresh | (F.col(ts_col) > as_ts(tail_from))
    due = src.filter(fresh).select(day.alias("_day")).distinct()
    if retry is not None:
        due = due.union(retry.filter(F.col("wf_name") == flow).select(F.col("wf_key").cast("date"))).distinct()
    due = due.filter("_day is not null")
    low, high = due.agg(F.min("_day"), F.max("_day")).first()
    if low is not None:  # plain bounds reach the scan
        src = src.filter((F.col(ts_col) >= F.lit(low).cast("timestamp")) & (F.col(ts_col) < F.date_add(F.lit(high), 1).cast("timestamp")))
    extra = []
    if days_per_package is not None:
        # One row per calendar day.
        nth = F.row_number().over(Window.orderBy("_day")) - 1
        due = due.withColumn("package_no", F.floor(nth / days_per_package).cast("bigint"))
        extra = ["package_no"]
    rows = src.withColumn("_day", day).join(due, "_day")
    return rows.select(
        F.lit(flow).alias("wf_name"), F.col("_day").cast("string").alias("wf_key"),
        F.to_json(F.struct(*src.columns)).alias("wf_data"), *extra,
    ).distinct()


def exchange_package(flows: list[DataFrame], counts: DataFrame, config: DataFrame, package_id) -> DataFrame:
    """Flow rows with their service rows: source counts, settings, per-key totals and the package total.

    ``counts`` and ``config`` are frames whose rows become JSON documents.
    """
    body = flows[0]
    for f in flows[1:]:
        body = body.unionByName(f)
    note = lambda df: df.select(
        F.lit(LOG_NAME).alias("wf_name"), package_key(package_id).alias("wf_key"), F.to_json(F.struct(*df.columns)).alias("wf_data"))
    body = body.unionByName(note(counts.select(F.lit("count").alias("type"), "*"))).unionByName(
        note(config.select(F.lit("config").alias("type"), "*")))
    size = F.length("wf_data").cast("bigint")
    per_key = body.groupBy("wf_name", "wf_key").agg(
        F.count("*").alias("cnt"), F.sum(size).alias("sum_len"), F.min(size).alias("min_len"), F.max(size).alias("max_len"))
    total = per_key.agg(
        F.count("*").alias("cnt"), F.sum("sum_len").alias("sum_len"), F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"),
    ).select(F.lit("SUM").alias("type"), F.lit(LOG_NAME).alias("wf_name"), package_key(package_id).alias("wf_key"), "*")
    meta = per_key.select(F.lit("OUT").alias("type"), "*").unionByName(total)
    return body.unionByName(note(meta))


def source_count(src: DataFrame, flow: str, ts_col: str) -> DataFrame:
    """Count and key bounds of a source for the package."""
    day = F.to_date(ts_col)
    return src.agg(F.count("*").alias("cnt"), F.min(day).cast("string").alias("key_min"), F.max(day).cast("string").alias("key_max")).select(
        F.lit(flow).alias("wf_name"), "*")


def log_rows(raw: DataFrame) -> DataFrame:
    """Exchange journal (id, ts, wf_name, wf_key, wf_data) with the measures of its documents."""
    d = F.from_json("wf_data", "struct<type:string,cnt:bigint,sum_len:bigint,min_len:bigint,max_len:bigint,time:double>")
    return raw.select("id", "ts", "wf_name", "wf_key", d.alias("d")).select("id", "ts", "wf_name", "wf_key", "d.*")


def exchange_log(rows: DataFrame) -> DataFrame:
    """Per (flow, package, key, type): complete when exactly two entries agree in every measure.

    The type is part of the grouping, so an OUT entry never completes an IN entry.
    """
    measures = ["cnt", "sum_len", "min_len", "max_len"]
    lo, hi = {m: F.col(f"_lo_{m}") for m in measures}, {m: F.col(f"_hi_{m}") for m in measures}
    g = rows.groupBy("wf_name", "id", "wf_key", "type").agg(
        F.count("*").alias("entries"), F.sum("time").alias("time"), F.min("ts").alias("ts"), F.max("ts").alias("last_ts"),
        *[F.min(m).alias(f"_lo_{m}") for m in measures], *[F.max(m).alias(f"_hi_{m}") for m in measures])
    same = (F.col("entries") == 2) & (lo["cnt"] == hi["cnt"])
    for m in measures[1:]:
        same = same & lo[m].eqNullSafe(hi[m])
    differs = lambda m: F.when(~lo[m].eqNullSafe(hi[m]), hi[m])
    note = F.to_json(F.struct(
        F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "type",
        F.when(F.col("entries") != 2, F.col("entries")).alias("count"), *[differs(m).alias(m) for m in measures]))
    return g.select("wf_name", "id", "wf_key", "type", *[lo[m].alias(m) for m in measures], "time", "ts",
                    F.coalesce(same, F.lit(False)).alias("completed"), note.alias("wf_data"))


def last_completed(log: DataFrame) -> DataFrame:
    """Last completed outgoing key per flow: newest package first."""
    done = log.filter("type = 'OUT' and completed")
    return latest_by_key(done, ["wf_name"], [F.desc("id"), F.desc("wf_key")]).select("wf_name", F.col("wf_key").alias("last_key"))


def _needs_retry(as_of) -> Column:
    """Finished without success or incomplete; or incomplete for half an hour.

    Unknown (NULL) while the load is active or not known and nothing is overdue.
    """
    finished = F.nullif(F.col("alive"), F.lit("ACTIVE")).isin("COMPLETED", "ABORTED")
    bad = (F.col("status") != "SUCCESS") | ~F.col("completed")
    late = ~F.col("completed") & (F.col("ts") < as_ts(as_of) - F.expr("interval 30 minutes"))
    return (finished & bad) | late


LOADING_COLUMNS = ["status_dttm", "auto", "alive", "status", "status_log"]


def exchange_log_ids(log: DataFrame, loadings: DataFrame, as_of) -> DataFrame:
    """Per (flow, package): all keys complete, totals, ordered keys and the retry flag.

    A package holds at most ``key_limit`` day keys of a flow, which bounds its key list.
    """
    g = log.groupBy("wf_name", "id").agg(
        F.bool_and("completed").alias("completed"), F.max("ts").alias("ts"), F.count("wf_key").alias("keys_cnt"),
        F.sum("cnt").alias("cnt"), F.sum("sum_len").alias("sum_len"), F.max("time").alias("time"),
        F.sort_array(F.collect_list("wf_key"), asc=False).alias("wf_keys"))
    return g.join(loadings.select("id", *LOADING_COLUMNS), "id", "left").withColumn("retry", _needs_retry(as_of))


def _packages(log: DataFrame, loadings: DataFrame, as_of) -> DataFrame:
    rows = log.join(loadings.select("id", *LOADING_COLUMNS), "id", "left").withColumn("retry", _needs_retry(as_of))
    return latest_by_key(rows, ["wf_name", "id", "wf_key"], [F.desc("ts"), F.asc("type")])


def exchange_log_keys(log: DataFrame, loadings: DataFrame, as_of) -> DataFrame:
    """Newest package per (flow, key) with the number of packages and the retry flag.

    The packages themselves are in :func:`exchange_key_packages`: a key that is sent again and
    again has no bound, so they are rows, not a list.
    """
    rows = _packages(log, loadings, as_of)
    n = rows.groupBy("wf_name", "wf_key").agg(F.count("*").alias("ids_cnt"), F.min("id").alias("first_id"))
    newest = latest_by_key(rows.filter("completed or retry is not null"), ["wf_name", "wf_key"], [F.desc("id")])
    return newest.join(n, ["wf_name", "wf_key"]).select(
        "wf_name", "wf_key", "completed", "retry", F.col("ts").alias("last_ts"), F.col("id").alias("last_id"),
        "ids_cnt", "first_id", "cnt", "sum_len", "time", *LOADING_COLUMNS)


def exchange_key_packages(log: DataFrame, loadings: DataFrame, as_of) -> DataFrame:
    """All packages that carried a key, one row each."""
    return _packages(log, loadings, as_of).select("wf_name", "wf_key", "id", "completed", "retry")


# --- receiving side ---------------------------------------------------------------------------

# JSON kinds as they are named in an inferred schema.
VARIANT_KINDS = {"BIGINT": "Int64", "DOUBLE": "Double", "DECIMAL": "Double", "STRING": "String", "BOOLEAN": "Bool",
                 "OBJECT": "String", "ARRAY": "String"}
SPARK_TYPES = {"Int64": "bigint", "Double": "double", "String": "string", "Bool": "boolean"}


def json_kind(v: Column) -> Column:
    """Kind of a VARIANT value; NULL for a JSON null."""
    head = F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in VARIANT_KINDS.items() for x in pair]), head)


def infer_flow_schema(envelope: DataFrame) -> DataFrame:
    """Fields of every flow with position and type; conflicting types become String.

    ``envelope`` is (_gp_id, _gp_name, _gp_key, _gp_data). Fields that are only ever null do not show.
    """
    items = envelope.select(
        "_gp_id", "_gp_name", F.posexplode(F.map_entries(F.from_json("_gp_data", "map<string,variant>"))).alias("pos", "e"))
    kinds = items.select("_gp_id", "_gp_name", (F.col("pos") + 1).alias("pos"), F.col("e.key").alias("field"), json_kind(F.col("e.value")).alias("kind"))
    g = kinds.filter("kind is not null").groupBy("_gp_name", "field").agg(
        F.max("pos").alias("position"), F.min("kind").alias("_a"), F.max("kind").alias("_b"), F.max("_gp_id").alias("last_id"))
    return g.select("_gp_name", "field", "position", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("String").alias("type"), "last_id")


def exchange_normalize(load: DataFrame, run_ts) -> DataFrame:
    """Distinct rows with unescaped document, content hash and run time; newest package per content."""
    text = F.when(F.col("_gp_data").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), F.col("_gp_data"), F.lit("}")), "struct<v:string>")["v"]).otherwise(F.col("_gp_data"))
    rows = load.select(as_ts(run_ts).alias("_gp_ts"), "_gp_id", "_gp_name", "_gp_key", text.alias("_gp_data"), F.md5("_gp_data").alias("_gp_hash"))
    return latest_by_key(rows, ["_gp_name", "_gp_key", "_gp_hash"], [F.desc("_gp_id")])


def last_loaded(log: DataFrame) -> DataFrame:
    """Highest package number of the newest load entry per flow. ``log``: (wf_name, ts, wf_type, wf_key)."""
    entries = log.filter("wf_type = 'IN_log'")
    return entries.groupBy("wf_name").agg(F.max_by(F.struct("ts"), "ts").alias("_t")).join(entries, "wf_name").filter(
        F.col("ts") == F.col("_t.ts")).groupBy(F.col("wf_name").alias("_gp_name")).agg(
        F.max(F.coalesce(F.col("wf_key").try_cast("bigint"), F.lit(0))).alias("last_id"))


def route_flows(envelope: DataFrame, log: DataFrame, known: list[str], sample_ids: int) -> DataFrame:
    """Flows with rows newer than their last load, and where each goes; ``ids`` shows the first ``sample_ids`` packages."""
    fresh = envelope.join(last_loaded(log), "_gp_name", "left").filter(F.col("_gp_id") > F.coalesce("last_id", F.lit(0)))
    # Distinct ids and keys per flow first: the flow itself may hold most rows.
    per_id = fresh.groupBy("_gp_name", "_gp_id").agg(F.count("*").alias("n"))
    per_key = fresh.groupBy("_gp_name", "_gp_key").agg(F.lit(1).alias("one"))
    ids = per_id.groupBy("_gp_name").agg(
        F.sum("n").alias("row_cnt"), F.min("_gp_id").alias("min_id"), F.max("_gp_id").alias("max_id"), F.count("*").alias("cnt_id"))
    keys = per_key.groupBy("_gp_name").agg(F.min("_gp_key").alias("min_key"), F.max("_gp_key").alias("max_key"), F.count("*").alias("cnt_key"))
    rank = F.row_number().over(Window.partitionBy("_gp_name").orderBy("_gp_id"))
    sample = per_id.withColumn("_r", rank).filter(F.col("_r") <= sample_ids).groupBy("_gp_name").agg(F.array_sort(F.collect_list("_gp_id")).alias("ids"))
    name = F.col("_gp_name")
    route = F.when(name.startswith("_"), "_ignored").when(name.isin(*known), F.concat(F.lit("process_"), name)).otherwise("_other")
    return ids.join(keys, "_gp_name").join(sample, "_gp_name").withColumn("route", route)


def route_branches(routes: DataFrame) -> DataFrame:
    """Distinct branches to run; a single ``_empty`` when nothing is due."""
    hit = routes.filter("route <> '_ignored'").select("route").distinct()
    none = routes.agg(F.count_if(F.col("route") != "_ignored").alias("n")).filter("n = 0").select(F.lit("_empty").alias("route"))
    return hit.unionByName(none)


SERVICE = ["_gp_ts", "_gp_key", "_gp_id", "_gp_hash"]


def typed_flow(envelope: DataFrame, flow: str, schema: T.StructType) -> DataFrame:
    """Typed projection of the documents of one flow; times are parsed in any known layout."""
    times = {f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)}
    text = T.StructType([T.StructField(f.name, T.StringType() if f.name in times else f.dataType) for f in schema.fields])
    d = envelope.filter(F.col("_gp_name") == flow).withColumn("_d", F.from_json("_gp_data", text))
    get = lambda f: best_effort_timestamp(F.col("_d")[f.name]) if f.name in times else F.col("_d")[f.name]
    return d.select("_gp_ts", *[get(f).alias(f.name) for f in schema.fields], "_gp_key", "_gp_id", "_gp_hash")


def process_flow(envelope: DataFrame, flow: str, schema: T.StructType, target: DataFrame) -> DataFrame:
    """Typed rows of packages the target has not seen yet."""
    seen = target.agg(F.coalesce(F.max("_gp_id"), F.lit(0)).alias("_seen"))
    return typed_flow(envelope, flow, schema).crossJoin(F.broadcast(seen)).filter("_gp_id > _seen").drop("_seen")


def apply_load(target: DataFrame, new: DataFrame, clear: str | None = None) -> DataFrame:
    """Target after a load: append, replace whole, replace the loaded keys, or keep the newest version."""
    if clear == "truncate":
        return new
    if clear == "delete":
        keys = new.select("_gp_key").distinct()
        return target.join(keys, "_gp_key", "left_anti").unionByName(new)
    if clear in ("optimize", "final"):
        return latest_by_key(target.unionByName(new), ["_gp_key", "_gp_hash"], [F.desc("_gp_id"), F.desc("_gp_ts")])
    if clear is not None:
        raise ValueError(f"unknown way to clear: {clear}")
    return target.unionByName(new)


def load_log(target: DataFrame, flow: str, run_ts) -> DataFrame:
    """Journal rows of a load: count per (package, key) of this run."""
    return target.filter((F.col("_gp_id") > 0) & (F.col("_gp_ts") == as_ts(run_ts))).groupBy("_gp_id", "_gp_key").agg(
        F.count("*").alias("cnt")).select(F.lit(flow).alias("wf_name"), F.lit("IN_log").alias("wf_type"), "_gp_id", "_gp_key", "cnt")


def load_totals(target: DataFrame, run_ts) -> DataFrame:
    """Row count and bounds of the whole table and of this run."""
    measures = lambda: [F.count("*").alias("row_cnt"), F.min("_gp_id").alias("min_id"), F.max("_gp_id").alias("max_id"),
                        F.min("_gp_ts").alias("min_ts"), F.max("_gp_ts").alias("max_ts")]
    part = target.withColumn("_now", F.col("_gp_ts") == as_ts(run_ts)).groupBy("_now").agg(*measures())
    both = part.filter("_now").select(F.lit("now").alias("type"), *part.columns[1:]).unionByName(
        part.agg(F.sum("row_cnt").alias("row_cnt"), F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"),
                 F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts")).select(F.lit("all").alias("type"), "*"))
    return both


FIELD_NAME = r"^[A-Za-z_][A-Za-z0-9_]*$"


def sample_unknown(envelope: DataFrame, flow: str, rows: int) -> DataFrame:
    """First rows of a flow nobody processes, as typed fields; badly named fields are left out.

    A sampling operator: ``rows`` is its purpose.
    """
    head = envelope.filter(F.col("_gp_name") == flow).orderBy("_gp_id", "_gp_key", "_gp_data").limit(rows)
    items = head.select("_gp_id", "_gp_key", "_gp_data", F.explode(F.map_entries(F.from_json("_gp_data", "map<string,variant>"))).alias("e"))
    return items.filter(F.col("e.key").rlike(FIELD_NAME)).select(
        "_gp_id", "_gp_key", F.col("e.key").alias("field"), json_kind(F.col("e.value")).alias("type"),
        F.variant_get(F.col("e.value"), "$", "string").alias("value"))


def drop_transferred(load: DataFrame, main: DataFrame) -> DataFrame:
    """Staged rows that are not in the main table yet, by package."""
    return load.join(main.select("_gp_id").distinct(), "_gp_id", "left_anti")


def transferred_packages(load: DataFrame, main: DataFrame) -> DataFrame:
    """Packages of the staging table that can be dropped."""
    return load.select("_gp_id").distinct().join(main.select("_gp_id").distinct(), "_gp_id", "left_semi")
