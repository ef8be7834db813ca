"""Latest state, start/end pairs and catalogs from the append-only load journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.scalars import best_effort_timestamp, canonical_json, field, seconds_between, try_json
from tidewatch.operators.common import latest_by_key

LOADING_DOC = (
    "struct<alive:string,auto:string,start_dttm:string,end_dttm:string,profile:string,wf_id:string,"
    "status:string,status_log:string,"
    "loading_status:array<struct<effective_from:string,status:string,log:string>>>"
)
ENTITY_DOC = "struct<name:string,path:string,storage:string,parentId:string>"
WORKFLOW_DOC = (
    "struct<id:string,name:string,profile:string,category:string,scheduled:boolean,deleted:boolean,"
    "singleLoading:boolean,engine:string,type:string,eventAwaitStrategy:string,"
    "wf_time_sched:struct<sched:string>,"
    "wf_event_sched:array<struct<profile:string,stat_id:string,entity_id:string,active:boolean>>,"
    "param:array<struct<param:string,prior_value:string>>,"
    "statusNotifications:array<struct<status:string,emails:string>>>"
)


def _newest(journal: DataFrame) -> list[Column]:
    """Newest first; of one moment the row that came last (``seq``, where the journal has it), else the greatest text."""
    return [F.desc("ts"), *([F.desc("seq")] if "seq" in journal.columns else []), F.desc("msg")]


def journal_latest(journal: DataFrame) -> DataFrame:
    """Newest document per (id, obj, url)."""
    return latest_by_key(journal, ["id", "obj", "url"], _newest(journal))


def replacing_latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Last version per key of a table that is only appended to."""
    return latest_by_key(df, keys, [F.desc_nulls_last(v) for v in version])


def state_current(history: DataFrame, keys: list[str], at: str, carry: list[str]) -> DataFrame:
    """Number of states, newest time and the other columns as they were at that time."""
    return history.groupBy(*keys).agg(
        F.count("*").alias("states"),
        F.max(at).alias(at),
        *[F.max_by(c, at).alias(c) for c in carry],
    )


def append_changed(new: DataFrame, journal: DataFrame) -> DataFrame:
    """New documents that differ from the last stored version of their (url, id).

    Documents are compared by content, not by key order or spacing; ``info`` always passes.
    """
    last = latest_by_key(journal, ["url", "id"], _newest(journal)).select("id", "url", canonical_json("msg").alias("_doc"))
    fresh = new.withColumn("_doc", canonical_json("msg"))
    changed = fresh.filter("obj <> 'info' and id is not null").join(last, ["id", "url", "_doc"], "left_anti")
    always = fresh.filter("obj = 'info'")
    return changed.select(*new.columns).unionByName(always.select(*new.columns))


def append_result(appended: DataFrame) -> DataFrame:
    n = F.count("*")
    return appended.agg(F.when(n == 0, "No data").otherwise(F.concat(F.lit("Ok "), n.cast("string"))).alias("result"))


def _merged(documents: DataFrame) -> DataFrame:
    """``_members`` from the list ``_parts`` of the members of one id: the last value of a key stands.

    Most ids come once in a message; only the others are merged, over the places of their keys in order.
    """
    places = F.transform("_entries", lambda e, i: F.struct(e["key"].alias("key"), i.alias("at")))
    last = F.filter("_places", lambda p, i: ~p["key"].eqNullSafe(F.get("_places", i + 1)["key"]))
    merged = F.map_from_entries(F.transform("_last", lambda p: F.get("_entries", p["at"])))
    return (
        documents.withColumn("_entries", F.when(F.size("_parts") > 1, F.flatten(F.transform("_parts", F.map_entries))))
        .withColumn("_places", F.sort_array(places)).withColumn("_last", last)
        .withColumn("_members", F.when(F.size("_parts") > 1, merged).otherwise(F.get("_parts", F.lit(0))))
    )


def explode_documents(messages: DataFrame) -> DataFrame:
    """One row per JSON object of a message ``(url, ts, msg)`` holding an object or an array.

    The id comes from a place that depends on the first two path segments of the url, and the
    parameter list shrinks to the workflow parameters with their own or else prior value. A message
    may repeat an id: its occurrences merge, the last value of a key stands. All of it happens
    inside the row of the message, nothing is shuffled.
    """
    base = (
        messages.withColumn("url", F.split_part("url", F.lit("?"), F.lit(1)))
        .withColumn("obj", F.regexp_extract("url", "^/([a-z]+)/?", 1))
        .withColumn("sub", F.regexp_extract("url", "^/[a-z]+/([a-z]+)/?", 1))
        .filter("obj <> 'tmpl'")
    )

    def doc_id(item: Column) -> Column:
        number = lambda p: F.try_variant_get(item, p, "bigint")
        return (
            F.when(F.col("obj") == "info", F.lit(0).cast("bigint"))
            .when(F.col("obj") == "statval", number("$.loading_id"))
            .when((F.col("obj") == "wf") & (F.col("sub") == "extended"), number("$.wf.id"))
            .otherwise(number("$.id"))
        )

    # Unreadable messages become one empty item, which the check for an object drops.
    listed = base.withColumn("_v", try_json("msg")).withColumn(
        "_list", F.coalesce(F.try_variant_get("_v", "$", "array<variant>"), F.array("_v")))
    objects = F.filter(
        F.transform("_list", lambda v: F.struct(doc_id(v).alias("id"), F.try_variant_get(v, "$", "map<string,variant>").alias("members"))),
        lambda o: F.size(o["members"]) > 0)
    # Objects of one id stand side by side in the order of (id, place), so each id is one slice of it.
    places = F.sort_array(F.transform("_objects", lambda o, i: F.struct(o["id"].alias("id"), i.alias("at"))))
    starts = F.filter(
        F.transform("_places", lambda p, i: F.when((i == 0) | ~p["id"].eqNullSafe(F.get("_places", i - 1)["id"]), i)), lambda i: i.isNotNull())
    slices = F.transform("_starts", lambda s, n: F.slice("_places", s + 1, F.coalesce(F.get("_starts", n + 1), F.size("_places")) - s))
    documents = F.transform(slices, lambda ps: F.struct(
        F.get(ps, F.lit(0))["id"].alias("id"), F.transform(ps, lambda p: F.get("_objects", p["at"])["members"]).alias("_parts")))
    rows = (
        listed.select("url", "ts", "obj", objects.alias("_objects")).withColumn("_places", places).withColumn("_starts", starts)
        # An inner inline would put a check of the list's size before all this, and so parse every message twice.
        .select("url", "ts", "obj", F.inline_outer(documents)).filter("_parts is not null")
    )
    kept = F.filter(
        F.try_variant_get(F.try_element_at("_members", F.lit("params")), "$", "array<struct<param:string,value:string,prior_value:string>>"),
        lambda p: p["param"].startswith("wf") & (p["param"] != "wf_id"),
    )
    folded = F.transform(kept, lambda p: F.create_map(p["param"], F.coalesce(p["value"], p["prior_value"])))
    rows = _merged(rows).withColumn("_params", F.to_variant_object(folded))
    msg = F.to_json(F.transform_values("_members", lambda k, v: F.when(k == "params", F.col("_params")).otherwise(v)))
    return rows.select("id", "obj", "url", "ts", msg.alias("msg"))


def pair_start_end(journal: DataFrame) -> DataFrame:
    """Start rows with their end row, if any: end.parent = start.id."""
    start = journal.filter("parent is null").select(
        F.col("id").alias("beg_id"), F.col("ts").alias("beg_ts"),
        F.col("wf_action").alias("beg_action"), F.col("wf_message").alias("beg_msg"),
    )
    end = journal.filter("parent is not null").select(
        F.col("parent").alias("beg_id"), F.col("id").alias("end_id"), F.col("ts").alias("end_ts"),
        F.col("wf_action").alias("end_action"), F.col("wf_message").alias("end_msg"),
    )
    return start.join(end, "beg_id", "left").withColumn("duration", seconds_between("end_ts", "beg_ts"))


def control_log(journal: DataFrame) -> DataFrame:
    """Paired control journal with the fields of both messages."""
    return pair_start_end(journal).select(
        "beg_id", "beg_ts", "beg_action", "end_id", "end_ts", "end_action", "duration",
        field("beg_msg", "wf").alias("wf"),
        field("beg_msg", "lid").try_cast("bigint").alias("loading_id"),
        F.coalesce(field("end_msg", "res"), field("end_msg", "reselt")).try_cast("int").alias("res"),
        field("end_msg", "wf_id").try_cast("bigint").alias("wf_id"),
        field("end_msg", "msg").alias("msg"),
        "beg_msg", "end_msg",
    )


def check_log(journal: DataFrame) -> DataFrame:
    """Paired check journal with the fields of both messages."""
    return pair_start_end(journal).select(
        "beg_id", "beg_ts", "beg_action", "end_id", "end_ts", "end_action", "duration",
        field("beg_msg", "obj").alias("obj"), field("beg_msg", "sch").alias("sch"),
        field("beg_msg", "key").alias("key"),
        field("end_msg", "res").try_cast("int").alias("res"), field("end_msg", "msg").alias("msg"),
        best_effort_timestamp(field("end_msg", "last")).alias("last"),
        field("end_msg", "value").alias("value"), "beg_msg", "end_msg",
    )


def loading_state(journal: DataFrame) -> DataFrame:
    """Newest state per load; the status time of a live load is its newest status entry."""
    rows = latest_by_key(journal.filter("obj = 'loading'"), ["id"], _newest(journal))
    d = F.col("d")
    aborted = F.coalesce(d["alive"] == "ABORTED", F.lit(False))
    newest = F.array_max(F.transform(d["loading_status"], lambda s: s["effective_from"]))
    return rows.withColumn("d", F.from_json("msg", LOADING_DOC)).select(
        "id", "ts", "url", d["alive"].alias("alive"), d["auto"].try_cast("boolean").alias("auto"),
        best_effort_timestamp(d["start_dttm"]).alias("start_dttm"),
        best_effort_timestamp(d["end_dttm"]).alias("end_dttm"),
        d["profile"].alias("profile"), d["wf_id"].try_cast("bigint").alias("wf_id"),
        best_effort_timestamp(F.when(aborted, d["end_dttm"]).otherwise(newest)).alias("status_dttm"),
        F.when(aborted, F.lit("ABORTED")).otherwise(d["status"]).alias("status"),
        d["status_log"].alias("status_log"), "msg",
    )


def entity_state(journal: DataFrame) -> DataFrame:
    rows = latest_by_key(journal.filter("obj = 'entity'"), ["id"], _newest(journal))
    d = F.col("d")
    return rows.withColumn("d", F.from_json("msg", ENTITY_DOC)).select(
        "id", "ts", "url", d["name"].alias("name"), d["path"].alias("path"), d["storage"].alias("storage"),
        d["parentId"].try_cast("bigint").alias("parentid"), "msg",
    )


def last_statval(journal: DataFrame) -> DataFrame:
    """Newest published value per (entity, statistic, profile)."""
    vals = journal.filter("obj = 'statval'").select(
        F.col("id").alias("loading_id"), "ts",
        F.from_json("msg", "struct<entity_id:string,stat_id:string,profile:string>").alias("d"),
    ).select("loading_id", "ts", "d.*")
    return latest_by_key(vals, ["entity_id", "stat_id", "profile"], [F.desc("ts"), F.desc("loading_id")])


def workflow_documents(journal: DataFrame, category_prefix: str) -> DataFrame:
    """Newest workflow document per id out of the two shapes it is stored in."""
    wrapped = "struct<wf:{0},workflow:{0},connectedEntities:array<bigint>>".format(WORKFLOW_DOC)
    parsed = journal.filter("obj in ('wf', 'loading')").withColumn("d", F.from_json("msg", wrapped))
    extended = parsed.filter(
        (F.col("url") == "/wf/extended") & F.col("d.wf.category").startswith(category_prefix)
    ).select("id", "ts", "url", F.col("d.wf").alias("w"), F.col("d.connectedEntities").alias("entities"),
             F.lit(0).alias("shape"))
    carried = parsed.filter(
        F.col("url").rlike(r"^/loading/\d+") & F.col("d.workflow.category").startswith(category_prefix)
    ).select(F.col("d.workflow.id").try_cast("bigint").alias("id"), "ts", "url", F.col("d.workflow").alias("w"),
             F.lit(1).alias("shape"))
    # Entities of the second shape: the newest listing of /entity/wf/<id>.
    listing = journal.filter(F.col("url").rlike(r"/entity/wf/\d+")).select(
        F.regexp_extract("url", r"/entity/wf/(\d+)", 1).try_cast("bigint").alias("id"), "ts",
        F.col("id").alias("entity"),
    )
    newest = listing.groupBy("id").agg(F.max("ts").alias("ts"))
    entities = listing.join(newest, ["id", "ts"]).groupBy("id").agg(
        F.array_sort(F.collect_list("entity")).alias("entities")
    )
    carried = carried.join(entities, "id", "left")
    both = extended.unionByName(carried)
    return latest_by_key(both, ["id"], [F.desc("ts"), F.asc("shape")])


def workflow_catalog(journal: DataFrame, category_prefix: str) -> DataFrame:
    """Workflow list with connected entities, schedule text and parameters."""
    wf = workflow_documents(journal, category_prefix)
    names = entity_state(journal).select(F.col("id").alias("entity"), F.col("name").alias("entity_name"))
    connected = (
        wf.select("id", F.explode("entities").alias("entity")).join(names, "entity", "left")
        .groupBy("id")
        .agg(F.array_join(F.array_sort(F.collect_list(F.concat(
            F.col("entity").cast("string"), F.lit(": "), F.coalesce("entity_name", F.lit(""))))), ", ").alias("connected"))
    )
    loads = loading_state(journal).select(F.col("id").alias("loading_id"), "end_dttm")
    active = (
        wf.select("id", F.explode("w.wf_event_sched").alias("e")).filter("e.active")
        .select("id", "e.profile", "e.stat_id", "e.entity_id")
        .join(last_statval(journal).drop("ts"), ["entity_id", "stat_id", "profile"], "left")
        .join(loads, "loading_id", "left")
    )
    shown = F.coalesce(F.date_format("end_dttm", "yyyy-MM-dd HH:mm:ss"), F.col("loading_id").cast("string"), F.lit(""))
    one = F.concat(F.col("entity_id"), F.lit(" ("), shown)
    # struct order = end time first with NULL lowest, then load id: earliest known value last.
    per_stat = active.groupBy("id", "profile", "stat_id").agg(
        F.array_sort(F.collect_list(F.struct("end_dttm", "loading_id", one.alias("text")))).alias("l")
    )
    event_text = per_stat.select(
        "id",
        F.concat(
            F.col("profile"), F.lit(" ["), F.col("stat_id"), F.lit("] {"),
            F.array_join(F.transform("l", lambda x: x["text"]), "), "), F.lit(")}"),
        ).alias("text"),
    ).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("text")), ", ").alias("events"))
    params = F.transform(
        "w.param",
        lambda p: F.concat(p["param"], F.lit(": "), F.coalesce(F.replace(p["prior_value"], F.lit("$"), F.lit("%")), F.lit(""))),
    )
    interval = F.try_element_at(F.filter("w.param", lambda p: p["param"] == "wf_interval"), F.lit(1))["prior_value"]
    return wf.join(connected, "id", "left").join(event_text, "id", "left").select(
        "id", "ts", "url", "w.profile", "w.category", "w.name", "w.scheduled", "w.deleted",
        F.col("w.singleLoading").alias("singleloading"), "w.engine", "w.type", "connected",
        F.col("w.eventAwaitStrategy").alias("eventawaitstrategy"),
        F.coalesce(
            F.concat("w.eventAwaitStrategy", F.lit(": "), "events"),
            F.concat(F.lit("sched: "), F.coalesce("w.wf_time_sched.sched", F.lit(""))),
        ).alias("wf_sched"),
        F.nullif(F.array_join(params, "; "), F.lit("")).alias("param"),
        F.to_json("w.statusNotifications").alias("statusnotifications"),
        F.coalesce(interval, F.lit("1 day")).alias("wf_interval"),
    )


def workflow_log(
    journal: DataFrame, stats: DataFrame, ztests: DataFrame, config: DataFrame, ptable: DataFrame
) -> DataFrame:
    """Start/end pairs with row statistics and the newest z-test of the load.

    Within limits here means the configured value limits with default +-3, which is a different
    rule from the z-test view.
    """
    start = journal.filter("parent is null or parent = 0").select(
        F.col("id").alias("start_id"), F.col("ts").alias("start_ts"),
        F.col("wf_action").alias("start_action"), F.col("wf_message").alias("workflow"))
    end = journal.filter("parent <> 0").select(
        F.col("parent").alias("start_id"), F.col("id").alias("end_id"), F.col("ts").alias("end_ts"),
        F.col("wf_action").alias("end_action"), F.col("wf_message").alias("message"))
    z = latest_by_key(ztests.filter("log_id is not null"), ["log_id"], [F.desc("ts"), F.desc("key_date")])
    z = z.withColumnRenamed("log_id", "end_id").drop("ts", "rows_count")
    cfg = config.select("object", "z_min", "z_max", "z_except")
    p = ptable.select(F.col("zscore").cast("decimal(10,1)").alias("z1"), "p_value")
    out = (
        start.join(end, "start_id", "left")
        .join(stats.withColumnRenamed("log_id", "end_id"), "end_id", "left")
        .join(z, "end_id", "left")
        .withColumn("z1", F.round(F.abs("zscore").cast("decimal(20,6)"), 1).cast("decimal(10,1)"))
        .join(p, "z1", "left")
        .join(cfg, "object", "left")
    )
    return out.select(
        "start_id", "start_ts", "start_action", "workflow", "end_id", "end_ts", "end_action",
        seconds_between("end_ts", "start_ts").alias("duration"), "message", "rows_count",
        "key_min", "key_max", "zscore",
        F.col("zscore").between(F.coalesce("z_min", F.lit(-3.0)), F.coalesce("z_max", F.lit(3.0))).alias("ztest_ok"),
        F.array_contains("z_except", F.col("key_date")).alias("is_except"),
        F.coalesce(F.round(F.col("p_value") * 2.0 * 100).cast("int"), F.lit(0)).alias("confidence"),
        "key_date", (F.col("std") / F.nullif(F.col("avg").cast("double"), F.lit(0.0))).alias("stable"),
    )


# Leading two words of the context lines that name a call.
CALL_KINDS = ("pgSQL function", "SQL statement", "External table")


def error_call_chain(errors: DataFrame) -> DataFrame:
    """Call chain of an error from its multi-line context: innermost call and outer->inner text."""
    lines = F.transform(
        F.split("context", "\n"),
        lambda s: F.struct(
            F.regexp_extract(s, r"(\w+ \w+) ", 1).alias("kind"),
            F.regexp_extract(s, r'\w+ \w+ "?([.\w]+)', 1).alias("name"),
        ),
    )
    indexed = F.transform(lines, lambda x, i: F.struct(i.alias("rn"), x["kind"].alias("kind"), x["name"].alias("name")))
    calls = F.filter(indexed, lambda x: x["kind"].isin(*CALL_KINDS))
    names = F.transform(F.col("_calls"), lambda x: F.nullif(x["name"], F.lit("")))
    first = F.try_element_at(F.filter("_calls", lambda x: x["rn"] == 0), F.lit(1))["name"]
    return errors.withColumn("_calls", calls).select(
        *errors.columns,
        F.nullif(first, F.lit("")).alias("last_call"),
        F.when(F.size("_calls") > 0, F.array_join(F.reverse(names), "->")).alias("calls"),
    )


STATUS_LIST = "array<struct<effective_from:string,status:string,log:string>>"


def loading_normalize(docs: DataFrame) -> DataFrame:
    """Lists of a load document folded to maps, and its run type.

    ``docs`` carries ``id, auto, params, stats, loading_status, start_dttm`` already parsed.
    """
    docs = docs.select("id", F.struct(*docs.columns).alias("d"))
    d = F.col("d")
    wanted = F.filter(d["params"], lambda p: p["param"].startswith("wf") | p["param"].contains("loading"))
    # Later entries win, as in a plain fold: keep the last entry of every key.
    last_param = F.filter(
        wanted, lambda p, i: ~F.exists(F.slice(wanted, i + 2, F.size(wanted) + 1), lambda q: q["param"] == p["param"])
    )
    params = F.map_from_entries(F.transform(last_param, lambda p: F.struct(p["param"], p["value"])))
    statuses = F.array_sort(d["loading_status"])  # effective_from is the first field
    first_status = F.try_element_at(statuses, F.lit(1))["status"]
    chosen = F.when(~d["auto"], F.lit("MANUAL")).otherwise(first_status)
    run_type = F.when(chosen.isin("TIME-WAIT", "EVENT-WAIT", "MANUAL"), chosen).otherwise(F.lit("NO-WAIT"))
    by_status = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform(statuses, lambda s: s["status"])),
            lambda k: F.struct(
                k, F.array_max(F.transform(F.filter(statuses, lambda s: s["status"] == k), lambda s: s["effective_from"]))
            ),
        )
    )
    by_time = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform(statuses, lambda s: s["effective_from"])),
            lambda k: F.struct(
                k,
                F.try_element_at(
                    F.transform(
                        F.filter(statuses, lambda s: s["effective_from"] == k),
                        lambda s: F.concat(s["status"], F.lit(" "), F.coalesce(s["log"], F.lit(""))),
                    ), F.lit(-1)),
            ),
        )
    )
    keyed = F.transform(
        F.array_sort(F.transform(d["stats"], lambda s: F.struct(s["stat_id"], s["value"], s["loading_id"], s["profile"], s["entity_id"]))),
        lambda s: F.struct(
            F.concat_ws("/", s["loading_id"], s["profile"], s["entity_id"], s["stat_id"]).alias("k"), s["value"].alias("v")
        ),
    )
    last_stat = F.filter(
        keyed, lambda p, i: ~F.exists(F.slice(keyed, i + 2, F.size(keyed) + 1), lambda q: q["k"] == p["k"])
    )
    return docs.select(
        "id", params.alias("params"), F.map_from_entries(last_stat).alias("stats"),
        F.coalesce(F.nullif(params["wfp_run_type"], F.lit("")), run_type).alias("run_type"),
        F.coalesce(F.try_element_at(d["loading_status"], F.lit(1))["effective_from"], d["start_dttm"]).alias("status_from"),
        by_status.alias("status_last"), by_time.alias("status_log"),
    )


def workflow_normalize(docs: DataFrame) -> DataFrame:
    """Parameter, notification and event lists of a workflow folded to maps.

    Without an event list the text parameter ``wf_event_sched`` ("a/1/2, b/3/4") is used.
    """
    def fold(name: str, key: str, value: str) -> Column:
        arr = F.col(name)
        last = F.filter(arr, lambda p, i: ~F.exists(F.slice(arr, i + 2, F.size(arr) + 1), lambda q: q[key] == p[key]))
        return F.coalesce(
            F.map_from_entries(F.transform(last, lambda p: F.struct(p[key], p[value]))),
            F.create_map().cast("map<string,string>"),
        )

    params = fold("param", "param", "prior_value")
    listed = F.transform(
        "wf_event_sched",
        lambda e: F.struct(
            F.concat_ws("/", e["profile"], e["entity_id"], e["stat_id"]).alias("k"),
            F.coalesce(e["active"], F.lit(True)).alias("v"),
        ),
    )
    text = F.filter(F.transform(F.split(params["wf_event_sched"], ","), lambda x: F.trim(x)), lambda x: x != "")
    from_text = F.transform(text, lambda k: F.struct(k.alias("k"), F.lit(True).alias("v")))
    chosen = F.when(F.coalesce(F.size("wf_event_sched"), F.lit(0)) > 0, listed).otherwise(from_text)
    last = F.filter(chosen, lambda p, i: ~F.exists(F.slice(chosen, i + 2, F.size(chosen) + 1), lambda q: q["k"] == p["k"]))
    return docs.select(
        "id", params.alias("params"), fold("statusNotifications", "status", "emails").alias("notifications"),
        F.map_from_entries(last).alias("events"),
    )


def journal_lookup(pairs: DataFrame) -> DataFrame:
    """Last finished message per load."""
    done = pairs.filter("end_id is not null and loading_id is not null")
    return latest_by_key(done, ["loading_id"], [F.desc("beg_ts"), F.desc("end_id")]).select(
        "loading_id", "beg_ts", "end_id", "end_msg"
    )
