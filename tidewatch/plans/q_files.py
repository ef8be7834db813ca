"""Readers, ingest and writers over files that Spark derives from the tables."""

import io
import zipfile

import pandas as pd
from pyspark.sql import Window, functions as F, types as T

from tidewatch.functions import scalars as S
from tidewatch.plans.registry import query
from tidewatch.session import scratch_dir
from tidewatch.sources import files as R, ingest as G, sinks as W

DOC = ["doc_id", "lang", "source", "n_chars"]


@query("read_exchange_tsv", "SELECT event_id AS _gp_id, event_type AS _gp_name, ts::DATE::VARCHAR AS _gp_key, user_id FROM events")
def _(t):
    path = scratch_dir(t.spark, "tsv")
    doc = F.to_json(F.struct("user_id", F.lit('say "hi"').alias("q")))
    t.events.select("event_id", "event_type", F.to_date("ts").cast("string").alias("k"), doc.alias("d")).write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    r = R.read_exchange_tsv(t.spark, path)
    return r.select("_gp_id", "_gp_name", "_gp_key", S.field("_gp_data", "user_id").cast("bigint").alias("user_id"))


@query("read_copy_csv", "SELECT doc_id, md5(text) AS h, lang FROM documents")
def _(t):
    path = scratch_dir(t.spark, "csv")
    t.documents.select("doc_id", "text", "lang").write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    r = R.read_copy_csv(t.spark, path, "doc_id bigint, text string, lang string")
    return r.select("doc_id", F.md5("text").alias("h"), "lang")


@query("read_json_array", "SELECT conv_id, turn, md5(text) AS h FROM conversations")
def _(t):
    """One file per group of conversations, each an array under a key, over several lines."""
    path = scratch_dir(t.spark, "arrays")
    item = F.to_json(F.struct("conv_id", "turn", "text"))
    rows = t.conversations.repartition(8, "conv_id").sortWithinPartitions("conv_id", "turn").select(item.alias("item"))

    def document(batches):
        first = True
        yield pd.DataFrame({"value": ['{"data": [']})
        for pdf in batches:
            lines = pdf["item"].tolist()
            yield pd.DataFrame({"value": [("" if first and i == 0 else ", ") + x for i, x in enumerate(lines)]})
            first = first and not lines
        yield pd.DataFrame({"value": ["]}"]})

    rows.mapInPandas(document, "value string").write.text(path)
    items = R.read_json_array(t.spark, path, "data")
    d = F.from_json("item", "struct<conv_id:bigint,turn:bigint,text:string>")
    return items.select(d.alias("d")).select("d.conv_id", "d.turn", F.md5("d.text").alias("h"))


def _jsonl(t, bad: bool = False):
    path = scratch_dir(t.spark, "jsonl")
    line = F.to_json(F.struct(*DOC, "text"))
    if bad:
        line = F.when(F.col("doc_id") % 10 == 3, F.lit('{"doc_id": 1')).otherwise(line)
    t.documents.repartition("doc_id").sortWithinPartitions("doc_id").select(line.alias("value")).write.text(path)
    return path


@query("read_jsonl", "SELECT doc_id, lang, source, n_chars, md5(text) AS h FROM documents")
def _(t):
    items = R.read_jsonl(t.spark, _jsonl(t))
    d = items.select(F.from_json("item", "struct<doc_id:bigint,lang:string,source:string,n_chars:bigint,text:string>").alias("d")).select("d.*")
    return d.withColumn("h", F.md5("text")).drop("text")


@query("bad_lines", "SELECT count(*) AS bad, true AS numbered FROM documents WHERE doc_id % 10 = 3")
def _(t):
    items = R.read_jsonl(t.spark, _jsonl(t, True))
    per = items.groupBy("file_name").agg(F.max("line_no").alias("m"), F.countDistinct("line_no").alias("d"), F.count("*").alias("n"))
    ok = per.agg(F.bool_and((F.col("m") == F.col("n")) & (F.col("d") == F.col("n"))).alias("numbered"))
    return R.bad_lines(items).agg(F.count("*").alias("bad")).crossJoin(ok)


@query("detect_format", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'jsonl' WHEN 2 THEN 'zip' WHEN 3 THEN 'json' END AS fmt FROM pages")
def _(t):
    k = F.col("page_id") % 5
    name = F.concat(F.lit("a/b."), F.when(k == 0, "CSV.gz").when(k == 1, "jsonl").when(k == 2, "zip").when(k == 3, "json").otherwise("pdf"))
    return t.pages.select("page_id", R.detect_format(name).alias("fmt"))


@query("read_zip", "SELECT doc_id, md5(lang || source) AS h FROM documents")
def _(t):
    def pack(batches):
        for pdf in batches:
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("folder/", "")
                half = len(pdf) // 2
                z.writestr("a.txt", "﻿" + "\n".join(pdf["line"][:half]))
                z.writestr("b.txt", "\r\n".join(pdf["line"][half:]))
            yield pd.DataFrame({"path": [f"/x/{pdf['doc_id'].iloc[0] if len(pdf) else 0}.zip"], "content": [buf.getvalue()]})

    lines = t.documents.select("doc_id", F.concat_ws(";", F.col("doc_id").cast("string"), "lang", "source").alias("line"))
    z = R.read_zip(lines.mapInPandas(pack, "path string, content binary"))
    p = F.split("line", ";")
    return z.filter("line <> ''").select(p[0].cast("bigint").alias("doc_id"), F.md5(F.concat(p[1], p[2])).alias("h"))


def _items(t):
    """Documents as JSON elements with keys in several spellings, extra keys and missing ones."""
    k = F.col("doc_id")
    item = F.concat(
        F.lit('{"Doc_ID": '), k.cast("string"), F.when(k % 2 == 0, F.concat(F.lit(', "LANG": "'), F.col("lang"), F.lit('"'))).otherwise(F.lit("")),
        F.lit(', "n_chars": '), F.when(k % 7 == 0, '"many"').when(k % 7 == 1, "null").otherwise(F.col("n_chars").cast("string")),
        F.lit(', "tags": ["a", "b"], "extra": {"x": '), k.cast("string"), F.lit("}"), F.when(k % 11 == 0, ', "rare": true').otherwise(F.lit("")),
        F.lit(","), F.expr("substring(to_json(struct(text AS Text)), 2)"))
    return t.documents.select(F.concat(F.lit("f"), (k % 3).cast("string")).alias("file_name"), "doc_id", item.alias("item"))


TARGET = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("tags", T.StringType()), T.StructField("loaded", T.StringType()), T.StructField("text", T.StringType())])


@query("pick_item", "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id END AS x FROM documents")
def _(t):
    k = F.col("doc_id").cast("string")
    src = t.documents.select("doc_id", F.when(F.col("doc_id") % 4 == 0, '{"a": {"b": 5}}').otherwise(F.concat(F.lit('{"a": {"b": {"x": '), k, F.lit("}}}"))).alias("item"))
    return G.pick_item(src, "a.b").select("doc_id", S.field("item", "x").cast("bigint").alias("x"))


@query("populate_record", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 7 > 1 THEN n_chars END AS n_chars, '["a","b"]' AS tags, 'now' AS loaded, md5(text) AS h FROM documents""")
def _(t):
    return G.populate_record(_items(t), TARGET, {"loaded": F.lit("now")}).withColumn("h", F.md5("text")).drop("text")


@query("cast_failures", "SELECT doc_id, 'n_chars' AS \"column\" FROM documents WHERE doc_id % 7 = 0")
def _(t):
    return G.cast_failures(_items(t), TARGET).select("doc_id", "column")


@query("unmapped_keys", "SELECT 'extra' AS key, count(*) AS rows FROM documents UNION ALL SELECT 'rare', count(*) FROM documents WHERE doc_id % 11 = 0")
def _(t):
    return G.unmapped_keys(_items(t), TARGET)


@query("source_profile", """SELECT 'Doc_ID' AS key, 'number' AS kinds, count(*) AS rows, false AS truncated FROM documents UNION ALL SELECT 'LANG', 'string', count(*), false FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT 'n_chars', 'string|number|null', count(*), false FROM documents UNION ALL SELECT 'tags', 'array', count(*), false FROM documents UNION ALL SELECT 'extra', 'object', count(*), false FROM documents UNION ALL SELECT 'rare', 'boolean', count(*), false FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT 'Text', 'string', count(*), false FROM documents""")
def _(t):
    return G.source_profile(_items(t))


@query("load_counters", """SELECT count(*) AS rows_source, 3::BIGINT AS files, count(*) FILTER (WHERE doc_id % 7 <> 0) AS rows_loaded, count(*) FILTER (WHERE doc_id % 7 = 0) AS rows_rejected,
  'doc_id bigint,lang string,n_chars bigint,tags string,loaded string,text string' AS target, 'Doc_ID number,LANG string,Text string,extra object,n_chars string|number|null' AS source,
  'extra' AS unmapped, 'loaded' AS defaulted, true AS source_truncated FROM documents""")
def _(t):
    return G.StagedItems(_items(t), TARGET, carry=["file_name"]).counters(key_cap=5)


@query("rejected_items", "SELECT 'f' || doc_id % 3 AS file_name, doc_id, 'n_chars' AS columns, md5(text) AS h FROM documents WHERE doc_id % 7 = 0")
def _(t):
    bad = G.StagedItems(_items(t), TARGET, carry=["file_name"]).rejected()
    doc = F.from_json("item", "struct<Doc_ID:bigint,Text:string>")
    return bad.select("file_name", doc["Doc_ID"].alias("doc_id"), F.array_join("columns", ",").alias("columns"), F.md5(doc["Text"]).alias("h"))


@query("stage_then_load", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 7 > 1 THEN n_chars END AS n_chars, 'now' AS loaded, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0")
def _(t):
    target = scratch_dir(t.spark, "target")
    G.stage_then_load(_items(t), TARGET, target, defaults={"loaded": F.lit("now")})
    return t.spark.read.schema(TARGET).parquet(target).select("doc_id", "lang", "n_chars", "loaded", F.md5("text").alias("h"))


@query("file_name_column", "SELECT count(*) AS rows, count(*) AS named FROM documents")
def _(t):
    path = scratch_dir(t.spark, "prov")
    t.documents.select(*DOC).write.parquet(path)
    return R.with_file_name(t.spark.read.parquet(path)).agg(F.count("*").alias("rows"), F.count_if(F.col("file_name").endswith(".parquet")).alias("named"))


@query("write_mode", "SELECT 2 * count(*) AS appended, count(*) FILTER (WHERE doc_id % 2 = 0) AS replaced, count(*) FILTER (WHERE doc_id % 3 = 0) AS switched FROM documents")
def _(t):
    d = t.documents.select(*DOC)
    a, b, c = (scratch_dir(t.spark, n) for n in ("append", "hard", "soft"))
    W.write_table(d, a), W.write_table(d, a)
    W.write_table(d, b, "hard"), W.write_table(d.filter("doc_id % 2 = 0"), b, "auto")
    W.write_table(d, c, "soft"), W.write_table(d.filter("doc_id % 3 = 0"), c, "auto", in_use=True)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(t.spark.read.parquet(f"{a}/data"), "appended").crossJoin(n(t.spark.read.parquet(f"{b}/data"), "replaced")).crossJoin(n(W.SwitchedTable(t.spark, c).read(), "switched"))


@query("two_slot_table", "SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 1")
def _(t):
    table = W.two_slot_table(t.spark, scratch_dir(t.spark, "slots"))
    d = t.documents.select("doc_id", "lang")
    table.load(d)
    before = table.read()
    table.load(before.filter("doc_id % 2 = 1"))
    return table.read()


CLEAN = [(";", " "), ("\t", " "), ("\n", " "), ("\\", "/"), ('"', "")]


@query("sanitize", """SELECT doc_id, md5(replace(replace(replace(replace(replace(text, ';', ' '), chr(9), ' '), chr(10), ' '), '\\', '/'), '"', '')) AS h,
  md5(replace(replace(source || ';' || chr(9) || '"x', ';', ' '), chr(9), ' ')[:-3] || 'x') AS a FROM documents""")
def _(t):
    arr = S.sanitize_array(F.array(F.concat("source", F.lit(';\t"x'))), CLEAN)
    return t.documents.select("doc_id", F.md5(S.sanitize("text", CLEAN)).alias("h"), F.md5(arr[0]).alias("a"))


def _export(t):
    path = scratch_dir(t.spark, "export")
    d = t.documents.select("doc_id", "text", F.array(F.col("lang"), F.lit(None).cast("string"), F.col("source")).alias("arr"), "n_chars")
    W.write_export(d, path, max_rows=100, removals=CLEAN, clean_arrays=True)
    return path


@query("write_export", """SELECT doc_id, md5(trim(replace(replace(replace(replace(replace(text, ';', ' '), chr(9), ' '), chr(10), ' '), '\\', '/'), '"', ''), ' ')) AS h, '{' || lang || ',NULL,' || source || '}' AS arr, n_chars FROM documents""")
def _(t):
    r = R.read_copy_csv(t.spark, _export(t), "doc_id bigint, text string, arr string, n_chars bigint", sep=";")
    return r.select("doc_id", F.md5(F.trim(F.coalesce("text", F.lit("")))).alias("h"), "arr", "n_chars")


@query("write_export_bytes", """SELECT doc_id, md5(text) AS h, n_chars, true AS fits, true AS ordered FROM documents""")
def _(t):
    """Files of at most 200 KB in the order of ids, every text kept."""
    path = scratch_dir(t.spark, "export")
    W.write_export(t.documents.select("doc_id", "text", "n_chars"), path, compression="none", fmt="json", max_size="200 KB", order=["doc_id"])
    # Sizes come with the rows: a second reader would list and open every file again.
    r = t.spark.read.schema("doc_id bigint, text string, n_chars bigint, _part bigint").json(path).withColumns({"file": F.col("_metadata.file_path"), "size": F.col("_metadata.file_size")})
    span = r.groupBy("_part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.countDistinct("file").alias("files"), F.max("size").alias("largest"))
    after = span.withColumn("next", F.lead("low").over(Window.orderBy("_part")))
    checks = after.agg((F.max("largest") <= 200 * 1024).alias("fits"), F.bool_and((F.col("next").isNull() | (F.col("high") < F.col("next"))) & (F.col("files") == 1)).alias("ordered"))
    return r.select("doc_id", F.md5("text").alias("h"), "n_chars").crossJoin(F.broadcast(checks))


@query("part_ticket", "SELECT count(*) AS rows, true AS small_parts, true AS named FROM documents")
def _(t):
    parts = W.export_parts(t.spark, _export(t))
    tk = W.part_tickets(parts, "Base", "20240101000000", "1", "docs")
    name = F.concat(F.lit("base__20240101000000__1__docs__"), F.concat_ws("_", "part", "total", "rows"), F.lit(".zip"))
    return tk.agg(F.sum("rows").alias("rows"), F.bool_and(F.col("rows") <= 100).alias("small_parts"),
                  F.bool_and((F.col("archive") == name) & (F.col("ticket") == F.concat_ws(";", "file_name", "rows"))).alias("named"))


@query("package_summary", "SELECT source, 'base__20240101000000.tkt' AS summary, 'base__20240101000000__1__docs__' || row_number() OVER (ORDER BY source) || '_' || count(*) OVER () || '_' || n || '.zip' AS line FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def _(t):
    parts = t.documents.groupBy(F.col("source").alias("file_name")).agg(F.count("*").alias("rows"))
    tk = W.part_tickets(parts, "Base", "20240101000000", "1", "docs")
    return W.package_summary(tk, "Base", "20240101000000").join(tk.select(F.col("archive").alias("line"), F.col("file_name").alias("source")), "line")


@query("build_meta", """SELECT * FROM (VALUES (1, 'o_orderkey', 'BIGINT', NULL, NULL, NULL), (2, 'date_', 'TIMESTAMP', NULL, NULL, NULL), (3, 'price', 'NUMERIC', 12, 12, 2), (4, 'tags', 'STRING', NULL, NULL, NULL)) v(position, column_name, source_type, length, precision, scale)
CROSS JOIN (SELECT max(o_orderkey) AS top FROM orders)""")
def _(t):
    df = t.orders.select("o_orderkey", F.col("o_orderdate").alias("date"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.array("o_orderstatus").alias("tags"))
    comments = t.orders.agg(F.max("o_orderkey").cast("string").alias("description")).withColumn("column_name", F.explode(F.array(*[F.lit(c) for c in ("o_orderkey", "date_", "price", "tags")])))
    return W.build_meta(df, comments, frozenset({"date"})).select("position", "column_name", "source_type", "length", "precision", "scale", F.col("description").cast("bigint").alias("top"))


@query("source_type_meta", """SELECT p_partkey AS column_name, ['TIMESTAMP', 'BIGINT', 'NUMERIC', 'STRING', 'STRING', 'INT'][p_partkey % 6 + 1] AS source_type, p_partkey % 6 NOT IN (0, 2) AS notnull, CASE p_partkey % 6 WHEN 2 THEN 18 WHEN 3 THEN p_size END::BIGINT AS length,
  CASE WHEN p_partkey % 6 = 2 THEN 18 END::BIGINT AS precision, CASE WHEN p_partkey % 6 = 2 THEN 4 END::BIGINT AS scale FROM part""")
def _(t):
    k = F.col("p_partkey") % 6
    ty = (F.when(k == 0, "Nullable(DateTime)").when(k == 1, "Int64").when(k == 2, "LowCardinality(Nullable(Decimal(18, 4)))").when(k == 3, F.concat(F.lit("FixedString("), F.col("p_size").cast("string"), F.lit(")")))
          .when(k == 4, "Tuple(a String)").otherwise("UInt8"))
    return W.source_type_meta(t.part.select(F.col("p_partkey").alias("column_name"), ty.alias("type")))


def listing(t):
    k = F.col("page_id")
    return t.pages.select(
        F.concat(F.lit("d"), (k % 5).cast("string"), F.lit("/p"), k.cast("string"), F.when(k % 13 == 0, "/").when(k % 11 == 0, ".html.error").otherwise(".html")).alias("key"),
        F.length("html").cast("bigint").alias("size"), F.expr("timestamp'2024-01-31 20:30:00' - make_dt_interval(0, cast(page_id % 200 as int))").alias("last_modified"))


_OBJ = """l AS (SELECT page_id AS k, 'd' || (page_id % 5) AS folder, length(html) AS size, TIMESTAMP '2024-01-31 20:30:00' - to_hours(page_id % 200) AS m FROM pages)"""


@query("object_inventory", f"""WITH {_OBJ}, g AS (SELECT folder, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS objects, min(m)::VARCHAR AS oldest, max(m)::VARCHAR AS newest, count(*) FILTER (WHERE m < TIMESTAMP '2024-01-25') AS old_objects FROM l GROUP BY 1)
SELECT *, CASE WHEN old_objects * 100.0 / objects >= 20 THEN 'error' WHEN old_objects * 100.0 / objects >= 5 THEN 'warn' ELSE 'healthy' END AS status, round(bytes * 100.0::DOUBLE / 1000000000, 4) AS quota_pct FROM g""")
def _(t):
    return R.object_inventory(listing(t), "2024-02-01", 7, 1_000_000_000)


@query("select_objects", f"WITH {_OBJ} SELECT k FROM l WHERE folder = 'd1' AND k % 13 <> 0 AND k % 11 <> 0 AND (m + INTERVAL 3 HOUR)::DATE BETWEEN DATE '2024-01-28' AND DATE '2024-01-31'")
def _(t):
    s = R.select_objects(listing(t), "d1/*", "2024-01-28", "2024-01-31")
    return s.select(F.regexp_extract("key", r"p(\d+)\.", 1).cast("bigint").alias("k"))


@query("size_guard", f"WITH {_OBJ} SELECT count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, sum(size) <= 100000 AS accepted FROM l WHERE folder = 'd2' AND k % 13 <> 0 AND k % 11 <> 0")
def _(t):
    return R.size_guard(R.select_objects(listing(t), "d2/p*"), 100_000)


@query("list_objects", "SELECT count(*) AS files, true AS sized FROM (SELECT DISTINCT source FROM documents)")
def _(t):
    path = scratch_dir(t.spark, "objects")
    t.documents.select(*DOC).repartition("source").write.partitionBy("source").option("compression", "none").parquet(path)
    o = R.list_objects(t.spark, path).filter(F.col("key").endswith(".parquet"))
    return o.agg(F.count("*").alias("files"), F.bool_and(F.col("size") > 0).alias("sized"))
