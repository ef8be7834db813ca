"""Readers: exchange packages, delimited and JSON files, archives, object listings."""

from __future__ import annotations

import io
import os
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch.functions.scalars import col, try_json
from tidewatch.operators.common import as_date, as_ts

PACKAGE_SCHEMA = "_gp_id bigint, _gp_name string, _gp_key string, _gp_data string"


def read_exchange_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated package: columns by position, no quoting, JSON kept raw."""
    return (
        spark.read.schema(PACKAGE_SCHEMA).option("sep", "\t").option("header", True).option("enforceSchema", True)
        .option("quote", "\u0001").option("escape", "\u0001").csv(path)
    )


def read_copy_csv(spark: SparkSession, path: str, schema, sep: str = ",", quote: str = '"', header: bool = True, null: str = "") -> DataFrame:
    """Delimited text; a line break inside quotes belongs to the record, doubled quotes stand for one."""
    return (
        spark.read.schema(schema).option("sep", sep).option("quote", quote).option("escape", quote).option("header", header)
        .option("multiLine", True).option("nullValue", null).option("mode", "FAILFAST").csv(path)
    )


# File name endings and what they hold.
FORMATS = {"csv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl"}


def detect_format(name) -> Column:
    """Format by file name: compression endings are looked through, unknown endings are NULL."""
    base = F.regexp_replace(F.lower(col(name)), r"\.gz$", "")
    end = F.regexp_extract(base, r"\.([a-z0-9]+)$", 1)
    out = F.when(end == "zip", "zip")
    for k, v in FORMATS.items():
        out = out.when(end == k, v)
    return out


def no_bom(text) -> Column:
    return F.regexp_replace(col(text), "^﻿", "")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; files are read in parallel, each by one task."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), no_bom("value").alias("text"))


def json_array_items(texts: DataFrame, root: str | None = None) -> DataFrame:
    """Elements of JSON arrays, or of the array under one key; anything but one complete document fails.

    ``texts``: file_name, text. Output: file_name, n, item (JSON text).
    """
    doc = try_json("text")
    arr = doc if root is None else F.try_variant_get(doc, f"$.{root}", "variant")
    items = F.try_variant_get(arr, "$", "array<variant>")
    checked = F.when(items.isNull(), F.raise_error(F.concat(F.lit("no JSON array in "), F.col("file_name")))).otherwise(items)
    return texts.select("file_name", F.posexplode(checked).alias("pos", "v")).select("file_name", (F.col("pos") + 1).alias("n"), F.to_json("v").alias("item"))


def read_json_array(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    return json_array_items(whole_texts(spark, path), root)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their number inside the file.

    A file is read in blocks: numbers inside a block come from the scan itself, and the few block
    sizes (a row per block) are accumulated and go to every task, so large files keep their parallel read.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_p"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("_b"), F.col("value")
    ).withColumn("_i", F.monotonically_increasing_id())
    blocks = raw.groupBy("_p", "_b").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    over = Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    return raw.join(F.broadcast(blocks), ["_p", "_b"]).select("file_name", (F.col("_before") + F.col("_i") - F.col("_first") + 1).alias("line_no"), no_bom("value").alias("value"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One element per non-empty line (file_name, line_no, item); unreadable lines have no item."""
    return jsonl_items(numbered_lines(spark, path).filter(F.trim("value") != ""))


def jsonl_items(lines: DataFrame) -> DataFrame:
    return lines.select("file_name", "line_no", F.to_json(try_json("value")).alias("item"), "value")


def bad_lines(items: DataFrame) -> DataFrame:
    """Unreadable lines with their number; feed to ``gate``."""
    return items.filter("item is null").select("file_name", "line_no", "value")


ZIP_LINES = "archive string, member string, line_no bigint, line string"
CHUNK = 10_000


def read_zip(files: DataFrame) -> DataFrame:
    """Lines of all members of zip archives; ``files`` has ``path`` and ``content`` as binaryFile gives them.

    Archives are opened in parallel; inside a task members are streamed and handed on in chunks.
    Nested archives are refused. Old archives keep member names in cp866.
    """
    def lines(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        name = info.filename
                        if not info.flag_bits & 0x800:
                            name = name.encode("cp437").decode("cp866")
                        if name.lower().endswith((".zip", ".gz")):
                            raise ValueError(f"{path}: archive inside an archive: {name}")
                        rows = []
                        with z.open(info) as member:
                            for n, text in enumerate(io.TextIOWrapper(member, "utf-8-sig"), 1):
                                rows.append((os.path.basename(path), name, n, text.rstrip("\r\n")))
                                if len(rows) == CHUNK:
                                    yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "line"])
                                    rows = []
                        yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "line"])

    return files.select("path", "content").mapInPandas(lines, ZIP_LINES)


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """Object listing (key, size, last_modified) without reading any content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def object_inventory(listing: DataFrame, as_of, ttl_days: int, quota_bytes: int, warn_pct: float = 5, error_pct: float = 20) -> DataFrame:
    """Per top folder: bytes, objects, age bounds, share over the time limit with its grade, part of the quota."""
    old = F.col("last_modified") < as_ts(as_of) - F.make_dt_interval(days=F.lit(ttl_days))
    g = listing.withColumn("folder", F.substring_index("key", "/", 1)).groupBy("folder").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("objects"), F.min("last_modified").alias("oldest"), F.max("last_modified").alias("newest"), F.count_if(old).alias("old_objects"))
    share = F.col("old_objects") * 100.0 / F.col("objects")
    return g.withColumn("status", F.when(share >= error_pct, "error").when(share >= warn_pct, "warn").otherwise("healthy")).withColumn(
        "quota_pct", F.round(F.col("bytes") * 100.0 / quota_bytes, 4))


def like_mask(mask: str) -> str:
    """Wildcard to a regular expression."""
    special = {"*": ".*", "?": "."}
    return "^" + "".join(special.get(ch, "\\" + ch if not ch.isalnum() and ch not in "_/" else ch) for ch in mask) + "$"


def select_objects(listing: DataFrame, mask: str, date_from=None, date_to=None) -> DataFrame:
    """Objects by wildcard and local calendar day of their change (both days included); no folders, no error files."""
    day = F.to_date(F.col("last_modified") + F.expr("interval 3 hours"))
    out = listing.filter(F.col("key").rlike(like_mask(mask)) & ~F.col("key").endswith("/") & ~F.col("key").endswith(".error"))
    if date_from is not None:
        out = out.filter(day >= as_date(date_from))
    if date_to is not None:
        out = out.filter(day <= as_date(date_to))
    return out


def size_guard(selected: DataFrame, max_bytes: int) -> DataFrame:
    """Total size of a selection against its limit."""
    return selected.agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("accepted", F.col("bytes") <= max_bytes)


def with_file_name(df: DataFrame, name: str = "file_name") -> DataFrame:
    """Provenance column of a file-based frame."""
    return df.select("*", F.col("_metadata.file_name").alias(name))


