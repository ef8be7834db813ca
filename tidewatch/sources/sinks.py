"""Writers: load modes, switching copies, delimited exports, tickets, column metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidewatch.functions.scalars import array_text, sanitize, sanitize_array
from tidewatch.session import truncate_lineage


class SwitchedTable:
    """A table in numbered versions with a pointer to the active one.

    A load writes a new version and flips the pointer last, so readers keep the old data until
    then. The pointer is a small table that is only appended to; its newest row counts.
    """

    def __init__(self, spark: SparkSession, root: str, slots: int | None = None):
        self.spark, self.root, self.slots = spark, root.rstrip("/"), slots

    def _pointer(self) -> DataFrame:
        return self.spark.read.schema("version bigint").parquet(f"{self.root}/pointer")

    def version(self) -> int:
        try:
            row = self._pointer().agg(F.max("version")).first()
        except Exception as e:  # the pointer does not exist before the first load
            if "PATH_NOT_FOUND" in str(e):
                return -1
            raise
        return -1 if row[0] is None else row[0]

    def path(self, version: int) -> str:
        return f"{self.root}/data_{version % self.slots if self.slots else version}"

    def read(self) -> DataFrame:
        v = self.version()
        if v < 0:
            raise ValueError(f"{self.root} was never loaded")
        return self.spark.read.parquet(self.path(v))

    def load(self, df: DataFrame) -> int:
        v = self.version() + 1
        df.write.mode("overwrite").parquet(self.path(v))
        self.spark.range(v, v + 1).toDF("version").coalesce(1).write.mode("append").parquet(f"{self.root}/pointer")
        return v


def two_slot_table(spark: SparkSession, root: str) -> SwitchedTable:
    """Two copies: loads go to the inactive one, then the active number flips."""
    return SwitchedTable(spark, root, slots=2)


WRITE_MODES = ("none", "hard", "soft", "auto")


def write_table(df: DataFrame, root: str, mode: str = "none", in_use: bool = False) -> str:
    """Load into a table folder: append, replace in place, or replace while readers keep the old data.

    ``auto`` replaces in place when nobody reads, else softly. Returns what was done.
    """
    if mode not in WRITE_MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "auto":
        mode = "soft" if in_use else "hard"
    if mode == "soft":
        SwitchedTable(df.sparkSession, root).load(df)
        return "soft"
    df.write.mode("append" if mode == "none" else "overwrite").parquet(f"{root.rstrip('/')}/data")
    return "append" if mode == "none" else "hard"


def export_columns(df: DataFrame, removals: list[tuple[str, str]] = (), clean_arrays: bool = False, pg_arrays: bool = True) -> DataFrame:
    """Columns ready for a delimited file: cleaned texts, arrays in brace or JSON notation."""
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType) and removals:
            c = sanitize(c, removals)
        elif isinstance(f.dataType, T.ArrayType):
            if clean_arrays and removals and isinstance(f.dataType.elementType, T.StringType):
                c = sanitize_array(c, removals)
            c = array_text(c) if pg_arrays else F.to_json(c)
        elif isinstance(f.dataType, (T.StructType, T.MapType, T.VariantType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(out)


# Units of a size limit.
UNITS = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}


def size_limit(text: str) -> int:
    """Bytes of a limit such as "100 MB"."""
    m = re.fullmatch(r"\s*(\d+)\s*([KMG]?B)\s*", text, re.I)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) * UNITS[m[2].upper()]


def dealt_by_size(df: DataFrame, order: list[str], size: Column, limit: int) -> DataFrame:
    """Rows with the number ``_part`` of their part: parts follow ``order`` and hold at most ``limit`` bytes each.

    Bytes are accumulated in two levels, totals of key ranges first, then rows inside a range, so no task sees all rows. A part
    takes the rows that start within ``limit`` less the longest row, which is what keeps the last one inside.
    """
    rows = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).withColumn("_bytes", size).withColumn("_row", F.monotonically_increasing_id())
    rows = truncate_lineage(rows, "export-rows")
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    ranges = rows.groupBy("_range").agg(F.sum("_bytes").alias("_sum"), F.max("_bytes").alias("_longest")).select(
        "_range", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before"), F.max("_longest").over(Window.partitionBy()).alias("_longest"))
    inside = Window.partitionBy("_range").orderBy(*order, "_row")
    at = F.col("_before") + F.sum("_bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bytes")
    step = F.lit(limit + 1) - F.col("_longest")
    checked = F.when(step <= 0, F.raise_error(F.concat(F.lit(f"a row is longer than a part of {limit} bytes: "), F.col("_longest").cast("string")))).otherwise(step)
    return rows.join(F.broadcast(ranges), "_range").withColumn("_part", F.floor(at / checked).cast("bigint")).drop("_range", "_bytes", "_row", "_before", "_longest")


def write_export(df: DataFrame, path: str, sep: str = ";", quote: str = '"', header: bool = True, compression: str = "gzip", max_rows: int = 0, fmt: str = "csv", max_size: str | None = None, order: list[str] = (), **clean) -> None:
    """Delimited (or JSON lines) export, split by rows or by bytes per file and compressed.

    With ``max_size`` ("100 MB", before compression) the rows go to files in ``order``, none larger than that.
    """
    options = {"sep": sep, "quote": quote, "escape": quote, "emptyValue": ""}
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown format {fmt!r}")
    out = export_columns(df, **clean)
    if max_size:
        if not order:
            raise ValueError("a split by size needs an order")
        head = len(sep.join(out.columns).encode()) + 2 * len(quote) * len(out.columns) + 1 if fmt == "csv" and header else 0
        whole = F.struct(*out.columns)
        text = F.to_csv(whole, options) if fmt == "csv" else F.to_json(whole)
        out = dealt_by_size(out, list(order), F.octet_length(text).cast("bigint") + 1, size_limit(max_size) - head)
        out = out.repartition("_part").sortWithinPartitions("_part", *order)
    w = out.write.mode("overwrite").option("compression", compression)
    if max_size:
        w = w.partitionBy("_part")
    if max_rows:
        w = w.option("maxRecordsPerFile", max_rows)
    if fmt == "csv":
        w.options(header=header, **options).csv(path)
    else:
        w.json(path)


def export_parts(spark: SparkSession, path: str, sep: str = ";", quote: str = '"', header: bool = True) -> DataFrame:
    """Rows per written file."""
    df = spark.read.option("sep", sep).option("quote", quote).option("escape", quote).option("header", header).csv(path)
    return df.select(F.col("_metadata.file_name").alias("file_name")).groupBy("file_name").agg(F.count("*").alias("rows"))


def part_tickets(parts: DataFrame, base: str, stamp: str, group: str, table: str) -> DataFrame:
    """Archive name and ticket line of every part: number, total and rows are part of the name.

    There is one row per file, numbered in the order of file names: inside ranges of names, and on from the files of
    the ranges before.
    """
    columns = parts.columns
    parts = truncate_lineage(parts.repartitionByRange("file_name").withColumn("_range", F.spark_partition_id()), "parts")
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = parts.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    n = (F.row_number().over(Window.partitionBy("_range").orderBy("file_name")) + F.col("_before")).cast("int")
    name = F.lower(F.concat(F.lit(f"{base}__{stamp}__{group}__{table}__"), F.col("part").cast("string"), F.lit("_"), F.col("total").cast("string"), F.lit("_"), F.col("rows").cast("string"), F.lit(".zip")))
    numbered = parts.join(F.broadcast(ranges), "_range").withColumn("part", n).select(*columns, "part", "total")
    return numbered.withColumn("archive", name).withColumn(
        "ticket", F.concat(F.col("file_name"), F.lit(";"), F.col("rows").cast("string")))


def package_summary(tickets: DataFrame, base: str, stamp: str) -> DataFrame:
    """Lines of the package ticket: all archives of all tables."""
    return tickets.select(F.lit(f"{base}__{stamp}.tkt".lower()).alias("summary"), F.col("archive").alias("line"))


# Target types of exported columns.
META_TYPES = {"timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "tinyint": "INT", "smallint": "INT", "int": "INT", "bigint": "BIGINT",
              "float": "FLOAT", "double": "DOUBLE", "decimal": "NUMERIC", "string": "STRING", "array": "STRING", "boolean": "STRING"}
SOURCE_TYPES = {"DateTime": "TIMESTAMP", "DateTime64": "TIMESTAMP", "Date": "DATE", "Int8": "INT", "Int16": "INT", "Int32": "INT", "UInt8": "INT", "UInt16": "INT", "UInt32": "INT",
                "Int64": "BIGINT", "UInt64": "BIGINT", "Float32": "FLOAT", "Float64": "DOUBLE", "Decimal": "NUMERIC", "UUID": "STRING", "String": "STRING", "Array": "STRING"}


def safe_name(name: str, reserved: frozenset[str] = frozenset()) -> str:
    """Reserved words, a setting of the receiver, get an underscore."""
    return name + "_" if name.lower() in reserved else name


def build_meta(df: DataFrame, comments: DataFrame | None = None, reserved: frozenset[str] = frozenset()) -> DataFrame:
    """Column metadata of a query result; one row per column, with descriptions joined in."""
    rows = []
    for i, f in enumerate(df.schema.fields):
        base = f.dataType.typeName().replace("integer", "int").replace("long", "bigint").replace("short", "smallint").replace("byte", "tinyint")
        dec = isinstance(f.dataType, T.DecimalType)
        rows.append((i + 1, safe_name(f.name, reserved), META_TYPES.get(base, "STRING"), f.dataType.precision if dec else None, f.dataType.precision if dec else None,
                     f.dataType.scale if dec else None, not f.nullable))
    meta = df.sparkSession.createDataFrame(rows, "position int, column_name string, source_type string, length int, precision int, scale int, notnull boolean")
    if comments is None:
        return meta.withColumn("description", F.lit(None).cast("string"))
    return meta.join(comments.select("column_name", "description"), "column_name", "left")


def source_type_meta(columns: DataFrame) -> DataFrame:
    """Declared source types (column_name, type) to target type, nullability, length, precision and scale."""
    t = F.regexp_replace("type", r"^LowCardinality\((.*)\)$", "$1")
    nullable = t.startswith("Nullable(")
    inner = F.regexp_replace(t, r"^Nullable\((.*)\)$", "$1")
    base = F.substring_index(inner, "(", 1)
    number = lambda rx: F.nullif(F.regexp_extract(inner, rx, 1), F.lit("")).cast("int")
    precision, scale = number(r"^Decimal\((\d+)"), number(r"^Decimal\(\d+,\s*(\d+)\)")
    mapped = None
    for k, v in SOURCE_TYPES.items():
        mapped = F.when(base == k, v) if mapped is None else mapped.when(base == k, v)
    return columns.select(
        "column_name", mapped.otherwise("STRING").alias("source_type"), (~nullable).alias("notnull"),
        F.coalesce(number(r"^FixedString\((\d+)\)"), F.when(scale.isNotNull(), precision)).alias("length"), F.when(scale.isNotNull(), precision).alias("precision"), scale.alias("scale"))
