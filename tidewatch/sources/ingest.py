"""JSON items to table rows: key mapping, profiles, counters, staging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from tidewatch.functions.scalars import col
from tidewatch.operators.common import gate
from tidewatch.session import scratch_dir


def members(item) -> Column:
    """Top-level members of a JSON object as a map of VARIANT values."""
    return F.from_json(col(item), "map<string,variant>")


def pick_item(items: DataFrame, path: str) -> DataFrame:
    """The object at a dotted path inside each element; ``item`` is NULL where there is none."""
    v = F.try_variant_get(F.try_parse_json("item"), "$." + path, "variant")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return items.withColumn("item", F.when(is_object, F.to_json(v)))


def missing_items(items: DataFrame) -> DataFrame:
    return items.filter("item is null")


def colliding_keys(items: DataFrame) -> DataFrame:
    """Elements in which two keys differ only in case."""
    keys = F.map_keys(members("item"))
    return items.filter(F.size(F.array_distinct(F.transform(keys, lambda k: F.lower(k)))) < F.size(keys))


def _as_text(v: Column) -> Column:
    """Scalars as their text, nested values as JSON, JSON null as NULL."""
    kind = F.schema_of_variant(v)
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.when(kind == "VOID", None).when(nested, F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))


def _mapped(items: DataFrame, schema: T.StructType, carry: list[str]) -> DataFrame:
    """Each element parsed once: the target columns, what did not fit, and the keys with their kinds.

    Adds ``_rejected`` (columns whose value doesn't fit), ``_kinds`` (kind bits by key), ``_clash`` (keys that differ only in
    case) and ``_has`` (target columns mentioned); ``_item`` keeps the element where something did not fit.
    """
    names = [f.name.lower() for f in schema.fields]
    keys = F.map_keys("_m")
    lower = F.transform(keys, lambda k: F.lower(k))
    rows = items.select(*carry, "item", members("item").alias("_m"))
    rows = rows.withColumn("_clash", F.coalesce(F.size(F.array_distinct(lower)) < F.size(keys), F.lit(False)))
    rows = rows.withColumn("_l", F.when(~F.col("_clash"), F.transform_keys("_m", lambda k, v: F.lower(k))))
    text = F.struct(*[_as_text(F.col("_l")[n]).alias(f"t{i}") for i, n in enumerate(names)])
    rows = rows.withColumn("_t", text)
    fit = F.struct(*[F.col(f"_t.t{i}").try_cast(f.dataType).alias(f"v{i}") for i, f in enumerate(schema.fields)])
    rows = rows.withColumn("_v", fit)
    bad = F.array_compact(F.array(*[F.when(F.col(f"_t.t{i}").isNotNull() & F.col(f"_v.v{i}").isNull(), f.name) for i, f in enumerate(schema.fields)]))
    rows = rows.withColumn("_rejected", bad)
    return rows.select(
        *carry, *[F.col(f"_v.v{i}").alias(f.name) for i, f in enumerate(schema.fields)], "_rejected", "_clash",
        F.when(F.size("_rejected") > 0, F.col("item")).alias("_item"), F.transform_values("_m", lambda k, v: _kind_bit(v)).alias("_kinds"),
        F.array(*[F.coalesce(F.map_contains_key("_l", n), F.lit(False)) for n in names]).alias("_has"))


class StagedItems:
    """Elements mapped to a target in one pass over the source, kept as Parquet.

    The pass parses every element once, splits good rows from rejected ones and counts on the way; everything
    else reads the mapped columns only.
    """

    def __init__(self, items: DataFrame, schema: T.StructType, defaults: dict[str, Column] | None = None, carry: list[str] | None = None, path: str | None = None):
        self.schema, self.defaults, self.carry = schema, defaults or {}, list(carry or [])
        spark = items.sparkSession
        path = path or scratch_dir(spark, "mapped")
        seen = Observation()
        rows = _mapped(items, schema, self.carry)
        rows = rows.observe(
            seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("_rejected") > 0).alias("rejected"), F.count_if("_clash").alias("clash"),
            *[F.count_if(F.col("_has")[i]).alias(f"has{i}") for i in range(len(schema.fields))])
        rows.drop("_has").write.mode("overwrite").parquet(path)
        self.counts = seen.get
        self.all = spark.read.schema(rows.drop("_has").schema).parquet(path)
        if self.counts["clash"]:
            gate(self.all.filter("_clash").select(F.map_keys("_kinds").alias("keys")), "keys differ only in case")
        self.defaulted = [f.name for i, f in enumerate(schema.fields) if not self.counts[f"has{i}"]] if self.counts["rows"] else []
        if self.counts["rows"] and len(self.defaulted) == len(schema.fields):
            raise ValueError("no key matches a target column")

    def _typed(self, rows: DataFrame) -> DataFrame:
        """Columns that no element mentions get their default."""
        value = lambda f: self.defaults.get(f.name, F.lit(None)).cast(f.dataType) if f.name in self.defaulted else F.col(f.name)
        return rows.select(*self.carry, *[value(f).alias(f.name) for f in self.schema.fields])

    def rows(self) -> DataFrame:
        """All elements as rows; values that don't fit are NULL."""
        return self._typed(self.all)

    def good(self) -> DataFrame:
        return self._typed(self.all.filter(F.size("_rejected") == 0))

    def rejected(self) -> DataFrame:
        """Elements with a value that doesn't fit, and in which columns."""
        return self.all.filter(F.size("_rejected") > 0).select(*self.carry, F.col("_item").alias("item"), F.col("_rejected").alias("columns"))

    def counters(self, key_cap: int, file_col: str = "file_name") -> DataFrame:
        """One row: rows read, loaded, rejected; files; types of the target, kinds of the source; unmapped and defaulted columns.

        At most ``key_cap`` keys are listed, in order; ``source_truncated`` tells that there were more.
        """
        names = [f.name.lower() for f in self.schema.fields]
        keys = self.all.select(F.explode("_kinds").alias("key", "bit")).groupBy("key").agg(F.bit_or("bit").alias("bits"))
        first = keys.orderBy("key").limit(key_cap)
        shown = F.concat_ws(" ", "key", _kind_names("bits"))
        # Both lists are cut by the limit above.
        listed = first.agg(F.array_join(F.array_sort(F.collect_list(shown)), ",").alias("source"),
                           F.array_join(F.array_sort(F.collect_list(F.when(~F.lower("key").isin(*names), F.col("key")))), ",").alias("unmapped"))
        more = keys.agg((F.count("*") > key_cap).alias("source_truncated"))
        files = self.all.groupBy(file_col).agg(F.lit(1).alias("one")).agg(F.count("*").alias("files"))
        n = self.counts
        fixed = [F.lit(n["rows"]).alias("rows_source"), F.lit(n["rows"] - n["rejected"]).alias("rows_loaded"), F.lit(n["rejected"]).alias("rows_rejected"),
                 F.lit(",".join(f"{f.name} {f.dataType.simpleString()}" for f in self.schema.fields)).alias("target"), F.lit(",".join(self.defaulted)).alias("defaulted")]
        return files.crossJoin(F.broadcast(listed)).crossJoin(F.broadcast(more)).select(*fixed, "files", "source", "unmapped", "source_truncated")


def populate_record(items: DataFrame, schema: T.StructType, defaults: dict[str, Column] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Elements as rows of the target: keys are matched without case, values cast, other keys dropped.

    Columns no element mentions keep their default; mentioned ones are NULL where an element lacks
    them. Keys that differ only in case are an error. The source is read and parsed once, into the shared folder.
    """
    return StagedItems(items, schema, defaults, carry).rows()


def cast_failures(items: DataFrame, schema: T.StructType) -> DataFrame:
    """Elements holding a value that does not fit its target column, with the column."""
    rows = items.withColumn("_m", F.transform_keys(members("item"), lambda k, v: F.lower(k)))
    bad = F.array_compact(F.array(*[
        F.when(_as_text(F.col("_m")[f.name.lower()]).isNotNull() & _as_text(F.col("_m")[f.name.lower()]).try_cast(f.dataType).isNull(), f.name) for f in schema.fields]))
    return rows.select(*items.columns, F.explode(bad).alias("column"))


def unmapped_keys(items: DataFrame, schema: T.StructType) -> DataFrame:
    """Keys without a target column, with the number of elements."""
    names = [f.name.lower() for f in schema.fields]
    return items.select(F.explode(F.map_keys(members("item"))).alias("key")).filter(~F.lower("key").isin(*names)).groupBy("key").agg(F.count("*").alias("rows"))


# JSON kinds in the order a profile lists them.
KINDS = ("string", "number", "boolean", "object", "array", "null")


def _kind_bit(v: Column) -> Column:
    """One bit per kind of a VARIANT, in the order of KINDS."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", 1).when(kind == "BOOLEAN", 4).when(kind.startswith("OBJECT"), 8).when(kind.startswith("ARRAY"), 16).when(kind == "VOID", 32).otherwise(2)


def _kind_names(bits: str) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(bits).bitwiseAND(1 << i) != 0, k) for i, k in enumerate(KINDS)])), "|")


def source_profile(items: DataFrame, key_cap: int | None = None) -> DataFrame:
    """Every top-level key with the kinds of values seen, joined in a fixed order.

    With ``key_cap`` only that many keys are listed and ``truncated`` tells that there were more.
    """
    g = items.select(F.explode(F.map_entries(members("item"))).alias("e")).groupBy(F.col("e.key").alias("key")).agg(
        F.bit_or(_kind_bit(F.col("e.value"))).alias("_f"), F.count("*").alias("rows"))
    out = g.select("key", _kind_names("_f").alias("kinds"), "rows")
    if key_cap is None:
        return out.withColumn("truncated", F.lit(False))
    total = out.agg((F.count("*") > key_cap).alias("truncated"))
    return out.orderBy("key").limit(key_cap).crossJoin(F.broadcast(total))


def stage_then_load(items: DataFrame, schema: T.StructType, target_path: str, stage_path: str | None = None, mode: str = "append", defaults: dict[str, Column] | None = None, carry: list[str] | None = None) -> StagedItems:
    """Stage the mapped elements first, then write the good ones to the target; a failed second step keeps what is staged.

    The source is read once; the second step copies columns. Rejected elements stay in the stage, with the columns that did not fit.
    """
    staged = StagedItems(items, schema, defaults, carry, stage_path)
    staged.good().write.mode(mode).parquet(target_path)
    return staged
