"""Newest rows by key of endless streams: tables merged per batch instead of state that only grows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewatch.functions.scalars import canonical_json
from tidewatch.operators.common import bucketed_lag, latest_by_key
from tidewatch.session import scratch_dir
from tidewatch.sources.sinks import SwitchedTable


class LatestTable:
    """The newest row per key as a table: a folder per batch, folded into a switched table now and then.

    A batch adds its own newest rows only, so a hot key costs one row a task. Batches before the current one are folded
    every ``fold_every`` batches; then keys whose first ``order`` column is more than ``keep`` older than the newest one go, which
    is what bounds the table. A repeated batch overwrites its folder and still finds the table as it was before it.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], order: list[str], fold_every: int, keep: str | None = None):
        self.spark, self.root, self.keys, self.order = spark, root.rstrip("/"), keys, order
        self.schema, self.fold_every, self.keep = schema, fold_every, keep
        self.folded = SwitchedTable(spark, f"{self.root}/folded")

    def _newest(self, rows: DataFrame) -> DataFrame:
        return latest_by_key(rows, self.keys, [F.desc_nulls_last(c) for c in self.order])

    def _batches(self) -> DataFrame:
        shape = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        try:
            return self.spark.read.schema(shape).parquet(f"{self.root}/batches")
        except AnalysisException as e:  # before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], shape)

    def read(self, before: int | None = None) -> DataFrame:
        """Newest row per key, of all batches or of those before one."""
        rows, upto = self._batches(), -1
        if self.folded.version() >= 0:
            base = self.folded.read()
            upto = base.agg(F.max("_upto")).first()[0]
        if before is not None:
            if before <= upto:
                raise ValueError(f"batch {before} is folded already")
            rows = rows.filter(F.col("batch") < before)
        rows = rows.filter(F.col("batch") > upto).drop("batch")
        if upto >= 0:
            rows = rows.unionByName(base.filter("not _mark").select(*self.schema.fieldNames()))
        return self._newest(rows)

    def merge(self, rows: DataFrame, batch: int) -> None:
        self._newest(rows.select(*self.schema.fieldNames())).write.mode("overwrite").parquet(f"{self.root}/batches/batch={batch}")
        if batch and batch % self.fold_every == 0:
            self.fold(batch)

    def fold(self, before: int) -> None:
        """Rewrite everything before a batch as one table, without the keys that are too old."""
        rows = self.read(before)
        if self.keep:
            newest = rows.agg(F.max(self.order[0]).alias("_newest"))
            rows = rows.crossJoin(F.broadcast(newest)).filter(F.col(self.order[0]) >= F.col("_newest") - F.expr(f"interval {self.keep}")).drop("_newest")
        # One row more tells the last batch folded, even if no key is left.
        mark = self.spark.createDataFrame([tuple([None] * len(self.schema.fields))], T.StructType([T.StructField(f.name, f.dataType) for f in self.schema.fields]))
        rows = rows.withColumn("_mark", F.lit(False)).unionByName(mark.withColumn("_mark", F.lit(True)))
        self.folded.load(rows.withColumn("_upto", F.lit(before - 1).cast("long")))


def drain_latest(stream: DataFrame, table: LatestTable, checkpoint: str | None = None) -> DataFrame:
    """Merge everything available into a table of newest rows and return it."""
    checkpoint = checkpoint or scratch_dir(table.spark, "latest-checkpoint")
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: table.merge(df, batch)).trigger(availableNow=True)
    query.start().awaitTermination()
    return table.read()


# --- changed documents ---------------------------------------------------------------------------------

DOCUMENTS = T.StructType([T.StructField("url", T.StringType()), T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("h", T.StringType())])


def documents_table(spark: SparkSession, root: str, fold_every: int, keep: str | None = None) -> LatestTable:
    """Last known document (its hash and time) per (url, id)."""
    return LatestTable(spark, root, DOCUMENTS, ["url", "id"], ["ts", "h"], fold_every, keep)


def _print() -> Column:
    """Hash of a document in its canonical form; unreadable and missing ones have the same."""
    return F.coalesce(F.md5(canonical_json("msg")), F.lit(""))


def changed(documents: DataFrame, known: DataFrame, bucket: Column) -> DataFrame:
    """Documents (url, id, ts, msg) that differ from the one before of their (url, id), given the last known ones.

    Documents older than the known one do not count. ``bucket`` grows with ts and spreads a hot key over tasks.
    """
    rows = documents.select("url", "id", "ts", "msg", _print().alias("h"))
    same = lambda a, b: a["url"].eqNullSafe(b["url"]) & a["id"].eqNullSafe(b["id"])
    last = known.join(rows.select("url", "id").distinct().alias("r"), same({"url": known["url"], "id": known["id"]}, {"url": F.col("r.url"), "id": F.col("r.id")}), "left_semi")
    last = last.select("url", "id", F.col("ts").alias("seen"), F.col("h").alias("was"))
    fresh = rows.alias("d").join(last.alias("k"), same({"url": F.col("d.url"), "id": F.col("d.id")}, {"url": F.col("k.url"), "id": F.col("k.id")}), "left").filter("seen is null or ts >= seen")
    fresh = fresh.select("d.*", "was")
    placed = bucketed_lag(fresh, ["url", "id"], ["ts", "h"], "h", bucket, "before")
    return placed.filter(~F.coalesce("before", "was").eqNullSafe(F.col("h"))).select("url", "id", "ts", "msg")


def drain_changed(stream: DataFrame, table: LatestTable, target: str, bucket: Column, checkpoint: str | None = None) -> DataFrame:
    """Write the changed documents of everything available, a folder per batch, and return them all."""
    spark = table.spark
    checkpoint = checkpoint or scratch_dir(spark, "changed-checkpoint")

    def step(df: DataFrame, batch: int) -> None:
        changed(df, table.read(batch), bucket).write.mode("overwrite").parquet(f"{target}/batch={batch}")
        table.merge(df.withColumn("h", _print()), batch)

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", target).schema("url string, id bigint, ts timestamp, msg string, batch long").parquet(f"{target}/batch=*")
