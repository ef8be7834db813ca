"""Typed loads of exchange flows into tables that change in one step."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewatch.operators.common import CheckFailed, as_ts, gate, latest_by_key
from tidewatch.operators.exchange import SERVICE, SPARK_TYPES, infer_flow_schema, load_log, load_totals, typed_flow
from tidewatch.operators.quality import reconcile_counts, unique_check
from tidewatch.sources.sinks import SwitchedTable

CLEARS = (None, "drop", "delete", "truncate", "optimize", "final")
HIDDEN = [T.StructField("_load", T.IntegerType()), T.StructField("_part", T.StringType())]


class FlowTable:
    """A table kept as folders by load and key, with a switched list of those that count.

    A load writes its rows under a number of its own, where no reader looks. Switching the list makes them the table, together
    with whatever the load clears: an untouched key is neither read nor written again. A load that fails before the switch
    leaves the table as it was. Readers join the list, so Spark prunes the folders of cleared and unfinished loads.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.list = SwitchedTable(spark, f"{self.root}/list")

    def exists(self) -> bool:
        return self.list.version() >= 0

    def listed(self) -> DataFrame:
        """Folders that count, as (load, part)."""
        if not self.exists():
            return self.spark.createDataFrame([], "load int, part string")
        return self.list.read().filter("load >= 0")

    def schema(self) -> T.StructType:
        """Columns of the table; the list keeps them in a row of its own."""
        text = self.list.read().filter("load < 0").first()["part"]
        return T.StructType.fromJson(json.loads(text))

    def rows(self, schema: T.StructType) -> DataFrame:
        """All rows ever written, with their folders."""
        return self.spark.read.schema(T.StructType([*schema.fields, *HIDDEN])).parquet(f"{self.root}/data")

    def read(self, listed: DataFrame | None = None, schema: T.StructType | None = None) -> DataFrame:
        """Rows of the folders that count, or of those given."""
        listed = self.listed() if listed is None else listed
        on = (F.col("_load") == F.col("load")) & (F.col("_part") == F.col("part"))
        return self.rows(schema or self.schema()).join(listed, on, "left_semi").drop("_load", "_part")

    def write(self, rows: DataFrame, key: str) -> DataFrame:
        """Write rows under a new load number, not listed yet; the folders they took."""
        load = self.list.version() + 1
        parts = rows.withColumn("_part", part_of(F.col(key))).write.mode("overwrite").partitionBy("_part")
        parts.parquet(f"{self.root}/data/_load={load}")
        return self.rows(rows.schema).filter(F.col("_load") == load).select(F.col("_load").alias("load"), F.col("_part").alias("part")).distinct()

    def switch(self, listed: DataFrame, schema: T.StructType) -> None:
        """From now on these folders are the table."""
        note = self.spark.createDataFrame([(-1, schema.json())], "load int, part string")
        self.list.load(listed.select("load", "part").unionByName(note).coalesce(1))


def part_of(key: Column) -> Column:
    """Folder name of a key; null and empty keys have names of their own."""
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))


def flow_schema(envelope: DataFrame, flow: str, most: int) -> T.StructType:
    """Fields found in the documents of a flow, in the order of their places; more than `most` are an error."""
    found = infer_flow_schema(envelope.filter(F.col("_gp_name") == flow)).orderBy("position", "field").limit(most + 1).collect()
    if not found or len(found) > most:
        raise CheckFailed(f"{flow}: {'no fields found' if not found else f'more than {most} fields'}")
    return T.StructType.fromDDL(", ".join(f"`{r.field.replace('`', '``')}` {SPARK_TYPES[r.type]}" for r in found))


@dataclass(frozen=True)
class LoadResult:
    log: DataFrame
    totals: DataFrame


def load_flow(
    envelope: DataFrame, flow: str, table: FlowTable, run_ts, schema: T.StructType | str = "*", clear: str | None = None,
    key: str = "_gp_key", announced: DataFrame | None = None, unique: list[str] | None = None, most_fields: int = 1000,
) -> LoadResult:
    """Load the new packages of a flow into its table, or raise :class:`CheckFailed` and leave the table as it was.

    ``schema`` "*" takes the fields of the table, or finds them in the documents if there is no table yet. ``clear`` says what goes
    first: "drop" and "delete" the keys of the flow's envelope, "truncate" everything; "optimize" and "final" keep the newest
    version per (key, content) of the keys that were loaded. Then rows of packages above the newest package left are added.

    Gates look at the table as it would be: ``announced`` (id, name, key, type, cnt, ts) must agree with the rows of this run's newest package, and
    ``unique`` columns must not repeat. ``_gp_ts`` of the envelope is the time of the run that received it.
    """
    if clear not in CLEARS:
        raise ValueError(f"unknown way to clear: {clear}")
    if schema == "*":
        schema = T.StructType([f for f in table.schema().fields if f.name not in SERVICE]) if table.exists() else flow_schema(envelope, flow, most_fields)
    mine = envelope.filter(F.col("_gp_name") == flow)
    listed = table.listed()
    if clear == "truncate":
        listed = listed.filter("false")
    elif clear in ("drop", "delete"):
        listed = listed.join(mine.select(part_of(F.col(key)).alias("part")).distinct(), "part", "left_anti")
    new = typed_flow(mine, flow, schema)
    if table.exists():
        newest = table.read(listed, new.schema).agg(F.coalesce(F.max("_gp_id"), F.lit(0)).alias("_seen"))
        new = new.crossJoin(F.broadcast(newest)).filter("_gp_id > _seen").drop("_seen")
        if clear in ("optimize", "final"):
            touched = new.select(part_of(F.col(key)).alias("part")).distinct()
            old = table.read(listed.join(touched, "part", "left_semi"), new.schema)
            new = latest_by_key(old.unionByName(new), ["_gp_key", "_gp_hash"], [F.desc("_gp_id"), F.desc("_gp_ts")])
    fresh = table.write(new, key)
    if clear in ("optimize", "final"):
        listed = listed.join(fresh.select("part"), "part", "left_anti")
    listed = listed.select("load", "part").unionByName(fresh)
    staged = table.read(listed, new.schema)
    if announced is not None:
        arrived = staged.select(F.col("_gp_id").alias("id"), F.lit(flow).alias("name"), F.col("_gp_key").alias("key"), F.col("_gp_ts").alias("ts"))
        checked = reconcile_counts(announced.filter(F.col("name") == flow), arrived, how="right", now=run_ts, last_target_id=True, not_empty=True)
        if checked.isEmpty():
            raise CheckFailed(f"{flow}: nothing arrived")
        gate(checked.filter("not is_ok"), f"{flow}: counts differ")
    if unique:
        gate(unique_check(staged, unique), f"{flow}: rows repeat")
    table.switch(listed, new.schema)
    return LoadResult(load_log(table.read(), flow, run_ts), load_totals(table.read(), run_ts))
