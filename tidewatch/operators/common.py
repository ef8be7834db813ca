"""Building blocks shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.scalars import col


class CheckFailed(ValueError):
    """Raised by :func:`gate` when a check found violations."""


def gate(violations: DataFrame, message: str, sample: int = 10) -> None:
    """Raise when ``violations`` is not empty; only a small sample reaches the driver."""
    rows = violations.limit(sample).collect()
    if rows:
        raise CheckFailed(f"{message}: " + "; ".join(str(r.asDict()) for r in rows))


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    The rank-equals-one filter lets Spark cut every map task down to one row per key before the
    shuffle, so a key that holds a third of all rows costs one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "n") -> DataFrame:
    """The first ``n`` rows per key, numbered; cut map-side like :func:`latest_by_key`."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= n)


def bucketed_running(
    df: DataFrame, keys: list[str], order: str, value: str, bucket: Column, total: str, following: str | None = None
) -> DataFrame:
    """Running sum of ``value`` by ``order`` within ``keys`` (and the next order), hot keys included.

    Two levels: totals per (keys, bucket) are accumulated over the buckets first, then rows inside
    each (keys, bucket); no task holds all rows of a hot key. ``bucket`` must grow with ``order``
    and one input row per (keys, order) is expected.
    """
    rows = df.withColumn("_k", _bucket_key(keys, bucket))
    over = _over_buckets(keys)
    tops = rows.groupBy("_k").agg(F.sum(value).alias("_sum"), F.min(order).alias("_first")).select(
        "_k",
        F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lead("_first").over(over).alias("_after"))
    inside = Window.partitionBy("_k").orderBy(order)
    rows = rows.withColumn("_in", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    if following:
        rows = rows.withColumn("_next", F.lead(order).over(inside))
    out = rows.join(tops.hint("merge"), "_k").withColumn(total, F.col("_in") + F.col("_before"))
    if following:
        out = out.withColumn(following, F.coalesce("_next", "_after"))
    return out.select(*df.columns, total, *([following] if following else []))


def _bucket_key(keys: list[str], bucket: Column) -> Column:
    """Keys and bucket as one struct: it is never NULL and compares NULL keys as equal, so ranking,
    totals and the join of both share one partitioning."""
    return F.struct(*keys, bucket.alias("_b"))


def _over_buckets(keys: list[str]):
    return Window.partitionBy(*[F.col("_k")[k] for k in keys]).orderBy(F.col("_k")["_b"])


def bucketed_lag(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column, name: str) -> DataFrame:
    """Value of the previous row by ``order`` within ``keys``, hot keys included.

    The previous row is looked up inside (keys, bucket); only the first row of a bucket takes the
    last value of the bucket before. ``bucket`` must grow with ``order``.
    """
    rows = df.withColumn("_k", _bucket_key(keys, bucket))
    tops = rows.groupBy("_k").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last")).select(
        "_k", F.lag("_last").over(_over_buckets(keys))["v"].alias("_prev"))
    inside = Window.partitionBy("_k").orderBy(*order)
    rows = rows.withColumn("_lag", F.lag(value).over(inside)).withColumn("_n", F.row_number().over(inside))
    out = rows.join(tops.hint("merge"), "_k").withColumn(name, F.when(F.col("_n") == 1, F.col("_prev")).otherwise(F.col("_lag")))
    return out.select(*df.columns, name)


def exact_quantile(df: DataFrame, value: str, share: float, bucket: Column) -> DataFrame:
    """One row with the interpolated quantile of a numeric column and the row count.

    Values are counted and the counts accumulated in buckets; nothing is sorted in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    total = counts.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("rows"))
    run = bucketed_running(counts, [], "_v", "_c", bucket, "_cum").crossJoin(F.broadcast(total))
    pos = (F.col("rows") - 1) * F.lit(share)
    low, high = F.floor(pos), F.ceil(pos)
    at = lambda p: F.min(F.when(F.col("_cum") > p, F.col("_v")))
    g = run.groupBy("rows").agg(at(low).alias("_lo"), at(high).alias("_hi"))
    part = pos - F.floor(pos)
    q = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part
    return total.join(g.select("rows", q.alias("quantile")), "rows", "left")


def as_ts(as_of) -> Column:
    """Literal or column to timestamp."""
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp")


def as_date(as_of) -> Column:
    return as_ts(as_of).cast("date")


def with_total(df: DataFrame, keys: list[str], aggs: list[Column], label: str = "total") -> DataFrame:
    """Aggregate by ``keys`` plus one total row labelled in the first key: one scan, one shuffle."""
    level = F.grouping_id()
    out = df.groupingSets([keys, []], *keys).agg(level.alias("_level"), *aggs)
    first = keys[0]
    shown = F.when(F.col("_level") > 0, F.lit(label)).otherwise(F.col(first).cast("string"))
    return out.withColumn(first, shown).drop("_level")


def share(part, total) -> Column:
    """Percentage, NULL when there is no total."""
    return F.round(col(part) * F.lit(100.0) / F.nullif(col(total).cast("double"), F.lit(0.0)), 2)
