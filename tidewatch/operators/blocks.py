"""Fingerprints of key ranges that add up: two tables are compared from the top down, and only differing blocks are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MEASURES = ["cnt", "sum_a", "sum_b", "xor_a"]


def row_hash(columns: list[str], seed: int) -> Column:
    """64-bit hash of a row; nulls count, so a value can't move to the next column unseen."""
    marks = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    return F.xxhash64(F.lit(seed), marks, *[F.col(c) for c in columns])


def block_fingerprints(df: DataFrame, key: str, columns: list[str], width: int) -> DataFrame:
    """(block, cnt, sum_a, sum_b, xor_a): rows whose whole-number key lies in [block * width, (block + 1) * width).

    Sums and exclusive ors of two row hashes add up map-side, whatever the order of the rows. Rows without a key are the block null.
    """
    block = F.floor(F.col(key) / F.lit(width)).cast("bigint")
    rows = df.select(block.alias("block"), row_hash([key, *columns], 1).alias("a"), row_hash([key, *columns], 2).alias("b"))
    # Sums wrap inside 32 bits each, so they never overflow.
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    return rows.groupBy("block").agg(F.count("*").alias("cnt"), F.sum(low("a")).alias("sum_a"), F.sum(low("b")).alias("sum_b"), F.bit_xor("a").alias("xor_a"))


def coarser(fingerprints: DataFrame, times: int) -> DataFrame:
    """The next level: `times` neighbouring blocks as one. Fingerprints of a whole table are one block."""
    up = F.floor(F.col("block") / F.lit(times)).cast("bigint")
    return fingerprints.groupBy(up.alias("block")).agg(F.sum("cnt").alias("cnt"), F.sum("sum_a").alias("sum_a"), F.sum("sum_b").alias("sum_b"), F.bit_xor("xor_a").alias("xor_a"))


def _unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("block", F.struct(*MEASURES).alias("x")), b.select(F.col("block").alias("other"), F.struct(*MEASURES).alias("y"))
    both = left.join(right, F.col("block").eqNullSafe(F.col("other")), "full").filter(~F.col("x").eqNullSafe(F.col("y")))
    return both.select(F.coalesce("block", "other").alias("block"))


def differing_blocks(a: DataFrame, b: DataFrame, times: int = 1000) -> DataFrame:
    """Blocks whose fingerprints differ: first of coarse blocks, then of the blocks inside those that do."""
    coarse = _unequal(coarser(a, times), coarser(b, times))
    inside = lambda d: d.withColumn("_up", F.floor(F.col("block") / F.lit(times)).cast("bigint")).join(coarse.select(F.col("block").alias("_c")), F.col("_up").eqNullSafe(F.col("_c")), "left_semi").drop("_up")
    return _unequal(inside(a), inside(b))


def within_blocks(df: DataFrame, key: str, width: int, blocks: DataFrame, most_ranges: int) -> DataFrame:
    """Rows of these blocks. Up to `most_ranges` runs of neighbouring blocks become key bounds, which prune the scan; more are a join."""
    found = blocks.orderBy("block").limit(most_ranges + 1).collect()
    if len(found) > most_ranges:
        block = F.floor(F.col(key) / F.lit(width)).cast("bigint")
        return df.join(blocks.select(F.col("block").alias("_block")), block.eqNullSafe(F.col("_block")), "left_semi")
    cond = F.lit(False)
    for r in found:
        cond = cond | (F.col(key).isNull() if r.block is None else (F.col(key) >= F.lit(r.block * width)) & (F.col(key) < F.lit((r.block + 1) * width)))
    return df.filter(cond)


def block_diff(a: DataFrame, b: DataFrame, key: str, columns: list[str], width: int, known_a: DataFrame | None = None, known_b: DataFrame | None = None, most_ranges: int = 100) -> DataFrame:
    """Keys whose rows differ, as (key, state): only_left, only_right or changed; keys may repeat, rows count as a bag.

    Stored fingerprints (`known_a`, `known_b`) spare their table the full scan: then only the differing blocks of it are read.
    """
    fa = known_a if known_a is not None else block_fingerprints(a, key, columns, width)
    fb = known_b if known_b is not None else block_fingerprints(b, key, columns, width)
    blocks = differing_blocks(fa, fb)
    side = lambda d, n: within_blocks(d, key, width, blocks, most_ranges).groupBy(F.col(key).alias("key")).agg(
        F.struct(F.count("*").alias("n"), F.sum(row_hash(columns, 1).bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"), F.bit_xor(row_hash(columns, 2)).alias("x")).alias(n))
    left, right = side(a, "x"), side(b, "y").withColumnRenamed("key", "other")
    both = left.join(right, F.col("key").eqNullSafe(F.col("other")), "full").filter(~F.col("x").eqNullSafe(F.col("y")))
    state = F.when(F.col("y").isNull(), "only_left").when(F.col("x").isNull(), "only_right").otherwise("changed")
    return both.select(F.coalesce("key", "other").alias(key), state.alias("state"))
