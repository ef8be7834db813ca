"""Near-duplicate vectors: epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm.common import stage
from tidewatch.llm.graph import components
from tidewatch.llm.vectors import matrix, one_row_per_id, usable, usual_length
from tidewatch.session import freed_shuffles, scratch_dir

FAN = 4  # children of an interval of the sequence
TILE = 8  # blocks to a side of a task's square, at least
SIDE_BYTES = 16 << 20  # of the vectors of a side, in double precision; more only if TILE blocks have more


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def packed(x: np.ndarray) -> list[bytes]:
    """A binary for each vector, equal ones for equal vectors: single precision where that holds every component exactly, else double."""
    x = x + 0.0  # no negative zeros
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    short = (single == x).all(1)
    return [(a if s else b).tobytes() for a, b, s in zip(single, x, short, strict=True)]


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    """Vectors out of their binaries, in double precision."""
    short = np.array([len(r) == 4 * dim for r in rows], bool)
    out = np.empty((len(rows), dim))
    out[short] = np.frombuffer(b"".join(r for r, s in zip(rows, short, strict=True) if s), np.float32).reshape(-1, dim)
    out[~short] = np.frombuffer(b"".join(r for r, s in zip(rows, short, strict=True) if not s), np.float64).reshape(-1, dim)
    return out


def _staged(df: DataFrame, name: str) -> DataFrame:
    with freed_shuffles(df.sparkSession):
        return stage(df, name)


def principal_axes(vectors: DataFrame, dim: int, keep: int) -> np.ndarray:
    """The directions in which the unit vectors of packed ones (v) spread most, from sums over all rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, n = np.zeros((dim, dim)), np.zeros(dim), 0
        for b in batches:
            if b.num_rows:
                u = _units(unpacked(b.column("v").to_pylist(), dim))
                total, first, n = total + u.T @ u, first + u.sum(0), n + len(u)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16]), pa.array([np.concatenate([total.ravel(), first, [n]]).tobytes()])], names=["slot", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slot": rows["slot"].iloc[:1], "sums": [np.sum([np.frombuffer(x) for x in rows["sums"]], axis=0).tobytes()]})

    slots = vectors.select("v").mapInArrow(sums, "slot long, sums binary").groupBy("slot").applyInPandas(add, "slot long, sums binary").collect()
    s = np.sum([np.frombuffer(r["sums"]) for r in slots], axis=0)
    n, mean = s[-1], s[dim * dim : -1] / s[-1]
    _, axes = np.linalg.eigh(s[: dim * dim].reshape(dim, dim) / n - np.outer(mean, mean))
    return axes[:, ::-1][:, :keep]


def _join_blocks(a: np.ndarray, b: np.ndarray, same: bool, cosine: float) -> np.ndarray:
    linked = a @ b.T >= cosine
    if same:
        np.fill_diagonal(linked, False)
    return linked


def _spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges to the smallest id of each connected part of a link matrix, instead of all its links."""
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(rows):
        return []
    m, x, y = linked[np.ix_(rows, cols)], left[rows].copy(), right[cols].copy()
    top = np.iinfo(np.int64).max
    while True:
        x2 = np.minimum(x, np.where(m, y[None, :], top).min(1))
        y2 = np.minimum(y, np.where(m, x2[:, None], top).min(0))
        if (x2 == x).all() and (y2 == y).all():
            break
        x, y = x2, y2
    edges = {(int(v), int(k)) for v, k in zip(np.concatenate((left[rows], right[cols])), np.concatenate((x, y)), strict=True) if v != k}
    return list(edges)


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 512, leading: int = 16, grid_axes: int = 8, round_bytes: int = 128 << 20) -> DataFrame:
    """Links of cosine >= `cosine` (double precision) and their groups: (vec_id, n_links, component_id, kept), a row per id.

    Unit vectors of that cosine lie within epsilon = sqrt(2 - 2 cosine). Equal vectors are one class. Classes are sorted by
    their epsilon grid cells on the `grid_axes` leading principal axes (ties by id) and cut into blocks; blocks form a tree
    of intervals of that sequence with bounding boxes on `leading` axes. Starting with the whole sequence, pairs of
    intervals are split further unless their boxes are provably more than epsilon apart. Block pairs left are
    compared in square tiles of blocks, each block sent once to a tile. A comparison returns link counts and the edges of a
    spanning forest, never the pairs of a dense group.

    What tiles are sent grows with the square of the vectors, so they take turns: a round sends blocks of at most `round_bytes`, or of
    the size of all blocks if that is more, and its shuffle files go before the next one starts. Vectors are written twice (as classes and in
    blocks), packed to single precision where it is exact.

    Null vectors, zero vectors, ones with null or non-finite components and ones of another than the usual length link
    with nothing. Null ids come back with null results. Of rows repeating an id the greatest vector counts. Extra columns
    are ignored.
    """
    spark = vectors.sparkSession
    rows = one_row_per_id(vectors, id_col, vector_col)
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    dim = usual_length(good)
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if dim is None:
        return alone

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(packed(matrix(b.column("v"))), pa.binary())], names=["vec_id", "v"])

    good = good.where(F.size("v") == dim).mapInArrow(pack, "vec_id long, v binary")
    classes = _staged(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "vector-classes")
    epsilon2 = max(2 - 2 * cosine, 0.0) + 1e-9
    axes = principal_axes(classes, dim, min(leading, dim))
    cells = min(grid_axes, axes.shape[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = _units(unpacked(b.column("v").to_pylist(), dim)) @ axes[:, :cells]
                grid = np.floor(p / np.sqrt(epsilon2)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(grid[:, k]) for k in range(cells))], names=[*b.schema.names, *(f"c{k}" for k in range(cells))])

    grid = [f"c{k}" for k in range(cells)]
    placed = classes.select("rep", "weight", "v").mapInArrow(place, "rep long, weight long, v binary, " + ", ".join(f"{c} long" for c in grid))
    parts = max(1, -(-classes.count() // (8 * block_rows)))

    def block(rows: pa.Table, part: int, k: int) -> pa.RecordBatch:
        x = unpacked(rows["v"].to_pylist(), dim)
        p = _units(x) @ axes
        single = x.astype(np.float32) if all(len(v) == 4 * dim for v in rows["v"].to_pylist()) else x
        ids, weights = (rows[c].to_numpy().astype(np.int64).tobytes() for c in ("rep", "weight"))
        return pa.RecordBatch.from_pylist([{"part": part, "k": k, "ids": ids, "weights": weights, "vectors": single.tobytes(), "lo": p.min(0).tolist(), "hi": p.max(0).tolist()}])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a part, in order, as blocks; the last one may be shorter."""
        part, k, held, n = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, block_rows - n))
                n += held[-1].num_rows
                b = b.slice(held[-1].num_rows)
                if n == block_rows:
                    yield block(pa.Table.from_batches(held), part, k)
                    k, held, n = k + 1, [], 0
        if held:
            yield block(pa.Table.from_batches(held), part, k)

    order = placed.repartitionByRange(parts, *grid, "rep").sortWithinPartitions(*grid, "rep").select("rep", "weight", "v")
    blocks = _staged(order.mapInArrow(cut, "part long, k long, ids binary, weights binary, vectors binary, lo array<double>, hi array<double>"), "grid-blocks")
    # A row per part, so a running sum in one task; the blocks stay where they are.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    blocks = blocks.join(F.broadcast(_staged(offsets, "grid-parts")), "part").withColumn("block", F.col("before") + F.col("k")).drop("part", "k", "before")
    count, all_bytes = blocks.agg(F.count("*"), F.sum(F.octet_length("vectors") + F.octet_length("ids") + F.octet_length("weights"))).first()
    pairs = _block_pairs(blocks.select("block", "lo", "hi"), count, epsilon2, axes.shape[1])

    def compare(pairs: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for r in blocks.itertuples():
            ids = np.frombuffer(r.ids, np.int64)
            x = np.frombuffer(r.vectors, np.float32 if len(r.vectors) == 4 * dim * len(ids) else np.float64)
            held[r.block] = (ids, np.frombuffer(r.weights, np.int64), _units(x.reshape(len(ids), dim).astype(np.float64)))
        degree: dict[int, np.ndarray] = {}
        edges: set[tuple[int, int]] = set()
        for i, j in zip(pairs["i"], pairs["j"], strict=True):
            (left, wl, a), (right, wr, b) = held[i], held[j]
            linked = _join_blocks(a, b, i == j, cosine)
            if linked.any():
                degree[i] = degree.get(i, 0) + linked @ wr
                if i != j:
                    degree[j] = degree.get(j, 0) + wl @ linked
                edges.update(_spanning(linked, left, right))
        out = [(int(v), None, int(n)) for k, counts in degree.items() for v, n in zip(held[k][0], counts, strict=True) if n]
        return pd.DataFrame(out + [(a, b, 0) for a, b in edges], columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    # Larger tiles send a block less often: as large as SIDE_BYTES allows, while there are many more of them than cores, over all and in a round.
    cores = spark.sparkContext.defaultParallelism
    copies = max(1, max(round_bytes, all_bytes) * count // max(1, all_bytes))
    side = max(TILE, min(SIDE_BYTES // (8 * dim * block_rows), int(count / math.sqrt(16 * cores)), copies // (8 * cores)))
    tiled = pairs.select("i", "j", F.floor(F.col("i") / side).alias("ti"), F.floor(F.col("j") / side).alias("tj"))
    needed = _staged(tiled.select("ti", "tj", "i").union(tiled.select("ti", "tj", "j")).distinct().toDF("si", "sj", "block"), "grid-needed")
    # A row per tile, numbered in one task by what the tiles before it are sent.
    sent_before = F.sum("copies").over(Window.orderBy("ti", "tj").rowsBetween(Window.unboundedPreceding, -1))
    tiles = needed.groupBy(F.col("si").alias("ti"), F.col("sj").alias("tj")).agg(F.count("*").alias("copies"))
    tiles = _staged(tiles.withColumn("turn", F.floor(F.coalesce(sent_before, F.lit(0)) / copies)), "grid-tiles")
    links = scratch_dir(spark, "vector-links")
    for turn in sorted(r["turn"] for r in tiles.select("turn").distinct().collect()):
        mine = F.broadcast(tiles.where(F.col("turn") == turn).select("ti", "tj"))
        wanted = needed.join(mine, (F.col("si") == F.col("ti")) & (F.col("sj") == F.col("tj"))).select("si", "sj", "block")
        sent = blocks.select("block", "ids", "weights", "vectors").join(F.broadcast(wanted), "block")
        found = tiled.join(mine, ["ti", "tj"]).groupBy("ti", "tj").cogroup(sent.groupBy("si", "sj")).applyInPandas(compare, "a long, b long, n long")
        with freed_shuffles(spark):
            found.write.parquet(f"{links}/turn={turn}")
    found = spark.read.schema("a long, b long, n long").parquet(links)

    degrees = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    with freed_shuffles(spark):
        groups = components(found.where("b is not null").select("a", "b"), "vector-components")
    # Members of a class find it by a digest, so that no vector travels once more.
    digest = F.unhex(F.sha2("v", 256)).alias("digest")
    several = classes.where("weight > 1").select(digest, "rep", "weight")
    named = good.select("vec_id", digest).join(several, "digest", "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("weight", F.lit(1)).alias("weight"))
    named = named.join(degrees, "rep", "left").join(groups.toDF("rep", "component"), "rep", "left")
    own = named.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = alone.select("vec_id").join(own, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _block_pairs(boxes: DataFrame, count: int, epsilon2: float, axes: int) -> DataFrame:
    """Pairs i <= j of blocks whose boxes may hold vectors within epsilon, by descent through the tree of intervals."""
    levels = [boxes.select(F.col("block").alias("k"), "lo", "hi")]
    while count > 1:
        up = levels[-1].groupBy(F.floor(F.col("k") / FAN).alias("k"))
        parent = up.agg(*(F.min(F.col("lo")[d]).alias(f"l{d}") for d in range(axes)), *(F.max(F.col("hi")[d]).alias(f"h{d}") for d in range(axes)))
        levels.append(_staged(parent.select("k", F.array(*(f"l{d}" for d in range(axes))).alias("lo"), F.array(*(f"h{d}" for d in range(axes))).alias("hi")), "grid-boxes"))
        count = -(-count // FAN)
    pairs = levels[-1].select(F.col("k").alias("i"), F.col("k").alias("j"))
    for boxes in reversed(levels[:-1]):
        children = F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda c: c.cast("long"))
        pairs = pairs.withColumn("a", F.explode(children)).withColumn("b", F.explode(children)).select((F.col("i") * FAN + F.col("a")).alias("i"), (F.col("j") * FAN + F.col("b")).alias("j")).where("i <= j")
        both = pairs.join(boxes.toDF("i", "li", "hi_"), "i").join(boxes.toDF("j", "lj", "hj"), "j")
        gap = [F.greatest(F.col("li")[d] - F.col("hj")[d], F.col("lj")[d] - F.col("hi_")[d], F.lit(0.0)) for d in range(axes)]
        pairs = _staged(both.where(sum((g * g for g in gap), F.lit(0.0)) <= epsilon2).select("i", "j"), "grid-pairs")
    return pairs
