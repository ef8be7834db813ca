"""Best-fit packing of token sequences in a tree of partitions."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import pieces, stage

ITEMS_PER_TASK = 16_384
PIECE = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _tokenize(tokenizer: str, capacity: int, end_id: int):
    """Documents to pieces. The vocabulary file is the one of the library `tokenizers`; its exact split and merges run in tiktoken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewatch.llm.tokens import fast_byte_encoder

        encode = fast_byte_encoder(tokenizer)
        uid = TaskContext.get().partitionId() << 40
        for b in pieces(batches, 500):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(np.asarray(encode(text or ""), dtype="<u4"), np.uint32(end_id)).astype("<u4")
                cut = len(ids) % capacity if len(ids) > capacity else len(ids)
                starts = [*([0] if cut else []), *range(cut, len(ids), capacity)]
                for k, (i, j) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    out.append((uid, doc, k, i, j - i, zlib.crc32(ids[i:j].tobytes())))
                    uid += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: positions by bin. Open bins are kept by free space, so an item costs O(log capacity)."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}
    spaces: list[int] = []  # sorted distinct free spaces that occur
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect_left(spaces, n)
        if at < len(spaces):
            space = spaces[at]
            k = free[space].pop()
            if not free[space]:
                spaces.pop(at)
        else:
            space, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        left = space - n
        if left:
            if not free.setdefault(left, []):
                spaces.insert(bisect_left(spaces, left), left)
            free[left].append(k)
    return bins


def _pack(capacity: int, nearly: int):
    """One task of a round: items (groups of pieces packed before) into bins; a bin is done when at most `nearly` tokens are free."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fill", "first"])
        members, fills, firsts = rows["members"].tolist(), rows["fill"].tolist(), rows["first"].tolist()
        out = []
        for own in best_fit(fills, capacity):
            fill = sum(fills[i] for i in own)
            out.append((min(firsts[i] for i in own), fill, capacity - fill <= nearly, len(own), [m for i in own for m in members[i]]))
        return pd.DataFrame(out, columns=["first", "fill", "done", "merged", "members"])

    return run


def pack(lengths: DataFrame, capacity: int, nearly: int = 0, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """(uid, length) with 1 <= length <= capacity to (uid, sequence_id, offset).

    Round 1 packs partitions of about `items_per_task` pieces by best fit. Bins with at most `nearly` free tokens are
    emitted; each underfull bin goes on as one item, into a tree of fewer and fewer partitions, until one is left. If
    a round of several partitions merges less than a hundredth of its items (they don't fit each other), the rest is emitted as it is: a larger
    task would not help, and none ever holds more than its share. A bin is named by the smallest uid in it.
    """
    out_schema = "first long, fill long, done boolean, merged long, members array<struct<uid: long, length: long>>"
    whole = lengths.where(F.col("length") >= capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = lengths.where(F.col("length") < capacity).select(F.col("uid").alias("first"), F.col("length").alias("fill"), F.array(F.struct("uid", "length")).alias("members"))
    packed, level, count = [], 0, items.count()
    while count:
        tasks = -(-count // items_per_task)
        grouped = items.withColumn("task", F.pmod(F.xxhash64(F.col("first"), F.lit(level)), F.lit(tasks)))
        done = stage(grouped.groupBy("task").applyInPandas(_pack(capacity, nearly), out_schema), "packing-round")
        rest = done.where("not done")
        left = rest.count()
        stuck = left > 0.99 * count
        packed.append(done if tasks == 1 or stuck else done.where("done"))
        if tasks == 1 or stuck:
            break
        items, count, level = rest.select("first", "fill", "members"), left, level + 1
    for bins in packed:
        placed = bins.select(F.col("first").alias("sequence_id"), F.posexplode("members").alias("at", "m"), "members")
        before = F.aggregate(F.slice("members", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, m: a + m["length"])
        whole = whole.union(placed.select("m.uid", "sequence_id", before.alias("offset")))
    return whole


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces and their places: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its ids and `end_id`. Only a document longer than `capacity` is cut, into pieces of `capacity` tokens, the first
    one shorter. Null or empty text is the end id alone. Rows repeating an id, and null ids, are documents of
    their own. Extra columns are ignored. `tokenizer` is the path of a byte-level vocabulary, readable on all executors.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = stage(docs.mapInArrow(_tokenize(tokenizer, capacity, end_id), PIECE), "pieces")
    places = pack(cut.select("uid", "length"), capacity)
    return cut.join(places, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
