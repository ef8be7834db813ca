"""Repeated lines: minimal perfect hash over line hashes, probed by the documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import mix, pieces, stage

BLANKS = " \t\n\v\f\r"
KEYS_PER_SHARD = 50_000
LOAD = 2.0  # slots per open key and level of the hash


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, as levels of bits.

    Each level maps the keys still open to LOAD slots a key; keys alone in their slot are placed there and the others go
    to the next level. The index of a key is the number of placed keys before it. Foreign keys get -1 or some index.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(bits).astype(np.int64) for bits in levels]
        ends = np.cumsum([0, *(c.sum() for c in counts)])
        self.ranks = [ends[i] + np.concatenate(([0], np.cumsum(c)[:-1])) for i, c in enumerate(counts)]

    @staticmethod
    def slots(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return mix(keys, 16 + level) % np.uint64(64 * words)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            words = int(len(keys) * LOAD) // 64 + 1
            at = cls.slots(keys, len(levels), words).astype(np.int64)
            alone = np.bincount(at, minlength=64 * words)[at] == 1
            bits = np.zeros(64 * words, np.uint8)
            bits[at[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little").view(np.uint64))
            keys = keys[~alone]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self.slots(keys[open_], level, len(bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = ranks[word[hit]] + np.bitwise_count(below)
            open_ = open_[~hit]
        return out


class LineIndex:
    """One shard: the perfect hash, and by its index a fingerprint, the number of documents and the keeping document."""

    def __init__(self, row):
        sizes = np.frombuffer(row["sizes"], np.int64)
        bits = np.frombuffer(row["bits"], np.uint64)
        self.hash = PerfectHash(np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        self.prints = np.frombuffer(row["prints"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.int64)
        self.keepers = np.frombuffer(row["keepers"], np.int64)

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count and keeper for each key; count 0 where the fingerprint says that the line isn't indexed."""
        at = self.hash.find(keys)
        known = at >= 0
        known[known] = self.prints[at[known]] == prints[known]
        at = np.where(known, at, 0)
        if not len(self.counts):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        return np.where(known, self.counts[at], 0), self.keepers[at]


def line_keys(text: str | None, min_chars: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lines of a text, which of them have a key, and the keys' 128-bit hashes as pairs."""
    lines = (text or "").split("\n")
    at, hashes = [], []
    for i, line in enumerate(lines):
        key = line.strip(BLANKS)
        if len(key) >= min_chars:
            at.append(i)
            hashes.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()))
    return lines, np.array(at, np.int64), np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)


def _hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2000):
            ids, keys = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if doc is not None:
                    own = np.unique(line_keys(text, min_chars)[2], axis=0)
                    keys.append(own)
                    ids.append(np.full(len(own), doc, np.int64))
            if ids:
                k = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(np.concatenate(ids))], names=["h", "f", "doc_id"])

    return run


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates("h")  # equal 64-bit keys of two lines (one chance in 2^64 a pair) would never part
    keys = rows["h"].to_numpy(np.int64).view(np.uint64)
    perfect = PerfectHash.build(keys)
    order = np.empty(len(keys), np.int64)
    order[perfect.find(keys)] = np.arange(len(keys))
    packed = {c: np.ascontiguousarray(rows[c].to_numpy(np.int64)[order]).tobytes() for c in ("f", "n", "keeper")}
    return pd.DataFrame([{
        "shard": int(rows["shard"].iloc[0]), "sizes": np.array([len(x) for x in perfect.levels], np.int64).tobytes(),
        "bits": np.concatenate(perfect.levels).tobytes(), "prints": packed["f"], "counts": packed["n"], "keepers": packed["keeper"],
    }])


def line_index(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, int]:
    """Index shards, a row each, over the hashes of lines found in at least `min_docs` documents; and the shard count.

    Rarer lines never count, and a probe for one misses by its 64-bit fingerprint. Shards are cut by hash to about
    KEYS_PER_SHARD keys whatever the size of the corpus.
    """
    found = docs.mapInArrow(_hashes(min_chars), "h long, f long, doc_id long")
    lines = found.groupBy("h", "f").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    lines = stage(lines, "repeated-lines")
    total = lines.count()
    shards = max(1, -(-total // KEYS_PER_SHARD))
    sharded = lines.withColumn("shard", F.pmod(F.shiftright("h", 8), F.lit(shards)))
    index = sharded.groupBy("shard").applyInPandas(_build, "shard long, sizes binary, bits binary, prints binary, counts binary, keepers binary")
    return stage(index, "line-index"), shards


def _without(text: str | None, drop: np.ndarray, lines: list[str]) -> tuple[str, int, int]:
    if not len(drop):
        return text or "", len(lines), 0
    gone = set(drop.tolist())
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def _out(b: pa.RecordBatch, rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    carried = [c for c in b.schema.names if c.startswith("carry_")]
    text, lines, dropped = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), *(b.column(c) for c in carried)], names=["doc_id", "text", "n_lines", "n_dropped", *carried])


def _probe_all(parts, shards: int, min_chars: int):
    """Documents against the whole index, held by every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {row["shard"]: LineIndex(row) for row in parts.value}
        for b in pieces(batches, 1000):
            docs = b.column("doc_id").to_pylist()
            found = [line_keys(text, min_chars) for text in b.column("text").to_pylist()]
            keys = np.concatenate([x[2] for x in found]) if found else np.empty((0, 2), np.uint64)
            owner = np.repeat(np.array([x or 0 for x in docs], np.int64), [len(x[1]) for x in found])
            drop = np.zeros(len(keys), bool)
            shard = np.mod(keys[:, 0].view(np.int64) >> 8, shards)
            for k in np.unique(shard):
                if k in index:
                    mine = np.flatnonzero(shard == k)
                    count, keeper = index[k].probe(keys[mine, 0], keys[mine, 1])
                    drop[mine] = (count > 0) & (keeper != owner[mine])
            ends = np.cumsum([0, *(len(x[1]) for x in found)])
            rows = [_without(text, at[drop[ends[i] : ends[i + 1]]] if docs[i] is not None else at[:0], lines) for i, ((lines, at, _), text) in enumerate(zip(found, b.column("text").to_pylist(), strict=True))]
            yield _out(b, rows)

    return run


def _requests(shards: int, min_chars: int):
    """Per document and shard: its keys there, packed, and their line numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1000):
            out = []
            for doc, text, version in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("version").to_pylist(), strict=True):
                if doc is None:
                    continue
                _, at, keys = line_keys(text, min_chars)
                shard = np.mod(keys[:, 0].view(np.int64) >> 8, shards)
                out += [(int(k), doc, version, keys[shard == k].tobytes(), at[shard == k].tobytes()) for k in np.unique(shard)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "doc_id", "version", "keys", "at"])

    return run


def _probe_shard(wanted: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(index):
        shard = LineIndex(index.iloc[0])
        for doc, version, keys, at in zip(wanted["doc_id"], wanted["version"], wanted["keys"], wanted["at"], strict=True):
            pairs = np.frombuffer(keys, np.uint64).reshape(-1, 2)
            count, keeper = shard.probe(pairs[:, 0], pairs[:, 1])
            gone = (count > 0) & (keeper != doc)
            if gone.any():
                out.append((doc, version, np.frombuffer(at, np.int64)[gone].tolist()))
    return pd.DataFrame(out, columns=["doc_id", "version", "gone"])


def _drop_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 1000):
        rows = [_without(text, np.array(sorted({i for part in gone or () for i in part}), np.int64), (text or "").split("\n")) for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True)]
        yield _out(b, rows)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, share_mb: float = 32, docs_per_probe: int = 20_000, carry: list[str] = ()) -> DataFrame:
    """Drop lines repeated across documents: (doc_id, text, n_lines, n_dropped, then the columns in `carry`), a row per input row.

    A line's key is the line without blanks at its ends, A-Z lower-cased. A key of at least `min_chars` code points
    found in at least `min_docs` rows stays only in the largest id holding it. Documents never join lines: they probe
    the arrays behind a perfect hash of the repeated lines. An index of up to `share_mb` is sent to every task;
    a larger one stays in shards, to which each document sends its packed keys, at most `docs_per_probe` documents (about)
    to one task, and only the numbers of dropped lines come back. Both give the same rows.

    Null or empty text is one empty line. Each row counts as a document, so rows repeating an id keep that id's
    lines. Rows with a null id count nowhere and keep all lines. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    own = "".join(f", carry_{i} {docs.schema[f'carry_{i}'].dataType.simpleString()}" for i in range(len(carry)))
    schema, back = f"doc_id long, text string, n_lines long, n_dropped long{own}", {f"carry_{i}": c for i, c in enumerate(carry)}
    index, shards = line_index(docs.select("doc_id", "text"), min_chars, min_docs)
    size = sum((F.length(c) for c in ("sizes", "bits", "prints", "counts", "keepers")), F.lit(0))
    if (index.agg(F.sum(size)).first()[0] or 0) <= share_mb * 1e6:
        parts = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in index.collect()])
        return docs.mapInArrow(_probe_all(parts, shards, min_chars), schema).withColumnsRenamed(back)
    versions = docs.withColumn("version", F.xxhash64("text"))
    wanted = versions.select("doc_id", "text", "version").mapInArrow(_requests(shards, min_chars), "shard long, doc_id long, version long, keys binary, at binary")
    wanted = stage(wanted, "line-requests")
    salts = wanted.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(docs_per_probe)).alias("salts"))
    wanted = wanted.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "version"), F.col("salts"))).drop("salts")
    spread = index.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    gone = wanted.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(_probe_shard, "doc_id long, version long, gone array<long>")
    gone = gone.groupBy("doc_id", "version").agg(F.collect_list("gone").alias("gone"))
    joined = versions.join(gone, ["doc_id", "version"], "left").select("doc_id", "text", "gone", *back)
    return joined.mapInArrow(_drop_listed, schema).withColumnsRenamed(back)
