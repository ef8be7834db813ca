"""Byte spans that occur earlier in the corpus: longest previous factors in suffix order, sharded by anchors.

A window is a string of `min_bytes` bytes inside one text. Its anchor is the least-hashed ANCHOR-byte string in it (the
first of equals), so equal windows have equal anchors. Neighbouring windows with one anchor form a run; the text under a
run is its string. Windows can only be equal under equal anchors, so:

1. every block of texts asks the shards which of its anchors occur elsewhere, too (8 bytes an anchor, compressed);
2. blocks send the strings of the shared anchors, equal ones once, to the shard of the anchor;
3. a shard sorts the suffixes of the strings under an anchor and reads their longest previous factors off the previous
   and the next smaller text position in suffix order: a factor of `min_bytes` is an earlier match;
4. blocks get a bit a window back and cut what the marked windows cover.

Texts travel compressed, twice, and no string is compared outside its anchor. An anchor with more than `hot` different strings
(a passage shared by many texts, each with other words around) is split: its runs are cut into stretches of STRETCH
windows, keyed by the bytes that all windows of a stretch share, which leaves few strings a key however many texts there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import mix, pieces, stage

ANCHOR = 37  # with windows of 100 bytes a run has at most 64 windows: one word of bits
STRETCH = 4
STEP = 1 << 19  # window starts worked on at a time
NO_ID = np.iinfo(np.int64).min
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 3)


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _hashes(buf: np.ndarray, n: int, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each of the first n positions: words of 8 bytes, the last one overlapping."""
    out = np.zeros(n, np.uint64)
    for k, at in enumerate([*range(0, size - 8, 8), size - 8]):
        word = np.ndarray((n,), "<u8", buf, at, (1,))
        out += word
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    return mix(out, 40)


def find_runs(buf: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the texts in `buf` that end at `ends`: first window, number of windows, place and hash of the anchor."""
    starts = np.concatenate(([0], ends[:-1]))
    grams = window - ANCHOR + 1  # anchors to choose from in a window
    long_ = ends - starts >= window
    lows, highs = starts[long_], ends[long_] - window + 1  # windows of a text: low <= p < high
    cuts = np.sort(np.concatenate((lows, highs)))
    out = []
    total = len(buf) - window + 1
    for s in range(0, max(total, 0), STEP):
        e = min(s + STEP, total)
        part = buf[s : e + window - 1]
        n = e - s + grams - 1
        h = _hashes(part, n, ANCHOR)
        key = (h & ~np.uint64(0xFFFFF)) | np.arange(n, dtype=np.uint64)
        span = 1
        while span * 2 <= grams:  # least of `span` keys from each place on
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < grams:
            key = np.minimum(key[: e - s], key[grams - span : grams - span + e - s])
        at = (key[: e - s] & np.uint64(0xFFFFF)).astype(np.int64)
        new = np.empty(e - s, bool)
        new[0] = True
        np.not_equal(at[1:], at[:-1], out=new[1:])
        new[cuts[(cuts >= s) & (cuts < e)] - s] = True
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, e - s))
        own = np.searchsorted(lows, first + s, "right") - 1
        inside = (own >= 0) & (first + s < (highs[own] if len(highs) else 0))
        first, count, place = first[inside], count[inside], at[first[inside]]
        out.append((first + s, count, place + s, h[place]))
    if not out:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    first, count, place, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return first, count, place, h


class Block:
    """Some texts in one buffer."""

    def __init__(self, row: dict, window: int):
        self.ids, self.ties, self.ends = (np.frombuffer(row[c], np.int64) for c in ("ids", "ties", "ends"))
        body = zstandard.decompress(row["body"])
        self.buf = np.frombuffer(body, np.uint8)
        self.bytes, self.window = body, window
        self.first, self.count, self.place, self.hash = find_runs(self.buf, self.ends, window)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different anchors, how many times each occurs, and the anchor of each run."""
        anchors, which, times = np.unique(self.hash, return_inverse=True, return_counts=True)
        return anchors, times, which

    def strings(self, answer: np.ndarray, which: np.ndarray):
        """Runs to compare as (key, first, windows): those of shared anchors; runs of hot anchors in stretches."""
        state = answer[which] if len(which) else np.empty(0, np.uint8)
        plain = state == 1
        key, first, count = [self.hash[plain]], [self.first[plain]], [self.count[plain]]
        hot = np.flatnonzero(state == 2)
        if len(hot):
            p = np.repeat(self.first[hot], self.count[hot])
            p += np.arange(len(p)) - np.repeat(np.cumsum(self.count[hot]) - self.count[hot], self.count[hot])
            owner = np.repeat(hot, self.count[hot])
            stretch = (self.place[owner] - p) // STRETCH
            new = np.append(True, (owner[1:] != owner[:-1]) | (stretch[1:] != stretch[:-1]))
            at = np.flatnonzero(new)
            core = self.place[owner[at]] - STRETCH * stretch[at]  # last window start of the stretch; its first window reaches from STRETCH - 1 before
            size = self.window - STRETCH + 1
            own = [xxhash.xxh3_64_intdigest(self.bytes[c : c + size], int(g)) for c, g in zip(core.tolist(), stretch[at], strict=True)]
            key.append(np.array(own, np.uint64))
            first.append(p[at])
            count.append(np.diff(np.append(at, len(p))))
        return np.concatenate(key), np.concatenate(first), np.concatenate(count)

    def order(self, first: np.ndarray) -> np.ndarray:
        """Rank of text positions: by id, then tie, then place in the block."""
        text = np.searchsorted(self.ends, first, "right")
        return np.lexsort((first, text, self.ties[text], self.ids[text]))

    def once(self, key: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Earliest run of each different string of a key (indexes), and of each run whether it is one."""
        seen, keep = set(), np.zeros(len(key), bool)
        last = (first + count + self.window - 1).tolist()
        begin, keys = first.tolist(), key.tolist()
        for i in self.order(first).tolist():
            string = (keys[i], self.bytes[begin[i] : last[i]])
            if string not in seen:
                seen.add(string)
                keep[i] = True
        return np.flatnonzero(keep), keep


def _blocks(most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in pieces(batches, 1 << 20, most_bytes):
            texts = b.column("body").to_pylist()
            ids = b.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            null = b.column("id").is_null().to_numpy(zero_copy_only=False)
            body = b"".join(x or b"" for x in texts)
            ties = np.array([xxhash.xxh3_64_intdigest(x or b"") for x in texts], np.uint64).view(np.int64)
            ends = np.cumsum([len(x or b"") for x in texts])
            row = [number, ids.astype(np.int64).tobytes(), null.tobytes(), ties.tobytes(), ends.astype(np.int64).tobytes(), zstandard.compress(body, 3), len(body)]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int64(), *[pa.binary()] * 5, pa.int64()), strict=True)], names=["block", "ids", "nulls", "ties", "ends", "body", "size"])
            number += 1

    return run


def _ask(window: int, shards: int):
    """Per block and shard: the block's different anchors there, and how many strings each may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                anchors, times, _ = Block(row, window).anchors()
                shard = (anchors % np.uint64(shards)).astype(np.int64)
                out = [(int(s), row["block"], _pack(anchors[shard == s]), _pack(times[shard == s].astype(np.uint32))) for s in np.unique(shard)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "block", "anchors", "times"])

    return run


def _shared(hot: int):
    """Per block of a shard: 0 for an anchor found once in all, 1 for a shared one, 2 for one with more than `hot` runs."""

    def run(rows: pa.Table) -> pa.Table:
        asked = [_unpack(x, np.uint64) for x in rows["anchors"].to_pylist()]
        times = [_unpack(x, np.uint32) for x in rows["times"].to_pylist()]
        _, which = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(which, np.concatenate(times).astype(np.float64))
        state = ((total > 1).astype(np.uint8) + (total > hot))[which]
        parts = np.split(state, np.cumsum([len(x) for x in asked])[:-1])
        return pa.table({"block": rows["block"], "shard": rows["shard"], "answer": pa.array([_pack(x) for x in parts], pa.binary())})

    return run


def _answers(row: dict, anchors: np.ndarray, shards: int) -> np.ndarray:
    """The shards' answers in the order of the block's anchors."""
    out = np.zeros(len(anchors), np.uint8)
    shard = (anchors % np.uint64(shards)).astype(np.int64)
    for r in row["answers"] or ():
        out[shard == r["shard"]] = _unpack(r["answer"], np.uint8)
    return out


FIELDS = [("keys", np.uint64), ("ids", np.int64), ("ties", np.int64), ("rows", np.int32), ("starts", np.int64), ("counts", np.uint8)]


def _send(window: int, shards: int):
    """Per block and shard: its different strings under shared anchors, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "block", *(n for n, _ in FIELDS), "strings"]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, window)
                anchors, _, which = block.anchors()
                key, first, count = block.strings(_answers(row, anchors, shards), which)
                own, _ = block.once(key, first, count)
                shard = (key[own] % np.uint64(shards)).astype(np.int64)
                out = []
                for s in np.unique(shard):
                    i = own[shard == s]
                    text = np.searchsorted(block.ends, first[i], "right")
                    values = (key[i], block.ids[text], block.ties[text], text, first[i], count[i])
                    strings = b"".join(block.bytes[a : a + c + window - 1] for a, c in zip(first[i].tolist(), count[i].tolist(), strict=True))
                    out.append((int(s), row["block"], *(_pack(v.astype(t)) for v, (_, t) in zip(values, FIELDS, strict=True)), zstandard.compress(strings, 3)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 7), strict=True)], names=names)

    return run


def suffix_ranks(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with `size` bytes left in their string, and the dense rank of these bytes among them, by doubling."""
    starts = np.concatenate(([0], ends[:-1]))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    rank = np.unique(np.ndarray((len(data),), ">u8", padded, 0, (1,)), return_inverse=True)[1]
    span = 8
    while span < size:
        step = min(span, size - span)  # the last round overlaps
        other = np.append(rank[step:], np.zeros(step, rank.dtype))
        rank = np.unique(rank.astype(np.uint64) << np.uint64(32) | other.astype(np.uint64), return_inverse=True)[1]
        span += step
    left = np.repeat(ends, ends - starts) - np.arange(len(data))
    places = np.flatnonzero(left >= size)
    return places, rank[places]


def previous_factors(rank: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Of suffixes with ranks by their first bytes and text positions: whether an earlier one starts with the same bytes.

    In suffix order the longest previous factor of a suffix is shared with the previous or the next smaller text position.
    Both are found by jumps along known smaller positions; only a neighbour of equal rank shares all the bytes.
    """
    n = len(rank)
    order = np.lexsort((position, rank))
    ranks, places = np.append(rank[order].astype(np.int64), -1), np.append(position[order], -1)
    found = np.zeros(n, bool)
    for step in (-1, 1):
        near = np.append(np.arange(n) + step, n)  # nearest place that may be smaller; n is none
        near[near < 0] = n
        open_ = np.arange(n)
        while len(open_):
            open_ = open_[ranks[near[open_]] == ranks[open_]]
            smaller = places[near[open_]] < places[open_]
            found[open_[smaller]] = True
            open_ = open_[~smaller]
            near[open_] = near[near[open_]]
    out = np.zeros(n, bool)
    out[order] = found
    return out


def _match(window: int, most_bytes: int):
    """Per block of a shard: a word of bits for each string sent, set where the window has an earlier match."""

    def run(rows: pa.Table) -> pa.Table:
        columns = {n: [_unpack(x, t) for x in rows[n].to_pylist()] for n, t in FIELDS}
        sizes = [len(x) for x in columns["keys"]]
        key, ids, ties, text, start, count = (np.concatenate(columns[n]) for n, _ in FIELDS)
        block = np.repeat(rows["block"].to_numpy(), sizes)
        order = np.lexsort((start, text, block, ties, ids, key))  # strings of a key together, earliest first
        length = count.astype(np.int64) + window - 1
        body = b"".join(zstandard.decompress(x) for x in rows["strings"].to_pylist())
        ends = np.cumsum(length)
        marks = np.zeros(len(key), np.uint64)
        edges = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        held, size = [], 0  # strings to sort, whole keys at a time
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            if b - a == 1:
                continue
            seen, own = set(), []
            for i in order[a:b].tolist():
                string = body[ends[i] - length[i] : ends[i]]
                if string in seen:
                    marks[i] = ONES
                else:
                    seen.add(string)
                    own.append(i)
            if len(own) > 1:
                held.append(own)
                size += int(length[own].sum())
            if size > most_bytes:
                _mark(held, body, ends, length, window, marks)
                held, size = [], 0
        _mark(held, body, ends, length, window, marks)
        parts = np.split(marks, np.cumsum(sizes)[:-1])
        return pa.table({"block": rows["block"], "shard": rows["shard"], "answer": pa.array([_pack(x) for x in parts], pa.binary())})

    return run


def _mark(groups: list[list[int]], body: bytes, ends: np.ndarray, length: np.ndarray, window: int, marks: np.ndarray) -> None:
    """Set the bits of windows with an earlier match; strings of a group come in the order of their texts."""
    if not groups:
        return
    own = np.array([i for g in groups for i in g])
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    data = np.frombuffer(b"".join(body[ends[i] - length[i] : ends[i]] for i in own.tolist()), np.uint8)
    stops = np.cumsum(length[own])
    places, rank = suffix_ranks(data, stops, window)
    string = np.searchsorted(stops, places, "right")
    offset = places - (stops - length[own])[string]
    both = np.unique(rank.astype(np.uint64) << np.uint64(32) | group[string].astype(np.uint64), return_inverse=True)[1]
    hit = previous_factors(both, places)
    np.bitwise_or.at(marks, own[string[hit]], np.uint64(1) << offset[hit].astype(np.uint64))


def _cut(window: int, shards: int):
    """Texts without what marked windows cover."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept", "span_starts", "span_lengths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, window)
                anchors, _, which = block.anchors()
                key, first, count = block.strings(_answers(row, anchors, shards), which)
                own, sent = block.once(key, first, count)
                marks = np.full(len(key), ONES)
                shard = (key[own] % np.uint64(shards)).astype(np.int64)
                for r in row["marks"] or ():
                    marks[own[shard == r["shard"]]] = _unpack(r["answer"], np.uint64)
                change = np.zeros(len(block.buf) + 1, np.int32)
                whole = marks == ONES
                np.add.at(change, first[whole], 1)
                np.add.at(change, (first + count + window - 1)[whole], -1)
                some = np.flatnonzero(~whole & (marks != 0))
                bits = (marks[some, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) == 1
                at, offset = np.nonzero(bits)
                p = first[some[at]] + offset
                np.add.at(change, p, 1)
                np.add.at(change, p + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                ids, null = block.ids.tolist(), np.frombuffer(row["nulls"], bool)
                out, size, low = [], 0, 0
                for i, high in enumerate(block.ends.tolist()):
                    mine = gone[low:high]
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
                    kept = block.bytes[low:high] if not len(edge) else block.buf[low:high][~mine].tobytes()
                    starts, stops = edge[::2], edge[1::2]
                    out.append((None if null[i] else ids[i], high - low, int(mine.sum()), len(starts), kept, starts.tolist(), (stops - starts).tolist()))
                    low, size = high, size + len(kept)
                    if size > 1 << 22:
                        yield _table(out, kinds, names)
                        out, size = [], 0
                if out:
                    yield _table(out, kinds, names)

    return run


def _table(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 100, hot: int = 4096, block_bytes: int = 4 << 20, shard_bytes: int = 16 << 20) -> DataFrame:
    """Remove every byte covered by a string of `min_bytes` bytes that also starts earlier in the corpus.

    A row per input row: (id, n_bytes, n_removed, n_spans, kept binary, span_starts, span_lengths); spans are the maximal removed
    runs, in bytes of the UTF-8 text. Earlier is a smaller id, or an earlier start in the same text; matches may overlap each other,
    never cross texts, and are judged on the input. `min_bytes` is 45 to 100.

    Null text is empty; texts shorter than `min_bytes` stay whole. Rows with a null id come before all others, and rows that share an
    id count as texts of their own; both follow in the order of a hash of the text, equal ones in the order of storage. Ids are
    whole numbers. Other columns are ignored. An empty table gives no rows.

    `block_bytes` is about the text of a block, `shard_bytes` the text behind a shard: the number of shards grows with the corpus.
    Anchors with more than `hot` runs are split by the bytes around them. None of the three changes a result.
    """
    if not ANCHOR + 8 <= min_bytes <= ANCHOR + 63:
        raise ValueError(f"min_bytes must be between {ANCHOR + 8} and {ANCHOR + 63}")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    blocks = stage(texts.mapInArrow(_blocks(block_bytes), "block long, ids binary, nulls binary, ties binary, ends binary, body binary, size long"), "blocks")
    shards = max(1, -(-(blocks.agg(F.sum("size")).first()[0] or 0) // shard_bytes))
    asked = blocks.mapInArrow(_ask(min_bytes, shards), "shard long, block long, anchors binary, times binary")
    back = "block long, shard long, answer binary"
    shared = asked.groupBy("shard").applyInArrow(_shared(hot), back)
    answers = stage(shared.groupBy("block").agg(F.collect_list(F.struct("shard", "answer")).alias("answers")), "shared-anchors")
    known = blocks.join(answers.hint("merge"), "block", "left")
    sent = known.mapInArrow(_send(min_bytes, shards), "shard long, block long, " + ", ".join(f"{n} binary" for n, _ in FIELDS) + ", strings binary")
    matched = sent.groupBy("shard").applyInArrow(_match(min_bytes, 1 << 22), back)
    marks = stage(matched.groupBy("block").agg(F.collect_list(F.struct("shard", "answer")).alias("marks")), "earlier-matches")
    done = known.join(marks.hint("merge"), "block", "left")
    return done.mapInArrow(_cut(min_bytes, shards), "id long, n_bytes long, n_removed long, n_spans long, kept binary, span_starts array<long>, span_lengths array<long>").withColumnRenamed("id", id_col)
