"""Near-duplicate texts: parity-sketch join over word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import WORD_ODD, ascii_words, compact, mix, pieces, small, stage
from tidewatch.llm.graph import components

SHINGLE = 5
SKETCH_WORDS = 8  # 512 bits
TOKENS_PER_PART = 2.2
STRETCH = 2000  # texts
PROPOSERS = 16
COMMON_SHARE = 0.0005  # a token in this share of all texts counts as common; so there are at most (mean set size / share) of them


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of a text; fewer words than `width` make one shingle."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(words))
    n = len(words) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out += h[i : i + n] * (WORD_ODD[i % len(WORD_ODD)] + np.uint64(2 * (i // len(WORD_ODD))))
    return np.unique(mix(out))


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Each token flips one bit of 512; two sketches differ in at most as many bits as the sets differ in tokens."""
    bits = np.bincount((tokens & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_sketch(tokens: np.ndarray) -> bytes:
    """A parity sketch of two to four bits per token; sketches of neighbouring bands are compared by folding the longer one."""
    bits = max(64, 1 << (len(tokens).bit_length() + 1))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def most_different(n: int, partner: int) -> int:
    """Largest symmetric difference of sets of these sizes with Jaccard of at least 3/4: (n + partner) / 7."""
    return (n + partner) // 7


def _least(keys: np.ndarray, n: int) -> np.ndarray:
    return np.partition(keys, n - 1)[:n] if len(keys) > n else keys


def signatures(tokens: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
    """Pigeonhole keys of one set.

    Sizes fall into bands [2^k, 2^(k+1)). A band cuts the parity sketch into parts; a part is kept as the XOR of the
    64-bit hashes of its tokens, so parts are equal exactly where the token parities are (but for chance, which
    verification removes). Sets that differ in d tokens differ in at most d parts: with all parts in one global order,
    the first d + 1 of two such sets share one. The order is by hash, but parts made of `common` tokens only (sorted
    hashes; any set of them is right) come after the others and empty parts last, so that passages shared by many
    texts rarely make a key. A set that may have a partner in the next band is keyed there too.
    """
    n = len(tokens)
    if n == 0:
        return np.empty(0, np.int64)
    band = n.bit_length() - 1
    largest = 4 * n // 3
    plans = [(band, most_different(n, min(largest, 2 ** (band + 1) - 1)))]
    if largest >= 2 ** (band + 1):
        plans.append((band + 1, most_different(n, largest)))
    known = np.zeros(n, bool)
    if common is not None and len(common):
        known = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens
    out = []
    for k, d in plans:
        parts = max(1, round(2 ** (k + 1) / TOKENS_PER_PART))
        own = (tokens >> np.uint64(16)) % np.uint64(parts)
        order = np.argsort(own, kind="stable")
        own = own[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        words = np.bitwise_xor.reduceat(mix(tokens[order], 1), first)
        place = own[first] * np.uint64(64) + np.uint64(k)
        keys = mix(words ^ mix(place, 2))
        late = np.logical_and.reduceat(known[order], first)
        keys = np.concatenate((_least(keys[~late], d + 1), _least(keys[late], d + 1)))[: d + 1]
        if len(keys) < d + 1:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), own[first])[: d + 1 - len(keys)]
            keys = np.concatenate((keys, mix(empty * np.uint64(64) + np.uint64(k), 3)))
        out.append(keys)
    return np.concatenate(out).view(np.int64)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), *((f"s{i}", pa.int64()) for i in range(SKETCH_WORDS)), ("wide", pa.binary())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text; and for each token found in many texts of a stretch, a row with n = -1, the token and that number."""
    for b in pieces(batches, STRETCH, 16 << 20):
        rows, wide, tokens = np.zeros((b.num_rows, 3 + SKETCH_WORDS), np.int64), [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            t = shingle_hashes(text)
            rows[i, 0] = len(t)
            rows[i, 1] = np.add.reduce(mix(t, 4)).view(np.int64)
            rows[i, 2] = np.bitwise_xor.reduce(mix(t, 5)).view(np.int64) if len(t) else 0
            rows[i, 3:] = parity_sketch(t)
            wide.append(wide_sketch(t))
            tokens.append(t)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(rows[:, j]) for j in range(rows.shape[1])), pa.array(wide, pa.binary())], schema=_DIGEST)
        token, count = np.unique(np.concatenate(tokens), return_counts=True) if tokens else (np.empty(0, np.uint64), np.empty(0, np.int64))
        often = count >= max(4, b.num_rows * COMMON_SHARE * 4)
        found, n = token[often].view(np.int64), int(often.sum())
        zero, less = pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, -1, np.int64))
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), less, pa.array(found), pa.array(count[often].astype(np.int64)), *([zero] * SKETCH_WORDS), pa.nulls(n, pa.binary())], schema=_DIGEST)


def _keys(common) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _keyed(batches, np.sort(np.array(common.value, np.int64).view(np.uint64)))

    return run


def _keyed(batches: Iterator[pa.RecordBatch], common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(sig, doc_id); equal sets near each other in a task are keyed once, since exact copies are classed by their digest."""
    schema, seen = pa.schema([("sig", pa.int64()), ("doc_id", pa.int64())]), set()
    for b in pieces(batches, 2000):
        if len(seen) > 100_000:
            seen = set()
        ids, sigs, lengths = [], [], []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if doc is None:
                continue
            t = shingle_hashes(text)
            key = xxhash.xxh3_128_digest(t.tobytes())
            if len(t) and key not in seen:
                seen.add(key)
                sigs.append(signatures(t, common))
                ids.append(doc)
                lengths.append(len(sigs[-1]))
            if len(ids) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.repeat(np.array(ids, np.int64), lengths))], schema=schema)
                ids, sigs, lengths = [], [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.repeat(np.array(ids, np.int64), lengths))], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, doc_id) to (sig, first of the run, other member); a run may span batches."""
    last = None
    for b in batches:
        sig, doc = b.column("sig").to_numpy(), b.column("doc_id").to_numpy()
        if not len(sig):
            continue
        head = np.concatenate(([last is None or sig[0] != last[0]], sig[1:] != sig[:-1]))
        at = np.maximum.accumulate(np.where(head, np.arange(len(sig)), -1))
        first = np.where(at >= 0, doc[at], last[1] if last else 0)
        last = (sig[-1], first[-1])
        keep = ~head & (first != doc)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(first[keep]), pa.array(doc[keep])], names=["sig", "a", "b"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose wide sketches allow a Jaccard of 3/4."""
    for b in batches:
        rows = zip(b.column("na").to_pylist(), b.column("nb").to_pylist(), b.column("wa").to_pylist(), b.column("wb").to_pylist(), strict=True)
        keep = [sketch_distance(x, y) <= most_different(m, n) for m, n, x, y in rows]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for b in pieces(batches, 1000):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([packer.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()], pa.binary())], names=["doc_id", "packed"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple = (None, None)
    unpack = zstandard.ZstdDecompressor()

    def tokens(packed: bytes) -> np.ndarray:
        return shingle_hashes(unpack.decompress(packed).decode("utf-8", "surrogatepass"))

    for b in pieces(batches, 1000):
        left, right, keep = b.column("a").to_pylist(), b.column("b").to_pylist(), []
        for a, x, y in zip(left, b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
            if last[0] != a:
                last = (a, tokens(x))
            s, t = last[1], tokens(y)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * both >= 75 * (len(s) + len(t) - both))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _close(a: str, b: str):
    """Size ratio and sketch distance that a pair with Jaccard of at least 3/4 must meet."""
    differ = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (na * 4 >= nb * 3) & (nb * 4 >= na * 3) & (differ * 7 <= na + nb)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", links_only: bool = False) -> DataFrame:
    """Groups of texts linked by 5-word-shingle Jaccard >= 0.75: (doc_id, n_shingles, component_id), a row per input row.

    Exact copies of a set are one class, represented by the smallest id. Keys of the classes meet in runs; each run
    first proposes (first member, other member) only. Tokens in many texts are counted first, so that keys avoid them. Of a member's proposals the closest by sketch is verified, then
    those that would join two components, then - for runs that still hold several components - pairs with other
    members and at last all remaining pairs that pass the size and sketch bounds. So no link that could change a component is left untested, while pairs inside
    a component are never listed. Verification compares the whole shingle sets.

    With `links_only`, the links themselves: (a, b, n_links), a row per linked pair of classes a < b, with the number of linked
    pairs of documents (product of the class sizes), and a row a = b per class of copies with the pairs inside it. All pairs of a run
    that pass the bounds are verified then, so the work grows with the square of a dense group, as its links do.

    Null, empty or blank text: no shingles, alone. Rows with a null id come back with a null component. Of rows repeating
    an id the one with the greatest text counts, and the id comes back once. Extra columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text")).union(docs.where("doc_id is null"))
        docs = stage(docs, "shingle-documents")
    digest = stage(docs.mapInArrow(_digests, ", ".join(f"{f.name} {'binary' if f.name == 'wide' else 'long'}" for f in _DIGEST)), "shingle-digests")
    counted = digest.where("n = -1").groupBy("h1").agg(F.sum("h2").alias("texts"))
    digest = digest.where("n >= 0")
    common = counted.where(F.col("texts") >= max(8, COMMON_SHARE * digest.count())).select("h1")
    shared = docs.sparkSession.sparkContext.broadcast(common.toPandas()["h1"].to_numpy(np.int64))
    known = digest.where("n > 0 and doc_id is not null")
    classes = stage(known.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "shingle-classes")
    member = known.join(classes.where("last <> rep"), ["n", "h1", "h2"]).where("doc_id <> rep").select("doc_id", "rep")
    member = compact(stage(member, "shingle-copies"))
    known = known.drop("h1", "h2").join(member, "doc_id", "left_anti")
    sketches = known.drop("wide")

    keyed = docs.mapInArrow(_keys(shared), "sig long, doc_id long").repartition("sig").sortWithinPartitions("sig", "doc_id")
    runs = stage(keyed.mapInArrow(_runs, "sig long, a long, b long"), "shingle-runs")

    def representative(df: DataFrame, column: str) -> DataFrame:
        names = member.select(F.col("doc_id").alias(column), F.col("rep").alias(f"{column}_rep"))
        return df.join(names, column, "left").withColumn(column, F.coalesce(f"{column}_rep", column)).drop(f"{column}_rep")

    pairs = representative(representative(runs.select("a", "b").distinct(), "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = sketches.alias("l"), sketches.alias("r")
    bounded = pairs.join(left, F.col("a") == F.col("l.doc_id")).join(right, F.col("b") == F.col("r.doc_id")).where(_close("l", "r"))
    distance = sum((F.bit_count(F.col(f"l.s{i}").bitwiseXOR(F.col(f"r.s{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    candidates = compact(stage(bounded.select("a", "b", distance.alias("distance")), "shingle-candidates"))

    wide = known.select("doc_id", "n", "wide")

    def verified(wanted: DataFrame) -> DataFrame:
        """Pairs (a, b) that link: by wide sketch first, then by the whole texts, which travel compressed and only for documents still in a pair."""
        left, right = wide.toDF("a", "na", "wa"), wide.toDF("b", "nb", "wb")
        near = wanted.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(_near, "a long, b long")
        near = compact(stage(near, "shingle-near"), 5_000)
        ids = small(near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct())
        texts = stage(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_compressed, "doc_id long, packed binary"), "shingle-texts")
        both = near.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
        return both.select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long")

    def labelled(df: DataFrame, column: str, label: str, comp: DataFrame) -> DataFrame:
        names = comp.select(F.col("node").alias(column), F.col("component").alias(label))
        return df.join(names, column, "left").withColumn(label, F.coalesce(label, column))

    if links_only:
        inside = representative(runs, "b").where("a <> b").select("sig", "b").distinct().join(sketches.withColumnRenamed("doc_id", "b"), "b")
        p, q = inside.alias("p"), inside.alias("q")
        others = p.join(q, (F.col("p.sig") == F.col("q.sig")) & (F.col("p.b") < F.col("q.b")) & _close("p", "q")).select(F.col("p.b").alias("a"), F.col("q.b").alias("b"))
        every = stage(verified(stage(candidates.select("a", "b").union(others).distinct(), "shingle-late")), "shingle-links")
        copies = member.groupBy("rep").agg((F.count("*") + 1).alias("size"))
        size_a, size_b = (copies.select(F.col("rep").alias(c), F.col("size").alias(f"size_{c}")) for c in ("a", "b"))
        between = every.join(size_a, "a", "left").join(size_b, "b", "left").select("a", "b", (F.coalesce("size_a", F.lit(1)) * F.coalesce("size_b", F.lit(1))).cast("long").alias("n_links"))
        return between.union(copies.select("rep", "rep", F.expr("size * (size - 1) div 2")))

    closest = candidates.groupBy("b").agg(F.min_by("a", F.struct("distance", "a")).alias("a"))
    links = compact(stage(verified(closest.select("a", "b")), "shingle-links"))
    comp = compact(stage(components(links, "shingle-components"), "shingle-labels"))

    rest = candidates.join(closest, ["a", "b"], "left_anti").select("a", "b")
    rest = labelled(labelled(rest, "a", "ca", comp), "b", "cb", comp).where("ca <> cb").select("a", "b")
    more = compact(stage(verified(rest), "shingle-links"))
    if not more.isEmpty():
        links = links.union(more)
        comp = compact(stage(components(links, "shingle-components"), "shingle-labels"))

    # Runs of three and more that still hold several components: other members propose pairs, one member a run and
    # round (one of PROPOSERS orders, so that runs of one group take different ones), which merges what is left of dense groups ...
    inside = representative(runs, "b").where("a <> b").select("sig", "b").distinct()

    def mixed_runs() -> DataFrame:
        own = labelled(inside, "b", "cb", comp)
        mixed = own.groupBy("sig").agg(F.min("cb").alias("lo"), F.max("cb").alias("hi")).where("lo <> hi").select("sig")
        return compact(stage(own.join(mixed, "sig").join(sketches.withColumnRenamed("doc_id", "b"), "b"), "shingle-mixed"))

    tested = candidates.select("a", "b")
    for turn in range(2):
        inside = mixed_runs()
        chosen = inside.groupBy("sig").agg(F.min_by(F.struct(*inside.columns), F.xxhash64("b", F.pmod("sig", F.lit(PROPOSERS)), F.lit(turn))).alias("q")).select("q.*")
        p, q = inside.alias("p"), chosen.alias("q")
        meet = (F.col("p.sig") == F.col("q.sig")) & (F.col("p.cb") != F.col("q.cb")) & _close("p", "q")
        late = p.join(q, meet).select(F.least("p.b", "q.b").alias("a"), F.greatest("p.b", "q.b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        late = compact(stage(late, "shingle-late"))
        more = compact(stage(verified(late), "shingle-links"))
        tested, inside = tested.union(late), inside.select("sig", "b")
        if not more.isEmpty():
            links = links.union(more)
            comp = compact(stage(components(links, "shingle-components"), "shingle-labels"))

    # ... and then all pairs of members of different components that the bounds allow are verified.
    inside = mixed_runs()
    p, q = inside.alias("p"), inside.alias("q")
    meet = (F.col("p.sig") == F.col("q.sig")) & (F.col("p.b") < F.col("q.b")) & (F.col("p.cb") != F.col("q.cb")) & _close("p", "q")
    late = p.join(q, meet).select(F.col("p.b").alias("a"), F.col("q.b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    more = stage(verified(late), "shingle-links")
    if not more.isEmpty():
        comp = compact(stage(components(links.union(more), "shingle-components"), "shingle-labels"))

    return labelled(representative(digest.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("r")), "r"), "r", "component_id", comp).select("doc_id", "n_shingles", "component_id")
