"""Language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewatch.llm.common import pieces

FEATURES = 1 << 14
GRAMS = (1, 2, 3)
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed letter n-grams, a row per text; anything but letters counts as one blank between words."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in enumerate(texts):
        if not text:
            continue
        c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(_letters()[c], c, 32)
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))].astype(np.uint64)
        if len(c) < 2:
            continue
        for n in GRAMS:
            g = np.full(len(c) - n + 1, n, np.uint64)
            for i in range(n):
                g = g * np.uint64(0x9E3779B97F4A7C15) + c[i : i + len(g)]
            slot = (g * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(50)
            out[row] += np.bincount(slot.astype(np.int64), minlength=FEATURES)
    return out


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A word of +1 and -1 for each language. Up to five languages get every split into two groups; more get, of many random codes of 10 log2 bits, the one whose closest words differ most."""
    if languages <= 5:
        columns = [[1, *(1 if (k >> i) & 1 else -1 for i in range(languages - 1))] for k in range(2 ** (languages - 1) - 1)] if languages > 1 else []
        return np.array(columns, np.int8).reshape(-1, languages).T
    rng, best, found = np.random.default_rng(seed), -1, None
    bits = int(np.ceil(10 * np.log2(languages)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        apart = (bits - code.astype(np.int32) @ code.T.astype(np.int32)) // 2
        np.fill_diagonal(apart, bits)
        if apart.min() > best and (np.abs(code.sum(0)) < languages).all():
            best, found = apart.min(), code
    return found


class Decoder:
    """Binary classifiers (log-odds of n-grams between the two groups of languages of a bit) and loss-weighted decoding."""

    SHARPNESS = 8.0

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names, self.code = names, codewords(len(names))
        share = counts / np.maximum(counts.sum(1, keepdims=True), 1)  # languages weigh alike, however much text they have
        bits = self.code.shape[1]
        self.weights = np.zeros((FEATURES, bits), np.float32)
        for b in range(bits):
            plus, minus = share[self.code[:, b] > 0].mean(0), share[self.code[:, b] < 0].mean(0)
            self.weights[:, b] = np.log((plus + 1e-6) / (minus + 1e-6))
        self.trust = np.full((len(names), bits), 1.0 / max(bits, 1))

    def weigh(self, right: np.ndarray, total: np.ndarray) -> None:
        """Weight of a bit for a language: how often its classifier is right on that language's training texts."""
        rate = np.clip((right + 1) / (total + 2) - 0.5, 0.01, None)
        self.trust = rate / rate.sum(1, keepdims=True)

    def margins(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.weights / np.maximum(counts.sum(1, keepdims=True), 1)

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score (share of the weight of all codewords by loss) and that of the next one."""
        m = self.margins(counts) * self.SHARPNESS
        loss = np.stack([(np.logaddexp(0, -m * word) * trust).sum(1) for word, trust in zip(self.code, self.trust, strict=True)], 1)
        p = np.exp(-(loss - loss.min(1, keepdims=True)) * self.SHARPNESS)
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, 1, kind="stable")
        rows = np.arange(len(p))
        second = p[rows, order[:, 1]] if p.shape[1] > 1 else np.zeros(len(p))
        return order[:, 0], p[rows, order[:, 0]], second


def fit(labelled: DataFrame, rows_per_language: int = 4000, most_languages: int = 1000) -> Decoder | None:
    """Fit on (text, lang). Documented bound: about `rows_per_language` rows of each language, drawn by hash; one pass counts n-grams, one measures the bits."""
    labelled = labelled.where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    names = sorted(r["lang"] for r in sizes)
    if not names:
        return None
    share = {r["lang"]: min(1.0, rows_per_language / r["count"]) for r in sizes}
    bound = F.create_map(*(F.lit(x) for n in names for x in (n, share[n])))[F.col("lang")]
    drawn = labelled.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_000)) < bound * 1_000_000).select("text", "lang")
    number = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), FEATURES))
        for b in pieces(batches, 200):
            own = np.array([number[x] for x in b.column("lang").to_pylist()])
            counts = features(b.column("text").to_pylist())
            for k in np.unique(own):
                total[k] += counts[own == k].sum(0)
        lang, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int64)), pa.array(slot.astype(np.int64)), pa.array(total[lang, slot])], names=["lang", "slot", "n"])

    counts = np.zeros((len(names), FEATURES))
    for r in drawn.mapInArrow(count, "lang long, slot long, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas().itertuples():
        counts[int(r.lang), int(r.slot)] = r.n
    model = Decoder(names, counts)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = model.code.shape[1]
        good, seen = np.zeros((len(names), bits)), np.zeros((len(names), bits))
        for b in pieces(batches, 200):
            own = np.array([number[x] for x in b.column("lang").to_pylist()])
            hit = np.sign(model.margins(features(b.column("text").to_pylist()))) == model.code[own]
            np.add.at(good, own, hit)
            np.add.at(seen, own, 1)
        lang, bit = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int64)), pa.array(bit.astype(np.int64)), pa.array(good[lang, bit]), pa.array(seen[lang, bit])], names=["lang", "bit", "good", "seen"])

    if len(names) > 1:
        good, seen = np.zeros_like(model.trust), np.zeros_like(model.trust)
        for r in drawn.mapInArrow(right, "lang long, bit long, good double, seen double").groupBy("lang", "bit").agg(F.sum("good").alias("good"), F.sum("seen").alias("seen")).collect():
            good[r["lang"], r["bit"]], seen[r["lang"], r["bit"]] = r["good"], r["seen"]
        model.weigh(good, seen)
    return model


def identify(docs: DataFrame, model: Decoder | None, least_lead: float = 0.2, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous, then the columns in `carry`) of every row, from the whole text and nothing else.

    `ambiguous`: the score leads that of the next language by less than `least_lead`. Texts without a letter, null texts and
    an empty model give `und` with score 0. The model has a fixed size a language and goes to every task. Repeated rows
    come back each. Other columns are ignored.
    """
    kept = [docs.schema[c] for c in carry]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"), *carry)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared.value
        for b in pieces(batches, 200):
            counts = features(b.column("_text").to_pylist())
            some = counts.sum(1) > 0
            names, scores, unsure = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            if decoder is not None and some.any():
                best, score, second = decoder.decode(counts[some])
                names[some], scores[some], unsure[some] = np.array(decoder.names, object)[best], score, score - second < least_lead
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores), pa.array(unsure), *(b.column(c) for c in carry)], names=["doc_id", "lang_pred", "score", "ambiguous", *carry])

    return docs.mapInArrow(run, T.StructType([*T.StructType.fromDDL("doc_id long, lang_pred string, score double, ambiguous boolean").fields, *kept]))
