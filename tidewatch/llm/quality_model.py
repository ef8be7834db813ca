"""Text quality: interpolated modified Kneser-Ney character model of trusted text, and perplexity by language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import pieces, small, stage

ORDER = 4  # characters; four 16-bit codes make one long
START = 1
BLOCK_ROWS = 2000
STRETCH = 1 << 19  # characters worked on at a time


def gram_codes(text: str, before: str = "") -> np.ndarray:
    """One long per character: the codes of the ORDER - 1 characters before it, then its own. Codes beyond 16 bits are folded to the private area."""
    c = np.frombuffer((before + text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = np.where(c > 0xFFFF, 0xE000 + (c & np.uint64(0xFFF)), c).astype(np.uint64)
    c = np.concatenate((np.full(ORDER - 1 - len(before), START, np.uint64), c))
    n = len(c) - ORDER + 1
    g = np.zeros(n, np.uint64)
    for i in range(ORDER):
        g = (g << np.uint64(16)) | c[i : i + n]
    return g


def gram_stretches(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The codes of all characters of some texts, some STRETCH of them at a time: long texts in parts, short ones together."""
    held, size = [], 0
    for text in texts:
        for start in range(0, len(text or ""), STRETCH):
            held.append(gram_codes(text[start : start + STRETCH], text[max(0, start - ORDER + 1) : start]))
            size += len(held[-1])
            if size >= STRETCH:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 1000):
        for codes in gram_stretches(b.column("text").to_pylist()):
            g, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["g", "n"])


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts of grams seen once, twice and more often, from the numbers of grams seen one to four times."""
    n1, n2, n3, n4 = counts.agg(*(F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4))).first()
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.01), k) for d, k in ((1 - 2 * y * n2 / n1, 1.0), (2 - 3 * y * n3 / n2, 2.0), (3 - 4 * y * n4 / n3, 3.0)))


def train(docs: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Model tables, order 1 first: grams (g, alpha) and contexts (h, gamma), so that p(g) = alpha(g) + gamma(h) p(shorter g).

    The highest order counts occurrences, the lower ones distinct characters before the gram. All texts given are
    counted; every table is dealt by its key.
    """
    counts = [stage(docs.mapInArrow(_count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")), "ngram-counts")]
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("g").bitwiseAND(F.lit((1 << 16 * k) - 1))
        counts.insert(0, stage(counts[0].groupBy(shorter.alias("g")).agg(F.count("*").alias("n")), "ngram-counts"))
    model = []
    for grams in counts:
        d1, d2, d3 = _discounts(grams)
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        h = F.shiftrightunsigned("g", 16)
        contexts = grams.groupBy(h.alias("h")).agg(F.sum("n").alias("total"), F.sum(discount).alias("saved")).select("h", "total", (F.col("saved") / F.col("total")).alias("gamma"))
        alpha = grams.withColumn("h", h).join(contexts.select("h", "total"), "h").select("g", ((F.col("n") - discount) / F.col("total")).alias("alpha"))
        model.append((stage(alpha, "ngram-alpha"), stage(contexts.select("h", "gamma"), "ngram-gamma")))
    return model


def log_probabilities(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(g, logp) of distinct grams, by joining the counts of each order: grams on their last k characters, contexts on those but the last."""
    chars = model[0][0].count() + 1
    out = grams.withColumn("p", F.lit(1.0 / chars))
    for k, (alpha, gamma) in enumerate(model, 1):
        own = F.col("g").bitwiseAND(F.lit((1 << 16 * k) - 1)) if k < ORDER else F.col("g")
        out = out.withColumn("own", own).withColumn("h", F.shiftrightunsigned("own", 16))
        out = out.join(alpha.withColumnRenamed("g", "own"), "own", "left").join(gamma, "h", "left")
        out = out.select("g", F.when(F.col("gamma").isNull(), F.col("p")).otherwise(F.coalesce("alpha", F.lit(0.0)) + F.col("gamma") * F.col("p")).alias("p"))
    return out.select("g", F.log("p").alias("logp"))


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams by block; the rows of a block follow each other."""
    for b in pieces(batches, BLOCK_ROWS, 16 << 20):
        blocks = b.column("block").to_numpy()
        for block in np.unique(blocks):
            g = np.empty(0, np.uint64)
            for codes in gram_stretches(b.column("text").filter(pa.array(blocks == block)).to_pylist()):
                g = np.union1d(g, codes)
            if len(g):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), block)), pa.array(g.view(np.int64))], names=["block", "g"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block as compressed Arrow streams of some hundred rows, to keep the shuffle small."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    for b in pieces(batches, 250):
        blocks = b.column("block").to_numpy()
        names, packed = [], []
        for block in np.unique(blocks):
            own, sink = b.filter(pa.array(blocks == block)).drop_columns(["block"]), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=options) as out:
                out.write_batch(own)
            names.append(block)
            packed.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.binary())], names=["block", "packed"])


def _score(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    known = known.sort_values("g")
    g, logp = known["g"].to_numpy(np.int64), known["logp"].to_numpy()
    out = []
    for packed in docs["packed"]:
        rows = pa.ipc.open_stream(packed).read_all()
        for doc, lang, text, text_hash in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "lang", "text", "text_hash")), strict=True):
            total = sum(float(logp[np.searchsorted(g, codes.view(np.int64))].sum()) for codes in gram_stretches([text]))
            perplexity = float(np.exp(-total / len(text))) if text else None
            out.append((doc, lang, perplexity, len(text or ""), text_hash))
    return pd.DataFrame(out, columns=["doc_id", "lang", "perplexity", "chars", "text_hash"]).astype({"doc_id": "Int64", "perplexity": "Float64"})


def with_blocks(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(doc_id, lang, text, text_hash, block): a block is BLOCK_ROWS neighbours of a file, the same in every read.

    A frame that isn't read straight from Parquet has no such places; it is written to the shared folder first.
    """
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")]
    place = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / BLOCK_ROWS)).alias("block")
    try:
        return docs.select(*columns, F.xxhash64(text_col).alias("text_hash"), place)
    except AnalysisException:
        docs = stage(docs.select(*columns), "quality-documents")
        return docs.select("*", F.xxhash64("text").alias("text_hash"), place)


def perplexities(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(doc_id, lang, perplexity, chars, text_hash) of every row of `with_blocks`.

    A block asks for its distinct grams only, all blocks' grams meet the sharded counts in joins, and the answers
    return to the block: so the shuffle holds the texts once, and grams by block instead of by document.
    """
    wanted = stage(docs.select("block", "text").mapInArrow(_wanted, "block long, g long").distinct(), "quality-grams")
    known = stage(log_probabilities(wanted.select("g").distinct(), model), "quality-logp")
    answers = wanted.join(known, "g").select("block", "g", "logp")
    return docs.mapInArrow(_packed, "block long, packed binary").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score, "doc_id long, lang string, perplexity double, chars long, text_hash long")


def quality(docs: DataFrame, trusted: DataFrame, quantile: float = 0.995, margin: float = 1.05, least: int = 20, steady: int = 40, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Perplexity of every document under a model of the trusted ones: (doc_id, lang, text_hash, perplexity, level, threshold, kept).

    `trusted` holds ids. Four fifths of the trusted documents train the model (all of them, no sample); the others, unseen by
    it, set a threshold for each language: `margin` times the `quantile` of their level. The level is the perplexity with
    `steady` characters of the language's typical one added, so that a few characters by chance don't condemn a short
    text. Languages with fewer than `least` such documents, and null, use the figures over all of them.

    Null or empty text has no perplexity and isn't kept. Without trusted text there is no threshold and everything with
    text is kept. Repeated rows come back each; `text_hash` tells rows with one id apart. Extra columns are ignored.
    """
    docs = with_blocks(docs, id_col, text_col, lang_col)
    ids = small(trusted.select(F.col(trusted.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct())
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = train(docs.where(~held_out).join(ids, "doc_id", "left_semi"))
    scored = stage(perplexities(docs, model), "perplexities")
    ruler = scored.where(held_out).join(ids, "doc_id", "left_semi").where("perplexity is not null")

    def by_language(rows: DataFrame, figure, name: str) -> tuple[DataFrame, float | None]:
        """A figure by language, and over all."""
        own = rows.groupBy("lang").agg(figure.alias(name), F.count("*").alias("rows")).where((F.col("rows") >= least) & F.col("lang").isNotNull())
        return small(own.drop("rows")), rows.agg(figure).first()[0]

    def with_figure(rows: DataFrame, figures: tuple[DataFrame, float | None], name: str) -> DataFrame:
        return rows.join(figures[0], "lang", "left").withColumn(name, F.coalesce(name, F.lit(figures[1]).cast("double")))

    typical = by_language(ruler, F.avg(F.log("perplexity")), "typical")
    level = F.exp((F.col("chars") * F.log("perplexity") + steady * F.col("typical")) / (F.col("chars") + steady))
    level = F.coalesce(level, F.col("perplexity"))
    limits = by_language(with_figure(ruler, typical, "typical").withColumn("level", level), F.percentile_approx("level", quantile, 10_000), "threshold")
    out = with_figure(with_figure(scored, typical, "typical").withColumn("level", level), limits, "threshold").withColumn("threshold", F.col("threshold") * margin)
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("level") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "text_hash", "perplexity", "level", "threshold", kept.alias("kept"))
