"""Corpus pipeline: quality, language, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's input.
All but the last return the columns of `documents`: doc_id, text, lang, source, n_chars. Rows with a null id pass the filters by
their text like all others. Columns of other names are left out, whatever they are called; an empty table gives an empty one. Texts
of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents less probable than their language's trusted text allows, and those without text.

    Rows that repeat an id are judged each by its own text. Null languages use the threshold over all. A level equal to the threshold stays.
    """
    from tidewatch.llm.common import table
    from tidewatch.llm.quality_model import quality

    verdicts = quality(docs, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))
    return _without(docs, verdicts.where("not kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language; the others get the language found.

    Null texts and texts without letters go, and so do texts as near to two languages. Rows that repeat an id are judged each.
    Null languages are not learned from; without any known language nothing is recognised.
    """
    from tidewatch.llm.language_id import fit, identify

    found = identify(docs, fit(docs.select("doc_id", "text", "lang")), carry=["text", "source", "n_chars"])
    return found.where("lang_pred <> 'und' and not ambiguous").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines; documents left without any text go.

    Rows that repeat an id count as documents of their own, and all keep the lines that the id keeps. Rows with a null id keep all lines.
    """
    from tidewatch.llm.line_dedup import dedup_lines

    kept = dedup_lines(docs, carry=["lang", "source"])
    return kept.where(F.length(F.trim("text")) > 0).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies; of rows repeating an id, the one with the greatest text."""
    from tidewatch.llm.ngram_join import near_duplicates

    copies = near_duplicates(docs).where("component_id <> doc_id").select("doc_id")
    kept = _without(docs, copies)
    named = kept.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    one = named.groupBy("doc_id").agg(F.max(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return one.unionByName(kept.where("doc_id is null")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    import public_tokenizers

    from tidewatch.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose id (and text, where `gone` has its hash) isn't listed. The list is broadcast if it is short enough."""
    from tidewatch.llm.common import small

    if "text_hash" not in gone.columns:
        return docs.join(small(gone.select("doc_id")), "doc_id", "left_anti").select(*COLUMNS)
    g = small(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())
    return docs.join(g, F.col("doc_id").eqNullSafe(F.col("gone_id")) & F.xxhash64("text").eqNullSafe(F.col("gone_hash")), "left_anti").select(*COLUMNS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("best_fit_packing", best_fit_packing),
]

# A trained model, a fixed tokenizer and best-fit packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`."""
    from tidewatch.llm.common import stage, table

    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
