"""The corpus pipeline: five operators over ``documents``, each stage written
as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qalytics.llm import common as C
from qalytics.llm import language_id, line_dedup, mixing, ngram_join, packing
from qalytics.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; rejected documents go."""
    C.on_workers(spark)
    return language_id.accepted_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup; lines that match an earlier line go, documents stay."""
    C.on_workers(spark)
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, similarity 0.8); one document of each group stays."""
    C.on_workers(spark)
    return ngram_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights; a document appears as often as it is taken."""
    C.on_workers(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: one row per piece."""
    C.on_workers(spark)
    return packing.packed_sequences(docs, tokenizer_path())


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("ngram_jaccard_join", drop_near_copies),
          ("source_mixing", mix_sources), ("best_fit_packing", pack)]

# Models, shuffles by hash and tokenizers have no SQL form; the stages are
# tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over ``documents``."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
