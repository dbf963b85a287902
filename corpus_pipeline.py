"""A training corpus from raw documents: five stages, each one operator of ``cardinal.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and returns the rows it keeps with the columns of ``documents``; the last
returns the packed pieces.  Each can be written as Parquet and read again as
the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardinal.llm import language, mixing, near_dup, packing, quality
from cardinal.llm.common import fold, reliable_checkpoint, table
from cardinal.llm.queries import quality_model, word_bpe


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts below the calibrated floor of the language model."""
    return language.keep_identified(docs, language.fit(docs, fold() != 0))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts scored below 0.3; the classifier learns from the labelled rows outside the held-out fold."""
    return quality.keep_good(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return near_dup.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of a schedule by target weights (rows ** 0.7); a source that runs out leaves it to the others."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, packed into sequences that follow the order of the rows."""
    return packing.pack(docs, word_bpe(), ordered=True)


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: Learned models and a tokenizer library take part: not expressible in SQL, tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = reliable_checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
