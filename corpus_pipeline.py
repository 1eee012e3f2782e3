"""The corpus pipeline: documents in, packed token pieces out.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and is written as Parquet and read again before the next one.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and empty tables, reads whole texts, and all but the last return the columns of
documents whatever other columns ``docs`` has.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from playbill.llm import exact_dedup, jaccard, mixing, quality, sequences
from playbill.llm.common import stored

#: distinct words an encoder remembers: workers of all stages share an executor
WORDS = 150_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier, learned from ``labels``, predicts as good.  A null
    text is scored as an empty one; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.with_scores(docs, labels, threshold=quality.THRESHOLD)
    return rows.filter("predicted = 1").select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts, that with the largest doc_id; null texts
    equal empty ones, and a null doc_id yields to any other."""
    return exact_dedup.drop_duplicates(docs).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by word 5-grams with a Jaccard
    similarity of 0.8 or more, that with the smallest doc_id.  Rows without
    words or without doc_id link with nothing and stay."""
    return jaccard.one_per_group(docs, width=5, percent=80).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes once per epoch that
    takes it, and the one that a budget cuts with its first words.  A null
    source is a source; rows without words are in no mix."""
    return mixing.mixed_documents(docs, weights=mixing.WEIGHTS, most=mixing.MOST_EPOCHS).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens.  A null
    or empty text is its end id; repeated rows are packed each."""
    return sequences.packed_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), "leading", 0, sequences.CAPACITY,
                                   memory=WORDS)


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the classifier; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
