"""Corpus pipeline: five stages one after another, each written as Parquet and read again by the next.

Stages filter, rewrite or repeat whole documents; all but the last return the columns of `documents`, and further
columns as they came. An empty table stays empty. Stages that use Python bound the session's Arrow batches in bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.llm import importance, jaccard_join, mixing, pii, sentencepiece_codec
from quarrion.llm.common import bounded_batches, table, written

#: Near duplicates: shingles of five words, a Jaccard similarity of 0.8 or more.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go. Null and empty texts have weight 1; repeated rows stay or go together."""
    bounded_batches(spark)
    return importance.keep_sampled(docs, importance.good_documents(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates stays.

    Rows with the same id are one document and stay or go together; rows without an id link with nothing and stay, as do
    texts without words."""
    bounded_batches(spark)
    found = jaccard_join.joined(docs, SHINGLE_WORDS, SHINGLE_PERCENT)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets. Null texts stay null, with n_chars 0; every row stays."""
    found = pii.redact(pii.find(docs))
    own = {"text": F.when(F.col("row.text").isNull(), F.col("row.text")).otherwise(F.col("redacted")), "n_chars": F.length("redacted").cast("long")}
    return found.select(*[own.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the temperature mixture of sources has them, each at least once. A null source is a source;
    rows that repeat come equally often."""
    return mixing.realised(mixing.mixed(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, one row for each row; null texts count as empty."""
    bounded_batches(spark)
    return sentencepiece_codec.encode_digests(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]
#: Fitted models, hash orders and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
