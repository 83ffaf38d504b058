"""Filter, deduplicate and pack a corpus: five stages, each on what the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelcast.functions.lineage import shared_folder
from panelcast.llm import exact_dedup, ngram_join, packing, quality, toxicity
from panelcast.llm.common import in_fold, labelled, read

# Near copies: word 5-grams, similarity of 0.8 or more.
NEAR = ngram_join.Rule(words=5, num=80, den=100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the n-gram classifier scores 0.5 or more.

    It learns from the labelled documents outside the held-out fold. Null and empty texts
    get the score of a text without features.
    """
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic").where(in_fold("doc_id", 5) != 0)
    model = toxicity.fit(labelled(docs.select("doc_id", "text"), labels, "toxic"))
    return toxicity.keep_clean(docs, model)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose perplexity exceeds what trusted text of their language has.

    Trusted are the documents labelled with quality 1. Null and empty texts go.
    """
    labels = read(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1")
    trusted = labelled(docs.select("doc_id", "text", "lang"), labels, "quality")
    model, limits = quality.fit(trusted)
    return quality.keep_good(docs, model, limits)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts, the smallest doc_id."""
    return ngram_join.one_of_each(docs, NEAR)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("best_fit_packing", pack),
]

# Trained classifiers and token ids have no SQL; tests/llm compares the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
