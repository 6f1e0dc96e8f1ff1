"""A training-corpus pipeline of four stages over ``documents``.

Toxic documents go, then those in no known language, then all but one of each group of near-duplicates; what
is left is packed into sequences. Every stage reads what the one before it wrote.
"""

from __future__ import annotations

import uuid

from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.llm import language, packing, simhash, toxicity
from dayweave.llm.common import table
from dayweave.session import ensure_checkpoint_dir

#: No stage can be written as SQL: they fit models, hash with XXH64 and pack greedily.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those a classifier, learned from the labelled ones among them, calls toxic."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that have no letters or fit no learned language better than the others.

    Where no document has a language there is nothing to learn from; all documents with a letter stay.
    """
    model = language.learn(docs)
    if not model.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language.keep_known(docs, model, min_score=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with the smallest id of every group whose shingles of five words are 0.8 or more alike."""
    return simhash.keep_first(docs, simhash.similar_documents(docs, size=5, similarity=0.8))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, path("byte_bpe_50k.json"), PATTERN)


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("near_duplicates", drop_near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}-{name}")
        docs = spark.read.parquet(f"{folder}/{n}-{name}")
    return docs
