"""The corpus pipeline: quality rules, near-duplicate removal, private data, mixing, encoding.

Each stage reads all that its predecessor kept, as stored files, and its decisions take effect: rejected
documents and all but one of each group of near copies go, surrogates stand in the texts, the mix
repeats and drops documents to meet its targets, and the last stage returns the pieces.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import mixing, nbest, pii, rules, simhash
from factloom.llm.common import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return rules.keep(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: four of five shingles of five words in common."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for private data."""
    out = pii.rewrite(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, by shard and in each shard's own order."""
    return mixing.mix(docs, shuffle=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document, and its N best segmentations."""
    return nbest.encode(docs, keep=["doc_id", "source"])


STAGES = [
    ("quality rules", quality),
    ("near duplicates", distinct),
    ("private data", private),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: Fingerprints, keyed surrogates and the lattice search are beyond SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the documents are a table in the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
