"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again by the next.

Language ID drops documents that it rejects, exact dedup and near dedup keep one document of each group,
mixing replicates documents toward the target weights of their sources, and packing returns, for every
remaining row, its length bucket, batch and place. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, langid, minhash, mixing, packing
from tessera.llm.common import cut, load
from tessera.llm.queries import TARGETS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.train(docs, ~langid.held_out()))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs, TARGETS, keep_unlisted=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing to target weights", mix),
    ("packing", pack),
]

#: SQL can express neither the language model nor the near-duplicate classes; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
