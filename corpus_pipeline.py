"""From raw documents to packed training sequences, stage by stage.

Every stage reads what the one before wrote: documents that the quality classifier rejects go, one of equal
and one of similar texts stays, sources are mixed to their target weights, and what is left is encoded and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidweave.llm.common import stored, table
from bidweave.llm.jaccard import drop_similar
from bidweave.llm.mixture import mix
from bidweave.llm.packing import pack
from bidweave.llm.queries import tokenizer_path
from bidweave.llm.quotient import drop_copies
from bidweave.llm.rffquality import keep_good
from bidweave.session import tune


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return drop_similar(docs, size=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return pack(docs, tokenizer_path(), size=4096, end_id=2)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mixed_sources),
    ("packing", packed_sequences),
]

# the classifier and the seeded choices have no SQL form; tests compare every stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
