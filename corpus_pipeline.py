"""From raw documents to token ids: quality filter, exact and near duplicates, mixing, encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.

Every stage takes nulls in any column (a null text counts as empty), empty and very long texts, repeated rows and empty tables, and reads the columns of ``documents`` alone,
so that others may have any name; what the operators do with ties is said at each of the functions that the stages call. An empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, exact_dedup, mixing, quality, simhash
from tessella.llm.common import DOCUMENT_COLUMNS, materialise, read


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and their site's posterior take for good (operator 2)."""
    return quality.keep_good(docs.select(*DOCUMENT_COLUMNS), read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id (operator 3)."""
    return exact_dedup.keep_one_copy(docs.select(*DOCUMENT_COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are linked by their fingerprints, the document with the smallest doc_id (operator 4)."""
    return simhash.keep_one_of_component(docs.select(*DOCUMENT_COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn words of each document, one row for each turn that draws from it (operator 7)."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix: doc_id, n_tokens, ids (operator 5)."""
    return bpe.encode_documents(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", filter_quality),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]
#: A fitted classifier, the draws of the mix and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what the one before it wrote."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
