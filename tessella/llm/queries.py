"""Queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, licenses, metric_join, mixing, piecewise, quality, runs, sharding, simhash, toxicity, warc, yinyang
from .common import read


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.page_responses(read(spark, sf_dir, "pages")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents"))


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op10_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.piecewise_fingerprints(read(spark, sf_dir, "documents"))


def op11_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.link_embeddings(read(spark, sf_dir, "embeddings"))


def op12_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.encode_embeddings(read(spark, sf_dir, "embeddings"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.document_runs(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after another."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc_derivatives, op2_quality, op3_exact_dedup, op4_simhash, op5_bpe, op6_toxicity, op7_mixing, op8_feistel_sharding, op9_license_scan, op10_piecewise_hash, op11_metric_join, op12_yinyang, op13_runs, pipeline)}
ORACLE_SQL: dict[str, str] = {"op3_exact_dedup": exact_dedup.ORACLE, "op11_metric_join": metric_join.ORACLE, "op12_yinyang": yinyang.ORACLE}
