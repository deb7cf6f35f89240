"""Exact duplicates with the heavy hitters split off (operator 3); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_ONE_IN, ascii_lower, keep_rows, materialise, row_key, text_of

#: Counters of each Misra-Gries summary: several times HEAVY_ONE_IN, so that no heavy digest escapes it.
COUNTERS = 16384
#: First-level summaries, merged into one afterwards.
SUMMARIES = 64


def text_digest(text: str | Column = "text") -> Column:
    """SHA-256 of the text with A-Z lower-cased, in lower-case hex; null counts as empty."""
    return F.sha2(ascii_lower(text_of(text)).cast("binary"), 256)


def heavy_digests(digests: DataFrame, one_in: int = HEAVY_ONE_IN) -> DataFrame:
    """Digests that hold at least 1/``one_in`` of the rows: (text_sha256, keep, group_size), ``one_in`` rows at most.

    Misra-Gries summaries (Spark's ``approx_top_k``, merged in two levels) name the candidates; an exact count
    over the rows of the candidates verifies them, so a false candidate never gets through.
    """
    total = digests.count()
    code = digests.select(F.xxhash64("text_sha256").alias("code"), (F.spark_partition_id() % SUMMARIES).alias("part"))
    parts = code.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(code, {COUNTERS})").alias("state"))
    whole = F.col("part") >= SUMMARIES  # one group, false; a sketch can't be made of a partition without rows, as an ungrouped aggregate would ask
    merged = parts.groupBy(whole).agg(F.expr(f"approx_top_k_combine(state, {COUNTERS})").alias("state"))
    candidates = merged.select(F.explode(F.expr(f"approx_top_k_estimate(state, {one_in})")).alias("top")).select(F.col("top.item").alias("code"))
    counted = (
        digests.join(F.broadcast(candidates), F.xxhash64("text_sha256") == F.col("code"), "left_semi")
        .groupBy("text_sha256")
        .agg(F.max(F.struct("doc_id", "row_tag")).alias("keep"), F.count("*").alias("group_size"))
    )
    return counted.where(F.col("group_size") * one_in >= F.lit(total))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = HEAVY_ONE_IN) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The row with the largest doc_id of a group stays;
    null ids are smaller than all others, and of rows with the same id exactly one stays. Null texts count as
    empty, and empty texts form a group like any other. An empty table gives an empty result. Other columns
    of ``docs`` are not looked at.

    Rows of heavy digests meet the broadcast winners (at most ``one_in``) where they are read; only the rest,
    in which no digest holds more than 1/``one_in`` of the rows, are shuffled, once: groups are aggregated where they come
    together, and their rows pass by the winners one at a time.
    """
    digests = materialise(docs.select(F.col(id_col).alias("doc_id"), text_digest(text_col).alias("text_sha256"), F.monotonically_increasing_id().alias("row_tag")))
    winners = materialise(heavy_digests(digests, one_in))
    heavy = digests.join(F.broadcast(winners), "text_sha256")
    light = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    light = light.repartition("text_sha256")
    groups = light.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row_tag")).alias("keep"), F.count("*").alias("group_size"))
    light = light.join(groups.hint("merge"), "text_sha256")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_tag") == F.col("keep.row_tag")).alias("kept"),
        "text_sha256",
    )


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns, whatever their names; repeated rows come out once.

    Null and empty texts are one text. Of rows that agree in id and text one stays by a hash of all columns. An empty table gives an empty result.
    """
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(row_key("doc_id", F.col("text_sha256")).alias("_key"))
    return keep_rows(docs, row_key(id_col, text_digest(text_col)), kept)


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
