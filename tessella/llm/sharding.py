"""Reproducible sharding by a Feistel permutation of global row numbers (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_copy, materialise, running_offsets, text_of
from .feistel import permute

SHARDS = 24
SEED = 8


def place(position: pd.Series, total: int, shards: int, seed: int) -> pd.DataFrame:
    """Shard and slot of global row numbers: row r goes to image mod shards, slot image div shards."""
    image = permute(position.to_numpy(), total, seed)
    return pd.DataFrame({"shard": (image % shards).astype("int32"), "slot": image // shards})


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (none for null) plus 8. The law is ``rows``: shards differ by one row at most,
    slots run from 0 without a gap, and grown_shard is null. Global row numbers follow a hash of doc_id, size and
    checksum, so the same rows get the same places whatever the partitioning; rows equal in these three are
    counted before the shuffle and take consecutive numbers. Null ids and texts, empty tables and repeated rows
    are all placed; other columns of ``docs`` are not looked at.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = materialise(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")))
    total, most = (x or 0 for x in counted.agg(F.sum("copies"), F.max("copies")).first())
    placed = running_offsets(counted, "copies", [], ["doc_id", "size", "text_crc32"], "first")
    placed = each_copy(placed, "copies", most, "copy").withColumn("position", F.col("first") + F.col("copy"))

    @F.pandas_udf("shard int, slot long")
    def shard_slot(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for position in batches:
            yield place(position, total, shards, seed)

    return placed.withColumn("at", shard_slot("position")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "at.shard", "at.slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(placed: DataFrame, path: str) -> None:
    """Write rows that carry shard and slot to one folder per shard, each file in the order of its slots."""
    shards = placed.select(F.max("shard")).first()[0] or 0
    placed.repartition(shards + 1, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
