"""Differences of entry sets and of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_entries(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Entries (keys, size, crc) of two sides with status added, removed, modified or unchanged."""
    a = left.select(*keys, F.col("size").alias("left_size"), F.col("crc").alias("left_crc"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col("size").alias("right_size"), F.col("crc").alias("right_crc"), F.lit(True).alias("_r"))
    same = (F.col("left_size") == F.col("right_size")) & (F.col("left_crc") == F.col("right_crc"))
    status = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return a.join(b, keys, "full_outer").withColumn("status", status).drop("_l", "_r")


def keys_on_one_side(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys that ``left`` alone has (removed) or ``right`` alone (added), each once; nulls are equal, as in EXCEPT.

    Both sides meet in one aggregate, which holds a key and two flags.
    """
    both = left.select(*keys, F.lit(True).alias("_l")).unionByName(right.select(*keys, F.lit(False).alias("_l")))
    met = both.groupBy(*keys).agg(F.max("_l").alias("_l"), F.min("_l").alias("_r"))
    return met.where(F.col("_l") == F.col("_r")).select(*keys, F.when(F.col("_l"), "removed").otherwise("added").alias("side"))


def compare_lines(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that differ by position in two texts of a key: (key, line from 1, left, right); a side that ends counts as empty."""
    def lines(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\R", -1)).alias("_pos", name))

    both = lines(left, "left").join(lines(right, "right"), [key, "_pos"], "full_outer")
    both = both.select(key, (F.col("_pos") + 1).cast("long").alias("line"), F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"))
    return both.where(F.col("left") != F.col("right"))
