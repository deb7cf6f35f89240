"""Limits, offsets and first occurrences over total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Pages that begin further on are found by the counts of ranges; ranges of the order, and rows of a sample for each.
DEEP, RANGES, SAMPLED = 100_000, 64, 16


def page(df: DataFrame, order: list[str | Column], offset: int, limit: int | None, zero_is_all: bool = False) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``limit`` of an order: a top-k of each partition, then of these; deep pages as :func:`deep_page` has them.

    A limit of zero or less gives no rows, or all of them where ``zero_is_all``.
    """
    limit = limit or 0
    if limit > 0 and offset >= DEEP and all(isinstance(c, str) for c in order):
        return deep_page(df, order, offset, limit)
    rows = df.orderBy(*order).offset(max(0, offset)) if limit <= 0 and zero_is_all else df.orderBy(*order).limit(max(0, offset) + max(0, limit)).offset(max(0, offset))
    return rows


def deep_page(df: DataFrame, order: list[str], offset: int, limit: int, sort: list[str] | None = None) -> DataFrame:
    """A page of an ascending order of columns that is far down: rows are counted by ranges of the first column, and those that hold the page are sorted alone.

    A value that ends a range counts by itself; a page inside one is sought among its rows by the next column. The ends are those of a sample by a hash; wherever they
    lie, the page is the same. ``sort`` has the columns of the whole order, where the first ones are one value.
    """
    sort, head = sort or order, F.col(order[0])
    n, kind = df.count(), df.select(order[0]).schema[0].dataType
    share = F.pmod(F.xxhash64(*sort), F.lit(max(1, n // (RANGES * SAMPLED)))) == 0
    some = [r[0] for r in df.where(share & head.isNotNull()).select(order[0]).distinct().orderBy(order[0]).limit(16 * RANGES * SAMPLED).collect()]
    ends = some[:: max(1, -(-len(some) // RANGES))]
    if offset >= n or not ends:
        return df.orderBy(*sort).limit(0 if offset >= n else offset + limit).offset(offset)
    # Class 0 are nulls; an end has an even number, what lies below it the odd one before.
    of = F.when(head.isNull(), 0)
    for k, end in enumerate(ends):
        of = of.when(head < F.lit(end).cast(kind), 2 * k + 1).when(head == F.lit(end).cast(kind), 2 * k + 2)
    ranged = df.withColumn("_range", of.otherwise(2 * len(ends) + 1))
    held = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # twice RANGES and some rows at most
    before, some = 0, []
    for k in sorted(held):
        if before + held[k] > offset and before < offset + limit:
            some.append((k, before))
        before += held[k]
    skipped, picked = some[0][1], ranged.where(F.col("_range").isin([k for k, _ in some])).drop("_range")
    if len(some) == 1 and some[0][0] % 2 == 0 and order[1:]:
        return deep_page(picked, order[1:], offset - skipped, limit, sort)
    return picked.orderBy(*sort).limit(offset - skipped + limit).offset(offset - skipped)


def with_total(paged: DataFrame, matches: DataFrame, name: str = "total") -> DataFrame:
    """``paged`` with the number of all matches, whatever the page."""
    return paged.join(F.broadcast(matches.agg(F.count("*").alias(name))))


def first_of_each(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key: a minimum that is aggregated before the shuffle, by a digest of the key, not a sort of whole groups or long keys."""
    ranked = [F.col(c) if isinstance(c, str) else c for c in order]
    digest = F.sha2(F.concat_ws("\0", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys]), 256)
    first = df.groupBy(digest.alias("_digest")).agg(F.min_by(F.struct(*df.columns), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(ranked)])).alias("_first"))
    return first.select(*[F.col(f"_first.{c}").alias(c) for c in [*keys, *[c for c in df.columns if c not in keys]]])


def head_of_each(df: DataFrame, keys: list[str], order: list[str | Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key; Spark keeps that many per key and task before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")
