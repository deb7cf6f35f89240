"""Hamming links among 64-bit fingerprints by a hierarchical index over their Gray order.

The index has one tree for each choice of 2 of 6 bit blocks. A top node holds the fingerprints that share those
two blocks (its masked bit pattern); two fingerprints at 4 or fewer differing bits differ in 4 blocks at most and
so share a top node of at least one tree. Below a top node the fingerprints stand in the order of their Gray rank, where
neighbours share most bits; runs of them form nodes whose mask covers the bits that all members share. Two nodes
are compared on the bits that both masks cover, differences add up from level to level, and a pair of groups is
dropped whole once they exceed the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

DISTANCE = 4
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
MASKS = [sum(((1 << n) - 1) << at for at, n in pair) for pair in combinations(BLOCKS, 2)]
#: A top node with more than twice as many fingerprints is cut into segments of so many in Gray order, which are paired by runs of WIDE.
SEGMENT, WIDE = 2048, 64
#: Large top nodes that are broadcast at most.
BROADCAST = 10_000
LEAF, FANOUT = 32, 8


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(code: Column) -> Column:
    """Position of a code in the Gray sequence, as a signed long."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked rows a and b the smaller of their labels until nothing changes; labels are row numbers."""
    while a.size:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _nodes(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``size`` codes: the mask of the bits that a run shares, and the values of those bits."""
    at = np.arange(0, codes.size, size)
    ones, any_ = np.bitwise_and.reduceat(codes, at), np.bitwise_or.reduceat(codes, at)
    return ones | ~any_, ones


def tree_labels(codes: np.ndarray) -> np.ndarray:
    """Labels of the components of distinct ``codes`` (uint64, in Gray order) under links at DISTANCE or fewer bits."""
    labels = np.arange(codes.size)
    sizes = [LEAF]
    while sizes[-1] * FANOUT < codes.size:
        sizes.append(sizes[-1] * FANOUT)
    levels = [_nodes(codes, s) for s in sizes]
    top = np.arange(levels[-1][0].size)
    i, j = (x.ravel() for x in np.meshgrid(top, top, indexing="ij"))
    i, j = i[i <= j], j[i <= j]
    known, acc = np.zeros(i.size, np.uint64), np.zeros(i.size, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        mask, value = levels[depth]
        both = mask[i] & mask[j]
        acc = acc + np.bitwise_count((value[i] ^ value[j]) & both & ~known)  # only bits that no upper pair has counted
        near = acc <= DISTANCE
        i, j, known, acc = i[near], j[near], both[near], acc[near]
        if depth:
            n = levels[depth - 1][0].size
            step = np.arange(FANOUT)
            ci = (i[:, None, None] * FANOUT + step[None, :, None] + np.zeros((1, 1, FANOUT), np.int64)).ravel()
            cj = (j[:, None, None] * FANOUT + step[None, None, :] + np.zeros((1, FANOUT, 1), np.int64)).ravel()
            known, acc = np.repeat(known, FANOUT * FANOUT), np.repeat(acc, FANOUT * FANOUT)
            real = (ci <= cj) & (cj < n)
            i, j, known, acc = ci[real], cj[real], known[real], acc[real]
    order = np.argsort(j - i, kind="stable")  # near leaves first: what they join needs no more comparing
    i, j = i[order], j[order]
    inside, starts = np.arange(LEAF), np.arange(0, codes.size, LEAF)
    for k in range(0, i.size, 512):
        a, b = i[k : k + 512], j[k : k + 512]
        least, most = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
        open_ = (most[a] != least[a]) | (most[b] != least[b]) | (least[a] != least[b])
        a, b = a[open_], b[open_]
        x = (a[:, None, None] * LEAF + inside[None, :, None] + np.zeros((1, 1, LEAF), np.int64)).ravel()
        y = (b[:, None, None] * LEAF + inside[None, None, :] + np.zeros((1, LEAF, 1), np.int64)).ravel()
        real = (x < y) & (y < codes.size)
        x, y = x[real], y[real]
        linked = np.bitwise_count(codes[x] ^ codes[y]) <= DISTANCE
        hook(labels, x[linked], y[linked])
    return labels


def spanning_links(group: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components within each run of equal ``group``: (code, code of its component's first)."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if group.size else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, group.size])
    labels = np.arange(group.size)
    for s, n in zip(start[size > LEAF], size[size > LEAF]):
        labels[s : s + n] = s + tree_labels(codes[s : s + n])
    small = np.flatnonzero(np.repeat((size > 1) & (size <= LEAF), size))
    end = np.repeat(start + size, size)
    for d in range(1, int(size[size <= LEAF].max(initial=1))):
        small = small[small + d < end[small]]
        a, b = small, small + d
        linked = np.bitwise_count(codes[a] ^ codes[b]) <= DISTANCE
        hook(labels, a[linked], b[linked])
    u = np.flatnonzero(labels != np.arange(group.size))
    return codes[u], codes[labels[u]]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, fp) in the order of task and Gray rank in, spanning links (u, v) out; a run may cross batches."""
    task, codes = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(t: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        u, v = spanning_links(t, c)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        task = np.r_[task, batch.column(0).to_numpy(zero_copy_only=False)]
        codes = np.r_[codes, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        if task.size:
            cut = int(np.flatnonzero(task != task[-1])[-1]) + 1 if task[0] != task[-1] else 0
            if cut:
                yield links(task[:cut], codes[:cut])
            task, codes = task[cut:], codes[cut:]
    if task.size:
        yield links(task, codes)


def _run(rows: DataFrame) -> DataFrame:
    """Links within the tasks of rows (task, fp)."""
    rank = gray_rank(F.col("fp"))
    return rows.repartition("task").sortWithinPartitions("task", rank).select("task", "fp").mapInArrow(_link_batches, "u long, v long")


def _segments(hot: DataFrame) -> DataFrame:
    """(top, fp, seg) of rows (top, fp, rank): a top node's fingerprints in the order of their Gray rank, SEGMENT to a segment.

    Rows are dealt by ranges and numbered within each; the few counts of ranges give where each begins.
    """
    n = hot.count()
    dealt = materialise(hot.repartitionByRange(max(1, -(-n // (8 * SEGMENT))), "top", "rank").select("top", "fp", "rank", F.spark_partition_id().alias("range")))
    before = Window.partitionBy("top").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("top", "range").agg(F.count("*").alias("n")).select("top", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("top", "range").orderBy("rank")) - 1
    placed = dealt.withColumn("number", number).join(counts, ["top", "range"])
    return materialise(placed.select("top", "fp", F.floor((F.col("base") + F.col("number")) / SEGMENT).alias("seg")))


def _near_segments(segments: DataFrame) -> DataFrame:
    """(top, seg, seg2) of the pairs of segments of a top node whose shared bits differ in DISTANCE places at most.

    Runs of WIDE segments are compared first, and only the segments of near runs after them.
    """
    apart = F.bit_count(F.expr("(ones & ~some2) | (ones2 & ~some)")) <= DISTANCE
    wide = segments.groupBy("top", F.floor(F.col("seg") / WIDE).alias("run")).agg(F.bit_and("ones").alias("ones"), F.bit_or("some").alias("some"))
    second = wide.select("top", F.col("run").alias("run2"), F.col("ones").alias("ones2"), F.col("some").alias("some2"))
    runs = wide.join(second, "top").where((F.col("run") <= F.col("run2")) & apart).select("top", "run", "run2")
    first = segments.withColumn("run", F.floor(F.col("seg") / WIDE))
    second = first.select("top", F.col("run").alias("run2"), F.col("seg").alias("seg2"), F.col("ones").alias("ones2"), F.col("some").alias("some2"))
    return runs.join(first, ["top", "run"]).join(second, ["top", "run2"]).where((F.col("seg") <= F.col("seg2")) & apart).select("top", "seg", "seg2")


def gray_links(codes: DataFrame) -> DataFrame:
    """Links (u, v) that span the components of the distinct long column ``fp`` under DISTANCE or fewer differing bits."""
    trees = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("tree"), F.lit(signed(m)).alias("mask")) for k, m in enumerate(MASKS)])
    nodes = codes.select("fp", F.explode(trees).alias("t")).select(F.xxhash64("t.tree", F.col("fp").bitwiseAND(F.col("t.mask"))).alias("top"), "fp")
    large = materialise(nodes.groupBy("top").agg(F.count("*").alias("n")).where(F.col("n") > 2 * SEGMENT))
    cold = _run(nodes.join(large, "top", "left_anti").select(F.col("top").alias("task"), "fp"))

    hot = nodes.join(F.broadcast(large.drop("n")), "top") if large.count() <= BROADCAST else nodes.join(large.drop("n"), "top")
    rows = _segments(hot.withColumn("rank", gray_rank(F.col("fp"))))
    segments = materialise(rows.groupBy("top", "seg").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("some")))
    sides = _near_segments(segments).select("top", F.xxhash64("top", "seg", "seg2").alias("task"), F.explode(F.array_distinct(F.array("seg", "seg2"))).alias("seg"))
    return cold.unionByName(_run(rows.join(sides, ["top", "seg"]).select("task", "fp")))
