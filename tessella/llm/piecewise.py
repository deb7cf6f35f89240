"""Context-triggered piecewise hashes of texts and their likeness (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of

#: Bytes that decide whether a chunk ends, chunks of a signature at most, and characters that two signatures must share in a row.
WINDOW, SIGNATURE, COMMON = 7, 64, 7
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_POWERS: dict[str, np.ndarray] = {}
BATCH = 64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd base and of its inverse, modulo 2**64."""
    if not _POWERS or _POWERS["up"].size <= n:
        size = max(n + 1, 1 << 17)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def fingerprint(data: bytes) -> str:
    """``level:signature:signature of level + 1`` of a text's bytes.

    A chunk ends where the rolling hash of the last WINDOW bytes has ``level`` zero bits at its top, so that a change moves only
    the ends near it. Each chunk's bytes give one character. The level is the least at which there are SIGNATURE chunks
    at most, so that both signatures cover the whole text.
    """
    n = len(data)
    if not n:
        return "0::"
    padded = np.zeros(n + 8, np.uint8)
    padded[8:] = np.frombuffer(data, np.uint8)
    windows = np.lib.stride_tricks.as_strided(padded[1:], (n, 8), (1, 1))
    rolled = windows.copy().view("<u8").ravel()
    rolled &= np.uint64(0xFFFFFFFFFFFFFF00)  # the last WINDOW of 8 bytes
    rolled *= _ROLL
    rolled ^= rolled >> np.uint64(32)
    rolled *= _ROLL
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((padded[8:].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])

    def ends(level: int) -> np.ndarray:
        at = np.flatnonzero(rolled >> np.uint64(64 - level) == 0) + 1 if level else np.arange(1, n + 1)
        return at if at.size and at[-1] == n else np.r_[at, n]

    level = max(0, (n // SIGNATURE).bit_length() - 1)
    while level and ends(level - 1).size <= SIGNATURE:
        level -= 1
    while ends(level).size > SIGNATURE:
        level += 1
    out = []
    for at in (ends(level), ends(level + 1)):
        start = np.r_[0, at[:-1]]
        digest = (sums[at] - sums[start]) * down[start]
        digest ^= digest >> np.uint64(33)
        digest *= _ROLL
        out.append(ALPHABET[(digest >> np.uint64(58)).astype(np.int64)].tobytes().decode())
    return f"{level}:{out[0]}:{out[1]}"


def edit_distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Levenshtein distances of pairs of signatures of 64 characters at most, all pairs at once, by bit-parallel rows."""
    count = len(left)
    if not count:
        return np.zeros(0, np.int64)
    one = np.uint64(1)
    m, k = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    a = np.frombuffer(b"".join(x.ljust(SIGNATURE, b"\0") for x in left), np.uint8).reshape(count, SIGNATURE)
    b = np.frombuffer(b"".join(x.ljust(SIGNATURE, b"\0") for x in right), np.uint8).reshape(count, SIGNATURE)
    match = np.zeros((count, 128), np.uint64)
    for i in range(int(m.max())):
        rows = np.flatnonzero(i < m)
        match[rows, a[rows, i]] |= one << np.uint64(i)
    plus, minus, score = np.full(count, ~np.uint64(0)), np.zeros(count, np.uint64), m.astype(np.int64).copy()
    last = one << np.maximum(m - 1, 0).astype(np.uint64)
    every = np.arange(count)
    for j in range(int(k.max())):
        live = (j < k) & (m > 0)
        eq = match[every, b[:, j]]
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | x
        h_plus, h_minus = minus | ~(d | plus), plus & d
        score += np.where(live & (h_plus & last != 0), 1, 0) - np.where(live & (h_minus & last != 0), 1, 0)
        h_plus, h_minus = h_plus << one | one, h_minus << one
        plus, minus = np.where(live, h_minus | ~(x | h_plus), plus), np.where(live, h_plus & x, minus)
    return np.where(m == 0, k, score)


def _share(a: bytes, b: bytes) -> bool:
    """Whether two signatures have COMMON characters in a row in common; for short ones, half the shorter one."""
    n = min(COMMON, max(1, min(len(a), len(b)) // 2))
    return not {a[i : i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i : i + n] for i in range(len(b) - n + 1))


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness (0 to 1) of pairs of fingerprints: 1 less the edit distance over the longer length, at the best common level.

    Equal fingerprints give 1. Levels that differ by more than one aren't compatible and give 0, as do signatures
    without COMMON equal characters in a row (half the shorter one, if that is less), which chance makes a little alike.
    """
    out, pairs = np.zeros(len(left)), []
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[i] = 1.0
            continue
        (kx, *sx), (ky, *sy) = x.split(":"), y.split(":")
        kx, ky = int(kx), int(ky)
        for level in {kx, kx + 1} & {ky, ky + 1}:
            a, b = sx[level - kx].encode(), sy[level - ky].encode()
            if _share(a, b):
                pairs.append((i, a, b))
    if pairs:
        rows, a, b = zip(*pairs)
        longest = np.array([max(len(x), len(y)) for x, y in zip(a, b)])
        np.maximum.at(out, np.array(rows), 1 - edit_distances(list(a), list(b)) / longest)
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by as many characters of the next document, or all that it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _pairs(kind: pa.DataType):
    """Sorted documents (doc_id, text) in; out: a result row for each but the last, and two rows with the ends of the partition."""
    schema = pa.schema(
        [("doc_id", kind), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
        + [("part", pa.int32()), ("end", pa.string()), ("text", pa.string())]
    )

    def results(ids: list, texts: list[str], prints: list[str], part: int) -> pa.RecordBatch:
        """Rows for all but the last text."""
        news = [edited(a, b) for a, b in zip(texts, texts[1:])]
        new_prints = [p if new == old else fingerprint(new.encode()) for old, new, p in zip(texts, news, prints)]
        n = len(news)
        return pa.RecordBatch.from_pydict(
            {"doc_id": ids[:n], "n_chars": list(map(len, texts[:n])), "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in news], "fingerprint": prints[:n], "edited_fingerprint": new_prints}
            | {"near_edited": likeness(prints[:n], new_prints), "near_next": likeness(prints[:n], prints[1:]), "part": [part] * n, "end": [None] * n, "text": [None] * n},
            schema=schema,
        )

    def ends(part: int, first: tuple, last: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [None, None] for n in schema.names} | {"doc_id": [first[0], last[0]], "part": [part] * 2, "end": ["first", "last"], "text": [first[1], last[1]]}, schema=schema)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, ids, texts, prints = TaskContext.get().partitionId(), None, [], [], []
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                rows = batch.slice(k, BATCH)
                new = rows.column(1).to_pylist()
                ids, texts, prints = ids + rows.column(0).to_pylist(), texts + new, prints + [fingerprint(t.encode()) for t in new]
                first = first or (ids[0], texts[0])
                if len(ids) > 1:
                    yield results(ids, texts, prints, part)
                ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
        if first:
            yield ends(part, first, (ids[0], texts[0]))

    def seam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, text, next) in: the last row of each partition with the first text of the next one."""
        for batch in batches:
            for i, text, following in zip(*(c.to_pylist() for c in batch.columns)):
                yield results([i, None], [text, following], [fingerprint(text.encode()), fingerprint(following.encode())], 0)

    return inner, seam


def piecewise_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next in descending doc_id, equal ids by a hash of the text, null ids after all others; after the last
    comes the first, so that a table of one row has itself next. Null texts count as empty. Equal texts have equal
    fingerprints, empty ones "0::". An empty table gives none. Other columns of ``docs`` are not looked at.

    Texts are shuffled once, by ranges of doc_id. Within a range a row finds its next document beside it; the two ends of
    each range are written aside and joined by the number of the range.
    """
    text = text_of(text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    inner, seam = _pairs(to_arrow_type(source.schema["doc_id"].dataType))
    columns = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, end string, text string"
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(source.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").mapInArrow(inner, columns))
    end = rows.where("end is not null").select("part", "end", "doc_id", "text")
    # One row per range: its number among the ranges with rows, in which the last is followed by the first.
    firsts, lasts = end.where("end = 'first'").drop("end"), end.where("end = 'last'").drop("end")
    ranges = firsts.select("part").withColumn("next_part", F.lead("part").over(Window.orderBy("part")))
    ranges = ranges.withColumn("next_part", F.coalesce("next_part", F.min("part").over(Window.partitionBy())))
    follow = firsts.select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    seams = lasts.join(ranges, "part").join(follow, "next_part").select("doc_id", "text", "following").mapInArrow(seam, columns)
    return rows.where("end is null").unionByName(seams).drop("part", "end", "text")
