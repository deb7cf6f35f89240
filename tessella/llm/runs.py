"""Periodic runs of words by Lyndon arrays on an ordered alphabet (operator 13).

The Lyndon array of a text says where the longest Lyndon word from each place ends: at the next smaller suffix. For one of the two orders of the alphabet the
periods of a run are such words. A pass from left to right keeps the places whose next smaller suffix is still to come on a stack and compares their suffixes
with the current one. What two suffixes on the stack share tells how much the current one shares with the lower of them, and places within an extension that has
been matched before take over what was found at the places that it was matched with. So words are compared beyond the rightmost place alone
that a match has reached, which passes over a text once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: A run has so many words at least, and so many periods.
WORDS, PERIODS = 24, 3


def lyndon_array(word: list[int]) -> tuple[list[int], list[int]]:
    """(end, share) by place: the next place whose suffix is smaller (the text's length if none), and how many words the two suffixes share.

    ``word`` has numbers in the order of the alphabet; a suffix that another one begins with is the smaller of the two.
    """
    n = len(word)
    end, share = [n] * n, [0] * n
    # The next lower place on the stack, whose suffix is smaller, and what it shares with this one.
    below, common = [-1] * n, [0] * n
    # The words from ``right`` up to ``reach`` are those from ``left`` on; both places have been compared.
    left = right = reach = 0
    for i in range(1, n):
        top, shared, compare = i - 1, 0, True
        if i < reach:
            back = right - left
            at = i - back
            while True:
                other = top - back
                popped = end[other] == at
                shared = share[other] if popped else common[at]
                if i + shared >= reach:  # as far as is known: go on from there
                    shared = reach - i
                    break
                if not popped:
                    compare = False
                    break
                end[top], share[top] = i, shared
                top = below[top]
        while compare:
            a, b = top + shared, i + shared
            while b < n and word[a] == word[b]:
                a += 1
                b += 1
            shared, left, right, reach = b - i, top, i, b
            if b < n and word[a] < word[b]:
                break
            while True:
                end[top], share[top], known, top = i, shared, common[top], below[top]
                if top < 0 or shared >= known:
                    break
            # What the one above shared with this one is less than what it shares with the current one: that decides.
            if top < 0 or shared > known:
                shared, compare = known if top >= 0 else 0, False
        below[i], common[i] = top, shared
    return end, share


def periodic_runs(word: list[int], words: int = WORDS, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``words`` words and ``periods`` (2 at least) periods at least, in order."""
    found, n = set(), len(word)
    for order in (word, [-w for w in word]):
        end, share = (np.array(x, np.int64) for x in lyndon_array(order))
        period = end - np.arange(n)
        # The first of a run's Lyndon words: at least one period follows it (most of one, where two periods are enough), and none is before it.
        some = np.flatnonzero((share + period >= period * (periods - 1)) & (share > 0))
        for i in map(int, some):
            p = int(period[i])
            if i >= p and end[i - p] == i and share[i - p] >= p:
                continue
            more = 0
            while i > more and word[i - more - 1] == word[i + p - more - 1]:
                more += 1
            length = p + int(share[i]) + more
            if length >= max(words, periods * p):
                found.add((i - more, length, p))
    return sorted(found)


def _stretches(word: np.ndarray, words: int, periods: int) -> list[tuple[int, int]]:
    """Stretches (low, high) without any word that occurs too seldom to stand in a run."""
    often = np.concatenate([[False], np.bincount(word)[word] >= periods, [False]]) if word.size else np.zeros(2, bool)
    turns = np.flatnonzero(np.diff(often.astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(turns[::2], turns[1::2]) if b - a >= words]


def runs_of(word: list[int], words: int = WORDS, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """:func:`periodic_runs` of a text. Each word of a run stands in it once a period at least, and one more neighbour would too: a text falls apart at words that are fewer, and so do its parts."""
    every = np.array(word, np.int64)
    out = []
    for a, b in _stretches(every, words, periods):
        for c, d in _stretches(np.unique(every[a:b], return_inverse=True)[1], words, periods):
            out += [(a + c + start, length, p) for start, length, p in periodic_runs(word[a + c : a + d], words, periods)]
    return out


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """The words, of which those from some place on repeat where the id's checksum ends in 0. Without an id they stay as they are."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def describe(words: list[bytes]) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of a text's words."""
    number: dict[bytes, int] = {}
    runs = runs_of([number.setdefault(w, len(number)) for w in words])
    best, kept = (None, None, None, None), words
    if runs:
        start, length, p = min(runs, key=lambda r: (-(r[1] << 64) // r[2], r[0], r[2]))
        best = (start, length, p, 1000 * length // p)
        drop = np.zeros(len(words), bool)
        for s, size, q in runs:
            drop[s + q : s + size] = True
        kept = [w for w, out in zip(words, drop.tolist()) if not out]
    text = "".join(f"{s},{size},{q}\n" for s, size, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (len(runs), *best, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


_MADE = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def document_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    Words are what ASCII white space parts; a null text has none, as an empty one. A text without a run has n_runs 0, four nulls, and the digest of nothing. Repeated rows
    have a row each; a null id has its words as they stand. Of runs with one exponent the first counts, then that of the smaller
    period. A text is worked on whole and by itself, in a time that grows with its words. An empty table gives an empty result; other columns are not looked at.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows = [describe(planted(texts[k].as_py().split(), ids[k].as_py())) for k in range(batch.num_rows)]
            columns = [pa.array([r[k] for r in rows], pa.int64() if k < 5 else pa.string()) for k in range(len(_MADE))]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *_MADE])

    words = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("_text"))
    return words.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} {'long' if k < 5 else 'string'}" for k, c in enumerate(_MADE)))
