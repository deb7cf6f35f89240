"""Vector codes by product quantisation whose codebooks are fitted by Yinyang Lloyd rounds, in integers throughout (operator 12).

The entries of a codebook are put into groups. Of every part of a vector the rounds carry its entry, an upper bound of the distance to it and, for each
group, a lower bound of the distance to the group's other entries. After a round bounds drift by as much as the entries have moved; a part is compared
with the entries of those groups alone whose bound no longer rules them out. Distances are sums of squares of integers, which decide ties exactly; bounds
are rounded outwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, heavy_join, materialise

PARTS, ENTRIES, ROUNDS, GROUPS, SCALE = 4, 256, 4, 16, 1024
#: Below this size of components sums of squared differences are exact in double precision; beyond it whole numbers of any size are used.
EXACT = 1 << 20
#: Numbers are summed in limbs of so many bits, so that no sum over four thousand million rows leaves a long.
LIMB = 31

ORACLE_HEAD = """WITH RECURSIVE k AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT len(e) // 4 AS d FROM k ORDER BY n LIMIT 1),
x AS (SELECT n, p, list_transform(e[p * d + 1 : (p + 1) * d], lambda v: CAST(floor(1024 * v) AS BIGINT)) AS v FROM k, w, (SELECT unnest(range(4)) AS p)),
b0 AS (SELECT p, n AS c, v FROM x WHERE n < 256)"""


def _oracle() -> str:
    """The rounds written out: assign every part, then replace entries by the floor of their parts' means."""
    out = ORACLE_HEAD
    for i in range(ROUNDS + 1):
        d = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        out += f",\na{i} AS MATERIALIZED (SELECT n, p, c, s FROM (SELECT x.n, x.p, min(CAST({d} AS BIGINT) * 256 + b.c) AS k FROM x JOIN b{i} b ON b.p = x.p GROUP BY x.n, x.p) t, LATERAL (SELECT k % 256 AS c, k // 256 AS s))"
        if i < ROUNDS:
            out += f""",\nm{i} AS (SELECT p, c, list(v ORDER BY pos) AS v FROM (SELECT a.p, a.c, pos, CAST(floor(sum(x.v[pos]) / count(*)) AS BIGINT) AS v FROM a{i} a JOIN x USING (n, p), w, (SELECT unnest(range(1, 4097)) AS pos) q WHERE pos <= d GROUP BY a.p, a.c, pos) GROUP BY p, c),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.c, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.c = b.c)"""
    return out + f""",
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM b{ROUNDS}),
r AS (SELECT n, string_agg(printf('%02x', c), '' ORDER BY p) AS code, CAST(sum(s) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN r USING (n), h"""


ORACLE = _oracle()


def valid(vec: Column) -> Column:
    """Whether a vector is not null, not empty, and all its components are finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(vec) > 0), F.lit(False))


def whole(vec: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as integers: longs where all are small, else whole numbers of any size."""
    big = np.abs(vec).max(initial=0.0) * SCALE >= EXACT
    if not big:
        return np.floor(vec.astype(np.float64) * SCALE).astype(np.int64)
    exact = np.empty(vec.shape, object)
    for i, x in np.ndenumerate(vec):
        top, bottom = float(x).as_integer_ratio()
        exact[i] = top * SCALE // bottom
    return exact


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows by entries)."""
    if x.dtype == object or entries.dtype == object:
        return ((x.astype(object)[:, None, :] - entries.astype(object)[None, :, :]) ** 2).sum(axis=2)
    a, b = x.astype(np.float64), entries.astype(np.float64)
    return (np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2.0 * (a @ b.T)).astype(np.int64)


def _root(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots as floats of four bytes, rounded up or down; what is beyond such a float counts as infinite or as its largest."""
    with np.errstate(over="ignore"):
        # Whole numbers beyond a double overflow to infinity, an upper bound still.
        f = np.sqrt(np.array([float(s) if s < 1 << 1000 else np.inf for s in squares.ravel()]).reshape(squares.shape)) if squares.dtype == object else np.sqrt(squares.astype(np.float64))
        f32 = f.astype(np.float32)
    return np.nextafter(f32, np.float32(np.inf)) if up else np.maximum(np.float32(0), np.nextafter(np.minimum(f32, np.finfo(np.float32).max), np.float32(-np.inf)))


def grouped(entries: np.ndarray) -> np.ndarray:
    """The group of each entry: farthest-first centres, then each entry to its nearest."""
    k = min(GROUPS, len(entries))
    centres, near = [0], _distances(entries, entries[:1])[:, 0]
    while len(centres) < k:
        centres.append(int(near.argmax()))
        near = np.minimum(near, _distances(entries, entries[centres[-1:]])[:, 0])
    return _distances(entries, entries[centres]).argmin(axis=1)


class Codebook:
    """The entries of one part position, their groups, and how far entries and groups have moved since the round before."""

    def __init__(self, entries: np.ndarray, group: np.ndarray, before: np.ndarray | None = None):
        self.entries, self.group = entries, group
        self.members = [np.flatnonzero(group == g) for g in range(int(group.max(initial=-1)) + 1)]
        moved = np.zeros(len(entries), object) if before is None else ((entries.astype(object) - before.astype(object)) ** 2).sum(axis=1)
        self.drift = _root(moved.astype(object), up=True).astype(np.float32) if before is not None else np.zeros(len(entries), np.float32)
        self.drift[moved == 0] = 0
        self.group_drift = np.array([self.drift[m].max(initial=0) for m in self.members], np.float32)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(entry, its squared distance, lower bounds by group, compared pairs) of parts that have no bounds yet."""
        d = _distances(x, self.entries)
        at = d.argmin(axis=1)
        best = d[np.arange(len(x)), at]
        d[np.arange(len(x)), at] = np.iinfo(np.int64).max if d.dtype != object else 1 << 2000
        return at, best, np.stack([_root(d[:, m].min(axis=1), up=False) for m in self.members], axis=1)

    def again(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry, upper bound, lower bounds, how many parts and groups were compared) after the entries have moved."""
        at, upper = at.copy(), np.nextafter(upper + self.drift[at], np.float32(np.inf))
        lower = np.maximum(np.float32(0), np.nextafter(lower - self.group_drift, np.float32(-np.inf)))
        lower = np.where(self.group_drift == 0, np.maximum(lower, 0), lower)
        open_ = np.flatnonzero(lower.min(axis=1) <= upper)
        scanned = 0
        if open_.size:
            mine = self._to(x[open_], at[open_])
            upper[open_] = _root(mine, up=True)
            still = lower[open_] <= upper[open_][:, None]
            best, best_at, old, old_d = mine.copy(), at[open_].copy(), at[open_], mine
            for g, members in enumerate(self.members):
                rows = np.flatnonzero(still[:, g])
                if not rows.size:
                    continue
                scanned += rows.size
                d = _distances(x[open_[rows]], self.entries[members])
                if d.dtype != object and best.dtype == object:
                    d = d.astype(object)
                own = members[None, :] == old[rows][:, None]
                d[own] = np.iinfo(np.int64).max if d.dtype != object else 1 << 2000
                k = d.argmin(axis=1)
                least, which = d[np.arange(rows.size), k], members[k]
                lower[open_[rows], g] = _root(least, up=False)
                closer = (least < best[rows]) | ((least == best[rows]) & (which < best_at[rows]))
                best[rows[closer]], best_at[rows[closer]] = least[closer], which[closer]
            moved = np.flatnonzero(best_at != old)
            if moved.size:
                # The entry that was left is one of its group's others now, and the new one is none of them: its group's bound stays one.
                g = self.group[old[moved]]
                rows = open_[moved]
                lower[rows, g] = np.minimum(lower[rows, g], _root(old_d[moved], up=False))
                at[rows], upper[rows] = best_at[moved], _root(best[moved], up=True)
        return at, upper, lower, scanned

    def _to(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        if x.dtype == object or self.entries.dtype == object:
            return ((x.astype(object) - self.entries[at].astype(object)) ** 2).sum(axis=1)
        return ((x - self.entries[at]) ** 2).sum(axis=1)


def limbs(n: int, count: int) -> list[int]:
    """A whole number in limbs, the last of which has its sign."""
    out = []
    for _ in range(count - 1):
        out.append(n & ((1 << LIMB) - 1))
        n >>= LIMB
    return [*out, n]


def cuts(dim: int) -> list[slice]:
    """Where the parts of a vector stand; where its length is no multiple of PARTS the first ones are longer by one."""
    ends = np.cumsum([0, *[dim // PARTS + (p < dim % PARTS) for p in range(PARTS)]])
    return [slice(int(a), int(b)) for a, b in zip(ends, ends[1:])]


_STATE = "key long, vec array<double>, code binary, upper binary, lower binary, part int, entry int, n long, sums array<long>"


def _round(books: list[Codebook], dim: int, words: int, final: bool):
    """A task of a round: rows with their new state, and after them the sums of each entry's parts in the task; of the final round codes and errors."""
    at_part = cuts(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b.entries), np.int64) for b in books]
        sums = [np.zeros((len(b.entries), s.stop - s.start), object) for b, s in zip(books, at_part)]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = whole(batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(n, dim))
            codes, uppers, lowers, errors = np.zeros((n, PARTS), np.uint8), [], [], np.zeros(n, object)
            known = batch.column("code").null_count == 0
            if known:
                old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, PARTS)
                old_upper = np.frombuffer(b"".join(batch.column("upper").to_pylist()), np.float32).reshape(n, PARTS)
                old_lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), np.float32).reshape(n, -1)
            place = 0
            for p, (book, cut) in enumerate(zip(books, at_part)):
                part, wide = x[:, cut], len(book.members)
                if known:
                    at, upper, lower, _ = book.again(part, old[:, p].astype(np.int64), old_upper[:, p], old_lower[:, place : place + wide])
                else:
                    at, best, lower = book.first(part)
                    upper = _root(best, up=True)
                place += wide
                codes[:, p] = at
                if final:
                    errors = errors + book._to(part, at)
                    continue
                uppers.append(upper)
                lowers.append(lower)
                counts[p] += np.bincount(at, minlength=len(book.entries))
                if part.dtype == object:
                    np.add.at(sums[p], at, part)
                else:
                    add = np.stack([np.bincount(at, part[:, k], len(book.entries)) for k in range(part.shape[1])], axis=1) if part.shape[1] else np.zeros((len(book.entries), 0))
                    sums[p] = sums[p] + add.astype(np.int64).astype(object)
            key = batch.column("key")
            if final:
                code = [row.tobytes().hex() for row in codes]
                yield pa.RecordBatch.from_arrays([key, pa.array(code), pa.array([str(int(e)) for e in errors])], ["key", "code", "error"])
                continue
            bytes_of = lambda a: pa.array([row.tobytes() for row in a], pa.binary())
            state = [key, batch.column("vec"), bytes_of(codes), bytes_of(np.stack(uppers, axis=1).astype(np.float32)), bytes_of(np.concatenate(lowers, axis=1).astype(np.float32))]
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*state, *none], _NAMES)
        if not final:
            rows = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c)]
            if rows:
                values = [[limb for v in sums[p][e] for limb in limbs(int(v), words)] for p, e in rows]
                none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, pa.array([p for p, _ in rows], pa.int32()), pa.array([int(e) for _, e in rows], pa.int32()), pa.array([int(counts[p][e]) for p, e in rows]), pa.array(values, pa.list_(pa.int64()))], _NAMES)

    return run


_NAMES = [x.split()[0] for x in _STATE.split(", ")]


def quantise(rows: DataFrame, dim: int, largest: float, first: list[np.ndarray]) -> tuple[DataFrame, list[Codebook]]:
    """(key, code, error as a decimal number) of rows (key, vec: all of length ``dim``), and the codebooks that the rounds end with.

    ``first`` has the initial entries of each part. Each round reads what the one before it wrote, once, and writes state and sums together; what comes to
    the driver is one sum for each entry and component.
    """
    words = max(1, -(-(int(min(largest, 1e300)) * SCALE + SCALE).bit_length() // LIMB)) + 1
    books = [Codebook(e, grouped(e)) for e in first]
    none = F.lit(None)
    state = rows.select("key", "vec", *[none.cast("binary").alias(c) for c in ("code", "upper", "lower")])
    for i in range(ROUNDS):
        made = materialise(state.mapInArrow(_round(books, dim, words, False), _STATE))
        total = made.where("part is not null").select("part", "entry", "n", F.posexplode("sums").alias("pos", "v")).groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        entries = [b.entries.astype(object) for b in books]
        sums: dict = {}
        for r in total.collect():  # entries times components times limbs, whatever the number of rows
            n, value = sums.get((r.part, r.entry, r.pos // words), (r.n, 0))
            sums[r.part, r.entry, r.pos // words] = (n, value + (r.v << LIMB * (r.pos % words)))
        for (p, e, k), (n, value) in sums.items():
            entries[p][e, k] = value // n
        entries = [e if max((abs(int(v)) for v in e.ravel()), default=0) >= EXACT else e.astype(np.int64) for e in entries]
        books = [Codebook(e, b.group, b.entries) for e, b in zip(entries, books)]
        if i:
            forget(state)
        state = made.where("part is null").select("key", "vec", "code", "upper", "lower")
    return materialise(state.mapInArrow(_round(books, dim, words, True), "key long, code string, error string")), books


def codebook_text(books: list[Codebook]) -> str:
    return ",".join(str(int(v)) for b in books for v in b.entries.ravel())


def encode_embeddings(embeddings: DataFrame) -> DataFrame:
    """One row per vector that is kept: vec_id, code, error, label_error, codebooks_sha256.

    A vector that is null or empty or holds null or non-finite components is dropped, and so is one whose length is not that of the kept vector of
    smallest vec_id (of several with one vec_id, the smallest by its components; a null vec_id is the largest). Repeated rows are coded each for itself. A
    length that 4 doesn't divide gives first parts that are longer by one. With fewer than 256 vectors the codebooks have so many entries. Components of any size are
    computed with exactly; an error beyond a long is its largest value. An empty table gives an empty result; other columns are not looked at.
    """
    vec = F.col("embedding").cast("array<double>")
    good = embeddings.where(valid(F.col("embedding"))).select("vec_id", F.col("label").cast("string").alias("label"), vec.alias("vec"))
    order = [F.col("vec_id").asc_nulls_last(), "vec"]
    head = good.orderBy(*order).first()
    if head is None:
        return good.select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    dim = len(head.vec)
    good = materialise(good.where(F.size("vec") == dim).withColumn("key", F.monotonically_increasing_id()))
    some = np.array([r.vec for r in good.orderBy(*order).limit(ENTRIES).collect()], float)
    largest = good.agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x))))).first()[0]
    start = whole(some)
    codes, books = quantise(good.select("key", "vec"), dim, largest, [start[:, c] for c in cuts(dim)])
    error = F.least(F.col("error").cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    # An error that even the decimal does not hold is beyond a long too.
    coded = materialise(good.select("key", "vec_id", "label").join(codes, "key").select("vec_id", F.coalesce("label", F.lit("\0null")).alias("_label"), "code", F.when(F.length("error") > 19, F.lit((1 << 63) - 1)).otherwise(error).alias("error")))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy("_label").agg(total.alias("label_error"), F.count("*").alias("n"))
    out = heavy_join(coded, by_label, "_label", "n", coded.count())
    digest = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
