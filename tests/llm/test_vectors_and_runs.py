"""Operators 11 to 13 against brute force on small tables with nulls, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

from tessella.llm import metric_join, queries, runs, yinyang

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int"


def vectors(seed, n=260, dim=8):
    """Loose and tight groups of vectors, multiples, repeated rows, and rows that are not usable."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=dim) * rng.choice([0.02, 0.15, 0.3]) if i % 3 else rng.normal(size=dim)
        rows.append((i, [float(x) for x in v * rng.choice([1, 40])], int(rng.integers(2)) if i % 11 else None))
    rows += [(n + i, rows[5 * i][1], rows[5 * i][2]) for i in range(12)]
    rows += [(3, rows[3][1], 1), (None, rows[4][1], 0), (n + 50, None, 1), (n + 51, [0.0] * dim, 1), (n + 52, [1.0, None] * (dim // 2), 1), (n + 53, [math.nan] * dim, 1), (n + 54, [math.inf] + [0.0] * (dim - 1), 0), (n + 55, [1.0, 2.0], 0), (n + 56, [2.0, 4.0], 0), (n + 57, [], 0)]
    return rows


def linked(rows):
    """(vec_id, n_links, component_id, kept) of each row, by comparing all."""
    usable = [v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    cos = lambda a, b: float(np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))))
    links = {i: [j for j in range(len(rows)) if i != j and usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= metric_join.COSINE] for i in range(len(rows))}
    out = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell,chunk,levels", [(1024, 1 << 15, 3), (16, 40, 3), (20, 60, 1), (8, 30, 0)])
def test_metric_join(spark, cell, chunk, levels):
    rows = vectors(cell)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS + ", _key string, node int").repartition(5)
    found = metric_join.link_embeddings(df, cell, chunk, levels)
    assert sorted((tuple(r) for r in found.collect()), key=str) == linked(rows)


def test_one_tight_group_is_counted_and_not_compared(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in centre + rng.normal(size=16) * 0.01], 1) for i in range(900)]
    df = spark.createDataFrame(rows, VECTORS)
    made = metric_join.class_links(df.selectExpr("cast(label as string) as unit", "vec_id as node", "1L as w", "embedding as vec"), cell=64, chunk=300)
    assert {r.links for r in made[0].collect()} == {899}
    # Links that are certain have an edge for a row and cell at most, not one for each pair.
    assert made[1].count() < 900 * metric_join.FAN
    assert {(r.n_links, r.component_id) for r in metric_join.link_embeddings(df, 64, 300).collect()} == {(899, 0)}


def test_vectors_of_an_empty_table(spark):
    none = spark.createDataFrame([], VECTORS)
    assert metric_join.link_embeddings(none).collect() == [] and yinyang.encode_embeddings(none).collect() == []
    alone = spark.createDataFrame([(7, None, 1), (None, [1.0], None)], VECTORS)
    assert sorted((tuple(r) for r in metric_join.link_embeddings(alone).collect()), key=str) == [(7, 0, 7, True), (None, 0, None, True)]
    assert yinyang.encode_embeddings(alone.where("vec_id = 7")).collect() == []


def coded(rows):
    """(vec_id, code, error, label_error, digest) with whole numbers of any size, comparing everything."""
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    cut = yinyang.cuts(len(good[0][1]))
    whole = lambda x: x.as_integer_ratio()[0] * 1024 // x.as_integer_ratio()[1]
    parts = [[[whole(float(x)) for x in r[1][c]] for r in good] for c in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[list(v) for v in p[:256]] for p in parts]
    near = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(4):
        for p, book in zip(parts, books):
            own = collections.defaultdict(list)
            for v in p:
                own[near(v, book)].append(v)
            for e, vs in own.items():
                book[e] = [sum(c) // len(vs) for c in zip(*vs)]
    codes = [[near(p[i], book) for p, book in zip(parts, books)] for i in range(len(good))]
    errors = [sum(far(p[i], book[c]) for p, book, c in zip(parts, books, codes[i])) for i in range(len(good))]
    by = collections.Counter()
    for r, e in zip(good, errors):
        by[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for v in book for x in v).encode()).hexdigest()
    top = (1 << 63) - 1
    return sorted(((r[0], "".join(f"{c:02x}" for c in code), min(e, top), min(by[r[2]], top), digest) for r, code, e in zip(good, codes, errors)), key=str)


def close(seed, n, dim):
    """Many vectors with few values, so that ties abound and entries move by little."""
    rng = random.Random(seed)
    return [(i, [rng.randrange(-3, 4) / 1024 + (i % 5) / 64 for _ in range(dim)], rng.choice([1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("rows", [vectors(1, 420), close(2, 600, 8), close(3, 90, 8), close(4, 300, 6), close(5, 20, 3)], ids=["groups", "ties", "few", "uneven", "short"])
def test_yinyang(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS + ", key string, code int").repartition(4)
    assert sorted((tuple(r) for r in yinyang.encode_embeddings(df).collect()), key=str) == coded(rows)


def test_yinyang_with_components_of_any_size(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1e-3, 1.0, 1e9, 1e30, -1e30, 3e38]) * rng.random() for _ in range(4)], i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, VECTORS)
    assert sorted((tuple(r) for r in yinyang.encode_embeddings(df).collect()), key=str) == coded(rows)


def test_yinyang_scans_few_groups():
    rng = np.random.default_rng(7)
    x = yinyang.whole(rng.normal(size=(4000, 4)) / 8 + rng.integers(0, 40, size=(4000, 1)))
    book = yinyang.Codebook(x[:256], yinyang.grouped(x[:256]))
    at, best, lower = book.first(x)
    moved = book.entries + rng.integers(-2, 3, size=book.entries.shape)
    again = yinyang.Codebook(moved, book.group, book.entries)
    found, _, _, scanned = again.again(x, at, yinyang._root(best, up=True), lower)
    assert (found == yinyang._distances(x, moved).argmin(axis=1)).all() and scanned < 0.2 * len(x) * len(book.members)


def runs_by_force(w, words=24, periods=3):
    out, n = [], len(w)
    for q in range(1, n // periods + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e - s + q
            if length >= max(words, periods * q) and not any(all(w[s + k] == w[s + k + d] for k in range(length - d)) for d in range(1, q)):
                out.append((s, length, q))
            s = e + 1
    return sorted(out)


def words_with_runs(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(70))]
    while w and rng.random() < 0.7:
        s, p, size = rng.randrange(len(w)), rng.randrange(1, 9), rng.randrange(1, 60)
        own = w[s : s + p]
        w = w[:s] + [own[k % len(own)] for k in range(size)] + w[s + p :]
    return w[:200]


def test_lyndon_arrays_and_runs():
    rng = random.Random(8)
    for _ in range(600):
        w = words_with_runs(rng)
        end = [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) for i in range(len(w))]
        assert runs.lyndon_array(w)[0] == end
        for least, periods in ((1, 2), (2, 3), (24, 3)):
            assert runs.periodic_runs(w, least, periods) == runs.runs_of(w, least, periods) == runs_by_force(w, least, periods)


def test_document_runs(spark):
    rng = random.Random(9)
    space = ["  ", "\t", "\r\n", "\x0b", "\x0c "]
    texts = [rng.choice(space).join("wortäß" [: 1 + x] + (" " if x == 4 else "") for x in words_with_runs(rng)) for _ in range(120)] + [None, "", "  \n", "a " * 50, "a b " * 12, "x " * 23]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "a " * 40)]
    want = []
    for i, t in rows:
        w = [x for x in (t or "").encode().replace(b"\t", b" ").replace(b"\r", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if x]
        h = zlib.crc32(str(i).encode())
        if i is not None and w and h % 10 == 0:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        found = runs_by_force(w)
        best = (None,) * 4
        if found:
            s, length, q = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))
            best = (s, length, q, 1000 * length // q)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(found), *best, digest("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), digest(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_runs int, _text string")
    assert sorted((tuple(r) for r in runs.document_runs(df).collect()), key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 10 and runs.document_runs(df.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_metric_join", "op12_yinyang"])
def test_oracles(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(found.fetchall())
