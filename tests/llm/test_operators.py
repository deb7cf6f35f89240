"""The text operators against brute force, on rows with nulls, empty and long texts, ties, repeated rows and odd columns."""

import base64
import hashlib
import math
import os
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tessella.llm import bpe, common, exact_dedup, feistel, gray_index, licenses, mixing, piecewise, pretokens, quality, sharding, simhash, toxicity, warc

INDEX = licenses.Index(licenses.TEMPLATES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 8))) for _ in range(n))


def make_rows():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(1, 200)) for _ in range(40)]
    texts = base + [base[0]] * 20 + [base[1].upper().replace("É", "é")] + [base[2] + " tail"] + ["", "", None, "   \n", "a", "Ünï Ä", "x " * 3000 + words(rng, 2000)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "S3", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "no id", "en", "s1", 5), (None, "no id", "en", "s1", 5), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame(rows, SCHEMA).repartition(3)
    names = ["fp", "keep", "digest", "kept", "group_size", "at", "target", "size", "task", "margin", "word", "_n", "text_sha256", "row_tag"]
    return made.select("*", *[F.lit(7).alias(n) for n in names])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int(r[0] % 3 > 0), int(r[0] % 5 == 0)) for r in rows[:60]] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def key(x):
    return (x is None, x if x is not None else 0)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_dedup(docs, rows, empty):
    found = exact_dedup.exact_dedup(docs, one_in=8).collect()
    assert len(found) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(hashlib.sha256(lower(t).encode()).hexdigest(), []).append(i)
    for r in found:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_dedup(empty).count() == 0
    stay = exact_dedup.keep_one_copy(docs)
    assert stay.count() == len(groups) and stay.columns == docs.columns


def test_heavy_digests_hold_their_share(spark):
    many = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(900)], "doc_id long, text string")
    digests = many.select("doc_id", exact_dedup.text_digest().alias("text_sha256"), F.monotonically_increasing_id().alias("row_tag"))
    assert [(r.group_size, r.keep.doc_id) for r in exact_dedup.heavy_digests(digests, 10).collect()] == [(300, 897)]


def simhash_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(codes, distance=4):
    parent = {c: c for c in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in codes:
        for b in codes:
            if a < b and bin(a ^ b).count("1") <= distance:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {c: find(c) for c in codes}


def test_simhash(docs, rows, empty):
    want = [(i, simhash_by_hand(t)) for i, t, *_ in rows]
    root = roots({f for _, f in want})
    least = {}
    for i, f in want:
        least[root[f]] = min(least.get(root[f], (True, 0)), key(i)) if root[f] in least else key(i)
    expected = sorted((key(i), f"{f:016x}", least[root[f]]) for i, f in want)
    found = simhash.simhash_dedup(docs).collect()
    assert sorted((key(r.doc_id), r.fingerprint, key(r.component_id)) for r in found) == expected
    stay = simhash.keep_one_of_component(docs)
    assert stay.count() == len(least) and stay.columns == docs.columns
    assert simhash.simhash_dedup(empty).count() == 0


@pytest.mark.parametrize("segment,wide", [(3, 2), (2048, 64)])
def test_gray_links_of_clusters(spark, monkeypatch, segment, wide):
    # Many runs of segments in the first case, none in the second.
    monkeypatch.setattr(gray_index, "SEGMENT", segment)
    monkeypatch.setattr(gray_index, "WIDE", wide)
    rng = random.Random(2)
    codes = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(4):
        centre = rng.getrandbits(64)
        codes |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(60)}
    df = spark.createDataFrame([(gray_index.signed(c),) for c in codes], "fp long")
    links = gray_index.gray_links(df).collect()
    assert all(bin((r.u ^ r.v) & (1 << 64) - 1).count("1") >= 1 for r in links)
    from tessella.llm.components import components

    found = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    groups, want = {}, {}
    for c, r in roots(codes).items():
        want.setdefault(r, set()).add(c)
        groups.setdefault(found.get(gray_index.signed(c), gray_index.signed(c)), set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_tree_labels_of_a_large_group():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    codes = np.unique(np.r_[rng.integers(0, 1 << 63, 600, dtype=np.uint64), (centres[:, None] ^ (np.uint64(1) << rng.integers(0, 63, (30, 20), dtype=np.uint64))).ravel()])
    labels, root = gray_index.tree_labels(codes), roots([int(c) for c in codes])
    names = {}
    for c, label in zip(codes, labels):
        assert names.setdefault(int(label), root[int(c)]) == root[int(c)]
    assert len(names) == len(set(root.values()))


def test_bpe_as_the_library_does(docs, rows, empty):
    enc = tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=bpe.ranks(bpe.vocabulary()), special_tokens={})
    want = []
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((key(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    found = bpe.encoding_digests(docs).collect()
    assert sorted((key(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(want)
    assert bpe.encoding_digests(empty).count() == 0


def test_pretokens_of_every_code_point():
    enc = tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=bpe.ranks(bpe.vocabulary()), special_tokens={})
    one, table, known = bpe.encoder(bpe.vocabulary()), pretokens.code_points(), {}
    rng, signs = random.Random(1), ["'", "s", "t", "re", "ve", "l", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "Z", "1", "²", "!", "''", "é", "\u2003", "\u3000", "日", "e", "r", "v", "\r\n", "😀"]
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    texts = ["".join(f"a{c}b {c}{c}'s 1{c}'  {c}\n" for c in every[k : k + 64]) for k in range(0, len(every), 64)]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(20000)]
    texts.append(" ".join(texts[-20000:]))
    words, counts = bpe.split_texts(pa.array(texts), table)
    words, at = words.to_pylist(), 0
    for text, n, want in zip(texts, counts.tolist(), enc.encode_ordinary_batch(texts)):
        ids = []
        for w in words[at : at + n]:
            if w not in known:
                known[w] = one.encode_ordinary(w.decode())
            ids += known[w]
        assert ids == want, repr(text[:60])
        at += n


@pytest.mark.parametrize("piece", [7, 40])
def test_long_texts_are_cut_where_tokens_begin(monkeypatch, piece):
    monkeypatch.setattr(pretokens, "PIECE", piece)
    table, texts = pretokens.code_points(), ["it's a b  c d'll " * 9, "", "x" * 100, "é ü a b c"]
    words, counts = bpe.split_texts(pa.array(texts), table)
    assert counts.tolist() == [len(re_matches(t)) for t in texts] and words.to_pylist() == [w.encode() for t in texts for w in re_matches(t)]


def re_matches(text):
    return regex.findall(bpe.pattern(), text)


def test_pack_round_trip():
    for values in ([], [0], [1, 70000, 2**32 - 1] * 9):
        assert bpe.unpack(bpe.pack(np.array(values))).tolist() == values


def test_toxicity(spark, docs, rows, labels, empty):
    found = toxicity.score_documents(docs, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert toxicity.score_documents(empty, labels).count() == 0
    assert {round(r.score, 6) for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.1}


def text_margin_by_hand(text, weights, bias):
    """The largest margin of a text's words by the definition: a word's triples with gaps, as a vector of length one, times the weights."""
    best = bias
    words_of_text = re.sub(r"(?<!\S)(\S)[ \t](?=\S(?!\S))", r"\1", text or "").split()
    for k, w in enumerate(words_of_text):
        w = toxicity.plain(w)
        for at in range(0, max(1, len(w) - toxicity.LETTERS // 2), toxicity.LETTERS // 2):
            part, phi = w[at : at + toxicity.LETTERS], {}
            code = [ord(c) - 97 if "a" <= c <= "z" else 26 + ((ord(c) * 2654435761 & 0xFFFFFFFF) >> 16) % (toxicity.CODES - 26) for c in part]
            for i in range(len(code)):
                for j in range(i + 1, len(code)):
                    for m in range(j + 1, min(len(code), i + 3 + toxicity.GAP)):
                        key = (code[i] * toxicity.CODES + code[j]) * toxicity.CODES + code[m]
                        phi[key] = phi.get(key, 0) + toxicity.DECAY ** (m - i - 2)
            length = sum(v * v for v in phi.values()) ** 0.5
            margin = bias + (sum(v * float(weights[f]) for f, v in phi.items()) / length if length else 0)
            best = margin if k == at == 0 else max(best, margin)
    return best


def test_scores_by_brute_force(spark, docs, rows, labels):
    rng = np.random.default_rng(8)
    weights, bias = rng.normal(size=toxicity.CODES**3).astype(np.float32), -0.25
    texts = [t or "" for _, t, *_ in rows] + ["i d i o t here", "Idi-oooot!!", "ÉÈ ß 日本語 привет", "a" * 5000, "x y", "日", "tie tie tie"]
    source = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shared = spark.sparkContext.broadcast((weights, bias))
    got = toxicity._scored(source.select("doc_id", toxicity.unspaced(F.col("text")).alias("text")), shared, "doc_id long, margin double, word string").collect()
    for r in got:
        assert r.margin == pytest.approx(text_margin_by_hand(texts[r.doc_id], weights, bias), abs=1e-4), texts[r.doc_id][:40]


def test_toxicity_in_other_scripts(spark):
    rng = random.Random(4)
    letters = "абвгдежзиклмнопрстуфхцчшщ"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    rows, marks = [], []
    for i in range(900):
        bad = i % 4 == 0
        rows.append((i, " ".join([word() for _ in range(25)] + (["дурачина"] if bad else []))))
        marks.append((i, int(bad)))
    scored = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).toPandas().set_index("doc_id")
    held = scored[scored.held_out]
    assert ((held.index % 4 == 0) == (held.predicted == 1)).mean() > 0.97


def test_toxicity_finds_gapped_insults(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(1200):
        bad = i % 4 == 0
        rows.append((i, words(rng, 20) + (" " + rng.choice(["grumblefink", "snodwaffle"]) if bad else "") + " " + words(rng, 5)))
        marks.append((i, int(bad)))
    rows += [(9000, words(rng, 9) + " grumb-lefink"), (9001, words(rng, 9) + " snodwafffle"), (9002, words(rng, 9))]
    scored = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).toPandas().set_index("doc_id")
    held = scored[scored.held_out & (scored.index < 9000)]
    assert ((held.index % 4 == 0) == (held.predicted == 1)).mean() > 0.97
    assert scored.predicted[[9000, 9001, 9002]].tolist() == [1, 1, 0]


def test_kernel_by_hand():
    def phi(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, len(w)):
                    if k - i + 1 <= 3 + toxicity.GAP:
                        out[w[i], w[j], w[k]] = out.get((w[i], w[j], w[k]), 0) + toxicity.DECAY ** (k - i - 2)
        return out

    a, b = "idiotic", "idioooms".replace("ooo", "oo")
    fa, fb = phi(a), phi(b)
    want = sum(v * fb.get(k, 0) for k, v in fa.items()) / (sum(v * v for v in fa.values()) * sum(v * v for v in fb.values())) ** 0.5
    ca, cb = toxicity.letter_codes([a])[0], toxicity.letter_codes([b])[0]
    assert toxicity.features(ca) @ toxicity.features(cb) == pytest.approx(want)


def test_mixing(docs, rows, empty):
    found = mixing.mix_documents(docs, block=8).collect()
    again = mixing.mix_documents(docs.repartition(7), block=8).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, _, x, _ in rows if x == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped, share = set(), 1.5 * sum(total.values())
    while True:
        left = share - sum(2 * total[s] for s in capped)
        open_ = sum(weight[s] for s in names if s not in capped)
        target = {s: 2 * total[s] if s in capped else left * weight[s] / open_ for s in names}
        above = {s for s in names if target[s] > 2 * total[s] + 1e-9}
        if not above - capped:
            break
        capped |= above
    taken = {}
    by_id = {i: x for i, _, _, x, _ in rows}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        if r.doc_id is not None:
            assert r.target == pytest.approx(target[by_id[r.doc_id]]) and r.source_size == total[by_id[r.doc_id]]
        taken[r.target] = taken.get(r.target, 0) + r.taken
    assert all(abs(n - t) <= 0.1 * t + 16 for t, n in taken.items())
    mixed = mixing.mixed_documents(docs, block=8).collect()
    assert sum(size(r.text) for r in mixed) == sum(r.taken for r in found)
    assert mixing.mix_documents(empty).count() == 0


def test_small_sources_meet_their_targets(spark):
    sizes = {"hot": 20000, "a": 1, "b": 5, "c": 15, "d": 16, "e": 31, "f": 40, None: 3}
    rows = [(i, "w " * n, "en", s, 2 * n) for i, (s, n) in enumerate(sizes.items())]
    found = mixing.mix_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.size for r in found} == set(sizes.values())
    for r in found:
        assert r.taken == r.target == 2 * r.size if r.size < 20000 else abs(r.taken - r.target) <= 16
    alike = mixing.mix_documents(spark.createDataFrame([(i, "w " * n, "en", s, 2 * n) for i, (s, n) in enumerate((("a", 31), ("b", 15), ("c", 77)))], SCHEMA)).collect()
    assert all(0 < r.taken and abs(r.taken - r.target) <= max(0.5, mixing.NEAR * r.target) for r in alike)


def test_word_machine_against_a_plain_kernel_machine():
    """The factor of landmarks gives, where every word is one, the margins of a squared-hinge machine on the whole kernel matrix."""
    rng = random.Random(3)
    bad = ["grumble", "blister", "noxious", "vermin"]
    words = sorted({w[:k] + rng.choice("xyz") + w[k:] for w in bad for k in range(1, len(w))} | {"".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9))) for _ in range(40)})
    y = np.array([1.0 if any(sum(c in w for c in b) >= len(b) - 1 for b in bad) else -1.0 for w in words])
    weight = np.array([rng.choice([0.5, 1.0, 2.0]) for _ in words])

    def triples(w):
        out = {}
        for i in range(len(w)):
            for b in range(2, toxicity.GAP + 3):
                for a in range(1, b):
                    if i + b < len(w):
                        key = w[i] + w[i + a] + w[i + b]
                        out[key] = out.get(key, 0) + toxicity.DECAY ** (b - 2)
        size = math.sqrt(sum(v * v for v in out.values()))
        return {k: v / size for k, v in out.items()}

    each = [triples(w) for w in words]
    kernel = np.array([[sum(v * b.get(k, 0) for k, v in a.items()) for b in each] for a in each])
    # Newton's method on the dual coefficients: f = K c + bias, with the ridge on c' K c.
    c, bias = np.zeros(len(words)), 0.0
    for _ in range(60):
        inside = y * (kernel @ c + bias) < 1
        k, w = kernel[np.ix_(inside, inside)], weight[inside]
        system = np.block([[k + np.diag(0.02 / w), np.ones((len(w), 1))], [np.ones((1, len(w))), np.zeros((1, 1))]])
        solved = np.linalg.solve(system, np.r_[y[inside], 0])
        c, bias = np.zeros(len(words)), solved[-1]
        c[inside] = solved[:-1]
    model, shift = toxicity.fit_words(words, y, weight)
    found = toxicity.word_margins(words, model, shift)
    assert len(words) < toxicity.LANDMARKS and np.abs(found - (kernel @ c + bias)).max() < 0.05
    assert ((found > 0) == (kernel @ c + bias > 0)).all()


def test_the_draws_say_which_shard_words_are_in(spark):
    # Each document is one block, so that the words of a source in a shard tell how many of its slots were drawn there.
    sizes = {"a": 6000, "b": 3000, "c": 300}
    rows = [(f"{s}{i}", "w " * 4, "en", s, 8) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long")
    found = mixing.mix_documents(df, block=4).collect()
    held = {s: np.zeros(mixing.SHARDS, int) for s in sizes}
    for r in found:
        each = [tuple(map(int, x.split(":"))) for x in r.shards.split(",") if x]
        assert sum(n for _, n in each) == r.taken and [k for k, _ in each] == sorted({k for k, _ in each})
        for k, n in each:
            held[r.doc_id[0]][k] += n // 4
    want = np.array([held[s].sum() for s in sizes])
    drawn = np.array([mixing.shard_counts(want, mixing.SHARDS, k, mixing.SEED)[1] for k in range(mixing.SHARDS)]).T
    assert (np.array([held[s] for s in sizes]) == drawn).all()
    # Shards are equally full, and their sources vary as drawn ones do: a fixed split would not vary.
    total = sum(held.values())
    assert total.max() - total.min() <= mixing.SHARDS
    for s in sizes:
        share = held[s].sum() / total.sum()
        assert 0.8 < held[s].var() / (total.mean() * share * (1 - share)) < 4  # about 2: a draw for each halving
    other = mixing.mix_documents(df, block=4, seed=8).collect()
    assert {(r.doc_id, r.shards) for r in other} != {(r.doc_id, r.shards) for r in found}
    by_shard = mixing.mixed_documents(df, block=4, by_shard=True).collect()
    assert sorted((r.doc_id, r.shard) for r in by_shard for _ in range(1)) == sorted((r.doc_id, int(x.split(":")[0])) for r in found for x in r.shards.split(",") if x for _ in range(int(x.split(":")[1]) // 4))


def test_the_mix_of_copies_does_not_depend_on_their_order(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "s", 5), (1, text, "fr", "s", 5), (1, text, None, "s", None), (1, text, "fr", "s", 5), (None, text, "en", None, 9), (None, text, "de", None, 9), (2, "x " * 50, "en", "t", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    made = [sorted(map(str, mixing.mixed_documents(spark.createDataFrame(rows[k:] + rows[:k], SCHEMA).repartition(k + 1), block=8).collect())) for k in range(4)]
    assert made[0] and all(m == made[0] for m in made)
    taken = sum(r.taken for r in mixing.mix_documents(spark.createDataFrame(rows, SCHEMA), block=8).collect())
    mixed = mixing.mixed_documents(spark.createDataFrame(rows, SCHEMA), block=8).collect()
    assert sum(len((r.text or "").split()) for r in mixed) == taken and {r.lang for r in mixed} == {"en", "fr", None, "de"}


def test_slots_count_the_words_of_their_blocks():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 3000, 400)
    target, key = rng.uniform(0, 2, 400) * size, rng.integers(0, 1 << 40, 400)
    block, slots = mixing.choose_slots(size, target, key, 32)
    for s, t, k, b, n in zip(*(x.tolist() for x in (size, target, key, block, slots))):
        many = -(-s // b)
        held = np.concatenate([np.minimum(b, s - b * feistel.permute(np.arange(many), many, k + turn * mixing.TURN_KEY)) for turn in (0, 1)])
        totals = np.concatenate([[0], np.cumsum(held)])
        assert abs(totals[n] - t) == pytest.approx(np.abs(totals - t).min()) and abs(totals[n] - t) <= max(0.5, 0.05 * t)


def test_feistel_permutes():
    for n in (1, 2, 3, 5, 64, 65, 1000):
        images = [feistel.permute(np.arange(n), n, k) for k in (1, 2)]
        assert all(sorted(x.tolist()) == list(range(n)) for x in images)
    assert (images[0] != images[1]).any()


def test_sharding(docs, rows, empty):
    found = sharding.shard_documents(docs).collect()
    again = sharding.shard_documents(docs.repartition(5)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    want = sorted((key(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((key(r.doc_id), r.size, r.text_crc32) for r in found) == want
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(by.get(s, [])) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_documents(empty).count() == 0


def test_offsets_of_many_buckets_are_those_of_few(spark, monkeypatch):
    rows = [(g, i, 1 + (7 * i) % 5) for g, n in (("hot", 700), ("cold", 3), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, w long").repartition(5)
    monkeypatch.setattr(common, "BUCKET_ROWS", 1)
    for group in ([], ["g"]):
        offsets = lambda: {(r.g, r.i): r.offset for r in common.running_offsets(df, "w", group, ["i", "g"]).collect()}
        one = offsets()
        for bits in (1, 9):
            monkeypatch.setattr(common, "LEVEL_BITS", bits)
            assert offsets() == one
        monkeypatch.undo()
        monkeypatch.setattr(common, "BUCKET_ROWS", 1)
        for g in {r[0] for r in rows} if group else {"all"}:
            end = 0
            for key, w in sorted(((k, w) for *k, w in rows if g in ("all", k[0])), key=lambda x: one[tuple(x[0])]):
                assert one[tuple(key)] == end
                end += w


def test_many_copies_of_one_row_are_dealt_out(spark, monkeypatch):
    rows = [(1, "same words here", "en", "s", 5)] * 50 + [(2, "other", "en", "s", 5), (3, None, None, None, None)]
    many = spark.createDataFrame(rows, SCHEMA)
    before = sorted(map(str, sharding.shard_documents(many).collect())), sorted(map(str, mixing.mix_documents(many, block=4).collect()))
    monkeypatch.setattr(common, "COPIES", 7)
    after = sorted(map(str, sharding.shard_documents(many).collect())), sorted(map(str, mixing.mix_documents(many, block=4).collect()))
    assert before == after and len(after[0]) == len(after[1]) == 52


def test_licenses(spark, empty):
    text = "Prose first.\nLicensed under the Apache License, Version 2.0.\nMore.\nThis work is licensed under the GNU General Public License, version 4."
    rows = [(1, text), (2, "a licensed plumber"), (3, None), (4, "x Released under the  MIT License. y"), (4, "x Released under the  MIT License. y"), (None, "Licensed under CC BY-NC 4.0.")]
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(1))).collect()
    got = sorted((key(r.doc_id), r.license, r.exact, r.wording) for r in found)
    first, second = [g for g in got if g[0] == (False, 1)]
    assert first[1:] == ("Apache-2.0 notice", True, "") and second[1].startswith("GPL") and not second[2]
    assert [g[1:3] for g in got if g[0] == (False, 4)] == [("MIT notice", True)] * 2
    assert [g[1] for g in got if g[0][0]] == ["CC-BY-NC-4.0"] and not [g for g in got if g[0][1] in (2, 3)]
    assert licenses.license_scan(empty).count() == 0
    for r in found:
        assert r.doc_id != 1 or "icensed under" in text[r.start : r.end] and 0 < r.saved < 1


def test_license_wordings_name_their_license():
    for name, text in licenses.TEMPLATES.items():
        assert re.search(INDEX.pattern(), text), name
        wrapped = re.sub(r"(.{60}\S*) ", r"\1\n * ", f"int main;\n/* {text} */\nint x;")
        assert [(h[2], h[4]) for h in licenses.scan(wrapped, INDEX)][:1] == [(name, 0)], name


@pytest.mark.parametrize("bullets", ["* ", "- ", "", "1. 2. 3. "])
def test_bsd_licenses_are_told_apart(bullets):
    for name, clauses in (("BSD-2-Clause text", 2), ("BSD-3-Clause text", 3)):
        marks = bullets.split(" ") if bullets.startswith("1") else [bullets.strip()] * 3
        text = licenses.TEMPLATES[name]
        for mark, start in zip(marks, ["Redistributions of source", "Redistributions in binary", "Neither the name"][:clauses]):
            text = text.replace(start, f"\n{mark} {start}")
        assert [(h[2], h[4]) for h in licenses.scan(f"Copyright (c) 2020, A. All rights reserved.\n{text}", INDEX)] == [("All rights reserved", 0), (name, 0)]


def test_license_versions_and_tags():
    gpl = licenses.TEMPLATES["GPL-3.0 header"]
    got = lambda text: [(h[2], h[4] == 0) for h in licenses.scan(text, INDEX)]
    assert got(gpl.replace("version 3", "version 2")) == [("GPL-2.0 header", True)]
    assert got(gpl.replace("version 3", "version 4")) in [[(f"GPL-{v}.0 header{licenses.OTHER}", False)] for v in (2, 3)]
    assert got(gpl.replace("GNU General", "GNU Lesser General")) == [("LGPL-3.0 header", False)]
    assert got("Licensed under CC BY 3.0.") == [(f"CC-BY-4.0{licenses.OTHER}", False)]
    assert got("Licensed under CC0 1.0.") == got("Licensed under CC0-1.0.")[:0] + [("CC0-1.0 notice", True)]
    assert got("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nfn main() {}") == [("(MIT OR Apache-2.0) AND BSD-3-Clause tag", True)]
    assert got("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */") == [("GPL-2.0-only WITH Linux-syscall-note tag", True)]


def test_license_scan_by_brute_force():
    """Templates with words lost, put in and changed: where plain comparing finds most of a template's words close together, the scan does too."""
    rng = random.Random(9)
    prose = lambda n: [rng.choice("the lorem license source of ipsum provided copyright software dolor any".split()) for _ in range(n)]
    for name, template in licenses.TEMPLATES.items():
        if name in licenses.PARTIAL or name == "All rights reserved":
            continue
        parts = template.split(" ")
        for lost in (0, INDEX.may_lack[name] // 2):
            kept = list(parts)
            for _ in range(lost):
                kept.pop(rng.randrange(len(kept)))
            text = " ".join([*prose(30), *kept, *prose(30)])
            place = licenses.wording(licenses._words(text), template)
            hits = licenses.scan(text, INDEX)
            start, end = text.index(" ".join(kept)), text.index(" ".join(kept)) + len(" ".join(kept))
            assert place[2] >= licenses.WORDS and any(h[0] < end and h[1] > start for h in hits), (name, lost)
            if not lost:
                assert (name, 0) in [(h[2], h[4]) for h in hits]
    for text in (" ".join(prose(4000)), "license " * 3000, "Permission " * 2000 + licenses.TEMPLATES["MIT text"]):
        assert [h[2] for h in licenses.scan(text, INDEX)] == (["MIT text"] if "hereby" in text else [])


def test_piecewise(docs, rows, empty):
    found = piecewise.piecewise_fingerprints(docs).collect()
    assert len(found) == len(rows)
    tie = lambda r: xxhash.xxh64_intdigest((r[1] or "").encode(), 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(tie(r))))
    want = []
    for i, r in enumerate(order):
        a, b = r[1] or "", order[(i + 1) % len(order)][1] or ""
        e = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        pa_, pe, pb = (piecewise.fingerprint(x.encode()) for x in (a, e, b))
        want.append((key(r[0]), len(a), hashlib.sha256(e.encode()).hexdigest(), pa_, pe, round(piecewise.likeness([pa_], [pe])[0], 9), round(piecewise.likeness([pa_], [pb])[0], 9)))
    got = [(key(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found]
    assert sorted(got) == sorted(want)
    assert piecewise.piecewise_fingerprints(empty).count() == 0
    assert piecewise.piecewise_fingerprints(docs.where("doc_id = 7")).first().near_next == 1.0


def fingerprint_by_hand(data):
    """The piecewise hash by its definition, one byte at a time, in whole numbers modulo 2**64."""
    if not data:
        return "0::"
    mask, factor = (1 << 64) - 1, 0x9E3779B97F4A7C15
    rolled = []
    for i in range(len(data)):
        x = sum(data[i - 6 + k] << 8 * (k + 1) for k in range(7) if i - 6 + k >= 0) * factor & mask
        rolled.append((x ^ x >> 32) * factor & mask)
    cuts = lambda level: [i + 1 for i in range(len(data)) if rolled[i] >> (64 - level) == 0 or i + 1 == len(data)]
    level = 0
    while len(cuts(level)) > 64:
        level += 1
    out = []
    for at in (cuts(level), cuts(level + 1)):
        signs = ""
        for start, end in zip([0, *at[:-1]], at):
            x = sum((b + 1) * pow(0x5851F42D4C957F2D, k, 1 << 64) for k, b in enumerate(data[start:end])) & mask
            signs += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[(x ^ x >> 33) * factor % (1 << 64) >> 58]
        out.append(signs)
    return f"{level}:{out[0]}:{out[1]}"


def test_fingerprints_by_hand(rows):
    rng = random.Random(12)
    texts = [(r[1] or "").encode()[:3000] for r in rows] + [rng.randbytes(n) for n in (1, 6, 7, 8, 63, 64, 65, 129, 1000, 5000)] + [b"a" * 700, b"ab" * 300]
    assert [piecewise.fingerprint(t) for t in texts] == [fingerprint_by_hand(t) for t in texts]


def test_equal_texts_and_ties_have_equal_fingerprints():
    rng = random.Random(3)
    for _ in range(30):
        data = rng.randbytes(rng.randrange(0, 4000))
        a = piecewise.fingerprint(data)
        level, first, second = a.split(":")
        assert piecewise.fingerprint(bytes(data)) == a and len(first) <= piecewise.SIGNATURE and len(second) <= max(piecewise.SIGNATURE, len(first))
        cut = data[: len(data) // 2] + b"!" + data[len(data) // 2 :]
        if len(data) > 1500:  # one byte changes a chunk or two at either level
            assert piecewise.likeness([a], [piecewise.fingerprint(cut)])[0] > 0.85


def test_edit_distances_by_hand():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            before, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
        return row[-1]

    rng = random.Random(1)
    pairs = [(bytes(rng.choice(b"abc") for _ in range(rng.randrange(65))), bytes(rng.choice(b"abc") for _ in range(rng.randrange(65)))) for _ in range(150)]
    assert piecewise.edit_distances(*map(list, zip(*pairs))).tolist() == [distance(a, b) for a, b in pairs]


def test_quality(docs, rows, labels, empty):
    found = quality.quality_documents(docs, labels).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 and r.keep == (r.score >= quality.THRESHOLD) for r in found)
    sites, corpus = {}, np.mean([r.evidence for r in found])
    for r in found:
        sites.setdefault(r.site, []).append(r.evidence)
    for r in found:  # between the corpus's mean and the site's own
        low, high = sorted([corpus, np.mean(sites[r.site])])
        assert low - 1e-9 <= r.site_posterior <= high + 1e-9
    assert quality.quality_documents(empty, labels).count() == 0
    unlabelled = quality.quality_documents(docs, labels.limit(0)).collect()
    assert all(r.keep and r.evidence == 0.5 for r in unlabelled)


def test_quality_by_brute_force(docs, rows, labels, spark):
    """Posteriors by their definition in plain Python, from the evidence of each row; null sites and paths are their own."""
    found = quality.quality_documents(docs, labels).collect()
    site, path, p = [r.site for r in found], [(r.site, r.path) for r in found], np.array([r.evidence for r in found])
    mean = p.mean()

    def pool(groups, prior):
        """Means of groups shrunk toward their priors, with the strength that moments give."""
        members = {}
        for i, g in enumerate(groups):
            members.setdefault(g, []).append(i)
        n = {g: len(m) for g, m in members.items()}
        average = {g: p[m].mean() for g, m in members.items()}
        inside = sum(((p[m] - average[g]) ** 2).sum() for g, m in members.items())
        within = inside / (len(p) - len(n))
        between = sum(n[g] * (average[g] - prior[g]) ** 2 for g in n)
        spread = (between - (len(n) - 1) * within) / max(len(p) - sum(x * x for x in n.values()) / len(p), 1e-9)
        k = min(max(within / spread, 1.0), 1e6) if spread > 0 else 1e6
        return {g: (k * prior[g] + n[g] * average[g]) / (k + n[g]) for g in n}

    sites = pool(site, dict.fromkeys(site, mean))
    paths = pool(path, {g: sites[g[0]] for g in path})
    logit = lambda x: np.log(x / (1 - x))
    for r in found:
        assert r.site_posterior == pytest.approx(sites[r.site], abs=1e-7) and r.path_posterior == pytest.approx(paths[r.site, r.path], abs=1e-7)
        if 1e-9 < r.evidence < 1 - 1e-9:
            assert logit(r.score) == pytest.approx(logit(r.evidence) + logit(min(max(paths[r.site, r.path], 1e-6), 1 - 1e-6)) - logit(mean), abs=1e-5)
    assert {None} <= set(site) and len({(r.site is None, r.site_posterior) for r in found}) > 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in found)


def test_quality_on_rows_not_taught(spark):
    """Held-out accuracy: clean and junk texts, a third of them never labelled."""
    rng = random.Random(6)
    clean = lambda: ". ".join(" ".join(rng.choice(["river", "stone", "walks", "under", "morning", "light", "quiet", "answer"]) for _ in range(9)).capitalize() for _ in range(5)) + "."
    junk = lambda: rng.choice([lambda: "BUY!! " * 40, lambda: " | ".join("x%d" % rng.randrange(99) for _ in range(60)), lambda: "".join(rng.choice("$%&#*@") for _ in range(200))])()
    rows = [(i, clean() if i % 4 else junk(), "en", f"s{i % 3}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(900) if i % 3], "doc_id long, quality int")
    found = quality.quality_documents(docs, labels).where("doc_id % 3 = 0").collect()
    assert np.mean([r.keep == (r.doc_id % 4 > 0) for r in found]) > 0.99


class Visible(HTMLParser):
    """Visible text as the standard library's parser sees a page."""

    BLOCK, UNSEEN = set("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead tr ul".split()), {"script", "style", "noscript", "template", "svg", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.UNSEEN
        self.out += ["\n"] if tag in self.BLOCK else [" "] if tag in self.UNSEEN else []

    def handle_endtag(self, tag):
        self.depth -= tag in self.UNSEEN and self.depth > 0
        self.out += ["\n"] if tag in self.BLOCK else []

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_warc_derivatives_by_brute_force(spark):
    """Every page of the table: text against the standard library's parser, identifiers and digests by hand."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: (r.url, r.html) for r in pages.collect()}
    derived = warc.derivatives(warc.page_responses(pages)).collect()
    assert sorted((r.page_id, r.record_type) for r in derived) == sorted((i, k) for i in html for k in ("metadata", "conversion"))
    responses = {r.page_id: r.record_id for r in warc.page_responses(pages).collect()}
    named = {r.page_id: r.record_id for r in derived if r.record_type == "conversion"}
    for r in derived:
        url, source = html[r.page_id]
        raw = (source or "").encode()
        sha1 = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.refers_to == responses[r.page_id] and r.target_uri == url and r.source_digest == sha1(raw) and r.source_headers == warc.PAGE_HEADERS
        assert r.block_digest == sha1(r.content.encode()) and r.content_length == len(r.content.encode())
        if r.record_type == "conversion":
            parser = Visible()
            parser.feed(source or "")
            parser.close()
            lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(parser.out).split("\n"))
            assert r.content == "\n".join(x for x in lines if x), r.page_id
        else:
            assert f"conversion: {named[r.page_id]}\r\n" in r.content and f"payload-length: {len(raw)}\r\n" in r.content


def test_warc_empty_tables_and_long_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derivatives(warc.page_responses(none)).count() == 0
    assert warc.read_responses(spark.createDataFrame([], "path string, content binary")).count() == 0
    assert warc.read_responses(spark.createDataFrame([("a", None), ("b", bytearray(b""))], "path string, content binary")).count() == 0
    long = "<p>" + "word " * 400_000 + "</p>" + "<b" * 50_000
    rows = warc.derivatives(warc.page_responses(spark.createDataFrame([(1, "u", long), (1, "u", long)], "page_id long, url string, html string"))).collect()
    assert len(rows) == 4 and len({r.record_id for r in rows}) == 2
    assert next(r for r in rows if r.record_type == "conversion").content.startswith("word word word")


def test_warc_reading_takes_linear_time():
    member = warc.record_bytes("response", "<1>", [], b"HTTP/1.1 200 OK\r\n\r\n" + random.Random(1).randbytes(9000))
    began = time.process_time()
    assert sum(1 for _ in warc.parse_parts(member * 500)) == 500
    few = time.process_time() - began
    began = time.process_time()
    assert sum(1 for _ in warc.parse_parts(member * 4000)) == 4000
    assert time.process_time() - began < 8 * few * 3 + 1


def test_warc(spark):
    page = '<html lang="de"><head><title>A &amp; B</title><script>var t="</p>";</script></head><body><p>One  two<br>three</p><a href="/x">link</a><!-- no --></body></html>'
    pages = spark.createDataFrame([(1, "http://h.example/d/", page), (1, "http://h.example/d/", page), (2, None, None), (None, "http://[bad", "<a href='//[x'>y</a><b")], "page_id long, url string, html string").withColumn("payload", F.lit(0))
    derived = warc.derivatives(warc.page_responses(pages)).collect()
    assert len(derived) == 8
    meta = next(r for r in derived if r.page_id == 1 and r.record_type == "metadata")
    text = next(r for r in derived if r.page_id == 1 and r.record_type == "conversion")
    assert text.content == "One two\nthree\nlink" and f"conversion: {text.record_id}" in meta.content and "title: A & B" in meta.content
    assert "outlink: http://h.example/x" in meta.content and meta.refers_to == text.refers_to and meta.source_digest == warc.digest(page.encode())
    assert next(r for r in derived if r.page_id == 2 and r.record_type == "conversion").content == ""
    members = warc.warc_members(warc.derivatives(warc.page_responses(pages))).collect()
    parsed = list(warc.parse_records(b"".join(bytes(m.member) for m in members)))
    assert sorted(f["warc-record-id"] for f, _ in parsed) == sorted(r.record_id for r in derived)
    assert all(f["warc-block-digest"] == warc.digest(block) for f, block in parsed)
    response = warc.record_bytes("response", "<urn:uuid:1>", [("WARC-Target-URI", "http://a.example/"), ("WARC-Date", "2024-05-05T00:00:00Z")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>\xe9</p>")
    files = spark.createDataFrame([(bytearray(response),)], "content binary")
    back = warc.derivatives(warc.read_responses(files)).where("record_type = 'conversion'").first()
    assert back.refers_to == "<urn:uuid:1>" and back.content == "é" and "latin-1" in back.source_headers


def test_damaged_warc_files_lose_one_record_only():
    member = lambda i: warc.record_bytes("response", f"<{i}>", [], b"HTTP/1.1 200 OK\r\n\r\n" + random.Random(i).randbytes(3000))
    plain = lambda i: zlib.decompress(member(i), 31)
    bad = bytearray(member(2))
    bad[len(bad) // 2 :] = bad[len(bad) // 2 :][::-1]
    no_length = b"WARC/1.0\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n"
    squeeze = lambda raw: zlib.compress(raw, wbits=31)
    for data, ids, failures in (
        (member(1) + bytes(bad) + member(3), "13", 1), (member(1) + b"\0" * 9 + member(3), "13", 0), (member(1) + b"junk" + member(3), "13", 1), (member(1) + member(2)[:-40] + member(3), "13", 1), 
        (plain(1) + plain(2)[:-900] + plain(3), "13", 1), (plain(1) + no_length + plain(3), "13", 1), (squeeze(plain(1) + no_length + plain(3)) + member(4), "134", 1), (plain(1) + member(2), "12", 0), (member(1)[:-20], "", 1),
    ):
        parts = list(warc.parse_parts(data))
        got = "".join(p[0]["warc-record-id"][1:-1] for p in parts if not isinstance(p, str))
        assert got == ids and any(isinstance(p, str) for p in parts) == failures


def test_warc_digests_encodings_and_failures(spark):
    html = "<p>Größe</p>".encode()
    body = zlib.compress(html, wbits=31)
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (body[:5], body[5:])) + b"0\r\n\r\n"
    fields = [("WARC-Payload-Digest", "sha256:abc"), ("WARC-Target-URI", "http://a.example/")]
    heads = [(b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked), (b"Content-Encoding: gzip", body), (b"Content-Encoding: deflate", zlib.compress(html)), (b"Transfer-Encoding: chunked", html), (b"Content-Encoding: odd", body)]
    data = b"".join(warc.record_bytes("response", f"<{i}>", fields, b"HTTP/1.1 200 OK\r\n" + h + b"\r\n\r\n" + b) for i, (h, b) in enumerate(heads))
    derived = warc.derivatives(warc.read_responses(spark.createDataFrame([("f.warc", bytearray(data + b"junk"))], "path string, content binary")))
    rows = derived.collect()
    assert {r.refers_to: r.content for r in rows if r.record_type == "conversion"} == {f"<{i}>": "" if i == 4 else "Größe" for i in range(5)}
    assert all(r.source_digest == "sha256:abc" for r in rows if r.record_type != "failure")
    assert all("source-block-digest: sha1:" in r.content and ("not-decoded: odd" in r.content) == (r.refers_to == "<4>") for r in rows if r.record_type == "metadata")
    assert [r.content.startswith("f.warc, offset ") for r in rows if r.record_type == "failure"] == [True]
    assert warc.warc_members(derived).count() == 10
