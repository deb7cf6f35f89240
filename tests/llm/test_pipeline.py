"""The pipeline's stages, each held against plain Python on its own input."""

import os
import re
from collections import Counter

import pytest
import tiktoken
import xxhash

import corpus_pipeline
from tessella.llm import bpe, mixing, quality
from tessella.llm.common import DOCUMENT_COLUMNS, materialise, read

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [tuple(r) for r in df.select(*DOCUMENT_COLUMNS).collect()]


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of each stage: the test table with nulls, ties, repeated rows, long and empty texts and a clashing column."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs = read(spark, SF, "documents").select(*DOCUMENT_COLUMNS)
    odd = [(None, "No id, a plain sentence of some words that says little.", "en", "s", 9), (None, None, None, None, None), (7, "", "en", "s", 0), (7, "A tie of two rows that differ in case.", "en", None, 5), (7, "a tie of two rows that DIFFER in case.", "en", None, 5)]
    odd += [(90001, "word after word " * 4000, "en", "long", 64000), odd[0], odd[3]]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("kept", docs["doc_id"] * 0).withColumn("size", docs["doc_id"])
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, SF))
        found[name] = (before, docs)
    return found


def test_stages_return_documents(steps):
    assert [df.columns == DOCUMENT_COLUMNS for _, df in list(steps.values())[:-1]] == [True] * 4 and steps["byte-level BPE"][1].columns == ["doc_id", "n_tokens", "ids"]


def test_quality_stage(spark, steps):
    before, after = steps["quality classifier"]
    judged = quality.quality_documents(before, read(spark, SF, "labels")).collect()
    assert after.count() == sum(r.keep for r in judged) < before.count()
    good = {r.doc_id for r in read(spark, SF, "labels").where("quality = 1").collect()}
    held, kept = ({r.doc_id for r in df.collect()} for df in (before, after))
    assert len(good & kept) >= 0.95 * len(good & held)
    assert not Counter(rows_of(after)) - Counter(rows_of(before))


def test_exact_stage(steps):
    before, after = map(rows_of, steps["exact dedup"])
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    best = {}
    for r in before:
        key = (r[0] is not None, r[0] or 0)
        best[lower(r[1])] = max(best.get(lower(r[1]), (False, 0)), key)
    assert sorted((lower(r[1]), r[0] is not None, r[0] or 0) for r in after) == sorted((t, *k) for t, k in best.items())
    assert not Counter(after) - Counter(before)


def fingerprint(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_near_stage(steps):
    before, after = map(rows_of, steps["SimHash near-dedup"])
    prints = [fingerprint(r[1]) for r in before]
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(before):
        key = (r[0] is None, r[0] or 0)
        least[find(i)] = min(least.get(find(i), (True, 1 << 62)), key)
    assert sorted((r[0] is None, r[0] or 0) for r in after) == sorted(least.values()) and 0 < len(after) < len(before) + 1
    assert not Counter(after) - Counter(before)


def test_mixing_stage(steps):
    before, mixed = steps["mixing"]
    taken = Counter()
    for r in mixing.mix_documents(before).collect():
        taken[r.doc_id] += r.taken
    own, drawn = {}, Counter()
    for r in rows_of(before):
        own.setdefault(r[0], []).append(WORDS.findall(r[1] or ""))
    for i, text, lang, source, n in rows_of(mixed):
        words = WORDS.findall(text)
        drawn[i] += len(words)
        assert words and n == len(text) and any(not Counter(words) - Counter(w) for w in own[i])
        if sum(len(w) for w in own[i]) == len(words):
            assert text in [r[1] for r in rows_of(before) if r[0] == i] or len(own[i]) > 1
        rest = iter(max(own[i], key=lambda w: len(set(w) & set(words))))  # the drawn words stand in the order of the text
        assert all(w in rest for w in words)
    assert drawn == +taken


def test_encoding_stage(steps):
    mixed, encoded = steps["byte-level BPE"]
    enc = tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=bpe.ranks(bpe.vocabulary()), special_tokens={})
    want = Counter((r[0], tuple(enc.encode_ordinary(r[1]))) for r in rows_of(mixed))
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == want and encoded.where("n_tokens <> size(ids)").count() == 0


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
