"""Toxicity by a subsequence string kernel and Nyström landmarks (operator 6).

The kernel compares words (or windows of long ones) by the ordered triples of letters that they have in common, gaps
allowed: a triple that spans g letters more than three counts DECAY**g, up to GAP. An insult with letters put in or
taken out still has most of its triples. A support vector machine is trained in the space that the kernel's values at a
few landmarks span; because a triple is one of CODES**3 features, its decision collapses into one weight
for each triple. The margin of a sentence is the largest of its words, and that of a text the largest of its sentences.

It is trained on labelled sentences. Those of clean texts are clean. Of a toxic text, the sentences that hold a word which chance
hardly puts into so many toxic texts are toxic; which of the others are is not known. A sentence stands for its witness, the word that
makes it what it is: of a toxic one first the most surprising word, of a clean one any. Then the model itself finds witnesses, over whole
texts: clean texts' words that it mistakes, and words for which it takes toxic texts for toxic, train the next model. A logistic curve
through the labelled texts' margins makes a score of a margin.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of
from .linear import logistic, sigmoid, squared_hinge

GAP, DECAY = 3, 0.6
#: Letters of a window; words that are longer give windows that overlap by half.
LETTERS = 24
LANDMARKS = 320
#: Codes of letters: a-z have their own, any other character one of the rest by a hash.
CODES = 48
#: Labelled rows that the model is fitted on at most, taken by a hash of their id, and labelled sentences of either kind, by a hash of the sentence.
SAMPLE, SENTENCES = 20_000, 5_000
#: Models fitted one after another, each with the witnesses of the one before.
ROUNDS = 4
THRESHOLD = 0.3
SEED = 6
_RUNS = re.compile(r"(.)\1{2,}", re.S)
_SPANS = [(a, b) for b in range(2, GAP + 3) for a in range(1, b)]


def plain(word: str) -> str:
    """A word in lower case without the signs at its ends and marks on its letters; of a character many times in a row two stay."""
    word = _RUNS.sub(r"\1\1", word.strip(".,;:!?\"'()[]{}<>*#$%&|-_/\\~`+=@^").lower())
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def letter_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (-1 beyond the end) of windows of words, and the word that each window belongs to."""
    windows, owner = [], []
    for i, w in enumerate(words):
        w = plain(w)
        for k in range(0, max(1, len(w) - LETTERS // 2), LETTERS // 2):
            windows.append(w[k : k + LETTERS])
            owner.append(i)
    width = max(map(len, windows), default=0)
    codes = np.full((len(windows), width + GAP + 2), -1, np.int32)
    if width:
        points = np.frombuffer("".join(x.ljust(width, "\0") for x in windows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width)
        other = 26 + (points * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(CODES - 26)
        codes[:, :width] = np.where(points == 0, -1, np.where((points >= 97) & (points <= 122), points.astype(np.int32) - 97, other.astype(np.int32)))
    return codes, np.array(owner, np.int64)


def triples(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pattern of gaps: triples (windows x places), -1 where one would pass the end, and their weights, zero there."""
    width, out = codes.shape[1] - GAP - 2, []
    for a, b in _SPANS:
        x, y, z = codes[:, :width], codes[:, a : width + a], codes[:, b : width + b]
        out.append((np.where(z >= 0, (x * CODES + y) * CODES + z, -1), np.where(z >= 0, DECAY ** (b - 2), 0.0)))
    return out


def scale(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The length of each window's feature vector, in which the weights of equal triples add up."""
    count, width = found[0][0].shape
    if not count * width:
        return np.ones(count)
    keys = np.sort(np.concatenate([f << 4 | k for k, (f, _) in enumerate(found)], 1), 1)
    weights = np.array([DECAY ** (b - 2) for _, b in _SPANS] + [0.0] * 6)[keys & 15]
    weights[keys < 0] = 0
    f = keys >> 4
    start = np.flatnonzero(np.c_[np.ones(count, bool), f[:, 1:] != f[:, :-1]])
    sums = np.add.reduceat(weights.ravel(), start)
    return np.sqrt(np.maximum(1e-9, np.bincount(start // f.shape[1], sums * sums, count)))


def features(codes: np.ndarray) -> np.ndarray:
    """The scaled feature vector (CODES**3) of one window."""
    found, out = triples(codes), np.zeros(CODES**3)
    for f, w in found:
        np.add.at(out, f[0], w[0])
    return out / scale(found)[0]


def project(found: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """Products of windows' feature vectors, not scaled, with one vector."""
    return sum((weights[f] * w).sum(1) for f, w in found)


def word_margins(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Margin of each word: the largest of its windows. Words of about one length are worked on together."""
    out = np.full(len(words), -np.inf)
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    for k in range(0, len(words), 8192):
        rows = order[k : k + 8192]
        codes, owner = letter_codes([words[i] for i in rows])
        found = triples(codes)
        np.maximum.at(out, rows[owner], project(found, weights) / scale(found) + bias)
    return out


def fit_words(words: list[str], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of triples and a bias, from words with labels (-1 or 1) and weights.

    Landmarks are taken one by one, each the word that those before it describe least (by weight): a pivoted
    Cholesky factor of the kernel, whose rows are the words' coordinates.
    """
    codes, owner = letter_codes(words)
    found = triples(codes)
    length, count = scale(found), min(LANDMARKS, len(codes))
    factor, chosen = np.zeros((len(codes), count)), []
    rest = (length > 1e-3).astype(float)
    for k in range(count):
        i = int(np.argmax(rest * weight[owner]))
        if rest[i] < 1e-3:
            break
        column = project(found, features(codes[i : i + 1])) / length - factor[:, :k] @ factor[i, :k]
        factor[:, k] = column / np.sqrt(column[i])
        rest = np.maximum(0, rest - factor[:, k] ** 2)
        rest[i] = 0
        chosen.append(i)
    factor = factor[:, : len(chosen)]
    w = squared_hinge(factor, y[owner], weight[owner], ridge=0.02)
    weights = np.zeros(CODES**3)
    for i, share in zip(chosen, np.linalg.solve(factor[chosen].T, w[:-1])):
        weights += share * features(codes[i : i + 1])
    return weights.astype(np.float32), float(w[-1])


def words_of(texts: pa.Array) -> tuple[pa.ListArray, list[str], np.ndarray]:
    """Words by text, the distinct words, and the place of each word among these."""
    lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    return lists, coded.dictionary.to_pylist(), coded.indices.to_numpy()


def text_margins(texts: pa.Array, weights: np.ndarray, bias: float) -> tuple[np.ndarray, list[str]]:
    """The largest margin of each text's words, and that word; texts without words have the bias and no word."""
    lists, words, at = words_of(texts)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out, best = np.full(len(texts), bias), [""] * len(texts)
    if at.size:
        margins, end = word_margins(words, weights, bias), np.cumsum(size)
        for i in np.flatnonzero(size):
            own = at[end[i] - size[i] : end[i]]
            top = own[np.argmax(margins[own])]
            out[i], best[i] = margins[top], words[top]
    return out, best


def unspaced(text: Column) -> Column:
    """Words of one letter each, one after another, as one word."""
    return F.regexp_replace(text, r"(?<!\S)(\S)[ \t](?=\S(?!\S))", "$1")


def _scored(source: DataFrame, model, columns: str) -> DataFrame:
    """``source`` (ending in text) with text replaced by its margin and the word that gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                margins, words = text_margins(part.columns[-1], weights, bias)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(margins), pa.array(words)], [*part.schema.names[:-1], "margin", "word"])

    return source.mapInArrow(run, columns)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sentences(rows: DataFrame, base: float, sentences: int) -> tuple[list, list]:
    """(word, n) of toxic and of clean labelled sentences of ``rows`` (toxic, text): their witnesses, and of how many sentences each is; ``sentences`` sentences of a kind at most."""
    spoken = rows.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word")).where("word <> ''")
    counted = materialise(spoken.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")))
    share, tests = F.col("bad") / F.col("n"), counted.count()
    # The share's divergence from that of all texts, n times: the logarithm of how unlikely chance makes it.
    part = lambda p, q: F.when(p > 0, p * F.log(p / q)).otherwise(0.0)
    counted = counted.withColumn("surprise", F.col("n") * (part(share, F.lit(base)) + part(1 - share, F.lit(1 - base))))
    telling = counted.where((share > (1 + base) / 3) & (F.col("surprise") > float(np.log(2 * max(tests, 1))))).select("word", "surprise")
    spoken = rows.select("toxic", F.explode(F.split(F.lower("text"), r"[.!?]+\s+|\n")).alias("sentence"))
    spoken = spoken.select("toxic", "sentence", F.array_distinct(F.filter(F.split("sentence", r"\s+"), lambda w: w != "")).alias("words")).where(F.size("words") > 0)
    toxic = spoken.where("toxic = 1").select("sentence", F.explode("words").alias("word")).join(telling, "word").groupBy("sentence").agg(F.max(F.struct("surprise", "word")).alias("top"))
    clean = spoken.where("toxic = 0").select("sentence", F.element_at("words", (F.pmod(F.xxhash64("sentence"), F.size("words")) + 1).cast("int")).alias("word")).dropDuplicates(["sentence"])
    chosen = lambda df, word: df.select("sentence", F.col(word).alias("word")).orderBy(F.xxhash64("sentence")).limit(sentences).groupBy("word").agg(F.count("*").alias("n")).orderBy("word").collect()
    return chosen(toxic, "top.word"), chosen(clean, "word")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sentences: int = SENTENCES):
    """(weights, bias) of the words' margin and (slope, shift) of the score, from labelled rows that aren't held out."""
    spark = docs.sparkSession
    chosen = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id")).limit(sample)  # so many rows at most are broadcast
    rows = materialise(docs.select("doc_id", unspaced(text_of("text")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "toxic", "text"))
    base, n = rows.agg(F.avg("toxic"), F.count("*")).first()
    constant = (np.zeros(CODES**3, np.float32), 0.0), (0.0, float(np.log((base or 0.1) / (1 - min(base or 0.1, 0.999)))))
    if not n or base in (0.0, 1.0):
        return constant
    bad, good = labelled_sentences(rows, base, sentences)
    if not bad or not good:
        return constant
    known = {r.word: (-1.0, float(r.n) ** 0.5) for r in good} | {r.word: (1.0, float(r.n)) for r in bad}
    for turn in range(ROUNDS):
        words, (y, trust) = list(known), np.array(list(known.values())).T
        weight = np.minimum(trust * np.where(y > 0, 0.5 / trust[y > 0].sum(), 0.5 / trust[y < 0].sum()) * len(y), 50.0)
        model = fit_words(words, y, weight)
        shared = spark.sparkContext.broadcast(model)
        scored = _scored(rows.select("doc_id", "toxic", "text"), shared, "doc_id long, toxic int, margin double, word string").toPandas()  # ``sample`` rows at most
        wrong = set(scored[(scored.toxic == 0) & (scored.margin > -0.6)].word) - {"", *known}
        right = set(scored[(scored.toxic == 1) & (scored.margin > 0)].word) - {"", *known, *wrong}
        if turn == ROUNDS - 1 or not wrong | right:
            break
        known |= {w: (-1.0, 2.0) for w in sorted(wrong)} | {w: (1.0, 1.0) for w in sorted(right)}
    slope, shift = logistic(scored[["margin"]].to_numpy(), scored["toxic"].to_numpy().astype(float), ridge=0.1)
    return model, (float(slope), float(shift))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    ``labels`` (doc_id, toxic) teach only by rows whose crc32 of the id is not 2 modulo 4. The score depends on
    the text alone; null and empty texts have the score of a text whose words say nothing. Null ids are not held out.
    Without labels of both kinds every score is their share (0.1 without any). Repeated rows each give a row, an
    empty table none; other columns of ``docs`` are not looked at.
    """
    model, (slope, shift) = fit(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select("doc_id", unspaced(text_of("text")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    scored = _scored(source, shared, f"doc_id {kind}, margin double, word string")
    score = 1 / (1 + F.exp(-(F.col("margin") * slope + shift)))
    scored = scored.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
