"""Quality by a document classifier and hierarchical empirical Bayes over sites (operator 2).

A logistic classifier reads a document's text alone. Its probabilities, summed by site and by path within a site, give
posteriors: a path's mean is shrunk toward its site's, and a site's toward that of the whole corpus, the more the
fewer documents it has. How much is estimated from the data, by comparing how sites (paths) differ with
how documents within them do. A document's log odds are its classifier's plus what its path's differ from the corpus's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, materialise, text_of
from .linear import logistic

#: Labelled rows that the classifier is fitted on at most, taken by a hash of their id.
SAMPLE = 20_000
#: Documents below this probability of good quality are rejected.
THRESHOLD = 0.5
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]


def features(text: str) -> list[float]:
    """Figures of a text: shares of kinds of bytes and of each sign, and how much its words and lines repeat."""
    data = text.encode()
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    times = Counter(words)
    w = max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    shapes = [np.log1p(len(data)), upper / max(1, upper + lower), count[48:58].sum() / n, count[128:].sum() / n, np.log1p(len(words)), (n - w) / w / 10, min(2.0, max(map(len, words), default=0) / 40)]
    repeats = [len(times) / w, max(times.values(), default=0) / w, again / w, len(set(lines)) / max(1, len(lines)), np.log1p(len(lines))]
    return [*shapes, *repeats, *np.sqrt(count[_SIGNS] / n)]


def log_odds(weights: np.ndarray, centre: np.ndarray, spread: np.ndarray):
    """A function of text: log odds of good quality."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts]).reshape(len(texts), len(centre))
            yield pd.Series(np.clip((x - centre) / spread, -8, 8) @ weights[:-1] + weights[-1])

    return score


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(weights with bias last, centre, spread) from labelled rows, ``sample`` of them at most."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id")).limit(sample)  # so many rows at most are broadcast
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")

    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([list(map(float, features(t))) for t in texts])

    size = len(features(""))
    table = rows.select("quality", measured("text").alias("x")).toPandas()  # ``sample`` rows of figures
    y = table["quality"].to_numpy(float)
    weights, centre, spread = np.zeros(size + 1), np.zeros(size), np.ones(size)
    if len(y) and 0 < y.mean() < 1:
        x = np.array(table["x"].tolist())
        centre, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
        weights = logistic(np.clip((x - centre) / spread, -8, 8), y, ridge=2.0)
    elif len(y):
        weights[-1] = 4.0 if y.mean() else -4.0
    return weights, centre, spread


def strength(groups: DataFrame, mean: str) -> float:
    """Prior strength, in documents, by moments: groups (n, s, ss: documents, sum and squared sum) about their prior mean."""
    g = groups.select("n", "s", "ss", (F.col("s") / F.col("n")).alias("m"), F.col(mean).alias("prior"))
    inside = F.sum(F.col("ss") - F.col("n") * F.col("m") ** 2)
    row = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), inside.alias("inside"), F.sum(F.col("n") * (F.col("m") - F.col("prior")) ** 2).alias("between"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")).first()
    if not row.k or row.n <= row.k:
        return 1e6
    within = row.inside / (row.n - row.k)
    spread = (row.between - (row.k - 1) * within) / max(row.n - row.nn / row.n, 1e-9)
    return float(np.clip(within / spread, 1.0, 1e6)) if spread > 0 else 1e6


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(group, n, site_posterior, path_posterior) and the corpus's mean, from rows (group, site, path, p); group names site and path."""
    paths = materialise(scored.groupBy("group", "site", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")))
    total = paths.agg(F.sum("s"), F.sum("n")).first()
    mean = min(max((total[0] or 0.5) / (total[1] or 1), 1e-6), 1 - 1e-6)
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).withColumn("prior", F.lit(mean))
    k = strength(sites, "prior")
    sites = materialise(sites.select("site", ((F.lit(k * mean) + F.col("s")) / (F.lit(k) + F.col("n"))).alias("site_posterior")))
    paths = paths.join(sites.withColumnRenamed("site", "_site"), F.col("site").eqNullSafe(F.col("_site"))).drop("_site")
    k = strength(paths, "site_posterior")
    return materialise(paths.select("group", "n", "site_posterior", ((F.col("site_posterior") * k + F.col("s")) / (F.lit(k) + F.col("n"))).alias("path_posterior"))), mean


def group_key(site: str, path: str) -> Column:
    """One name for a site and a path within it; null is a site (path) of its own."""
    return F.concat_ws("|", F.coalesce(F.length(site).cast("string"), F.lit("null")), F.col(path).isNull().cast("string"), site, path)


def judged(odds: DataFrame) -> DataFrame:
    """``odds`` (_row, _site, _path, _odds) with evidence, site_posterior, path_posterior, score and keep, with a leading underscore.

    The classifier has read each text once; rows of hot sites meet their posteriors in a broadcast join.
    """
    rows = materialise(odds.withColumn("_group", group_key("_site", "_path")))
    p = 1 / (1 + F.exp(-F.col("_odds")))
    posteriors, mean = site_posteriors(rows.select(F.col("_group").alias("group"), F.col("_site").alias("site"), F.col("_path").alias("path"), p.alias("p")))
    posteriors = posteriors.select(*[F.col(c).alias(f"_{c}") for c in posteriors.columns])
    found = heavy_join(rows, posteriors, "_group", "_n", rows.count())
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("_path_posterior")))
    total = F.col("_odds") + F.log(q / (1 - q)) - float(np.log(mean / (1 - mean)))
    found = found.withColumn("_evidence", p).withColumn("_score", 1 / (1 + F.exp(-total))).withColumn("_keep", F.col("_score") >= THRESHOLD)
    return found.select("_row", "_site", "_path", "_evidence", "_site_posterior", "_path_posterior", "_score", "_keep")


def with_odds(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, site: Column | None = None, path: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (all columns, unless given) as _row, their site (source, unless given), path (lang) and the classifier's log odds."""
    score = log_odds(*fit(docs, labels, sample))
    site, path = F.col("source") if site is None else site, F.col("lang") if path is None else path
    row = F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("_row")
    return docs.select(row, site.alias("_site"), path.alias("_path"), score(text_of("text")).alias("_odds"))


def quality_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, site, path, evidence, site_posterior, path_posterior, score, keep.

    A document's site is its source, its path within the site its language; null is a site (path) of its own. evidence is the
    classifier's probability, score the combined one; rows below THRESHOLD are not kept. Null texts count as empty,
    repeated rows each count, and an empty table gives an empty result. Without labels the evidence is one half for all,
    and all are kept; with labels of one kind, it is that kind's. Other columns of ``docs`` are not looked at.
    """
    rows = judged(with_odds(docs, labels, ["doc_id"], sample=sample))
    return rows.select("_row.doc_id", *[F.col(f"_{c}").alias(c) for c in ("site", "path", "evidence", "site_posterior", "path_posterior", "score", "keep")])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names, and as often as they are there.

    Null and empty texts are judged by their site and path and the figures of a text without words; null sources and languages are a site and a path of their own. Equal rows, and rows
    that tie, have one judgement. Without labels all are kept; with labels of one kind the evidence is that kind's. An empty table gives an empty result.
    """
    return judged(with_odds(docs, labels)).where("_keep").select("_row.*")
