"""Operator 9: document quality by positive-unlabelled learning.

Trusted positives and unlabelled web text, each a bounded sample of the training rows, fit an additive logistic model
of the text's style; the loss is the non-negative unbiased risk under an estimated share of positives. That share comes from
positives and unlabelled text alone: it is the smallest ratio, over thresholds of a first fit, of the shares of both that lie
above, measured on rows that the first fit hasn't seen. Each measure of
the style enters as a one-hot bin between quantiles of the unlabelled sample. The model, a few kilobytes, is applied to every
whole text in one map-side pass.

Defined results: a null text counts as empty and is scored like any other; rows with a null key belong to neither fold's
training rows and are not held out; repeated rows are scored alike; without any positive label or any text of a training row every score is 0.5; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows in the sample of trusted positives, and in that of unlabelled text.
MAX_POSITIVE, MAX_UNLABELLED = 10_000, 10_000
#: Bins of a measure, steps, learning rate and ridge penalty of the fit.
BINS, STEPS, RATE, RIDGE = 8, 400, 0.3, 1e-6
FOLDS, HELD_OUT = 5, 0
#: Words among which distinct ones are counted, block by block over the whole text: the share doesn't sink with length.
BLOCK = 2000

MEASURES = ["log_words", "word_length", "upper_words", "upper_chars", "digits", "marks", "odd_marks", "bars", "odd_ends", "repeats", "distinct", "lines", "line_repeats", "stops", "letters"]
_MARKS = set(string.punctuation) - set(".,;:'\"()-?")


def measures(text: str) -> list[float]:
    """Style of a text, as shares and means; the order is that of MEASURES."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    count = text.count
    upper = sum(map(count, string.ascii_uppercase))
    digits = sum(map(count, string.digits))
    odd = sum(map(count, _MARKS))
    plain = sum(map(count, ".,;:'\"()-?"))
    ends = [w[-1] for w in words]
    spaces = len(text) - sum(map(len, words))
    return [
        np.log1p(len(words)),
        (size - spaces) / n,
        sum(map(str.isupper, words)) / n,
        upper / size,
        digits / size,
        plain / n,
        odd / n,
        count("|") / n,
        sum(map(_MARKS.__contains__, ends)) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(len(set(words[i : i + BLOCK])) for i in range(0, len(words), BLOCK)) / n,
        n_lines / n,
        1 - len(set(lines)) / n_lines if lines else 0.0,
        sum(map(".?!".__contains__, ends)) / n,
        (size - spaces - digits - odd - plain) / size,
    ]


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Bin edges of each measure: distinct quantiles, and one just above zero, where many texts are."""
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.r_[1e-9, np.quantile(c, cuts)]) for c in x.T]


def cells(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The weight that each measure of each row uses: bins are numbered over all measures."""
    first = np.cumsum([0, *(len(e) + 1 for e in edges[:-1])])
    return np.stack([f + np.searchsorted(e, c, side="right") for f, e, c in zip(first, edges, x.T, strict=True)], axis=1)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, bins: int = BINS, steps: int = STEPS) -> dict:
    """Weights that minimise prior * E+[l(g)] + max(0, Eu[l(-g)] - prior * E+[l(-g)]), l the logistic loss.

    Where the bracket is negative the step goes the other way, out of the overfit.
    """
    edges = edges_of(unlabelled, bins)
    size = sum(len(e) + 1 for e in edges)
    p, u = cells(positive, edges), cells(unlabelled, edges)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))

    def probability(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(w[x].sum(1) + w[-1])))

    def mean_gradient(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(x.ravel(), np.repeat(by, x.shape[1]), size), by.sum()] / len(x)

    for t in range(1, steps + 1):
        on_p, on_u = probability(p), probability(u)
        loss_p, loss_u = -np.log1p(-np.minimum(on_p, 1 - 1e-12)), -np.log1p(-np.minimum(on_u, 1 - 1e-12))
        negative = mean_gradient(u, on_u) - prior * mean_gradient(p, on_p)
        grad = prior * mean_gradient(p, on_p - 1) + negative if loss_u.mean() >= prior * loss_p.mean() else -negative
        grad[:-1] += RIDGE * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"edges": edges, "weights": w}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if not len(x):
        return np.zeros(0)
    w = model["weights"]
    return 1 / (1 + np.exp(-(w[cells(x, model["edges"])].sum(1) + w[-1])))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS // 2) -> float:
    """The share of positives among the unlabelled: the threshold is that whose ratio is smallest with a standard error on both sides."""
    above_p, above_u = [], []
    for fold in (0, 1):
        model = fit(positive[fold::2], unlabelled[fold::2], 0.5, steps=steps)
        above_p.append(predict(model, positive[1 - fold :: 2]))
        above_u.append(predict(model, unlabelled[1 - fold :: 2]))
    p, u = (np.sort(np.concatenate(x)) for x in (above_p, above_u))
    cuts = np.unique(p)
    share_p, share_u = (1 - np.searchsorted(x, cuts) / len(x) for x in (p, u))
    error_p, error_u = (np.sqrt((x * (1 - x) + 1 / n) / n) for x, n in ((share_p, len(p)), (share_u, len(u))))
    best = ((share_u + error_u) / np.maximum(1e-9, share_p - error_p)).argmin()
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def fold(key):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS))


def sampled_measures(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Measures of the documents that a bounded table of ids names, in a fixed order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [measures(x or "") for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": rows})

    found = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text").mapInPandas(run, "doc_id long, x array<double>").collect()
    return np.array([r.x for r in sorted(found, key=lambda r: (r.doc_id, r.x))]).reshape(-1, len(MEASURES))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> dict | None:
    """The fitted model, or none without positives or text."""
    trusted = labels.where(fold("doc_id") != HELD_OUT).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality IS NOT NULL")
    order = F.xxhash64("doc_id")
    # Labels without a document would use up the bound.
    positives = trusted.where("quality = 1").select("doc_id").join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_positive)
    unlabelled = docs.where(fold("doc_id") != HELD_OUT).select("doc_id").orderBy(order, "doc_id").limit(max_unlabelled).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    p, u = sampled_measures(texts, positives), sampled_measures(texts, unlabelled)
    return fit(p, u, class_prior(p, u) if min(len(p), len(u)) > 1 else 0.5) if len(p) and len(u) else None


def scores(docs: DataFrame, model: dict | None, text: str = "text"):
    """A column: the probability that a text is of good quality."""
    if model is None:
        return F.lit(0.5).cast("double")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([measures(t or "") for t in batch]).reshape(-1, len(MEASURES))
            yield pd.Series(predict(model, x), dtype="float64")

    return F.pandas_udf(run, "double")(F.col(text))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score the threshold or more, with all their columns."""
    return docs.where(scores(docs, train(docs, labels)) >= threshold)


def op9_quality(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = docs.select("doc_id", "text").withColumn("score", scores(docs, train(docs, labels)))
    held_out = F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
