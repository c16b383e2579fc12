"""Quality from positive and unlabelled texts.

A logistic model over binned ratios of a text's counts minimises the non-negative
unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),
with a step that raises the second part again where it falls below zero: first with the
logistic loss, then with the bounded sigmoid loss. No negative label is read. The class prior comes from the same two samples: a first model tells
positives from unlabelled texts, and over the thresholds of its score on the other
half the smallest upper bound of (share of unlabelled above) / (share of positives
above) is the prior.

Positives and unlabelled texts are samples of at most ``MAX_POSITIVE`` and about
``MAX_UNLABELLED`` rows, by the hash of their id, none of them held out. Null and empty
texts have all counts zero and get that point's score. Without positives every score
is the default prior. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, sampled, small_batches
from .text_stats import COUNTS, counts, with_counts

MAX_POSITIVE = 12_000
MAX_UNLABELLED = 12_000
BINS = 12
STEPS = 8
PRIOR = 0.5
THRESHOLD = 0.7


def features(x: dict[str, np.ndarray]) -> np.ndarray:
    per = lambda a, b: x[a] / np.maximum(x[b], 1)
    return np.column_stack(
        [
            np.log1p(x["n_words"]), per("word_chars", "n_words"), per("n_symbols", "n_words"), per("n_symbol_words", "n_words"),
            per("n_bar_words", "n_words"), per("n_upper_words", "n_words"), per("n_bang_words", "n_words"), per("n_twin_words", "n_words"),
            per("n_repeat_words", "n_words"), per("n_dup_lines", "n_lines"), per("n_letters", "word_chars"), per("n_digits", "word_chars"),
            per("n_stop_words", "n_words"), per("n_long_words", "n_words"), per("n_words", "n_lines"), per("n_other", "word_chars"),
        ]
    )


@dataclass
class Model:
    edges: list[np.ndarray]
    weights: np.ndarray
    prior: float

    def design(self, f: np.ndarray) -> np.ndarray:
        """For each feature the place in the weights of its bin."""
        start, out = 1, []
        for k, e in enumerate(self.edges):
            out.append(start + np.searchsorted(e, f[:, k], "left"))
            start += len(e) + 1
        return np.column_stack(out)

    def logit(self, f: np.ndarray) -> np.ndarray:
        return self.weights[0] + self.weights[self.design(f)].sum(axis=1)

    def score(self, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(f), -30, 30)))


def bin_edges(f: np.ndarray) -> list[np.ndarray]:
    """For each feature quantiles, and even steps of its range, so that rare large values aren't in one bin with common small ones."""
    out = []
    for v in f.T:
        quantiles = np.quantile(v, np.r_[np.linspace(0, 1, BINS + 1)[1:-1], 0.95, 0.98, 0.99])
        out.append(np.unique(np.r_[quantiles, np.linspace(v.min(), v.max(), STEPS + 1)[1:-1]]))
    return out


def _descend(model: Model, gradient, steps: int = 400, rate: float = 0.05) -> None:
    """Adam over the whole sample, from zero."""
    m = v = np.zeros_like(model.weights)
    for t in range(1, steps + 1):
        g = gradient(model.weights)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        model.weights = model.weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def _both(model: Model, positive: np.ndarray, unlabelled: np.ndarray):
    dp, du, size = model.design(positive), model.design(unlabelled), len(model.weights)

    def logits(w: np.ndarray, d: np.ndarray) -> np.ndarray:
        return w[0] + w[d].sum(axis=1)

    def back(d: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.bincount(d.ravel(), np.repeat(g, d.shape[1]), size)
        out[0] = g.sum()
        return out

    return dp, du, logits, back


def minimise_risk(positive: np.ndarray, unlabelled: np.ndarray, edges: list[np.ndarray], prior: float, decay: float = 1e-5) -> Model:
    model = Model(edges, np.zeros(1 + sum(len(e) + 1 for e in edges)), prior)
    dp, du, logits, back = _both(model, positive, unlabelled)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def logistic(w: np.ndarray) -> np.ndarray:
        zp, zu = logits(w, dp), logits(w, du)
        plus = prior * back(dp, (sigmoid(zp) - 1) / len(zp))
        minus = back(du, sigmoid(zu) / len(zu)) - prior * back(dp, sigmoid(zp) / len(zp))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        return (plus + minus if negative >= 0 else -minus) + decay * w

    def bounded(w: np.ndarray) -> np.ndarray:
        sp, su = sigmoid(logits(w, dp)), sigmoid(logits(w, du))
        slope_p, slope_u = sp * (1 - sp), su * (1 - su)
        plus = -prior * back(dp, slope_p / len(sp))
        minus = back(du, slope_u / len(su)) - prior * back(dp, slope_p / len(sp))
        return (plus + minus if su.mean() - prior * sp.mean() >= 0 else -minus) + decay * w

    # The logistic loss finds the way; its tail is noise next to the few negatives, so
    # the bounded sigmoid loss finishes.
    _descend(model, logistic)
    _descend(model, bounded)
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, edges: list[np.ndarray], confidence: float = 0.1) -> float:
    """The share of positives among unlabelled rows."""
    halves = [(a[::2], a[1::2]) for a in (positive, unlabelled)]
    (p, p_test), (u, u_test) = halves
    model = Model(edges, np.zeros(1 + sum(len(e) + 1 for e in edges)), PRIOR)
    dp, du, logits, back = _both(model, p, u)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    _descend(model, lambda w: back(dp, (sigmoid(logits(w, dp)) - 1) / len(p)) + back(du, sigmoid(logits(w, du)) / len(u)) + 1e-3 * w)
    zp, zu = np.sort(model.logit(p_test)), np.sort(model.logit(u_test))
    cuts = np.unique(zp)
    above_p = 1 - np.searchsorted(zp, cuts, "left") / len(zp)
    above_u = 1 - np.searchsorted(zu, cuts, "left") / len(zu)
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(zp)) + 1 / np.sqrt(len(zu)))
    best = int(np.argmin((above_u + slack) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> Model:
    known = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~fold(F.col("doc_id"), modulus, remainder)).select("doc_id").distinct()
    known = sampled(known, "doc_id", MAX_POSITIVE).withColumn("positive", F.lit(True))
    total = docs.count()
    share = min(1.0, MAX_UNLABELLED / max(1, total))
    # Other bits of the hash than those that order the positives.
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("unlabelled")), F.lit(1_000_000)) < int(share * 1_000_000)
    rows = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & ~fold(F.col("doc_id"), modulus, remainder))
    rows = rows.withColumn("drawn", drawn).join(F.broadcast(known), "doc_id", "left").filter(F.col("drawn") | F.col("positive"))
    found = with_counts(rows, carry=("drawn", "positive")).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    f = features({c: found[c].to_numpy(float) for c in COUNTS})
    positive, unlabelled = f[found["positive"].notna().to_numpy()], f[found["drawn"].to_numpy(bool)]
    if len(positive) < 4 or len(unlabelled) < 4:
        return Model([np.zeros(0)] * f.shape[1], np.zeros(1 + f.shape[1]), PRIOR)
    edges = bin_edges(unlabelled)
    return minimise_risk(positive, unlabelled, edges, estimate_prior(positive, unlabelled, edges))


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = features({k: v.astype(float) for k, v in counts(batch.column(1)).items()})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(f))], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more, with the columns of docs."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = features({k: v.astype(float) for k, v in counts(batch.column(at)).items()})
            yield batch.filter(pa.array(model.score(f) >= threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
