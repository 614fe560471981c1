"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Each text is the set of its hashed character n-grams.  From labelled text come
smoothed counts of the texts of either class that hold an n-gram; their log
ratio scales the n-gram's feature, and a logistic regression over the scaled
features gives the weights.  Scoring sums weights of the n-grams found, one
vectorised pass over each whole text.

Fitting uses at most ``per_class`` labelled ids of either class (a documented
bound); counts are summed by Spark, and what the driver trains on is the
sample's ``n_features`` n-grams that tell the classes apart best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.llm.common import id_text, labelled_sample, per_batch, stored

ORDERS = (3, 4, 5)
BITS = 18
SPACES = np.array([9, 10, 11, 12, 13], dtype=np.uint32)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Model:
    """``weights`` by hashed n-gram (zero: not a feature), and the intercept."""

    weights: np.ndarray
    bias: float


#: Characters of a text looked at together.
PIECE = 1 << 18


def ngrams(text: str) -> np.ndarray:
    """The different hashed n-grams of the lower-cased text with a space at either end, found piece by piece."""
    text = f" {text.lower()} "
    reach = max(ORDERS) - 1  # pieces overlap, so that every n-gram lies in one
    found = [np.unique(_hashed(text[k : k + PIECE + reach])) for k in range(0, len(text), PIECE)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _hashed(text: str) -> np.ndarray:
    """Hashed n-grams of a piece of text, repeats included."""
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    cp = np.where(np.isin(cp, SPACES), np.uint32(32), cp).astype(np.uint64)
    found, h = [], cp
    for n in range(2, max(ORDERS) + 1):
        if len(cp) < n:
            break
        h = h[: len(cp) - n + 1] * _BASE + cp[n - 1 :]
        if n in ORDERS:
            found.append(((h ^ (h >> np.uint64(29))) * _MIX + np.uint64(n)) >> np.uint64(64 - BITS))
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either class that hold each n-gram, summed within the task."""
    seen = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
            seen[label, ngrams(text)] += 1
    hit = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(seen[0, hit]), pa.array(seen[1, hit])], names=["ngram", "n0", "n1"])


def _train(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, ratio: np.ndarray, steps: int, decay: float) -> tuple[np.ndarray, float]:
    """Logistic regression over binary features scaled by ``ratio``, full-batch Adam."""
    col = np.concatenate(rows) if rows else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.ones(len(ratio)) * 0.1, 0.0
    share = weights / weights.sum()
    m = v = np.zeros(len(ratio) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, (w * ratio)[col], len(rows)) + b
        gap = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        grad = np.append(np.bincount(col, gap[row], len(ratio)) * ratio + decay * w, gap.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w * ratio, float(b)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", per_class: int = 3000,
        n_features: int = 1 << 14, least_z: float = 4.0, steps: int = 200, decay: float = 1e-5) -> Model:
    """Train on labelled texts whose ``doc_id`` satisfies ``learn``.

    Features are the ``n_features`` n-grams whose shares in the two classes
    differ most, in standard errors, and by at least ``least_z`` of them: with
    fewer, an n-gram of the sample differs by chance (without that bound, 0.59
    instead of over 0.8 of the held-out toxic texts at sf0.1 are caught).

    Without labelled texts of both classes the model has no features and gives
    every text the one class's label as score (0 where there is none at all).
    """
    sample, stands_for = labelled_sample(docs, labels, label_col, learn, per_class)
    sample = stored(sample, "toxic-sample")
    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if len(n) < 2:
        return Model(weights, 40.0 if 1 in n else -40.0)
    counts = per_batch(sample, _counts, "ngram bigint, n0 bigint, n1 bigint").groupBy("ngram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # smoothed shares of the texts of either class that hold the n-gram, and how surely they differ
    p1, p0 = (F.col("n1") + 1.0) / (n[1] + 2.0), (F.col("n0") + 1.0) / (n[0] + 2.0)
    spread = F.sqrt(p1 * (1 - p1) / float(n[1]) + p0 * (1 - p0) / float(n[0]))
    best = (counts.select("ngram", F.log(p1 / p0).alias("ratio"), (F.abs(p1 - p0) / spread).alias("z"))
            .where(F.col("z") >= least_z).orderBy(F.desc("z"), "ngram").limit(n_features).collect())
    chosen = np.array(sorted(r.ngram for r in best), dtype=np.int64)
    ratio_of = {r.ngram: r.ratio for r in best}
    ratio = np.array([ratio_of[g] for g in chosen.tolist()])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[chosen] = np.arange(len(chosen), dtype=np.int32)
        for batch in batches:
            found = [np.sort(p[p >= 0]) for p in (place[ngrams(t)] for t in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([f.tobytes() for f in found], pa.binary())], names=["label", "at"])

    rows = per_batch(sample, features, "label int, at binary").collect()  # at most n_features numbers for each sampled text
    rows.sort(key=lambda r: (r.label, bytes(r["at"])))  # the same order whatever the partitions
    y = np.array([r.label for r in rows], dtype=float)
    # either class counts half in training, then the intercept is set back half way to the true shares
    each = np.array([1 / n[r.label] for r in rows])
    w, b = _train([np.frombuffer(r["at"], np.int32).astype(np.int64) for r in rows], y, each, ratio, steps, decay)
    weights[chosen] = w
    return Model(weights, b + 0.5 * float(np.log(stands_for[1] * n[1] / (stands_for[0] * n[0]))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score double`` of every whole text; null and empty texts score like a text without known n-grams."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 floats, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value.weights, sent.value.bias
        known = weights != 0
        for batch in batches:
            out = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column("text")):
                grams = ngrams(text.as_py())
                out[k] = weights[grams[known[grams]]].sum(dtype=np.float64) + bias
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -40, 40))))], names=["doc_id", "score"])

    return per_batch(id_text(docs, id_col, text_col), run, "doc_id bigint, score double")
