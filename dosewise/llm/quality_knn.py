"""Quality: nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words, each word's shape (letters, capitals, digits and
punctuation), and a mark for every word that repeats the one before; hashed
into ``TERMS`` columns, weighted by log frequency and inverse document
frequency.  A truncated singular value decomposition of the labelled texts
gives the latent space.  The labelled vectors and the projection, both of a
fixed largest size, are broadcast; every document is projected, its exact
cosines with all labelled vectors are computed in blocks, and its nearest
neighbours' labels are weighted by similarity.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from dosewise.llm.common import id_text, labelled_sample, per_batch

WORD_TERMS, SHAPE_TERMS = 3072, 1023
#: Hashed words, hashed shapes, repeated words.
TERMS = WORD_TERMS + SHAPE_TERMS + 1
BLOCK = 512
_RUNS = re.compile(r"(.)\1+")


@dataclass
class Model:
    idf: np.ndarray  # TERMS
    axes: np.ndarray  # TERMS x rank
    vectors: np.ndarray  # labelled vectors, unit length
    labels: np.ndarray
    votes: np.ndarray  # labelled ids that each vector stands for
    k: int
    prior: float


@functools.lru_cache(1 << 16)
def _terms(word: str) -> tuple[int, int]:
    shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return (zlib.crc32(word.lower().encode()) % WORD_TERMS, WORD_TERMS + zlib.crc32(_RUNS.sub(r"\1", shape).encode()) % SHAPE_TERMS)


def term_counts(text: str) -> np.ndarray:
    """Counts of the terms of a whole text."""
    words = text.split()
    ids = [i for w in words for i in _terms(w)]
    counts = np.bincount(ids, minlength=TERMS) if ids else np.zeros(TERMS, dtype=np.int64)
    counts[-1] = sum(a == b for a, b in zip(words, words[1:]))
    return counts


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", per_class: int = 2500,
        rank: int = 48, k: int = 25) -> Model:
    """Latent space and labelled vectors from at most ``per_class`` labelled ids of either class.

    Without labelled texts every score is 0.5.
    """
    sample, stands_for = labelled_sample(docs, labels, label_col, learn, per_class)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(t) for t in batch.column("text").to_pylist()]
            at = [np.flatnonzero(c).astype(np.int32) for c in found]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([c[a].astype(np.int32).tobytes() for c, a in zip(found, at)], pa.binary())], names=["label", "at", "n"])

    rows = per_batch(sample, counts, "label int, at binary, n binary").collect()  # at most TERMS numbers for each sampled text
    rows.sort(key=lambda r: (r.label, bytes(r["at"]), bytes(r["n"])))  # the same order whatever the partitions
    x = np.zeros((len(rows), TERMS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int32)
    idf = np.log((1 + len(rows)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = _weighted(x, idf)
    # leading right singular vectors, by subspace iteration from a seeded start
    axes = np.random.default_rng(7).standard_normal((TERMS, rank + 16)).astype(np.float32)
    for _ in range(4):
        axes = np.linalg.qr(x.T @ (x @ axes))[0] if len(rows) else axes
    if len(rows):
        _, _, turn = np.linalg.svd(x @ axes, full_matrices=False)
        axes = axes @ turn.T
    axes = np.ascontiguousarray(axes[:, :rank], dtype=np.float32)
    y = np.array([r.label for r in rows], dtype=np.int64)
    votes = np.array([stands_for[int(v)] for v in y], dtype=np.float64)
    return Model(idf, axes, _unit(x @ axes), y, votes, k, float((votes * y).sum() / votes.sum()) if len(rows) else 0.5)


def vote(model: Model, counts: np.ndarray) -> np.ndarray:
    """Scores of a block of texts' term counts."""
    q = _unit(_weighted(counts, model.idf) @ model.axes)
    if not len(model.labels):
        return np.full(len(q), model.prior)
    sims = (q @ model.vectors.T).astype(np.float64)
    k = min(model.k, sims.shape[1])
    nearest = np.partition(sims, sims.shape[1] - k, axis=1)[:, [sims.shape[1] - k]]
    # all that tie with the k-th count; cubes let close neighbours outweigh distant ones
    w = np.where(sims >= nearest, np.clip(sims, 0, None) ** 3, 0) * model.votes
    total = w.sum(axis=1)
    return np.where(total > 1e-9, (w @ model.labels) / np.maximum(total, 1e-9), model.prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score double`` (0 to 1, higher: label 1 likelier) of every whole text.

    Null and empty texts, and texts like no labelled one, get the share of label 1.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * per_class vectors and the axes, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                counts = np.stack([term_counts(t.as_py()) for t in part.column("text")])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.clip(vote(model, counts), 0, 1))], names=["doc_id", "score"])

    return per_batch(id_text(docs, id_col, text_col), run, "doc_id bigint, score double")
