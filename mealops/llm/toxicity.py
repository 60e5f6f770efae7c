"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the different words, neighbouring pairs and pairs one word apart of a text,
hashed into ``CELLS`` cells. FTRL-proximal gives every cell its own rate and L1 keeps all but
few weights at zero, so the fitted weights are a short list of (cell, weight) that travels
with the tasks. Fitted on at most ``TRAIN_ROWS`` labelled documents; every document is scored
over its whole text.

Defined results: a NULL or empty text has no feature and gets the score of the bias; equal
texts get equal scores; NULL ids pass through; without labels the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, labelled_sample, mix64, stripped

CELLS = 1 << 20
#: Labelled documents the model is fitted on, those with the smallest id hashes.
TRAIN_ROWS = 12_000
PASSES, ALPHA, BETA, L1, L2 = 5, 4.0, 1.0, 6.0, 0.0


def cells(h: np.ndarray) -> np.ndarray:
    """The different cells of words, pairs and skip-pairs."""
    mask = np.uint64(CELLS - 1)
    parts = [mix64(h)]
    for gap in (1, 2):
        if len(h) > gap:
            parts.append(mix64(h[:-gap] ^ mix64(h[gap:], gap), 2 + gap))
    return np.unique(np.concatenate(parts) & mask).astype(np.int64)


def fit(bags: list[np.ndarray], y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, cells, weights) after ``PASSES`` passes of FTRL-proximal."""
    if len(y) == 0:
        return 0.0, np.zeros(0, np.int64), np.zeros(0)
    z, n = np.zeros(CELLS + 1), np.zeros(CELLS + 1)
    bias = CELLS  # the last coordinate, without L1

    def weights(i: np.ndarray) -> np.ndarray:
        zi, l1 = z[i], np.where(i == bias, 0.0, L1)
        return np.where(np.abs(zi) <= l1, 0.0,
                        -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rng = np.random.default_rng(5)
    for _ in range(PASSES):
        for d in rng.permutation(len(y)):
            i = np.append(bags[d], bias)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y[d]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    every = np.arange(CELLS + 1)
    w = weights(every)
    kept = np.flatnonzero(w[:-1])
    return float(w[-1]), kept, w[kept]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """Fit on at most ``rows`` labelled documents outside the held-out fold. Texts become
    cells in the tasks; the bounded sample of cells reaches the driver."""
    @F.arrow_udf("array<int>")
    def to_cells(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes(stripped)
        for batch in batches:
            yield pa.array([cells(hashes.of(t)).astype(np.int32) for t in batch.cast(pa.binary()).to_pylist()],
                           pa.list_(pa.int32()))

    got = (labelled_sample(docs, labels, "toxic", rows)
           .select("doc_id", "y", to_cells("text").alias("cells")).toPandas())
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    bags = got["cells"].to_numpy()
    return fit([np.asarray(bags[k]) for k in order], got["y"].to_numpy()[order])


def scorer(bias: float, at: np.ndarray, weight: np.ndarray):
    """Column function: whole text to score between 0 and 1."""
    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes, dense = WordHashes(stripped), np.zeros(CELLS)
        dense[at] = weight
        for batch in batches:
            total = [bias + dense[cells(hashes.of(t))].sum() for t in batch.cast(pa.binary()).to_pylist()]
            yield pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))), pa.float64())
    return toxicity


def toxicity_score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS):
    """The score of ``text`` by weights fitted here on ``docs`` and ``labels``."""
    return scorer(*train(docs, labels, rows))(F.col("text"))
