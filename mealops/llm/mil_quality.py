"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words. A passage's hashed words and word shapes
go through a learned encoder; gated attention (tanh times sigmoid) weighs the passages, and a
logistic layer scores the weighted representation. Only documents carry labels, so the
attention learns which passages matter. The model is about 11,000 numbers and is fitted on at
most ``TRAIN_ROWS`` labelled documents; every document is scored over its whole text.

Defined results: a NULL or empty text is one empty passage and gets that passage's score;
equal texts get equal scores; NULL ids pass through; without labelled documents of both kinds
every score is the share of good ones among the labels (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, shape

PASSAGE = 64
SHAPES, WORDS = 64, 192
DIM = SHAPES + WORDS
CODE, GATE = 32, 16
#: Labelled documents the model is fitted on, those with the smallest id hashes.
TRAIN_ROWS = 4_000
EPOCHS, BATCH, RATE = 30, 128, 0.01
_BLOCK = 4096  # passages whose features are laid out at once


class WordFeatures(dict):
    """word -> shape cell * WORDS + word cell; the first ``limit`` words are remembered."""

    def __init__(self, limit: int = 400_000):
        self.limit, self.shapes = limit, {}

    def __missing__(self, word: bytes) -> int:
        s = shape(word)
        cell = self.shapes.get(s)
        if cell is None:
            cell = xxhash.xxh3_64_intdigest(s) % SHAPES * WORDS
            if len(self.shapes) < 10_000:
                self.shapes[s] = cell
        cell += xxhash.xxh3_64_intdigest(word) % WORDS
        if len(self) < self.limit:
            self[word] = cell
        return cell

    def of(self, text: bytes | None) -> np.ndarray:
        found = (text or b"").split()
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))


def passages(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all words, the passage of each, and each document's first passage plus the
    end; a document without words has one empty passage."""
    count = np.array([max(1, -(-len(d) // PASSAGE)) for d in docs], np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    words = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    place = np.concatenate([np.arange(len(d)) // PASSAGE + f for d, f in zip(docs, first)] or [np.zeros(0, np.int64)])
    return words, place, first


def layout(words: np.ndarray, place: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Feature rows of passages lo..hi: root shares of shape and word cells."""
    a, b = np.searchsorted(place, [lo, hi])
    row = (place[a:b] - lo) * DIM
    x = np.bincount(np.concatenate([row + words[a:b] // WORDS, row + SHAPES + words[a:b] % WORDS]),
                    minlength=(hi - lo) * DIM).reshape(hi - lo, DIM).astype(np.float32)
    return np.sqrt(x / np.maximum(x[:, :SHAPES].sum(1, keepdims=True), 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _softmax(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    size = np.diff(first)
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, first[:-1]), size))
    return e / np.repeat(np.add.reduceat(e, first[:-1]), size)


class Model:
    def __init__(self, prior: float = 0.5):
        rng = np.random.default_rng(7)
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"We": scale(DIM, CODE), "be": np.zeros(CODE, np.float32), "V": scale(CODE, GATE),
                  "U": scale(CODE, GATE), "w": scale(GATE), "c": scale(CODE),
                  "b": np.array(np.log(prior / (1 - prior)), np.float32)}

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.p["We"] + self.p["be"], 0)

    def attend(self, e: np.ndarray, first: np.ndarray):
        t, g = np.tanh(e @ self.p["V"]), _sigmoid(e @ self.p["U"])
        a = _softmax((t * g) @ self.p["w"], first)
        return t, g, a, np.add.reduceat(a[:, None] * e, first[:-1], axis=0)

    def score(self, z: np.ndarray) -> np.ndarray:
        return _sigmoid(z @ self.p["c"] + self.p["b"])

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, size = self.p, np.diff(first)
        e = self.encode(x)
        t, g, a, z = self.attend(e, first)
        do = ((self.score(z) - y) / len(y)).astype(np.float32)
        dz = np.repeat(do[:, None] * p["c"], size, axis=0)
        da = (e * dz).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), size))
        dtg = ds[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        de = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (e > 0)
        return {"We": x.T @ de, "be": de.sum(0), "V": e.T @ dt, "U": e.T @ dg,
                "w": (t * g).T @ ds, "c": z.T @ do, "b": do.sum()}


def fit(bags: list[bytes | None], y: np.ndarray) -> Model | float:
    """Model of labelled texts by Adam over batches of whole documents; labels of one kind
    only give a constant score."""
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    features = WordFeatures()
    words, place, first = passages([features.of(t) for t in bags])
    size, model = np.diff(first), Model(float(y.mean()))
    x = np.concatenate([layout(words, place, lo, min(lo + _BLOCK, int(first[-1])))
                        for lo in range(0, int(first[-1]), _BLOCK)])
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(q) for k, q in model.p.items()}
    rng, step = np.random.default_rng(11), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            own = order[at:at + BATCH]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in own])
            grad = model.gradient(x[rows], np.concatenate([[0], np.cumsum(size[own])]), y[own])
            step += 1
            for k, q in grad.items():
                q = q + 1e-4 * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                model.p[k] = (model.p[k] - RATE * (m[k] / (1 - 0.9 ** step))
                              / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def score_texts(model: Model | float, bags: list[bytes | None], features: WordFeatures) -> np.ndarray:
    if not bags or not isinstance(model, Model):
        return np.full(len(bags), model if bags else 0.0)
    words, place, first = passages([features.of(t) for t in bags])
    e = np.concatenate([model.encode(layout(words, place, lo, min(lo + _BLOCK, int(first[-1]))))
                        for lo in range(0, int(first[-1]), _BLOCK)])
    return model.score(model.attend(e, first)[3]).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | float:
    """Fit on at most ``rows`` labelled documents outside the held-out fold. The sample is
    what reaches the driver; ids only put it in a fixed order."""
    got = labelled_sample(docs, labels, "quality", rows).orderBy("doc_id", "text").toPandas()
    return fit([None if t is None else t.encode() for t in got["text"]], got["y"].to_numpy(np.float32))


def scorer(model: Model | float):
    """Column function: whole text to score between 0 and 1."""
    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = WordFeatures()
        for batch in batches:
            yield pa.array(score_texts(model, batch.cast(pa.binary()).to_pylist(), features), pa.float64())
    return quality


def quality_score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Column:
    """The score of ``text`` by a model fitted here on ``docs`` and ``labels``."""
    return scorer(train(docs, labels, rows))(F.col("text"))
