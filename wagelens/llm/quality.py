"""Quality by nearest-neighbour voting in a latent semantic space.

A text is the profile of its byte trigrams, hashed and weighted by rarity,
and of a few terms for its shape (repeated words, distinct words, capitals,
marks, word length, each by steps); a truncated singular value decomposition of a bounded labelled sample gives the
latent space. The sample's vectors and labels are broadcast, every document is
compared with all of them in blocks of exact cosine products, and the labels
of its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import doc_columns
from .labelled import labelled_sample

#: Bounds of the labelled sample (documents, characters of one); 2 to this power hashed trigrams; latent dimensions.
SAMPLE_ROWS, SAMPLE_CHARS, HASH_BITS, DIMS = 4_000, 8_000, 11, 64
#: Weight of a shape term against the whole profile of trigrams, steps of a shape.
SHAPE, STEPS = 0.4, 8
#: Neighbours, power of the similarity, documents compared at once, score from which label 1 is predicted.
NEIGHBOURS, POWER, BLOCK, THRESHOLD = 15, 4, 512, 0.3


def profile(raw: bytes, bits: int = HASH_BITS) -> np.ndarray:
    """Hashed byte trigrams of a whole text: square roots of the counts."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        b = np.concatenate([b, np.full(3 - len(b), 32, np.uint32)]) if len(b) else b
    if not len(b):
        return np.zeros(1 << bits, np.float32)
    out = np.zeros(1 << bits)
    for a in range(0, len(b) - 2, 1 << 20):            # long texts in steps, summed
        part = b[a:a + (1 << 20) + 2]
        code = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - bits), minlength=1 << bits)
    return np.sqrt(out).astype(np.float32)


def shape(text: str) -> list[float]:
    """Shares from 0 to 1: words that repeat the word before, that are distinct, capitals, marks; word length."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 5
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    solid = max(int((raw > 32).sum()), 1)
    capital = int(((raw >= 65) & (raw <= 90)).sum())
    mark = int(((raw > 32) & (raw < 48) | (raw > 57) & (raw < 65) | (raw > 90) & (raw < 97) | (raw > 122) & (raw < 128)).sum())
    return [sum(map(eq, words, words[1:])) / n, len(set(words)) / n ** 0.9, capital / solid, mark / solid, solid / n / 16]


def shape_terms(text: str) -> np.ndarray:
    """One term for the step that each shape of the text reaches (finer towards 0)."""
    out = np.zeros(5 * STEPS, np.float32)
    for i, x in enumerate(shape(text)):
        out[i * STEPS + min(STEPS - 1, int(np.sqrt(min(x, 1.0)) * STEPS))] = 1.0
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


class Model:
    """Weights of the trigrams, basis of the latent space, vectors and labels of the sample."""

    def __init__(self, texts: list[str], labels: list[int], dims: int = DIMS, bits: int = HASH_BITS, seed: int = 5):
        self.bits = bits
        self.labels = np.array(labels, float)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5
        grams = np.array([profile(t.encode("utf-8", "replace"), bits) for t in texts], np.float32).reshape(len(texts), 1 << bits)
        self.idf = np.log((1.0 + len(grams)) / (1.0 + (grams > 0).sum(axis=0))).astype(np.float32) + 1.0
        x = self._terms(grams, texts)
        del grams
        # truncated SVD by a random range finder with power steps
        dims = max(1, min(dims, len(x)))
        y = np.random.default_rng(seed).standard_normal((x.shape[1], min(dims + 16, x.shape[1]))).astype(np.float32)
        for _ in range(3 if len(x) else 0):
            y, _r = np.linalg.qr(x.T @ (x @ y))
        if len(x):
            _u, _s, v = np.linalg.svd(x @ y, full_matrices=False)
            y = (y @ v.T)[:, :dims]
        self.basis = np.ascontiguousarray(y[:, :dims], np.float32)
        self.vectors = _unit(x @ self.basis)

    def _terms(self, grams: np.ndarray, texts: list[str]) -> np.ndarray:
        shapes = np.array([shape_terms(t) if t else np.zeros(5 * STEPS, np.float32) for t in texts], np.float32)
        return _unit(np.hstack([_unit(grams * self.idf), SHAPE * shapes.reshape(len(texts), 5 * STEPS)]))

    def latent(self, texts: list[str]) -> np.ndarray:
        rows = np.array([profile(t.encode("utf-8", "replace"), self.bits) for t in texts], np.float32)
        return _unit(self._terms(rows, texts) @ self.basis)

    def score(self, texts: list[str], neighbours: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
        """Votes of the nearest sample vectors; without any similarity, the share of label 1 in the sample."""
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        near = self.latent(texts) @ self.vectors.T     # exact cosines with the whole sample
        k = min(neighbours, near.shape[1])
        at = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
        weight = np.clip(np.take_along_axis(near, at, axis=1).astype(float), 0.0, 1.0) ** power
        total = weight.sum(axis=1)
        votes = (weight * self.labels[at]).sum(axis=1)
        return np.clip(np.where(total > 1e-12, votes / np.maximum(total, 1e-12), self.prior), 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    return Model(*labelled_sample(docs, labels, label_col, learnable, rows, chars, id_col, text_col))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted; one row per input row.

    A null or empty text, or one like nothing in the sample, gets the share of
    label 1 in the sample (0.5 for an empty sample). Whole texts count; only
    the two named columns are read. The broadcast model is bounded: at most
    ``SAMPLE_ROWS`` vectors of ``DIMS`` numbers and the basis.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a in range(0, batch.num_rows, BLOCK):
                got = sent.value.score(batch.column("text")[a:a + BLOCK].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [ids[a:a + BLOCK], pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))],
                    ["doc_id", "score", "predicted"])
    return doc_columns(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
