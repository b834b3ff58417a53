"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence has a logistic score of its words
and word beginnings, and a document is toxic if any sentence is: the noisy-or
of its sentences. Only document labels are known, so the sentence scores are
trained through the noisy-or; afterwards they tell which sentences offend.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import doc_columns
from .labelled import labelled_sample

#: Bounds of the labelled sample (documents, characters of one).
SAMPLE_ROWS, SAMPLE_CHARS = 8_000, 6_000
#: Lengths of word beginnings that are features, documents that a feature needs, training steps, weight decay.
BEGINNINGS, LEAST_DOCS, STEPS, DECAY = (4, 5, 6), 3, 200, 1e-4
#: Score from which a document, and a sentence, is told.
THRESHOLD, SENTENCE_THRESHOLD = 0.3, 0.3

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the pieces between sentence marks and line feeds that hold a letter or digit."""
    return [m.span() for m in SENTENCE.finditer(text) if any(map(str.isalnum, m.group()))]


def features(sentence: str) -> set[str]:
    out = set()
    for w in WORD.findall(sentence.lower()):
        out.add(w if len(w) <= 40 else w[:40])
        for n in BEGINNINGS:
            if len(w) > n:
                out.add(w[:n] + "*")
    return out


class Model:
    """Weights of the features and the bias of a sentence's logistic score."""

    def __init__(self, texts: list[str], labels: list[int], steps: int = STEPS, decay: float = DECAY):
        number: dict[str, int] = {}
        feat, size, doc, held = [], [], [], Counter()
        for d, t in enumerate(texts):
            own = set()
            for a, b in sentences(t):
                at = [number.setdefault(f, len(number)) for f in features(t[a:b])]
                own.update(at)
                feat.append(np.array(at, np.int32))
                size.append(len(at))
                doc.append(d)
            held.update(own)
        feat = np.concatenate(feat) if feat else np.zeros(0, np.int32)
        sent = np.repeat(np.arange(len(size)), size)
        docs_of = np.array([held[i] for i in range(len(number))], np.int64)
        keep = docs_of >= LEAST_DOCS
        feat, sent = feat[keep[feat]], sent[keep[feat]]
        new = np.cumsum(keep) - 1
        names = [f for f, k in zip(number, keep.tolist()) if k]
        feat, doc, y = new[feat], np.array(doc, np.int64), np.array(labels, float)
        theta, self.bias = self._train(feat, sent, doc, y, len(names), steps, decay)
        # beginnings and words that say nothing are left out of the broadcast
        self.weights = {f: float(t) for f, t in zip(names, theta) if abs(t) > 1e-3}

    @staticmethod
    def _train(feat, sent, doc, y, n: int, steps: int, decay: float) -> tuple[np.ndarray, float]:
        """Adam on the log loss of the noisy-or, weight decay on the weights; all rows in every step."""
        theta, bias = np.zeros(n), -4.0
        if not len(doc) or y.min() == y.max():
            return theta, bias if not len(y) or y.max() == 0 else 4.0
        m, v = np.zeros(n + 1), np.zeros(n + 1)
        for t in range(1, steps + 1):
            z = bias + np.bincount(sent, weights=theta[feat], minlength=len(doc))
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
            none = np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)))
            told = np.maximum(1.0 - none, 1e-9)
            # d loss / d z of a sentence: p if the document is clean, -p * (1 - P) / P if it is toxic
            g = p * np.where(y[doc] == 1, -none[doc] / told[doc], 1.0)
            grad = np.append(np.bincount(feat, weights=g[sent], minlength=n) / len(y) + decay * theta, g.sum() / len(y))
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
            theta, bias = theta - step[:-1], bias - step[-1]
        return theta, float(bias)

    def sentence_scores(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        spans = sentences(text)
        z = np.array([self.bias + sum(self.weights.get(f, 0.0) for f in features(text[a:b])) for a, b in spans])
        return spans, 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str) -> tuple[float, list[tuple[int, int]], np.ndarray]:
        """Noisy-or of the sentences (none: 0), their places and scores."""
        spans, p = self.sentence_scores(text)
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0, spans, p


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    return Model(*labelled_sample(docs, labels, label_col, learnable, rows, chars, id_col, text_col))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
          sentence_threshold: float = SENTENCE_THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, offending [(start, end, score)]; one row per input row.

    ``offending``: the sentences that reach ``sentence_threshold``, in code
    points. A null or empty text, or one without sentences, scores 0. Whole
    texts count; only the two named columns are read. The broadcast model
    holds at most the features of ``SAMPLE_ROWS`` documents.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                s, at, p = sent.value.score(text)
                scores.append(s)
                spans.append([{"start": a, "end": b, "score": x} for (a, b), x in zip(at, p.tolist())
                              if x >= sentence_threshold])
            got = np.array(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32)),
                 pa.array(spans, span)], ["doc_id", "score", "predicted", "offending"])
    return doc_columns(docs, id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")
