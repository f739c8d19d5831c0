"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, word pairs and pairs with
one word between. Every coordinate has a learning rate of its own; the L1 penalty
leaves most weights at zero. What is left, as two short arrays, is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.features import labelled, lowered, pair, words
from weftline.llm.shared import fold, slices, tidied

BITS = 20
#: Labelled rows the model is fitted on, at most (in expectation), and passes over them.
ROWS, EPOCHS = 16_000, 3
#: Rates and penalties of FTRL-proximal.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 6.0, 0.1
#: A document counts as toxic from this score.
TOXIC = 0.3


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of concatenated texts, repeats included."""
    doc, _, _, h = words(lowered(data), at)
    shift = np.uint64(64 - BITS)
    docs, found = [doc], [h]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        docs.append(doc[gap:][same])
        found.append(pair(h[:-gap], h[gap:], gap)[same])
    return np.concatenate(docs), (np.concatenate(found) >> shift).astype(np.int64)


class Model:
    """Buckets with a weight, in order, their weights, and the bias."""

    def __init__(self, bucket: np.ndarray, weight: np.ndarray, bias: float) -> None:
        self.bucket, self.weight, self.bias = bucket, weight, bias
        self._dense: np.ndarray | None = None

    def __getstate__(self) -> tuple:
        return self.bucket, self.weight, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, np.float64)
            self._dense[self.bucket] = self.weight
        doc, bucket = features(data, at)
        hit = self._dense[bucket] != 0
        once = np.unique((doc[hit] << BITS) | bucket[hit])
        total = np.bincount(once >> BITS, self._dense[once & ((1 << BITS) - 1)], len(at) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(examples: list[tuple[np.ndarray, int]]) -> Model:
    """From (distinct buckets, label) of each document, in a fixed order. The last coordinate is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray | slice, l1: float | np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rng = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            i, y = examples[k]
            i = np.append(i, 1 << BITS)
            penalty = np.full(len(i), L1)
            penalty[-1] = 0
            w = weights(i, penalty)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(slice(None), np.append(np.full(1 << BITS, L1), 0.0))
    some = np.flatnonzero(w[:-1])
    return Model(some, w[some], float(w[-1]))


def examples(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, int]]:
    for batch in batches:
        y = batch["y"].to_numpy()
        for lo, _, data, at in slices(pa.array(batch["text"], pa.string())):
            doc, bucket = features(data, at)
            key = np.unique((doc << BITS) | bucket)
            edges = np.searchsorted(key >> BITS, np.arange(len(at)))
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                yield (key[a:b] & ((1 << BITS) - 1)).astype(np.int32), int(y[lo + i])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows: int = ROWS) -> Model:
    """Fitted in one task on about ``rows`` labelled documents at most; no weights if there are none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = list(examples(batches))
        if seen:
            m = train(seen)
            yield pd.DataFrame({"bucket": [m.bucket.tolist()], "weight": [m.weight.tolist()], "bias": [m.bias]})

    found = labelled(docs, labels, label, rows).select("text", "y").mapInPandas(tidied(run), "bucket array<long>, weight array<double>, bias double").collect()
    if not found:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    return Model(np.array(found[0].bucket, np.int64), np.array(found[0].weight), found[0].bias)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Labels are learned from folds other than 2 alone, and only texts are read for a
    score. Null and empty texts get the score of no features. Repeated and null ids are
    rows like others; other columns don't matter; empty tables give an empty table. The
    broadcast model has 2**BITS weights at most.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, data, at in slices(batch.column(1)):
                out[lo:hi] = held.value.score(data, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(tidied(run), "doc_id long, score double")
    return out.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
