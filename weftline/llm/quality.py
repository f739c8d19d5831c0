"""Quality classifier: supervised subword embeddings, averaged per document.

A document's features are its words, its GRAM-byte strings and, as the only trace of
word order, whether a word repeats the one before it. Each is hashed to one of BUCKETS
learned vectors of DIM numbers; their mean goes through a linear layer and a softmax.
Both are trained together by plain stochastic gradient descent in numpy.

For scoring, the layer is applied to the vectors beforehand: the logit of a mean of
vectors is the mean of their logits, so a document costs one number a feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.features import labelled, words
from weftline.llm.shared import fold, mix, named, slices, tidied

BITS, DIM, GRAM = 16, 8, 3
#: Labelled rows the model is fitted on, at most (in expectation); passes over them; rate at the start.
ROWS, EPOCHS, RATE = 8000, 3, 40.0
#: A document counts as good from this score.
GOOD = 0.7


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of concatenated texts; bucket 0 is a repeated word's."""
    shift = np.uint64(64 - BITS)
    doc, _, _, h = words(data, at)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    n = max(0, len(data) - GRAM + 1)
    code = np.zeros(n, np.uint64)
    for k in range(GRAM):
        code = (code << np.uint64(8)) | data[k : k + n].astype(np.uint64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = owner[:n] == owner[GRAM - 1 :] if n else np.zeros(0, bool)
    grams = (mix(code[whole] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) >> shift).astype(np.int64)
    return np.concatenate([doc, doc[again], owner[:n][whole]]), np.concatenate([(h >> shift).astype(np.int64), np.zeros(again.sum(), np.int64), grams])


class Model:
    """weight: what each bucket adds to the logit of label 1, once the mean is taken; bias."""

    def __init__(self, weight: np.ndarray, bias: float) -> None:
        self.weight, self.bias = weight.astype(np.float32), bias

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        doc, bucket = features(data, at)
        n = len(at) - 1
        size = np.maximum(np.bincount(doc, minlength=n), 1)
        return 1 / (1 + np.exp(-np.clip(np.bincount(doc, self.weight[bucket], n) / size + self.bias, -30, 30)))


def train(examples: Iterator[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """From (distinct buckets, shares, label) of each document, in a fixed order."""
    rng = np.random.default_rng(1)
    vectors = rng.uniform(-1, 1, (1 << BITS, DIM)) / DIM
    layer, bias = rng.uniform(-1, 1, (2, DIM)), np.zeros(2)
    kept = list(examples)
    steps = max(1, EPOCHS * len(kept))
    for epoch in range(EPOCHS):
        for i, k in enumerate(rng.permutation(len(kept))):
            bucket, share, y = kept[k]
            rate = RATE * (1 - (epoch * len(kept) + i) / steps)
            own = vectors[bucket]
            mean = share @ own
            logit = layer @ mean + bias
            p = np.exp(logit - logit.max())
            err = p / p.sum()
            err[y] -= 1
            back = layer.T @ err
            layer -= 0.01 * rate * np.outer(err, mean)
            bias -= 0.001 * rate * err
            vectors[bucket] = own - rate * np.outer(share, back)
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def examples(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    for batch in batches:
        y = batch["y"].to_numpy()
        for lo, _, data, at in slices(pa.array(batch["text"], pa.string())):
            doc, bucket = features(data, at)
            key, count = np.unique((doc << BITS) | bucket, return_counts=True)
            edges = np.searchsorted(key >> BITS, np.arange(len(at)))
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if b > a:
                    yield (key[a:b] & ((1 << BITS) - 1)).astype(np.int32), (count[a:b] / count[a:b].sum()).astype(np.float32), int(y[lo + i])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = ROWS) -> Model:
    """Fitted in one task on about ``rows`` labelled documents at most; an even chance if there are none."""
    sample = labelled(docs, labels, label, rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = list(examples(batches))
        if seen:
            m = train(iter(seen))
            yield pd.DataFrame({"weight": [m.weight.tobytes()], "bias": [m.bias]})

    found = sample.select("text", "y").mapInPandas(tidied(run), "weight binary, bias double").collect()
    return Model(np.frombuffer(found[0].weight, np.float32), found[0].bias) if found else Model(np.zeros(1 << BITS), 0.0)


def scored(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with quality_score (0 to 1); the model, of fixed size, is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            out = np.zeros(len(part))
            for lo, hi, data, at in slices(part):
                out[lo:hi] = held.value.score(data, at)
            yield pa.array(out)

    whole = tidied(score)
    whole.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    del whole.__wrapped__
    score = F.arrow_udf(whole, "double")
    return docs.withColumn("quality_score", score(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Labels are learned from folds other than 2 alone, and only texts are read for a
    score. Null and empty texts get the score of no features. Repeated and null ids are
    rows like others; other columns don't matter; empty tables give an empty table.
    """
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= GOOD).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns whatever their names, that score GOOD or more.

    Null and empty texts get the score of no features; rows that repeat an id or a text, and texts of
    any length, are each judged whole; a score of just GOOD is kept. An empty table gives an empty table.
    """
    inner = docs.select(F.struct(*map(named, docs.columns)).alias("row"), "text")
    out = scored(inner, fit(docs, labels)).where(F.col("quality_score") >= GOOD)
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))
