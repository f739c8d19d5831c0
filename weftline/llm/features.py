"""Hashed word features of many texts at once, and sampling of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import fold, mix, prefix_hash, runs, sample_rows, span_hash

#: Bytes of words: letters, digits and everything outside ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters, byte for byte."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][latin] += 32
    return out


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, hash) of each word of concatenated texts; no word spans two texts."""
    mask = WORD[data]
    start, end = runs(mask)
    inner = at[1:-1]
    if len(inner):  # cut words at the borders of texts
        inner = inner[(inner > 0) & (inner < len(data))]
        inside = np.unique(inner[mask[inner] & mask[inner - 1]])
        start, end = np.sort(np.concatenate([start, inside])), np.sort(np.concatenate([end, inside]))
    return np.searchsorted(at, start, "right") - 1, start, end, span_hash(prefix_hash(data), start, end)


def pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15 + 2 * salt) + b)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y): about ``most`` labelled rows of the training folds at most, with their whole texts.

    The ids of the sample, of which there are so many at most in expectation, are
    broadcast. An id labelled more than once is 1 if any says so; of rows that share an
    id the least text counts, so repeats don't widen the sample. All is in one partition.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold() != 2)).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).where("y in (0, 1)")
    chosen = sample_rows(rows, most)
    found = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).coalesce(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
