"""Removal of repeated strings against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from weftline.llm.suffix import cleaned, digests, two_stage

SCHEMA = "doc_id long, text string, t1 int, spans string"


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def planted(seed, length):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared = [word(length + rng.randrange(150)) for _ in range(6)]
    texts = [None, "", "short", word(length - 1), "a" * (3 * length), "a" * (3 * length + 7), "ab" * length, "xyz" * length + word(20), "日本" * length]
    for _ in range(40):
        texts.append("".join(word(rng.randrange(90)) + (rng.choice(shared) if rng.random() < 0.5 else "") for _ in range(rng.randrange(5))))
    texts += [texts[20]] * 3 + [texts[12] + "tail"] + [word(30) * 9]
    return texts


@pytest.mark.parametrize(("seed", "length"), [(1, 40), (2, 200)])
def test_as_brute_force(spark, seed, length):
    texts = planted(seed, length)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in digests(df, length=length).collect()}
    for i, want in enumerate(brute(texts, length)):
        assert got[i] == want, (i, texts[i])


@pytest.mark.parametrize("text", ["a" * 300, "abc" * 120, "x" * 150 + "y" + "x" * 250])
def test_one_text_that_repeats_itself(spark, text):
    df = spark.createDataFrame([(1, text, 1, "x")], SCHEMA)
    assert [tuple(r)[1:] for r in digests(df).collect()] == brute([text], 200)


@pytest.mark.parametrize("hot", [0, 1, 6])
def test_hot_anchors(spark, monkeypatch, hot):
    import weftline.llm.suffix as s

    # 0: all windows are counted one by one, after second anchors; 1 and 6: some of each
    monkeypatch.setattr(s, "HOT", hot)
    texts = planted(3, 60)
    rng = random.Random(4)
    common = "".join(rng.choices("abcdefg", k=150))
    texts += ["".join(rng.choices("uvwxyz", k=rng.randrange(90))) + common + "".join(rng.choices("uvwxyz", k=rng.randrange(90))) for _ in range(30)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in digests(df, length=60).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 60)


def test_texts_longer_than_two_pieces(spark):
    from weftline.llm.suffix import PIECE

    rng = np.random.default_rng(8)
    long = rng.integers(97, 123, 2 * PIECE + 5000).astype(np.uint8)
    passage = rng.integers(97, 123, 300).astype(np.uint8)
    long[PIECE - 100 : PIECE + 200] = passage  # over the border of two pieces
    short = np.concatenate([rng.integers(97, 123, 50).astype(np.uint8), passage])
    df = spark.createDataFrame([(1, long.tobytes().decode(), 1, "x"), (2, short.tobytes().decode(), 1, "x")], SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digests(df).collect()}
    left = np.delete(long, np.arange(PIECE - 100, PIECE + 200)).tobytes()
    assert got == {1: (len(long), 300, 1, hashlib.sha256(left).hexdigest()), 2: (350, 300, 1, hashlib.sha256(short[:50].tobytes()).hexdigest())}


def test_pieces_hold_every_window_once():
    import pyarrow as pa

    import weftline.llm.suffix as s

    text = "".join(random.Random(1).choices("abcdef", k=3 * s.PIECE + 77))
    seen = np.zeros(len(text), int)
    for lo, off, data, at in s.pieces(pa.array([text]), 200):
        assert lo == 0 and bytes(data) == text.encode()[off : off + len(data)] and at.tolist() == [0, len(data)]
        seen[off : off + len(data) - 199] += 1
    assert (seen[:-199] == 1).all() and not seen[-199:].any()


def test_repeated_rows_and_null_ids(spark):
    t = "".join(random.Random(5).choices("abcdefgh", k=260))
    df = spark.createDataFrame([(1, t, 1, "x")] * 3 + [(None, t, 1, "x"), (2, None, None, None)], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_removed) for r in digests(df).collect())
    assert got == [(0, 260), (1, 260), (1, 260), (1, 260), (2, 0)]


def test_empty_table(spark):
    assert digests(spark.createDataFrame([], SCHEMA)).collect() == []
    assert cleaned(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "text", "t1", "spans"]


def test_cleaned_keeps_columns_and_nulls(spark):
    t = "".join(random.Random(6).choices("abcdefgh", k=230))
    df = spark.createDataFrame([(1, t + "one", 7, "s"), (2, "two" + t, 8, None), (3, None, 9, "u"), (4, "clean", 1, "v")], SCHEMA)
    got = {r.doc_id: (r.text, r.t1, r.spans) for r in cleaned(df).collect()}
    assert got == {1: ("one", 7, "s"), 2: ("two", 8, None), 3: (None, 9, "u"), 4: ("clean", 1, "v")}


@pytest.mark.parametrize("seed", range(4))
def test_two_stage_sorts_suffixes(seed):
    rng = random.Random(seed)
    raw = bytes(rng.choice(b"ab" if seed % 2 else b"abcdxyz") for _ in range(400)) + b"\xff"
    depth = 64
    order = two_stage(np.frombuffer(raw, np.uint8), depth).tolist()
    assert sorted(order) == list(range(len(raw)))
    cut = [raw[i : i + depth] for i in order]
    assert cut == sorted(cut)
