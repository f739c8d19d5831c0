"""Byte-level BPE against the public library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

from weftline.llm.bpe import Encoder, bpe, encoder

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def samples():
    rng = random.Random(3)
    alphabets = ["abcdefghij ABC'0123456789", "äöüßéèñ ", "日本語かなカナ ", "абвгд ", "😀👩‍👩 ́e", "\x00\x1c\x1f\x85  \n\r\t .,!?-_", "\U00020000\U0001f600İǅ"]
    out = ["", " ", "\n\n", "I'll we've 'S 'T don'T", "a" * 5000, "ab" * 3000, " " * 3000, " " * 50 + "x", "１２３ⅣⅤ", "don’t", "x\x1cy\x1f z", "<|endoftext|> plain"]
    for _ in range(300):
        out.append("".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(80))))
    return out


def test_ids_as_the_library_gives(library):
    e = encoder(PATH, P.PATTERN)
    for t, packed in zip(samples(), e.packed(samples()), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(t), repr(t)
        assert e.decode(packed) == t.encode()


def by_definition(piece, ranks):
    """Merge the leftmost of the pairs with the lowest rank until none has one."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]  # noqa: B905
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(4))
def test_queue_as_defined_for_any_ranks(seed):
    # ranks in any order: a merge may bring a pair of a lower rank than its own
    rng = random.Random(seed)
    tokens = {bytes(rng.choices(b"abc", k=rng.randrange(2, 7))) for _ in range(60)}
    ranks = dict(zip([*(bytes([b]) for b in range(256)), *sorted(tokens, key=lambda _: rng.random())], rng.sample(range(9000), 256 + len(tokens)), strict=True))
    e = Encoder(ranks, P.PATTERN)
    for _ in range(300):
        piece = bytes(rng.choices(b"abc", k=rng.randrange(1, 60)))
        pieces = [piece, *(bytes(rng.choices(b"aaabc", k=rng.randrange(1, 60))) for _ in range(rng.randrange(4)))]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.merge(pieces)] == [by_definition(x, ranks) for x in pieces]


def test_every_new_pretoken_goes_through_the_queue(library, monkeypatch):
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e, seen = Encoder(ranks, P.PATTERN), []
    merge = e.merge
    monkeypatch.setattr(e, "merge", lambda pieces, **how: seen.extend(pieces) or merge(pieces, **how))
    for t, packed in zip(rows, e.packed(rows), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(t)
    assert {r for t in rows for p in e.split(t) if (r := p.encode()) not in ranks} == set(seen)
    assert len(seen) > 10_000


def test_long_pretoken(library):
    rng = random.Random(6)
    for long in ("lorem" * 4000, "a" * 100_001, "".join(rng.choices("acgt", k=30_000))):
        assert np.frombuffer(encoder(PATH, P.PATTERN).merge([long.encode()])[0], "<u4").tolist() == library.encode_ordinary(long)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "ab", [9], 7)], "doc_id long, text string, ids array<int>, n_tokens int")
    got = bpe(df, PATH, P.PATTERN, ids=True).collect()
    assert [r.n_tokens for r in got] == [len(got[0].ids)] and got[0].ids != [9]


def test_operator(spark, library):
    texts = [None, "", "hello world", "naïve café", "a" * 200_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "hello world", "x"), (2, "hello world", "x")]
    got = bpe(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, P.PATTERN, ids=True).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        r = by_id[i]
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).collect() == []


def test_workers_forget_after_a_task(spark):
    """What a worker remembered would add to the memory of whatever it does next."""

    def left(batches):
        from weftline.llm import bpe as module

        list(batches)
        used = module.encoder.cache_info().currsize
        yield pa.RecordBatch.from_pydict({"used": [used], "kept": [len(module.encoder(PATH, P.PATTERN).kept)]})

    rows = [(i, f"a{i}b zq{i}x unheardof{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert bpe(docs, PATH, P.PATTERN).agg({"n_tokens": "sum"}).first()[0]
    found = spark.range(0, 400, 1, 4).mapInArrow(left, "used long, kept long").collect()
    assert any(r.used for r in found)  # a worker that has encoded
    assert {r.kept for r in found} == {0}
