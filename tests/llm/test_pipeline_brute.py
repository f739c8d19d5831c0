"""The whole pipeline against plain Python, and each stage on odd tables."""

import base64
import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

pipeline = pytest.importorskip("corpus_pipeline")

from weftline.llm.quality import quality  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def without_near_copies(docs):
    """The document of the smallest id of each group."""
    sets = [shingles(d["text"]) for d in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y, key=lambda k: docs[k]["doc_id"])] = min(x, y, key=lambda k: docs[k]["doc_id"])
    return [d for k, d in enumerate(docs) if find(k) == k]


def without_repeats(docs, length=200):
    raw = [(d["text"] or "").encode() for d in docs]
    seen = Counter(hashlib.blake2b(r[i : i + length], digest_size=12).digest() for r in raw for i in range(len(r) - length + 1))
    out = []
    for d, r in zip(docs, raw, strict=True):
        keep = np.ones(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[hashlib.blake2b(r[i : i + length], digest_size=12).digest()] > 1:
                keep[i : i + length] = False
        text = bytes(np.frombuffer(r, np.uint8)[keep]).decode("utf-8", "ignore")
        out.append(d | {"text": text, "n_chars": len(text)})
    return out


def mixed(docs, block=16):
    """docs with slot and position, by walking the schedule slot by slot."""
    by = {}
    for d in docs:
        key = hashlib.md5("|".join(str(d[c]) for c in ("doc_id", "source", "text", "lang", "n_chars") if d[c] is not None).encode()).hexdigest()
        by.setdefault("n" if d["source"] is None else "s" + d["source"], []).append((key, d))
    names = sorted(by)
    r = [math.isqrt(len(by[n])) for n in names]
    total = sum(r)
    parts = max(1000, min(16384, total // min(r)))
    w = [1] if len(names) == 1 else [max(1, (2 * parts * x + total) // (2 * total)) for x in r]
    q, done, slot, out = sum(w), [0] * len(names), 0, []
    queues = [[d for _, d in sorted(by[n], key=lambda x: x[0])] for n in names]
    while any(done[i] * block < len(queues[i]) for i in range(len(names))):
        i = min((((done[i] + 1) * q + w[i] - 1) // w[i], i) for i in range(len(names)) if done[i] * q // w[i] <= slot)[1]
        for d in queues[i][done[i] * block : (done[i] + 1) * block]:
            out.append(d | {"mix_slot": slot, "mix_position": len(out) + 1})
        done[i] += 1
        slot += 1
    return out


def test_as_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    plain = [r.asDict() for r in docs.collect() if r.doc_id in kept]
    plain = mixed(without_repeats(without_near_copies(plain)))
    assert 50 < len(plain) < len(kept)
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for d in plain:
        ids = library.encode_ordinary(d["text"])
        want.add((d["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest(), d["mix_slot"], d["mix_position"]))
    assert {tuple(r) for r in pipeline.run(spark, SF).collect()} == want


ODD = "t1 long, t2 string, row int, part string, spans int, mix_slot int, Mix_Position string, node long, `odd name.x` string, quality_score double, tie int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows and ids, an empty and a very long text, names that stages use themselves."""
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(12).collect()]
    long = " ".join(f"w{k % 977}x{k % 1013}" for k in range(400_000))
    texts = [*prose, None, None, "", prose[0], prose[0] + " and more", long, long[: len(long) // 2]]
    extra = (5, "five", 1, "p", 2, 3, "m", 4, "o", 0.5, 6)
    rows = [(i, t, "en", "web" if i % 3 else None, len(t or ""), *extra) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, prose[5], None, None, None, *[None] * len(extra)), (None, None, None, None, None, *[None] * len(extra))]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {ODD}").repartition(3)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, odd, k):
    out = pipeline.STAGES[k][1](spark, odd, SF)
    got = out.collect()
    ids = Counter(r.doc_id for r in odd.collect())
    if k == 4:
        assert Counter(r.doc_id for r in got) == ids
        assert sorted(r.mix_position for r in got) == list(range(1, len(got) + 1))
        empty = [r for r in got if r.doc_id in (12, 13, 14)]
        assert [r.n_tokens for r in empty] == [0, 0, 0]
        return
    assert out.columns == odd.columns and out.schema.simpleString() == odd.schema.simpleString()
    have, given = Counter(map(tuple, got)), Counter(map(tuple, odd.collect()))
    if k == 0:  # rows go or stay whole
        assert not have - given and sum(have.values()) > 10
    if k == 1:  # one of each group: null and empty texts are one, copies and near copies are
        assert not have - given
        kept = Counter(r.doc_id for r in got)
        assert kept[3] == 1 and kept[12] == 1 and not kept[13] and not kept[14] and not kept[15] and not kept[None]
        assert kept[17] == 1
    if k == 2:  # only text and n_chars change; nulls stay null
        assert Counter((r.doc_id, r.t2, r.source) for r in got) == Counter((r.doc_id, r.t2, r.source) for r in odd.collect())
        by = {r.doc_id: r for r in got}
        assert by[12].text is None and by[14].text == "" and by[3].text == ""
        assert by[17].n_chars == len(by[17].text)
    if k == 3:
        assert have == given
