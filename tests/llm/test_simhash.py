"""SimHash against its definition, pair by pair."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from weftline.llm.components import components, forest
from weftline.llm.simhash import distinct_documents, layout, near, simhash_components

SCHEMA = "doc_id long, text string, fp string, t1 long"


def fingerprint(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def texts(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Éa", "A b", "x y"]
    out = [None, "", " \t\n\x0b", "one", "One", "two words", "UPPER lower", "ÉCOLE nb sp", "a" * 70_000]
    for _ in range(n):
        base = rng.choices(words, k=rng.choice([3, 4, 5, 30, 200]))
        out.append(rng.choice([" ", "\t", "  ", "\n"]).join(base))
        if rng.random() < 0.4:
            base[rng.randrange(len(base))] = "changed"
            out.append(" ".join(base))
    return out


def test_as_defined(spark):
    given = texts(1)
    df = spark.createDataFrame([(i + 5, t, "x", 1) for i, t in enumerate(given)], SCHEMA).repartition(3)
    prints = {i + 5: fingerprint(t, 4) for i, t in enumerate(given)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(df, width=4, radius=4).collect()}
    want = groups(prints, 4)
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


@pytest.mark.parametrize("count", [None, 1 << 26, 1 << 32])
def test_large_sets_are_tiled(spark, monkeypatch, count):
    import weftline.llm.simhash as s

    monkeypatch.setattr(s, "TILE", 8)
    rng = random.Random(2)
    # fingerprints near each other, many with one population count
    seeds = [rng.getrandbits(64) for _ in range(3)]
    fps = {int(np.uint64(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))).view(np.int64)) for x in seeds for _ in range(60)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r.id: r.component for r in components(s.links(df, 4, count=count)).collect()}
    want = groups({f: f & (1 << 64) - 1 for f in fps}, 4)
    for f in fps:
        assert found.get(f, f) == want[f]


@pytest.mark.parametrize("radius", [0, 3, 4])
@pytest.mark.parametrize("n", [10, 1 << 26, 1 << 32])
def test_layout_misses_no_pair(radius, n):
    masks = layout(n, radius)
    rng = random.Random(radius)
    for _ in range(300):
        a, b = rng.getrandbits(64), 0
        b = a
        for k in rng.sample(range(64), radius):
            b ^= 1 << k
        assert any(a & m == b & m for m in masks)


def test_near_pairs():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 12, 700).astype(np.uint64)
    links = near(a, None, 2)
    want = groups(dict(enumerate(map(int, a))), 2)
    got = forest(len(a), links)
    part = np.arange(len(a))
    part[got[:, 0]] = got[:, 1]
    assert part.tolist() == [want[i] for i in range(len(a))]


def test_repeated_and_null_ids_and_empty(spark):
    df = spark.createDataFrame([(3, "a b c d e", "x", 1), (3, "a b c d e", "x", 1), (None, "a b c d e", "x", 1), (9, "A B C D E", "y", 2)], SCHEMA)
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash_components(df, width=4).collect()) == [(0, 3), (3, 3), (3, 3), (9, 3)]
    assert simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []
    assert distinct_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_distinct_documents_keeps_one_of_each_group(spark):
    rng = random.Random(7)
    rows, family = [], {}
    for k in range(25):
        words = [f"v{rng.randrange(5000)}" for _ in range(120)]
        for c in range(rng.choice([1, 1, 3])):
            w = list(words)
            if c:
                w[rng.randrange(120)] = "edit"  # five of 116 shingles differ: similarity over 0.9
            rows.append((len(rows), " ".join(w), "s", k))
            family.setdefault(k, []).append(len(rows) - 1)
    rows += [(900, None, "n", 1), (901, "", "n", 2), (902, None, "n", 3)]
    kept = distinct_documents(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(r.doc_id for r in kept) == sorted([min(v) for v in family.values()] + [900])
    assert kept[0].__fields__ == ["doc_id", "text", "fp", "t1"]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 260)] + [(None, 4), (5, None), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_distinct_documents_by_similarity(spark, monkeypatch):
    import weftline.llm.simhash as s

    monkeypatch.setattr(s, "WIDE_TILE", 4)
    rng = random.Random(11)
    given = ["a b c d e f g h", "a b c d e f g h i", "q r s t u v w", "q r s t u v w x"]  # 4 of 5 shingles, 3 of 4
    for k in range(40):
        words = [f"u{rng.randrange(9000)}" for _ in range(rng.choice([12, 60, 250]))] + (["a", "common", "line", "of", "six", "words"] if k % 2 else [])
        for _ in range(rng.choice([1, 2, 5])):
            w = list(words)
            for _ in range(rng.randrange(1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9000)}"
            given.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in given)]
    root = list(range(len(given)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shares = []
    for i, a in enumerate(sets):
        for j in range(i):
            shares.append(len(a & sets[j]) / len(a | sets[j]))
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert sum(0.7 < x < 0.8 for x in shares) > 5 and sum(0.8 <= x < 0.9 for x in shares) > 5
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(given)], SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in distinct_documents(df).collect()) == sorted({find(i) for i in range(len(given))})


def test_components_go_on_until_they_stand_still(spark, monkeypatch):
    import weftline.llm.components as c

    monkeypatch.setattr(c, "ROUNDS", 1, raising=False)
    edges = [(k, k + 1) for k in range(40)]
    assert {r.component for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()} == {0}


def test_parities_show_no_more_than_sets_differ():
    import weftline.llm.simhash as s

    rng = np.random.default_rng(1)
    for n, m, both in ((3, 5, 2), (2000, 2300, 1900), (900, 1100, 850), (40_000, 42_000, 39_000)):
        x = rng.integers(0, 2**63, n + m - both).astype(np.uint64)
        a, b = np.unique(x[:n]), np.unique(x[n - both :])
        p, q = s.parity(a), s.parity(b)
        to = min(len(p), len(q))
        off = int(np.bitwise_count((s.folded(p, to) ^ s.folded(q, to)).view(np.uint64)).sum())
        apart = len(np.setxor1d(a, b))
        assert off <= apart and (apart - off) % 2 == 0 and off > apart / 3


def test_met_again(spark, monkeypatch):
    import weftline.llm.simhash as s

    rng = random.Random(9)
    rows = [(rng.randrange(400), i) for i in range(500)] + [(1000, i) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(tuple(r) for r in s.met_again(spark.createDataFrame(rows, "k long, node long")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    times = Counter(k for k, _ in rows)
    assert got == sorted(r for r in rows if times[r[0]] > 1)
