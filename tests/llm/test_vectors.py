"""Near-duplicate vectors and exact search against all pairs."""

import math
import random

import numpy as np
import pytest

import weftline.llm.search as search
import weftline.llm.vectors as vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def made(seed, n=160, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = (centres[rng.integers(0, 6, n)] + rng.normal(size=(n, d)) * rng.choice([0.05, 0.3, 1.0], (n, 1))).astype(np.float32)
    rows = [(i, x[i].tolist(), 1, "a") for i in range(n)]
    rows += [(1000 + k, x[3].tolist(), 1, "copy") for k in range(20)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 0, "b"), (2001, [0.0] * d, 0, "b"), (2002, [nan] * d, 0, "b"), (2003, [inf] + [1.0] * (d - 1), 0, "b"), (2004, [None] + [1.0] * (d - 1), 0, "b"), (2005, [], 0, "b"), (2006, [1.0, 2.0], 0, "b"), (2007, [2.0, 4.0], 0, "b")]
    return rows


def good(v, zero=False):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v))


def brute_links(rows, least):
    out = {i: set() for i, *_ in rows}
    ok = [(i, np.array(v, np.float64)) for i, v, *_ in rows if good(v)]
    for k, (i, a) in enumerate(ok):
        for j, b in ok[k + 1 :]:
            if len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= least:
                out[i].add(j)
                out[j].add(i)
    return out


@pytest.mark.parametrize(("seed", "tile", "per"), [(1, 4096, 4096), (2, 16, 20)])
def test_links_and_components(spark, monkeypatch, seed, tile, per):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "PER_PIVOT", per)
    rows = made(seed)
    links = brute_links(rows, 0.9)
    low = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in low:
                low[j] = i
                todo += links[j]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.vector_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {i: (len(links[i]), low[i], low[i] == i) for i in links}


@pytest.mark.parametrize(("seed", "queries", "candidates", "step"), [(1, 1024, 16384, 16), (2, 5, 30, 3)])
def test_top_k(spark, monkeypatch, seed, queries, candidates, step):
    monkeypatch.setattr(search, "QUERIES", queries)
    monkeypatch.setattr(search, "CANDIDATES", candidates)
    monkeypatch.setattr(search, "STEP", step)
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ok = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v, *_ in rows if good(v, zero=True)]
    want = set()
    for q, a in ok:
        if q % 20 == 0:
            found = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b)))[:20]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(found, 1)}
    got = {tuple(r) for r in search.top_k(df, "vec_id % 20 = 0", k=20).collect()}
    assert got == want


def test_repeats_nulls_and_empty(spark):
    rows = [(1, [1.0, 0.0], 1, "a"), (1, [1.0, 0.0], 1, "a"), (None, [1.0, 0.0], 1, "a"), (5, [0.0, 1.0], 1, "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in vectors.vector_components(df).collect())
    assert got == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (5, 0, 5, True)]
    empty = spark.createDataFrame([], SCHEMA)
    assert vectors.vector_components(empty).collect() == []
    assert search.top_k(empty, "vec_id % 20 = 0").collect() == []


def test_repeated_rows_are_candidates_of_their_own(spark):
    rows = [(0, [1.0, 0.0], 1, "a"), (0, [1.0, 0.0], 1, "a"), (1, [1.0, 0.0], 1, "a"), (1, [1.0, 0.0], 1, "a"), (3, [0.5, 9.0], 1, "a"), (None, [1.0, 0.0], 1, "a")]
    got = sorted(tuple(r) for r in search.top_k(spark.createDataFrame(rows, SCHEMA), "vec_id % 20 = 0", k=3).collect())
    assert got == sorted([(0, 1, 0, 4096), (0, 2, 1, 4096), (0, 3, 1, 4096)] * 2)


@pytest.mark.parametrize("candidates", [16384, 4])
def test_huge_components_stay_exact(spark, monkeypatch, candidates):
    monkeypatch.setattr(search, "CANDIDATES", candidates)
    rng = random.Random(1)
    sizes = [1.0, 1e15, 1e300]
    rows = [(i, [rng.uniform(-1, 1) * sizes[i % 3] for _ in range(4)], 1, "a") for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    got = {}
    for r in search.top_k(df, "vec_id in (0, 1, 2)", k=7).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    v = {i: [math.floor(64 * c) for c in x] for i, x, *_ in rows}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    for q in (0, 1, 2):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i in v if i != q)[:7]
        assert got[q] == {k: (i, clip(-s)) for k, (s, i) in enumerate(best, 1)}


def test_sortable_bytes():
    rng = random.Random(2)
    some = [rng.choice([-1, 1]) * rng.getrandbits(rng.choice([1, 8, 9, 64, 300])) for _ in range(400)] + [0, -1, 1, 255, 256, -255, -256]
    assert sorted(some) == sorted(some, key=search.sortable)


def test_very_long_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 30_000)).astype(np.float32)
    x[7] = x[3] + 0.01 * x[5]
    df = spark.createDataFrame([(i, v.tolist(), 1, "a") for i, v in enumerate(x)], SCHEMA)
    q = np.floor(64 * x.astype(np.float64))
    want = sorted((-int(q[0] @ q[i]), i) for i in range(1, 12))[:5]
    assert [(-r.score, r.vec_id) for r in sorted(search.top_k(df, "vec_id = 0", k=5).collect(), key=lambda r: r["rank"])] == want
    assert {r.vec_id: r.component_id for r in vectors.vector_components(df).collect()} == {i: 3 if i == 7 else i for i in range(12)}


def test_many_lengths(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, 1.0, 2.0]) for _ in range(1 + i % 50)], 1, "a") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    links = brute_links(rows, 0.9)
    assert {r.vec_id: r.n_links for r in vectors.vector_components(df).collect()} == {i: len(x) for i, x in links.items()}
    got = {}
    for r in search.top_k(df, "vec_id % 20 = 0", k=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    by = dict((i, v) for i, v, *_ in rows)
    for q in range(0, 300, 20):
        best = sorted((-int(sum(64 * a * 64 * b for a, b in zip(by[q], by[i], strict=True))), i) for i in by if i != q and len(by[i]) == len(by[q]))[:3]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]


def test_more_pivots_than_a_chunk_takes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "AT_ONCE", 40)
    rng = np.random.default_rng(5)
    x = vectors.unit(rng.normal(size=(60, 6)))
    pivots = vectors.choose(x, 9)
    home, far = vectors.homes_of(x, pivots)
    d = vectors.distances(x, pivots)
    assert home.tolist() == d.argmin(1).tolist() and np.allclose(far, d.min(1))
    rings = np.array([[far[home == c].min(initial=9), far[home == c].max(initial=0)] for c in range(9)])
    r = math.sqrt(2 - 2 * 0.9)
    found = set(zip(*map(list, vectors.guests(x, home, pivots, rings, r)), strict=True))
    for i in range(60):
        for j in range(60):
            if home[j] < home[i] and x[i] @ x[j] >= 0.9:
                assert (i, home[j]) in found
