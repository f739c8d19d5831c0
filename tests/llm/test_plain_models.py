"""The three learned models against plain versions of their definitions, on small tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import language, quality, toxicity

TEXTS = ["banana bandana", "Ananas and bananas!", "nab a ban", "a", "", "zwölf Boxkämpfer jagen"]


class KneserNey:
    """Interpolated Kneser-Ney over characters, in dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        top = Counter(g for t in texts for g in self.grams(t))
        self.counts = {order: top}
        for n in range(order - 1, 0, -1):
            ways = defaultdict(set)
            for g in self.counts[n + 1]:
                ways[g[1:]].add(g[0])
            self.counts[n] = Counter({g: len(w) for g, w in ways.items()})
        self.discount, self.total, self.kinds = {}, {}, {}
        for n, c in self.counts.items():
            n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
            self.discount[n] = n1 / (n1 + 2 * n2) if n1 else 0.5
            self.total[n], self.kinds[n] = Counter(), Counter()
            for g, v in c.items():
                self.total[n][g[:-1]] += v
                self.kinds[n][g[:-1]] += 1

    def grams(self, text):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        while "  " in letters:
            letters = letters.replace("  ", " ")
        padded = "\0" * (self.order - 1) + letters
        return [padded[i : i + self.order] for i in range(len(letters))]

    def probability(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(self.counts[1]) + 1000)
        below = self.probability(gram[1:])
        total = self.total[n][gram[:-1]]
        if not total:
            return below
        d = self.discount[n]
        back = d * self.kinds[n][gram[:-1]] / total
        return max(self.counts[n][gram] - d, 0) / total + back * below

    def entropy(self, text):
        return -sum(math.log(self.probability(g)) for g in self.grams(text)) / max(1, len(self.grams(text)))


def counted(texts):
    c, _ = language.characters(texts)
    return np.unique(language.grams(c, language.ORDER, np.flatnonzero(c)), return_counts=True)


def test_kneser_ney():
    given = {"x": TEXTS, "y": ["the quick brown fox", "jumps over the lazy dog", "the dog"]}
    models = language.estimate(["x", "y"], {k: counted(v) for k, v in given.items()})
    plain = {k: KneserNey(v, language.ORDER) for k, v in given.items()}
    asked = [*TEXTS, "the banana", "qqq zz", "Über den Zaun", "fox\nand  hound"]
    got, size = models.entropies(asked)
    for i, t in enumerate(asked):
        assert size[i] == sum(c.isalpha() for c in t)
        for j, lang in enumerate(("x", "y")):
            if t:
                assert math.isclose(got[i, j], plain[lang].entropy(t), rel_tol=1e-9), (t, lang)


def test_kneser_ney_distribution_of_a_seen_context():
    plain = KneserNey(TEXTS, language.ORDER)
    # all mass but what the base gives to characters that were never seen
    seen = list(plain.counts[1])
    for context in ("ana", "ban", "nan"):
        left = plain.discount[1] * plain.kinds[1][""] / plain.total[1][""] * (1 - len(seen) / (len(seen) + 1000))
        for n in (2, 3, 4):
            h = context[-(n - 1) :]
            left *= plain.discount[n] * plain.kinds[n][h] / plain.total[n][h]
        assert math.isclose(sum(plain.probability(context + c) for c in seen), 1 - left, rel_tol=1e-9)


def sample(rng, features, n=60, most=12):
    return [(np.sort(rng.choice(features, rng.integers(1, most), replace=False)).astype(np.int32), int(rng.random() < 0.5)) for _ in range(n)]


def test_ftrl():
    rng = np.random.default_rng(3)
    given = sample(rng, 40)
    given = [(x, int(5 in x or 7 in x)) for x, _ in given] * 4
    got = toxicity.train(given)
    bias = 1 << toxicity.BITS
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == bias else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(1)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(given)):
            x, y = given[k]
            each = [*x.tolist(), bias]
            w = {i: weight(i) for i in each}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in each:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in list(z) if i != bias and weight(i)}
    assert got.bucket.tolist() == sorted(want) and want
    assert np.allclose(got.weight, [want[i] for i in sorted(want)], rtol=1e-9)
    assert math.isclose(got.bias, weight(bias), rel_tol=1e-9)
    assert len(want) < 40  # the penalty has left some out


def test_sgd(monkeypatch):
    monkeypatch.setattr(quality, "BITS", 6)
    rng = np.random.default_rng(4)
    given = []
    for x, _ in sample(rng, 60, n=40):
        share = rng.random(len(x)).astype(np.float32)
        given.append((x, share / share.sum(), int(3 in x or 9 in x)))
    got = quality.train(iter(given))
    rng = np.random.default_rng(1)
    vectors = (rng.uniform(-1, 1, (1 << quality.BITS, quality.DIM)) / quality.DIM).tolist()
    layer, bias = rng.uniform(-1, 1, (2, quality.DIM)).tolist(), [0.0, 0.0]
    steps, dims = quality.EPOCHS * len(given), range(quality.DIM)
    for epoch in range(quality.EPOCHS):
        for i, k in enumerate(rng.permutation(len(given))):
            x, share, y = given[k]
            rate = quality.RATE * (1 - (epoch * len(given) + i) / steps)
            mean = [sum(float(s) * vectors[b][d] for b, s in zip(x, share, strict=True)) for d in dims]
            logit = [sum(layer[c][d] * mean[d] for d in dims) + bias[c] for c in (0, 1)]
            p = [math.exp(v) / sum(map(math.exp, logit)) for v in logit]
            err = [p[c] - (c == y) for c in (0, 1)]
            back = [sum(layer[c][d] * err[c] for c in (0, 1)) for d in dims]
            for c in (0, 1):
                for d in dims:
                    layer[c][d] -= 0.01 * rate * err[c] * mean[d]
                bias[c] -= 0.001 * rate * err[c]
            for b, s in zip(x, share, strict=True):
                for d in dims:
                    vectors[b][d] -= rate * float(s) * back[d]
    want = [sum(v[d] * (layer[1][d] - layer[0][d]) for d in dims) for v in vectors]
    assert np.allclose(got.weight, want, rtol=1e-3, atol=1e-3)
    assert math.isclose(got.bias, bias[1] - bias[0], rel_tol=1e-3, abs_tol=1e-4)


@pytest.mark.parametrize(("module", "name", "least"), [(toxicity.toxicity, "toxic", toxicity.TOXIC), (quality.quality, "quality", quality.GOOD)])
def test_clashing_names_and_repeated_rows(spark, module, name, least):
    rows = [(i, f"word{i % 7} and {'bad' if i % 2 else 'fine'} {i % 5}", 5, "x") for i in range(30)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, predicted string")
    labels = spark.createDataFrame([(i, i % 2, "y") for i in range(30)], f"doc_id long, {name} int, text string")
    got = module(docs, labels).collect()
    assert len(got) == 60 and got[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    assert all(r.predicted == int(r.score >= least) for r in got)
    assert len({(r.doc_id, r.score) for r in got}) == 30


def test_language_rows_as_they_come(spark):
    long = "der lange satz geht immer weiter und weiter " * 30_000
    rows = [(i, "der hund und die katze", "de", 1.0, "a") for i in range(20)] + [(100 + i, "the dog and the cat", "en", 1.0, "a") for i in range(20)]
    rows += [(500, long, None, 1.0, "a")] * 2 + [(None, "the cat", None, 1.0, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    got = language.languages(docs).collect()
    assert len(got) == len(rows)
    assert [r.lang_pred for r in got if r.doc_id == 500] == ["de"] * 2
    assert [(r.lang_pred, r.held_out) for r in got if r.doc_id is None] == [("en", False)]


def test_good_keeps_a_column_of_each_name(spark):
    docs = spark.createDataFrame([(1, "one text", 0.5, "c")], "doc_id long, text string, quality_score double, c_quality_score string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.good(docs, labels)
    assert out.columns == docs.columns
    assert [tuple(r) for r in out.collect()] in ([], [(1, "one text", 0.5, "c")])
