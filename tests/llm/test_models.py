"""Classifiers: held-out accuracy on the given tables, contracts, and odd inputs."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import language, quality, toxicity
from weftline.llm.features import pair, words

SF = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_languages(spark):
    docs = read(spark, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language.languages(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.held_out and truth[r.doc_id] is not None]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.97 * len(tested)


def test_language_of_odd_texts(spark):
    docs = read(spark, "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate([None, "", "12 34 !?", "\U00020000", "x"])], docs.schema)
    got = {r.doc_id - 10**9: r for r in language.languages(docs.union(odd)).where("doc_id >= 1000000000").collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and [got[i].score for i in range(3)] == [0.0] * 3
    assert got[3].lang_pred != "und" and got[4].lang_pred != "und"
    assert language.languages(docs.where("false")).collect() == []
    assert {r.lang_pred for r in language.languages(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("lang = 'q'")).collect()} == set()


def test_kneser_ney_sums_to_one():
    texts = ["banana bandana", "ananas and bananas", "nab a ban"]
    c, _ = language.characters(texts)
    gram, n = np.unique(language.grams(c, language.ORDER, np.flatnonzero(c)), return_counts=True)
    m = language.estimate(["x"], {"x": (gram, n)})
    seen = np.unique(c[c != 0])
    history = language.grams(c, language.ORDER - 1, np.flatnonzero(c)[:-1])[5:9]
    for h in history:
        total = np.exp(m.logs((np.full(len(seen), h) << np.uint64(16)) | seen)).sum()
        assert math.isclose(total, 1.0, abs_tol=0.05)


@pytest.mark.parametrize(("module", "name", "least"), [(toxicity.toxicity, "toxic", 0.85), (quality.quality, "quality", 0.95)])
def test_scores(spark, module, name, least):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    truth = {r.doc_id: r[name] for r in labels.collect()}
    got = module(docs, labels).collect()
    threshold = toxicity.TOXIC if name == "toxic" else quality.GOOD
    assert len(got) == docs.count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in tested) >= least * len(tested)
    # held-out labels play no part
    flipped = labels.where("crc32(cast(doc_id as string)) % 4 != 2")
    again = {(r.doc_id, r.score) for r in module(docs, flipped).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


@pytest.mark.parametrize("module", [toxicity.toxicity, quality.quality])
def test_odd_rows(spark, module):
    docs = spark.createDataFrame([(1, "good words here", "a"), (1, "good words here", "a"), (None, "x", "b"), (2, None, "c"), (3, "", "d"), (4, "é" * 300_000, "e")], "doc_id long, text string, quality_score string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = module(docs, labels).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 2, 3, 4]
    assert all(0 <= r.score <= 1 for r in got)
    assert module(docs, labels.where("false")).count() == 6
    assert module(docs.where("false"), labels).collect() == []


def test_good_keeps_columns(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    kept = quality.good(docs, labels)
    assert kept.columns == docs.columns
    truth = {r.doc_id: r.quality for r in labels.collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = [i for i, q in truth.items() if q == 1]
    assert sum(i in ids for i in clean) >= 0.97 * len(clean)


def test_words_and_skip_grams():
    texts = ["Naïve café x", "", "x y", "end"]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    doc, start, end, h = words(np.frombuffer(b"".join(raw), np.uint8), at)
    assert Counter(doc.tolist()) == {0: 3, 2: 2, 3: 1}
    assert h[2] == h[3] and len(set(h.tolist())) == 5
    assert pair(h[:1], h[1:2], 1) != pair(h[:1], h[1:2], 2)


def test_language_whose_texts_were_all_set_aside(spark):
    text = "zwölf boxkämpfer jagen viktor quer über den großen deich"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("de").alias("lang"))
    aside = F.pmod(F.xxhash64(F.lit("test"), "doc_id", "text"), F.lit(11)) == 0
    one = docs.where(aside & (language.fold() != 2)).limit(1)
    other = docs.where(~aside & (language.fold() != 2)).limit(1).select("doc_id", F.lit("the quick brown fox jumps over the lazy dog").alias("text"), F.lit("en").alias("lang"))
    assert "de" in language.fit(one.union(other)).languages
