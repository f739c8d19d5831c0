"""The corpus pipeline: stages in order, each by itself, and the whole run."""

import json
import shutil

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    before, columns = docs.cache(), docs.columns
    for k, (_, stage) in enumerate(pipeline.STAGES):
        after = stage(spark, before, SF).cache()
        if k < 4:
            assert after.columns == columns
            assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        else:
            assert after.count() == before.count()
        before = after


def test_run_is_what_the_stages_give(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    got = {tuple(r) for r in pipeline.run(spark, SF).collect()}
    assert got == {tuple(r) for r in docs.collect()} and got


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_tokens_carry_the_mixing_whatever_the_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    order = [r.doc_id for r in pipeline.mixing(spark, docs, SF).collect()]
    docs.repartition(7).write.parquet(str(tmp_path / "mixed"))
    got = pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "mixed")), SF).collect()
    got.sort(key=lambda r: r.mix_position)
    assert [r.mix_position for r in got] == list(range(1, len(order) + 1))
    assert [r.doc_id for r in got] == order
    assert [r.mix_slot for r in got] == sorted(r.mix_slot for r in got)


def test_tokens_follow_the_mixing_that_was_made(spark, tmp_path):
    """Not the default one; its files are dealt anew, and some rows are there twice."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).cache()
    docs = docs.union(docs.limit(5))
    made = pipeline.interleaved(docs, block=3, target={"web": 5})
    order = [r.doc_id for r in made.collect()]
    assert order != [r.doc_id for r in pipeline.mixing(spark, docs, SF).collect()]
    made.repartition(7).write.parquet(str(tmp_path / "mixed"))
    got = pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "mixed")), SF).collect()
    got.sort(key=lambda r: r.mix_position)
    assert [r.mix_position for r in got] == list(range(1, len(order) + 1))
    assert [r.doc_id for r in got] == order


def test_another_mixing_stage_changes_the_run(spark, monkeypatch):
    usual = {tuple(r) for r in pipeline.run(spark, SF).collect()}
    stages = [(n, (lambda s, docs, d: pipeline.interleaved(docs, block=1)) if n == "mixing" else f) for n, f in pipeline.STAGES]
    monkeypatch.setattr(pipeline, "STAGES", stages)
    other = {tuple(r) for r in pipeline.run(spark, SF).collect()}
    assert {r[:4] for r in other} == {r[:4] for r in usual} and other != usual


def test_places_of_some_rows_of_changed_ones_and_without_their_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).cache()
    made = pipeline.interleaved(docs, block=3).cache()
    place = {r.doc_id: r.mix_position for r in pipeline.tokens(spark, made, SF).collect()}
    assert [r.doc_id for r in made.collect()] == sorted(place, key=place.get)
    some = pipeline.tokens(spark, made.where("doc_id % 2 = 0"), SF).collect()
    assert {r.doc_id: r.mix_position for r in some} == {i: p for i, p in place.items() if i % 2 == 0}
    changed = made.withColumn("text", pipeline.F.upper("text"))
    for other in (changed, made.union(made), made.drop("n_chars")):
        got = sorted(pipeline.tokens(spark, other, SF).collect(), key=lambda r: r.mix_position)
        assert [r.mix_position for r in got] == list(range(1, other.count() + 1))
        assert [r.doc_id for r in got] == [r.doc_id for r in pipeline.interleaved(other, block=3).collect()]
    made.write.parquet(str(tmp_path / "made"))
    shutil.rmtree(json.loads(made.schema["doc_id"].metadata["weftline_mixing"])["path"].removeprefix("file:"))
    assert {r.doc_id: r.mix_position for r in pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "made")), SF).collect()} == place
