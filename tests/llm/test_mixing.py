"""Pfair mixing: every source keeps within one block of its share at every slot."""

import random
from collections import Counter

import pytest

from weftline.llm.mixing import COLUMNS, interleaved, mixed

SCHEMA = "doc_id long, source string, h string, b int"


def rows(seed):
    rng = random.Random(seed)
    out = []
    for k, n in enumerate([300, 120, 40, 7, 1]):
        out += [(1000 * k + i, f"s{k}", "x", i) for i in range(n)]
    out += [(9000 + i, None, None, i) for i in range(25)] + [(None, "s1", "null id", i) for i in range(5)] + [(1, "s0", "x", 1)] * 4
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("target", [None, {"s0": 5, "s1": 3, "s2": 1}])
def test_pfair(spark, target):
    given = rows(1)
    got = mixed(spark.createDataFrame(given, SCHEMA).repartition(4), target=target, quantum=50, block=4).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[:4]) for r in got), key=key) == sorted(given, key=key)
    assert sorted(r.mix_position for r in got) == list(range(1, len(given) + 1))
    slots = {}
    for r in got:
        assert r.mix_release <= r.mix_slot < r.mix_due
        assert slots.setdefault(r.mix_slot, (r.source, r.mix_block)) == (r.source, r.mix_block)
    # blocks of a source come in order, and a slot holds one block
    order = sorted(got, key=lambda r: r.mix_position)
    assert [r.mix_slot for r in order] == sorted(r.mix_slot for r in order)
    for s in {r.source for r in got}:
        blocks = [r.mix_block for r in order if r.source == s]
        assert blocks == sorted(blocks)
        assert max(Counter(blocks).values()) <= 4


def test_shares_hold_while_all_sources_last(spark):
    given = [(i, "a", "x", 1) for i in range(400)] + [(1000 + i, "b", "x", 1) for i in range(400)]
    got = sorted(mixed(spark.createDataFrame(given, SCHEMA), target={"a": 3, "b": 1}, quantum=4, block=1).collect(), key=lambda r: r.mix_position)
    for n in range(1, 400):
        share = sum(r.source == "a" for r in got[:n])
        assert abs(share - n * 0.75) < 1


def test_interleaved_and_empty(spark):
    df = spark.createDataFrame(rows(2), SCHEMA)
    assert interleaved(df).columns == df.columns
    assert interleaved(df).count() == df.count()
    empty = spark.createDataFrame([], SCHEMA)
    assert mixed(empty).collect() == []


@pytest.mark.parametrize("names", [["mix_position", "B", "Lead", "n_src"], ["row", "node", "W", "Mix_Slot"], ["k", "at", "h", "a.b"]])
def test_clashing_columns_come_back_whole(spark, names):
    given = [(i, f"s{i % 3}", i * 7, i * 11, i * 13, i * 17) for i in range(60)]
    df = spark.createDataFrame(given, "doc_id long, source string, " + ", ".join(f"`{n}` int" for n in names))
    got = interleaved(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == given
    full = mixed(df)
    assert full.columns == ["doc_id", "source", *(f"docs_{n}" if n.lower().startswith("mix_") else n for n in names), *COLUMNS]
    assert sorted(tuple(r)[:6] for r in full.collect()) == given
    assert [r.doc_id for r in got.collect()] == [r.doc_id for r in sorted(full.collect(), key=lambda r: r.mix_position)]


def test_many_sources_are_scheduled_in_a_tree(spark, monkeypatch):
    import weftline.llm.mixing as m

    monkeypatch.setattr(m, "FAN", 8)
    monkeypatch.setattr(m, "CHUNK", 32)
    sizes = {"big": 900, **{f"t{k}": 9 + k % 5 for k in range(100)}}
    given = [(1000 * n + i, s) for n, (s, c) in enumerate(sizes.items()) for i in range(c)]
    target = {"big": 100, **dict.fromkeys(list(sizes)[1:], 3)}
    df = spark.createDataFrame(given, "doc_id long, source string")
    levels = m.tree(m.wishes(df.groupBy(m.F.concat(m.F.lit("s"), "source").alias("src")).count().withColumnRenamed("count", "n"), target), 100)
    assert len(levels) > 2 and all(r.n < 100 for x in levels for r in x.groupBy("parent").count().withColumnRenamed("count", "n").collect())
    got = sorted(mixed(df, target=target, quantum=100, block=1).collect(), key=lambda r: r.mix_position)
    assert sorted((r.doc_id, r.source) for r in got) == sorted(given)
    assert [r.mix_position for r in got] == list(range(1, len(given) + 1))
    assert [r.mix_slot for r in got] == sorted({r.mix_slot for r in got})
    # a fourth of the slots are the big source's, from the start
    for n, slot in enumerate(r.mix_slot for r in got if r.source == "big"):
        assert abs(slot - n * 4) <= 4 + n / 10  # weights are whole parts of 100
    # every source gets on at about the pace of its weight
    end = {s: max(r.mix_slot for r in got if r.source == s) for s in sizes}
    assert max(end[s] / sizes[s] for s in list(sizes)[1:]) < 2.2 * min(end[s] / sizes[s] for s in list(sizes)[1:])


def test_unequal_targets_keep_their_shares(spark):
    given = [(i, "a" if i < 3 else "b") for i in range(9003)]
    got = mixed(spark.createDataFrame(given, "doc_id long, source string"), target={"a": 1, "b": 3000}, block=1).collect()
    assert sorted(r.mix_slot // 3001 for r in got if r.source == "a") == [0, 1, 2]


def test_python_free(spark):
    text = mixed(spark.createDataFrame(rows(3), SCHEMA))._jdf.queryExecution().toString()
    assert not any(x in text for x in ("Python", "Pandas", "Arrow"))
