import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import names
from weftline.functions.checks import Bounds, distil, violates
from weftline.functions.draw import Draw
from weftline.functions.generators import Context, MAKERS, base, bounded, finished, override, value
from weftline.functions.instants import ms_of, millis, timestamp
from weftline.functions.patterns import sampler
from weftline.functions.spread import Spread, label_draw, zipf_weights
from weftline.sources.model import Column, Partition, Table

CHECKS = {
    "(price > (0)::numeric)": {"price": Bounds(low=0, low_open=True)},
    "((qty >= 1) AND (qty <= 100))": {"qty": Bounds(low=1, high=100)},
    "((status)::text = ANY ((ARRAY['a'::character varying, 'b'::character varying])::text[]))": {"status": Bounds(among=("a", "b"))},
    "status IN ('x', 'it''s')": {"status": Bounds(among=("x", "it's"))},
    "char_length(code) >= 3 AND length(code) < 9": {"code": Bounds(min_length=3, max_length=8)},
    "octet_length(code) = 4": {"code": Bounds(min_length=4, max_length=4, octets=True)},
    "zip ~ '^[0-9]{5}$'": {"zip": Bounds(pattern="^[0-9]{5}$")},
    "name ~* '^a'": {"name": Bounds(pattern="^a", ignore_case=True)},
    "10 < n": {"n": Bounds(low=10, low_open=True)},
    "n BETWEEN -5 AND 5 AND n <> 3": {"n": Bounds(low=-5, high=5)},
    "n >= 0 AND n > 0": {"n": Bounds(low=0, low_open=True)},
    "a = 1 OR b = 2": {},
    "a > b": {},
    "`k` >= 2.5": {"k": Bounds(low=2.5)},
    "x IN (SELECT 1)": {},
}


@pytest.mark.parametrize("text", CHECKS)
def test_checks(text):
    assert distil([text]) == CHECKS[text]


def test_checks_meet():
    got = distil(["a IN ('x','y')", "a IN ('y','z')", "n > 1", "n >= 3", "n < 9"])
    assert got == {"a": Bounds(among=("y",)), "n": Bounds(low=3, high=9, high_open=True)}


def test_violations(spark):
    df = spark.createDataFrame([("a", 5), ("bbbb", 11), (None, None)], "t string, n int")
    bad = df.select(violates(Bounds(max_length=2), F.col("t")).alias("x"), violates(Bounds(low=5, high=10, low_open=True), F.col("n")).alias("y")).collect()
    assert [tuple(r) for r in bad] == [(False, True), (True, True), (False, False)]


def test_names():
    assert names.tokens("billingAddress_line-2") == ["billing", "address", "line", "2"]
    want = {"user_email": "internet.email", "name": "person.fullName", "surname": "person.lastName", "createdAt": "date.past", "created": "date.past", "zip": "location.zipCode", "unzipped": None, "order_total": "commerce.price", "company_name": "company.name", "imageUrl": "image.url", "profile_link": "internet.url", "updated_at": "date.recent"}
    assert {k: names.text_rule(k) for k in want} == want
    assert names.number_rule("age") == (0, 95) and names.number_rule("unit_price") == "money" and names.number_rule("page") is None


PATTERNS = ["^[0-9]{5}$", "[A-Z]{2,3}-\\d+", "(ab|c)*x?", "\\w{1,20}", "[^a-z]{3,}", "a.c", "v[0-9]+\\.[0-9]+", "(?:no|yes)!", "[[:digit:]]{2}"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_match(spark, pattern):
    rows = spark.range(200).select(sampler(pattern, Draw(1, "p", F.col("id"))).alias("t")).collect()
    plain = re.compile("(?:" + pattern.replace("[[:digit:]]", "[0-9]").strip("^$") + r")\Z")
    assert all(plain.match(r.t) for r in rows) and len({r.t for r in rows}) > 1


@pytest.mark.parametrize("pattern", ["(?=a)b", "a\\1", "[", "(a"])
def test_patterns_without_sampler(spark, pattern):
    assert sampler(pattern, Draw(1, "p", F.col("id"))) is None


@pytest.mark.parametrize("rng", ["md5", "xxhash64"])
def test_draws_do_not_depend_on_partitions(spark, rng):
    d = Draw(3, "t.c", F.col("id"), rng=rng)
    got = [sorted((r.id, r.u, r.k) for r in spark.range(0, 300, 1, n).select("id", d.u().alias("u"), d.below(10, 1).alias("k")).collect()) for n in (1, 3, 8)]
    assert got[0] == got[1] == got[2]
    assert all(0 <= u < 1 and 0 <= k < 10 for _, u, k in got[0])
    assert abs(sum(u for _, u, _ in got[0]) / 300 - 0.5) < 0.06


def test_zipf_heads(spark):
    d = Draw(5, "z", F.col("id"))
    labels = [f"l{k:02d}" for k in range(100)]
    n = {r.l: r["count"] for r in spark.range(5000).select(label_draw(d, Spread("zipf"), labels).alias("l")).groupBy("l").count().collect()}
    head, tail = (sum(n.get(x, 0) for x in labels[a:b]) for a, b in ((0, 10), (90, 100)))
    assert head > 5 * tail
    assert zipf_weights(3, 2) == [1_000_000, 250_000, 111_111]
    assert label_draw(d, Spread(), labels) is None


KINDS = [Column("v", k) for k in ("integer", "decimal", "boolean", "uuid", "json", "date", "time", "timestamp", "bytea", "inet", "money", "interval", "macaddr", "xml", "text", "unsupported")]
KINDS += [Column("v", "array", element=Column("e", "text")), Column("v", "composite", fields=(Column("a", "date"), Column("b", "integer"))), Column("v", "range", element=Column("b", "timestamp")), Column("v", "enum", labels=("x", "y")), Column("v", "decimal", precision=4, scale=2), Column("v", length=3)]


@pytest.mark.parametrize("column", KINDS, ids=lambda c: f"{c.kind}{c.precision or c.length or ''}")
def test_every_kind_has_its_type(spark, column):
    made = finished(value(Draw(1, "x", F.col("id")), Table("t", (column,)), column, None, Context()), column)
    df = spark.range(50).select(made.alias("v"))
    assert df.schema["v"].dataType.simpleString() == column.spark_type().simpleString()
    rows = [r.v for r in df.collect()]
    assert all((v is None) == (column.kind == "unsupported") for v in rows)
    if column.kind == "range":
        assert all(v.lower < v.upper for v in rows)
    if column.length:
        assert all(len(v) <= 3 for v in rows)


@pytest.mark.parametrize("name", sorted(MAKERS))
def test_every_maker(spark, name):
    rows = spark.range(40).select(MAKERS[name](Draw(2, name, F.col("id")), Context()).alias("v")).collect()
    assert all(r.v is not None for r in rows)


def test_bounds_hold(spark):
    d = Draw(1, "b", F.col("id"))
    cases = [(Bounds(low=0, high=1, low_open=True, high_open=True), Column("r", "decimal"), 0.01, 0.99), (Bounds(high=5), Column("n", "integer"), -995, 5), (Bounds(low=2.5), Column("n", "integer"), 3, 1003)]
    for b, c, lo, hi in cases:
        v = [r.v for r in spark.range(500).select(bounded(d, b, c).alias("v")).collect()]
        assert lo <= min(v) and max(v) <= hi


def test_precedence(spark):
    c, t = Column("status", "enum", labels=("a", "b")), Table("t", (Column("status", "enum", labels=("a", "b")),))
    d = Draw(1, "s", F.col("id"))
    one = lambda b, ctx: {r.v for r in spark.range(60).select(value(d, t, c, b, ctx).alias("v")).collect()}
    assert one(None, Context()) == {"a", "b"}
    assert one(Bounds(among=("z",)), Context()) == {"z"}
    assert one(Bounds(among=("z",)), Context(columns={"t.status": {"value": "q"}, "status": {"value": "r"}})) == {"q"}
    assert one(None, Context(columns={"status": {"value": "q"}}, spreads={"main.t.status": Spread("weighted", weights=(("w", 1.0),))})) == {"w"}
    with pytest.raises(ValueError, match="no generator"):
        override(d, "no.such", Context())


def test_partition_keys(spark):
    c = Column("at", "date")
    t = Table("t", (c,), partition=Partition("range", ("at",), ranges=(("2024-01-01", "2024-02-01"),)))
    days = {str(r.v) for r in spark.range(200).select(finished(value(Draw(1, "p", F.col("id")), t, c, None, Context()), c).alias("v")).collect()}
    assert min(days) >= "2024-01-01" and max(days) < "2024-02-01" and len(days) > 20


def test_instants(spark):
    df = spark.range(1).select(timestamp(F.lit(millis("2024-03-31T02:30:00.125"))).alias("t")).select("t", ms_of(F.col("t"), "timestamp").alias("ms"))
    r = df.first()
    assert str(r.t) == "2024-03-31 02:30:00.125000" and r.ms == millis("2024-03-31T02:30:00.125")
    assert base(Draw(1, "x", F.lit(1)), Column("year", "integer"), Context()) is not None
