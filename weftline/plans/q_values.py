"""Queries over value generators, each with the same draws in SQL."""

from __future__ import annotations

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.checks import distil
from weftline.functions.draw import Draw, sql_below, sql_bits
from weftline.functions.generators import NULLS, Context, base, bounded, finished, key_of_partition, override, value
from weftline.functions.instants import DAY, millis
from weftline.functions.names import NUMBER_RULES
from weftline.functions.patterns import sampler
from weftline.functions.vocabulary import SEXES
from weftline.sources.model import Column, Partition, Table

SEED, ROWS = 7, 5000


def _range(spark: SparkSession, n: int = ROWS) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "i")


def _draw(name: str) -> Draw:
    return Draw(SEED, name, F.col("i"))


def _below(name: str, n: int | str, slot: int = 0) -> str:
    return sql_below(SEED, name, "i", n, slot)


def _from(select: str, n: int = ROWS) -> str:
    return f"SELECT i, {select} FROM range({n}) r(i)"


def gen_numeric_rules(spark: SparkSession, sf: str) -> DataFrame:
    made = [base(_draw(f"rule.{r.maker}"), Column(r.maker, "integer"), Context()).alias(f"{r.maker}_value") for r, _, _ in NUMBER_RULES]
    return _range(spark).select("i", *made)


BOUNDED = ("a > 5 AND a <= 20", "b >= 10", "c BETWEEN -3 AND 3")


def gen_bounded(spark: SparkSession, sf: str) -> DataFrame:
    b = distil(BOUNDED)
    return _range(spark).select("i", *(bounded(_draw(f"bounded.{k}"), b[k], Column(k, "integer")).alias(k) for k in "abc"))


def gen_scaled_decimal(spark: SparkSession, sf: str) -> DataFrame:
    price, rate = Column("price", "decimal", precision=10, scale=2), Column("rate", "decimal")
    b = distil(["rate > 0 AND rate < 1"])
    return _range(spark).select("i", base(_draw("price"), price, Context()).alias("price"), bounded(_draw("rate"), b["rate"], rate).alias("rate"))


def gen_null_injection(spark: SparkSession, sf: str) -> DataFrame:
    d = _draw("nullable")
    return _range(spark).select("i", F.when(d.of("nullable.null").u() >= NULLS, d.below(100)).alias("v"))


def gen_partition_key(spark: SparkSession, sf: str) -> DataFrame:
    lists = Partition("list", ("region",), values=("eu", "us", "apac"))
    ranges = Partition("range", ("at",), ranges=(("2024-01-01", "2025-01-01"), ("2025-01-01", "2025-07-01")))
    day = Column("at", "date")
    return _range(spark).select("i", key_of_partition(_draw("list"), Column("region"), lists).alias("region"), finished(key_of_partition(_draw("range"), day, ranges), day).alias("at"))


def _made(name: str, c: Column) -> C:
    return finished(base(_draw(name), c, Context()), c)


def gen_array(spark: SparkSession, sf: str) -> DataFrame:
    v = _made("arr", Column("v", "array", element=Column("e", "integer")))
    return _range(spark).select("i", F.size(v).cast("long").alias("n"), F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def gen_struct(spark: SparkSession, sf: str) -> DataFrame:
    v = _made("rec", Column("v", "composite", fields=(Column("code", "integer", bits=16), Column("on", "boolean"))))
    return _range(spark).select("i", v["code"].cast("long").alias("code"), v["on"].alias("is_on"))


def gen_range(spark: SparkSession, sf: str) -> DataFrame:
    v = _made("rng", Column("v", "range", element=Column("b", "integer")))
    return _range(spark).select("i", v["lower"].alias("low"), v["upper"].alias("high"))


def gen_interval(spark: SparkSession, sf: str) -> DataFrame:
    v = _made("gap", Column("v", "interval"))
    part = lambda p: F.extract(F.lit(p), v).cast("long")
    return _range(spark).select("i", (((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60 + part("SECOND")).alias("seconds"))


def gen_json_shapes(spark: SparkSession, sf: str) -> DataFrame:
    made = [base(_draw(f"json.{k}"), Column(k, "json"), Context()).alias(f"{k}_json") for k in ("dimensions", "settings")]
    return _range(spark).select("i", *made)


def gen_regex_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _range(spark).select("i", sampler("^[A-F]{2}-[0-9]{3}(x|yz)$", _draw("re")).alias("code"))


def gen_overrides(spark: SparkSession, sf: str) -> DataFrame:
    made = {"tier": {"value": "gold"}, "state": {"values": ["on", "off", "idle"]}, "who": "person.sex"}
    return _range(spark).select("i", *(override(_draw(f"over.{k}"), s, Context()).alias(k) for k, s in made.items()))


def gen_checked_labels(spark: SparkSession, sf: str) -> DataFrame:
    checks = ("size IN ('S', 'M', 'L')",)
    c = Column("size")
    return _range(spark).select("i", value(_draw("sized"), Table("t", (c,), checks=checks), c, distil(checks)["size"], Context()).alias("size_label"))


def check_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """CHECK texts distilled to bounds on columns."""
    checks = ["(price > 0)", "qty >= 1 AND qty <= 100", "(status = ANY (ARRAY['a'::text, 'b'::text]))", "char_length(code) <= 5", "10 < n", "zip ~ '^[0-9]{5}$'"]
    rows = [(k, b.low, b.high, b.low_open, ",".join(b.among) if b.among else None, b.max_length, b.pattern) for k, b in sorted(distil(checks).items())]
    return spark.createDataFrame([(k, None if lo is None else float(lo), None if hi is None else float(hi), o, a, m, p) for k, lo, hi, o, a, m, p in rows], "column_name string, low double, high double, low_open boolean, among string, max_length int, pattern string")


QUERIES = {f.__name__: f for f in (gen_numeric_rules, gen_bounded, gen_scaled_decimal, gen_null_injection, gen_partition_key, gen_array, gen_struct, gen_range, gen_interval, gen_json_shapes, gen_regex_sample, gen_overrides, gen_checked_labels, check_bounds)}


def _pick(name: str, values: list, slot: int = 0) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][1 + {_below(name, len(values), slot)}]"


_RANGE_SQL = f"""WITH w AS (SELECT i, [{millis('2024-01-01')}, {millis('2025-01-01')}][1 + {_below('range', 2)}]::BIGINT AS lo, [366, 181][1 + {_below('range', 2)}]::BIGINT AS days, {_pick('list', ['eu', 'us', 'apac'])} AS region FROM range({ROWS}) r(i))
SELECT i, region, (DATE '1970-01-01' + ((lo + {_below('range', 'days', 1)} * {DAY}) // {DAY})::INTEGER) AS at FROM w"""

ORACLES = {
    "gen_numeric_rules": _from(", ".join(f"{lo} + {_below(f'rule.{r.maker}', hi - lo + 1)} AS {r.maker}_value" for r, lo, hi in NUMBER_RULES)),
    "gen_bounded": _from(f"6 + {_below('bounded.a', 15)} AS a, 10 + {_below('bounded.b', 1001)} AS b, -3 + {_below('bounded.c', 7)} AS c"),
    "gen_scaled_decimal": _from(f"{_below('price', 1_000_001)} / 100.0::DOUBLE AS price, (1 + {_below('rate', 99)}) / 100.0::DOUBLE AS rate"),
    "gen_null_injection": _from(f"CASE WHEN {sql_bits(SEED, 'nullable.null', 'i')} / 4503599627370496.0::DOUBLE >= {NULLS}::DOUBLE THEN {_below('nullable', 100)} END AS v"),
    "gen_partition_key": _RANGE_SQL,
    "gen_array": _from(f"{_below('arr', 4)} AS n, " + " + ".join(f"CASE WHEN {_below('arr', 4)} > {k} THEN {_below(f'arr.{k}', 1_000_001)} ELSE 0 END" for k in range(3)) + " AS total"),
    "gen_struct": _from(f"{_below('rec.code', 30_001)} AS code, {_below('rec.on', 2)} = 1 AS is_on"),
    "gen_range": _from(f"{_below('rng.lower', 1_000_001)} AS low, {_below('rng.lower', 1_000_001)} + 1 + {_below('rng', 100, 8)} AS high"),
    "gen_interval": _from(f"(({_below('gap', 91)} * 24 + {_below('gap', 24, 1)}) * 60 + {_below('gap', 60, 2)}) * 60 + {_below('gap', 60, 3)} AS seconds"),
    "gen_json_shapes": _from(
        f"""'{{"width":' || (1 + {_below('json.dimensions', 500)}) || ',"height":' || (1 + {_below('json.dimensions', 500, 1)}) || ',"unit":"' || {_pick('json.dimensions', ['cm', 'mm', 'in'], 2)} || '"}}' AS dimensions_json,
'{{"theme":"' || {_pick('json.settings', ['light', 'dark'])} || '","language":"' || {_pick('json.settings', ['en', 'de', 'fr', 'ja'], 1)} || '","notifications":' || ({_below('json.settings', 2, 2)} = 1) || '}}' AS settings_json"""
    ),
    "gen_regex_sample": _from(" || ".join([f"substr('ABCDEF', 1 + {_below('re', 6, s)}, 1)" for s in (0, 1)] + ["'-'"] + [f"{_below('re', 10, s)}" for s in (2, 3, 4)] + [f"CASE {_below('re', 2, 5)} WHEN 0 THEN 'x' ELSE 'yz' END"]) + " AS code"),
    "gen_overrides": _from(f"'gold' AS tier, {_pick('over.state', ['on', 'off', 'idle'])} AS state, {_pick('over.who', SEXES)} AS who"),
    "gen_checked_labels": _from(f"{_pick('sized', ['S', 'M', 'L'])} AS size_label"),
    "check_bounds": "SELECT * FROM (VALUES ('code', NULL::DOUBLE, NULL::DOUBLE, false, NULL, 5, NULL), ('n', 10.0, NULL, true, NULL, NULL, NULL), ('price', 0.0, NULL, true, NULL, NULL, NULL), ('qty', 1.0, 100.0, false, NULL, NULL, NULL), ('status', NULL, NULL, false, 'a,b', NULL, NULL), ('zip', NULL, NULL, false, NULL, NULL, '^[0-9]{5}$')) t(column_name, low, high, low_open, among, max_length, pattern)",
}
