"""Graph, closure, foreign-key draw and append queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.draw import Draw, sql_bits, sql_below
from weftline.functions.spread import SCALE, Spread, label_draw, zipf_weights
from weftline.operators import append, audit
from weftline.operators.closure import closure
from weftline.operators.foreign import assign, dense_parent, self_parent
from weftline.operators.graph import key_groups, order, protected, representative
from weftline.operators.numbering import dense_rank
from weftline.sources.model import KEYS, Column, ForeignKey, Schema, Table, stored

TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
ALL_COLUMNS = {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]}
EDGES = [(t, c, p, pc) for t, (_, fks) in KEYS.items() for c, p, pc in fks]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def topo_order(spark: SparkSession, sf: str) -> DataFrame:
    waves = order(stored(spark, sf)[0])[1]
    return spark.createDataFrame([(k.split(".")[1], i) for i, w in enumerate(waves) for k in w], "table_name string, wave int")


def fk_key_groups(spark: SparkSession, sf: str) -> DataFrame:
    schema = stored(spark, sf)[0]
    guard = protected(schema)
    rows = [(f"{k.split('.')[1]}.{c}", ".".join((g[0][0].split(".")[1], g[0][1])), (k, c) == representative(schema, g), (k, c) in guard) for g in key_groups(schema) for k, c in g]
    return spark.createDataFrame(rows, "member string, first_member string, is_representative boolean, is_protected boolean")


def _sums(found: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, key_sum) of a closure."""
    parts = []
    for key, df in found.items():
        name = key.split(".")[1]
        first = KEYS[name][0][0] if KEYS[name][0] else df.columns[0]
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col(first).cast("long")), F.lit(0)).alias("key_sum")).select(F.lit(name).alias("table_name"), "n_rows", "key_sum"))
    return reduce(DataFrame.unionByName, parts)


def _closed(start: dict[str, int], names: tuple[str, ...] = TPCH):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        schema, frames = stored(spark, sf, names)
        return _sums(closure(schema, frames, start))

    return run


def closure_null_fk(spark: SparkSession, sf: str) -> DataFrame:
    schema, frames = stored(spark, sf, ("region", "nation", "customer", "orders"))
    frames["main.orders"] = frames["main.orders"].withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_custkey")))
    return _sums(closure(schema, frames, {"orders": 200}))


def closure_self_fk(spark: SparkSession, sf: str) -> DataFrame:
    t = Table("tree", (Column("id", "integer"), Column("up", "integer")), primary=("id",), foreign=(ForeignKey(("up",), "main.tree", ("id",)),))
    schema = Schema({t.key: t})
    n = _read(spark, sf, "nation").select((F.lit(30) - F.col("n_nationkey")).cast("long").alias("id"))
    tree = n.union(spark.range(1, 6).select("id")).withColumn("up", F.when(F.col("id") > 1, F.expr("id div 2")))
    # the roots with the smallest ids have no way to go: take the far end
    tree = tree.select((-F.col("id")).alias("id"), (-F.col("up")).alias("up"))
    return closure(schema, {t.key: tree}, {"tree": 3})[t.key].select("id", "up")


def closure_rows_customer(spark: SparkSession, sf: str) -> DataFrame:
    schema, frames = stored(spark, sf, TPCH)
    return closure(schema, frames, {"orders": 300})["main.customer"]


CHILDREN = 10_000


def _children(spark: SparkSession) -> DataFrame:
    return spark.range(CHILDREN).withColumnRenamed("id", "i")


def _draw(name: str, row: C | None = None) -> Draw:
    return Draw(7, name, F.col("i") if row is None else row)


def _ranked(spark: SparkSession, sf: str, table: str, key: str) -> tuple[DataFrame, int]:
    parents = _read(spark, sf, table).select(key)
    return dense_rank(parents, [key]).withColumn("rank", F.col("rank").cast("long")), parents.count()


def _fk(table: str, key: str, name: str, spread: Spread):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        pool, n = _ranked(spark, sf, table, key)
        return assign(_children(spark), _draw(name), pool, n, spread).select("i", F.col(key).alias("parent"))

    return run


def fk_composite_tuple(spark: SparkSession, sf: str) -> DataFrame:
    parents = _read(spark, sf, "conversations").select("conv_id", "turn").distinct()
    pool = dense_rank(parents, ["conv_id", "turn"]).withColumn("rank", F.col("rank").cast("long"))
    return assign(_children(spark), _draw("composite"), pool, parents.count()).select("i", "conv_id", "turn")


def fk_fanout_skew(spark: SparkSession, sf: str) -> DataFrame:
    """Half-cover of zipf against uniform draws over the same parents."""
    pool, n = _ranked(spark, sf, "customer", "c_custkey")
    parts = []
    for kind in ("uniform", "zipf"):
        rows = assign(_children(spark), _draw(f"fan {kind}"), pool, n, Spread(kind))
        parts.append(audit.half_cover(rows, "c_custkey").select(F.lit(kind).alias("spread"), "n_parents", "n_half"))
    return audit.together(parts)


def fk_dense(spark: SparkSession, sf: str) -> DataFrame:
    return _children(spark).select("i", dense_parent(_draw("dense"), 777).alias("parent"))


def self_fk_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _children(spark).select((F.col("i") + 1).alias("id"), self_parent(_draw("tree"), F.col("i")).alias("up"), self_parent(_draw("tree"), F.col("i"), nullable=False).alias("up_required"))


STATUSES = (("paid", 0.7), ("open", 0.2), ("void", 0.1))
CITIES = ["north", "east", "south", "west", "centre"]


def value_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _children(spark).select("i", label_draw(_draw("status"), Spread("weighted", weights=STATUSES), []).alias("label"))


def value_zipf_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _children(spark).select("i", label_draw(_draw("city"), Spread("zipf", 1.5), CITIES).alias("label"))


def append_ids(spark: SparkSession, sf: str) -> DataFrame:
    orders = _read(spark, sf, "orders")
    start = append.next_id(orders, "o_orderkey")
    new = spark.range(500).select((F.col("id") + start).alias("o_orderkey"))
    old = orders.agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top"))
    return new.join(F.broadcast(old)).agg(F.count(F.lit(1)).alias("n_new"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"), F.sum((F.col("o_orderkey") <= F.col("top")).cast("long")).alias("collisions"))


def append_children(spark: SparkSession, sf: str) -> DataFrame:
    schema, frames = stored(spark, sf, ("customer", "orders"))
    start = append.next_id(frames["main.orders"], "o_orderkey")
    pool = append.pool(frames["main.customer"], schema.find("customer"), ["c_custkey"])
    new = spark.range(500).withColumnRenamed("id", "i")
    drawn = assign(new, _draw("append"), pool, min(append.PARENTS, frames["main.customer"].count()))
    return drawn.select((F.col("i") + start).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"))


QUERIES = {
    "topo_order": topo_order,
    "key_groups": fk_key_groups,
    "closure_lineitem": _closed({"lineitem": 100}),
    "closure_orders": _closed({"orders": 1000}),
    "closure_multi_root": _closed({"orders": 50, "supplier": 20}),
    "closure_labels": _closed({"labels": 60}, ("documents", "labels")),
    "closure_null_fk": closure_null_fk,
    "closure_self_fk": closure_self_fk,
    "closure_rows_customer": closure_rows_customer,
    "fk_uniform_draw": _fk("customer", "c_custkey", "uniform", Spread()),
    "fk_zipf_draw": _fk("part", "p_partkey", "zipf", Spread("zipf")),
    "fk_zipf_skew2": _fk("part", "p_partkey", "zipf2", Spread("zipf", 2.0)),
    "fk_weighted_degrades_uniform": _fk("customer", "c_custkey", "weighted", Spread("weighted", weights=STATUSES)),
    "fk_composite_tuple": fk_composite_tuple,
    "fk_fanout_skew": fk_fanout_skew,
    "fk_dense": fk_dense,
    "self_fk_tree": self_fk_tree,
    "value_weighted": value_weighted,
    "value_zipf_labels": value_zipf_labels,
    "append_ids": append_ids,
    "append_children": append_children,
}


def _closure_sql(roots: dict[str, str], names: tuple[str, ...] = TPCH, replace: dict[str, str] | None = None) -> str:
    """Nested IN, children first; roots: table -> subquery of its root rows' condition."""
    parts, out = [], []
    edges = [e for e in EDGES if e[0] in names and e[2] in names]
    for t in reversed([n for n in KEYS if n in names]):
        conds = [f"{e[3]} IN (SELECT {e[1]} FROM s_{e[0]} WHERE {e[1]} IS NOT NULL)" for e in edges if e[2] == t]
        if t in roots:
            conds.append(roots[t])
        if not conds:
            conds = ["false"]
        src = (replace or {}).get(t, t)
        parts.append(f"s_{t} AS (SELECT {'DISTINCT ' if not KEYS[t][0] else ''}* FROM {src} WHERE {' OR '.join(conds)})")
        key = KEYS[t][0][0] if KEYS[t][0] else ALL_COLUMNS[t][0]
        out.append(f"SELECT '{t}' AS table_name, count(*) AS n_rows, coalesce(sum({key}), 0)::BIGINT AS key_sum FROM s_{t} HAVING count(*) > 0")
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL\n".join(out)


def _roots(table: str, n: int) -> str:
    key = KEYS[table][0][0]
    return f"{key} IN (SELECT {key} FROM {table} ORDER BY {key} LIMIT {n})"


def _rows(n: int) -> str:
    return f"(SELECT i FROM range({n}) r(i))"


def _fk_sql(table: str, key: str, name: str) -> str:
    return f"WITH p AS (SELECT {key}, row_number() OVER (ORDER BY {key}) AS rank FROM {table}), c AS (SELECT i, 1 + {sql_below(7, name, 'i', '(SELECT count(*) FROM p)')} AS rank FROM {_rows(CHILDREN)}) SELECT i, {key} AS parent FROM c JOIN p USING (rank)"


def _zipf_sql(table: str, key: str, name: str, skew: int) -> str:
    w = f"greatest(1, floor({SCALE}.0::DOUBLE / {'rank::DOUBLE' if skew == 1 else 'pow(rank::DOUBLE, 2.0)'}))::BIGINT"
    return f"""WITH p AS (SELECT {key}, row_number() OVER (ORDER BY {key}) AS rank FROM {table}),
w AS (SELECT *, {w} AS w FROM p), t AS (SELECT *, (sum(w) OVER (ORDER BY rank))::BIGINT AS hi FROM w),
c AS (SELECT i, {sql_below(7, name, 'i', '(SELECT max(hi) FROM t)')} AS x FROM {_rows(CHILDREN)})
SELECT i, {key} AS parent FROM c JOIN t ON x >= hi - w AND x < hi"""


def _label_sql(name: str, labels: list[str], weights: list[int]) -> str:
    case, total = "", 0
    for v, w in zip(labels, weights, strict=True):
        total += w
        case += f" WHEN x < {total} THEN '{v}'"
    return f"SELECT i, CASE{case} END AS label FROM (SELECT i, {sql_below(7, name, 'i', sum(weights))} AS x FROM {_rows(CHILDREN)})"


def _half(rows: str, column: str) -> str:
    return f"SELECT count(*) AS n_parents, count(*) FILTER (WHERE 2 * ahead < total) AS n_half FROM (SELECT n, sum(n) OVER (ORDER BY n DESC, k ROWS UNBOUNDED PRECEDING) - n AS ahead, sum(n) OVER () AS total FROM (SELECT {column} AS k, count(*) AS n FROM ({rows}) GROUP BY 1))"


def _groups_sql() -> str:
    members = sorted({(t, c) for t, c, _, _ in EDGES} | {(p, pc) for _, _, p, pc in EDGES})
    edges = ", ".join(f"('{t}.{c}', '{p}.{pc}')" for t, c, p, pc in EDGES)
    nodes = ", ".join(f"('{t}.{c}')" for t, c in members)
    return f"""WITH RECURSIVE e(a, b) AS (VALUES {edges}), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n(m) AS (VALUES {nodes}),
reach(a, b) AS (SELECT m, m FROM n UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
f AS (SELECT a AS member, min(b) AS first_member FROM reach GROUP BY a)
SELECT member, first_member, member = (SELECT coalesce(min(g.member) FILTER (WHERE g.member IN (SELECT b FROM e)), min(g.member)) FROM f g WHERE g.first_member = f.first_member) AS is_representative, true AS is_protected FROM f"""


_ZIPF5 = zipf_weights(5, 1.5)
_W3 = [1_000_000, 285_714, 142_857]
ORACLES = {
    "topo_order": "WITH RECURSIVE e(c, p) AS (VALUES " + ", ".join(f"('{t}', '{p}')" for t, _, p, _ in EDGES) + "), n(t) AS (VALUES " + ", ".join(f"('{t}')" for t in KEYS) + "), d(t, w) AS (SELECT t, 0 FROM n UNION SELECT e.c, d.w + 1 FROM d JOIN e ON e.p = d.t) SELECT t AS table_name, max(w)::INTEGER AS wave FROM d GROUP BY t",
    "key_groups": _groups_sql(),
    "closure_lineitem": _closure_sql({"lineitem": "row(" + ", ".join(ALL_COLUMNS["lineitem"]) + ") IN (SELECT row(" + ", ".join(ALL_COLUMNS["lineitem"]) + ") FROM lineitem ORDER BY " + ", ".join(ALL_COLUMNS["lineitem"]) + " LIMIT 100)"}),
    "closure_orders": _closure_sql({"orders": _roots("orders", 1000)}),
    "closure_multi_root": _closure_sql({"orders": _roots("orders", 50), "supplier": _roots("supplier", 20)}),
    "closure_labels": _closure_sql({"labels": _roots("labels", 60)}, ("documents", "labels")),
    "closure_null_fk": _closure_sql({"orders": _roots("orders", 200)}, ("region", "nation", "customer", "orders"), {"orders": "(SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_custkey) FROM orders)"}),
    "closure_self_fk": "WITH RECURSIVE t AS (SELECT -id AS id, CASE WHEN id > 1 THEN -(id // 2) END AS up FROM (SELECT (30 - n_nationkey)::BIGINT AS id FROM nation UNION ALL SELECT i FROM range(1, 6) r(i))), c AS (SELECT * FROM (SELECT * FROM t ORDER BY id LIMIT 3) UNION SELECT t.* FROM c JOIN t ON t.id = c.up) SELECT id, up FROM c",
    "closure_rows_customer": "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 300))",
    "fk_uniform_draw": _fk_sql("customer", "c_custkey", "uniform"),
    "fk_zipf_draw": _zipf_sql("part", "p_partkey", "zipf", 1),
    "fk_zipf_skew2": _zipf_sql("part", "p_partkey", "zipf2", 2),
    "fk_weighted_degrades_uniform": _fk_sql("customer", "c_custkey", "weighted"),
    "fk_composite_tuple": f"WITH p AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS rank FROM (SELECT DISTINCT conv_id, turn FROM conversations)), c AS (SELECT i, 1 + {sql_below(7, 'composite', 'i', '(SELECT count(*) FROM p)')} AS rank FROM {_rows(CHILDREN)}) SELECT i, conv_id, turn FROM c JOIN p USING (rank)",
    "fk_fanout_skew": f"SELECT 'uniform' AS spread, * FROM ({_half(_fk_sql('customer', 'c_custkey', 'fan uniform'), 'parent')}) UNION ALL SELECT 'zipf', * FROM ({_half(_zipf_sql('customer', 'c_custkey', 'fan zipf', 1), 'parent')})",
    "fk_dense": f"SELECT i, 1 + {sql_below(7, 'dense', 'i', 777)} AS parent FROM {_rows(CHILDREN)}",
    "self_fk_tree": f"SELECT i + 1 AS id, CASE WHEN i = 0 OR {sql_bits(7, 'tree', 'i')} / 4503599627370496.0::DOUBLE < 0.6::DOUBLE THEN NULL ELSE 1 + {sql_below(7, 'tree', 'i', 'i', 1)} END AS up, CASE WHEN i = 0 THEN 1 ELSE 1 + {sql_below(7, 'tree', 'i', 'i', 1)} END AS up_required FROM {_rows(CHILDREN)}",
    "value_weighted": _label_sql("status", [v for v, _ in STATUSES], _W3),
    "value_zipf_labels": _label_sql("city", CITIES, _ZIPF5),
    "append_ids": "SELECT 500::BIGINT AS n_new, max(o_orderkey) + 1::BIGINT AS first_id, max(o_orderkey) + 500::BIGINT AS last_id, 0::BIGINT AS collisions FROM orders",
    "append_children": f"WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rank FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 100000)), c AS (SELECT i, 1 + {sql_below(7, 'append', 'i', '(SELECT count(*) FROM p)')} AS rank FROM {_rows(500)}) SELECT (SELECT max(o_orderkey) + 1 FROM orders) + i AS o_orderkey, c_custkey AS o_custkey FROM c JOIN p USING (rank)",
}
