"""Audit queries over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.checks import distil, violates
from weftline.operators import audit
from weftline.sources.model import KEYS, ForeignKey, stored


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def audit_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.row_counts(stored(spark, sf)[1])


def audit_orphans_all_fks(spark: SparkSession, sf: str) -> DataFrame:
    schema, frames = stored(spark, sf)
    return audit.orphan_counts(schema, frames)


def audit_orphans_injected(spark: SparkSession, sf: str) -> DataFrame:
    orders = _read(spark, sf, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey")))
    bad = audit.orphans(orders, ForeignKey(("o_custkey",), "main.customer", ("c_custkey",)), _read(spark, sf, "customer"))
    return bad.agg(F.count(F.lit(1)).alias("violations"), F.min("o_orderkey").alias("first_order"), F.max("o_orderkey").alias("last_order"))


def audit_parent_without_children(spark: SparkSession, sf: str) -> DataFrame:
    pairs = (("customer", "c_custkey", "orders", "o_custkey"), ("part", "p_partkey", "lineitem", "l_partkey"), ("supplier", "s_suppkey", "lineitem", "l_suppkey"))
    return audit.together([audit.orphans(_read(spark, sf, p), ForeignKey((pk,), c, (ck,)), _read(spark, sf, c)).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"{p} without {c}").alias("subject"), "violations") for p, pk, c, ck in pairs])


def audit_unique_single(spark: SparkSession, sf: str) -> DataFrame:
    schema, frames = stored(spark, sf)
    return audit.together([audit.duplicates(frames[k], list(t.primary), f"{t.name}.{t.primary[0]}") for k, t in schema.tables.items() if len(t.primary) == 1])


def audit_unique_composite(spark: SparkSession, sf: str) -> DataFrame:
    return audit.together([audit.duplicates(_read(spark, sf, t), c, f"{t}.{','.join(c)}") for t, c in (("conversations", ["conv_id", "turn"]), ("lineitem", ["l_orderkey", "l_linenumber"]))])


LABELS = {"orders": "o_orderstatus IN ('P', 'O') AND o_orderpriority = ANY (ARRAY['1-URGENT'::text, '2-HIGH'::text, '3-MEDIUM'::text])", "customer": "c_mktsegment in ('BUILDING', 'MACHINERY')", "events": "event_type IN ('view', 'click', 'purchase')"}
NUMBERS = {"lineitem": "l_quantity BETWEEN 2 AND 45 AND l_discount >= 0 AND 0.08 > l_discount AND l_tax <= 0.07", "part": "p_size > 0 AND p_size <= 40"}
LENGTHS = {"customer": "char_length(c_name) >= 3 AND length(c_name) < 18", "part": "octet_length(p_name) <= 12"}
PATTERNS = {"part": "p_brand ~ '^Brand#[1-3][0-9]*$'", "customer": "c_name ~ '^Customer#[0-9]*[02468]$'"}


def _bounds(checks: dict[str, str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return audit.together([audit.tally(_read(spark, sf, t), f"{t}.{c}", violates(b, F.col(c))) for t, text in checks.items() for c, b in distil([text]).items()])

    return run


def audit_array_elements(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "embeddings")
    out = F.aggregate("embedding", F.lit(0).cast("long"), lambda acc, x: acc + F.when((x < -0.25) | (x > 0.25), 1).otherwise(0))
    return e.agg(F.sum(F.size("embedding")).cast("long").alias("n_elements"), F.sum(out).cast("long").alias("violations"))


def audit_array_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Elements of arrays that are none of the labels."""
    roles = _read(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    wrong = F.size(F.filter("roles", lambda r: ~r.isin("user", "assistant"))).cast("long")
    return roles.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("roles")).cast("long").alias("n_elements"), F.sum(wrong).alias("violations"))


def audit_json_valid(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events")
    return e.agg(F.sum(F.when(F.col("props").isNotNull() & F.try_parse_json("props").isNull(), 1).otherwise(0)).cast("long").alias("violations"), F.sum(F.when(F.get_json_object("props", "$.k").isNotNull(), 1).otherwise(0)).cast("long").alias("n_with_k"))


def audit_partition_routing(spark: SparkSession, sf: str) -> DataFrame:
    o = _read(spark, sf, "orders")
    year = F.year("o_orderdate")
    # parts as they would be loaded, each by its own bounds, but for one day's rows that went to the wrong part
    late = F.col("o_orderdate").cast("date") == F.lit("1996-12-31").cast("date")
    parts = [o.where((F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"))).select(F.lit(0).alias("bucket")), o.where((year >= 1995) & (year < 1997) & ~late).select(F.lit(1).alias("bucket")), o.where((year >= 1997) | late).select(F.lit(2).alias("bucket"))]
    return audit.routing(o, F.when(year < 1995, 0).when(year < 1997, 1).otherwise(2), audit.together(parts))


def audit_temporal_child_vs_parent(spark: SparkSession, sf: str) -> DataFrame:
    li, o = _read(spark, sf, "lineitem"), _read(spark, sf, "orders")
    joined = li.select("l_orderkey", "l_shipdate").join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return audit.tally(joined, "lineitem.l_shipdate before orders.o_orderdate", F.col("l_shipdate") < F.col("o_orderdate"))


def audit_null_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.together([audit.null_counts(_read(spark, sf, t), t) for t in ("orders", "events")])


def fanout_per_parent(spark: SparkSession, sf: str) -> DataFrame:
    return audit.fan_out(_read(spark, sf, "orders"), "o_custkey")


def fanout_half_cover(spark: SparkSession, sf: str) -> DataFrame:
    return audit.half_cover(_read(spark, sf, "orders"), "o_custkey")


def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return audit.together([audit.shares(_read(spark, sf, t), c).select(F.lit(f"{t}.{c}").alias("subject"), "label", "n") for t, c in (("orders", "o_orderstatus"), ("events", "event_type"))])


def audit_distinct_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "orders").select("o_orderpriority").distinct().orderBy("o_orderpriority")


def audit_label_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Names that should follow from a key: customer and supplier names."""
    return audit.together([audit.tally(_read(spark, sf, t), f"{t}.{c}", F.col(c) != F.concat(F.lit(p), F.col(k).cast("string"))) for t, c, k, p in (("customer", "c_name", "c_custkey", "Customer#"), ("supplier", "s_name", "s_suppkey", "Supplier#"))])


QUERIES = {
    "audit_row_counts": audit_row_counts,
    "audit_orphans_all_fks": audit_orphans_all_fks,
    "audit_orphans_injected": audit_orphans_injected,
    "audit_parent_without_children": audit_parent_without_children,
    "audit_unique_single": audit_unique_single,
    "audit_unique_composite": audit_unique_composite,
    "audit_label_domain": _bounds(LABELS),
    "audit_numeric_bounds": _bounds(NUMBERS),
    "audit_length_bounds": _bounds(LENGTHS),
    "audit_regex": _bounds(PATTERNS),
    "audit_array_elements": audit_array_elements,
    "audit_array_labels": audit_array_labels,
    "audit_json_valid": audit_json_valid,
    "audit_partition_routing": audit_partition_routing,
    "audit_temporal_child_vs_parent": audit_temporal_child_vs_parent,
    "audit_null_counts": audit_null_counts,
    "audit_distinct_labels": audit_distinct_labels,
    "audit_label_agreement": audit_label_agreement,
    "fanout_per_parent": fanout_per_parent,
    "fanout_half_cover": fanout_half_cover,
    "label_distribution": label_distribution,
}


def _each(rows: list[str]) -> str:
    return "\nUNION ALL\n".join(rows)


def _count(table: str, column: str, bad: str) -> str:
    return f"SELECT '{table}.{column}' AS subject, count(*) FILTER (WHERE {bad}) AS violations FROM {table}"


ORACLES = {
    "audit_row_counts": _each([f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in KEYS]),
    "audit_orphans_all_fks": _each([f"SELECT '{t}.{c}' AS subject, count(*) AS violations FROM {t} c LEFT JOIN {p} p ON c.{c} = p.{pc} WHERE c.{c} IS NOT NULL AND p.{pc} IS NULL" for t, (_, fks) in KEYS.items() for c, p, pc in fks]),
    "audit_orphans_injected": "SELECT count(*) AS violations, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer)",
    "audit_parent_without_children": _each([f"SELECT '{p} without {c}' AS subject, count(*) AS violations FROM {p} WHERE NOT EXISTS (SELECT 1 FROM {c} WHERE {ck} = {pk})" for p, pk, c, ck in (("customer", "c_custkey", "orders", "o_custkey"), ("part", "p_partkey", "lineitem", "l_partkey"), ("supplier", "s_suppkey", "lineitem", "l_suppkey"))]),
    "audit_unique_single": _each([f"SELECT '{t}.{pk[0]}' AS subject, count(*) - count(DISTINCT {pk[0]}) AS violations FROM {t}" for t, (pk, _) in KEYS.items() if len(pk) == 1]),
    "audit_unique_composite": _each([f"SELECT '{t}.{a},{b}' AS subject, count(*) - count(DISTINCT ({a}, {b})) AS violations FROM {t}" for t, a, b in (("conversations", "conv_id", "turn"), ("lineitem", "l_orderkey", "l_linenumber"))]),
    "audit_label_domain": _each([_count("orders", "o_orderstatus", "o_orderstatus NOT IN ('P', 'O')"), _count("orders", "o_orderpriority", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"), _count("customer", "c_mktsegment", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"), _count("events", "event_type", "event_type NOT IN ('view', 'click', 'purchase')")]),
    "audit_numeric_bounds": _each([_count("lineitem", "l_quantity", "NOT l_quantity BETWEEN 2 AND 45"), _count("lineitem", "l_discount", "l_discount < 0 OR l_discount >= 0.08::DOUBLE"), _count("lineitem", "l_tax", "l_tax > 0.07::DOUBLE"), _count("part", "p_size", "p_size <= 0 OR p_size > 40")]),
    "audit_length_bounds": _each([_count("customer", "c_name", "length(c_name) < 3 OR length(c_name) >= 18"), _count("part", "p_name", "strlen(p_name) > 12")]),
    "audit_regex": _each([_count("part", "p_brand", "NOT regexp_matches(p_brand, '^Brand#[1-3][0-9]*$')"), _count("customer", "c_name", "NOT regexp_matches(c_name, '^Customer#[0-9]*[02468]$')")]),
    "audit_array_elements": "SELECT count(*) AS n_elements, count(*) FILTER (WHERE x < -0.25 OR x > 0.25) AS violations FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)",
    "audit_json_valid": "SELECT count(*) FILTER (WHERE props IS NOT NULL AND NOT json_valid(props)) AS violations, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL) AS n_with_k FROM events",
    "audit_partition_routing": """WITH b AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 0 WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 1 ELSE 2 END AS own, o_orderdate::DATE = DATE '1996-12-31' AS late FROM orders),
p AS (SELECT own AS bucket, count(*) AS n FROM b GROUP BY 1), c AS (SELECT CASE WHEN late THEN 2 ELSE own END AS bucket, count(*) AS n FROM b GROUP BY 1)
SELECT coalesce(p.bucket, c.bucket) AS bucket, coalesce(p.n, 0)::BIGINT AS n_parent, coalesce(c.n, 0)::BIGINT AS n_child FROM p FULL JOIN c ON p.bucket = c.bucket""",
    "audit_array_labels": "SELECT count(DISTINCT conv_id) AS n_rows, count(*) AS n_elements, count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS violations FROM conversations",
    "audit_temporal_child_vs_parent": "SELECT 'lineitem.l_shipdate before orders.o_orderdate' AS subject, count(*) FILTER (WHERE l_shipdate < o_orderdate) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "audit_null_counts": _each([f"SELECT '{t}.{c}' AS column_name, count(*) - count({c}) AS n_null FROM {t}" for t, cs in (("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")), ("events", ("event_id", "ts", "user_id", "event_type", "value", "props"))) for c in cs]),
    "audit_distinct_labels": "SELECT DISTINCT o_orderpriority FROM orders",
    "audit_label_agreement": _each([_count("customer", "c_name", "c_name <> 'Customer#' || c_custkey"), _count("supplier", "s_name", "s_name <> 'Supplier#' || s_suppkey")]),
    "fanout_per_parent": "SELECT o_custkey AS parent, count(*) AS n_children FROM orders GROUP BY o_custkey",
    "fanout_half_cover": "WITH f AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT n, sum(n) OVER (ORDER BY n DESC, o_custkey ROWS UNBOUNDED PRECEDING) - n AS ahead, sum(n) OVER () AS total FROM f) SELECT count(*) AS n_parents, count(*) FILTER (WHERE 2 * ahead < total) AS n_half FROM r",
    "label_distribution": _each(["SELECT 'orders.o_orderstatus' AS subject, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 2", "SELECT 'events.event_type' AS subject, event_type AS label, count(*) AS n FROM events GROUP BY 2"]),
}
