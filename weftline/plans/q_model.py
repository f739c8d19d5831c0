"""Queries over whole-model operators: generation, anonymization, literals, plans, DDL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import literals
from weftline.functions.draw import sql_below
from weftline.functions.spread import Spread
from weftline.functions.vocabulary import STATES
from weftline.operators import audit
from weftline.operators.anonymize import anonymize
from weftline.operators.closure import closure
from weftline.operators.engine import Config, generate
from weftline.plans import preview
from weftline.sources import sinks
from weftline.sources.ddl import load
from weftline.sources.model import Column, ForeignKey, Schema, Table, stored

# The tables of the published benchmark, so that figures can be compared like for like.
#: The model of an online shop, in DDL; generated by the flagship query and the bench.
SHOP = """
CREATE TABLE categories (id INTEGER PRIMARY KEY, name TEXT NOT NULL, slug TEXT NOT NULL UNIQUE, parent_id INTEGER REFERENCES categories(id));
CREATE TABLE users (id INTEGER PRIMARY KEY, email TEXT NOT NULL UNIQUE, first_name TEXT NOT NULL, last_name TEXT NOT NULL, phone TEXT, country TEXT, created_at TIMESTAMP NOT NULL);
CREATE TABLE products (id INTEGER PRIMARY KEY, name TEXT NOT NULL, price REAL NOT NULL CHECK (price > 0), category_id INTEGER NOT NULL REFERENCES categories(id), in_stock BOOLEAN NOT NULL);
CREATE TABLE orders (id INTEGER PRIMARY KEY, user_id INTEGER NOT NULL REFERENCES users(id), status TEXT NOT NULL CHECK (status IN ('pending', 'paid', 'shipped', 'delivered', 'cancelled')), total REAL NOT NULL, created_at TIMESTAMP NOT NULL);
CREATE TABLE order_items (id INTEGER PRIMARY KEY, order_id INTEGER NOT NULL REFERENCES orders(id), product_id INTEGER NOT NULL REFERENCES products(id), quantity INTEGER NOT NULL CHECK (quantity > 0));
"""
SHOP_ROWS = {"users": 400, "products": 80, "orders": 2000, "order_items": 2000, "categories": 20}


def shop() -> Schema:
    return load(SHOP, "sqlite")


def gen_shop_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, orphans and key clashes of each generated table."""
    schema = shop()
    made = generate(spark, schema, Config(rows=SHOP_ROWS, seed=11))
    parts = []
    for key, t in schema.tables.items():
        rows = made[key]
        out = rows.agg(F.count(F.lit(1)).alias("n_rows"), *((F.count(F.lit(1)) - F.count_distinct(*s)).alias(f"d{k}") for k, s in enumerate(t.key_sets())))
        lost = [audit.orphans(rows, f, made[f.parent]).agg(F.count(F.lit(1)).alias(f"o{k}")) for k, f in enumerate(t.foreign)]
        for x in lost:
            out = out.join(F.broadcast(x))
        clashes = sum((F.col(f"d{k}") for k in range(len(t.key_sets()))), F.lit(0).cast("long"))
        orphans = sum((F.col(f"o{k}") for k in range(len(lost))), F.lit(0).cast("long"))
        parts.append(out.select(F.lit(t.name).alias("table_name"), "n_rows", orphans.alias("orphans"), clashes.alias("clashes")))
    return audit.together(parts)


def _single(*columns: Column, uniques: tuple = (), checks: tuple = ()) -> Schema:
    s = Schema()
    s.add(Table("t", (Column("id", "integer", False, identity=True), *columns), primary=("id",), uniques=uniques, checks=checks))
    return s


def gen_unique_rounds(spark: SparkSession, sf: str) -> DataFrame:
    s = _single(Column("code", "integer", False), uniques=(("code",),), checks=("code BETWEEN 1 AND 900",))
    rows = generate(spark, s, Config(rows={"t": 500}, seed=5))["main.t"]
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("code").alias("n_codes"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def gen_unique_exhausted(spark: SparkSession, sf: str) -> DataFrame:
    s = _single(Column("code", nullable=False), uniques=(("code",),), checks=("code IN ('a', 'b', 'c')",))
    return generate(spark, s, Config(rows={"t": 10}, seed=5))["main.t"].select("code")


def _people() -> Schema:
    s = Schema()
    s.add(Table("users", (Column("id", "integer", False, identity=True), Column("created_at", "timestamp", False), Column("updated_at", "timestamp"), Column("expires_at", "timestamp")), primary=("id",)))
    s.add(Table("orders", (Column("id", "integer", False, identity=True), Column("user_id", "integer", False), Column("created_at", "timestamp", False)), primary=("id",), foreign=(ForeignKey(("user_id",), "main.users", ("id",)),)))
    return s


def gen_temporal(spark: SparkSession, sf: str) -> DataFrame:
    made = generate(spark, _people(), Config(rows={"users": 50, "orders": 500}, seed=3))
    users, orders = made["main.users"], made["main.orders"]
    both = orders.select("user_id", F.col("created_at").alias("ordered")).join(users.withColumnRenamed("id", "user_id"), "user_id")
    one = both.agg(F.count(F.lit(1)).alias("n_orders"), F.sum((F.col("ordered") < F.col("created_at")).cast("long")).alias("before_parent"))
    two = users.agg(F.count(F.lit(1)).alias("n_users"), F.coalesce(F.sum((F.col("updated_at") < F.col("created_at")).cast("long")), F.lit(0)).alias("updated_early"), F.coalesce(F.sum((F.col("expires_at") < F.col("created_at")).cast("long")), F.lit(0)).alias("expired_early"))
    return one.join(F.broadcast(two))


def gen_coherent_names(spark: SparkSession, sf: str) -> DataFrame:
    names = [Column(n, nullable=False) for n in ("first_name", "last_name", "full_name", "email", "username")]
    rows = generate(spark, _single(*names), Config(rows={"t": 200}, seed=4))["main.t"]
    first, last = F.lower("first_name"), F.lower("last_name")
    bad = {"full_wrong": F.col("full_name") != F.concat_ws(" ", "first_name", "last_name"), "email_wrong": ~F.startswith("email", F.concat(first, F.lit("."), last)), "username_wrong": ~F.startswith("username", F.concat(first, F.lit("_"), last))}
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *(F.sum(b.cast("long")).alias(k) for k, b in bad.items()))


def gen_coherent_places(spark: SparkSession, sf: str) -> DataFrame:
    rows = generate(spark, _single(*(Column(n, nullable=False) for n in ("city", "state", "zip", "country"))), Config(rows={"t": 200}, seed=4))["main.t"]
    known = spark.createDataFrame([(s, c, f"{z:03d}") for s, (z, cities) in STATES.items() for c in cities], "state string, city string, prefix string")
    bad = rows.join(F.broadcast(known), ["state", "city"], "left").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("prefix").isNull().cast("long")).alias("city_wrong"), F.sum((F.substring("zip", 1, 3) != F.col("prefix")).cast("long")).alias("zip_wrong"))
    return bad


NEW = ["alpha", "beta", "gamma", "delta", "omega"]


def _scrubbed(spark: SparkSession, sf: str, names: tuple[str, ...], **options) -> dict[str, DataFrame]:
    schema, frames = stored(spark, sf, names)
    return anonymize(schema, frames, Config(seed=9, rng="md5", **options))


CUSTOMER_KEPT = ("c_name", "c_nationkey", "c_acctbal")


def anon_local(spark: SparkSession, sf: str) -> DataFrame:
    """A label column mapped value by value; the others stay."""
    out = _scrubbed(spark, sf, ("customer",), columns={"c_mktsegment": {"values": NEW}}, preserve=CUSTOMER_KEPT)
    return out["main.customer"].select("c_custkey", "c_name", "c_mktsegment")


def anon_group(spark: SparkSession, sf: str) -> DataFrame:
    """A join key and everything that refers to it, moved together."""
    out = _scrubbed(spark, sf, ("customer", "orders"), anonymize=("customer.c_custkey",), preserve=(*CUSTOMER_KEPT, "c_mktsegment", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
    return out["main.orders"].select("o_orderkey", "o_custkey").join(out["main.customer"].select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")


def anon_unique(spark: SparkSession, sf: str) -> DataFrame:
    """A unique text stays unique and none of the old values is left."""
    schema, frames = stored(spark, sf, ("customer",))
    t = schema.tables["main.customer"]
    schema.add(replace(t, uniques=(("c_name",),)))
    out = anonymize(schema, frames, Config(seed=9))["main.customer"]
    old = frames["main.customer"].select(F.col("c_name").alias("old"))
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("c_name").alias("n_names")).join(F.broadcast(out.join(old, out["c_name"] == old["old"], "left_semi").agg(F.count(F.lit(1)).alias("leaked"))))


def anon_preserve(spark: SparkSession, sf: str) -> DataFrame:
    """Of two columns of labels one is preserved, the other is not."""
    out = _scrubbed(spark, sf, ("orders", "customer"), columns={"o_orderpriority": {"values": NEW}}, preserve=("orders.o_orderstatus", "o_totalprice", "o_orderdate", *CUSTOMER_KEPT, "c_mktsegment"))
    return out["main.orders"].select("o_orderkey", "o_orderstatus", "o_orderpriority")


def anon_null(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls before and after, and values that became null or stopped being null."""
    schema, frames = stored(spark, sf, ("customer",))
    some = frames["main.customer"].withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    out = anonymize(schema, {"main.customer": some}, Config(seed=9, columns={"c_mktsegment": {"values": NEW}}))["main.customer"]
    both = some.select("c_custkey", F.col("c_mktsegment").isNull().alias("was")).join(out.select("c_custkey", F.col("c_mktsegment").isNull().alias("now")), "c_custkey")
    return both.agg(F.sum(F.col("was").cast("long")).alias("n_null"), F.sum((F.col("was") != F.col("now")).cast("long")).alias("changed"))


def anon_leak_audit(spark: SparkSession, sf: str) -> DataFrame:
    out = _scrubbed(spark, sf, ("customer",), columns={"c_mktsegment": {"values": NEW}})["main.customer"]
    old = spark.read.parquet(f"{sf}/customer.parquet")
    # rows of which every seventh was put back as it was: the audit must find just those
    mixed = out.join(old.select("c_custkey", F.col("c_name").alias("was")), "c_custkey").withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, F.col("was")).otherwise(F.col("c_name")))
    found = {"c_name": audit.leaks(old, out, "c_name"), "c_mktsegment": audit.leaks(old, out, "c_mktsegment"), "c_name put back": audit.leaks(old, mixed, "c_name")}
    return audit.together([df.select(F.lit(c).alias("subject"), "violations") for c, df in found.items()])


def anon_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Fakes for each original: one."""
    out = _scrubbed(spark, sf, ("orders", "customer"), columns={"o_orderpriority": {"values": NEW}})["main.orders"]
    old = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_orderpriority").alias("original"))
    return out.join(old, "o_orderkey").groupBy("original").agg(F.count_distinct("o_orderpriority").alias("n_fakes"), F.count(F.lit(1)).alias("n_rows"))


def anon_inconsistent(spark: SparkSession, sf: str) -> DataFrame:
    """Originals with more than one fake: none, and the two that were tampered with."""
    out = _scrubbed(spark, sf, ("orders", "customer"), columns={"o_orderpriority": {"values": NEW}})["main.orders"]
    old = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_orderpriority").alias("original"))
    pairs = out.join(old, "o_orderkey").select("original", F.col("o_orderpriority").alias("fake"))
    spoilt = pairs.union(spark.createDataFrame([("1-URGENT", "?"), ("5-LOW", "?")], "original string, fake string"))
    return audit.together([audit.inconsistent(p, "original", "fake").select(F.lit(n).alias("subject"), "violations") for n, p in (("as made", pairs), ("spoilt", spoilt))])


def _emitted(dialect: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        parts = []
        for name, extra in (("nation", ()), ("events", ()), ("customer", ())):
            schema, frames = stored(spark, sf, (name,))
            t = schema.find(name)
            columns = [replace(c, kind="json") if c.name == "props" else c for c in t.columns]
            parts.append(frames[t.key].select(F.lit(name).alias("table_name"), F.col(t.primary[0]).cast("long").alias("key"), literals.row(columns, dialect).alias("sql")))
        return audit.together(parts)

    return run


def emit_copy_lines(spark: SparkSession, sf: str) -> DataFrame:
    schema, frames = stored(spark, sf, ("documents",))
    t = schema.find("documents")
    return frames[t.key].select("doc_id", literals.copy_line(t.columns).alias("line"))


def emit_insert_heads(spark: SparkSession, sf: str) -> DataFrame:
    s = shop()
    rows = [(d, t.name, sinks.head(t, list(t.columns), d), sinks.cleared(t, d)) for d in ("postgres", "mysql", "sqlite") for t in s.tables.values() if t.name == "order_items"]
    return spark.createDataFrame(rows, "dialect string, table_name string, head string, clear string")


def _plan(entries: list[preview.Entry], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, e.key, e.rows, e.cyclic, e.skipped) for i, e in enumerate(entries, 1)], "place int, table_key string, n_rows long, cyclic boolean, skipped boolean")


def plan_generate(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(preview.of_generate(spark, shop(), Config(rows=SHOP_ROWS, skip=("order_items",)), samples=False), spark)


def plan_append(spark: SparkSession, sf: str) -> DataFrame:
    schema, frames = stored(spark, sf, ("region", "nation", "customer", "orders"))
    return _plan(preview.of_append(spark, schema, frames, Config(rows={"orders": 25, "customer": 0}), samples=False), spark)


def plan_subset(spark: SparkSession, sf: str) -> DataFrame:
    schema, frames = stored(spark, sf, ("region", "nation", "customer", "orders"))
    return _plan(preview.of_subset(schema, closure(schema, frames, {"orders": 100})), spark)


def ddl_to_model(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(t.name, c.name, c.kind, c.nullable, c.identity, c.name in t.primary, f.parent if (f := t.foreign_of(c.name)) else None) for t in shop().tables.values() for c in t.columns]
    return spark.createDataFrame(rows, "table_name string, column_name string, kind string, nullable boolean, is_identity boolean, is_primary boolean, parent string")


QUERIES = {f.__name__: f for f in (gen_shop_graph, gen_unique_rounds, gen_unique_exhausted, gen_temporal, gen_coherent_names, gen_coherent_places, anon_local, anon_group, anon_unique, anon_preserve, anon_null, anon_leak_audit, anon_consistency, anon_inconsistent, emit_copy_lines, emit_insert_heads, plan_generate, plan_append, plan_subset, ddl_to_model)} | {"emit_pg_literals": _emitted("postgres"), "emit_mysql_literals": _emitted("mysql"), "emit_sqlite_literals": _emitted("sqlite")}


def _hash(value: str) -> str:
    return f"('0x' || substr(md5({value}::VARCHAR), 1, 15))::BIGINT"


def _pick(value: str, column: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in NEW) + f"][1 + {sql_below(9, f'anon.main.{column}', _hash(value), len(NEW))}]"


def _num(x: str) -> str:
    return f"regexp_replace({x}::DOUBLE::VARCHAR, '\\.0*$', '')"


def _emit_sql(dialect: str) -> str:
    q = lambda x: f"'''' || replace({x}, '''', '''''') || ''''"
    ts = "strftime(ts, '%Y-%m-%d %H:%M:%S')" if dialect == "mysql" else "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
    props = "replace(props, chr(92), chr(92) || chr(92))" if dialect == "mysql" else "props"
    tail = " || '::jsonb'" if dialect == "postgres" else ""
    return f"""SELECT 'nation' AS table_name, n_nationkey::BIGINT AS key, '(' || n_nationkey || ', ' || {q('n_name')} || ', ' || n_regionkey || ')' AS sql FROM nation
UNION ALL SELECT 'events', event_id, '(' || event_id || ', ' || {q(ts)} || ', ' || user_id || ', ' || {q('event_type')} || ', ' || {_num('value')} || ', ' || {q(props)}{tail} || ')' FROM events
UNION ALL SELECT 'customer', c_custkey, '(' || c_custkey || ', ' || {q('c_name')} || ', ' || c_nationkey || ', ' || {_num('c_acctbal')} || ', ' || {q('c_mktsegment')} || ')' FROM customer"""


def _plan_sql(rows: list[tuple[str, str]], cyclic: tuple[str, ...] = (), skipped: tuple[str, ...] = ()) -> str:
    return "\nUNION ALL\n".join(f"SELECT {i} AS place, '{k}' AS table_key, ({n})::BIGINT AS n_rows, {'true' if k in cyclic else 'false'} AS cyclic, {'true' if k in skipped else 'false'} AS skipped" for i, (k, n) in enumerate(rows, 1))


_FIELDS = [
    ("categories", "id integer 0 1 1", "name text 0 0 0", "slug text 0 0 0", "parent_id integer 1 0 0 main.categories"),
    ("users", "id integer 0 1 1", "email text 0 0 0", "first_name text 0 0 0", "last_name text 0 0 0", "phone text 1 0 0", "country text 1 0 0", "created_at timestamp 0 0 0"),
    ("products", "id integer 0 1 1", "name text 0 0 0", "price decimal 0 0 0", "category_id integer 0 0 0 main.categories", "in_stock boolean 0 0 0"),
    ("orders", "id integer 0 1 1", "user_id integer 0 0 0 main.users", "status text 0 0 0", "total decimal 0 0 0", "created_at timestamp 0 0 0"),
    ("order_items", "id integer 0 1 1", "order_id integer 0 0 0 main.orders", "product_id integer 0 0 0 main.products", "quantity integer 0 0 0"),
]


def _ddl_sql() -> str:
    rows = []
    for t, *columns in _FIELDS:
        for c in columns:
            name, kind, *flags = c.split()
            on = ["true" if f == "1" else "false" for f in flags[:3]]
            rows.append(f"('{t}', '{name}', '{kind}', {', '.join(on)}, " + (f"'{flags[3]}'" if len(flags) > 3 else "NULL") + ")")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(table_name, column_name, kind, nullable, is_identity, is_primary, parent)"


ORACLES = {
    "gen_shop_graph": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {n}::BIGINT, 0::BIGINT, 0::BIGINT)" for k, n in SHOP_ROWS.items()) + ") t(table_name, n_rows, orphans, clashes)",
    "gen_unique_rounds": "SELECT 500::BIGINT AS n_rows, 500::BIGINT AS n_codes, 1::BIGINT AS first_id, 500::BIGINT AS last_id",
    "gen_unique_exhausted": "SELECT * FROM (VALUES ('a'), ('b'), ('c')) t(code)",
    "gen_temporal": "SELECT 500::BIGINT AS n_orders, 0::BIGINT AS before_parent, 50::BIGINT AS n_users, 0::BIGINT AS updated_early, 0::BIGINT AS expired_early",
    "gen_coherent_names": "SELECT 200::BIGINT AS n_rows, 0::BIGINT AS full_wrong, 0::BIGINT AS email_wrong, 0::BIGINT AS username_wrong",
    "gen_coherent_places": "SELECT 200::BIGINT AS n_rows, 0::BIGINT AS city_wrong, 0::BIGINT AS zip_wrong",
    "anon_local": f"SELECT c_custkey, c_name, {_pick('c_mktsegment', 'customer.c_mktsegment')} AS c_mktsegment FROM customer",
    "anon_group": """WITH o AS (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL),
m AS (SELECT k, (SELECT max(k) FROM o) + row_number() OVER (ORDER BY md5(k::VARCHAR), k) AS f FROM o)
SELECT o_orderkey, f AS o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN m ON k = o_custkey""",
    "anon_unique": "SELECT count(*) AS n_rows, count(*) AS n_names, 0::BIGINT AS leaked FROM customer",
    "anon_preserve": f"SELECT o_orderkey, o_orderstatus, {_pick('o_orderpriority', 'orders.o_orderpriority')} AS o_orderpriority FROM orders",
    "anon_null": "SELECT count(*) FILTER (WHERE c_custkey % 5 = 0) AS n_null, 0::BIGINT AS changed FROM customer",
    "anon_leak_audit": "SELECT * FROM (VALUES ('c_name', 0::BIGINT), ('c_mktsegment', 0)) t(subject, violations) UNION ALL SELECT 'c_name put back', count(*) FROM customer WHERE c_custkey % 7 = 0",
    "anon_inconsistent": "SELECT 'as made' AS subject, 0::BIGINT AS violations UNION ALL SELECT 'spoilt', count(DISTINCT o_orderpriority) FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')",
    "anon_consistency": "SELECT o_orderpriority AS original, 1::BIGINT AS n_fakes, count(*) AS n_rows FROM orders GROUP BY 1",
    "emit_copy_lines": r"SELECT doc_id, concat_ws(chr(9), doc_id, " + ", ".join(f"coalesce(replace(replace(replace(replace({c}, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't'), chr(92) || 'N')" for c in ("text", "lang", "source")) + ", coalesce(n_chars::VARCHAR, chr(92) || 'N')) AS line FROM documents",
    "emit_insert_heads": """SELECT * FROM (VALUES
('postgres', 'order_items', 'INSERT INTO "main"."order_items" ("id", "order_id", "product_id", "quantity") OVERRIDING SYSTEM VALUE VALUES', 'TRUNCATE "main"."order_items" RESTART IDENTITY CASCADE;'),
('mysql', 'order_items', 'INSERT INTO `order_items` (`id`, `order_id`, `product_id`, `quantity`) VALUES', 'DELETE FROM `order_items`;'),
('sqlite', 'order_items', 'INSERT INTO "order_items" ("id", "order_id", "product_id", "quantity") VALUES', 'DELETE FROM "order_items";')) t(dialect, table_name, head, clear)""",
    "plan_generate": _plan_sql([("main.categories", "20"), ("main.users", "400"), ("main.products", "80"), ("main.orders", "2000"), ("main.order_items", "0")], ("main.categories",), ("main.order_items",)),
    "plan_append": _plan_sql([("main.orders", "25")]),
    "plan_subset": "WITH o AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c))\n" + _plan_sql([("main.region", "SELECT count(*) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)"), ("main.nation", "SELECT count(*) FROM n"), ("main.customer", "SELECT count(*) FROM c"), ("main.orders", "100")]),
    "ddl_to_model": _ddl_sql(),
    "emit_pg_literals": _emit_sql("postgres"),
    "emit_mysql_literals": _emit_sql("mysql"),
    "emit_sqlite_literals": _emit_sql("sqlite"),
}
