from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from weftline.functions.draw import Draw
from weftline.functions.spread import Spread
from weftline.operators import engine
from weftline.operators.append import append
from weftline.operators.engine import Config, generate
from weftline.operators.graph import cyclic_tables, key_groups, order, protected, representative
from weftline.operators.temporal import role, window
from weftline.plans.q_model import _people, shop
from weftline.sources.ddl import load
from weftline.sources.model import Column, ForeignKey, Schema, Table


def schema(*tables):
    s = Schema()
    for t in tables:
        s.add(t)
    return s


ID = Column("id", "integer", False, identity=True)


def test_same_rows_on_any_partitioning(spark):
    s = shop()
    config = Config(rows={"users": 60, "products": 12, "orders": 90, "order_items": 90, "categories": 6}, seed=2)
    found = []
    for n in ("1", "3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        made = generate(spark, s, config)
        found.append({k: sorted(map(tuple, df.collect()), key=str) for k, df in made.items()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2]
    other = generate(spark, s, replace(config, seed=3))
    assert sorted(map(tuple, other["main.users"].collect()), key=str) != found[0]["main.users"]


def test_keys_hold(spark):
    s = shop()
    made = generate(spark, s, Config(rows={"users": 80, "products": 30, "orders": 200, "order_items": 300, "categories": 15}, seed=8, rng="xxhash64"))
    for k, t in s.tables.items():
        rows = made[k]
        for keys in t.key_sets():
            assert rows.select(*keys).distinct().count() == rows.count()
        for f in t.foreign:
            parents = made[f.parent].select(F.col(f.parent_columns[0]).alias("p"))
            assert rows.where(F.col(f.columns[0]).isNotNull()).join(parents, F.col(f.columns[0]) == F.col("p"), "left_anti").count() == 0
        assert [r.id for r in rows.select("id").orderBy("id").collect()] == list(range(1, rows.count() + 1))
    cats = made["main.categories"].collect()
    assert all(r.parent_id is None or r.parent_id < r.id for r in cats) and any(r.parent_id for r in cats)
    assert made["main.products"].where("price <= 0").count() == 0
    assert {r.status for r in made["main.orders"].select("status").distinct().collect()} == {"pending", "paid", "shipped", "delivered", "cancelled"}
    late = made["main.orders"].alias("o").join(made["main.users"].alias("u"), F.col("o.user_id") == F.col("u.id")).where("o.created_at < u.created_at")
    assert late.count() == 0


def test_exhausted_domains_give_what_there_is(spark):
    s = schema(Table("a", (ID,), primary=("id",)), Table("b", (ID,), primary=("id",)), Table("ab", (Column("a_id", "integer", False), Column("b_id", "integer", False)), primary=("a_id", "b_id"), foreign=(ForeignKey(("a_id",), "main.a", ("id",)), ForeignKey(("b_id",), "main.b", ("id",)))))
    made = generate(spark, s, Config(rows={"a": 3, "b": 3, "ab": 50}, seed=1))["main.ab"]
    assert made.count() == made.distinct().count() == 9


def test_zipf_is_steeper_than_uniform(spark):
    s = shop()
    top = {}
    for name, spread in (("zipf", Spread("zipf")), ("uniform", Spread())):
        made = generate(spark, s, Config(rows={"users": 50, "orders": 2000, "products": 1, "order_items": 1, "categories": 1}, seed=4, distributions={"orders.user_id": spread}))
        top[name] = made["main.orders"].groupBy("user_id").count().agg(F.max("count")).first()[0]
    assert top["zipf"] > 2 * top["uniform"]


def test_temporal_order(spark):
    made = generate(spark, _people(), Config(rows={"users": 60, "orders": 300}, seed=6, since="2020-01-01", until="2020-06-01"))
    users = made["main.users"]
    assert users.where("created_at < '2020-01-01' or created_at > '2020-06-01' or updated_at < created_at or updated_at > '2020-06-01' or expires_at < created_at").count() == 0
    with pytest.raises(ValueError, match="after"):
        window("2024-01-02", "2024-01-01")
    assert role("deleted_at", "timestamp") == "future" and role("last_login", "date") == "activity" and role("created", "date") == "created" and role("created_at", "text") is None


def test_overrides_and_checks_are_left_alone(spark):
    t = Table("t", (ID, Column("first_name", nullable=False), Column("last_name", nullable=False), Column("full_name", nullable=False), Column("state", nullable=False), Column("city", nullable=False)), primary=("id",), checks=("state IN ('TX')",))
    rows = generate(spark, schema(t), Config(rows={"t": 40}, seed=1, columns={"first_name": {"value": "Zoe"}}))["main.t"].collect()
    assert all(r.first_name == "Zoe" and r.full_name == f"Zoe {r.last_name}" and r.state == "TX" and r.city in ("Dallas", "Austin", "Houston") for r in rows)


def test_nulls_only_where_they_may_be(spark):
    t = Table("t", (ID, Column("a"), Column("b", nullable=False), Column("c", length=60)), primary=("id",), uniques=(("c",),))
    rows = generate(spark, schema(t), Config(rows={"t": 800}, seed=1))["main.t"]
    n = rows.agg(*(F.sum(F.col(c).isNull().cast("int")) for c in ("a", "b", "c"))).first()
    assert 30 < n[0] < 110 and n[1] == n[2] == 0


def test_refusals(spark):
    geo = schema(Table("docs", (ID, Column("g", "unsupported", False), Column("h", "unsupported"), Column("k", "unsupported", False, default=True)), primary=("id",)))
    assert engine.refused(geo, Config()) == ["main.docs.g"]
    with pytest.raises(ValueError, match="main.docs.g"):
        generate(spark, geo, Config(rows={"docs": 1}))
    made = generate(spark, geo, Config(rows={"docs": 2}, columns={"docs.g": {"value": "x"}}))["main.docs"]
    assert made.columns == ["id", "g", "h"] and made.where("g = 'x' and h is null").count() == 2
    orphan = schema(Table("c", (ID, Column("p", "integer", False)), primary=("id",), foreign=(ForeignKey(("p",), "main.p", ("id",)),)), Table("p", (ID,), primary=("id",)))
    with pytest.raises(ValueError, match="no parent rows"):
        generate(spark, orphan, Config(rows={"c": 2}, skip=("p",)))


def test_cycles(spark):
    s = load("CREATE TABLE a (id serial PRIMARY KEY, b_id int); CREATE TABLE b (id serial PRIMARY KEY, a_id int NOT NULL REFERENCES a); CREATE TABLE c (id serial PRIMARY KEY, b_id int REFERENCES b); ALTER TABLE a ADD FOREIGN KEY (b_id) REFERENCES b (id);")
    assert cyclic_tables(s) == {"public.a", "public.b"} and order(s)[0] == ["public.a", "public.b", "public.c"]
    made = generate(spark, s, Config(rows={"a": 4, "b": 4, "c": 4}, seed=1))
    assert made["public.a"].where("b_id is not null").count() == 0 and made["public.b"].where("a_id is null").count() == 0


def test_natural_keys_and_composite_links(spark):
    s = schema(
        Table("p", (Column("code", nullable=False, length=40), Column("n", "integer", False), Column("up"), Column("up_n", "integer")), primary=("code", "n"), foreign=(ForeignKey(("up", "up_n"), "main.p", ("code", "n")),)),
        Table("q", (ID, Column("pc", nullable=False), Column("pn", "integer", False)), primary=("id",), foreign=(ForeignKey(("pc", "pn"), "main.p", ("code", "n")),)),
    )
    made = generate(spark, s, Config(rows={"p": 30, "q": 80}, seed=3))
    p, q = made["main.p"], made["main.q"]
    keys = p.select(F.col("code").alias("c"), F.col("n").alias("m"))
    assert q.join(keys, (q.pc == keys.c) & (q.pn == keys.m), "left_anti").count() == 0
    linked = p.where("up is not null")
    assert linked.count() > 3 and linked.join(keys, (linked.up == keys.c) & (linked.up_n == keys.m), "left_anti").count() == 0


def test_append(spark):
    s = load("CREATE TABLE users (id serial PRIMARY KEY, email text NOT NULL UNIQUE); CREATE TABLE orders (id serial PRIMARY KEY, user_id int NOT NULL REFERENCES users);")
    frames = {"public.users": spark.createDataFrame([(5, "a"), (6, "b"), (7, "c")], "id int, email string"), "public.orders": spark.createDataFrame([(100, 5), (200, 6)], "id int, user_id int")}
    made = append(spark, s, frames, Config(rows={"orders": 20, "users": 0}, seed=1))
    rows = made["public.orders"].collect()
    assert set(made) == {"public.orders"} and sorted(r.id for r in rows) == list(range(201, 221)) and {r.user_id for r in rows} <= {5, 6, 7}
    codes = load("CREATE TABLE t (id serial PRIMARY KEY, k int NOT NULL UNIQUE CHECK (k BETWEEN 1 AND 12));")
    have = {"public.t": spark.createDataFrame([(i, i) for i in range(1, 9)], "id int, k int")}
    new = append(spark, codes, have, Config(rows={"t": 4}, seed=1))["public.t"].collect()
    assert {r.k for r in new} <= {9, 10, 11, 12} and [r.id for r in sorted(new)] == list(range(9, 9 + len(new)))


def test_append_numbers_plain_keys_on(spark):
    """Keys that the database doesn't fill, in a table that has taken all that would be drawn; rules and types that leave no room above still draw."""
    s = load("CREATE TABLE t (id smallint PRIMARY KEY, n int); CREATE TABLE u (id int PRIMARY KEY CHECK (id BETWEEN 1 AND 12)); CREATE TABLE v (id smallint PRIMARY KEY); CREATE TABLE w (id int PRIMARY KEY);")
    frames = {"public.t": spark.range(30_001), "public.u": spark.range(1, 9), "public.v": spark.createDataFrame([(1,), (32766,)], "id long"), "public.w": spark.range(5)}
    frames = {k: df.select(F.col("id").cast("int")) for k, df in frames.items()}
    made = append(spark, s, frames, Config(rows={"t": 5, "u": 2, "v": 3, "w": 4}, columns={"w.id": {"values": [70, 71, 72, 73, 74, 75]}}, seed=1))
    ids = {k: sorted(r.id for r in df.collect()) for k, df in made.items()}
    assert ids["public.t"] == list(range(30_001, 30_006))
    assert len(ids["public.u"]) == 2 and set(ids["public.u"]) <= {9, 10, 11, 12}
    assert len(set(ids["public.v"])) == 3 and max(ids["public.v"]) <= 30_000 and 1 not in ids["public.v"]
    assert len(set(ids["public.w"])) == 4 and set(ids["public.w"]) <= set(range(70, 76))
    one = append(spark, s, frames, Config(rows={"v": 1}, seed=1))["public.v"].collect()
    assert [r.id for r in one] == [32_767]


def test_append_lends_all_parents(spark):
    """Parents beyond 100,000 get children too: those that the draws name, by rank of the key."""
    s = load("CREATE TABLE users (id bigint PRIMARY KEY, name text); CREATE TABLE orders (id serial PRIMARY KEY, user_id bigint NOT NULL REFERENCES users);")
    n = 130_000
    users = spark.range(n).select((7 + 3 * F.col("id")).alias("id"), F.lit("x").alias("name")).repartition(5, "id")
    frames = {"public.users": users, "public.orders": spark.createDataFrame([], "id int, user_id long")}
    made = append(spark, s, frames, Config(rows={"orders": 300}, seed=7, rng="md5"))["public.orders"]
    want = spark.range(300).select((F.col("id") + 1).alias("id"), (7 + 3 * Draw(7, "public.orders.fk0", F.col("id")).below(n)).alias("user_id"))
    rows = sorted(tuple(r) for r in made.select("id", "user_id").collect())
    assert rows == sorted(tuple(r) for r in want.collect()) and max(u for _, u in rows) > 7 + 3 * 100_000


def test_graph():
    s = shop()
    assert order(s)[1] == [["main.categories", "main.users"], ["main.products", "main.orders"], ["main.order_items"]]
    groups = key_groups(s)
    assert [("main.categories", "id"), ("main.categories", "parent_id"), ("main.products", "category_id")] in groups
    assert representative(s, groups[0]) == ("main.categories", "id") and ("main.orders", "user_id") in protected(s) and ("main.orders", "total") not in protected(s)
