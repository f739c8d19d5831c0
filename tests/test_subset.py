from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from weftline.operators.anonymize import anonymize, plan
from weftline.operators.closure import closure
from weftline.operators.engine import Config
from weftline.sources.ddl import load
from weftline.sources.model import Table

SHOP = load("""
CREATE TABLE users (id int PRIMARY KEY, email text NOT NULL UNIQUE, first_name text, country text);
CREATE TABLE products (id int PRIMARY KEY, name text);
CREATE TABLE orders (id int PRIMARY KEY, user_id int REFERENCES users, note text);
CREATE TABLE items (id int PRIMARY KEY, order_id int REFERENCES orders, product_id int REFERENCES products);
""")


def frames(spark):
    return {
        "public.users": spark.createDataFrame([(1, "a@x", "Ann", "NO"), (2, "b@x", "Bob", "SE"), (3, "c@x", None, "NO")], "id int, email string, first_name string, country string"),
        "public.products": spark.createDataFrame([(10, "p"), (11, "q"), (12, "r")], "id int, name string"),
        "public.orders": spark.createDataFrame([(100, 1, "n"), (101, 2, None), (102, None, "n")], "id int, user_id int, note string"),
        "public.items": spark.createDataFrame([(1, 100, 10), (2, 100, 11), (3, 102, 12)], "id int, order_id int, product_id int"),
    }


def ids(df):
    return sorted(r.id for r in df.collect())


def test_closure(spark):
    got = closure(SHOP, frames(spark), {"items": 2})
    assert {k.split(".")[1]: ids(v) for k, v in got.items()} == {"items": [1, 2], "orders": [100], "products": [10, 11], "users": [1]}
    got = closure(SHOP, frames(spark), {"orders": 3, "public.products": 1})
    assert {k.split(".")[1]: ids(v) for k, v in got.items()} == {"orders": [100, 101, 102], "products": [10], "users": [1, 2]}
    with pytest.raises(KeyError):
        closure(SHOP, frames(spark), {"nowhere": 1})


def test_closure_of_trees_and_cycles(spark):
    tree = load("CREATE TABLE t (id int PRIMARY KEY, up int REFERENCES t);")
    df = spark.createDataFrame([(1, 4), (4, 9), (9, 20), (20, None), (5, 6), (6, 5)], "id int, up int")
    assert ids(closure(tree, {"public.t": df}, {"t": 1})["public.t"]) == [1, 4, 9, 20]
    loop = load("CREATE TABLE a (id int PRIMARY KEY, b int); CREATE TABLE b (id int PRIMARY KEY, a int REFERENCES a); ALTER TABLE a ADD FOREIGN KEY (b) REFERENCES b (id);")
    got = closure(loop, {"public.a": spark.createDataFrame([(1, 2), (3, 4), (8, None)], "id int, b int"), "public.b": spark.createDataFrame([(2, 3), (4, 1), (6, 8)], "id int, a int")}, {"a": 1})
    assert ids(got["public.a"]) == [1, 3] and ids(got["public.b"]) == [2, 4]


def test_composite_keys_with_nulls(spark):
    s = load("CREATE TABLE p (a int, b int, PRIMARY KEY (a, b)); CREATE TABLE c (id int PRIMARY KEY, x int, y int, FOREIGN KEY (x, y) REFERENCES p (a, b));")
    got = closure(s, {"public.p": spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a int, b int"), "public.c": spark.createDataFrame([(1, 1, 2), (2, 1, None), (3, None, None)], "id int, x int, y int")}, {"c": 3})
    assert [tuple(r) for r in got["public.p"].collect()] == [(1, 2)]


def test_rows_without_keys_keep_one_of_equals(spark):
    s = load("CREATE TABLE t (a int, b int);")
    assert closure(s, {"public.t": spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "a int, b int")}, {"t": 3})["public.t"].count() == 2


def test_anonymize_leaves_keys_and_moves_the_rest(spark):
    got = anonymize(SHOP, frames(spark), Config(seed=1, preserve=("users.country",)))
    users = {r.id: r for r in got["public.users"].collect()}
    assert set(users) == {1, 2, 3} and users[3].first_name is None and users[1].first_name is not None
    assert {r.country for r in users.values()} == {"NO", "SE"}
    emails = {r.email for r in users.values()}
    assert len(emails) == 3 and not emails & {"a@x", "b@x", "c@x"}
    notes = {r.id: r.note for r in got["public.orders"].collect()}
    assert notes[101] is None and notes[100] == notes[102] not in (None, "n")
    assert {r.user_id for r in got["public.orders"].collect()} == {1, 2, None}


def test_forced_groups_move_together(spark):
    s = load("CREATE TABLE accounts (email text PRIMARY KEY, plan text); CREATE TABLE sessions (id int PRIMARY KEY, account_email text REFERENCES accounts, token text);")
    given = {"public.accounts": spark.createDataFrame([("a@x.no", "free"), ("b@x.no", "pro")], "email string, plan string"), "public.sessions": spark.createDataFrame([(1, "a@x.no", "t"), (2, "b@x.no", "u"), (3, "a@x.no", "v")], "id int, account_email string, token string")}
    config = Config(seed=1, anonymize=("sessions.account_email",), preserve=("accounts.email", "plan"))
    assert "preserved" in plan(s, config)[1][0]
    got = anonymize(s, given, config)
    accounts = {r.plan: r.email for r in got["public.accounts"].collect()}
    sessions = {r.id: r.account_email for r in got["public.sessions"].collect()}
    assert set(accounts) == {"free", "pro"} and not set(accounts.values()) & {"a@x.no", "b@x.no"}
    assert sessions == {1: accounts["free"], 2: accounts["pro"], 3: accounts["free"]}
    same = anonymize(s, {k: v.repartition(5) for k, v in given.items()}, config)
    assert {r.id: r.account_email for r in same["public.sessions"].collect()} == sessions


@pytest.mark.parametrize("kind", ["integer", "uuid", "bytea", "decimal", "date", "timestamp", "text"])
def test_unique_columns_stay_unique(spark, kind):
    t = load("CREATE TABLE t (id int PRIMARY KEY, v text UNIQUE);").tables["public.t"]
    column = replace(t.columns[1], kind=kind, length=9 if kind == "text" else None)
    s = load("")
    s.add(Table("t", (t.columns[0], column), "public", ("id",), (("v",),)))
    made = {"integer": "id * 7", "uuid": "concat('u', id)", "bytea": "encode(cast(id as string), 'utf-8')", "decimal": "id / 4D", "date": "date_add(date'2024-01-01', cast(id as int))", "timestamp": "cast(date_add(date'2024-01-01', cast(id as int)) as timestamp_ntz)", "text": "concat('t', id)"}[kind]
    df = spark.range(300).select(F.col("id").cast("int"), F.when(F.col("id") > 0, F.expr(made)).cast(column.spark_type()).alias("v"))
    got = anonymize(s, {"public.t": df}, Config(seed=2))["public.t"]
    assert got.select("v").distinct().count() == 300 and got.where("v is null").count() == 1
    assert got.join(df.select(F.col("v").alias("o")), F.col("v") == F.col("o")).count() == 0
