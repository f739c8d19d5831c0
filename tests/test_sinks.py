import sqlite3

import pytest
from pyspark.sql import functions as F

from weftline.functions import literals
from weftline.operators.engine import Config, generate
from weftline.plans.q_model import SHOP, shop
from weftline.sources import sinks
from weftline.sources.model import Column, ForeignKey, Schema, Table

COLUMNS = (Column("i", "integer"), Column("x", "decimal"), Column("b", "boolean"), Column("t"), Column("j", "json"), Column("d", "date"), Column("at", "timestamp"), Column("raw", "bytea"), Column("arr", "array", element=Column("e")), Column("rec", "composite", fields=(Column("a", "integer"), Column("c"))), Column("gap", "interval"), Column("win", "range", element=Column("w", "integer")))


def one(spark):
    return spark.sql("""SELECT 5 AS i, 2.50D AS x, true AS b, concat('it''s', chr(9), chr(92), chr(10)) AS t, '{"k":"v''s"}' AS j, date'2024-05-06' AS d, timestamp_ntz'2024-05-06 07:08:09.012' AS at,
        X'00FF' AS raw, array('a"b', null, 'c') AS arr, named_struct('a', 1, 'c', 'x,y') AS rec, make_dt_interval(3, 4, 5, 6) AS gap, named_struct('lower', 1, 'upper', 9) AS win""")


WANT = {
    "postgres": "(5, 2.5, TRUE, 'it''s\t\\\n', '{\"k\":\"v''s\"}'::jsonb, '2024-05-06', '2024-05-06T07:08:09.012Z', '\\x00ff', '{\"a\\\"b\",NULL,\"c\"}', '(\"1\",\"x,y\")', '3 days 04:05:06', '[1,9)')",
    "mysql": "(5, 2.5, 1, 'it''s\t\\\\\n', '{\"k\":\"v''s\"}', '2024-05-06', '2024-05-06 07:08:09', X'00ff', '[\"a\\\\\"b\",null,\"c\"]', '{\"a\":1,\"c\":\"x,y\"}', '3 days 04:05:06', '{\"lower\":1,\"upper\":9}')",
    "sqlite": "(5, 2.5, 1, 'it''s\t\\\n', '{\"k\":\"v''s\"}', '2024-05-06', '2024-05-06T07:08:09.012Z', X'00ff', '[\"a\\\"b\",null,\"c\"]', '{\"a\":1,\"c\":\"x,y\"}', '3 days 04:05:06', '{\"lower\":1,\"upper\":9}')",
}


@pytest.mark.parametrize("dialect", WANT)
def test_literals(spark, dialect):
    assert one(spark).select(literals.row(COLUMNS, dialect)).first()[0] == WANT[dialect]
    nulls = one(spark).select(*(F.when(F.lit(False), F.col(c.name)).alias(c.name) for c in COLUMNS))
    assert nulls.select(literals.row(COLUMNS, dialect)).first()[0] == "(" + ", ".join(["NULL"] * len(COLUMNS)) + ")"


def test_numbers(spark):
    df = spark.sql("SELECT stack(6, 1.0D, 12345678901.5D, 0.1D, -3.25D, 0D, 1.0E9D) AS x")
    assert [r[0] for r in df.select(literals.number(F.col("x"))).collect()] == ["1", "12345678901.5", "0.1", "-3.25", "0", "1000000000"]


def test_copy_lines(spark):
    line = one(spark).select(literals.copy_line(COLUMNS)).first()[0]
    assert line.split("\t")[:4] == ["5", "2.5", "t", "it's\\t\\\\\\n"] and line.split("\t")[7] == "\\\\x00ff"
    assert spark.sql("SELECT CAST(null AS int) AS i").select(literals.copy_line(COLUMNS[:1])).first()[0] == "\\N"


def test_scripts_load_into_sqlite(spark, tmp_path):
    s = shop()
    made = generate(spark, s, Config(rows={"users": 12, "products": 5, "orders": 20, "order_items": 20, "categories": 4}, seed=1))
    script = "\n".join(sinks.script(s, made, "sqlite"))
    db = sqlite3.connect(":memory:")
    db.executescript(SHOP + script)
    assert db.execute("SELECT count(*) FROM orders").fetchone() == (20,) and db.execute("PRAGMA foreign_key_check").fetchall() == []
    file = str(tmp_path / "x.db")
    with sqlite3.connect(file) as other:
        other.executescript(SHOP)
    for _ in range(2):
        sink = sinks.Sqlite(file, truncate=True)
        assert sinks.into(s, made, sink)["main.order_items"] == 20
        sink.close()
    with sqlite3.connect(file) as other:
        for t in ("users", "orders", "order_items"):
            assert other.execute(f"SELECT * FROM {t} ORDER BY id").fetchall() == db.execute(f"SELECT * FROM {t} ORDER BY id").fetchall()
    sink = sinks.Sqlite(file, truncate=True)
    sink.write(s.tables["main.users"], made["main.users"].limit(1))
    sink.close(failed=True)
    with sqlite3.connect(file) as other:
        assert other.execute("SELECT count(*) FROM users").fetchone() == (12,)


def test_statements_are_batched(spark):
    t = Table("t", (Column("n", "integer"),))
    rows = spark.range(0, 25, 1, 2).select(F.col("id").cast("int").alias("n"))
    sql = [r.sql for r in sinks.statements(t, rows, "mysql", batch=10).collect()]
    assert len(sql) == 4 and all(x.startswith("INSERT INTO `t` (`n`) VALUES\n  (") and x.endswith(";") for x in sql)
    db = sqlite3.connect(":memory:")
    db.executescript("CREATE TABLE t (n int);" + "".join(sql))
    assert db.execute("SELECT count(*), sum(n) FROM t").fetchone() == (25, 300)


def test_postgres_script_resets_sequences(spark):
    s = Schema()
    s.add(Table("t", (Column("id", "integer", False, identity=True), Column("v")), "public", ("id",)))
    lines = list(sinks.script(s, {"public.t": spark.createDataFrame([(2, "b"), (1, None)], "id int, v string")}))
    assert lines == ["BEGIN;", "", "-- public.t: 2 rows", 'INSERT INTO "public"."t" ("id", "v") OVERRIDING SYSTEM VALUE VALUES', "  (1, NULL),", "  (2, 'b');", "", "", "-- reset sequences", "SELECT setval(pg_get_serial_sequence('public.t', 'id'), (SELECT COALESCE(MAX(\"id\"), 1) FROM \"public\".\"t\"), true);", "COMMIT;"]


def test_parquet_publishes_at_the_end(spark, tmp_path):
    t = Table("t", (Column("n", "integer"),))
    sink = sinks.Parquet(str(tmp_path / "out"))
    back = sink.keep(t, spark.range(5).select(F.col("id").alias("n")))
    assert back.count() == 5 and not (tmp_path / "out" / "t.parquet").exists()
    sink.publish()
    assert spark.read.parquet(str(tmp_path / "out" / "t.parquet")).count() == 5 and [p.name for p in (tmp_path / "out").iterdir()] == ["t.parquet"]


def test_jdbc_against_an_embedded_database(spark, tmp_path):
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    people = Table("people", (Column("id", "integer", False), Column("name"), Column("tags", "array", element=Column("e"))), primary=("id",), schema="app")
    notes = Table("notes", (Column("id", "integer", False), Column("person", "integer")), primary=("id",), foreign=(ForeignKey(("person",), "app.people", ("id",)),), schema="app")
    schema = Schema({t.key: t for t in (people, notes)})
    sink = sinks.Jdbc(url, "derby", truncate=True)
    sink.execute(spark, ['CREATE TABLE "people" ("id" INT PRIMARY KEY, "name" VARCHAR(40), "tags" VARCHAR(200))', 'CREATE TABLE "notes" ("id" INT PRIMARY KEY, "person" INT REFERENCES "people" ("id"))'])
    frames = {"app.people": spark.createDataFrame([(1, "Ada", ["x", "y"]), (2, "Eve", [])], "id int, name string, tags array<string>"), "app.notes": spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id int, person int")}
    for _ in range(2):  # the second load empties what the first wrote, children first
        assert sinks.into(schema, frames, sink) == {"app.people": 2, "app.notes": 3}
    read = lambda t: sorted(tuple(r) for r in spark.read.format("jdbc").option("url", url).option("dbtable", f'"{t}"').load().collect())
    assert read("people") == [(1, "Ada", '["x","y"]'), (2, "Eve", "[]")] and read("notes") == [(1, 2), (2, 1), (3, 1)]
    with pytest.raises(Exception, match="DELETE"):
        sink.execute(spark, ['INSERT INTO "notes" VALUES (9, 1)', 'DELETE FROM "people"'])
    assert len(read("notes")) == 3  # rolled back


def test_load_script_is_one_transaction(spark):
    t = Table("t", (Column("id", "integer", False, identity=True), Column("v")), primary=("id",), schema="public")
    u = Table("u", (Column("t_id", "integer"),), foreign=(ForeignKey(("t_id",), "public.t", ("id",)),), schema="public")
    frames = {"public.t": spark.createDataFrame([(1, "a\tb"), (2, None)], "id int, v string").coalesce(1), "public.u": spark.createDataFrame([(1,)], "t_id int")}
    assert list(sinks.load_script(Schema({x.key: x for x in (t, u)}), frames, truncate=True)) == [
        "\\set ON_ERROR_STOP on", "BEGIN;", 'TRUNCATE "public"."t", "public"."u" RESTART IDENTITY CASCADE;',
        'COPY "public"."t" ("id", "v") FROM STDIN;', "1\ta\\tb", "2\t\\N", "\\.",
        'COPY "public"."u" ("t_id") FROM STDIN;', "1", "\\.",
        "SELECT setval(pg_get_serial_sequence('public.t', 'id'), (SELECT COALESCE(MAX(\"id\"), 1) FROM \"public\".\"t\"), true);", "COMMIT;",
    ]
