import sqlite3

import pytest

from weftline.sources import catalog
from weftline.sources.ddl import load
from weftline.sources.model import ForeignKey, Partition, lookup

POSTGRES = """
-- a comment; with a semicolon
CREATE TYPE status AS ENUM ('new', 'it''s');
CREATE DOMAIN zip AS text CHECK (VALUE ~ '^[0-9]{5}$');
CREATE TYPE home AS (street text, no int);
CREATE FUNCTION f() RETURNS trigger AS $$ BEGIN; RETURN 1; END $$ LANGUAGE plpgsql;
CREATE TABLE IF NOT EXISTS shop.users (
  id BIGINT GENERATED BY DEFAULT AS IDENTITY (START WITH 5) PRIMARY KEY, email character varying(80) NOT NULL UNIQUE,
  at timestamp with time zone DEFAULT now() NOT NULL, tags text[] DEFAULT '{}', s status DEFAULT 'new', z zip, h home, during tstzrange,
  both text GENERATED ALWAYS AS (email || 'x') STORED, price numeric(10,2) CHECK (price > 0 AND price < 9), geo geometry);
CREATE TABLE shop.items (user_id bigint, line smallserial, qty int DEFAULT (1 + 2) CHECK (qty BETWEEN 1 AND 5), up int,
  CONSTRAINT pk PRIMARY KEY (user_id, line), FOREIGN KEY (user_id) REFERENCES shop.users ON DELETE CASCADE, UNIQUE (qty, up));
ALTER TABLE ONLY shop.items ADD CONSTRAINT u2 UNIQUE (up), ADD CHECK (up >= 0);
ALTER TABLE shop.items ADD COLUMN ignored int;
CREATE UNIQUE INDEX one ON shop.users USING btree (at DESC);
CREATE UNIQUE INDEX partial ON shop.users (z) WHERE z IS NOT NULL;
CREATE UNIQUE INDEX expr ON shop.users (lower(email));
CREATE INDEX plain ON shop.users (s);
CREATE TABLE shop.logs (at date NOT NULL, kind text) PARTITION BY RANGE (at);
CREATE TABLE shop.logs_a PARTITION OF shop.logs FOR VALUES FROM (MINVALUE) TO ('2024-01-01');
CREATE TABLE shop.logs_b PARTITION OF shop.logs FOR VALUES FROM ('2024-01-01') TO ('2025-01-01');
CREATE TABLE shop.kinds (kind text) PARTITION BY LIST (kind);
CREATE TABLE shop.kinds_a PARTITION OF shop.kinds FOR VALUES IN ('a', 'b');
CREATE TABLE shop.kinds_d PARTITION OF shop.kinds DEFAULT;
THIS IS NOT SQL (;
"""


def test_postgres_ddl():
    s = load(POSTGRES)
    users, items = s.tables["shop.users"], s.tables["shop.items"]
    kinds = {c.name: c.kind for c in users.columns}
    assert kinds == {"id": "integer", "email": "text", "at": "timestamp", "tags": "array", "s": "enum", "z": "text", "h": "composite", "during": "range", "both": "text", "price": "decimal", "geo": "unsupported"}
    assert users.column("id").identity and not users.column("id").nullable
    assert users.column("email").length == 80 and users.column("s").labels == ("new", "it's") and users.column("both").generated
    assert (users.column("price").precision, users.column("price").scale) == (10, 2)
    assert users.primary == ("id",) and users.uniques == (("email",), ("at",))
    assert items.primary == ("user_id", "line") and items.foreign == (ForeignKey(("user_id",), "shop.users", ("id",)),)
    assert items.uniques == (("qty", "up"), ("up",)) and items.checks == ("qty BETWEEN 1 AND 5", "up >= 0")
    assert items.column("line").default and items.column("line").bits == 16 and "ignored" not in items.names()
    assert s.tables["shop.logs"].partition == Partition("range", ("at",), ranges=((None, "2024-01-01"), ("2024-01-01", "2025-01-01")))
    assert s.tables["shop.kinds"].partition == Partition("list", ("kind",), True, values=("a", "b"))


MYSQL = """
USE `mine`;
CREATE TABLE `users` (`id` int unsigned NOT NULL AUTO_INCREMENT, `kind` enum('A','b') DEFAULT 'A' COMMENT 'x, y; z', flags set('p','q'), ok tinyint(1) NOT NULL, n tinyint(3),
  name varchar(20) CHARACTER SET utf8mb4 COLLATE utf8mb4_bin NOT NULL DEFAULT 'it\\'s', at timestamp DEFAULT CURRENT_TIMESTAMP ON UPDATE CURRENT_TIMESTAMP, doc json, `key` text,
  total decimal(8,2) GENERATED ALWAYS AS (n * 2) VIRTUAL, PRIMARY KEY (`id`), UNIQUE KEY `u` (`name`(10)), KEY `k` (`ok`), CONSTRAINT `c` CHECK (`n` in (1,2))) ENGINE=InnoDB; # done
CREATE TABLE items (id serial, user_id int, CONSTRAINT fk FOREIGN KEY (user_id) REFERENCES users (id));
CREATE UNIQUE INDEX one ON items (user_id);
"""


def test_mysql_ddl():
    s = load(MYSQL, "mysql")
    users, items = s.tables["mine.users"], s.tables["mine.items"]
    assert {c.name: c.kind for c in users.columns} == {"id": "integer", "kind": "enum", "flags": "enum", "ok": "boolean", "n": "integer", "name": "text", "at": "timestamp", "doc": "json", "key": "text", "total": "decimal"}
    assert users.column("kind").labels == ("A", "b") and users.column("flags").labels == ("p,q",) and users.column("total").generated
    assert users.column("id").identity and users.uniques == (("name",),) and users.checks == ("`n` in (1,2)",)
    assert items.column("id").identity and items.foreign == (ForeignKey(("user_id",), "mine.users", ("id",)),) and items.uniques == (("id",), ("user_id",))


SQLITE = """
CREATE TABLE cats (id INTEGER PRIMARY KEY, name TEXT NOT NULL COLLATE NOCASE, slug VARCHAR(30) UNIQUE, up INTEGER REFERENCES cats, status TEXT CHECK (status IN ('a', 'b')), price REAL CHECK (price > 0), raw, ok BOOLEAN, at DATETIME, u GUID, n NUMERIC);
CREATE TABLE links ([from id] INT, "to" INT, kind INT, PRIMARY KEY ("from id", "to"), FOREIGN KEY (kind) REFERENCES cats (id)) WITHOUT ROWID;
"""


def as_sqlite(tmp_path):
    file = tmp_path / "a.db"
    with sqlite3.connect(file) as db:
        db.executescript(SQLITE)
        db.execute("INSERT INTO cats VALUES (1, 'x', 's', NULL, 'a', 2.5, x'00ff', 1, '2024-05-06T07:08:09.010Z', 'u', 3)")
        db.execute("INSERT INTO cats (id, name) VALUES (2, 'y')")
    return str(file)


def test_sqlite_text_and_catalog_agree(tmp_path):
    text, live = load(SQLITE, "sqlite"), catalog.sqlite(as_sqlite(tmp_path))
    assert set(text.tables) == set(live.tables) == {"main.cats", "main.links"}
    for k, t in text.tables.items():
        other = live.tables[k]
        assert [(c.name, c.kind, c.nullable, c.identity, c.length) for c in t.columns] == [(c.name, c.kind, c.nullable, c.identity, c.length) for c in other.columns]
        assert (t.primary, t.uniques, t.foreign, t.checks) == (other.primary, other.uniques, other.foreign, other.checks)
    cats = text.tables["main.cats"]
    assert {c.name: c.kind for c in cats.columns} == {"id": "integer", "name": "text", "slug": "text", "up": "integer", "status": "text", "price": "decimal", "raw": "bytea", "ok": "boolean", "at": "timestamp", "u": "uuid", "n": "decimal"}
    assert cats.foreign == (ForeignKey(("up",), "main.cats", ("id",)),) and cats.column("id").identity


def test_sqlite_rows(spark, tmp_path):
    model, frames = catalog.connect(spark, as_sqlite(tmp_path))
    rows = frames["main.cats"].orderBy("id").collect()
    assert (rows[0].price, bytes(rows[0].raw), rows[0].ok, str(rows[0].at)) == (2.5, b"\x00\xff", True, "2024-05-06 07:08:09.010000")
    assert rows[1].price is None and frames["main.links"].count() == 0


def test_postgres_catalog_rows():
    col = lambda t, c, kind, **more: {"schema_name": "public", "table_name": t, "column_name": c, "type_name": kind, "base_name": None, "nullable": True, "has_default": False, "identity_kind": "", "generated_kind": "", "modifier": -1} | more
    columns = [col("a", "id", "int4", nullable=False, has_default=True), col("a", "m", "_mood"), col("a", "z", "zip", base_name="text"), col("a", "n", "numeric", modifier=(10 << 16 | 2) + 4), col("a", "t", "varchar", modifier=24), col("a", "h", "addr"), col("a", "w", "tsrange"), col("a", "g", "geometry"), col("b", "a_id", "int4"), col("b", "at", "date")]
    s = catalog.postgres_model(
        columns,
        [{"type_name": "mood", "label": x} for x in ("ok", "bad")],
        [{"type_name": "zip", "definition": "CHECK ((VALUE ~ '^[0-9]{5}$'::text))"}],
        [{"type_name": "addr", "column_name": "street", "field_type": "text"}],
        [{"type_name": "tsrange", "subtype": "timestamp"}],
        [{"schema_name": "public", "table_name": "a", "kind": "p", "definition": "", "column_list": "id"}, {"schema_name": "public", "table_name": "a", "kind": "c", "definition": "CHECK ((n > (0)::numeric))", "column_list": "n"}, {"schema_name": "public", "table_name": "b", "kind": "f", "definition": "", "column_list": "a_id", "parent_schema": "public", "parent_name": "a", "parent_list": "id"}],
        [{"schema_name": "public", "table_name": "b", "strategy": "r", "column_list": "at", "bound": "FOR VALUES FROM ('2024-01-01') TO (MAXVALUE)"}, {"schema_name": "public", "table_name": "b", "strategy": "r", "column_list": "at", "bound": "DEFAULT"}],
    )
    a, b = s.tables["public.a"], s.tables["public.b"]
    assert {c.name: c.kind for c in a.columns} == {"id": "integer", "m": "array", "z": "text", "n": "decimal", "t": "text", "h": "composite", "w": "range", "g": "unsupported"}
    assert a.column("m").element.labels == ("ok", "bad") and (a.column("n").precision, a.column("n").scale, a.column("t").length) == (10, 2, 20)
    assert a.primary == ("id",) and a.checks == ('("z" ~ \'^[0-9]{5}$\'::text)', "(n > (0)::numeric)")
    assert b.foreign == (ForeignKey(("a_id",), "public.a", ("id",)),) and b.partition == Partition("range", ("at",), True, (("2024-01-01", None),))


def test_mysql_catalog_rows():
    col = lambda c, kind, full, **more: {"schema_name": "d", "table_name": "t", "column_name": c, "type_name": kind, "full_type": full, "nullable": "YES", "default_text": None, "extra": ""} | more
    key = lambda name, kind, c, n, **more: {"schema_name": "d", "table_name": "t", "constraint_name": name, "kind": kind, "column_name": c, "place": n} | more
    s = catalog.mysql_model(
        [col("id", "int", "int unsigned", nullable="NO", extra="auto_increment"), col("ok", "tinyint", "tinyint(1)"), col("e", "enum", "enum('A','it''s')"), col("n", "decimal", "decimal(8,3)"), col("at", "timestamp", "timestamp", default_text="now", extra="DEFAULT_GENERATED"), col("g", "int", "int", extra="VIRTUAL GENERATED")],
        [key("PRIMARY", "PRIMARY KEY", "id", 1), key("u", "UNIQUE", "n", 2), key("u", "UNIQUE", "ok", 1), key("f", "FOREIGN KEY", "n", 1, parent_schema="d", parent_name="p", parent_column="id")],
        [{"schema_name": "d", "table_name": "t", "definition": "(`e` in (_utf8mb4\\'A\\',_utf8mb4\\'b\\'))"}],
    )
    t = s.tables["d.t"]
    assert t.column("id").identity and t.column("ok").kind == "boolean" and t.column("e").labels == ("A", "it's") and t.column("g").generated and not t.column("at").generated
    assert t.primary == ("id",) and t.uniques == (("ok", "n"),) and t.foreign == (ForeignKey(("n",), "d.p", ("id",)),)
    assert t.checks == ("(`e` in ('A','b'))",)


@pytest.mark.parametrize(("text", "dialect"), [("postgres://u:p@h/db", "postgres"), ("mysql://h/shop", "mysql"), ("mariadb://h/x", "mysql"), ("sqlite:a.db", "sqlite"), ("x.sqlite3", "sqlite"), (":memory:", "sqlite"), ("parquet:/data", "parquet"), ("jdbc:mysql://h/x", "mysql")])
def test_routing(text, dialect):
    assert catalog.dialect_of(text) == dialect


def test_urls():
    assert catalog.jdbc_url("postgres://u:p@h:5433/db") == ("jdbc:postgresql://h:5433/db", {"user": "u", "password": "p"})
    assert catalog.default_schemas("mysql://h/shop") == ["shop"] and catalog.default_schemas("postgres://h/db") == ["public"] and catalog.default_schemas("a.db") == ["main"]


def test_lookup_order():
    t = load("CREATE TABLE s.t (c int);").tables["s.t"]
    assert lookup({"c": 1, "s.t.c": 2, "t.c": 3}, t, "c") == 3 and lookup({"c": 1, "s.t.c": 2}, t, "c") == 2 and lookup({"c": 1}, t, "c") == 1 and lookup({}, t, "c") is None


def test_parquet_folder(spark):
    model, frames = catalog.connect(spark, "parquet:/root/testdata/sf0.001")
    assert model.find("nation").column("n_nationkey").kind == "integer" and frames["main.region"].count() == 5
