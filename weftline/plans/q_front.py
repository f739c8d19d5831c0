"""Queries over what is read before any row is made: DDL text, catalogs, names, settings, graphs.

Their SQL states by hand what must come out.
"""

from __future__ import annotations

import sqlite3
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftline.functions.names import json_rule, number_rule, text_rule
from weftline.functions.spread import Spread
from weftline.operators import coherence, temporal
from weftline.operators.engine import Config, emitted, governed, refused
from weftline.operators.graph import cyclic_tables, order
from weftline.plans import settings
from weftline.sources import catalog
from weftline.sources.ddl import load
from weftline.sources.model import Column, ForeignKey, Schema, Table, lookup

POSTGRES = """
-- a comment; with a semicolon
CREATE TYPE mood AS ENUM ('glad', 'it''s fine');
CREATE DOMAIN plz AS text CHECK (VALUE ~ '^[0-9]{5}$');
CREATE TYPE place AS (street text, no int);
CREATE FUNCTION f() RETURNS trigger AS $$ BEGIN; RETURN 1; END $$ LANGUAGE plpgsql;
CREATE TABLE crm.people (
  id BIGINT GENERATED ALWAYS AS IDENTITY PRIMARY KEY, mail character varying(60) NOT NULL UNIQUE, tags text[],
  m mood DEFAULT 'glad', zip plz, home place, seen timestamptz DEFAULT now() NOT NULL, span int4range,
  upper_mail text GENERATED ALWAYS AS (upper(mail)) STORED, pay numeric(9,2) CHECK (pay >= 0), pos geometry);
CREATE TABLE crm.notes (person bigint NOT NULL, nr smallserial, stars int CHECK (stars BETWEEN 1 AND 5), up int, PRIMARY KEY (person, nr));
ALTER TABLE ONLY crm.notes ADD CONSTRAINT fk FOREIGN KEY (person) REFERENCES crm.people ON DELETE CASCADE;
ALTER TABLE crm.notes ADD CONSTRAINT one UNIQUE (up);
CREATE UNIQUE INDEX seen_once ON crm.people (seen);
CREATE INDEX ignored ON crm.people (zip);
CREATE TABLE crm.days (day date NOT NULL, n int) PARTITION BY RANGE (day);
CREATE TABLE crm.days_a PARTITION OF crm.days FOR VALUES FROM ('2024-01-01') TO ('2025-01-01');
NOT A STATEMENT (;
"""
MYSQL = """
USE `works`;
CREATE TABLE `staff` (`id` int unsigned NOT NULL AUTO_INCREMENT, `rank` enum('A','b') DEFAULT 'A' COMMENT 'x, y; z', ok tinyint(1) NOT NULL, n tinyint(3),
  name varchar(20) CHARACTER SET utf8mb4 NOT NULL DEFAULT 'it\\'s', doc json, `key` text, total decimal(8,2) GENERATED ALWAYS AS (n * 2) VIRTUAL,
  PRIMARY KEY (`id`), UNIQUE KEY `u` (`name`(10)), KEY `k` (`ok`), CONSTRAINT `c` CHECK (`n` in (1,2))) ENGINE=InnoDB; # done
CREATE TABLE shifts (id serial, staff_id int, day date, CONSTRAINT fk FOREIGN KEY (staff_id) REFERENCES staff (id));
CREATE UNIQUE INDEX one ON shifts (day);
ALTER TABLE shifts ADD CONSTRAINT late CHECK (staff_id > 3);
ALTER TABLE shifts ADD COLUMN ignored int;
"""
SQLITE = """
CREATE TABLE IF NOT EXISTS boxes (id INTEGER PRIMARY KEY, label TEXT NOT NULL COLLATE NOCASE, code VARCHAR(8) UNIQUE, inside INTEGER REFERENCES boxes, size TEXT CHECK (size IN ('s', 'm')), raw, open BOOLEAN, at DATETIME, u GUID, w REAL);
CREATE TABLE pairs ([left box] INT, "right" INT, w INT, PRIMARY KEY ("left box", "right"), FOREIGN KEY (w) REFERENCES boxes (id)) WITHOUT ROWID;
"""
COLUMNS = "table_name string, column_name string, kind string, nullable boolean, is_identity boolean, is_generated boolean, max_length int, labels string"
KEYS = "table_name string, rule string, detail string"


def columns_of(spark: SparkSession, schema: Schema) -> DataFrame:
    rows = [(t.name, c.name, c.kind, c.nullable, c.identity, c.generated, c.length, "|".join(c.labels) or None) for t in schema.tables.values() for c in t.columns]
    return spark.createDataFrame(rows, COLUMNS)


def keys_of(spark: SparkSession, schema: Schema) -> DataFrame:
    rows = []
    for t in schema.tables.values():
        rows += [(t.name, "primary", ",".join(t.primary))] if t.primary else []
        rows += [(t.name, "unique", ",".join(u)) for u in t.uniques]
        rows += [(t.name, "foreign", f"{','.join(f.columns)} -> {f.parent}({','.join(f.parent_columns)})") for f in t.foreign]
        rows += [(t.name, "check", c) for c in t.checks]
        rows += [(t.name, "partition", f"{t.partition.strategy} {','.join(t.partition.columns)} {t.partition.ranges}")] if t.partition else []
    return spark.createDataFrame(rows, KEYS)


def _ddl(text: str, dialect: str, what: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: what(spark, load(text, dialect))


def _live(what: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """Of a SQLite file made for the query, read through its catalog."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        with tempfile.TemporaryDirectory() as folder:
            file = str(Path(folder) / "a.db")
            with sqlite3.connect(file) as db:
                db.executescript(SQLITE)
            db.close()
            return what(spark, catalog.sqlite(file))

    return run


def _postgres_rows() -> Schema:
    col = lambda c, kind, **more: {"schema_name": "public", "table_name": "a", "column_name": c, "type_name": kind, "base_name": None, "nullable": True, "has_default": False, "identity_kind": "", "generated_kind": "", "modifier": -1} | more
    return catalog.postgres_model(
        [col("id", "int4", nullable=False, identity_kind="a"), col("m", "_mood"), col("z", "plz", base_name="text"), col("n", "numeric", modifier=(10 << 16 | 2) + 4), col("t", "varchar", modifier=24), col("h", "addr"), col("w", "tsrange"), col("g", "geometry"), col("e", "mood")],
        [{"type_name": "mood", "label": x} for x in ("ok", "bad")],
        [{"type_name": "plz", "definition": "CHECK ((VALUE ~ '^[0-9]{5}$'::text))"}],
        [{"type_name": "addr", "column_name": "street", "field_type": "text"}],
        [{"type_name": "tsrange", "subtype": "timestamp"}],
        [{"schema_name": "public", "table_name": "a", "kind": "p", "definition": "", "column_list": "id"}, {"schema_name": "public", "table_name": "a", "kind": "c", "definition": "CHECK ((n > (0)::numeric))", "column_list": "n"}, {"schema_name": "public", "table_name": "a", "kind": "u", "definition": "", "column_list": "t"}],
        [],
    )


def _mysql_rows() -> Schema:
    col = lambda c, kind, full, **more: {"schema_name": "d", "table_name": "t", "column_name": c, "type_name": kind, "full_type": full, "nullable": "YES", "default_text": None, "extra": ""} | more
    key = lambda name, kind, c, n, **more: {"schema_name": "d", "table_name": "t", "constraint_name": name, "kind": kind, "column_name": c, "place": n} | more
    return catalog.mysql_model(
        [col("id", "int", "int unsigned", nullable="NO", extra="auto_increment"), col("ok", "tinyint", "tinyint(1)"), col("e", "enum", "enum('A','it''s')"), col("n", "decimal", "decimal(8,3)"), col("g", "int", "int", extra="VIRTUAL GENERATED")],
        [key("PRIMARY", "PRIMARY KEY", "id", 1), key("u", "UNIQUE", "n", 2), key("u", "UNIQUE", "ok", 1), key("f", "FOREIGN KEY", "n", 1, parent_schema="d", parent_name="p", parent_column="id")],
        [{"schema_name": "d", "table_name": "t", "definition": "(`e` in (_utf8mb4\\'A\\',_utf8mb4\\'b\\'))"}],
    )


CONNECTIONS = ("postgres://u:p@h/db", "postgresql://h/db", "mysql://h/shop", "mariadb://h/x", "sqlite:a.db", "file:a.db", "a.sqlite", "a.sqlite3", ":memory:", "parquet:/data")


def source_routing(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(c, catalog.dialect_of(c), ",".join(catalog.default_schemas(c)) or None) for c in CONNECTIONS], "connection string, dialect string, schemas string")


NAMES = """email work_email userName login passwd first_name givenName last_name surname middle_name displayName name contact_name company employer
job_title role mobile fax avatar photo website user_agent ip_address ip mac_address link slug street_address address town province country
postalCode zip latitude lng timezone currency iban credit_card total product_name product colour headline subject description bio created_at created
last_seen expires_at dob gender guid rank""".split()


def name_rules_text(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n, text_rule(n)) for n in NAMES], "name string, maker string")


OTHERS = "age page birth_year quantity qty rating stars score percentage discount discount_percent item_count price subtotal fee rank".split()
DOCUMENTS = "address billingAddress home_address latlng geo position tags roles preferences prefs configuration dimensions box_size contact pricing unit_cost amount profile anything".split()


def name_rules_number(spark: SparkSession, sf: str) -> DataFrame:
    found = {n: number_rule(n) for n in OTHERS}
    return spark.createDataFrame([(n, str(r) if isinstance(r, str) else None if r is None else f"{r[0]} to {r[1]}") for n, r in found.items()], "name string, found string")


def name_rules_json(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n, json_rule(n)) for n in DOCUMENTS], "name string, shape string")


MOMENTS = "created_at created_on date_created createdOn first_seen inserted_at registered_at updated_at last_login modified_at expires_at deleted_at birthday at".split()
PERSONS = "first_name lastName surname full_name name contact_name display_name email_address billing_email work_mail login gender region billing_state municipality shipping_zip postcode home_town country nationality".split()


def roles_of_moments(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n, temporal.role(n, "timestamp"), temporal.role(n, "text")) for n in MOMENTS], "name string, of_timestamp string, of_text string")


def roles_of_persons(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(n, coherence.role(n)) for n in PERSONS]
    return spark.createDataFrame([(n, r[0] if r else None, r[1] if r else None) for n, r in rows], "name string, role string, whose string")


def graph_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables that refer to each other, one below them and one beside: only the two, and one that refers to itself, are on a cycle."""
    s = Schema()
    fk = lambda parent: ForeignKey((f"{parent}_id",), f"main.{parent}", ("id",))
    for name, parents in (("head", ("team",)), ("team", ("head", "city")), ("note", ("head",)), ("city", ()), ("tree", ("tree",)), ("far", ("unknown",))):
        s.add(Table(name, (Column("id", "integer"), *(Column(f"{p}_id", "integer") for p in parents)), primary=("id",), foreign=tuple(map(fk, parents))))
    on = cyclic_tables(s)
    return spark.createDataFrame([(k.split(".")[1], i, k in on) for i, w in enumerate(order(s)[1]) for k in w], "table_name string, wave int, on_cycle boolean")


def settings_read(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("rows", k, str(v)) for k, v in settings.rows(["users=10", "shop.orders=2.9"]).items()]
    rows += [("distribution", k, f"{s.kind} {s.skew if s.kind == 'zipf' else ''} {s.weights or ''}".strip()) for k, s in settings.distributions(["a=uniform", "b=zipf", "c=zipf:2", "d=weighted:x=0.9,1=0.1"]).items()]
    rows += [("column", k, str(v)) for k, v in settings.columns(["a=internet.email", "b=value:30", "c=value:a=b", "d=values:x, true"]).items()]
    file = {"rows": {"a": 1, "b": 2}, "seed": 4, "skip": ["x"]}
    both = settings.config(file, rows={"b": 3}, skip=("y",), seed=None)
    rows += [("merged", "rows", str(both.rows)), ("merged", "seed", str(both.seed)), ("merged", "skip", ",".join(both.skip)), ("merged", "default_rows", str(both.default_rows))]
    return spark.createDataFrame(rows, "part string, name string, found string")


def model_rules(spark: SparkSession, sf: str) -> DataFrame:
    """What the model decides: columns written, columns refused, which foreign key and which setting counts."""
    t = Table("t", (Column("id", "integer", False, identity=True), Column("a", "integer"), Column("geo", "unsupported", False), Column("auto", "unsupported", False, default=True), Column("calc", "integer", generated=True), Column("soft", "unsupported")), primary=("id",), foreign=(ForeignKey(("a", "id"), "main.p", ("x", "y")), ForeignKey(("a",), "main.q", ("z",))))
    s = Schema({t.key: t})
    rows = [("written", ",".join(c.name for c in emitted(t, {}))), ("written with a setting", ",".join(c.name for c in emitted(t, {"t.auto": {"value": 1}}))), ("refused", ",".join(refused(s, Config()))), ("refused with a setting", ",".join(refused(s, Config(columns={"geo": {"value": "x"}})))), ("foreign key of a", t.foreign_of("a").parent)]
    found = {"a": 1, "main.t.a": 2, "t.a": 3}
    rows += [("setting", str(lookup(found, t, "a"))), ("setting by schema", str(lookup({k: found[k] for k in ("a", "main.t.a")}, t, "a"))), ("setting by column", str(lookup({"a": 1}, t, "a")))]
    rows += [("spread of the key", governed(t, t.foreign[0], {"id": Spread("zipf", 2.0)}).kind), ("weights for parents", governed(t, t.foreign[1], {"a": Spread("weighted", weights=(("x", 1.0),))}).kind)]
    try:
        s.find("nowhere")
    except KeyError as e:
        rows.append(("unknown table", e.args[0]))
    return spark.createDataFrame(rows, "rule string, found string")


QUERIES = {f.__name__: f for f in (source_routing, name_rules_text, name_rules_number, name_rules_json, roles_of_moments, roles_of_persons, graph_cycle, settings_read, model_rules)} | {
    "ddl_postgres_columns": _ddl(POSTGRES, "postgres", columns_of),
    "ddl_postgres_keys": _ddl(POSTGRES, "postgres", keys_of),
    "ddl_mysql_columns": _ddl(MYSQL, "mysql", columns_of),
    "ddl_mysql_keys": _ddl(MYSQL, "mysql", keys_of),
    "ddl_sqlite_keys": _ddl(SQLITE, "sqlite", keys_of),
    "catalog_sqlite_columns": _live(columns_of),
    "catalog_sqlite_keys": _live(keys_of),
    "catalog_postgres_columns": lambda spark, sf: columns_of(spark, _postgres_rows()),
    "catalog_postgres_keys": lambda spark, sf: keys_of(spark, _postgres_rows()),
    "catalog_mysql_columns": lambda spark, sf: columns_of(spark, _mysql_rows()),
    "catalog_mysql_keys": lambda spark, sf: keys_of(spark, _mysql_rows()),
}


def _values(names: str, *rows: tuple) -> str:
    def lit(v: object) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


def _columns(table: str, text: str) -> list[tuple]:
    """Rows from lines: name kind flags [length] [labels]; flags: n nullable, i identity, g generated, - none."""
    out = []
    for line in text.strip().splitlines():
        name, kind, flags, length, *labels = line.strip().split(" ", 4)
        out.append((table, name.replace("_blank_", " "), kind, "n" in flags, "i" in flags, "g" in flags, None if length == "-" else int(length), labels[0] if labels else None))
    return out


_COLUMNS = "table_name, column_name, kind, nullable, is_identity, is_generated, max_length, labels"
_KEYS = "table_name, rule, detail"
_BOXES = """id integer i -
label text - -
code text n 8
inside integer n -
size text n -
raw bytea n -
open boolean n -
at timestamp n -
u uuid n -
w decimal n -"""
_PAIRS = """left_blank_box integer - -
right integer - -
w integer n -"""
_SQLITE_KEYS = (("boxes", "primary", "id"), ("boxes", "unique", "code"), ("boxes", "foreign", "inside -> main.boxes(id)"), ("boxes", "check", "size IN ('s', 'm')"), ("pairs", "primary", "left box,right"), ("pairs", "foreign", "w -> main.boxes(id)"))

ORACLES = {
    "source_routing": _values("connection, dialect, schemas", ("postgres://u:p@h/db", "postgres", "public"), ("postgresql://h/db", "postgres", "public"), ("mysql://h/shop", "mysql", "shop"), ("mariadb://h/x", "mysql", "x"), *((c, "sqlite", "main") for c in ("sqlite:a.db", "file:a.db", "a.sqlite", "a.sqlite3", ":memory:")), ("parquet:/data", "parquet", "main")),
    "ddl_postgres_columns": _values(_COLUMNS, *_columns("people", "id integer i -\nmail text - 60\ntags array n -\nm enum n - glad|it's fine\nzip text n -\nhome composite n -\nseen timestamp - -\nspan range n -\nupper_mail text ng -\npay decimal n -\npos unsupported n -"), *_columns("notes", "person integer - -\nnr integer - -\nstars integer n -\nup integer n -"), *_columns("days", "day date - -\nn integer n -")),
    "ddl_postgres_keys": _values(_KEYS, ("people", "primary", "id"), ("people", "unique", "mail"), ("people", "unique", "seen"), ("people", "check", "\"zip\" ~ '^[0-9]{5}$'"), ("people", "check", "pay >= 0"), ("notes", "primary", "person,nr"), ("notes", "unique", "up"), ("notes", "foreign", "person -> crm.people(id)"), ("notes", "check", "stars BETWEEN 1 AND 5"), ("days", "partition", "range day (('2024-01-01', '2025-01-01'),)")),
    "ddl_mysql_columns": _values(_COLUMNS, *_columns("staff", "id integer i -\nrank enum n - A|b\nok boolean - -\nn integer n -\nname text - 20\ndoc json n -\nkey text n -\ntotal decimal ng -"), *_columns("shifts", "id integer i -\nstaff_id integer n -\nday date n -")),
    "ddl_mysql_keys": _values(_KEYS, ("staff", "primary", "id"), ("staff", "unique", "name"), ("staff", "check", "`n` in (1,2)"), ("shifts", "unique", "id"), ("shifts", "unique", "day"), ("shifts", "foreign", "staff_id -> works.staff(id)"), ("shifts", "check", "staff_id > 3")),
    "ddl_sqlite_keys": _values(_KEYS, *_SQLITE_KEYS),
    "catalog_sqlite_columns": _values(_COLUMNS, *_columns("boxes", _BOXES), *_columns("pairs", _PAIRS)),
    "catalog_sqlite_keys": _values(_KEYS, *_SQLITE_KEYS),
    "catalog_postgres_columns": _values(_COLUMNS, *_columns("a", "id integer i -\nm array n -\nz text n -\nn decimal n -\nt text n 20\nh composite n -\nw range n -\ng unsupported n -\ne enum n - ok|bad")),
    "catalog_postgres_keys": _values(_KEYS, ("a", "primary", "id"), ("a", "unique", "t"), ("a", "check", "(\"z\" ~ '^[0-9]{5}$'::text)"), ("a", "check", "(n > (0)::numeric)")),
    "catalog_mysql_columns": _values(_COLUMNS, *_columns("t", "id integer i -\nok boolean n -\ne enum n - A|it's\nn decimal n -\ng integer ng -")),
    "catalog_mysql_keys": _values(_KEYS, ("t", "primary", "id"), ("t", "unique", "ok,n"), ("t", "foreign", "n -> d.p(id)"), ("t", "check", "(`e` in ('A','b'))")),
    "name_rules_text": _values(
        "name, maker",
        *(
            (n, m)
            for m, names in {
                "internet.email": "email work_email", "internet.username": "login", "internet.password": "passwd", "person.firstName": "first_name givenName", "person.lastName": "last_name surname", "person.middleName": "middle_name",
                "person.fullName": "displayName name contact_name", "company.name": "company employer", "person.jobTitle": "job_title role", "phone.number": "mobile fax", "image.url": "avatar photo", "internet.url": "website link",
                "internet.userAgent": "user_agent", "internet.ipv4": "ip_address ip", "internet.mac": "mac_address", "lorem.slug": "slug", "location.street": "street_address address", "location.city": "town", "location.state": "province",
                "location.country": "country", "location.zipCode": "postalCode zip", "location.latitude": "latitude", "location.longitude": "lng", "location.timeZone": "timezone", "finance.currencyCode": "currency", "finance.iban": "iban",
                "finance.creditCardNumber": "credit_card", "commerce.price": "total", "commerce.productName": "product_name", "commerce.product": "product", "color.human": "colour", "lorem.sentence": "headline subject",
                "lorem.paragraph": "description bio", "date.past": "created_at created", "date.recent": "last_seen", "date.future": "expires_at", "date.birthdate": "dob", "person.sex": "gender", "string.uuid": "guid",
            }.items()
            for n in names.split()
        ),
        ("userName", None), ("rank", None),
    ),
    "name_rules_number": _values("name, found", ("age", "0 to 95"), ("page", None), ("birth_year", "1970 to 2025"), ("quantity", "1 to 100"), ("qty", "1 to 100"), ("rating", "1 to 5"), ("stars", "1 to 5"), ("score", "0 to 100"), ("percentage", "0 to 100"), ("discount", "0 to 100"), ("discount_percent", "0 to 100"), ("item_count", "0 to 1000"), ("price", "money"), ("subtotal", "money"), ("fee", "money"), ("rank", None)),
    "name_rules_json": _values("name, shape", ("address", "address"), ("billingAddress", "address"), ("home_address", "address"), ("latlng", "point"), ("geo", "point"), ("position", "record"), ("tags", "tags"), ("roles", "permissions"), ("preferences", "settings"), ("prefs", "settings"), ("configuration", "settings"), ("dimensions", "dimensions"), ("box_size", "dimensions"), ("contact", "contact"), ("pricing", "price"), ("unit_cost", "price"), ("amount", "record"), ("profile", "profile"), ("anything", "record")),
    "roles_of_moments": _values("name, of_timestamp, of_text", *((n, "created", None) for n in "created_at created_on date_created createdOn first_seen inserted_at registered_at".split()), *((n, "activity", None) for n in "updated_at last_login modified_at".split()), *((n, "future", None) for n in "expires_at deleted_at".split()), ("birthday", None, None), ("at", None, None)),
    "roles_of_persons": _values("name, role, whose", ("first_name", "first", ""), ("lastName", "last", ""), ("surname", "last", ""), ("full_name", "full", ""), ("name", "full", ""), ("contact_name", "full", ""), ("display_name", "full", ""), ("email_address", "email", ""), ("billing_email", "email", "billing"), ("work_mail", None, None), ("login", "username", ""), ("gender", "sex", ""), ("region", "state", ""), ("billing_state", "state", "billing"), ("municipality", "city", ""), ("shipping_zip", "zip", "shipping"), ("postcode", "zip", ""), ("home_town", "city", "home"), ("country", "country", ""), ("nationality", None, None)),
    "graph_cycle": _values("table_name, wave, on_cycle", ("city", 0, False), ("tree", 0, True), ("far", 0, False), ("head", 1, True), ("team", 2, True), ("note", 2, False)),
    "settings_read": _values("part, name, found", ("rows", "users", "10"), ("rows", "shop.orders", "2"), ("distribution", "a", "uniform"), ("distribution", "b", "zipf 1.0"), ("distribution", "c", "zipf 2.0"), ("distribution", "d", "weighted  (('x', 0.9), (1, 0.1))"), ("column", "a", "internet.email"), ("column", "b", "{'value': 30}"), ("column", "c", "{'value': 'a=b'}"), ("column", "d", "{'values': ['x', True]}"), ("merged", "rows", "{'a': 1, 'b': 3}"), ("merged", "seed", "4"), ("merged", "skip", "x,y"), ("merged", "default_rows", "10")),
    "model_rules": _values("rule, found", ("written", "id,a,geo,soft"), ("written with a setting", "id,a,geo,auto,soft"), ("refused", "main.t.geo"), ("refused with a setting", ""), ("foreign key of a", "main.p"), ("setting", "3"), ("setting by schema", "2"), ("setting by column", "1"), ("spread of the key", "zipf"), ("weights for parents", "uniform"), ("unknown table", "no table nowhere")),
}
