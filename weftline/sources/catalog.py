"""Models from live catalogs: Postgres, MySQL, SQLite, and folders of Parquet.

Postgres and MySQL are read over JDBC with the queries below (their driver must be on
the class path); the rows are turned into a model by plain functions, which need no
database. SQLite is read with the standard library.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from weftline.sources.ddl import split, tokenize, unquoted
from weftline.sources.kinds import bits_of, kind_of, sizes
from weftline.sources.model import Column, ForeignKey, Partition, Schema, Table

Rows = list[dict]
Ask = Callable[[str], Rows]


# -- where a connection string leads


def dialect_of(connection: str) -> str:
    """mysql and mariadb URLs; sqlite and file URLs, :memory: and names of SQLite files; a folder; else Postgres."""
    low = connection.lower()
    if re.match(r"(jdbc:)?(mysql|mariadb):", low):
        return "mysql"
    if low.startswith(("sqlite:", "file:", "jdbc:sqlite:")) or low == ":memory:" or low.endswith((".db", ".sqlite", ".sqlite3")):
        return "sqlite"
    if low.startswith(("parquet:", "/")) and "://" not in low.removeprefix("parquet:"):
        return "parquet"
    return "postgres"


def sqlite_file(connection: str) -> str:
    return re.sub(r"^(jdbc:)?(sqlite|file):(//)?", "", connection)


def default_schemas(connection: str) -> list[str]:
    """public, the database in a MySQL URL, main."""
    dialect = dialect_of(connection)
    if dialect == "mysql":
        name = urlsplit(connection.removeprefix("jdbc:")).path.strip("/")
        return [name] if name else []
    return ["public"] if dialect == "postgres" else ["main"]


def jdbc_url(connection: str) -> tuple[str, dict[str, str]]:
    """(URL, user and password) for Spark from a usual connection string."""
    if connection.startswith("jdbc:"):
        return connection, {}
    u = urlsplit(connection)
    scheme = {"postgres": "postgresql", "mariadb": "mariadb"}.get(u.scheme, u.scheme)
    port = f":{u.port}" if u.port else ""
    properties = {k: v for k, v in (("user", u.username), ("password", u.password)) if v}
    return f"jdbc:{scheme}://{u.hostname or 'localhost'}{port}{u.path}", properties


def over_jdbc(spark: SparkSession, connection: str) -> Ask:
    url, properties = jdbc_url(connection)
    return lambda sql: [{k.lower(): v for k, v in r.asDict().items()} for r in spark.read.format("jdbc").option("url", url).option("query", sql).options(**properties).load().collect()]


# -- Postgres

POSTGRES_COLUMNS = """
SELECT n.nspname AS schema_name, c.relname AS table_name, a.attname AS column_name, t.typname AS type_name, t.typtype::text AS type_type,
  CASE WHEN t.typcategory = 'A' THEN e.typname END AS element_name, b.typname AS base_name, NOT a.attnotnull AS nullable,
  d.adbin IS NOT NULL AS has_default, a.attidentity::text AS identity_kind, a.attgenerated::text AS generated_kind,
  a.atttypmod AS modifier, t.oid::bigint AS type_id, a.attnum AS place
FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_type t ON t.oid = a.atttypid
LEFT JOIN pg_type e ON e.oid = t.typelem LEFT JOIN pg_type b ON b.oid = t.typbasetype LEFT JOIN pg_attrdef d ON d.adrelid = c.oid AND d.adnum = a.attnum
WHERE c.relkind IN ('r', 'p') AND NOT c.relispartition AND a.attnum > 0 AND NOT a.attisdropped AND n.nspname IN ({schemas})
ORDER BY n.nspname, c.relname, a.attnum"""
POSTGRES_ENUMS = "SELECT t.typname AS type_name, e.enumlabel AS label FROM pg_enum e JOIN pg_type t ON t.oid = e.enumtypid ORDER BY t.typname, e.enumsortorder"
POSTGRES_DOMAINS = "SELECT t.typname AS type_name, pg_get_constraintdef(k.oid) AS definition FROM pg_constraint k JOIN pg_type t ON t.oid = k.contypid"
POSTGRES_FIELDS = """
SELECT t.typname AS type_name, a.attname AS column_name, f.typname AS field_type FROM pg_type t JOIN pg_attribute a ON a.attrelid = t.typrelid
JOIN pg_type f ON f.oid = a.atttypid JOIN pg_class c ON c.oid = t.typrelid WHERE c.relkind = 'c' AND a.attnum > 0 AND NOT a.attisdropped ORDER BY t.typname, a.attnum"""
POSTGRES_RANGES = "SELECT t.typname AS type_name, s.typname AS subtype FROM pg_range r JOIN pg_type t ON t.oid = r.rngtypid JOIN pg_type s ON s.oid = r.rngsubtype"
POSTGRES_KEYS = """
SELECT n.nspname AS schema_name, c.relname AS table_name, k.contype::text AS kind, pg_get_constraintdef(k.oid) AS definition,
  (SELECT string_agg(a.attname, ',' ORDER BY u.o) FROM unnest(k.conkey) WITH ORDINALITY u(n, o) JOIN pg_attribute a ON a.attrelid = k.conrelid AND a.attnum = u.n) AS column_list,
  fn.nspname AS parent_schema, fc.relname AS parent_name,
  (SELECT string_agg(a.attname, ',' ORDER BY u.o) FROM unnest(k.confkey) WITH ORDINALITY u(n, o) JOIN pg_attribute a ON a.attrelid = k.confrelid AND a.attnum = u.n) AS parent_list
FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid JOIN pg_namespace n ON n.oid = c.relnamespace
LEFT JOIN pg_class fc ON fc.oid = k.confrelid LEFT JOIN pg_namespace fn ON fn.oid = fc.relnamespace
WHERE k.contype IN ('p', 'u', 'f', 'c') AND n.nspname IN ({schemas}) ORDER BY k.conname"""
POSTGRES_PARTITIONS = """
SELECT n.nspname AS schema_name, c.relname AS table_name, p.partstrat::text AS strategy,
  (SELECT string_agg(coalesce(a.attname, ''), ',' ORDER BY u.o) FROM unnest(p.partattrs::int[]) WITH ORDINALITY u(n, o) LEFT JOIN pg_attribute a ON a.attrelid = c.oid AND a.attnum = u.n) AS column_list,
  pg_get_expr(h.relpartbound, h.oid) AS bound
FROM pg_partitioned_table p JOIN pg_class c ON c.oid = p.partrelid JOIN pg_namespace n ON n.oid = c.relnamespace
LEFT JOIN pg_inherits i ON i.inhparent = c.oid LEFT JOIN pg_class h ON h.oid = i.inhrelid WHERE n.nspname IN ({schemas})"""


def bound(p: Partition, text: str | None) -> Partition:
    """A partition's key space with one more bound: DEFAULT, FROM (..) TO (..), or IN (..)."""
    if not text:
        return p
    if text.strip().upper() == "DEFAULT":
        return replace(p, has_default=True)
    toks = tokenize(text, "postgres")
    groups, depth, now = [], 0, []
    for t in toks:
        if t.low == ")":
            depth -= 1
            if not depth:
                groups.append(split(now))
                now = []
        if depth:
            now.append(t)
        depth += t.low == "("

    def first(part: list) -> str | None:
        if part[0].low in ("minvalue", "maxvalue"):
            return None
        strings = [t for t in part if t.kind == "string"]
        return unquoted(strings[0]) if strings else "".join(t.text for t in part)

    if any(t.low == "in" for t in toks):
        return replace(p, values=p.values + tuple(v for part in groups[0] if (v := first(part)) is not None and v.lower() != "null"))
    if any(t.low == "from" for t in toks):
        return replace(p, ranges=(*p.ranges, (first(groups[0][0]), first(groups[1][0]))))
    return p


def inner_check(definition: str) -> str:
    """What stands within CHECK (...)."""
    m = re.match(r"\s*CHECK\s*\((.*)\)\s*(?:NO INHERIT|NOT VALID)?\s*$", definition, re.DOTALL | re.IGNORECASE)
    return m.group(1) if m else definition


class PostgresTypes:
    """Type names to columns, through domains, enums, records, ranges and arrays."""

    def __init__(self, enums: Rows, domains: Rows, fields: Rows, ranges: Rows) -> None:
        self.labels: dict[str, tuple[str, ...]] = {}
        for r in enums:
            self.labels[r["type_name"]] = (*self.labels.get(r["type_name"], ()), r["label"])
        self.checks: dict[str, list[str]] = {}
        for r in domains:
            self.checks.setdefault(r["type_name"], []).append(inner_check(r["definition"]))
        self.fields: dict[str, list[tuple[str, str]]] = {}
        for r in fields:
            self.fields.setdefault(r["type_name"], []).append((r["column_name"], r["field_type"]))
        self.ranges = {r["type_name"]: r["subtype"] for r in ranges}

    def column(self, name: str, type_name: str, base: str | None = None, seen: tuple[str, ...] = ()) -> Column:
        if type_name in seen:
            return Column(name, "unsupported")
        deeper = (*seen, type_name)
        if type_name in self.labels:
            return Column(name, "enum", labels=self.labels[type_name])
        if base:
            return self.column(name, base, None, deeper)
        if type_name.startswith("_"):
            return Column(name, "array", element=self.column(f"{name}_element", type_name[1:], None, deeper))
        if type_name in self.fields:
            return Column(name, "composite", fields=tuple(self.column(f, t, None, deeper) for f, t in self.fields[type_name]))
        if type_name in self.ranges:
            return Column(name, "range", element=self.column(f"{name}_bound", self.ranges[type_name], None, deeper))
        kind = kind_of(type_name, "postgres")
        return Column(name, kind, bits=bits_of(type_name, "postgres") if kind == "integer" else 64)


def listed(text: str | None) -> tuple[str, ...]:
    return tuple(text.split(",")) if text else ()


def postgres_model(columns: Rows, enums: Rows, domains: Rows, fields: Rows, ranges: Rows, keys: Rows, partitions: Rows) -> Schema:
    """From the rows of the queries above."""
    types = PostgresTypes(enums, domains, fields, ranges)
    tables: dict[tuple[str, str], Table] = {}
    for r in columns:
        key = r["schema_name"], r["table_name"]
        c = types.column(r["column_name"], r["type_name"], r.get("base_name"))
        mod = r.get("modifier") or -1
        if mod > 4 and c.kind == "text":
            c = replace(c, length=mod - 4)
        if mod > 4 and c.kind == "decimal":
            c = replace(c, precision=(mod - 4) >> 16, scale=(mod - 4) & 0x7FF)
        c = replace(c, nullable=bool(r["nullable"]), default=bool(r.get("has_default")) and not r.get("generated_kind"), identity=bool(r.get("identity_kind")), generated=bool(r.get("generated_kind")))
        t = tables.get(key) or Table(key[1], (), key[0])
        more = tuple(re.sub(r"\bVALUE\b", f'"{c.name}"', x) for x in types.checks.get(r["type_name"], ()))
        tables[key] = replace(t, columns=(*t.columns, c), checks=t.checks + more)
    for r in keys:
        t = tables.get((r["schema_name"], r["table_name"]))
        if t is None:
            continue
        names = listed(r.get("column_list"))
        if r["kind"] == "p":
            t = replace(t, primary=names)
        elif r["kind"] == "u":
            t = replace(t, uniques=(*t.uniques, names))
        elif r["kind"] == "f":
            t = replace(t, foreign=(*t.foreign, ForeignKey(names, f"{r['parent_schema']}.{r['parent_name']}", listed(r["parent_list"]))))
        else:
            t = replace(t, checks=(*t.checks, inner_check(r["definition"])))
        tables[r["schema_name"], r["table_name"]] = t
    for r in partitions:
        key = r["schema_name"], r["table_name"]
        if key in tables:
            names = listed(r["column_list"])
            p = tables[key].partition or Partition({"r": "range", "l": "list", "h": "hash"}[r["strategy"]], names if all(names) else ())
            tables[key] = replace(tables[key], partition=bound(p, r.get("bound")))
    out = Schema()
    for t in tables.values():
        out.add(t)
    return out


def postgres(ask: Ask, schemas: list[str]) -> Schema:
    among = ", ".join("'" + s.replace("'", "''") + "'" for s in schemas)
    return postgres_model(*(ask(q.format(schemas=among)) for q in (POSTGRES_COLUMNS, POSTGRES_ENUMS, POSTGRES_DOMAINS, POSTGRES_FIELDS, POSTGRES_RANGES, POSTGRES_KEYS, POSTGRES_PARTITIONS)))


# -- MySQL

MYSQL_COLUMNS = """
SELECT c.table_schema AS schema_name, c.table_name AS table_name, c.column_name AS column_name, c.data_type AS type_name, c.column_type AS full_type,
  c.is_nullable AS nullable, c.column_default AS default_text, c.extra AS extra, c.ordinal_position AS place
FROM information_schema.columns c JOIN information_schema.tables t ON t.table_schema = c.table_schema AND t.table_name = c.table_name
WHERE t.table_type = 'BASE TABLE' AND c.table_schema IN ({schemas}) ORDER BY 1, 2, c.ordinal_position"""
MYSQL_KEYS = """
SELECT k.table_schema AS schema_name, k.table_name AS table_name, k.constraint_name AS constraint_name, t.constraint_type AS kind, k.column_name AS column_name,
  k.referenced_table_schema AS parent_schema, k.referenced_table_name AS parent_name, k.referenced_column_name AS parent_column, k.ordinal_position AS place
FROM information_schema.key_column_usage k JOIN information_schema.table_constraints t ON t.constraint_schema = k.constraint_schema AND t.table_name = k.table_name AND t.constraint_name = k.constraint_name
WHERE k.table_schema IN ({schemas}) ORDER BY 1, 2, 3, k.ordinal_position"""
MYSQL_CHECKS = """
SELECT t.table_schema AS schema_name, t.table_name AS table_name, c.check_clause AS definition FROM information_schema.check_constraints c
JOIN information_schema.table_constraints t ON t.constraint_schema = c.constraint_schema AND t.constraint_name = c.constraint_name WHERE t.table_schema IN ({schemas})"""


def mysql_labels(full_type: str) -> tuple[str, ...]:
    """Labels of enum('a','b'); a set is one label."""
    values = tuple(unquoted(t) for t in tokenize(full_type, "mysql") if t.kind == "string")
    return values if full_type.lower().startswith("enum") else (",".join(values),)


def mysql_check(text: str) -> str:
    """Without character set introducers and escaped quotes."""
    return re.sub(r"_\w+\s*(?=\\?')", "", text).replace("\\'", "'")


def mysql_model(columns: Rows, keys: Rows, checks: Rows) -> Schema:
    tables: dict[tuple[str, str], Table] = {}
    for r in columns:
        key = r["schema_name"], r["table_name"]
        name, full, extra = r["type_name"].lower(), r["full_type"], (r.get("extra") or "").lower()
        args = tuple(x.strip() for x in m.group(1).split(",")) if (m := re.search(r"\(([\d, ]+)\)", full)) else ()
        if name in ("enum", "set"):
            c = Column(r["column_name"], "enum", labels=mysql_labels(full))
        else:
            kind = kind_of(name, "mysql", args)
            c = Column(r["column_name"], kind, bits=bits_of(name, "mysql") if kind == "integer" else 64, **sizes(kind, args))
        c = replace(c, nullable=r["nullable"] == "YES", default=r.get("default_text") is not None, identity="auto_increment" in extra, generated="generated" in extra and "default_generated" not in extra)
        t = tables.get(key) or Table(key[1], (), key[0])
        tables[key] = replace(t, columns=(*t.columns, c))
    grouped: dict[tuple, list[dict]] = {}
    for r in sorted(keys, key=lambda r: r["place"]):
        grouped.setdefault((r["schema_name"], r["table_name"], r["constraint_name"], r["kind"]), []).append(r)
    for (s, name, _, kind), parts in grouped.items():
        t = tables.get((s, name))
        if t is None:
            continue
        names = tuple(p["column_name"] for p in parts)
        if kind == "PRIMARY KEY":
            t = replace(t, primary=names)
        elif kind == "UNIQUE":
            t = replace(t, uniques=(*t.uniques, names))
        elif kind == "FOREIGN KEY":
            t = replace(t, foreign=(*t.foreign, ForeignKey(names, f"{parts[0]['parent_schema']}.{parts[0]['parent_name']}", tuple(p["parent_column"] for p in parts))))
        tables[s, name] = t
    for r in checks:
        key = r["schema_name"], r["table_name"]
        if key in tables:
            tables[key] = replace(tables[key], checks=(*tables[key].checks, mysql_check(r["definition"])))
    out = Schema()
    for t in tables.values():
        out.add(t)
    return out


def mysql(ask: Ask, schemas: list[str]) -> Schema:
    among = ", ".join("'" + s.replace("'", "''") + "'" for s in schemas)
    found = [ask(q.format(schemas=among)) for q in (MYSQL_COLUMNS, MYSQL_KEYS)]
    try:
        checks = ask(MYSQL_CHECKS.format(schemas=among))
    except Exception:  # noqa: BLE001 - servers before 8.0.16 have no such view
        checks = []
    return mysql_model(*found, checks)


# -- SQLite


def checks_in(sql: str) -> tuple[str, ...]:
    """The CHECK clauses of a CREATE TABLE, wherever they stand."""
    toks, out = tokenize(sql, "sqlite"), []
    for i, t in enumerate(toks):
        if t.low == "check" and i + 1 < len(toks) and toks[i + 1].low == "(":
            depth, k = 1, i + 2
            while k < len(toks) and depth:
                depth += {"(": 1, ")": -1}.get(toks[k].low, 0)
                k += 1
            out.append(sql[toks[i + 2].start : toks[k - 2].end])
    return tuple(out)


def sqlite(file: str) -> Schema:
    import sqlite3

    with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
        out = Schema()
        for name, sql in db.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY rowid").fetchall():
            quoted = '"' + name.replace('"', '""') + '"'
            columns, primary = [], []
            for _, col, declared, required, default, pk, hidden in db.execute(f"PRAGMA table_xinfo({quoted})").fetchall():
                if hidden == 1:
                    continue
                base, args = (m.group(1).strip(), tuple(x.strip() for x in m.group(2).split(","))) if (m := re.match(r"([^(]*)\(([^)]*)\)", declared or "")) else (declared or "", ())
                kind = kind_of(base, "sqlite")
                columns.append(Column(col, kind, nullable=not (required or pk), default=default is not None, generated=hidden in (2, 3), **sizes(kind, args)))
                if pk:
                    primary.append((pk, col, (declared or "").strip().upper()))
            names = tuple(c for _, c, _ in sorted(primary))
            if len(primary) == 1 and primary[0][2] == "INTEGER":
                columns = [replace(c, identity=True) if c.name == names[0] else c for c in columns]
            links: dict[int, list[tuple]] = {}
            for r in db.execute(f"PRAGMA foreign_key_list({quoted})").fetchall():
                links.setdefault(r[0], []).append(r)
            fks = []
            for _, rows in sorted(links.items()):
                rows.sort(key=lambda r: r[1])
                fks.append(ForeignKey(tuple(r[3] for r in rows), f"main.{rows[0][2]}", tuple(r[4] for r in rows) if all(r[4] for r in rows) else ()))
            uniques = []
            for r in db.execute(f"PRAGMA index_list({quoted})").fetchall():
                if r[2] and r[3] != "pk" and not r[4]:
                    cols = tuple(x[2] for x in sorted(db.execute(f"PRAGMA index_info(\"{r[1]}\")").fetchall()))
                    if all(cols):
                        uniques.append(cols)
            out.add(Table(name, tuple(columns), "main", names, tuple(sorted(uniques)), tuple(fks), checks_in(sql or "")))
        return out.resolved()


def sqlite_frames(spark: SparkSession, file: str, schema: Schema) -> dict[str, DataFrame]:
    """The tables of a SQLite file, by key; a file is read on the driver, so it must be small."""
    import sqlite3

    out = {}
    with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
        for key, t in schema.tables.items():
            names = t.names()
            rows = db.execute("SELECT " + ", ".join('"' + n.replace('"', '""') + '"' for n in names) + ' FROM "' + t.name.replace('"', '""') + '"').fetchall()
            raw = ", ".join(f"`{c.name}` {'long' if c.kind in ('integer', 'boolean') else 'double' if c.kind == 'decimal' else 'binary' if c.kind == 'bytea' else 'string'}" for c in t.columns)
            held = [tuple(bound_value(v, c.kind) for v, c in zip(r, t.columns, strict=True)) for r in rows]
            df = spark.createDataFrame(held, raw)
            out[key] = df.select(*(stored(df[f"`{c.name}`"], c).alias(c.name) for c in t.columns))
    return out


def bound_value(v, kind: str):
    if v is None or kind not in ("integer", "boolean", "decimal", "bytea"):
        return v if v is None else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
    return int(v) if kind in ("integer", "boolean") else float(v) if kind == "decimal" else v.encode() if isinstance(v, str) else bytes(v)


def stored(v, c: Column):
    if c.kind == "timestamp":
        from pyspark.sql import functions as F

        return F.regexp_replace(v, "Z$", "").cast("timestamp_ntz")
    return v.cast(c.spark_type())


def jdbc_frames(spark: SparkSession, connection: str, schema: Schema) -> dict[str, DataFrame]:
    """Tables over JDBC by key. A single integer primary key splits the read into ranges."""
    url, properties = jdbc_url(connection)
    dialect, out = dialect_of(connection), {}
    for key, t in schema.tables.items():
        name = f"{t.schema}.{t.name}"
        reader = spark.read.format("jdbc").option("url", url).options(**properties)
        if len(t.primary) == 1 and t.column(t.primary[0]).kind == "integer":
            mark = "`" if dialect == "mysql" else '"'
            pk = f"{mark}{t.primary[0]}{mark}"
            lo, hi = reader.option("query", f"SELECT min({pk}) AS lo, max({pk}) AS hi FROM {name}").load().first()
            if lo is not None and hi > lo:
                parts = spark.sparkContext.defaultParallelism
                out[key] = spark.read.format("jdbc").option("url", url).options(**properties).option("dbtable", name).option("partitionColumn", t.primary[0]).option("lowerBound", str(lo)).option("upperBound", str(hi)).option("numPartitions", str(parts)).load()
                continue
        out[key] = reader.option("dbtable", name).load()
    return out


def parquet_model(spark: SparkSession, folder: str) -> tuple[Schema, dict[str, DataFrame]]:
    """A folder of name.parquet tables; keys.json or schema.sql beside them declares the keys."""
    from weftline.sources.ddl import load
    from weftline.sources.model import of_struct

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(str(s.getPath().getName()) for s in fs.listStatus(path))
    declared = None
    if "schema.sql" in names:
        declared = load("\n".join(r.value for r in spark.read.text(f"{folder}/schema.sql").collect()), "sqlite")
    out, frames = Schema(), {}
    for n in names:
        if n.endswith(".parquet"):
            df = spark.read.parquet(f"{folder}/{n}")
            t = of_struct(n.removesuffix(".parquet"), df.schema)
            if declared is not None and t.key in declared.tables:
                t = declared.tables[t.key]
            out.add(t)
            frames[t.key] = df
    return out, frames


def connect(spark: SparkSession, connection: str, schemas: list[str] | None = None) -> tuple[Schema, dict[str, DataFrame]]:
    """The model behind a connection string, and its tables by key (lazy, but for SQLite)."""
    dialect = dialect_of(connection)
    if dialect == "parquet":
        return parquet_model(spark, connection.removeprefix("parquet:"))
    if dialect == "sqlite":
        model = sqlite(sqlite_file(connection))
        return model, sqlite_frames(spark, sqlite_file(connection), model)
    ask = over_jdbc(spark, connection)
    model = (postgres if dialect == "postgres" else mysql)(ask, schemas or default_schemas(connection))
    return model, jdbc_frames(spark, connection, model)
