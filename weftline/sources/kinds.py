"""Declared types to the model's kinds, by dialect."""

from __future__ import annotations

import re

# Type names by kind.
POSTGRES = {
    "integer": "int2 int4 int8 smallint integer int bigint smallserial serial bigserial serial2 serial4 serial8 oid",
    "decimal": "float4 float8 numeric decimal real double float",
    "boolean": "bool boolean", "uuid": "uuid", "json": "json jsonb", "date": "date", "time": "time timetz", "timestamp": "timestamp timestamptz",
    "bytea": "bytea", "inet": "inet cidr", "money": "money", "interval": "interval", "macaddr": "macaddr macaddr8", "xml": "xml",
    "text": "text varchar bpchar char character citext name",
}
MYSQL = {
    "integer": "smallint mediumint int integer bigint bit year tinyint serial", "decimal": "decimal dec numeric fixed float double real",
    "boolean": "bool boolean", "date": "date", "time": "time", "timestamp": "datetime timestamp", "json": "json",
    "bytea": "binary varbinary tinyblob blob mediumblob longblob", "text": "char varchar tinytext text mediumtext longtext character nchar nvarchar",
}
#: SQLite looks for these within the declared type, in this order.
SQLITE = (("boolean", "BOOL"), ("timestamp", "DATETIME TIMESTAMP"), ("date", "DATE"), ("time", "TIME"), ("json", "JSON"), ("uuid", "UUID GUID"), ("integer", "INT"), ("text", "CHAR CLOB TEXT"), ("bytea", "BLOB"), ("decimal", "REAL FLOA DOUB"))
SMALL = {"int2", "smallint", "smallserial", "serial2", "tinyint", "year"}
MIDDLE = {"int4", "int", "integer", "serial", "serial4", "mediumint"}
RANGES = {"int4range": "integer", "int8range": "integer", "numrange": "decimal", "daterange": "date", "tsrange": "timestamp", "tstzrange": "timestamp"}


def kind_of(name: str, dialect: str, args: tuple[str, ...] = ()) -> str:
    """A kind, or unsupported."""
    if dialect == "sqlite":
        up = name.upper()
        if not up.strip():
            return "bytea"
        return next((k for k, parts in SQLITE if any(p in up for p in parts.split())), "decimal")
    word = name.lower()
    if dialect == "mysql" and word == "tinyint" and args == ("1",):
        return "boolean"
    return next((k for k, names in (POSTGRES if dialect == "postgres" else MYSQL).items() if word in names.split()), "unsupported")


def bits_of(name: str, dialect: str) -> int:
    word = name.lower()
    if dialect == "sqlite" or dialect == "mysql" and word == "serial":
        return 64
    return 16 if word in SMALL else 32 if word in MIDDLE else 64


def sizes(kind: str, args: tuple[str, ...]) -> dict:
    """length, or precision and scale, from what stands in parentheses."""
    numbers = [int(a) for a in args if re.fullmatch(r"\d+", a)]
    if not numbers:
        return {}
    if kind == "text":
        return {"length": numbers[0]}
    if kind == "decimal":
        return {"precision": numbers[0], "scale": numbers[1] if len(numbers) > 1 else 0}
    return {}
