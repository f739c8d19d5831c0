"""Values as SQL literals and COPY fields, as string expressions.

Dialects: postgres, mysql, sqlite. JSON columns hold JSON text already; arrays, records
and ranges become JSON outside Postgres.
"""

from __future__ import annotations

from pyspark.sql import Column as Col
from pyspark.sql import functions as F

from weftline.sources.model import Column

NUMBERS = ("integer", "decimal", "money")


def number(v: Col) -> Col:
    """Without an exponent, and without a point where nothing follows it."""
    plain = v.cast("string")
    wide = F.regexp_replace(v.cast("decimal(38,10)").cast("string"), "0+$", "")
    return F.regexp_replace(F.when(F.contains(plain, F.lit("E")), wide).otherwise(plain), r"\.0*$", "")


def iso(v: Col, kind: str) -> Col:
    """As 2024-05-06T07:08:09.012Z, dates as 2024-05-06."""
    return v.cast("string") if kind == "date" else F.date_format(v.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def doubled(text: Col) -> Col:
    return F.replace(text, F.lit("'"), F.lit("''"))


def shown(v: Col, c: Column) -> Col:
    """A value of a part of an array, record or range as text."""
    if c.kind in NUMBERS:
        return number(v)
    if c.kind in ("date", "timestamp"):
        return iso(v, c.kind)
    if c.kind == "boolean":
        return F.when(v, "true").otherwise("false")
    return v.cast("string")


def interval(v: Col) -> Col:
    """As 3 days 04:05:06."""
    part = lambda p: F.extract(F.lit(p), v)
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(part("DAY").cast("string"), F.lit(" days "), F.concat_ws(":", two(part("HOUR")), two(part("MINUTE")), two(part("SECOND"))))


def quoted_part(text: Col) -> Col:
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def postgres_text(v: Col, c: Column) -> Col:
    """What stands between the quotes, before they are doubled."""
    if c.kind == "array":
        return F.concat(F.lit("{"), F.array_join(F.transform(v, lambda x: F.coalesce(quoted_part(shown(x, c.element)), F.lit("NULL"))), ","), F.lit("}"))
    if c.kind == "composite":
        return F.concat(F.lit("("), F.concat_ws(",", *(F.coalesce(quoted_part(shown(v[f.name], f)), F.lit("")) for f in c.fields)), F.lit(")"))
    if c.kind == "range":
        return F.concat(F.lit("["), F.coalesce(shown(v["lower"], c.element), F.lit("")), F.lit(","), F.coalesce(shown(v["upper"], c.element), F.lit("")), F.lit(")"))
    if c.kind == "interval":
        return interval(v)
    if c.kind == "bytea":
        return F.concat(F.lit("\\x"), F.lower(F.hex(v)))
    if c.kind in ("date", "timestamp"):
        return iso(v, c.kind)
    return v.cast("string")


def other_text(v: Col, c: Column, dialect: str) -> Col:
    if c.kind in ("array", "composite", "range"):
        return F.to_json(v)
    if c.kind == "interval":
        return interval(v)
    if c.kind == "timestamp" and dialect == "mysql":
        return F.date_format(v.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    if c.kind in ("date", "timestamp"):
        return iso(v, c.kind)
    return v.cast("string")


def literal(v: Col, c: Column, dialect: str = "postgres") -> Col:
    """A SQL literal; NULL for null."""
    if c.kind in NUMBERS:
        made = number(v)
    elif c.kind == "boolean":
        yes, no = ("TRUE", "FALSE") if dialect == "postgres" else ("1", "0")
        made = F.when(v, yes).otherwise(no)
    elif c.kind == "bytea" and dialect != "postgres":
        made = F.concat(F.lit("X'"), F.lower(F.hex(v)), F.lit("'"))
    elif dialect == "postgres":
        made = F.concat(F.lit("'"), doubled(postgres_text(v, c)), F.lit("'::jsonb" if c.kind == "json" else "'"))
    else:
        body = other_text(v, c, dialect)
        body = F.replace(body, F.lit("\\"), F.lit("\\\\")) if dialect == "mysql" else body
        made = F.concat(F.lit("'"), doubled(body), F.lit("'"))
    return F.when(v.isNull(), "NULL").otherwise(made)


def row(columns: tuple[Column, ...] | list[Column], dialect: str = "postgres") -> Col:
    """(a, b, ...) of a row."""
    parts = [x for c in columns for x in (F.lit(", "), literal(F.col(c.name), c, dialect))][1:]
    return F.concat(F.lit("("), *parts, F.lit(")"))


def field(v: Col, c: Column) -> Col:
    """A field of COPY's text format: \\N for null, backslashes and control characters escaped."""
    if c.kind in NUMBERS:
        made = number(v)
    elif c.kind == "boolean":
        made = F.when(v, "t").otherwise("f")
    else:
        made = postgres_text(v, c)
        for raw, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            made = F.replace(made, F.lit(raw), F.lit(escaped))
    return F.when(v.isNull(), "\\N").otherwise(made)


def copy_line(columns: tuple[Column, ...] | list[Column]) -> Col:
    return F.concat_ws("\t", *(field(F.col(c.name), c) for c in columns))
