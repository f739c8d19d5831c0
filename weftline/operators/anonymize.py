"""Real rows with made-up values: the same value always becomes the same fake, nulls stay null.

A column that need not stay unique is a pure function of its own value: no join. A unique
column, and a group of join keys that is forced, gets a table of its distinct values
numbered by their hash; the fake is an injective function of the number, and the table is
joined back wherever the group occurs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import instants
from weftline.functions.checks import distil
from weftline.functions.draw import Draw
from weftline.functions.generators import Context, finished, uuid, value
from weftline.operators.engine import Config
from weftline.operators.graph import key_groups, protected, representative
from weftline.operators.numbering import dense_rank
from weftline.operators.temporal import window
from weftline.sources.model import Column, Schema, Table, lookup, matches
from weftline.sources.scratch import cut

#: Names of mapping columns, unlikely in anyone's table.
REAL, FAKE = "real__", "fake__"


@dataclass(frozen=True)
class Scrub:
    """What happens to a column: group is the forced group's index, or None for the column's own mapping."""

    table: str
    column: str
    unique: bool
    group: int | None = None


def plan(schema: Schema, config: Config) -> tuple[list[Scrub], list[str]]:
    """The columns to scrub, and warnings.

    Join keys move only with their whole group, when any member is named in
    ``anonymize``; then preserved columns stay; then keys stay unless named; the rest goes.
    """
    grouped = {m: k for k, g in enumerate(key_groups(schema)) for m in g}
    forced = {k for (t, c), k in grouped.items() if matches(list(config.anonymize), schema.tables[t], c)}
    guard, out, warned = protected(schema), [], []
    for key, t in schema.tables.items():
        singles = {s[0] for s in t.key_sets() if len(s) == 1}
        for c in t.columns:
            if c.generated:
                continue
            kept = matches(list(config.preserve), t, c.name)
            k = grouped.get((key, c.name))
            if k is not None:
                if k in forced:
                    out.append(Scrub(key, c.name, True, k))
                    if kept:
                        warned.append(f"{key}.{c.name} is preserved, but its join group is anonymized")
            elif not kept and ((key, c.name) not in guard or matches(list(config.anonymize), t, c.name)):
                out.append(Scrub(key, c.name, c.name in singles))
    return out, warned


def number(c: Col, kind: str) -> Col:
    """A row number for draws, from a value."""
    shown = F.hex(c) if kind == "bytea" else F.to_json(c) if kind in ("array", "composite", "range") else c.cast("string")
    return F.conv(F.substring(F.md5(shown), 1, 15), 16, 10).cast("long")


def fake(schema: Schema, t: Table, c: Column, config: Config, row: Col) -> Col:
    """The column's usual generator, with a row number of our choice."""
    w = window(config.since, config.until)
    draw = Draw(config.seed, f"anon.{t.key}.{c.name}", row, 0, config.rng)
    made = value(draw, replace(t, partition=None), c, distil(t.checks).get(c.name), Context(config.columns, {}, w.until))
    return finished(made.cast("long") if c.kind in ("date", "timestamp") else made, c)


def injective(schema: Schema, t: Table, c: Column, config: Config, top: Col) -> Col:
    """A fake from the number ``rank`` alone, none like another; top: the largest real value, of numbers."""
    rank = F.col("rank")
    if c.kind == "integer":
        most = {16: 2**15, 32: 2**31}.get(c.bits, 2**63) - 1
        above = F.greatest(top, F.lit(0)).cast("long")
        return F.when(above <= F.lit(most).cast("long") - rank, above + rank).otherwise(rank).cast(c.spark_type())
    if c.kind in ("decimal", "money"):
        return (F.greatest(F.ceil(top), F.lit(0)) + rank).cast(c.spark_type())
    if c.kind in ("date", "timestamp"):
        return finished(F.lit(instants.millis("2025-01-01")).cast("long") + rank * (instants.DAY if c.kind == "date" else 1000), c)
    if c.kind == "uuid":
        return uuid(Draw(config.seed, f"anon.{t.key}.{c.name}", rank, 0, config.rng))
    if c.kind == "bytea":
        return F.unhex(F.md5(F.concat_ws("|", F.lit(str(config.seed)), rank.cast("string"))))
    if c.kind != "text" or distil(t.checks).get(c.name) is not None:
        return fake(schema, t, c, config, rank)  # labels and checked texts have no room for a number
    made, shown = fake(schema, t, c, config, rank), rank.cast("string")
    if c.length is not None:
        if c.length < 8:
            return F.lpad(F.lower(F.hex(rank)), c.length, "0")
        made = F.substr(made, F.lit(1), F.greatest(F.lit(c.length) - F.char_length(shown) - 2, F.lit(0)))
    at = F.instr(made, "@")
    return F.when(at > 0, F.concat(F.substring_index(made, "@", 1), F.lit("."), shown, F.lit("@"), F.substring_index(made, "@", -1))).otherwise(F.concat(made, F.lit("-"), shown))


def mapping(schema: Schema, frames: dict[str, DataFrame], members: list[tuple[str, str]], t: Table, c: Column, config: Config) -> DataFrame:
    """(real__, fake__) over the distinct values of all members, by the generator of column c of t."""
    kind = c.spark_type()
    reals = reduce(DataFrame.union, [frames[k].select(F.col(m).cast(kind).alias(REAL)) for k, m in members if k in frames]).where(F.col(REAL).isNotNull()).distinct()
    ranked = dense_rank(reals.withColumn("order_", F.md5(F.col(REAL).cast("string"))), ["order_", REAL]).withColumn("rank", F.col("rank").cast("long"))
    top = F.lit(None)
    if c.kind in ("integer", "decimal", "money"):
        top = F.lit(reals.agg(F.max(REAL)).first()[0] or 0)
    return cut(ranked.select(REAL, injective(schema, t, c, config, top).alias(FAKE)))


def anonymize(schema: Schema, frames: dict[str, DataFrame], config: Config) -> dict[str, DataFrame]:
    """frames (by table key) with their columns scrubbed; tables without rows of their own stay out."""
    scrubs, _ = plan(schema, config)
    groups = key_groups(schema)
    maps: dict[int, tuple[DataFrame, Column]] = {}
    for k in {s.group for s in scrubs if s.group is not None}:
        key, name = representative(schema, groups[k])
        t = schema.tables[key]
        c = t.column(name)
        maps[k] = mapping(schema, frames, groups[k], t, c, config), c
    out = {}
    for key, rows in frames.items():
        t = schema.tables[key]
        own = [s for s in scrubs if s.table == key and s.column in rows.columns]
        pure = {}
        for s in own:
            c = t.column(s.column)
            limited = bool(c.labels) or lookup(config.columns, t, c.name) is not None and not s.unique
            if s.group is None and (not s.unique or limited):
                pure[c.name] = F.when(F.col(c.name).isNotNull(), fake(schema, t, c, config, number(F.col(c.name), c.kind)))
                continue
            table, kind = maps[s.group] if s.group is not None else (mapping(schema, frames, [(key, c.name)], t, c, config), c)
            side = table.select(F.col(REAL).alias(f"{REAL}{c.name}"), F.col(FAKE).cast(c.spark_type()).alias(f"{FAKE}{c.name}"))
            rows = rows.join(side, F.col(c.name).cast(kind.spark_type()) == F.col(f"{REAL}{c.name}"), "left").withColumn(c.name, F.col(f"{FAKE}{c.name}")).drop(f"{REAL}{c.name}", f"{FAKE}{c.name}")
        out[key] = rows.withColumns(pure).select(*frames[key].columns) if pure else rows.select(*frames[key].columns)
    return out
