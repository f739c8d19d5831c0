"""Appending to tables that hold data: ids go on, parents are what is there."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.checks import distil
from weftline.functions.draw import Draw
from weftline.functions.generators import key_of_partition
from weftline.operators.engine import Config, Pool, generate, pool_of, synthetic
from weftline.sources.model import Schema, Table, lookup

#: Rows of pool(), a bounded pool; append() lends whole parents.
PARENTS = 100_000


def targets(schema: Schema, rows: dict[str, int]) -> dict[str, int]:
    """Tables by key with the rows to add; only those named, with more than none."""
    return {schema.find(k).key: n for k, n in rows.items() if n > 0}


def next_id(df: DataFrame, column: str) -> int:
    """One above the largest id; 1 for an empty table."""
    return int(df.agg(F.max(column)).first()[0] or 0) + 1


def pool(df: DataFrame, table: Table, columns: list[str]) -> DataFrame:
    """(rank, columns): the first PARENTS rows by primary key, ranked. Bounded, so one task numbers them."""
    order = list(table.primary) or columns
    some = df.select(*dict.fromkeys([*order, *columns])).orderBy(*order).limit(PARENTS)
    return some.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select("rank", *columns)


def natural(table: Table, config: Config) -> str | None:
    """A single integer primary key whose values nothing else sets: no foreign key, setting, spread, CHECK or partition."""
    if len(table.primary) != 1:
        return None
    c = table.column(table.primary[0])
    if c.kind != "integer" or c.generated or table.foreign_of(c.name) or c.name in distil(table.checks):
        return None
    ruled = lookup(config.columns, table, c.name) is not None or lookup(config.distributions, table, c.name) is not None
    return None if ruled or key_of_partition(Draw(config.seed, table.key, F.lit(0)), c, table.partition) is not None else c.name


def numbered(schema: Schema, frames: dict[str, DataFrame], grown: dict[str, int], config: Config) -> tuple[Schema, dict[str, int]]:
    """The model with all keys that number on marked as numbered, and their first new ids.

    A key that the database doesn't fill is drawn only where numbers above the largest
    one would not fit its type: draws find few free keys, or none, in a table that has
    taken most of their range.
    """
    model, starts = Schema(dict(schema.tables)), {}
    for k in grown:
        t = schema.tables[k]
        own, key = synthetic(t), synthetic(t) or natural(t, config)
        if k not in frames or not key:
            continue
        start = next_id(frames[k], key)
        if own or start + grown[k] <= 1 << t.column(key).bits - 1:
            starts[k] = start
            model.add(replace(t, columns=tuple(replace(c, identity=c.identity or c.name == key) for c in t.columns)))
    return model, starts


def append(spark: SparkSession, schema: Schema, frames: dict[str, DataFrame], config: Config) -> dict[str, DataFrame]:
    """New rows for the tables that config.rows names, none of whose keys are taken.

    Grown tables number on from their largest id, also where it is a plain integer key
    (see numbered); tables that aren't grown lend all of their rows as parents, ranked by
    primary key, and nothing else is generated.
    """
    grown = targets(schema, config.rows)
    pools: dict[str, Pool] = {}
    referred: dict[str, set[str]] = {}
    for f in (f for k in grown for f in schema.tables[k].foreign if f.parent not in grown):
        referred.setdefault(f.parent, set()).update(f.parent_columns)
    for key, columns in referred.items():
        t = schema.tables.get(key)
        if t is not None and key in frames:
            pools[key] = pool_of(frames[key], t, frames[key].count(), columns=columns)
    model, starts = numbered(schema, frames, grown, config)
    return generate(spark, model, config, only=grown, pools=pools, starts=starts, taken={k: frames[k] for k in grown if k in frames})
