"""Referentially complete subsets: root rows and every row they need, to a fixpoint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import cyclic_tables, order
from weftline.sources.model import ForeignKey, Schema, Table
from weftline.sources.scratch import cut, written


def roots(df: DataFrame, table: Table, n: int) -> DataFrame:
    """The first n rows by primary key; by all columns where there is none."""
    return df.orderBy(*(table.primary or table.names())).limit(n)


def identity(df: DataFrame, table: Table) -> DataFrame:
    return df.dropDuplicates(list(table.primary)) if table.primary else df.distinct()


def wanted(children: DataFrame, fk: ForeignKey) -> DataFrame:
    """Distinct key tuples of a foreign key without nulls, named k0, k1, ..."""
    keys = children.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(fk.columns)))
    return keys.dropna().distinct()


def holding(parents: DataFrame, columns: tuple[str, ...], keys: DataFrame) -> DataFrame:
    """Parent rows with one of the keys (k0, k1, ...)."""
    on: list[Column] = [parents[p] == keys[f"k{i}"] for i, p in enumerate(columns)]
    return parents.join(keys, reduce(lambda a, b: a & b, on), "left_semi")


def referred(parents: DataFrame, children: DataFrame, fk: ForeignKey) -> DataFrame:
    """Parent rows that children refer to."""
    return holding(parents, fk.parent_columns, wanted(children, fk))


def closure(schema: Schema, frames: dict[str, DataFrame], start: dict[str, int]) -> dict[str, DataFrame]:
    """start: root table (key or name) -> number of rows. A frame for each table that has rows to give.

    Without cycles tables are visited children first. The keys that a table's rows refer to
    are written once, so a frame reads its own table and keys, not all that led to it. A table on a cycle
    is closed by rounds: each takes the parents of the rows that are new, until none is;
    every round is a checkpoint.
    """
    chosen: dict[str, list[DataFrame]] = {}
    for name, n in start.items():
        t = schema.find(name)
        chosen.setdefault(t.key, []).append(roots(frames[t.key], t, n))
    looped = cyclic_tables(schema)
    if looped:
        return rounds(schema, frames, chosen)
    done: dict[str, DataFrame] = {}
    asked: dict[tuple[str, tuple[str, ...]], list[DataFrame]] = {}
    for key in reversed(order(schema)[0]):
        t = schema.tables[key]
        parts = list(chosen.get(key, []))
        for (parent, columns), keys in asked.items():
            if parent == key:
                parts.append(holding(frames[key], columns, reduce(DataFrame.unionByName, keys).distinct()))
        if not parts:
            continue
        done[key] = identity(reduce(DataFrame.unionByName, parts), t) if len(parts) > 1 or not t.primary else parts[0]
        links = [f for f in t.foreign if f.parent in frames]
        if links:
            slim = written(done[key].select(*dict.fromkeys(c for f in links for c in f.columns)).distinct())
            for f in links:
                asked.setdefault((f.parent, tuple(f.parent_columns)), []).append(wanted(slim, f))
    return done


def rounds(schema: Schema, frames: dict[str, DataFrame], chosen: dict[str, list[DataFrame]]) -> dict[str, DataFrame]:
    """The closure for any graph: only rows that are new look for parents."""
    have: dict[str, DataFrame] = {}
    new = {k: cut(identity(reduce(DataFrame.unionByName, v), schema.tables[k])) for k, v in chosen.items()}
    while new:
        for k, rows in new.items():
            have[k] = cut(have[k].unionByName(rows)) if k in have else rows
        found: dict[str, list[DataFrame]] = {}
        for k, rows in new.items():
            for f in schema.tables[k].foreign:
                if f.parent in frames:
                    found.setdefault(f.parent, []).append(referred(frames[f.parent], rows, f))
        new = {}
        for k, parts in found.items():
            t = schema.tables[k]
            rows = identity(reduce(DataFrame.unionByName, parts), t)
            if k in have:
                on = list(t.primary) or t.names()
                old = have[k].select(*(F.col(c).alias(f"o_{c}") for c in on))
                rows = rows.join(old, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in on)), "left_anti")
            rows = cut(rows)
            if not rows.isEmpty():
                new[k] = rows
    return have
