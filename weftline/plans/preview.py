"""Dry runs: what a run would write, with sample rows, and nothing written."""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from weftline.operators.append import append, targets
from weftline.operators.engine import Config, generate
from weftline.operators.graph import cyclic_tables, order
from weftline.sources.model import Schema

SAMPLE = 3
# The report's first line.
HEADS = {"generate": "Plan (dry run — nothing was written):", "append": "Append plan (dry run — existing rows read, nothing written):", "subset": "Subset plan (dry run — source read, nothing written):"}


@dataclass(frozen=True)
class Entry:
    key: str
    rows: int
    cyclic: bool
    skipped: bool
    sample: tuple[dict, ...] = ()


def sampled(df: DataFrame | None) -> tuple[dict, ...]:
    return tuple(r.asDict(recursive=True) for r in df.limit(SAMPLE).collect()) if df is not None else ()


def capped(config: Config) -> Config:
    return replace(config, rows={k: min(v, SAMPLE) for k, v in config.rows.items()}, default_rows=min(config.default_rows, SAMPLE))


def of_generate(spark: SparkSession, schema: Schema, config: Config, samples: bool = True) -> list[Entry]:
    """Planned counts; samples come from a run of SAMPLE rows a table."""
    loops = cyclic_tables(schema)
    made = generate(spark, schema, capped(config), lazy=True) if samples else {}
    return [Entry(k, 0 if config.skips(schema.tables[k]) else config.count(schema.tables[k]), k in loops, config.skips(schema.tables[k]), sampled(made.get(k))) for k in order(schema)[0]]


def of_append(spark: SparkSession, schema: Schema, frames: dict[str, DataFrame], config: Config, samples: bool = True) -> list[Entry]:
    """Only the tables that grow."""
    loops, grown = cyclic_tables(schema), targets(schema, config.rows)
    made = append(spark, schema, frames, capped(config)) if samples else {}
    return [Entry(k, grown[k], k in loops, False, sampled(made.get(k))) for k in order(schema)[0] if k in grown]


def of_subset(schema: Schema, frames: dict[str, DataFrame]) -> list[Entry]:
    """Exact counts and real (anonymized) rows, parents first."""
    loops = cyclic_tables(schema)
    return [Entry(k, frames[k].count(), k in loops, False, sampled(frames[k])) for k in order(schema)[0] if k in frames]


def shown(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    text = value if isinstance(value, str) else json.dumps(value, default=str) if isinstance(value, (dict, list, bool)) else str(value)
    text = text[:37] + "…" if len(text) > 40 else text
    return f"'{text}'" if isinstance(value, str) else text


def report(entries: list[Entry], mode: str = "generate") -> str:
    width = max([5, *(len(e.key) for e in entries)])
    out = [HEADS[mode], "", f"  {'#':>3}  {'table':<{width}}  {'rows':>9}"]
    for i, e in enumerate(entries, 1):
        marks = ", ".join(m for m, on in (("cyclic", e.cyclic), ("skipped", e.skipped)) if on)
        out.append(f"  {i:>3}  {e.key:<{width}}  {e.rows:>9}" + (f"  ({marks})" if marks else ""))
    filled = f"{sum(e.rows > 0 for e in entries)} tables"
    out += [f"  {'':3}  {'':<{width}}  {'─' * 9}", f"  {'':3}  {filled:<{width}}  {sum(e.rows for e in entries):>9}"]
    if any(e.sample for e in entries):
        out += ["", "Sample rows:"]
        for e in entries:
            if e.sample:
                out += ["", f"  {e.key}", *("    { " + ", ".join(f"{k}: {shown(v)}" for k, v in r.items()) + " }" for r in e.sample)]
    return "\n".join(out)
