"""The command line: generate, append to, or subset and anonymize relational tables."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from weftline.operators.anonymize import anonymize, plan
from weftline.operators.append import append
from weftline.operators.closure import closure
from weftline.operators.engine import generate
from weftline.operators.graph import order
from weftline.operators.temporal import window
from weftline.plans import preview, settings
from weftline.sources import catalog, ddl, sinks
from weftline.sources.session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("weftline", description=__doc__)
    many = {"nargs": "+", "action": "extend", "default": []}
    p.add_argument("connection", nargs="?", default=os.environ.get("DATABASE_URL"), help="a database URL, a SQLite file, or a folder of Parquet tables")
    p.add_argument("-r", "--rows", metavar="TABLE=N", **many)
    p.add_argument("-d", "--default-rows", type=int)
    p.add_argument("-s", "--seed", type=int)
    p.add_argument("--since")
    p.add_argument("--until")
    p.add_argument("--batch-size", type=int, default=sinks.BATCH, help="rows of one INSERT in written statements")
    p.add_argument("--schema", metavar="NAME", **many)
    p.add_argument("--skip", metavar="TABLE", **many)
    p.add_argument("--distribution", metavar="COLUMN=KIND", **many)
    p.add_argument("-C", "--column", metavar="COLUMN=GENERATOR", **many)
    p.add_argument("-c", "--config")
    p.add_argument("--schema-file")
    p.add_argument("--dialect", choices=("postgres", "mysql", "sqlite"), default=None)
    p.add_argument("--schema-dialect", choices=("postgres", "mysql", "sqlite"))
    p.add_argument("-o", "--out")
    p.add_argument("--print", action="store_true", dest="show")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--append", action="store_true")
    p.add_argument("--truncate", action="store_true")
    p.add_argument("--subset", metavar="TABLE=N", **many)
    p.add_argument("--to")
    p.add_argument("--anonymize", metavar="COLUMN", **many)
    p.add_argument("--preserve", metavar="COLUMN", **many)
    p.add_argument("--rng", choices=("md5", "xxhash64"))
    return p


def refuse(p: argparse.ArgumentParser, a: argparse.Namespace) -> None:
    """Modes that exclude each other, before anything is read."""
    offline = a.schema_file is not None
    if not a.connection and not offline:
        p.error("no connection: name one, or set DATABASE_URL")
    if offline and (a.append or a.subset or a.to):
        p.error("--schema-file has no rows to append to or to take")
    if offline and not (a.out or a.show or a.dry_run):
        p.error("--schema-file needs -o, --print or --dry-run")
    if a.append and (a.subset or a.truncate):
        p.error("--append goes with neither --subset nor --truncate")
    if a.append and not a.rows:
        p.error("--append needs --rows")
    if a.subset and not (a.out or a.show or a.to or a.dry_run):
        p.error("--subset needs --to, -o, --print or --dry-run; the source is never written")
    if a.out and a.show:
        p.error("-o and --print exclude each other")


def open_sink(connection: str, truncate: bool):
    dialect = catalog.dialect_of(connection)
    if dialect == "sqlite":
        return sinks.Sqlite(catalog.sqlite_file(connection), truncate)
    if dialect == "parquet":
        return sinks.Parquet(connection.removeprefix("parquet:"))
    url, properties = catalog.jdbc_url(connection)
    return sinks.Jdbc(url, dialect, truncate, **properties)


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    refuse(p, a)
    try:
        found = settings.load(a.config)
        config = settings.config(found, rows=settings.rows(a.rows), default_rows=a.default_rows, columns=settings.columns(a.column), distributions=settings.distributions(a.distribution), skip=tuple(a.skip), seed=a.seed, since=a.since, until=a.until, anonymize=tuple(a.anonymize), preserve=tuple(a.preserve), rng=a.rng)
        window(config.since, config.until)
        roots = settings.rows(a.subset)
    except (ValueError, OSError) as x:
        p.error(str(x))
    spark = session("*")
    frames = {}
    if a.schema_file:
        schema = ddl.load(Path(a.schema_file).read_text(), a.schema_dialect or a.dialect or "postgres")
    else:
        schema, frames = catalog.connect(spark, a.connection, a.schema or None)
    out_dialect = a.dialect or (catalog.dialect_of(a.connection) if a.connection and not a.schema_file else "postgres")
    out_dialect = "postgres" if out_dialect == "parquet" else out_dialect
    mode = "subset" if roots else "append" if a.append else "generate"
    # rows for a folder of Parquet are written there as they are made
    published = sinks.Parquet(a.connection.removeprefix("parquet:")) if mode == "generate" and not (a.show or a.out or a.dry_run) and catalog.dialect_of(a.connection) == "parquet" else None
    try:
        if mode == "subset":
            for warning in plan(schema, config)[1]:
                print(f"warning: {warning}", file=sys.stderr)
            taken = closure(schema, frames, roots)
            made = anonymize(schema, {k: taken[k] for k in order(schema)[0] if k in taken}, config)
            if a.dry_run:
                print(preview.report(preview.of_subset(schema, made), mode))
                return 0
        elif a.dry_run:
            entries = preview.of_append(spark, schema, frames, config) if a.append else preview.of_generate(spark, schema, config)
            print(preview.report(entries, mode))
            return 0
        else:
            made = append(spark, schema, frames, config) if a.append else generate(spark, schema, config, store=published.keep if published else None)
    except (ValueError, KeyError) as x:
        print(f"error: {x}", file=sys.stderr)
        return 1
    if a.show:
        for line in sinks.script(schema, made, out_dialect):
            print(line)
    elif a.out:
        sinks.save_script(sinks.script(schema, made, out_dialect), a.out)
    elif published is not None:
        published.publish()
    else:
        sink = open_sink(a.to if roots else a.connection, a.truncate)
        try:
            sinks.into(schema, made, sink)
        except BaseException:
            if hasattr(sink, "close"):
                sink.close(failed=True)
            raise
        if hasattr(sink, "close"):
            sink.close()
        if hasattr(sink, "publish"):
            sink.publish()
    counts = {k: df.count() for k, df in made.items()}
    print(f"{sum(counts.values())} rows into {len(counts)} tables: " + ", ".join(f"{k} {n}" for k, n in counts.items()), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
