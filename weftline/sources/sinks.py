"""Where generated or subset tables go: Parquet, JDBC, SQL scripts, COPY files, SQLite.

Each table is written by its own job. There is no transaction over several tables, so
``parquet`` stages into a folder and publishes it as a whole at the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftline.functions.literals import copy_line, row
from weftline.sources.model import Column, Schema, Table

#: Rows of one INSERT in scripts that are written by the cluster.
BATCH = 1000
#: Values bound in one statement, at most.
BINDS = 900


class Sink(Protocol):
    def write(self, table: Table, rows: DataFrame) -> int:
        """Write the rows, and give back how many there were."""


def quoted(name: str, dialect: str) -> str:
    mark = "`" if dialect == "mysql" else '"'
    return mark + name.replace(mark, mark * 2) + mark


def reference(table: Table, dialect: str) -> str:
    """The table's name; Postgres names carry their schema."""
    return f"{quoted(table.schema, dialect)}.{quoted(table.name, dialect)}" if dialect == "postgres" else quoted(table.name, dialect)


def present(table: Table, rows: DataFrame) -> list[Column]:
    return [c for c in table.columns if c.name in rows.columns]


def head(table: Table, columns: list[Column], dialect: str) -> str:
    own = " OVERRIDING SYSTEM VALUE" if dialect == "postgres" and any(c.identity for c in columns) else ""
    return f"INSERT INTO {reference(table, dialect)} ({', '.join(quoted(c.name, dialect) for c in columns)}){own} VALUES"


# What opens and closes a script.
OPEN = {"postgres": ["BEGIN;"], "mysql": ["SET FOREIGN_KEY_CHECKS=0;", "START TRANSACTION;"], "sqlite": ["PRAGMA foreign_keys=OFF;", "BEGIN TRANSACTION;"]}
CLOSE = {"postgres": ["COMMIT;"], "mysql": ["COMMIT;", "SET FOREIGN_KEY_CHECKS=1;"], "sqlite": ["COMMIT;"]}


def sequence_reset(table: Table) -> str | None:
    """For Postgres: the statement that moves a serial key's sequence past the ids that were written."""
    if len(table.primary) != 1:
        return None
    c = table.column(table.primary[0])
    if c.kind != "integer" or not (c.identity or c.default):
        return None
    return f"SELECT setval(pg_get_serial_sequence('{table.schema}.{table.name}', '{c.name}'), (SELECT COALESCE(MAX({quoted(c.name, 'postgres')}), 1) FROM {reference(table, 'postgres')}), true);"


def ordered(table: Table, rows: DataFrame) -> DataFrame:
    keys = [k for k in table.primary if k in rows.columns]
    return rows.orderBy(*keys) if keys else rows


def script(schema: Schema, frames: dict[str, DataFrame], dialect: str = "postgres") -> Iterator[str]:
    """The lines of one runnable script, streamed partition by partition; for what fits one file."""
    yield from [*OPEN[dialect], ""]
    resets = []
    for key, rows in frames.items():
        t = schema.tables[key]
        n = rows.count()
        if not n:
            continue
        columns = present(t, rows)
        yield f"-- {key}: {n} rows"
        yield head(t, columns, dialect)
        for k, r in enumerate(ordered(t, rows).select(row(columns, dialect).alias("r")).toLocalIterator(), 1):
            yield f"  {r.r}{';' if k == n else ','}"
        yield ""
        if dialect == "postgres" and (reset := sequence_reset(t)):
            resets.append(reset)
    if resets:
        yield from ["", "-- reset sequences", *resets]
    yield from CLOSE[dialect]


def statements(table: Table, rows: DataFrame, dialect: str = "postgres", batch: int = BATCH) -> DataFrame:
    """(sql): INSERT statements of up to ``batch`` rows, made where the rows are; no shuffle."""
    columns = present(table, rows)
    top = head(table, columns, dialect)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        for part in batches:
            held += part["r"].tolist()
            full = len(held) // batch * batch
            yield pd.DataFrame({"sql": [top + "\n  " + ",\n  ".join(held[k : k + batch]) + ";" for k in range(0, full, batch)]})
            held = held[full:]
        if held:
            yield pd.DataFrame({"sql": [top + "\n  " + ",\n  ".join(held) + ";"]})

    return rows.select(row(columns, dialect).alias("r")).mapInPandas(pack, "sql string")


def copy_file(table: Table, rows: DataFrame) -> DataFrame:
    """(value): lines for COPY ... FROM STDIN in text format."""
    return rows.select(copy_line(present(table, rows)).alias("value"))


def cleared(table: Table, dialect: str) -> str:
    return f"TRUNCATE {reference(table, dialect)} RESTART IDENTITY CASCADE;" if dialect == "postgres" else f"DELETE FROM {reference(table, dialect)};"


def emptied(tables: list[Table], dialect: str) -> list[str]:
    """What empties tables that are given parents first: one statement in Postgres, else one a table, children first."""
    if dialect == "postgres":
        return [f"TRUNCATE {', '.join(reference(t, dialect) for t in tables)} RESTART IDENTITY CASCADE;"] if tables else []
    return [f"DELETE FROM {reference(t, dialect)};" for t in reversed(tables)]


def load_script(schema: Schema, frames: dict[str, DataFrame], truncate: bool = False) -> Iterator[str]:
    """The lines of a load for psql in one transaction: COPY of every table, then sequences. Any error rolls all back.

    Rows stream through the driver, a partition at a time, as they make one file.
    """
    tables = [schema.tables[k] for k in frames]
    yield from ["\\set ON_ERROR_STOP on", "BEGIN;", *(emptied(tables, "postgres") if truncate else [])]
    for t in tables:
        rows = frames[t.key]
        yield f"COPY {reference(t, 'postgres')} ({', '.join(quoted(c.name, 'postgres') for c in present(t, rows))}) FROM STDIN;"
        for r in copy_file(t, rows).toLocalIterator():
            yield r.value
        yield "\\."
    yield from [x for t in tables if (x := sequence_reset(t))]
    yield "COMMIT;"


class Parquet:
    """Tables as Parquet under a folder; publish() moves them there once all are written.

    A table of a schema other than ``main`` and ``public`` is called by both names.
    """

    def __init__(self, folder: str) -> None:
        self.folder, self.stage, self.names = folder.rstrip("/"), f"{folder.rstrip('/')}/_stage-{uuid.uuid4().hex}", []
        self.spark = None

    def write(self, table: Table, rows: DataFrame) -> int:
        return self.keep(table, rows).count()

    def keep(self, table: Table, rows: DataFrame) -> DataFrame:
        """Write the table, and give back what was written; for generate(store=...)."""
        self.spark = rows.sparkSession
        name = table.name if table.schema in ("main", "public") else table.key
        path = f"{self.stage}/{name}.parquet"
        rows.write.parquet(path)
        self.names.append(name)
        return self.spark.read.schema(rows.schema).parquet(path)

    def publish(self) -> None:
        """Renames within one file system; a table that is there already is replaced, and put back if that fails."""
        if self.spark is None:
            return
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(conf)
        for n in self.names:
            new, old, place = (path(x) for x in (f"{self.stage}/{n}.parquet", f"{self.stage}/{n}.old", f"{self.folder}/{n}.parquet"))
            had = fs.exists(place)
            if had and not fs.rename(place, old):
                raise OSError(f"{self.folder}/{n}.parquet could not be moved")
            if not fs.rename(new, place):
                if had:
                    fs.rename(old, place)
                raise OSError(f"{self.folder}/{n}.parquet could not be published")
        fs.delete(path(self.stage), True)


class Jdbc:
    """A database over JDBC; its driver must be on the class path. Nested values go as text.

    Tables are written by the executors, several connections a table, so there is no
    transaction over all; ``load_script`` makes one for Postgres. With truncate the
    tables are emptied first, children before parents.
    """

    def __init__(self, url: str, dialect: str = "postgres", truncate: bool = False, **properties: str) -> None:
        self.url, self.dialect, self.truncate, self.properties = url, dialect, truncate, properties

    def execute(self, spark: SparkSession, statements: list[str]) -> None:
        """In one transaction, over one connection of the driver's."""
        jvm = spark.sparkContext._jvm
        own = jvm.java.util.Properties()
        for k, v in self.properties.items():
            own.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, own)
        try:
            connection.setAutoCommit(False)
            for text in statements:
                connection.createStatement().execute(text.rstrip(";"))
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def begin(self, spark: SparkSession, tables: list[Table]) -> None:
        if self.truncate:
            self.execute(spark, emptied(tables, self.dialect))

    def finish(self, spark: SparkSession, tables: list[Table]) -> None:
        resets = [x for t in tables if (x := sequence_reset(t))] if self.dialect == "postgres" else []
        if resets:
            self.execute(spark, resets)

    def write(self, table: Table, rows: DataFrame) -> int:
        seen = Observation()
        flat = rows.observe(seen, F.count(F.lit(1)).alias("n")).select(*(F.to_json(c.name).alias(c.name) if c.kind in ("array", "composite", "range") else F.col(c.name) for c in present(table, rows)))
        writer = flat.write.format("jdbc").option("url", self.url).option("dbtable", reference(table, self.dialect)).option("batchsize", 10_000).options(**self.properties)
        writer.mode("append").save()
        return seen.get["n"]


class Sqlite:
    """A SQLite file on the driver's disk, one transaction for all tables; rows stream through the driver."""

    def __init__(self, file: str, truncate: bool = False) -> None:
        import sqlite3

        self.connection = sqlite3.connect(file, isolation_level=None)
        self.truncate = truncate
        self.connection.execute("PRAGMA foreign_keys=OFF")
        self.connection.execute("BEGIN")

    def write(self, table: Table, rows: DataFrame) -> int:
        columns, n = present(table, rows), 0
        name = quoted(table.name, "sqlite")
        if self.truncate:
            self.connection.execute(f"DELETE FROM {name}")
        flat = ordered(table, rows).select(*(bound(c).alias(c.name) for c in columns))
        per = max(1, BINDS // len(columns))
        one = f"({', '.join('?' * len(columns))})"
        top = f"INSERT INTO {name} ({', '.join(quoted(c.name, 'sqlite') for c in columns)}) VALUES "
        held: list[tuple] = []
        for r in flat.toLocalIterator():
            held.append(tuple(r))
            n += 1
            if len(held) == per:
                self.connection.execute(top + ", ".join([one] * per), [v for x in held for v in x])
                held = []
        if held:
            self.connection.execute(top + ", ".join([one] * len(held)), [v for x in held for v in x])
        return n

    def close(self, failed: bool = False) -> None:
        self.connection.execute("ROLLBACK" if failed else "COMMIT")
        self.connection.close()


def bound(c: Column):
    """A value as SQLite binds it: numbers, texts, bytes."""
    from weftline.functions.literals import interval, iso

    v = F.col(c.name)
    if c.kind == "boolean":
        return v.cast("int")
    if c.kind in ("date", "timestamp"):
        return iso(v, c.kind)
    if c.kind in ("array", "composite", "range"):
        return F.to_json(v)
    if c.kind == "interval":
        return interval(v)
    if c.kind in ("decimal", "money"):
        return v.cast("double")
    return v


def into(schema: Schema, frames: dict[str, DataFrame], sink: Sink) -> dict[str, int]:
    """Write every table, parents first as they come, and count the rows as they pass."""
    tables = [schema.tables[k] for k in frames]
    spark = next((df.sparkSession for df in frames.values()), None)
    for step in ("begin", "write", "finish"):
        if step == "write":
            counts = {key: sink.write(schema.tables[key], rows) for key, rows in frames.items()}
        elif spark is not None and hasattr(sink, step):
            getattr(sink, step)(spark, tables)
    return counts


def save_script(lines: Iterator[str], file: str) -> None:
    with Path(file).open("w") as f:
        f.writelines(x + "\n" for x in lines)
