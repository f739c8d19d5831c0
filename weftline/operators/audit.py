"""Integrity audits. Each is one row, or one row a subject, with counts; never an empty set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.model import ForeignKey, Schema, Table


def tally(df: DataFrame, subject: str, bad: Column) -> DataFrame:
    """(subject, violations): rows where ``bad`` is true."""
    return df.agg(F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).cast("long").alias("violations")).select(F.lit(subject).alias("subject"), "violations")


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    return together([df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(k.split(".")[-1]).alias("table_name"), "n_rows") for k, df in frames.items()])


def orphans(children: DataFrame, fk: ForeignKey, parents: DataFrame) -> DataFrame:
    """Child rows whose key, with no null in it, has no parent."""
    keys = parents.select(*(F.col(p).alias(f"p{i}") for i, p in enumerate(fk.parent_columns)))
    whole = children.dropna(subset=list(fk.columns))
    return whole.join(keys, reduce(lambda a, b: a & b, (F.col(c) == F.col(f"p{i}") for i, c in enumerate(fk.columns))), "left_anti")


def orphan_counts(schema: Schema, frames: dict[str, DataFrame]) -> DataFrame:
    parts = [orphans(frames[k], f, frames[f.parent]).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"{t.name}.{','.join(f.columns)}").alias("subject"), "violations") for k, t in schema.tables.items() for f in t.foreign]
    return together(parts)


def duplicates(df: DataFrame, columns: list[str], subject: str) -> DataFrame:
    """(subject, violations): rows beyond the first of each key; nulls are equal."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("violations")).select(F.lit(subject).alias("subject"), "violations")


def key_collisions(schema: Schema, frames: dict[str, DataFrame]) -> DataFrame:
    return together([duplicates(frames[k], list(c), f"{t.name}.{','.join(c)}") for k, t in schema.tables.items() for c in t.key_sets()])


def null_counts(df: DataFrame, table: str) -> DataFrame:
    """(column_name, n_null) for every column in one pass."""
    one = df.agg(*(F.coalesce(F.sum(F.col(c).isNull().cast("int")), F.lit(0)).cast("long").alias(c) for c in df.columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f"{table}.{c}").alias("column_name"), F.col(c).alias("n_null")) for c in df.columns))).alias("e")).select("e.*")


def fan_out(children: DataFrame, column: str) -> DataFrame:
    """(parent, n_children)."""
    return children.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("parent")).agg(F.count(F.lit(1)).alias("n_children"))


def half_cover(children: DataFrame, column: str) -> DataFrame:
    """(n_parents, n_half): how few parents hold half of the children.

    Fan-outs are counted by size first, so the running total is over distinct sizes.
    """
    by_size = fan_out(children, column).groupBy("n_children").agg(F.count(F.lit(1)).alias("parents"))
    down = Window.orderBy(F.desc("n_children")).rowsBetween(Window.unboundedPreceding, -1)
    run = by_size.withColumn("ahead", F.coalesce(F.sum(F.col("n_children") * F.col("parents")).over(down), F.lit(0)))
    total = by_size.agg(F.sum(F.col("n_children") * F.col("parents")).alias("total"), F.sum("parents").alias("n_parents"))
    need = F.least(F.col("parents"), F.greatest(F.lit(0), F.expr("(total - 2 * ahead + 2 * n_children - 1) div (2 * n_children)")))
    return run.join(F.broadcast(total)).agg(F.max("n_parents").cast("long").alias("n_parents"), F.coalesce(F.sum(need), F.lit(0)).cast("long").alias("n_half"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """(label, n) of a column."""
    return df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def routing(df: DataFrame, bucket: Column, children: DataFrame) -> DataFrame:
    """(bucket, n_parent, n_child): rows of a partitioned table and of its parts agree."""
    a = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_parent"))
    b = children.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_child"))
    return a.join(b, "bucket", "full").select("bucket", F.coalesce("n_parent", F.lit(0)).cast("long").alias("n_parent"), F.coalesce("n_child", F.lit(0)).cast("long").alias("n_child"))


def leaks(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """(violations): rows of ``after`` that hold an original value."""
    old = before.select(F.col(column).alias("o_")).dropna().distinct()
    return after.join(old, F.col(column) == F.col("o_"), "left_semi").agg(F.count(F.lit(1)).alias("violations"))


def inconsistent(pairs: DataFrame, original: str, fake: str) -> DataFrame:
    """(violations): originals with more than one fake."""
    return pairs.groupBy(original).agg(F.count_distinct(fake).alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("int")), F.lit(0)).cast("long").alias("violations"))


def table_audit(table: Table, df: DataFrame, bounds: dict) -> DataFrame | None:
    """Violations of the distilled CHECK bounds, a row for each column that has some."""
    from weftline.functions.checks import violates

    parts = [tally(df, f"{table.name}.{c}", violates(b, F.col(c), table.column(c).kind)) for c, b in bounds.items() if c in df.columns]
    return together(parts) if parts else None
