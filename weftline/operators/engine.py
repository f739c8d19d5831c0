"""Generation of a whole model: parents first, one lazy frame a table, draws by row number.

A row's values come in this order: ids and foreign keys, generators, nulls, instants,
coherence, uniqueness. Every draw depends on (seed, table, column, row, attempt) alone.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import instants
from weftline.functions.checks import Bounds, distil
from weftline.functions.draw import Draw
from weftline.functions.generators import NULLS, Context, finished, key_of_partition, value
from weftline.functions.spread import Spread
from weftline.operators import coherence, temporal
from weftline.operators.foreign import assign, self_parent
from weftline.operators.graph import order
from weftline.operators.numbering import dense_rank
from weftline.sources.model import Column, ForeignKey, Schema, Table, lookup
from weftline.sources.scratch import cut, written

#: Draws of a row until its keys are new; then the row is given up.
ATTEMPTS = 25
DEFAULT_ROWS = 10


@dataclass
class Config:
    """Settings of a run; keys of ``rows`` are table names or keys, of the others column names."""

    rows: dict[str, int] = field(default_factory=dict)
    default_rows: int = DEFAULT_ROWS
    columns: dict = field(default_factory=dict)
    distributions: dict[str, Spread] = field(default_factory=dict)
    skip: tuple[str, ...] = ()
    seed: int = 0
    since: str | None = None
    until: str | None = None
    anonymize: tuple[str, ...] = ()
    preserve: tuple[str, ...] = ()
    rng: str = "xxhash64"

    def count(self, table: Table) -> int:
        return next((self.rows[k] for k in (table.name, table.key) if k in self.rows), self.default_rows)

    def skips(self, table: Table) -> bool:
        return table.name in self.skip or table.key in self.skip


@dataclass
class Pool:
    """Parent rows: frame (rank from 1, own key columns, created_ as milliseconds if there is such a column) and their number.

    dense: (column, first id) where ranks are ids less a constant.
    """

    frame: DataFrame
    n: int
    dense: tuple[str, int] | None = None


def synthetic(table: Table) -> str | None:
    """The column that is numbered 1, 2, ...: a single integer primary key that the database would fill, and no foreign key."""
    if len(table.primary) != 1:
        return None
    c = table.column(table.primary[0])
    return c.name if c.kind == "integer" and (c.identity or c.default) and not table.foreign_of(c.name) else None


def emitted(table: Table, columns: dict) -> list[Column]:
    """Columns that are written: none that the database computes or, unsupported, fills itself."""
    return [c for c in table.columns if not c.generated and not (c.kind == "unsupported" and (c.default or c.identity) and lookup(columns, table, c.name) is None)]


def refused(schema: Schema, config: Config) -> list[str]:
    """Columns that must have a value of a type that can't be made."""
    return [f"{t.key}.{c.name}" for t in schema.tables.values() if not config.skips(t) for c in t.columns if c.kind == "unsupported" and not c.nullable and not c.default and not c.identity and lookup(config.columns, t, c.name) is None and not t.foreign_of(c.name)]


def governed(table: Table, fk: ForeignKey, spreads: dict[str, Spread]) -> Spread:
    """The first column of a key with a spread governs it; weights mean nothing for parents."""
    found = next((s for c in fk.columns if (s := lookup(spreads, table, c)) is not None), Spread())
    return found if found.kind != "weighted" else Spread()


def pool_of(rows: DataFrame, table: Table, n: int, first: int | None = None, columns: set[str] | None = None) -> Pool:
    """A pool from a finished table's rows (or some of them); columns: those that children refer to (None: all)."""
    born = temporal.anchor(table)
    extra = [instants.ms_of(F.col(born), table.column(born).kind).alias("created_")] if born else []
    key = synthetic(table)
    if key and first is not None:
        return Pool(rows.select((F.col(key) - first + 1).cast("long").alias("rank"), "*", *extra), n, (key, first))
    order = list(table.primary) or table.names()
    held = rows.columns if columns is None else [c for c in rows.columns if c in columns or c in order]
    ranked = dense_rank(rows.select(*held, *extra), order)
    return Pool(ranked.withColumn("rank", F.col("rank").cast("long")), n)


class Maker:
    """Candidates of one table: build() turns (i, attempt) into rows."""

    def __init__(self, spark: SparkSession, table: Table, config: Config, pools: dict[str, Pool], start: int = 1) -> None:
        self.spark, self.table, self.config, self.pools, self.start = spark, table, config, pools, start
        self.bounds: dict[str, Bounds] = distil(table.checks)
        self.window = temporal.window(config.since, config.until)
        self.context = Context(config.columns, config.distributions, self.window.until)
        self.key = synthetic(table)
        self.draw = Draw(config.seed, table.key, F.col("i"), F.col("attempt"), config.rng)
        self.columns = emitted(table, config.columns)
        self.unique = {c for s in table.key_sets() for c in s}
        self.injective: set[str] = set()
        #: Keys whose parents are rows of the same table with ids of their own: joined once the table is whole.
        self.selves = [f for f in table.foreign if f.parent == table.key and f.parent_columns != (self.key,)]

    def frozen(self) -> set[str]:
        """Columns that the passes leave alone: overridden, keys of partitions, foreign keys, and under a CHECK."""
        t = self.table
        named = {c.name for c in t.columns if lookup(self.config.columns, t, c.name) is not None or lookup(self.config.distributions, t, c.name) is not None or c.name in self.bounds or t.foreign_of(c.name)}
        return named | {c.name for c in t.columns if key_of_partition(self.draw, c, t.partition) is not None}

    def with_parents(self, rows: DataFrame) -> tuple[DataFrame, dict[str, Col], Col | None]:
        """rows joined to a parent for each key; the key columns' values; the latest creation among parents."""
        t, values, floors = self.table, {}, []
        for k, fk in enumerate(t.foreign):
            mine = [c for c in fk.columns if t.foreign_of(c) is fk]
            draw = self.draw.of(f"{t.key}.fk{k}")
            if fk.parent == t.key:
                nullable = all(t.column(c).nullable for c in fk.columns)
                if fk.parent_columns == (self.key,):
                    values |= {c: self_parent(draw, F.col("i"), nullable, self.start) for c in mine}
                else:
                    values |= {c: F.lit(None) for c in mine}
                continue
            pool = self.pools.get(fk.parent)
            if pool is None or not pool.n:
                if needed := [c for c in mine if not t.column(c).nullable]:
                    raise ValueError(f"{t.key}: no parent rows in {fk.parent} for {', '.join(needed)}")
                values |= {c: F.lit(None) for c in mine}
                continue
            spread, born = governed(t, fk, self.config.distributions), "created_" in pool.frame.columns and temporal.anchor(t) is not None
            if pool.dense and fk.parent_columns == (pool.dense[0],) and spread.kind == "uniform" and not born:
                values |= {c: draw.below(pool.n) + pool.dense[1] for c in mine}
                continue
            held = pool.frame.select("rank", *(F.col(p).alias(f"fk{k}_{j}") for j, p in enumerate(fk.parent_columns)), *([F.col("created_").alias(f"born{k}")] if born else []))
            rows = assign(rows, draw, held, pool.n, spread)
            values |= {c: F.col(f"fk{k}_{fk.columns.index(c)}") for c in mine}
            if born:
                floors.append(F.col(f"born{k}"))
        floor = None if not floors else floors[0] if len(floors) == 1 else F.greatest(*floors)
        return rows, values, floor

    def build(self, rows: DataFrame) -> DataFrame:
        """(i, attempt, columns) for rows (i, attempt)."""
        t, frozen = self.table, self.frozen()
        rows, parents, floor = self.with_parents(rows)
        made: list[Col] = []
        for c in self.columns:
            d = self.draw.of(f"{t.key}.{c.name}")
            if c.name == self.key:
                v = (F.col("i") + self.start).cast("long")
            elif c.name in parents:
                v = parents[c.name]
                v = instants.ms_of(v, c.kind) if c.kind in ("date", "timestamp") else v
            else:
                v = value(d, t, c, self.bounds.get(c.name), self.context)
                if c.nullable and c.name not in self.unique and key_of_partition(d, c, t.partition) is None and not (isinstance(lookup(self.config.columns, t, c.name), dict) and "value" in lookup(self.config.columns, t, c.name)):
                    v = F.when(d.of(f"{t.key}.{c.name}.null").u() >= NULLS, v)
            made.append(v.cast("long").alias(c.name) if c.kind in ("date", "timestamp") else v.alias(c.name))
        rows = rows.select("i", "attempt", *([floor.alias("floor_")] if floor is not None else []), *made)
        rows = temporal.coherent(rows, t, self.draw, self.window, F.col("floor_") if floor is not None else None, frozen)
        rows = coherence.coherent(rows, t, self.draw, frozen)
        return rows.select("i", "attempt", *(self.told_apart(c, frozen).alias(c.name) for c in self.columns))

    def told_apart(self, c: Column, frozen: set[str]) -> Col:
        """The finished column; a text that must be unique by itself carries the row's number, so no round is lost on it."""
        v = finished(F.col(c.name), c)
        alone = (c.name,) in self.table.key_sets()
        if not alone or c.kind != "text" or c.name in frozen or c.length is not None and c.length < 24:
            return v
        self.injective.add(c.name)
        n = (F.col("i") + self.start).cast("string")
        room = F.substring(v, 1, c.length - 13) if c.length is not None else v
        at = F.instr(room, "@")
        return F.when(at > 0, F.concat(F.substring_index(room, "@", 1), F.lit("."), n, F.lit("@"), F.substring_index(room, "@", -1))).otherwise(F.concat(room, F.lit("-"), n))


def distinct_rows(maker: Maker, n: int, taken: DataFrame | None) -> tuple[DataFrame, bool]:
    """n candidate rows at most, no two alike in any key set (null is a value like others), and whether all have one.

    Rows that lose draw again, ATTEMPTS times at most; who holds a key keeps it. taken:
    rows that are there already. Each round is a checkpoint; without key sets that can
    clash there is no round.
    """
    todo = maker.spark.range(n).select(F.col("id").alias("i"), F.lit(0).alias("attempt"))
    rows = maker.build(todo)
    single = {(maker.key,), *((c,) for c in maker.injective)}
    sets = [s for s in maker.table.key_sets() if s not in single and not set(s) & (maker.injective | ({maker.key} if maker.key else set()))]
    if not sets:
        return rows, True
    kept: DataFrame | None = None
    for attempt in range(ATTEMPTS):
        rows = cut(rows)
        wins = F.lit(True)
        ranked = rows
        for k, s in enumerate(sets):
            ranked = ranked.withColumn(f"nth{k}", F.row_number().over(Window.partitionBy(*s).orderBy("i")))
            wins = wins & (F.col(f"nth{k}") == 1)
        won = ranked.where(wins).drop(*(f"nth{k}" for k in range(len(sets))))
        for other in [x for x in (kept, taken) if x is not None]:
            for s in sets:
                old = other.select(*(F.col(c).alias(f"o_{c}") for c in s))
                won = won.join(old, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in s)), "left_anti")
        won = cut(won)
        kept = won if kept is None else cut(kept.unionByName(won))
        lost = rows.select("i").join(won.select("i"), "i", "left_anti")
        if attempt + 1 == ATTEMPTS or lost.isEmpty():
            return kept, kept.count() == n
        rows = maker.build(lost.select("i", F.lit(attempt + 1).alias("attempt")))
    return kept, False


def table_rows(maker: Maker, n: int, taken: DataFrame | None = None) -> DataFrame:
    """The rows of one table, ids without gaps."""
    rows, whole = distinct_rows(maker, n, taken)
    if maker.key and not whole:
        # ids and links to the own table follow the numbers that are left
        numbered = dense_rank(rows, ["i"]).withColumn("at_", (F.col("rank") - 1).cast("long")).drop("rank")
        new = {maker.key: F.col("at_") + maker.start}
        for k, fk in enumerate(maker.table.foreign):
            if fk.parent == maker.table.key and fk.parent_columns == (maker.key,):
                nullable = all(maker.table.column(c).nullable for c in fk.columns)
                d = Draw(maker.config.seed, f"{maker.table.key}.fk{k}", F.col("at_"), 0, maker.config.rng)
                new |= {c: self_parent(d, F.col("at_"), nullable, maker.start) for c in fk.columns}
        rows = numbered.withColumns(new).drop("at_")
    for k, fk in enumerate(maker.selves):
        rows = linked(maker, rows, fk, k)
    return rows.select(*(F.col(c.name).cast(c.spark_type()).alias(c.name) if c.kind not in ("date", "timestamp", "array", "composite", "range", "interval") else F.col(c.name) for c in maker.columns))


def linked(maker: Maker, rows: DataFrame, fk: ForeignKey, k: int) -> DataFrame:
    """Keys to rows of the same table that aren't its numbered id: one earlier row for the whole key."""
    nullable = all(maker.table.column(c).nullable for c in fk.columns)
    rows = cut(dense_rank(rows, ["i"]).withColumn("at_", (F.col("rank") - 1).cast("long")).drop("rank"))
    d = Draw(maker.config.seed, f"{maker.table.key}.self{k}", F.col("at_"), 0, maker.config.rng)
    rows = rows.withColumn("up_", self_parent(d, F.col("at_"), nullable, 0))
    ups = rows.select(F.col("at_").alias("up_"), *(F.col(p).alias(f"p{j}_") for j, p in enumerate(fk.parent_columns)))
    joined = rows.drop(*fk.columns).join(ups, "up_", "left")
    return joined.withColumns({c: F.col(f"p{j}_") for j, c in enumerate(fk.columns)}).drop("up_", "at_", *(f"p{j}_" for j in range(len(fk.columns))))


def generate(spark: SparkSession, schema: Schema, config: Config, *, only: dict[str, int] | None = None, pools: dict[str, Pool] | None = None, starts: dict[str, int] | None = None, taken: dict[str, DataFrame] | None = None, store: Callable[[Table, DataFrame], DataFrame] | None = None, lazy: bool = False) -> dict[str, DataFrame]:
    """A frame for each table, by key, parents first.

    Tables that are skipped have none. Columns that can't be made are an error before
    anything is drawn. Tables are written by ``store``, which gives back what to read (the
    shared folder if there is none), so that no row is drawn twice; lazy: only those that
    others refer to. Tables of one wave of the order don't depend on each other and run
    side by side. only, pools, starts, taken: for appending, see operators.append.
    """
    if bad := refused(schema, config):
        raise ValueError("no values can be made for " + ", ".join(bad))
    pools, out = dict(pools or {}), {}
    referred: dict[str, set[str]] = {}
    for t in schema.tables.values():
        for f in t.foreign:
            if f.parent != t.key:
                referred.setdefault(f.parent, set()).update(f.parent_columns)

    def made(key: str) -> tuple[DataFrame, Pool | None]:
        t = schema.tables[key]
        n = only[key] if only is not None else config.count(t)
        start = (starts or {}).get(key, 1)
        rows = table_rows(Maker(spark, t, config, pools, start), n, (taken or {}).get(key))
        if not lazy or key in referred:
            rows = store(t, rows) if store else written(rows)
        return rows, pool_of(rows, t, rows.count(), start, referred[key]) if key in referred else None

    done, waves = order(schema)
    for wave in waves:
        todo = [k for k in wave if not config.skips(schema.tables[k]) and (only is None or k in only)]
        with ThreadPoolExecutor(max(1, min(4, len(todo)))) as pool:
            for key, (rows, lent) in zip(todo, pool.map(made, todo), strict=True):
                out[key] = rows
                if lent is not None:
                    pools[key] = lent
    return {k: out[k] for k in done if k in out}
