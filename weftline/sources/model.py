"""The relational model: tables, columns, keys, foreign keys, checks, partitions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KINDS = ("integer", "decimal", "boolean", "uuid", "json", "date", "time", "timestamp", "bytea", "inet", "money", "interval", "macaddr", "xml", "text", "enum", "array", "composite", "range", "unsupported")


@dataclass(frozen=True)
class Column:
    name: str
    kind: str = "text"
    nullable: bool = True
    bits: int = 64  # of integers
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    labels: tuple[str, ...] = ()
    identity: bool = False  # the database numbers the rows
    generated: bool = False  # computed by the database; never written
    default: bool = False
    element: Column | None = None  # of arrays and ranges
    fields: tuple[Column, ...] = ()  # of composites

    def spark_type(self) -> T.DataType:
        if self.kind == "integer":
            return {16: T.ShortType(), 32: T.IntegerType()}.get(self.bits, T.LongType())
        if self.kind == "decimal":
            return T.DecimalType(min(self.precision, 38), self.scale or 0) if self.precision else T.DoubleType()
        if self.kind == "money":
            return T.DecimalType(18, 2)
        if self.kind == "array":
            return T.ArrayType(self.element.spark_type())
        if self.kind == "range":
            return T.StructType([T.StructField(x, self.element.spark_type()) for x in ("lower", "upper")])
        if self.kind == "composite":
            return T.StructType([T.StructField(f.name, f.spark_type()) for f in self.fields])
        simple = {"boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "bytea": T.BinaryType(), "interval": T.DayTimeIntervalType()}
        return simple.get(self.kind, T.StringType())


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str  # key of the parent table
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Partition:
    """How a table is partitioned: range, list or hash on its first key column."""

    strategy: str
    columns: tuple[str, ...]
    has_default: bool = False
    ranges: tuple[tuple[str | None, str | None], ...] = ()
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    schema: str = "main"
    primary: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    foreign: tuple[ForeignKey, ...] = ()
    checks: tuple[str, ...] = ()
    partition: Partition | None = None

    @property
    def key(self) -> str:
        return f"{self.schema}.{self.name}"

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def key_sets(self) -> list[tuple[str, ...]]:
        """Column sets that must be unique: the primary key, then the others."""
        return list(dict.fromkeys([*([self.primary] if self.primary else []), *self.uniques]))

    def foreign_of(self, column: str) -> ForeignKey | None:
        """The first foreign key that holds the column."""
        return next((f for f in self.foreign if column in f.columns), None)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type(), c.nullable) for c in self.columns])


@dataclass
class Schema:
    tables: dict[str, Table] = field(default_factory=dict)

    def add(self, table: Table) -> None:
        self.tables[table.key] = table

    def find(self, name: str) -> Table:
        """By key, or by bare name."""
        if name in self.tables:
            return self.tables[name]
        for t in self.tables.values():
            if t.name == name:
                return t
        raise KeyError(f"no table {name}")

    def resolved(self) -> Schema:
        """Foreign keys without columns point at their parent's primary key."""
        out = Schema()
        for t in self.tables.values():
            fks = tuple(f if f.parent_columns or f.parent not in self.tables else replace(f, parent_columns=self.tables[f.parent].primary) for f in t.foreign)
            out.add(replace(t, foreign=fks))
        return out


def lookup(settings: dict, table: Table, column: str):
    """A setting by ``table.column``, ``schema.table.column`` or ``column``; the first hit wins."""
    return next((settings[k] for k in (f"{table.name}.{column}", f"{table.key}.{column}", column) if k in settings), None)


def matches(patterns: list[str], table: Table, column: str) -> bool:
    return any(p in (f"{table.name}.{column}", f"{table.key}.{column}", column) for p in patterns)


def of_struct(name: str, struct: T.StructType, **keys) -> Table:
    """A table over stored data: its column kinds follow the Spark types."""

    def kind(t: T.DataType) -> dict:
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return {"kind": "integer", "bits": {"ByteType": 16, "ShortType": 16, "IntegerType": 32}.get(type(t).__name__, 64)}
        if isinstance(t, T.DecimalType):
            return {"kind": "decimal", "precision": t.precision, "scale": t.scale}
        if isinstance(t, (T.FloatType, T.DoubleType)):
            return {"kind": "decimal"}
        if isinstance(t, T.ArrayType):
            return {"kind": "array", "element": Column("element", **kind(t.elementType))}
        if isinstance(t, T.StructType):
            return {"kind": "composite", "fields": tuple(Column(f.name, **kind(f.dataType)) for f in t)}
        named = {"BooleanType": "boolean", "DateType": "date", "TimestampType": "timestamp", "TimestampNTZType": "timestamp", "BinaryType": "bytea", "DayTimeIntervalType": "interval", "StringType": "text", "VarcharType": "text", "CharType": "text"}
        return {"kind": named.get(type(t).__name__, "unsupported")}

    return Table(name, tuple(Column(f.name, nullable=f.nullable, **kind(f.dataType)) for f in struct), **keys)


#: Keys declared over the stored tables: primary key, foreign keys (columns, parent, parent columns).
KEYS: dict[str, tuple[tuple[str, ...], tuple[tuple[str, str, str], ...]]] = {
    "region": (("r_regionkey",), ()),
    "nation": (("n_nationkey",), (("n_regionkey", "region", "r_regionkey"),)),
    "customer": (("c_custkey",), (("c_nationkey", "nation", "n_nationkey"),)),
    "supplier": (("s_suppkey",), (("s_nationkey", "nation", "n_nationkey"),)),
    "part": (("p_partkey",), ()),
    "orders": (("o_orderkey",), (("o_custkey", "customer", "c_custkey"),)),
    "lineitem": ((), (("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey"))),
    "events": (("event_id",), (("user_id", "customer", "c_custkey"),)),
    "documents": (("doc_id",), ()),
    "labels": (("doc_id",), (("doc_id", "documents", "doc_id"),)),
    "embeddings": (("vec_id",), ()),
    "pages": (("page_id",), ()),
    "benchmark": (("item_id",), ()),
    "conversations": (("conv_id", "turn"), ()),
}


def stored(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(KEYS)) -> tuple[Schema, dict[str, DataFrame]]:
    """The declared model over a folder of Parquet tables, and the tables by key; nothing is read but footers."""
    schema, frames = Schema(), {}
    for name in names:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        primary, fks = KEYS[name]
        schema.add(of_struct(name, df.schema, primary=primary, foreign=tuple(ForeignKey((c,), f"main.{p}", (pc,)) for c, p, pc in fks)))
        frames[f"main.{name}"] = df
    return schema, frames
