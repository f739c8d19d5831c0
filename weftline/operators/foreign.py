"""Foreign keys for generated rows: a parent rank a row, then the parent's whole key tuple."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.draw import Draw
from weftline.functions.spread import Spread, zipf_ranks


def assign(children: DataFrame, draw: Draw, pool: DataFrame, n: int, spread: Spread = Spread()) -> DataFrame:
    """children joined to one row of pool (rank 1 to n, other columns) each.

    uniform: the rank is arithmetic and one equi-join brings the key. zipf: the parents'
    order is their popularity. weighted has no meaning for parents and is uniform. An
    empty pool gives nulls.
    """
    if not n:
        kinds = [f for f in pool.schema.fields if f.name != "rank"]
        return children.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in kinds))
    if spread.kind == "zipf":
        ranked = zipf_ranks(children, draw, pool, n, spread.skew)
    else:
        ranked = children.withColumn("rank", draw.below(n) + 1)
    return ranked.join(pool, "rank").drop("rank")


def dense_parent(draw: Draw, n: int) -> Column:
    """A uniform parent where parent keys are 1 to n: no join at all."""
    return draw.below(n) + 1


def self_parent(draw: Draw, at: Column, nullable: bool = True, start: int = 1) -> Column:
    """A parent within the same table of dense ids from ``start``: an earlier row's id.

    at counts rows from 0. Row 0 has none (or itself where null isn't allowed); others
    have none with probability 0.6 where it is.
    """
    earlier = draw.below(at, 1) + start
    if not nullable:
        return F.when(at == 0, F.lit(start).cast("long")).otherwise(earlier)
    return F.when(at == 0, F.lit(None).cast("long")).when(draw.u(0) < 0.6, F.lit(None).cast("long")).otherwise(earlier)
