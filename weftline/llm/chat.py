"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation once after every exchange, each log a prefix of the
next. Every turn gets a rolling hash of the turns up to it. A conversation whose last
hash is the hash of an earlier turn of another one is a prefix of it, and an anti-join
removes it; of equal conversations the one with the smallest id stays. What is left is
rendered by a template.

A conversation of any length is handled in segments of SEGMENT turns: turns are
numbered within ranges of their turn numbers, and the rolling hash is a running sum of
hashes of (place, role, text), so that sums of segments add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import cut

SEGMENT = 256
#: Hashes are below this, and summed in two halves of 31 bits, so that sums of any number of turns fit a long.
TOP = 1 << 62


def hash_of(salt: int, *cols: Column) -> Column:
    """Of 62 bits; nulls are told apart from empty strings."""
    parts = [x for c in cols for x in (c.isNull(), F.coalesce(c, F.lit("")))]
    return F.pmod(F.xxhash64(F.lit(salt), *parts), F.lit(TOP))


def placed(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, role, text) with place (1, 2, ...) in the conversation and segment.

    Order: turn number (null first), role, text. Numbers come from counts of ranges of
    turn numbers, so that a conversation of any length is spread over tasks.
    """
    ranged = turns.withColumn("range", F.coalesce(F.expr(f"turn div {SEGMENT}"), F.lit(-(1 << 55)).cast("long")))
    sizes = ranged.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    lead = sizes.select(F.col("conv").alias("c_"), F.col("range").alias("r_"), F.coalesce(before, F.lit(0)).alias("lead"))
    order = Window.partitionBy("conv", "range").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    numbered = ranged.withColumn("k", F.row_number().over(order)).join(lead, F.col("conv").eqNullSafe(F.col("c_")) & (F.col("range") == F.col("r_")))
    return numbered.select("conv", "turn", "role", "text", (F.col("k") + F.col("lead")).alias("place"), F.expr(f"(k + lead - 1) div {SEGMENT}").alias("segment"))


def prefixes(turns: DataFrame) -> DataFrame:
    """placed turns (conv, place, segment, h1, h2) with the halves of the rolling hashes up to each: pa1, pb1, pa2, pb2."""
    for i in (1, 2):
        h = F.col(f"h{i}")
        turns = turns.withColumn(f"a{i}", F.shiftright(h, 31)).withColumn(f"b{i}", h.bitwiseAND((1 << 31) - 1))
    halves = ["a1", "b1", "a2", "b2"]
    sums = turns.groupBy("conv", "segment").agg(*(F.sum(x).alias(f"s{x}") for x in halves))
    earlier = Window.partitionBy("conv").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    lead = sums.select(F.col("conv").alias("c_"), F.col("segment").alias("s_"), *(F.coalesce(F.sum(f"s{x}").over(earlier), F.lit(0)).alias(f"l{x}") for x in halves))
    within = Window.partitionBy("conv", "segment").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    joined = turns.join(lead, F.col("conv").eqNullSafe(F.col("c_")) & (F.col("segment") == F.col("s_")))
    total = {x: F.sum(x).over(within) + F.col(f"l{x}") for x in halves}
    return joined.select("conv", "place", *(total[x].alias(f"p{x}") for x in halves))


def maximal(turns: DataFrame) -> DataFrame:
    """The ids (conv) and lengths (n) of conversations that are no prefix of another."""
    hashed = turns.select("conv", "place", "segment", hash_of(1, F.col("place").cast("string"), F.col("role"), F.col("text")).alias("h1"), hash_of(2, F.col("text"), F.col("role"), F.col("place").cast("string")).alias("h2"))
    rolling = cut(prefixes(hashed))
    length = rolling.groupBy("conv").agg(F.max("place").alias("n"))
    upto = ["pa1", "pb1", "pa2", "pb2"]
    sized = rolling.join(length.select(F.col("conv").alias("c_"), "n"), F.col("conv").eqNullSafe(F.col("c_")))
    # one of equal conversations; null is the smallest id
    first = sized.where("place = n").groupBy("n", *upto).agg(F.min(F.struct("conv")).alias("one")).select("one.conv", "n", *upto)
    # a first turn that many logs share is one row in each task, and one in all
    inner = sized.where("place < n").select(F.col("place").alias("n"), *upto).distinct()
    return first.join(inner, ["n", *upto], "left_anti").select("conv", "n")


def chat(turns: DataFrame) -> DataFrame:
    """(conv_id, segment, n_turns, rendered): each maximal conversation, SEGMENT turns a row.

    turns has conv_id, turn, role and text; others don't matter. Null roles and texts
    render as empty strings but differ from them in comparisons. Turns are ordered by
    number, then role and text; equal rows are turns of their own. Rows with a null
    conv_id are one conversation. An empty table gives an empty table. n_turns is the
    length of the whole conversation. Texts of any length are rendered whole. Conversations
    of any length are handled SEGMENT turns at a time; turns whose numbers lie within
    one range of SEGMENT, or are null, are sorted in one task, which spills.
    """
    rows = placed(turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))
    kept = maximal(rows).select(F.col("conv").alias("c_"), "n")
    line = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    left = rows.join(kept, F.col("conv").eqNullSafe(F.col("c_")))
    packed = left.groupBy("conv", "segment", "n").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return packed.select(F.col("conv").alias("conv_id"), "segment", F.col("n").alias("n_turns"), F.expr("array_join(lines.line, '')").alias("rendered"))
