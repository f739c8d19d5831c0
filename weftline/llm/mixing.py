"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

The documents of a source, in an order fixed by a hash of their rows, form blocks of
``block`` documents. Time is counted in slots, one block each. Source s with weight
W of a total Q gives its b-th block (from 0) the window from floor(b * Q / W) to
ceil((b + 1) * Q / W); of the blocks released, the one with the earliest deadline
takes the slot (ties: the source that sorts first). For one slot at a time and
weights that sum to 1 this keeps every source within one block of its share at every
slot. All windows repeat with period Q, so the schedule of one period gives the slot
of any block by arithmetic: no task ever walks the whole schedule.

Up to FAN sources are scheduled together. More are scheduled in a tree, so that no row
ever holds more than a group: light sources form groups by a hash, groups get slots like
sources, and a group hands its slots to its members by a schedule of its own. A source
with a share of 2 / FAN or more is a group by itself. A source's deviation is then under one
block, plus its share of its group for every level below the first.

A source that has run out leaves its slots empty; the others close up in their order,
still in proportion to their weights, and nothing is dropped or repeated.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import Scratch, cut, named

#: Sources scheduled together, about; groups of light sources have half as many on average.
FAN = 64
#: Slots in a period at most, but for one a source at least.
LONGEST = 16384
#: Sources, and slots of all periods, of a plan that is broadcast at most; a larger one is joined by a shuffle.
SENT = 1 << 16, 1 << 22
#: Slots whose rows are counted together.
CHUNK = 256
#: What is added to each row.
COLUMNS = ["mix_block", "mix_release", "mix_due", "mix_slot", "mix_position"]
#: By what a row is found again in the table of places.
KEYS = ("mix_digest", "mix_tie")
#: The metadata of a column under which a mixed table, and its Parquet files, name their table of places.
MARK = "weftline_mixing"


def wishes(counts: DataFrame, target: dict[str, int] | None) -> DataFrame:
    """(node, r): what each source of counts (src, n) should weigh, a whole number from 1."""
    raw = F.floor(F.sqrt(F.col("n").cast("double"))).cast("long")
    if target is not None:
        raw = F.coalesce(F.element_at(F.create_map(*(x for k, v in target.items() for x in (F.lit(f"s{k}"), F.lit(int(v))))), F.col("src")).cast("long"), F.lit(1)) if target else F.lit(1).cast("long")
    return counts.select(F.col("src").alias("node"), F.greatest(raw, F.lit(1).cast("long")).alias("r"))


def grouped(nodes: DataFrame, count: int, level: int) -> DataFrame:
    """nodes (node, r) with parent: one for all if there are few, else a group of light ones or the node itself."""
    if count <= FAN:
        return nodes.withColumn("parent", F.lit("all"))
    total = nodes.agg(F.sum("r")).first()[0]
    light = F.concat(F.lit(f"g{level}."), F.pmod(F.xxhash64(F.lit(level), "node"), F.lit(-(-2 * count // FAN))).cast("string"))
    return nodes.withColumn("parent", F.when(F.col("r") * (FAN // 2) >= total, F.concat(F.lit("alone."), "node")).otherwise(light))


def schedule(nodes: DataFrame, quantum: int) -> DataFrame:
    """(node, parent, w, q, slots): of nodes (node, parent, r), the slots each has in one period of its parent's.

    Weights are rounded to parts of a period: the total by the least wish, but from
    ``quantum`` to LONGEST slots; every node has one slot at least.
    """
    one = nodes.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("node", "r"))).alias("given"), F.sum("r").alias("total"), F.min("r").alias("least"))
    one = one.withColumn("parts", F.expr(f"greatest({quantum}L, least({LONGEST}L, total div least))"))
    one = one.withColumn("s", F.expr("if(size(given) = 1, transform(given, x -> named_struct('node', x.node, 'w', 1L)), transform(given, x -> named_struct('node', x.node, 'w', greatest(1L, (2 * parts * x.r + total) div (2 * total)))))"))
    one = one.withColumn("q", F.expr("aggregate(s, 0L, (a, x) -> a + x.w)"))
    edf = """
        aggregate(sequence(0L, q - 1),
          named_struct('k', transform(s, x -> 0L), 'out', cast(array() as array<int>)),
          (acc, t) -> transform(
            array(array_min(transform(s, (x, i) ->
              if((acc.k[i] * q) div x.w <= t, named_struct('due', ((acc.k[i] + 1) * q + x.w - 1) div x.w, 'i', i), null))).i),
            i -> named_struct('k', transform(acc.k, (v, j) -> if(j = i, v + 1, v)), 'out', concat(acc.out, array(i))))[0],
          acc -> acc.out)
    """
    taken = one.select("parent", "s", "q", F.posexplode(F.expr(edf)).alias("t", "i")).select("parent", "q", F.expr("s[i].node").alias("node"), F.expr("s[i].w").alias("w"), F.col("t").cast("long").alias("t"))
    return taken.groupBy("node", "parent", "w", "q").agg(F.sort_array(F.collect_list("t")).alias("slots"))


def tree(nodes: DataFrame, quantum: int) -> list[DataFrame]:
    """Schedules from the sources' own upwards; the last has one parent for all."""
    levels = []
    while True:
        count = nodes.count()
        nodes = cut(grouped(nodes, count, len(levels)))
        levels.append(cut(schedule(nodes, quantum)))
        if count <= FAN:
            return levels
        nodes = nodes.groupBy(F.col("parent").alias("node")).agg(F.sum("r").alias("r"))


def sized(plan: DataFrame) -> DataFrame:
    n, slots = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(plan) if n <= SENT[0] and slots <= SENT[1] else plan


def hashable(docs: DataFrame) -> list[str]:
    return [c for c, t in docs.dtypes if "map" not in t and "variant" not in t]


def digests(columns: list[str], key: str, source: str) -> list[Column]:
    """What orders the rows of a source: the md5 of columns as text, and a hash of them as they are."""
    texts = [named(c).cast("string") for c in [key, source, *(c for c in columns if c not in (key, source))] if c in columns]
    return [F.md5(F.concat_ws("|", *texts)), F.xxhash64(*map(named, columns))]


def placed(docs: DataFrame, carry: list[str], target: dict[str, int] | None, quantum: int, block: int, key: str, source: str) -> DataFrame:
    """(row, KEYS, nth, and COLUMNS) for each row of docs; row is a struct of the columns to carry, nth counts equal rows."""
    src = F.when(named(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), named(source).cast("string")))
    digest, tie = digests(hashable(docs), key, source)
    rows = docs.select(F.struct(*map(named, carry)).alias("row"), src.alias("src"), digest.alias("h"), tie.alias("tie")).withColumn("sub", F.substring("h", 1, 3))
    groups = cut(rows.groupBy("src", "sub").agg(F.count(F.lit(1)).alias("n")))
    lead = groups.withColumn("lead", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    # the part of a block that one group of rows holds; its slot, and the rows ahead of it
    share = f"least(lead + n, (b + 1) * {block}) - greatest(lead, b * {block})"
    pieces = lead.select("src", "sub", "lead", "n", F.explode(F.expr(f"sequence(lead div {block}, (lead + n - 1) div {block})")).alias("b"))
    pieces = pieces.select("src", "sub", "b", F.expr(share).alias("size"), F.col("b").alias("at"), F.col("src").alias("node"))
    for level, plan in enumerate(tree(wishes(groups.groupBy("src").agg(F.sum("n").alias("n")), target), quantum)):
        pieces = pieces.join(sized(plan), "node")
        if not level:
            pieces = pieces.withColumn("release", F.expr("(at * q) div w")).withColumn("due", F.expr("((at + 1) * q + w - 1) div w"))
        pieces = pieces.withColumn("at", F.expr("(at div w) * q + slots[cast(at % w as int)]")).withColumn("node", F.col("parent")).drop("parent", "w", "q", "slots")
    pieces = cut(pieces.select("src", "sub", "b", "size", "release", "due", F.col("at").alias("slot")).withColumn("chunk", F.expr(f"slot div {CHUNK}")))
    before = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = pieces.groupBy("chunk").agg(F.sum("size").alias("size")).select("chunk", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.sum("size").over(Window.partitionBy("chunk").orderBy("slot", "sub").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("within", F.coalesce(within, F.lit(0))).join(chunks, "chunk").withColumn("ahead", F.col("base") + F.col("within"))
    known = pieces.groupBy("src", "sub").agg(F.sort_array(F.collect_list(F.struct("b", "release", "due", "slot", "ahead"))).alias("blocks")).join(lead, ["src", "sub"])
    nth = F.row_number().over(Window.partitionBy("src", "sub").orderBy("h", "tie"))
    out = rows.withColumn("nth", nth).join(known, ["src", "sub"]).withColumn("k", F.col("lead") + F.col("nth") - 1)
    out = out.withColumn("own", F.expr(f"blocks[cast(k div {block} - lead div {block} as int)]"))
    equal = F.row_number().over(Window.partitionBy("src", "sub", "h", "tie").orderBy("nth"))
    return out.select("row", F.col("h").alias(KEYS[0]), F.col("tie").alias(KEYS[1]), equal.alias("nth"), F.col("own.b").alias("mix_block"), F.col("own.release").alias("mix_release"), F.col("own.due").alias("mix_due"), F.col("own.slot").alias("mix_slot"), F.expr(f"own.ahead + k - greatest(lead, own.b * {block}) + 1").alias("mix_position"))


def mixed(docs: DataFrame, *, target: dict[str, int] | None = None, quantum: int = 1000, block: int = 16, key: str = "doc_id", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """docs with mix_block, mix_release, mix_due, mix_slot (from 0) and mix_position (1 to the number of rows).

    Every row of docs comes back once, with the columns of ``carry`` (None: all). Windows are in slots of
    the source's group, the whole schedule if there are FAN sources or fewer.
    Null is a source of its own. Rows of a source are ordered by the md5 of key, source and
    other columns as text, so rows with one id, or a null id, are spread too; rows that are
    equal throughout are interchangeable; texts of any length count whole. A column of docs named like a new one,
    in whatever case, comes back as ``docs_`` and its name. An empty table gives an empty
    table. target maps sources to whole weights; those it doesn't name weigh 1. Without a
    target a source weighs as the square root of its count (temperature 2).

    Shuffles: the rows once by (source, three digits of the hash), so a source of any size
    is spread over 4,096 groups; a row for each block of such a group, by slots and
    back; the sources by their groups. The rows themselves meet one row of their group.
    """
    carry = docs.columns if carry is None else carry
    out = placed(docs, carry, target, quantum, block, key, source)
    own: list[Column] = [F.col("row")[c].alias(f"docs_{c}" if c.lower() in COLUMNS else c) for c in carry]
    return out.select(*own, *COLUMNS)


def marked(docs: DataFrame) -> dict[str, Any] | None:
    """What the mixing that docs come from has noted of itself; None if there was none."""
    return next((json.loads(f.metadata[MARK]) for f in docs.schema if MARK in f.metadata), None)


def interleaved(docs: DataFrame, *, target: dict[str, int] | None = None, quantum: int = 1000, block: int = 16, key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs, its own columns only and unchanged, sorted by the position that mixed() gives.

    Files don't keep the order of rows. So the places are written to a table too, digests, slot and position
    of each row, which stays in the shared folder. The metadata of column ``key`` (or else the first) names it,
    and goes with the rows into Parquet and back; places() reads it.
    """
    out = placed(docs, docs.columns, target, quantum, block, key, source)
    scratch = Scratch(docs.sparkSession)
    scratch.written(out.select(*KEYS, "nth", "mix_slot", "mix_position"))
    settings = {"target": target and {str(k): int(v) for k, v in target.items()}, "quantum": quantum, "block": block, "key": key, "source": source}
    about = {f.name: dict(f.metadata) for f in docs.schema}
    about[key if key in about else docs.columns[0]][MARK] = json.dumps({"path": scratch.paths[0], "columns": hashable(docs), "settings": settings})
    return out.orderBy("mix_position").select(*(F.col("row")[c].alias(c, metadata=about[c]) for c in docs.columns))


def keyed(note: dict[str, Any]) -> list[Column]:
    return [c.alias(k) for c, k in zip(digests(note["columns"], note["settings"]["key"], note["settings"]["source"]), KEYS, strict=True)]


def counted(rows: DataFrame) -> DataFrame:
    """rows, which have KEYS, with nth; rows with the same KEYS are interchangeable."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*KEYS)))


def places(docs: DataFrame) -> tuple[list[Column], DataFrame]:
    """Columns of docs to find a row by, and the places (KEYS, nth, mix_slot, mix_position) in the mixing that docs come from.

    docs may be some of the mixed rows, in any order. If a row has no place there, or the table is gone, docs
    are mixed anew by the settings of that mixing; by the usual ones if docs come from none.
    """
    note = marked(docs)
    if note and {*note["columns"]} <= {*docs.columns}:
        try:
            found = docs.sparkSession.read.parquet(note["path"])
        except AnalysisException:
            found = None
        if found is not None and counted(docs.select(*keyed(note))).join(found, [*KEYS, "nth"], "left_anti").isEmpty():
            return keyed(note), found
    note = marked(interleaved(docs, **(note["settings"] if note else {})))
    return keyed(note), docs.sparkSession.read.parquet(note["path"])


def with_places(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with mix_slot and mix_position instead of KEYS, from the places found."""
    own = [c for c in rows.columns if c not in KEYS]
    return counted(rows).join(found, [*KEYS, "nth"], "left").select(*map(named, own), "mix_slot", "mix_position")
