"""Embedding near-duplicates: an exact range join by cosine over pivot cells.

Vectors are scaled to length 1, where cosine c is Euclidean distance sqrt(2 - 2c).
Each goes to the cell of its nearest pivot, and as a guest to every other cell that
might hold a partner. The triangle inequality rules a cell out: its vectors lie in a
ring around its pivot, and on its side of the plane between the two pivots. A pair of
vectors from two cells is compared in the lower-numbered one only. Cells work alone,
in tiles of TILE rows, so a large cell is many tasks.

Equal vectors become one with a count before anything is compared, and a tile gives
counts of links and a spanning forest, never all pairs of a group. On data without
clusters in many dimensions the rings rule out little and every vector is a guest in
about half of the cells; the work is then that of comparing all pairs once. Distances to
pivots are worked out again in each of three passes rather than kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import components, forest
from weftline.llm.shared import cut, sample_rows, tidied
from weftline.llm.simhash import with_last

TILE, PIECE = 4096, 512
#: Rows from which pivots are chosen, for each pivot and at least, and their bytes at most; distinct vectors for each pivot, and the most pivots.
EACH, SAMPLE, SAMPLE_BYTES, PER_PIVOT, PIVOTS = 4, 2048, 1 << 26, 4096, 1024
#: Distances worked out at a time.
AT_ONCE = 1 << 20


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as float64."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe for very large and very small components."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose(sample: np.ndarray, k: int) -> np.ndarray:
    """k pivots from unit rows, each the farthest from those before it."""
    at = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(at) < min(k, len(sample)):
        at.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(1))
    return sample[at]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def close(d: int) -> float:
    """Single-precision products of unit rows of d numbers are wrong by less; what is so near the threshold is worked out in double precision."""
    return max(1e-4, d * 2.0**-22)


def homes_of(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot, distance to it) of unit rows."""
    home, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, AT_ONCE // len(pivots))
    for lo in range(0, len(x), step):
        d = distances(x[lo : lo + step], pivots)
        home[lo : lo + step] = d.argmin(1)
        far[lo : lo + step] = d.min(1)
    return home, far


def guests(x: np.ndarray, home: np.ndarray, pivots: np.ndarray, rings: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the row might have a partner whose home is this cell, lower than its own."""
    slack = r + 1e-7
    apart = distances(pivots, pivots)
    rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, AT_ONCE // len(pivots))
    for lo in range(0, len(x), step):
        d, own = distances(x[lo : lo + step], pivots), home[lo : lo + step]
        dh = d[np.arange(len(d)), own][:, None]
        lower = np.arange(len(pivots))[None, :] < own[:, None]
        in_ring = (d <= rings[:, 1] + slack) & (d >= rings[:, 0] - slack)
        row, cell = np.nonzero(lower & in_ring & (d - dh <= 2 * slack) & (d * d - dh * dh <= 2 * slack * apart[own] + 1e-7))
        rows.append(row + lo)
        cells.append(cell)
    return np.concatenate(rows), np.concatenate(cells)


def compare(a: np.ndarray, b: np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= least between unit rows: within a (each pair once), or from a to b."""
    other = a if b is None else b
    a32, b32 = a.astype(np.float32), other.astype(np.float32)
    slack = close(a.shape[1])
    for lo in range(0, len(a), PIECE):
        base = lo if b is None else 0
        s = a32[lo : lo + PIECE] @ b32[base:].T
        p, q = np.nonzero(s >= least - slack)
        value = s[p, q]
        p, q = p + lo, q + base
        sure = value >= least + slack
        doubt = np.flatnonzero(~sure)
        for k in range(0, len(doubt), 65536):
            d = doubt[k : k + 65536]
            sure[d] = (a[p[d]] * other[q[d]]).sum(1) >= least
        if b is None:
            sure &= p < q
        if sure.any():
            yield p[sure], q[sure]


def range_join(nodes: DataFrame, length: int, least: float) -> DataFrame:
    """(kind, a, b) for nodes (node, m, vec) of one length: kind 0: b more linked rows of node a; kind 1: a link."""
    r = float(np.sqrt(max(0.0, 2 - 2 * least)))
    n = nodes.count()
    k = max(1, min(PIVOTS, -(-n // PER_PIVOT)))
    some = sample_rows(nodes.select("node", "vec"), min(max(SAMPLE, EACH * k), max(1, SAMPLE_BYTES // (8 * length))), "node").select("vec").toArrow().column("vec").combine_chunks()
    pivots = choose(unit(matrix(some)), k) if len(some) else np.zeros((0, 1))
    if not len(pivots):  # the sample missed what little there is
        first = nodes.select("vec").limit(1).toArrow().column("vec").combine_chunks()
        pivots = unit(matrix(first)) if len(first) else np.ones((1, 1))
    k = len(pivots)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home, far = homes_of(unit(matrix(batch.column(0))), pivots)
                yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(far)], ["cell", "d"])

    rings, sizes = np.full((k, 2), [np.inf, -np.inf]), np.zeros((k, 2), np.int64)
    for c, count, lo, hi in nodes.select("vec").mapInArrow(tidied(homes), "cell long, d double").groupBy("cell").agg(F.count(F.lit(1)), F.min("d"), F.max("d")).collect():
        rings[c], sizes[c, 0] = (lo, hi), count

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(0)))
                each = np.bincount(guests(x, homes_of(x, pivots)[0], pivots, rings, r)[1], minlength=k)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(each)), pa.array(each[each > 0])], ["cell", "n"])

    for c, count in nodes.select("vec").mapInArrow(tidied(visits), "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        sizes[c, 1] = count
    tiles = np.maximum(-(-sizes // TILE), [1, 0])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cell, i, j, side): home tile i against home tile j >= i, or against guest tile j - home tiles."""
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            x = unit(matrix(batch.column(2)))
            home, _ = homes_of(x, pivots)
            part = (node * 0x9E3779B97F4A7C15 % (1 << 61)) if node.dtype == object else (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            who, cell, i, j, side = [], [], [], [], []

            def put(rows: np.ndarray, c: np.ndarray, x: np.ndarray, y: np.ndarray, s: int) -> None:
                who.append(rows)
                cell.append(c)
                i.append(x)
                j.append(y)
                side.append(np.full(len(rows), s))

            for c in np.unique(home).tolist():
                rows = np.flatnonzero(home == c)
                th, tg = tiles[c].tolist()
                own = (part[rows] % np.uint64(th)).astype(np.int64)
                for t in range(th + tg):
                    low, high = np.minimum(own, t), np.maximum(own, t)
                    put(rows, np.full(len(rows), c), low, high, 0)
                    if t < th:  # against another home tile the higher one is on the right
                        side[-1][own > t] = 1
            row, c = guests(x, home, pivots, rings, r)
            own = (part[row] % np.maximum(tiles[c, 1], 1).astype(np.uint64)).astype(np.int64) + tiles[c, 0]
            for t in range(int(tiles[:, 0].max())):
                yes = tiles[c, 0] > t
                put(row[yes], c[yes], np.full(yes.sum(), t), own[yes], 1)
            who_ = np.concatenate(who)
            unit_ = (np.concatenate(cell) << 40) | (np.concatenate(i) << 20) | np.concatenate(j)
            cols = [pa.array(unit_), pa.array(np.concatenate(side))]
            for lo in range(0, len(who_), 20_000):
                take = pa.array(who_[lo : lo + 20_000])
                yield pa.RecordBatch.from_arrays([x.slice(lo, 20_000) for x in cols] + [batch.column(x).take(take) for x in range(3)], ["unit", "side", "node", "m", "vec"])

    kind = dict(nodes.dtypes)["vec"]
    dealt = nodes.select("node", "m", "vec").mapInArrow(tidied(deal), f"unit long, side long, node long, m long, vec {kind}").repartition("unit").sortWithinPartitions("unit", "side")

    return linked(dealt, least)


def linked(dealt: DataFrame, least: float) -> DataFrame:
    """(kind, a, b) from units (unit, side, node, m, vec), each unit's rows together and side 0 first."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        side, node, m = (t.column(c).to_numpy() for c in ("side", "node", "m"))
        x = unit(matrix(t.column("vec").combine_chunks()))
        a = int((side == 0).sum())
        links, found = np.zeros(len(x), np.int64), np.zeros((0, 2), np.int64)
        one_tile = (int(t.column("unit")[0].as_py()) >> 20) % (1 << 20) == int(t.column("unit")[0].as_py()) % (1 << 20)
        for p, q in compare(x[:a], None if one_tile else x[a:], least) if one_tile or a < len(x) else ():
            q = q if one_tile else q + a
            np.add.at(links, p, m[q])
            np.add.at(links, q, m[p])
            found = np.concatenate([found, np.stack([p, q], 1)])
            if len(found) > 8 * len(x):
                found = forest(len(x), found)
        found = forest(len(x), found)
        some = np.flatnonzero(links)
        cols = [np.concatenate([np.zeros(len(some), np.int64), np.ones(len(found), np.int64)]), np.concatenate([node[some], node[found[:, 0]]]), np.concatenate([links[some], node[found[:, 1]]])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch, last in with_last(batches):
            if batch is not None and batch.num_rows:
                units = batch.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(units)) + 1).tolist(), len(units)]
                for lo, hi in zip(edges, edges[1:]):  # noqa: B905
                    if held and held[0].column(0)[0].as_py() != units[lo]:
                        yield solve(held)
                        held = []
                    held.append(batch.slice(lo, hi - lo))
            if last and held:
                yield solve(held)

    return dealt.mapInArrow(tidied(join), "kind long, a long, b long")


def vector_components(rows: DataFrame, *, least: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Two rows link if the cosine of their vectors, in double precision, is at least
    ``least`` (which must be positive). A vector that is null, empty, zero, or holds a
    null or non-finite component links with nothing; vectors of different lengths don't
    link. n_links counts linked rows other than the row itself; component_id is the
    smallest vec_id reachable, itself included; kept is vec_id = component_id. Rows that
    repeat an id are rows of their own (several may be kept); a null id names nothing.
    Other columns don't matter; an empty table gives an empty table.
    """
    v = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vec")).withColumn("ok", F.expr("vec is not null and size(vec) > 0 and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(vec, x -> x != 0)"))
    v = v.withColumn("t1", F.xxhash64("vec")).withColumn("t2", F.xxhash64(F.lit("vec"), "vec"))
    # equal vectors are one node; the checkpoint fixes the nodes' numbers
    nodes = cut(v.where("ok").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("rep"), F.first("vec").alias("vec")).withColumn("node", F.monotonically_increasing_id()))
    sizes = nodes.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    # lengths of which there are no more vectors than a tile holds are a tile each
    few = nodes.join(sizes.where(F.col("n") <= TILE), F.size("vec") == F.col("d"))
    found = linked(few.select(F.col("d").cast("long").alias("unit"), F.lit(0).cast("long").alias("side"), "node", "m", "vec").withColumn("unit", F.shiftleft("unit", 40)).repartition("unit").sortWithinPartitions("unit"), least)
    for length, _ in sizes.where(F.col("n") > TILE).orderBy("d").collect():
        found = found.union(range_join(nodes.where(F.size("vec") == length), length, least))
    found = cut(found)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    parts = components(found.where("kind = 1").select("a", "b")).withColumnsRenamed({"id": "node", "component": "part"})
    known = nodes.select("node", "t1", "t2", "m", "rep").join(counts, "node", "left").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    names = known.groupBy("part").agg(F.min("rep").alias("name"))
    known = known.join(names, "part").select("t1", "t2", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n"), "name", F.lit(True).alias("ok"))
    out = v.select("vec_id", "t1", "t2", "ok").join(known, ["t1", "t2", "ok"], "left")
    component = F.when(F.col("ok"), F.col("name")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
