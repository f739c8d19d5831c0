"""Exact top-k search by inner product: branch and bound over columns.

Queries and candidates meet in blocks of bounded size. In a block the candidates lie
column by column. For each query, products are summed STEP columns at a time; after
each step a candidate whose sum, plus the most that the remaining columns could add
(the product of the remaining lengths, by Cauchy and Schwarz), is under the k-th best
score known so far goes, and those that stay are packed together.

All queries meet one block of candidates first. The k-th best score a query has there
goes with it to the other blocks, so that most of their candidates go after a few columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import cut, tidied
from weftline.llm.simhash import with_last
from weftline.llm.vectors import matrix

#: Queries and candidates in a block; columns in a step.
QUERIES, CANDIDATES, STEP = 4096, 8192, 16
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 52)
#: Range of the score that is returned; the ranking knows no bounds.
LONG = -(2**63), 2**63 - 1


def sortable(score: int) -> bytes:
    """Bytes that sort as whole numbers of any size do."""
    size = (abs(score).bit_length() + 7) // 8
    raw = b"\x80" + size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return raw if score >= 0 else bytes(255 - b for b in raw)


def block(own: np.ndarray, q: np.ndarray, least: np.ndarray, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(index of the query, indices of its k best candidates, scores), ties to smaller ids.

    own: the number of each query's row, which is no candidate of its; rows: of the
    candidates; least: a score that k rows of a query are known to reach.
    Candidates whose products could be too large for doubles are summed as whole numbers.
    """
    n, d = v.shape
    order = np.argsort(-(v * v).sum(0), kind="stable")
    steps = [order[lo : lo + STEP] for lo in range(0, d, STEP)]
    columns = [np.ascontiguousarray(v[:, s].T) for s in steps]
    with np.errstate(over="ignore", invalid="ignore"):
        rest = np.sqrt(np.cumsum([(c * c).sum(0) for c in columns][::-1], axis=0)[::-1])
    rest = [*rest[1:], np.zeros(n)]
    size = np.abs(v).max(1, initial=0)
    for j, x in enumerate(q):
        with np.errstate(over="ignore"):
            plain = d * np.abs(x).max(initial=0) * size < EXACT
        other = rows != own[j]
        alive, slow = np.flatnonzero(plain & other), np.flatnonzero(~plain & other)
        bound = least[j]
        total = x[steps[0]] @ columns[0][:, alive] if len(alive) < n else x[steps[0]] @ columns[0]
        for t in range(len(steps)):
            if t:
                total = total + x[steps[t]] @ columns[t][:, alive]
            if t + 1 < len(steps) and len(alive):
                if len(alive) > k and (t == 0 or bound == -np.inf):
                    # the k best so far have their whole scores worked out: at least k rows reach the least of them
                    head = alive[np.argpartition(-total, k - 1)[:k]]
                    bound = max(bound, float((v[head] @ x).min()))
                left = x[np.concatenate(steps[t + 1 :])]
                may = total + np.sqrt(left @ left) * rest[t][alive]
                stay = may * (1 + 1e-12) + 0.5 >= bound
                alive, total = alive[stay], total[stay]
        if len(slow):
            big = [int(y) for y in x]
            scores = [int(s) for s in total] + [sum(a * int(b) for a, b in zip(big, v[i], strict=True)) for i in slow]
            alive = np.concatenate([alive, slow])
            best = np.array(sorted(range(len(alive)), key=lambda i: (-scores[i], ids[alive[i]]))[:k], np.int64)
            yield j, alive[best], [scores[i] for i in best]
        else:
            if len(alive) > k:  # ties with the k-th stay for now
                near = np.flatnonzero(total >= -np.partition(-total, k - 1)[k - 1])
                alive, total = alive[near], total[near]
            best = np.lexsort((ids[alive], -total))[:k]
            yield j, alive[best], [int(s) for s in total[best]]


def top_k(rows: DataFrame, queries: str, *, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the highest scores for each row that fulfils ``queries``, a SQL condition.

    Components become floor(scale * x); the score is their integer inner product. Ranks follow the
    whole score, of any size; the score returned is kept within the range of a long. A query's candidates
    are all other rows of the same length: rows that repeat an id or a vector are
    rows like others. Ties go to the smaller id. Vectors that are null, empty or hold
    null or non-finite components, and rows with a null id, take no part. Other columns
    don't matter; vectors of any length are handled; an empty table gives an empty table.

    Every query meets every row, in blocks: rows are sent once for each QUERIES queries,
    queries once for each CANDIDATES rows.
    """
    given = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("src"), F.expr(queries).alias("asks"))
    good = given.where("id is not null and src is not null and size(src) > 0 and not exists(src, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    # floors are taken in numpy: Spark's would be a long; the checkpoint fixes the rows' numbers
    base = cut(good.select("id", F.coalesce("asks", F.lit(False)).alias("asks"), F.expr(f"transform(src, x -> cast(x as double) * {float(scale)!r}D)").alias("vec")).withColumn("row", F.monotonically_increasing_id()))
    sizes = base.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("asked")).where("asked > 0")
    small = (F.col("n") <= CANDIDATES) & (F.col("asked") <= QUERIES)
    # lengths of which there are no more vectors than a block holds are a block each
    few = base.join(sizes.where(small).select("d"), F.size("vec") == F.col("d"))
    own = few.where("asks").select("d", F.lit(0).cast("long").alias("side"), "id", "row", "vec").union(few.select("d", F.lit(1).cast("long").alias("side"), "id", "row", "vec"))
    out = met(own.select(F.col("d").cast("long").alias("unit"), "side", "id", "row", "vec", F.lit(None).cast("double").alias("least")), k)
    for d, n, asked in sizes.where(~small).orderBy("d").collect():
        out = out.union(matched(base.where(F.size("vec") == d), -(-asked // QUERIES), -(-n // CANDIDATES), k))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("key"), "vec_id", "vec_row")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def met(units: DataFrame, k: int) -> DataFrame:
    """(query_id, query_row, vec_id, vec_row, score, key) from units (unit, side, id, row, vec, least): queries on side 0, candidates on side 1."""
    dealt = units.repartition("unit").sortWithinPartitions("unit", "side")
    return dealt.mapInArrow(tidied(lambda batches: search(batches, k)), "query_id long, query_row long, vec_id long, vec_row long, score long, key binary")


def matched(rows: DataFrame, nq: int, nv: int, k: int) -> DataFrame:
    """(query_id, query_row, vec_id, vec_row, score, key): each query's k best in each of nv blocks, of rows (id, asks, vec, row)."""
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    left = rows.where("asks").select(part(nq).alias("q"), F.lit(0).cast("long").alias("side"), "id", "row", "vec")
    right = rows.select(part(nv).alias("v"), F.lit(1).cast("long").alias("side"), "id", "row", "vec", F.lit(None).cast("double").alias("least"))

    def meet(asked: DataFrame, lo: int, hi: int) -> DataFrame:
        """asked (q, side, id, row, vec, least) against the blocks from lo to hi."""
        a = asked.select("q", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias("v"), "side", "id", "row", "vec", "least")
        b = right.where((F.col("v") >= lo) & (F.col("v") < hi)).select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q"), "v", "side", "id", "row", "vec", "least")
        return met(a.union(b).select((F.col("q").cast("long") * nv + F.col("v")).alias("unit"), "side", "id", "row", "vec", "least"), k)

    first = meet(left.withColumn("least", F.lit(None).cast("double")), 0, 1)
    if nv == 1:
        return first
    first = cut(first)
    # a k-th best score beyond what doubles hold exactly is no bound
    known = first.groupBy(F.col("query_row").alias("row")).agg(F.count(F.lit(1)).alias("m"), F.min("score").cast("double").alias("least")).where((F.col("m") >= k) & (F.abs("least") < EXACT)).select("row", "least")
    return first.union(meet(left.join(known, "row", "left").select("q", "side", "id", "row", "vec", "least"), 1, nv))


def search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, row, left = t.column("id").to_numpy(), t.column("row").to_numpy(), t.column("side").to_numpy() == 0
        x = np.floor(matrix(t.column("vec").combine_chunks()))
        least = np.nan_to_num(t.column("least").to_numpy()[left].astype(np.float64), nan=-np.inf)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        scores: list[int] = []
        for j, best, found in block(row[left], x[left], least, row[~left], ids[~left], x[~left], k) if left.any() else ():
            for c, value in zip(out, (np.full(len(best), ids[left][j]), np.full(len(best), row[left][j]), ids[~left][best], row[~left][best]), strict=True):
                c.append(value)
            scores += found
        score = pa.array([min(max(s, LONG[0]), LONG[1]) for s in scores], pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in out), score, pa.array([sortable(s) for s in scores], pa.binary())], ["query_id", "query_row", "vec_id", "vec_row", "score", "key"])

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
