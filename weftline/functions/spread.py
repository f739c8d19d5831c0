"""How draws spread over labels and parents: uniform, zipf, weighted.

Weights are whole numbers, so that running totals are exact in every engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.draw import Draw

SCALE = 1_000_000
#: Ranks in a run whose total is summed ahead of the running sum.
RUN = 4096


@dataclass(frozen=True)
class Spread:
    kind: str = "uniform"  # uniform, zipf, weighted
    skew: float = 1.0
    weights: tuple[tuple[str, float], ...] = ()


def zipf_weights(n: int, skew: float) -> list[int]:
    """About SCALE / k**skew for ranks k = 1 to n, 1 at least."""
    return [max(1, int(SCALE / k**skew)) for k in range(1, n + 1)]


def whole(weights: list[float]) -> list[int]:
    top = max(weights, default=1.0) or 1.0
    return [max(0, round(w / top * SCALE)) for w in weights]


def label_draw(draw: Draw, spread: Spread, labels: list[str]) -> Column | None:
    """A label by the spread, or None where the usual generator should serve."""
    if spread.kind == "weighted":
        return draw.weighted([v for v, _ in spread.weights], whole([w for _, w in spread.weights]))
    if spread.kind == "zipf" and labels:
        return draw.weighted(labels, zipf_weights(len(labels), spread.skew))
    return None


def rank_weights(parents: DataFrame, skew: float) -> DataFrame:
    """parents (rank from 1) with w, and lo <= x < hi: its part of [0, total).

    The running total is taken over runs of RUN ranks and their sums, so no task sees
    all ranks.
    """
    w = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(float(SCALE)) / (F.col("rank").cast("double") if skew == 1 else F.pow(F.col("rank").cast("double"), F.lit(float(skew))))).cast("long"))
    ranked = parents.withColumn("w", w).withColumn("run", F.expr(f"(rank - 1) div {RUN}"))
    sums = ranked.groupBy("run").agg(F.sum("w").alias("s"))
    lead = sums.select("run", F.coalesce(F.sum("s").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("lead"))
    hi = F.sum("w").over(Window.partitionBy("run").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) + F.col("lead")
    return ranked.join(lead, "run").withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("w")).drop("run", "lead")


def zipf_ranks(children: DataFrame, draw: Draw, parents: DataFrame, n: int, skew: float) -> DataFrame:
    """children with ``rank`` drawn by zipf over n parents (rank).

    Not a range join: [0, total) is cut into n equal buckets, each parent goes to the
    buckets it touches (2n rows at most in all), and children meet them by bucket.
    """
    weighted = rank_weights(parents.select("rank"), skew)
    total = weighted.agg(F.max("hi")).first()[0] or 0
    step = max(1, -(-total // max(1, n)))
    x = children.withColumn("x_", draw.below(total)).withColumn("b_", F.expr(f"x_ div {step}"))
    touched = weighted.select("rank", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {step}"), F.expr(f"(hi - 1) div {step}"))).alias("b_"))
    return x.join(touched, "b_").where("x_ >= lo and x_ < hi").drop("x_", "b_", "lo", "hi")
