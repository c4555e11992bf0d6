"""Calibrated probabilities: isotonic regression and Platt scaling.

Isotonic regression pools adjacent groups of scores until their means rise.  Pooling may start
anywhere, so ranges of scores are pooled by themselves first; then only ranges whose edges still
violate the order are pooled together, twice as wide each time, until no edge does.  Platt scaling
is a Newton iteration over five sums.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molscreen.operators.running import with_ranges
from molscreen.session import materialise

BLOCK = "range bigint, low double, high double, total double, n bigint"


def _pool(table: pa.Table) -> pa.Table:
    """Adjacent violators of one group pooled, in one pass over its blocks in order."""
    order = np.argsort(table["low"].to_numpy(), kind="stable")
    first, low, high, total, n = (table[c].to_numpy()[order].tolist() for c in ("range", "low", "high", "total", "n"))
    out: list[list] = []
    for block in zip(first, low, high, total, n):
        block = list(block)
        while out and out[-1][3] * block[4] >= block[3] * out[-1][4]:
            before = out.pop()
            block = [before[0], before[1], block[2], before[3] + block[3], before[4] + block[4]]
        out.append(block)
    kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["range", "low", "high", "total", "n"])


def isotonic(df: DataFrame, score: str, label: str) -> DataFrame:
    """(low, high, n, value): the blocks of the isotonic fit of ``label`` on ``score``, means strictly rising.

    Rows without a score or a label take no part; equal scores are one point.
    """
    known = df.select(F.col(score).cast("double").alias("low"), F.col(label).cast("double").alias("y"))
    known = known.where(F.col("low").isNotNull() & ~F.isnan("low") & F.col("y").isNotNull())
    points = materialise(known.groupBy("low").agg(F.sum("y").alias("total"), F.count(F.lit(1)).alias("n")), "points")
    ranged = with_ranges(points, "low").withColumnRenamed("_range", "range")
    blocks = ranged.select("range", "low", F.col("low").alias("high"), "total", "n")
    width = 0
    while True:
        group = F.shiftright("range", width)
        blocks = materialise(blocks.withColumn("group", group).groupBy("group").applyInArrow(lambda t: _pool(t), BLOCK), "pooled")
        at = F.struct("total", "n")
        edges = blocks.groupBy(F.shiftright("range", width).alias("group")).agg(F.min_by(at, "low").alias("first"), F.max_by(at, "low").alias("last"))
        # one row per range
        before = F.lag("last").over(Window.orderBy("group"))
        wrong = edges.select(before.alias("b"), F.col("first").alias("f")).where("b.total * f.n >= f.total * b.n")
        if wrong.isEmpty():
            break
        width += 1
    return blocks.select("low", "high", "n", (F.col("total") / F.col("n")).alias("value"))


def fitted(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, value): the calibrated value of every distinct score of ``df``."""
    blocks = materialise(isotonic(df, score, label), "blocks")
    known = df.select(F.col(score).cast("double").alias("score")).where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).distinct()
    points = materialise(with_ranges(known, "score"), "scores")
    # a block meets the ranges it reaches into
    ranges = points.groupBy("_range").agg(F.min("score").alias("_from"), F.max("score").alias("_to"))
    met = blocks.join(ranges, (F.col("low") <= F.col("_to")) & (F.col("high") >= F.col("_from"))).select("_range", "low", "high", "value")
    return points.join(met, "_range").where("score between low and high").select("score", "value")


def platt(df: DataFrame, score: str, label: str, most: int = 100, tolerance: float = 1e-12) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(a * score + b)), fitted by Newton steps.

    Targets are smoothed by the class counts.  A step that does not lower the loss is halved.
    """
    known = df.select(F.col(score).cast("double").alias("s"), (F.col(label) > 0).alias("y")).where("s is not null and not isnan(s) and y is not null")
    # equal rows are one
    points = materialise(known.groupBy("s", "y").agg(F.count(F.lit(1)).alias("n")), "platt")
    row = points.agg(F.sum(F.when(F.col("y"), F.col("n"))), F.sum(F.when(~F.col("y"), F.col("n")))).first()
    yes, no = row[0] or 0, row[1] or 0
    if not yes + no:
        raise ValueError("nothing to calibrate on")
    target = F.when(F.col("y"), (yes + 1.0) / (yes + 2.0)).otherwise(1.0 / (no + 2.0))

    def sums(a: float, b: float):
        z = F.col("s") * a + b
        p = 1 / (1 + F.exp(z))
        d, w = target - p, p * (1 - p)
        # log(1 + e^z) without overflow
        loss = target * z + F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        terms = [d * F.col("s"), d, w * F.col("s") * F.col("s") + F.lit(0.0), w * F.col("s"), w, loss]
        return points.agg(*[F.sum(t * F.col("n")) for t in terms]).first()

    a, b = 0.0, math.log((no + 1.0) / (yes + 1.0))
    now = sums(a, b)
    for _ in range(most):
        ga, gb, haa, hab, hbb, loss = now
        det = (haa + 1e-12) * (hbb + 1e-12) - hab * hab
        da, db = -((hbb + 1e-12) * ga - hab * gb) / det, -((haa + 1e-12) * gb - hab * ga) / det
        step = 1.0
        while step > 1e-10:
            new = sums(a + step * da, b + step * db)
            if new[5] <= loss:
                break
            step /= 2
        else:
            break
        a, b, now = a + step * da, b + step * db, new
        if abs(step * da) + abs(step * db) < tolerance * (1 + abs(a) + abs(b)):
            break
    return a, b
