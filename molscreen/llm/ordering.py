"""Global positions along an order, from range-sorted parts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molscreen.llm.common import CELL_ROWS, quoted
from molscreen.session import materialise


def range_sorted(df: DataFrame, order: list[str], rows: int, name: str) -> DataFrame:
    """Stored copy of ``df``, range-sorted by ``order``, with ``_part`` and 0-based ``name``.

    The parts are written once, so that sampling their bounds anew cannot move a row.  Only
    one count per part is accumulated in one task.
    """
    parts = max(1, math.ceil(rows / CELL_ROWS))
    cols = [quoted(c) for c in order]
    stored = materialise(df.repartitionByRange(parts, *cols).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*cols)
    placed = stored.join(starts, F.col("_part") == F.col("_at")).drop("_at")
    return placed.withColumn(name, F.col("_start") + F.row_number().over(inside) - 1).drop("_start")
