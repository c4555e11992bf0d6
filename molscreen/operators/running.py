"""Running totals over a global order without sorting everything into one task.

A window without a partition key, or with one hot key, puts the whole order into a
single task.  Here the order is first cut into value ranges of about equal row count:
each range is summed, the few range sums are accumulated, and only then are rows
accumulated inside their own range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cut points that one plan carries as literals.
MOST_CUTS = 4096
#: Rows that a range should hold at most; beyond it ranges are cut once more.
RANGE_ROWS = 250_000


def _range_count(df: DataFrame) -> int:
    """Ranges of the first level: a few per shuffle partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, min(MOST_CUTS, 4 * parts))


def _literals(values: list, kind: str) -> Column:
    """Array literal, parsed in one go."""
    items = ", ".join(f"CAST('{v}' AS {kind})" for v in values)
    return F.expr(f"CAST(array({items}) AS array<{kind}>)")


def with_ranges(df: DataFrame, order: str, ranges: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``_range``: order-preserving range number of ``order`` from its own approximate quantiles.

    Only the first level's cut points (at most MOST_CUTS numbers) and the row count come to the
    driver; the cuts go back into the plan as literals.  Where ranges would exceed
    ``range_rows`` rows, each is cut again by its own quantiles, which stay in a table, so the
    number of ranges grows with the rows.  Approximation moves the cuts, never a result.
    """
    side = math.ceil(math.sqrt(ranges or _range_count(df)))
    total = side * side
    probs = [i / total for i in range(1, total)]
    cuts, rows = df.agg(F.percentile_approx(F.col(order), probs, max(1000, 4 * total)), F.count(F.lit(1))).first()
    first = df.withColumn("_range", _first_level(df, order, cuts or [], side).cast("bigint"))
    more = math.ceil(rows / (total * range_rows))
    if more <= 1:
        return first
    more = min(MOST_CUTS, more)
    fine = first.groupBy(F.col("_range").alias("_first")).agg(
        F.percentile_approx(F.col(order), [i / more for i in range(1, more)], 4 * more).alias("_cuts")
    )
    # at most MOST_CUTS rows; adaptive execution broadcasts them where they are small
    joined = first.join(fine, F.col("_range") == F.col("_first"))
    below = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0))
    return joined.withColumn("_range", F.col("_range") * more + F.greatest(below, F.lit(0))).drop("_first", "_cuts")


def _first_level(df: DataFrame, order: str, cuts: list, side: int) -> Column:
    """Two short scans (coarse, then fine) find a row's range."""
    kind = df.schema[order].dataType.simpleString()
    fine, coarse = _literals(cuts, kind), _literals(cuts[side - 1 :: side], kind)
    value = F.col(order)
    big = F.size(F.filter(coarse, lambda c: c < value))
    small = F.size(F.filter(F.slice(fine, big * side + 1, F.lit(side)), lambda c: c < value))
    return F.when(value.isNull(), -1).otherwise(big * side + small)


def hash_bucket(order: str, bits: int, rows: int) -> Column:
    """Order-preserving range number of a uniform hash in [0, 2^bits), about RANGE_ROWS rows each."""
    range_bits = min(bits, 31, max(6, math.ceil(math.log2(max(1, rows) / RANGE_ROWS + 1)) + 2))
    return F.shiftright(F.col(order), bits - range_bits).cast("bigint")


def running_sum(
    df: DataFrame,
    order: str,
    values: dict[str, str],
    by: list[str] | None = None,
    ties: list[str] | None = None,
    bucket: Column | None = None,
    ascending: bool = True,
) -> DataFrame:
    """Add inclusive running sums and per-group totals along ``order`` within ``by``.

    ``values`` maps a numeric column to the output name; ``<output>_total`` is added as
    well.  (``by``, ``order``, ``ties``) must be unique, and ``order`` alone should be
    nearly so: aggregate equal values first, so that no range holds a hot value.
    """
    by, ties = by or [], ties or []
    ranged = df.withColumn("_range", bucket) if bucket is not None else with_ranges(df, order)
    # one struct key serves the join and the window, and treats null groups as equal
    marked = ranged.withColumn("_cell", F.struct(*by, "_range")) if by else ranged.withColumn("_cell", F.col("_range"))
    direction = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    sums = marked.groupBy("_cell").agg(*[F.sum(src).alias(f"_sum_{out}") for src, out in values.items()])
    # at most a few thousand rows per group: one per range
    group = [F.col("_cell")[c] for c in by] if by else []
    place = F.col("_cell")["_range"] if by else F.col("_cell")
    whole = Window.partitionBy(*group)
    before = whole.orderBy(place.asc() if ascending else place.desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("_cell").alias("_at"),
        *[
            F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_before_{out}")
            for out in values.values()
        ],
        *[F.sum(f"_sum_{out}").over(whole).alias(f"{out}_total") for out in values.values()],
    )
    inside = (
        Window.partitionBy("_cell")
        .orderBy(direction(order), *[direction(t) for t in ties])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = marked.join(offsets, F.col("_cell") == F.col("_at")).drop("_at")
    local = [(F.col(f"_before_{name}") + F.sum(src).over(inside)).alias(name) for src, name in values.items()]
    helpers = ["_range", "_cell", *[f"_before_{name}" for name in values.values()]]
    return joined.select("*", *local).drop(*helpers)


def row_position(df: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """Add ``row_index``: 0-based position along a unique ``order`` within ``by``."""
    counted = running_sum(df.withColumn("_one", F.lit(1).cast("bigint")), order, {"_one": "_pos"}, by=by)
    return counted.withColumn("row_index", F.col("_pos") - 1).drop("_one", "_pos", "_pos_total")


def exact_percentiles(
    df: DataFrame, value: str, fractions: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """Exact interpolated percentiles per group, plus the row count ``n``.

    Works on counts per distinct value, so no group's values ever meet in one task.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sum(counts, value, {"_n": "_cum"}, by=by)
    n = F.col("_cum_total")
    aggs = []
    for name, p in fractions.items():
        at = F.lit(p) * (n - 1)
        for side, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_cum") - F.col("_n") <= k) & (F.col("_cum") > k)
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
    picked = cum.groupBy(*by).agg(F.max(n).alias("n"), *aggs)
    cols = []
    for name, p in fractions.items():
        at = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*by, *cols, "n")
