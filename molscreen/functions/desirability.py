"""Desirability curves and the weighted geometric mean, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-6  # fixed value: keeps ln() finite for small, survivable terms


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def is_finite(v: Column) -> Column:
    """False for NaN and both infinities; null stays null."""
    return ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def higher_better(value: Column, low, high) -> Column:
    """Linear ramp from 0 at ``low`` to 1 at ``high``; non-finite or empty ramp is 0."""
    lo, hi = _col(low), _col(high)
    ramp = F.try_divide(value - lo, hi - lo)
    return (
        F.when(value.isNull() | lo.isNull() | hi.isNull(), F.lit(None).cast("double"))
        .when(~is_finite(value) | (hi <= lo), 0.0)
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ramp)))
    )


def lower_better(value: Column, low, high, strict: bool = False) -> Column:
    """Mirror of :func:`higher_better`.

    A non-finite value or an empty ramp therefore scores 1; ``strict`` scores it 0.
    """
    mirrored = 1.0 - higher_better(value, low, high)
    if not strict:
        return mirrored
    return F.when(~is_finite(value) | (_col(high) <= _col(low)), 0.0).otherwise(mirrored)


def binary(probability: Column, want_positive) -> Column:
    """Probability of the wanted outcome, clamped to [0, 1]; non-finite is 0."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), probability))
    return (
        F.when(probability.isNull(), F.lit(None).cast("double"))
        .when(~is_finite(probability), 0.0)
        .otherwise(F.when(_col(want_positive), p).otherwise(1.0 - p))
    )


def window(value: Column, low, high) -> Column:
    """Triangle over [low, high] peaking at the centre, 0 outside."""
    lo, hi = _col(low), _col(high)
    peak = 1.0 - F.try_divide(F.abs(value - (lo + hi) / 2.0), (hi - lo) / 2.0)
    return (
        F.when(value.isNull() | lo.isNull() | hi.isNull(), F.lit(None).cast("double"))
        .when(~is_finite(value) | (hi <= lo) | (value < lo) | (value > hi), 0.0)
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), peak)))
    )


def by_shape(value: Column, shape: Column, low: Column, high: Column) -> Column:
    """Pick the curve named in ``shape``: higher, lower, window, positive, negative."""
    return (
        F.when(shape == "higher", higher_better(value, low, high))
        .when(shape == "lower", lower_better(value, low, high))
        .when(shape == "window", window(value, low, high))
        .when(shape == "positive", binary(value, True))
        .when(shape == "negative", binary(value, False))
    )


def _log_term(d: Column, w: Column) -> Column:
    # NaN falls to the floor: greatest() would keep it, because Spark sorts NaN highest
    return w * F.ln(F.when(F.isnan(d), FLOOR).otherwise(F.greatest(d, F.lit(FLOOR))))


def _is_fatal(d: Column, w: Column) -> Column:
    return (w > 0) & ~F.isnan(d) & (d <= 0)


def _combine(weight_sum: Column, fatal: Column, log_sum: Column) -> Column:
    return (
        F.when(weight_sum.isNull() | (weight_sum <= 0), F.lit(None).cast("double"))
        .when(fatal, 0.0)
        .otherwise(F.exp(F.try_divide(log_sum, weight_sum)))
    )


def geometric_mean_agg(d: Column, w: Column) -> Column:
    """Aggregate form over tall rows (one row per endpoint); null terms are skipped."""
    live = d.isNotNull() & w.isNotNull()
    return _combine(
        F.sum(F.when(live, w)),
        F.max(F.when(live, _is_fatal(d, w))),
        F.sum(F.when(live, _log_term(d, w))),
    )


def geometric_mean_array(terms: Column) -> Column:
    """Row form over an array of (d, w) structs; null terms are skipped.

    The sum runs in array order, so equal inputs give bit-equal scores on every run.
    """
    live = F.filter(terms, lambda t: t["d"].isNotNull() & t["w"].isNotNull())
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("log"), F.lit(False).alias("fatal"))

    def add(acc: Column, t: Column) -> Column:
        return F.struct(
            (acc["w"] + t["w"]).alias("w"),
            (acc["log"] + _log_term(t["d"], t["w"])).alias("log"),
            (acc["fatal"] | _is_fatal(t["d"], t["w"])).alias("fatal"),
        )

    return F.aggregate(live, start, add, lambda acc: _combine(acc["w"], acc["fatal"], acc["log"]))


def geometric_mean(terms: list[tuple[Column, Column]]) -> Column:
    """The same over a fixed list of (desirability, weight) columns."""
    if not terms:
        return F.lit(None).cast("double")
    return geometric_mean_array(F.array(*[F.struct(d.alias("d"), w.alias("w")) for d, w in terms]))
