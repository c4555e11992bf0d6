"""Rounding of doubles by their exact binary value, halves to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal places that exact arithmetic in 38 digits allows.
MOST_PLACES = 6


def round_exact(value: Column, places: int) -> Column:
    """``value`` to so many places as report generators print it: 2.675 is less than it looks and gives 2.67.

    A double is a whole number over a power of two, so the tenth powers that it lies between, and
    on which side of their middle, are found in whole numbers.  Doubles that lie no closer together
    than those powers stay as they are.
    """
    if not 0 <= places <= MOST_PLACES:
        raise ValueError(f"places must be from 0 to {MOST_PLACES}")
    scale, least = 10**places, 0.4 / 10**places
    big = lambda c: c.cast("decimal(38,0)")
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n).cast("decimal(19,0)")

    def parts(x: Column) -> Column:
        # enough binary places for any double of this size; one more or less from the logarithm does no harm
        shift = F.lit(54) - F.floor(F.log2(x)).cast("int")
        return F.struct(x.alias("x"), F.floor(shift / 2).cast("int").alias("p"), (shift - F.floor(shift / 2).cast("int")).alias("q"))

    def whole(t: Column) -> Column:
        number = (t["x"] * F.pow(F.lit(2.0), t["p"]) * F.pow(F.lit(2.0), t["q"])).cast("bigint").cast("decimal(19,0)")
        return F.struct(big(number * F.lit(scale).cast("decimal(10,0)")).alias("n"), big(power(t["p"]) * power(t["q"])).alias("one"))

    def divided(t: Column) -> Column:
        rest = t["n"] % t["one"]
        return F.struct(((t["n"] - rest) / t["one"]).cast("bigint").alias("below"), big(rest * F.lit(2).cast("decimal(1,0)")).alias("twice"), t["one"].alias("one"))

    def rounded(t: Column) -> Column:
        up = F.when(t["twice"] > t["one"], 1).when(t["twice"] < t["one"], 0).otherwise(t["below"] % 2)
        return (t["below"] + up).cast("double") / scale

    x = F.abs(value)
    plain = (x >= least) & (x < float(1 << 53) / scale)
    exact = _let(_let(_let(_let(x, parts), whole), divided), rounded)
    size = F.when(plain, exact).when(x < 1, 0.0).otherwise(x)
    # NaN and infinities stay
    return F.when(F.isnan(value), value).when(value < 0, -size).when(value.isNotNull(), size)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
