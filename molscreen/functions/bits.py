"""Fixed-width bit sets stored as ``array<bigint>`` (bit 63 of a word is the sign bit)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from molscreen.schemas import FP_BITS, IN_DOMAIN_THRESHOLD, MARGINAL_THRESHOLD


def word_of(bit: Column, n_bits: int = FP_BITS) -> Column:
    """Index of the word that holds ``bit`` after folding modulo ``n_bits``."""
    return F.floor(F.pmod(bit, F.lit(n_bits)) / 64).cast("int")


def mask_of(bit: Column, n_bits: int = FP_BITS) -> Column:
    """Single-bit mask of ``bit`` inside its word."""
    shift = F.pmod(F.pmod(bit, F.lit(n_bits)), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)


def from_bits(bits: Column, n_bits: int = FP_BITS) -> Column:
    """Words of an ``array<int>`` of bit positions, which fold modulo ``n_bits``."""
    folded = F.transform(bits, lambda b: F.pmod(b, F.lit(n_bits)).cast("int"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_bits // 64 - 1)),
        lambda w: F.aggregate(
            F.filter(folded, lambda b: F.floor(b / 64) == w),
            F.lit(0).cast("bigint"),
            lambda acc, b: acc.bitwiseOR(
                F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(b, F.lit(64)).cast("int"))
            ),
        ),
    )


def get_bit(words: Column, bit: Column, n_bits: int = FP_BITS) -> Column:
    """True when ``bit`` (folded) is set."""
    return F.get(words, word_of(bit, n_bits)).bitwiseAND(mask_of(bit, n_bits)) != 0


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(w))


def is_empty(words: Column) -> Column:
    return F.forall(words, lambda w: w == 0)


def shared_bits(a: Column, b: Column) -> Column:
    """Cardinality of the intersection."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda acc, n: acc + n
    )


def ratio(shared: Column, count_a: Column, count_b: Column) -> Column:
    """Tanimoto from the three counts; two empty sets are not similar (0)."""
    union = count_a + count_b - shared
    return F.when(union == 0, 0.0).otherwise(F.try_divide(shared.cast("double"), union.cast("double")))


def tanimoto(a: Column, b: Column) -> Column:
    return ratio(shared_bits(a, b), popcount(a), popcount(b))


def can_exceed(count_a: Column, count_b: Column, threshold) -> Column:
    """Whether two popcounts still allow a Tanimoto of at least ``threshold``."""
    big = F.greatest(count_a, count_b)
    bound = F.try_divide(F.least(count_a, count_b).cast("double"), big.cast("double"))
    return (big > 0) & F.coalesce(bound >= threshold, F.lit(False))


def classify(similarity: Column) -> Column:
    """Applicability-domain status; both cut-offs are inclusive."""
    return (
        F.when(similarity >= IN_DOMAIN_THRESHOLD, "in_domain")
        .when(similarity >= MARGINAL_THRESHOLD, "low_confidence")
        .otherwise("out_of_domain")
    )
