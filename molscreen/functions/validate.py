"""Row validation: input text, identity keys, statuses, error text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from molscreen.schemas import BATCH_STATUSES, MAX_SMILES_LEN, TERMINAL_STATUSES

# decimal or exponent form or infinity, blanks around; no type suffixes
NUMBER = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
KEY_PATTERN = "^[A-Z]{14}-[A-Z]{10}-[A-Z]\\z"  # fixed format: 14-10-1 upper case


def input_error(text: Column, max_len: int = MAX_SMILES_LEN) -> Column:
    """First failing check in cost order, or null: empty, too long (bytes), illegal character."""
    return (
        F.when(text.isNull() | text.rlike(r"(?U)^\s*\z"), "empty_input")
        .when(F.octet_length(text) > max_len, "input_too_long")
        .when(text.rlike(r"[^\x20-\x7E]"), "illegal_character")
    )


def is_key(key: Column) -> Column:
    """Shape check of a 27-character identity key."""
    return F.coalesce(key.rlike(KEY_PATTERN), F.lit(False))


def parse_key(key: Column) -> Column:
    """The key itself when well formed, else null."""
    return F.when(is_key(key), key)


def key_skeleton(key: Column) -> Column:
    """Connectivity block: the first 14 characters."""
    return F.substring(key, 1, 14)


def parse_status(status: Column) -> Column:
    """Exact-match batch status; anything else is null."""
    return F.when(status.isin(BATCH_STATUSES), status)


def is_terminal(status: Column) -> Column:
    return status.isin(TERMINAL_STATUSES)


def clamp(value: Column, low, high) -> Column:
    """Out-of-range values move to the nearest edge instead of failing."""
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def render_error(text: Column, position: Column, message: Column) -> Column:
    """Two-line error text with a caret under the offending character."""
    caret = F.concat(text, F.lit("\n"), F.repeat(F.lit(" "), position), F.lit("^ "), message)
    return F.when(position.isNull(), F.concat(text, F.lit("\n"), message)).otherwise(caret)


def to_number(value: Column) -> Column:
    """Numeric coercion: text that is no number, and NaN, become null."""
    return F.when(value.cast("string").rlike(NUMBER), value.try_cast("double"))


def band(value: Column, low: Column, high: Column) -> Column:
    """low / moderate / high band of a value against two caller-supplied cut-offs."""
    return F.when(value < low, "low").when(value < high, "moderate").when(value.isNotNull(), "high")


def withhold(score: Column, status: Column) -> Column:
    """Score, or null when the molecule is outside the model's domain (never 0)."""
    return F.when(status != "out_of_domain", score)


def withhold_reason(status: Column) -> Column:
    return F.when(status == "out_of_domain", "outside_applicability_domain")


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def destandardise(value: Column, mean: Column, sd: Column) -> Column:
    """Physical value of a standardised model output."""
    return value * sd + mean


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
