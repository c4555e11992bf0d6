"""Cleaning, deduplication, label conflicts and dataset profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molscreen.functions.validate import to_number
from molscreen.schemas import MAX_HEAVY_ATOMS
from molscreen.session import broadcast_if_small


def usable_rows(df: DataFrame, structure: str = "canonical_smiles", size: str | None = "heavy_atoms") -> DataFrame:
    """Drop rows without a structure and reject (never truncate) oversized ones."""
    kept = df.where(F.col(structure).isNotNull())
    return kept if size is None else kept.where(F.col(size) <= MAX_HEAVY_ATOMS)


def intake_report(df: DataFrame, structure: str = "canonical_smiles", size: str = "heavy_atoms") -> DataFrame:
    """One row of drop counts: input, parsed, invalid, oversized, percent of parsed."""
    parsed = F.count(structure)
    over = F.count_if(F.col(structure).isNotNull() & (F.col(size) > MAX_HEAVY_ATOMS))
    return df.agg(
        F.count(F.lit(1)).alias("n_input"),
        parsed.alias("n_parsed"),
        (F.count(F.lit(1)) - parsed).alias("n_invalid"),
        over.alias("n_oversized"),
        F.try_divide(100.0 * over, parsed).alias("oversized_pct"),
    )


def identity_key(df: DataFrame, key: str = "mol_key", structure: str = "canonical_smiles") -> Column:
    """``key`` when every row has one, else ``structure`` for the whole dataset."""
    all_keyed = df.agg(F.coalesce(F.every(F.col(key).isNotNull()), F.lit(True))).scalar()
    return F.when(all_keyed, F.col(key)).otherwise(F.col(structure))


def known(df: DataFrame, label: str) -> Column:
    """The label, or null where it is NaN: a missing measurement is no value of its own."""
    numeric = df.schema[label].dataType.typeName() in ("double", "float")
    return F.when(~F.isnan(label), F.col(label)) if numeric else F.col(label)


def _representatives(first: list[str], row_index: str) -> list[Column]:
    # first non-null value in input order, independent of task order
    return [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(row_index))).alias(c) for c in first]


def dedup_mean(df: DataFrame, key: str, labels: list[str], first: list[str], row_index: str) -> DataFrame:
    """One row per key: mean of each label, first representative in input order."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            *_representatives(first, row_index),
            *[F.avg(known(df, c)).alias(c) for c in labels],
            F.count(F.lit(1)).alias("n_rows"),
        )
    )


def dedup_majority(df: DataFrame, key: str, labels: list[str], first: list[str], row_index: str) -> DataFrame:
    """One row per key: most frequent label, ties to the lowest, all-null to null.

    Two steps in one pass over the input: counts per (key, label, value), which reduces a
    hot key before it meets, then the vote.  Labels must share a type.
    """
    votes = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), known(df, c).alias("value")) for i, c in enumerate(labels)]))
    counted = (
        df.where(F.col(key).isNotNull())
        .select(key, *({row_index, *first} - {key}), votes.alias("_v"))
        .groupBy(key, F.col("_v.which").alias("_which"), F.col("_v.value").alias("_value"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.min(F.when(F.col(c).isNotNull(), F.struct(row_index, c))).alias(f"_first_{c}") for c in first],
        )
    )
    value, n = F.col("_value"), F.col("_n")
    picks = [
        F.min_by(value, F.when((F.col("_which") == i) & value.isNotNull(), F.struct(-n, value))).alias(c)
        for i, c in enumerate(labels)
    ]
    return counted.groupBy(key).agg(
        *[F.min(f"_first_{c}")[c].alias(c) for c in first],
        *picks,
        F.sum(F.when(F.col("_which") == 0, n)).alias("n_rows"),
    )


def clean_dataset(
    df: DataFrame,
    labels: list[str],
    task: str,
    key: str = "mol_key",
    structure: str = "canonical_smiles",
    size: str | None = "heavy_atoms",
    row_index: str = "row_index",
) -> DataFrame:
    """Drop invalid and oversized rows, then collapse duplicates per identity key."""
    kept = usable_rows(df, structure, size)
    keyed = kept.withColumn("key", identity_key(kept, key, structure))
    first = [structure] + ([size] if size else [])
    collapse = dedup_mean if task == "regression" else dedup_majority
    return collapse(keyed, "key", labels, first, row_index)


def distinct_count(column: str) -> Column:
    """Distinct values that are not null, told apart by 96 bits of hash, so that no long text is shuffled."""
    return F.count_distinct(F.xxhash64(column), F.crc32(F.col(column).cast("string")))


def collapse_report(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and merged duplicates."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), distinct_count(key).alias("n_unique"))
    return counts.withColumn("n_merged", F.col("n_rows") - F.col("n_unique"))


def label_conflicts(df: DataFrame, key: str, label: str, task: str) -> DataFrame:
    """Rows of keys whose labels disagree: spread above 1e-9, or more than one class; NaN is no label.

    ``in_key_order`` sorts them for a report.
    """
    if task == "regression":
        test = F.stddev_samp(known(df, label)) > 1e-9
    else:
        # one class only means lowest equals highest: no distinct set is built
        test = F.min(known(df, label)) != F.max(known(df, label))
    bad = df.where(F.col(key).isNotNull()).groupBy(key).agg(test.alias("_bad")).where("_bad").select(key)
    return df.join(bad, key, "left_semi").select(key, label)


def in_key_order(conflicts: DataFrame, key: str, label: str) -> DataFrame:
    """Conflict rows as they are reported: by key, labels ascending."""
    return conflicts.orderBy(F.col(key).asc_nulls_last(), F.col(label).asc_nulls_last())


def duplicate_count(column: str) -> Column:
    """Repeats after the first occurrence; nulls count as equal to each other."""
    has_null = F.when(F.count_if(F.col(column).isNull()) > 0, 1).otherwise(0)
    return F.count(F.lit(1)) - distinct_count(column) - has_null


def adjusted_skew(column: str) -> Column:
    """Bias-adjusted skewness; null below three values, 0 for constant data."""
    n = F.count(column).cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    population = F.when(F.min(column) == F.max(column), 0.0).otherwise(F.skewness(column))
    return F.when(F.count(column) >= 3, factor * population)


def size_profile(df: DataFrame, by: list[str], structure: str, size: str) -> DataFrame:
    """Rows, unparseable, mean and maximum size, over-cap share of parsed, duplicates."""
    parsed = F.count(size)
    over = F.count_if(F.col(size) > MAX_HEAVY_ATOMS)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.lit(1)) - parsed).alias("unparseable"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("heavy_mean"),
        F.coalesce(F.max(size), F.lit(0)).alias("heavy_max"),
        over.alias("over_cap"),
        (100.0 * over / F.greatest(parsed, F.lit(1))).alias("over_cap_pct"),
        duplicate_count(structure).alias("duplicate_smiles"),
    )


def binary_profile(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Positive rate, imbalance flag on the unrounded rate, and class weight."""
    rates = df.withColumn("_y", to_number(F.col(label))).groupBy(*by).agg(F.avg("_y").alias("positive_rate"))
    p = F.col("positive_rate")
    return rates.withColumn("imbalanced", (p < 0.2) | (p > 0.8)).withColumn(
        "pos_weight", F.when((p > 0) & (p < 1), F.try_divide(1 - p, p))
    )


def regression_profile(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Mean, sample deviation, range and adjusted skew; long-tailed beyond |skew| 1."""
    out = df.withColumn("_y", to_number(F.col(label))).groupBy(*by).agg(
        F.avg("_y").alias("target_mean"),
        F.stddev_samp("_y").alias("target_std"),
        F.min("_y").alias("target_min"),
        F.max("_y").alias("target_max"),
        adjusted_skew("_y").alias("target_skew"),
    )
    return out.withColumn("long_tailed", F.abs("target_skew") > 1.0)


def profile(df: DataFrame, endpoints: DataFrame, structure: str = "Drug", label: str = "Y", size: str = "heavy_atoms") -> DataFrame:
    """Full profile, one row per registered endpoint; ``df`` carries ``endpoint``.

    The registry has twelve rows, and the three profiles at most one row per endpoint.
    """
    meta = endpoints.select(F.col("code").alias("endpoint"), "tdc_name", "category", "task", "expected_n")
    known = df.join(broadcast_if_small(meta.select("endpoint", "task")), "endpoint")
    sizes = size_profile(known, ["endpoint"], structure, size)
    cls = binary_profile(known.where(F.col("task") == "binary"), ["endpoint"], label)
    reg = regression_profile(known.where(F.col("task") == "regression"), ["endpoint"], label)
    return sizes.join(meta, "endpoint").join(cls, "endpoint", "left").join(reg, "endpoint", "left")


def profile_total(profiles: DataFrame) -> DataFrame:
    """Grand totals over endpoints: rows, over-cap molecules and their share."""
    return profiles.agg(
        F.sum("n_rows").alias("total_rows"),
        F.sum("over_cap").alias("total_over_cap"),
        F.try_divide(100.0 * F.sum("over_cap"), F.sum("n_rows")).alias("over_cap_pct"),
    )


def profile_warnings(profiles: DataFrame) -> DataFrame:
    """One row per finding: imbalance, long tail, unparseable, over cap."""
    found = F.array(
        F.when(F.col("imbalanced"), F.struct(F.lit("imbalanced").alias("finding"), F.col("pos_weight").alias("value"))),
        F.when(F.col("long_tailed"), F.struct(F.lit("long_tailed").alias("finding"), F.col("target_skew").alias("value"))),
        F.when(
            F.col("unparseable") > 0,
            F.struct(F.lit("unparseable").alias("finding"), F.col("unparseable").cast("double").alias("value")),
        ),
        F.when(
            F.col("over_cap") > 0,
            F.struct(F.lit("over_cap").alias("finding"), F.col("over_cap").cast("double").alias("value")),
        ),
    )
    rows = profiles.select("endpoint", F.explode(F.filter(found, lambda w: w.isNotNull())).alias("w"))
    return rows.select("endpoint", "w.finding", "w.value")


def drift_verdict(documented: DataFrame, profiles: DataFrame, by: str = "endpoint") -> DataFrame:
    """Compare profiled counts with documented ones; unmatched entries are reported.

    ``documented`` has (by, expected_n); ``profiles`` has (by, n_rows, duplicate_smiles).
    """
    joined = documented.join(profiles.select(by, "n_rows", "duplicate_smiles"), by, "left")
    unique = F.col("n_rows") - F.col("duplicate_smiles")
    gap = unique - F.col("expected_n")
    verdict = (
        F.when(F.col("n_rows").isNull() & F.col("duplicate_smiles").isNull(), "unprofiled")
        .when(unique.isNull(), "incomplete_profile")
        .when(gap == 0, "duplicates")
        .when(F.col("n_rows") == F.col("expected_n"), "equal")
        .otherwise("unexplained")
    )
    return joined.select(by, "expected_n", "n_rows", unique.alias("n_unique"), gap.alias("off_by"), verdict.alias("verdict"))


def drift_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count_if(F.col("verdict").isin("duplicates", "equal")).alias("explained"),
        F.count_if(F.col("verdict") == "unexplained").alias("unexplained"),
    )


def split_sanity(df: DataFrame, split: str, target: str) -> DataFrame:
    """Per-split size, mean and deviation of a regression target."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean"), F.stddev_samp(target).alias("sd")
    )


def multilabel_rates(df: DataFrame, split: str, labels: list[str]) -> DataFrame:
    """Per split and label: labelled rows, positive rate, and a flag when none is labelled."""
    tall = df.unpivot([split], labels, "label", "y")
    return tall.groupBy(split, "label").agg(
        F.count("y").alias("n_labelled"),
        F.avg("y").alias("positive_rate"),
        (F.count("y") == 0).alias("no_labels"),
    )


def mean_of_rates(rates: DataFrame, split: str) -> DataFrame:
    return rates.groupBy(split).agg(F.avg("positive_rate").alias("mean_rate"), F.count_if("no_labels").alias("n_empty"))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    gone = missing_columns(df, required)
    if gone:
        raise ValueError(f"missing required columns {gone}; found {df.columns}")
    return df


def first_present(df: DataFrame, aliases: list[str]) -> str:
    """First of several possible column names that the table has."""
    for name in aliases:
        if name in df.columns:
            return name
    raise ValueError(f"none of {aliases} among {df.columns}")
