"""Model-quality metrics over (endpoint, label, score) tables.

Rows are first counted per distinct score, so ties are single rows and no metric ranks
raw rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molscreen.operators.running import running_sum


def _score_counts(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    kept = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return kept.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )


def auroc(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve by mid-ranks; null when a class is missing."""
    cum = running_sum(_score_counts(df, by, label, score), score, {"_neg": "_cn", "_pos": "_cp"}, by=by)
    # twice the pairs won, kept whole so that the sum is exact
    big = lambda c: c.cast("decimal(38,0)")  # noqa: E731  pair counts outgrow 64 bits
    won2 = F.sum(big(F.col("_pos")) * big(2 * (F.col("_cn") - F.col("_neg")) + F.col("_neg")))
    n_pos, n_neg = F.max("_cp_total"), F.max("_cn_total")
    area = F.try_divide(won2.cast("double"), (2.0 * big(n_pos).cast("double") * big(n_neg).cast("double")))
    return cum.groupBy(*by).agg(n_pos.alias("n_pos"), n_neg.alias("n_neg"), area.alias("auroc"))


def auprc(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Average precision: precision at each distinct score, weighted by the recall gained."""
    cum = running_sum(
        _score_counts(df, by, label, score), score, {"_neg": "_cn", "_pos": "_cp"}, by=by, ascending=False
    )
    precision = F.col("_cp") / (F.col("_cp") + F.col("_cn"))
    gained = F.col("_pos") / F.nullif(F.col("_cp_total"), F.lit(0))
    return cum.groupBy(*by).agg(F.sum(precision * gained).alias("auprc"))


def mae(df: DataFrame, by: list[str], actual: str, predicted: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae"))


def _mid_ranks(counts: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    per_value = counts.groupBy(*by, value).agg(F.sum("_n").alias("_n"))
    cum = running_sum(per_value, value, {"_n": "_c"}, by=by)
    mid = (F.col("_c") - F.col("_n")).cast("double") + (F.col("_n") + 1) / 2.0
    return cum.select(*by, value, mid.alias(name))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Spearman correlation: Pearson correlation of mid-ranks, weighted by pair counts."""
    kept = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = kept.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_n"))
    ranked = pairs.join(_mid_ranks(pairs, by, x, "_rx"), [*by, x]).join(_mid_ranks(pairs, by, y, "_ry"), [*by, y])
    n = F.col("_n")
    # ranks always average (N+1)/2, so centring needs no second pass
    total = ranked.groupBy(*by).agg(
        F.sum(n).alias("n"),
        F.sum(n * F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(n * F.col("_rx") * F.col("_rx")).alias("_xx"),
        F.sum(n * F.col("_ry") * F.col("_ry")).alias("_yy"),
    )
    shift = F.col("n") * ((F.col("n") + 1) / 2.0) * ((F.col("n") + 1) / 2.0)
    rho = F.try_divide(
        F.col("_xy") - shift, F.sqrt(F.col("_xx") - shift) * F.sqrt(F.col("_yy") - shift)
    )
    return total.select(*by, "n", rho.alias("spearman"))


def seed_summary(scores: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Mean and sample deviation of a metric over the split seeds."""
    return scores.groupBy(*by).agg(
        F.count(metric).alias("n_seeds"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd")
    )


def masked_loss(tall: DataFrame, by: str, loss: str) -> DataFrame:
    """Mean loss over the endpoints a molecule has labels for, then over molecules."""
    per_molecule = tall.where(F.col(loss).isNotNull()).groupBy(by).agg(F.avg(loss).alias("loss"))
    return per_molecule.agg(F.count(F.lit(1)).alias("n_molecules"), F.avg("loss").alias("mean_loss"))
