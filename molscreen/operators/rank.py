"""Composite scores and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molscreen.functions import desirability as D
from molscreen.session import broadcast_if_small


def score_order(score: str = "score", key: str = "inchikey", row_index: str | None = None) -> list[Column]:
    """Best first: score down, then key down; NaN below every number, null last of all."""
    s = F.col(score)
    cols = [s.isNull().asc(), F.isnan(s).asc(), s.desc(), F.col(key).desc()]
    return cols + ([F.col(row_index).asc()] if row_index else [])


def top_k(
    df: DataFrame, k: int, score: str = "score", key: str = "inchikey", row_index: str | None = None
) -> DataFrame:
    """Best ``k`` rows; every task keeps only its own best ``k`` before the merge."""
    return df.orderBy(*score_order(score, key, row_index)).limit(max(k, 0))


def with_rank(best: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number the rows of an already limited result from 1."""
    return best.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def top_k_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Best ``k`` rows of each group; map tasks cut to ``k`` per group before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, rn.cast("bigint")).where(F.col(name) <= k)


def batch_ranking(df: DataFrame, batch: str, k: int, score: str = "triage_score", key: str = "inchikey") -> DataFrame:
    """Per batch, best scores first with withheld (null) scores last."""
    return top_k_per_group(df, [batch], [F.col(score).desc_nulls_last(), F.col(key).desc()], k)


def next_page(
    df: DataFrame, size: int, after: tuple[float, str] | None, score: str = "score", key: str = "inchikey"
) -> DataFrame:
    """Keyset page: the rows that follow the (score, key) of the last row seen."""
    if after is not None:
        last_score, last_key = after
        s = F.col(score)
        same_key = F.col(key) < F.lit(last_key)
        if last_score is None:
            df = df.where(s.isNull() & same_key)
        elif last_score != last_score:  # NaN: only NaN and null rows follow
            df = df.where(s.isNull() | (F.isnan(s) & same_key))
        else:
            later = s.isNull() | F.isnan(s) | (s < last_score) | ((s == last_score) & same_key)
            df = df.where(later)
    return top_k(df, size, score, key)


def triage_tall(values: DataFrame, endpoints: DataFrame, by: list[str]) -> DataFrame:
    """Composite score per molecule from tall (molecule, endpoint, value) rows.

    ``endpoints`` is the twelve-row registry, so it is always small enough to broadcast.
    """
    meta = endpoints.select(F.col("code").alias("endpoint"), "shape", "low", "high", "weight")
    terms = values.join(broadcast_if_small(meta), "endpoint").withColumn(
        "desirability", D.by_shape(F.col("value"), F.col("shape"), F.col("low"), F.col("high"))
    )
    return terms.groupBy(*by).agg(
        D.geometric_mean_agg(F.col("desirability"), F.col("weight")).alias("triage_score")
    )


def triage_wide(values: Column, endpoints: list[tuple]) -> Column:
    """Composite score of an array of endpoint values, without any shuffle.

    ``endpoints`` lists (code, shape, low, high, weight) in the order of the array.
    """
    curves = F.array(
        *[
            F.struct(
                F.lit(shape).alias("shape"),
                F.lit(low).cast("double").alias("low"),
                F.lit(high).cast("double").alias("high"),
                F.lit(float(weight)).alias("w"),
            )
            for _, shape, low, high, weight in endpoints
        ]
    )
    terms = F.zip_with(
        values,
        curves,
        lambda v, c: F.struct(D.by_shape(v, c["shape"], c["low"], c["high"]).alias("d"), c["w"].alias("w")),
    )
    return D.geometric_mean_array(terms)
