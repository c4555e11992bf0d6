"""Train / validation / test splits that keep whole groups together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molscreen.operators.running import hash_bucket, running_sum
from molscreen.session import broadcast_if_small


def _check(fractions: tuple[float, float, float]) -> None:
    if abs(sum(fractions) - 1.0) >= 1e-6:
        raise AssertionError(f"the three shares {fractions} do not make a whole")


def seeded_hash(key: Column, seed: int) -> Column:
    """Uniform 60-bit hash of a key under a seed, the same in any engine that has MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def fill_quotas(classes: list[tuple[int, int]], fractions: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """(size, groups to train, groups to validation) for (size, group count) classes.

    Groups of one size are interchangeable to a greedy first-fit, so it can be decided
    class by class, biggest first: as many as still fit train, then validation, rest test.
    """
    total = sum(size * n for size, n in classes)
    room_train, room_val = int(fractions[0] * total), int(fractions[1] * total)
    quotas = []
    for size, n in sorted(classes, reverse=True):
        to_train = min(n, room_train // size)
        to_val = min(n - to_train, room_val // size)
        room_train -= to_train * size
        room_val -= to_val * size
        quotas.append((size, to_train, to_val))
    return quotas


def assign_groups(
    df: DataFrame, group: str, fractions: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, row_index: str | None = None
) -> DataFrame:
    """(group, n, split): greedy first-fit, biggest groups first, seeded order among equals.

    With ``row_index`` groups of one size keep the order in which they first appear.

    Only the distinct group sizes reach the driver.  N rows have at most sqrt(2N)
    distinct sizes, because distinct sizes must add up to no more than N.
    """
    _check(fractions)
    first = [F.min(row_index).cast("bigint").alias("_h")] if row_index else []
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *first)
    classes = [(r["n"], r["c"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()]
    quotas = df.sparkSession.createDataFrame(
        fill_quotas(classes, fractions) or [(0, 0, 0)], "n bigint, to_train bigint, to_val bigint"
    )
    # many distinct sizes are joined by shuffle
    ordered = sizes.join(broadcast_if_small(quotas), "n")
    if not row_index:
        ordered = ordered.withColumn("_h", seeded_hash(F.col(group), seed))
    ranked = running_sum(
        ordered.withColumn("_one", F.lit(1).cast("bigint")),
        "_h",
        {"_one": "_rank"},
        by=["n"],
        ties=[group],
        # first appearances are no uniform numbers: ranges by their own quantiles
        bucket=None if row_index else hash_bucket("_h", 60, sum(c for _, c in classes)),
    )
    split = (
        F.when(F.col("_rank") <= F.col("to_train"), "train")
        .when(F.col("_rank") <= F.col("to_train") + F.col("to_val"), "val")
        .otherwise("test")
    )
    return ranked.select(group, "n", split.alias("split"))


def group_split(
    df: DataFrame, group: str, fractions: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, row_index: str | None = None
) -> DataFrame:
    """Every row with its ``split``; a group never spans two splits."""
    assigned = assign_groups(df, group, fractions, seed, row_index).withColumnRenamed(group, "_g")
    return df.join(assigned.select("_g", "split"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def random_split_on(key: Column, fractions: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> Column:
    """Split of a row from its identity key alone, so it agrees across endpoints and runs."""
    _check(fractions)
    train, val, _ = (round(f * 1_000_000) for f in fractions)
    slot = F.pmod(seeded_hash(key, seed), F.lit(1_000_000))
    return F.when(slot < train, "train").when(slot < train + val, "val").otherwise("test")
