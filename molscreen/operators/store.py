"""Operators over the stored tables: molecules, predictions, batches, model versions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molscreen.functions.validate import is_terminal, parse_status
from molscreen.operators.running import exact_percentiles, running_sum
from molscreen.schemas import CHECKPOINT_ROWS
from molscreen.session import broadcast_if_small


def find(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; a miss is an empty result, not an error."""
    return df.where(F.col(key) == F.lit(value))


def get(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup where a miss is an error."""
    found = find(df, key, value)
    if found.isEmpty():
        raise LookupError(f"no row with {key} = {value!r}")
    return found


def find_many(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``keys``; unknown keys are simply absent."""
    return df.join(keys.select(key), key, "left_semi")


def new_rows(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Incoming rows to insert: keys not stored yet, first row per key in input order."""
    rest = [c for c in incoming.columns if c != key]
    fresh = incoming.join(existing.select(key), key, "left_anti")
    picked = fresh.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(key, *[F.col("_row")[c].alias(c) for c in rest])


def insert_count(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """How many rows a bulk insert that skips known keys would add."""
    return (
        incoming.select(key)
        .join(existing.select(key), key, "left_anti")
        .agg(F.count_distinct(key).alias("n_inserted"))
    )


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The table after inserting unknown keys; stored rows win over incoming ones."""
    return existing.unionByName(new_rows(existing, incoming, key, order).select(existing.columns))


def cache_probe(requests: DataFrame, predictions: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """Requests with the stored prediction, if any, and a ``cached`` flag."""
    stored = predictions.select(*keys, *carry).withColumn("_hit", F.lit(True))
    return requests.join(stored, keys, "left").withColumn("cached", F.col("_hit").isNotNull()).drop("_hit")


def with_values(predictions: DataFrame, values: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Predictions with their endpoint values as one array in output order.

    The registry is twelve rows; a prediction has at most one value per endpoint.
    """
    meta = endpoints.select(F.col("code").alias("endpoint"), "output_index")
    packed = (
        values.join(broadcast_if_small(meta), "endpoint")
        .groupBy("prediction_id")
        .agg(F.array_sort(F.collect_list(F.struct("output_index", "endpoint", "value"))).alias("values"))
    )
    return predictions.join(packed, "prediction_id", "left")


def to_wide(values: DataFrame, codes: list[str], by: str = "prediction_id") -> DataFrame:
    """One column per endpoint; (``by``, endpoint) is unique, so any aggregate picks the value.

    Conditional aggregates need one hash pass, where a pivot groups twice.
    """
    return values.groupBy(by).agg(*[F.max(F.when(F.col("endpoint") == c, F.col("value"))).alias(c) for c in codes])


def to_tall(wide: DataFrame, codes: list[str], by: str = "prediction_id") -> DataFrame:
    return wide.unpivot([by], codes, "endpoint", "value").where(F.col("value").isNotNull())


def endpoint_filter(values: DataFrame, endpoint: str, below: float) -> DataFrame:
    """Predictions whose value for one endpoint lies below a bound."""
    return values.where((F.col("endpoint") == endpoint) & (F.col("value") < below))


def orphaned(batches: DataFrame, now: dt.datetime, minutes: int) -> DataFrame:
    """Running batches created more than ``minutes`` before ``now`` (in the session's time zone)."""
    edge = (now - dt.timedelta(minutes=minutes)).isoformat(sep=" ")
    created = batches.schema["created_at"].dataType
    return batches.where((F.col("status") == "running") & (F.col("created_at") < F.lit(edge).cast(created)))


def active_version(versions: DataFrame) -> DataFrame:
    """The one active model version; none or several is an error."""
    active = versions.where("is_active")
    n = active.limit(2).count()
    if n != 1:
        raise LookupError("no active model version" if n == 0 else "more than one active model version")
    return active


def recent(batches: DataFrame, limit: int, created: str = "created_at", key: str = "batch_id") -> DataFrame:
    return batches.orderBy(F.col(created).desc(), F.col(key)).limit(limit)


def latency_percentiles(df: DataFrame, latency: str, created: str, since_hours: float, now=None) -> DataFrame:
    """Exact p50, p95, p99 and count of latencies in the last hours before ``now``.

    ``now`` defaults to the newest row, read inside the plan.
    """
    clock = F.lit(now) if now is not None else df.agg(F.max(created)).scalar()
    edge = clock - F.expr(f"INTERVAL {int(since_hours * 3600)} SECONDS")
    recent_rows = df.where(F.col(created) >= edge)
    return exact_percentiles(recent_rows, latency, {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def batch_counters(rows: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Completed and failed rows per batch; a row fails when it has an error code."""
    bad = F.col("error_code").isNotNull()
    return rows.groupBy(batch).agg(
        F.count_if(~bad).alias("completed_rows"), F.count_if(bad).alias("failed_rows")
    )


def latest_status(log: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Current status of each batch from its status log; unknown statuses are ignored.

    A terminal status is final: nothing logged later replaces it.
    """
    valid = log.withColumn("status", parse_status(F.col("status"))).where(F.col("status").isNotNull())
    done = is_terminal(F.col("status"))
    # first terminal entry if there is one, else the newest entry
    first_end = F.min_by("status", F.when(done, F.col("updated_at")))
    newest = F.max_by("status", F.col("updated_at"))
    return valid.groupBy(batch).agg(F.coalesce(first_end, newest).alias("status"))


def progress(rows: DataFrame, order: str, failed: str, every: int = CHECKPOINT_ROWS) -> DataFrame:
    """One progress event per ``every`` rows of a batch: rows done and failed so far."""
    ones = rows.select(
        order, F.lit(1).cast("bigint").alias("_one"), F.col(failed).cast("bigint").alias("_bad")
    )
    cum = running_sum(ones, order, {"_one": "_done", "_bad": "_failed"})
    step = F.floor((F.col("_done") - 1) / every).cast("bigint")
    return cum.groupBy(step.alias("checkpoint")).agg(
        F.count(F.lit(1)).alias("rows_in_step"),
        F.max("_done").alias("rows_done"),
        F.max("_failed").alias("rows_failed"),
    )


def progress_by_index(rows: DataFrame, batch: str, row_index: str, failed: str, every: int = CHECKPOINT_ROWS) -> DataFrame:
    """Progress of many batches at once when rows carry their position in the file.

    Steps are counted first; only those counts (1 per ``every`` rows) are accumulated.
    """
    step = F.floor(F.col(row_index) / every).cast("bigint")
    steps = rows.groupBy(batch, step.alias("checkpoint")).agg(
        F.count(F.lit(1)).alias("rows_in_step"), F.count_if(F.col(failed)).alias("failed_in_step")
    )
    # ranges of checkpoints are summed first, so one huge batch is not one window partition
    sums = running_sum(steps, "checkpoint", {"rows_in_step": "rows_done", "failed_in_step": "rows_failed"}, by=[batch])
    return sums.select(batch, "checkpoint", "rows_in_step", "rows_done", "rows_failed")


def compare_with_reference(
    candidates: DataFrame, reference: DataFrame, value: str, name: str = "pct_below"
) -> DataFrame:
    """Share of reference values strictly below each candidate value.

    Both sides are counted per distinct value first, so a common value is one row.
    """
    cand = candidates.groupBy(value).agg(F.lit(0).cast("bigint").alias("_ref"))
    ref = reference.groupBy(value).agg(F.count(F.lit(1)).alias("_ref"))
    merged = cand.unionByName(ref).where(F.col(value).isNotNull()).groupBy(value).agg(F.sum("_ref").alias("_ref"))
    cum = running_sum(merged, value, {"_ref": "_cum"})
    share = F.try_divide((F.col("_cum") - F.col("_ref")).cast("double"), F.col("_cum_total").cast("double"))
    ranks = cum.select(F.col(value).alias("_v"), share.alias(name))
    return candidates.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def set_differences(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Identifiers present on one side only, with the side named."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return (
        a.join(b, column, "left_anti").withColumn("only_in", F.lit("left"))
        .unionByName(b.join(a, column, "left_anti").withColumn("only_in", F.lit("right")))
    )


def extract_identifiers(df: DataFrame, text: str, pattern: str, name: str = "identifier") -> DataFrame:
    """Distinct regular-expression matches over whole texts."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    return df.select(F.explode(F.array_distinct(found)).alias(name)).distinct()
