"""Library batches as file streams: ranking, progress, deduplication and resume.

Every micro-batch writes its own folder, named by the batch id and replaced as a whole.  A
batch that is run again after a failure therefore leaves the same files, and results are
read as the union of the folders.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from molscreen.operators.rank import top_k
from molscreen.operators.store import latest_status
from molscreen.operators.store import progress as step_progress
from molscreen.schemas import BATCH_STATUSES, CHECKPOINT_ROWS, TERMINAL_STATUSES
from molscreen.session import materialise


def file_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1, fmt: str = "parquet") -> DataFrame:
    """Files of a folder as a stream, so many per micro-batch: that bounds what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)


def _folder(root: str, kind: str, batch_id: int) -> str:
    return f"{root}/{kind}/batch={batch_id}"


def _run(stream: DataFrame, root: str, name: str, handle) -> StreamingQuery:
    """Process everything available, then stop; the checkpoint lets a restart go on."""
    writer = stream.writeStream.foreachBatch(handle).trigger(availableNow=True)
    return writer.option("checkpointLocation", f"{root}/checkpoint-{name}").start()


def _read(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/{kind}").parquet(f"{root}/{kind}/batch=*")


def rank_stream(
    stream: DataFrame, root: str, k: int, score: str = "score", key: str = "inchikey", row_index: str | None = None
) -> StreamingQuery:
    """Carry the best ``k`` rows from micro-batch to micro-batch.

    Each batch's folder holds the best of all rows so far, made from the folder before it, so
    the state is ``k`` rows however many batches there are, and a replayed batch gives the same.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        seen = batch
        if batch_id > 0:
            seen = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(_folder(root, "top", batch_id - 1)))
        best = top_k(seen, k, score, key, row_index)
        best.coalesce(1).write.mode("overwrite").parquet(_folder(root, "top", batch_id))

    return _run(stream, root, "top", handle)


def ranked(
    spark: SparkSession, root: str, k: int, score: str = "score", key: str = "inchikey", row_index: str | None = None
) -> DataFrame:
    """The best ``k`` rows seen so far over all micro-batches: the last one's."""
    states = _read(spark, root, "top")
    last = states.agg(F.max("batch")).first()[0]  # from the folder names
    return top_k(states.where(F.col("batch") == last).drop("batch"), k, score, key, row_index)


def progress_stream(stream: DataFrame, root: str, failed: str, order: str | None = None, every: int = CHECKPOINT_ROWS) -> StreamingQuery:
    """Count rows and failures of each micro-batch, in steps of ``every`` rows along ``order``.

    Without an order a micro-batch is one step.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if order is None:
            counts = batch.agg(F.lit(0).cast("bigint").alias("step"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(failed)).alias("failed"))
        else:
            steps = step_progress(batch, order, failed, every)
            counts = steps.select(F.col("checkpoint").alias("step"), F.col("rows_done").alias("rows"), F.col("rows_failed").alias("failed"))
        counts.write.mode("overwrite").parquet(_folder(root, "progress", batch_id))

    return _run(stream, root, "progress", handle)


def progress(spark: SparkSession, root: str) -> DataFrame:
    """Rows done and failed so far, step by step: the batch's own count on top of the batches before it."""
    from pyspark.sql import Window

    steps = _read(spark, root, "progress")
    totals = steps.groupBy("batch").agg(F.max("rows").alias("rows_in"), F.max("failed").alias("failed_in"))
    # one row per micro-batch
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.select("batch", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("rows_in", "failed_in")])
    return steps.join(sums, "batch").select(
        "batch", "step", (F.col("rows_in") + F.col("rows")).alias("rows_done"), (F.col("failed_in") + F.col("failed")).alias("rows_failed")
    )


def rows_per_trigger_ok(progress_rows: DataFrame, every: int = CHECKPOINT_ROWS) -> DataFrame:
    """Steps that went further than ``every`` rows without a progress event.

    A micro-batch's first step starts where the batches before it ended.
    """
    from pyspark.sql import Window

    ends = progress_rows.groupBy("batch").agg(F.max("rows_done").alias("_end"))
    # one row per micro-batch
    start = F.lag("_end", 1, 0).over(Window.orderBy("batch")).alias("_start")
    rows = progress_rows.join(ends.select("batch", start), "batch")
    inside = Window.partitionBy("batch").orderBy("step")
    done = F.col("rows_done") - F.coalesce(F.lag("rows_done").over(inside), F.col("_start"))
    return rows.select("batch", "step", done.alias("rows_in_step")).where(F.col("rows_in_step") > every)


#: Buckets of the store of keys; more for stores of more keys.
BUCKETS = 16
#: Folders of one bucket that a batch reads at most; then they become one.
MERGED = 8


def key_bucket(keys: list[str], buckets: int = BUCKETS) -> Column:
    """Bucket of a key, the same in every batch."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def dedup_stream(stream: DataFrame, root: str, keys: list[str], order: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Store only keys not stored by an earlier micro-batch (molecule and model version).

    Within a micro-batch the first row in ``order`` wins.  Rows are stored in folders by key
    bucket, and their keys once more by themselves.  A batch reads the keys of the buckets that it
    touches, at most ``MERGED`` folders each, however many batches there were: a bucket that has
    as many is written anew as one.  A small index per batch says which folders hold a bucket.
    Everything a batch reads was written by lower batch ids, so running it again gives the same
    rows.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
        fresh = first.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).withColumn("_bucket", key_bucket(keys, buckets))
        fresh = materialise(fresh, "fresh")
        touched = sorted(r["_bucket"] for r in fresh.select("_bucket").distinct().collect())  # at most the buckets
        index = _index(spark, root, batch_id)
        kinds = fresh.select(*keys, "_bucket").schema
        folders = [f"{_folder(root, 'keys', at)}/_bucket={b}" for b in touched for at in index.get(b, [])]
        known = None
        if folders:
            schema = T.StructType([f for f in kinds if f.name != "_bucket"])
            known = spark.read.schema(schema).parquet(*folders).withColumn("_bucket", key_bucket(keys, buckets))
            same = [fresh[k].eqNullSafe(known[k]) for k in ["_bucket", *keys]]
            fresh = materialise(fresh.join(known, functools.reduce(lambda a, b: a & b, same), "left_anti"), "new")
        fresh.write.mode("overwrite").partitionBy("_bucket").parquet(_folder(root, "store", batch_id))
        held = fresh.select(*keys, "_bucket")
        full = [b for b in touched if len(index.get(b, [])) >= MERGED]
        if full:
            held = held.unionByName(known.where(F.col("_bucket").isin(full)))
        held.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(_folder(root, "keys", batch_id))
        added = {r["_bucket"] for r in spark.read.parquet(_folder(root, "keys", batch_id)).select("_bucket").distinct().collect()} if not held.isEmpty() else set()
        after = {b: ([] if b in full else index.get(b, [])) + ([batch_id] if b in added else []) for b in {*index, *added}}
        rows = [(b, at) for b, ats in sorted(after.items()) for at in ats]
        spark.createDataFrame(rows, "bucket int, at bigint").coalesce(1).write.mode("overwrite").parquet(_folder(root, "index", batch_id))

    return _run(stream, root, "store", handle)


def _index(spark: SparkSession, root: str, batch_id: int) -> dict[int, list[int]]:
    """Which batches hold keys of every bucket, from the index of the batch before; at most ``MERGED`` rows per bucket."""
    out: dict[int, list[int]] = {}
    if batch_id > 0:
        for r in spark.read.schema("bucket int, at bigint").parquet(_folder(root, "index", batch_id - 1)).collect():
            out.setdefault(r["bucket"], []).append(r["at"])
    return out


def stored(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "store").drop("batch", "_bucket")


def dedup_within(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Stateful alternative: drop repeats that arrive within ``delay`` of the first."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def log_status(spark: SparkSession, path: str, batch_id: str, status: str, at: dt.datetime) -> None:
    """Append one entry to the status log."""
    if status not in BATCH_STATUSES:
        raise ValueError(f"unknown batch status {status!r}")
    row = spark.createDataFrame([(batch_id, status, at)], "batch_id string, status string, updated_at timestamp")
    row.coalesce(1).write.mode("append").parquet(path)


def create_batch(spark: SparkSession, path: str, batch_id: str, at: dt.datetime) -> None:
    log_status(spark, path, batch_id, "queued", at)


def finish_batch(spark: SparkSession, path: str, batch_id: str, status: str, at: dt.datetime) -> None:
    """Close a batch; only a terminal status does."""
    if status not in TERMINAL_STATUSES:
        raise ValueError(f"{status!r} is not a terminal status")
    log_status(spark, path, batch_id, status, at)


def statuses(spark: SparkSession, path: str) -> DataFrame:
    return latest_status(spark.read.parquet(path))
