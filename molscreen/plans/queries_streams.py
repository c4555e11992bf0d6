"""Queries that run as file streams over stored copies of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from molscreen.operators.rank import score_order, with_rank
from molscreen.plans.tables import read
from molscreen.session import shared_dir
from molscreen.streaming import batches as T

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def _stream(spark, rows, name: str):
    """Store rows as eight files and open them as a stream of two files per micro-batch."""
    spread = rows.repartition(8)
    folder = f"{shared_dir(spark)}/molscreen-{name}-{uuid.uuid4().hex}"
    spread.write.parquet(folder)
    stored = rows
    return T.file_stream(spark, folder, stored.schema, files_per_trigger=2), f"{shared_dir(spark)}/molscreen-{name}-run-{uuid.uuid4().hex}"


@query(
    """
    WITH s AS (SELECT event_id, lpad(CAST(user_id AS VARCHAR), 8, '0') AS inchikey,
        CASE WHEN event_id % 50 = 7 THEN 'NaN'::DOUBLE ELSE value END AS score FROM events)
    SELECT event_id, inchikey, score, row_number() OVER (ORDER BY isnan(score), score DESC, inchikey DESC, event_id) AS rank
    FROM s ORDER BY isnan(score), score DESC, inchikey DESC, event_id LIMIT 100
    """
)
def stream_topk(spark, sf_dir):
    """Single-pass ranking of a streamed batch: the best hundred, NaN last."""
    rows = read(spark, sf_dir, "events").select(
        "event_id",
        F.lpad(F.col("user_id").cast("string"), 8, "0").alias("inchikey"),
        F.when(F.col("event_id") % 50 == 7, float("nan")).otherwise(F.col("value")).alias("score"),
    )
    stream, root = _stream(spark, rows, "topk")
    T.rank_stream(stream, root, 100, row_index="event_id").awaitTermination()
    return with_rank(T.ranked(spark, root, 100, row_index="event_id"), score_order(row_index="event_id"))


@query(
    """
    SELECT count(*) AS rows_done, count(*) FILTER (WHERE event_type = 'error') AS rows_failed, 4 AS batches,
      CAST(ceil(count(*) / 1000.0) * 4 AS BIGINT) AS steps, 0 AS too_long FROM events
    """
)
def stream_progress(spark, sf_dir):
    """Progress of a streamed batch every 250 rows: the last event accounts for every row."""
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("bad"))
    stream, root = _stream(spark, rows, "progress")
    T.progress_stream(stream, root, "bad", order="event_id").awaitTermination()
    events = T.progress(spark, root)
    too_long = T.rows_per_trigger_ok(events).agg(F.count(F.lit(1)).cast("int").alias("too_long"))
    return events.agg(
        F.max("rows_done").alias("rows_done"), F.max("rows_failed").alias("rows_failed"),
        F.count_distinct("batch").cast("int").alias("batches"), F.count(F.lit(1)).alias("steps"),
    ).crossJoin(too_long)  # one row each


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedup(spark, sf_dir):
    """Each (molecule, model version) is stored once over all micro-batches."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    stream, root = _stream(spark, rows, "dedup")
    T.dedup_stream(stream, root, ["user_id", "event_type"], "event_id").awaitTermination()
    return T.stored(spark, root).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
