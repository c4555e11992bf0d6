"""Tables of the store: Parquet by default, JDBC where a database is wanted."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molscreen.schemas import BULK_CHUNK

# One table per stored entity; predictions are keyed by (molecule, model version).
TABLES = {
    "molecules": "inchikey STRING, canonical_smiles STRING, n_heavy_atoms INT, mol_weight DOUBLE, words ARRAY<BIGINT>",
    "endpoints": "code STRING, tdc_name STRING, category STRING, task STRING, unit STRING, output_index INT",
    "model_versions": "version STRING, is_active BOOLEAN, metrics MAP<STRING, DOUBLE>, created_at TIMESTAMP",
    "predictions": "prediction_id BIGINT, inchikey STRING, model_version STRING, triage_score DOUBLE, similarity DOUBLE, status STRING, latency_ms DOUBLE, created_at TIMESTAMP",
    "prediction_values": "prediction_id BIGINT, endpoint STRING, value DOUBLE",
    "batches": "batch_id STRING, status STRING, total_rows BIGINT, completed_rows BIGINT, failed_rows BIGINT, created_at TIMESTAMP, finished_at TIMESTAMP",
}


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Create whatever tables are missing; running it again changes nothing."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return list(TABLES)


#: Steps of the store's layout: (number, statement), applied once each, in order.
MIGRATIONS = [(i + 1, f"CREATE TABLE IF NOT EXISTS {{database}}.{name} ({columns}) USING parquet") for i, (name, columns) in enumerate(TABLES.items())]
LEDGER = "number INT, checksum STRING, applied_at TIMESTAMP"


def checksum(statement: str) -> str:
    return hashlib.sha256(statement.encode()).hexdigest()


def migration_faults(ledger: DataFrame, steps: list[tuple[int, str]]) -> DataFrame:
    """(number, fault): what stands between the ledger and the steps: changed, missing, skipped or repeated ones."""
    spark = ledger.sparkSession
    known = spark.createDataFrame([(n, checksum(s)) for n, s in steps], "number int, expected string")
    applied = ledger.groupBy("number").agg(F.count(F.lit(1)).alias("times"), F.min("checksum").alias("low"), F.max("checksum").alias("checksum"))
    last = ledger.agg(F.max("number").alias("_last"))  # one row
    both = known.join(applied, "number", "full_outer").crossJoin(last)
    fault = (
        F.when(F.col("expected").isNull(), "unknown step")
        .when((F.col("times") > 1) | (F.col("low") != F.col("checksum")), "applied more than once")
        .when(F.col("checksum") != F.col("expected"), "changed after it was applied")
        .when(F.col("times").isNull() & (F.col("number") < F.col("_last")), "skipped")
    )
    return both.select("number", fault.alias("fault")).where("fault is not null")


def migrate(spark: SparkSession, ledger: str, steps: list[tuple[int, str]] | None = None, **names: str) -> list[int]:
    """Apply the steps that the ledger (a Parquet folder) does not hold yet; the numbers of those applied now.

    Only forward: a ledger that does not agree with the steps is refused before anything runs.
    A step is noted after it ran, so one that was interrupted runs again; statements must allow that.
    """
    steps = MIGRATIONS if steps is None else steps
    if [n for n, _ in steps] != sorted({n for n, _ in steps}):
        raise ValueError("steps must have rising numbers")
    try:
        held = spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = spark.createDataFrame([], LEDGER)
    faults = migration_faults(held, steps).orderBy("number").collect()  # at most one row per step
    if faults:
        raise RuntimeError("; ".join(f"step {r['number']}: {r['fault']}" for r in faults))
    done = {r["number"] for r in held.select("number").collect()}
    new = [(n, s) for n, s in steps if n not in done]
    for n, statement in new:
        spark.sql(statement.format(**{"database": "default", **names}))
        spark.createDataFrame([(n, checksum(statement))], "number int, checksum string").withColumn("applied_at", F.current_timestamp()).coalesce(1).write.mode(
            "append"
        ).parquet(ledger)
    return [n for n, _ in new]


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options
) -> DataFrame:
    """Read a database table, split on a numeric key so that no single task reads it whole."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key is not None:
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, **options) -> None:
    """Append in chunks of 1000 rows per statement batch."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=BULK_CHUNK, **options).mode("append").save()


def all_fingerprints(molecules: DataFrame) -> DataFrame:
    """(ref_id, words) of every stored molecule that has a fingerprint."""
    return molecules.where("words IS NOT NULL").selectExpr("inchikey AS ref_id", "words")
