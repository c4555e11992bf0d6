"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import molscreen

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # capturing call sites for error messages doubles the time to build large plans
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Single-machine session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("molscreen")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Give this package's modules to the Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_molscreen_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(molscreen.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="molscreen-"), "molscreen.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("molscreen", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._molscreen_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir``, or a local one where unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    # one folder for the application, gone with it
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.TemporaryDirectory(prefix="molscreen-", ignore_cleanup_errors=True)
    return _LOCAL[application].name


_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Store an expensive intermediate as Parquet in the shared folder and read it back.

    Later jobs then read only the columns they need, and losing executors costs nothing.
    """
    path = f"{shared_dir(df.sparkSession)}/molscreen-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Broadcast hint for a narrow side of at most ``rows`` rows: counted, reading no more than that."""
    return F.broadcast(df) if df.select(F.lit(1)).limit(rows + 1).count() <= rows else df


def work_partitions(spark: SparkSession) -> int:
    """Partitions for work that costs far more than its bytes suggest (adaptive merging is by bytes)."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def opaque(fn, schema: str):
    """Arrow function that the optimizer evaluates exactly once per row.

    Filters on an expensive function's result would otherwise be pushed below it with a
    second copy of the call.
    """
    return F.arrow_udf(fn, schema).asNondeterministic()
