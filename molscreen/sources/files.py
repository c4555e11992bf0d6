"""File sources and sinks: endpoint CSVs, manifests, profiles, tensors, exports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molscreen.operators.clean import require_columns
from molscreen.schemas import ENDPOINTS, MAX_HEAVY_ATOMS, RAW_SCHEMA, SPLIT_SEEDS

SPLITS = ("train_val", "test")


def read_csv(spark: SparkSession, path, schema=RAW_SCHEMA, line_breaks: bool = False) -> DataFrame:
    """Headed CSV (plain or gzipped) with a fixed schema; no inference scan.

    Files with line breaks inside quotes cannot be split, so they are asked for by name.
    """
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", escape='"', multiLine=line_breaks)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path can be listed, on any file system Spark reads."""
    try:
        spark.read.format("binaryFile").load(path).limit(0).count()
        return True
    except AnalysisException:
        return False


def read_endpoints(spark: SparkSession, root: str, codes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, missing): all split files of all endpoints in one scan.

    Files, or folders of part files, are ``<root>/<endpoint>_<split>.csv``.  A missing one is
    reported, not fatal.  Endpoint and split come from that name.
    """
    names = [(c, s, f"{root}/{c}_{s}.csv") for c in (codes or [e[0] for e in ENDPOINTS]) for s in SPLITS]
    found = [n for n in names if exists(spark, n[2])]
    missing = spark.createDataFrame([n for n in names if n not in found], "endpoint string, split string, path string")
    if not found:
        empty = spark.createDataFrame([], RAW_SCHEMA)
        return empty.withColumns({"endpoint": F.lit(""), "split": F.lit("")}), missing
    place = r"([^/]*)_(train_val|test)\.csv(?:/[^/]*)?$"
    name = F.regexp_extract(F.col("_metadata.file_path"), place, 1)
    split = F.regexp_extract(F.col("_metadata.file_path"), place, 2)
    rows = read_csv(spark, [n[2] for n in found]).select("*", name.alias("endpoint"), split.alias("split"))
    return rows, missing


def stage(
    spark: SparkSession, sources: dict[str, str], target: str, required: list[str] | None = None, force: bool = False
) -> DataFrame:
    """Copy named CSV sources into ``target``; one status row each, failures do not stop the rest.

    A name already staged is skipped unless ``force``.  Remote fetching is left to whatever
    fills the source folder.
    """
    report = []
    for name, path in sources.items():
        out = f"{target}/{name}.csv"
        try:
            if not force and exists(spark, out):
                report.append((name, "skipped", None))
                continue
            df = spark.read.csv(path, header=True, escape='"')
            require_columns(df, required or [])
            df.write.mode("overwrite").csv(out, header=True, escape='"')
            report.append((name, "staged", None))
        except (AnalysisException, ValueError) as e:
            report.append((name, "failed", str(e).split("\n")[0][:300]))
    return spark.createDataFrame(report, "name string, status string, error string")


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a headed CSV, header not counted."""
    return spark.read.csv(path, header=True).count()


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    writer = df.write.mode("overwrite").options(header=True, escape='"', **keep)
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_manifest(counts: DataFrame, path: str, source: str) -> None:
    """Dataset manifest as one JSON object; ``counts`` has at most one row per endpoint."""
    entry = F.struct(*[c for c in counts.columns if c != "endpoint"])
    body = counts.agg(F.map_from_entries(F.collect_list(F.struct("endpoint", entry))).alias("endpoints")).select(
        F.lit(source).alias("source"),
        F.lit("Drug").alias("smiles_column"),
        F.lit("Y").alias("label_column"),
        F.array(*[F.lit(s) for s in SPLIT_SEEDS]).alias("prescribed_seeds"),
        "endpoints",
    )
    body.coalesce(1).write.mode("overwrite").json(path)


def write_profile(profiles: DataFrame, path: str) -> None:
    """Profile of all endpoints as one JSON object keyed by endpoint (twelve entries)."""
    entry = F.struct(*[c for c in profiles.columns if c != "endpoint"])
    body = profiles.agg(
        F.lit(MAX_HEAVY_ATOMS).alias("max_heavy_atoms"),
        F.sum("n_rows").alias("total_rows"),
        F.map_from_entries(F.collect_list(F.struct("endpoint", entry))).alias("endpoints"),
    )
    body.coalesce(1).write.mode("overwrite").json(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """(endpoint, n_rows, duplicate_smiles) of a profile file, whatever its counts are called."""
    text = spark.read.text(path, wholetext=True)
    entries = F.coalesce(
        F.from_json("value", "endpoints map<string,map<string,string>>")["endpoints"],
        F.from_json("value", "map<string,map<string,string>>"),
    )
    rows = text.select(F.explode(entries).alias("endpoint", "entry"))

    def first(*aliases: str):
        return F.coalesce(*[F.try_element_at("entry", F.lit(a)) for a in aliases]).try_cast("bigint")

    return rows.select(
        "endpoint",
        first("rows", "n_rows").alias("n_rows"),
        first("dup", "duplicates", "duplicate_smiles").alias("duplicate_smiles"),
    )


def _floats(column: pa.Array) -> pa.Array:
    blobs = [b.as_py() for b in column]
    out = []
    for b in blobs:
        if b is not None and len(b) % 4:
            raise ValueError(f"{len(b)} bytes are no whole number of 32-bit floats")
        out.append(None if b is None else np.frombuffer(b, "<f4"))
    return pa.array(out, pa.list_(pa.float32()))


def read_f32(spark: SparkSession, path: str) -> DataFrame:
    """(path, values): raw little-endian 32-bit floats, one row per file."""
    blobs = spark.read.format("binaryFile").load(path)
    return blobs.select("path", F.arrow_udf(_floats, "array<float>")(F.col("content")).alias("values"))


def write_f32(values, path: str) -> None:
    """Write one small tensor as raw little-endian floats (a local fixture file)."""
    np.asarray(values, "<f4").tofile(path)


def within_batch_limit(rows: DataFrame, limit: int) -> bool:
    """Whether an upload has at most the caller's ``limit`` rows; reads no more than one row past it."""
    return rows.select(F.lit(1)).limit(limit + 1).count() <= limit


def accepted_and_rejected(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error code; rejected rows keep their reason."""
    bad = F.col("error_code").isNotNull()
    return rows.where(~bad), rows.where(bad)


CAVEAT = "Outputs of an untrained model; not predictions."


def export(results: DataFrame, path: str, model_version: str) -> None:
    """Ranked results as CSV, with the model version and the caveat on every row.

    Arrays, structs and maps, the endpoint values among them, become JSON text.
    """
    nested = {c for c, t in results.dtypes if t.startswith(("array", "struct", "map"))}
    flat = [F.to_json(c).alias(c) if c in nested else F.col(c) for c in results.columns]
    stamped = results.select(*flat, F.lit(model_version).alias("model_version"), F.lit(CAVEAT).alias("caveat"))
    write_csv(stamped, path)


def over_cap_table(profiles: DataFrame) -> DataFrame:
    """Report rows: rows and over-cap molecules per endpoint with display percentages."""
    return profiles.select(
        "endpoint", "n_rows", "over_cap", F.format_string("%.3f%%", F.col("over_cap_pct")).alias("share")
    ).orderBy("endpoint")
