"""Queries over the whole screening path."""

from __future__ import annotations

from pyspark.sql import functions as F

from molscreen.operators import molgraph as G
from molscreen.operators import smiles as S
from molscreen.plans import screen as W
from molscreen.plans.tables import block_molecules, block_sql
from molscreen.session import materialise

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def _screened(spark, sf_dir):
    rows = block_molecules(spark, sf_dir).withColumnRenamed("p_partkey", "row_index")
    # known chemistry: the structures written in few characters, so that others lie near it or outside
    known = rows.where(F.length("smiles") <= 8).select(F.md5("smiles").alias("ref_id"), "smiles").distinct()
    refs = G.perceive(S.parse(known, "ref_id", "smiles", distinct_texts=True))
    refs = materialise(refs.where(F.col("words").isNotNull()).select("ref_id", "words"), "references")
    return W.screen(rows, refs)


@query(
    f"""
    WITH {block_sql()}
    SELECT p_partkey AS row_index, error_code, error_code IS NULL AS has_key, error_code IS NULL AS has_values,
      CAST(CASE WHEN error_code IS NULL THEN polar END AS BIGINT) AS hba FROM parts
    """
)
def screen_rows(spark, sf_dir):
    """Every input row comes back once, scored or with its error."""
    s = _screened(spark, sf_dir)
    return s.select(
        "row_index", "error_code", F.col("mol_key").isNotNull().alias("has_key"),
        (F.coalesce(F.size("values"), F.lit(0)) == 12).alias("has_values"), F.col("hba").cast("bigint").alias("hba"),
    )


@query()
def screen_ranking(spark, sf_dir):
    """The twenty best candidates (outputs of an untrained network: a plumbing check)."""
    return W.ranking(_screened(spark, sf_dir), 20).select(
        "rank", "row_index", "canonical_smiles", "mol_key", "similarity", "status", "triage_score"
    )
