"""Queries over calibration, exact rounding, named alerts, migrations and imports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from molscreen.functions.rounding import round_exact
from molscreen.operators import calibrate as C
from molscreen.operators import molgraph as G
from molscreen.operators import smiles as S
from molscreen.operators import split as P
from molscreen.operators import substructure as U
from molscreen.plans import screen as W
from molscreen.plans.tables import block_molecules, block_sql, read
from molscreen.session import materialise, shared_dir
from molscreen.sources import database as D
from molscreen.streaming import batches as T

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/molscreen-{name}-{uuid.uuid4().hex}"


@query(
    """
    SELECT o_orderkey, CAST(printf('%.2f', o_orderkey / 200.0::DOUBLE) AS DOUBLE) AS hundredths, CAST(printf('%.2f', (o_orderkey % 1000) / 8.0::DOUBLE) AS DOUBLE) AS eighths,
      CAST(printf('%.3f', o_totalprice / 7.0::DOUBLE) AS DOUBLE) AS sevenths, CAST(printf('%.4f', -o_custkey / 3000.0::DOUBLE) AS DOUBLE) AS negative,
      CAST(printf('%.0f', o_orderkey / 2.0::DOUBLE) AS DOUBLE) AS halves FROM orders
    """
)
def report_rounding(spark, sf_dir):
    """Rounding by the exact binary value, halves to even: 2.675 gives 2.67 and 0.125 gives 0.12."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", round_exact(k / 200.0, 2).alias("hundredths"), round_exact((k % 1000) / 8.0, 2).alias("eighths"),
        round_exact(F.col("o_totalprice").cast("double") / 7.0, 3).alias("sevenths"), round_exact(-F.col("o_custkey") / 3000.0, 4).alias("negative"),
        round_exact(k / 2.0, 0).alias("halves"),
    )


_SCORED_SQL = """
    WITH d AS (SELECT CAST(least(n_chars, 3000) // 10 AS DOUBLE) / 100.0 AS s, quality AS y FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL)"""


def _scored(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.select((F.floor(F.least("n_chars", F.lit(3000)) / 10).cast("double") / 100.0).alias("s"), F.col("quality").alias("y"))


@query(
    _SCORED_SQL
    + """,
    g AS (SELECT s, sum(y) AS y, count(*) AS n FROM d GROUP BY s),
    c AS (SELECT s, row_number() OVER w AS i, sum(y) OVER w AS cy, sum(n) OVER w AS cn, sum(y) OVER w - y AS py, sum(n) OVER w - n AS pn FROM g WINDOW w AS (ORDER BY s)),
    pairs AS (SELECT a.i AS a, b.i AS b, (b.cy - a.py)::DOUBLE / (b.cn - a.pn) AS mean FROM c a JOIN c b ON b.i >= a.i),
    least_mean AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM pairs)
    SELECT c.s AS score, round(max(m), 9) AS value FROM least_mean JOIN c USING (i) GROUP BY c.s"""
)
def calibration_isotonic(spark, sf_dir):
    """Isotonic probability of every score; the SQL takes the largest of the least means."""
    return C.fitted(_scored(spark, sf_dir), "s", "y").select("score", F.round("value", 9).alias("value"))


@query(
    _SCORED_SQL.replace("WITH d", "WITH RECURSIVE d")
    + """,
    n AS (SELECT count(*) FILTER (WHERE y > 0) AS yes, count(*) FILTER (WHERE y <= 0) AS no FROM d),
    t AS (SELECT s, CASE WHEN y > 0 THEN (yes + 1.0::DOUBLE) / (yes + 2.0::DOUBLE) ELSE 1.0::DOUBLE / (no + 2.0::DOUBLE) END AS t FROM d, n),
    it(k, a, b) AS (
      SELECT 0, 0.0::DOUBLE, ln((no + 1.0::DOUBLE) / (yes + 1.0::DOUBLE)) FROM n
      UNION ALL
      SELECT k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
        SELECT k, a, b, sum((t - p) * s) AS ga, sum(t - p) AS gb, sum(p * (1 - p) * s * s) AS haa, sum(p * (1 - p) * s) AS hab, sum(p * (1 - p)) AS hbb
        FROM (SELECT it.k, it.a, it.b, t.s, t.t, 1 / (1 + exp(it.a * t.s + it.b)) AS p FROM it, t WHERE it.k < 30) GROUP BY k, a, b))
    SELECT round(a, 6) AS a, round(b, 6) AS b FROM it WHERE k = 30"""
)
def calibration_platt(spark, sf_dir):
    """Coefficients of the sigmoid that turns a score into a probability."""
    a, b = C.platt(_scored(spark, sf_dir), "s", "y")
    return spark.createDataFrame([(a, b)], "a double, b double").select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


ALERTS = [("acid_or_ester", "C(=O)O"), ("nitrile", "C#N"), ("trifluoromethyl", "FC(F)F"), ("cyclopropane", "C1CC1"), ("pyridine", "c1ccncc1"), ("anilide", "c1ccccc1NC=O")]


@query(
    f"""
    WITH {block_sql()}
    SELECT p_partkey, 'acid_or_ester' AS alert FROM parts WHERE error_code IS NULL AND (pre_i IN (6, 9) OR suf_i = 5)
    UNION ALL SELECT p_partkey, 'nitrile' FROM parts WHERE error_code IS NULL AND suf_i = 6
    UNION ALL SELECT p_partkey, 'trifluoromethyl' FROM parts WHERE error_code IS NULL AND pre_i = 7
    UNION ALL SELECT p_partkey, 'cyclopropane' FROM parts WHERE error_code IS NULL AND (core_i = 5 OR suf_i = 7)
    UNION ALL SELECT p_partkey, 'pyridine' FROM parts WHERE error_code IS NULL AND core_i = 2
    """
)
def named_alerts(spark, sf_dir):
    """Which of the caller's patterns every molecule holds; one of them is nowhere."""
    rows = block_molecules(spark, sf_dir)
    # every text once
    texts = rows.select(F.md5("smiles").alias("digest"), "smiles").distinct()
    bonds = U.bond_table(G.perceive(S.parse(texts, "digest", "smiles", distinct_texts=True)), "digest")
    patterns = spark.createDataFrame(ALERTS, "alert string, smiles string")
    found = U.matches(bonds, U.bond_table(G.perceive(S.parse(patterns, "alert", "smiles")), "alert"))
    return rows.join(found, F.md5("smiles") == F.col("mol")).select("p_partkey", F.col("pattern").alias("alert"))


@query(
    """
    WITH RECURSIVE sizes AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY o_custkey),
    classes AS (SELECT n, count(*) AS c, row_number() OVER (ORDER BY n DESC) AS i FROM sizes GROUP BY n),
    total AS (SELECT CAST(floor(0.8 * sum(n)) AS BIGINT) AS t, CAST(floor(0.1 * sum(n)) AS BIGINT) AS v FROM sizes),
    fill(i, n, to_train, to_val, t, v) AS (
      SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), t, v FROM total
      UNION ALL
      SELECT q.i, q.n, q.a, q.b, q.t - q.a * q.n, q.v - q.b * q.n FROM (
        SELECT k.i, k.n, least(k.c, f.t // k.n) AS a, least(k.c - least(k.c, f.t // k.n), f.v // k.n) AS b, f.t, f.v
        FROM fill f JOIN classes k ON k.i = f.i + 1) q),
    ranked AS (SELECT o_custkey, n, row_number() OVER (PARTITION BY n ORDER BY first) AS r FROM sizes)
    SELECT r.o_custkey, r.n, CASE WHEN r.r <= f.to_train THEN 'train' WHEN r.r <= f.to_train + f.to_val THEN 'val' ELSE 'test' END AS split
    FROM ranked r JOIN fill f ON f.n = r.n
    """
)
def group_split_first_seen(spark, sf_dir):
    """Groups of one size taken in the order in which they first appear."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return P.assign_groups(orders, "o_custkey", row_index="o_orderkey")


@query(
    """
    SELECT CAST(n_nationkey + 1 AS INTEGER) AS number, CASE WHEN n_nationkey % 7 = 3 THEN 'changed after it was applied' WHEN n_nationkey % 11 = 5 THEN 'skipped' ELSE 'applied more than once' END AS fault
    FROM nation WHERE n_nationkey % 7 = 3 OR (n_nationkey % 11 = 5 OR n_nationkey % 13 = 2) AND n_nationkey < (SELECT max(n_nationkey) FROM nation)
    UNION ALL SELECT CAST(max(n_nationkey) + 2 AS INTEGER), 'unknown step' FROM nation
    """
)
def migration_ledger(spark, sf_dir):
    """A ledger held against its steps, one per nation: changed, skipped, repeated and unknown ones are named."""
    nation = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    steps = [(r["n_nationkey"] + 1, f"CREATE TABLE {r['n_name']}") for r in nation.orderBy("n_nationkey").collect()]  # a list of steps
    text = F.concat(F.lit("CREATE TABLE "), "n_name", F.when(k % 7 == 3, " ").otherwise(""))
    times = F.when((k % 11 == 5) & (k % 7 != 3), 0).when((k % 13 == 2) & (k % 7 != 3), 2).otherwise(1)
    last = nation.agg(F.max("n_nationkey").alias("last"))
    noted = nation.crossJoin(last).select((k + 1).cast("int").alias("number"), F.sha2(text, 256).alias("checksum"), F.explode(F.array_repeat(F.lit(0), F.when(k == F.col("last"), 1).otherwise(times))))
    odd = last.select((F.col("last") + 2).cast("int").alias("number"), F.lit("").alias("checksum"))
    return D.migration_faults(noted.select("number", "checksum").unionByName(odd), steps)


@query(
    f"""
    WITH {block_sql()}
    SELECT count(*) FILTER (WHERE error_code IS NULL) AS completed, count(*) FILTER (WHERE error_code IS NOT NULL) AS failed, count(*) AS last_done,
      count(*) FILTER (WHERE error_code IS NOT NULL) AS last_failed, true AS rising, count(*) AS written FROM parts
    """
)
def import_progress(spark, sf_dir):
    """A library imported in one write: its counts, what progress reported last, and what was written."""
    rows = block_molecules(spark, sf_dir)
    source, out = _scratch(spark, "library"), _scratch(spark, "import")
    rows.write.csv(source, header=True)
    known = materialise(rows.where(F.length("smiles") <= 8).select(F.md5("smiles").alias("ref_id"), "smiles").distinct(), "known")
    refs = materialise(G.perceive(S.parse(known, "ref_id", "smiles", distinct_texts=True)).where("words is not null").select("ref_id", "words"), "references")
    told: list[tuple[int, int]] = []
    counts = W.import_library(spark, source, out, refs, progress_every=100, on_progress=lambda done, failed: told.append((done, failed)))
    rising = told == sorted(told) and all(f <= d for d, f in told)
    written = spark.read.csv(f"{out}/part=*", header=True, multiLine=True, escape='"').count()
    return counts.select("completed", "failed", *[F.lit(v).cast("bigint").alias(n) for n, v in (("last_done", told[-1][0]), ("last_failed", told[-1][1]))], F.lit(rising).alias("rising"), F.lit(written).cast("bigint").alias("written"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_within(spark, sf_dir):
    """Repeats dropped by a stateful stream whose delay covers the whole table."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    folder, out = _scratch(spark, "within-in"), _scratch(spark, "within-out")
    rows.repartition(4).write.parquet(folder)
    kept = T.dedup_within(T.file_stream(spark, folder, rows.schema, 2), ["user_id", "event_type"], "ts", "36500 days")
    writer = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", _scratch(spark, "within-state")).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select("user_id", "event_type")
