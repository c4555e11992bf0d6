"""Queries over scores: desirability, composite ranking, paging, percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from molscreen.functions import desirability as D
from molscreen.operators import rank as R
from molscreen.operators import store as S
from molscreen.plans.tables import big, endpoint_values, r6, read
from molscreen.schemas import CATEGORY_WEIGHTS, CURVES, ENDPOINTS, endpoint_registry

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


@query(
    """
    SELECT p_partkey,
      round(CASE WHEN p_partkey % 89 = 0 THEN 0.0
                 ELSE least(1.0, greatest(0.0, (p_retailprice - 950.0) / 750.0)) END, 6) AS d_higher,
      round(CASE WHEN p_partkey % 89 = 0 THEN 1.0
                 ELSE 1.0 - least(1.0, greatest(0.0, (p_retailprice - 950.0) / 750.0)) END, 6) AS d_lower
    FROM part
    """
)
def desirability_ramp(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    price = F.when(F.col("p_partkey") % 89 == 0, float("nan")).otherwise(F.col("p_retailprice"))
    return part.select(
        "p_partkey",
        r6(D.higher_better(price, 950.0, 1700.0)).alias("d_higher"),
        r6(D.lower_better(price, 950.0, 1700.0)).alias("d_lower"),
    )


@query(
    """
    SELECT p_partkey,
      round(CASE WHEN p_size < 10 OR p_size > 40 THEN 0.0
                 ELSE 1.0 - abs(p_size - 25.0) / 15.0 END, 6) AS d_window
    FROM part
    """
)
def desirability_window(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", r6(D.window(F.col("p_size").cast("double"), 10.0, 40.0)).alias("d_window"))


@query(
    """
    WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_acctbal / 8000.0 END AS p FROM customer)
    SELECT c_custkey,
      round(CASE WHEN p IS NULL THEN 0.0 ELSE least(1.0, greatest(0.0, p)) END, 9) AS d_wanted,
      round(CASE WHEN p IS NULL THEN 0.0 ELSE 1.0 - least(1.0, greatest(0.0, p)) END, 9) AS d_unwanted
    FROM v
    """
)
def desirability_binary(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    p = F.when(F.col("c_custkey") % 97 == 0, float("inf")).otherwise(F.col("c_acctbal") / 8000.0)
    return c.select(
        "c_custkey",
        F.round(D.binary(p, True), 9).alias("d_wanted"),
        F.round(D.binary(p, False), 9).alias("d_unwanted"),
    )


@query(
    """
    WITH a AS (
      SELECT l_partkey, count(*) AS n, sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc,
             sum(CAST(round(l_quantity) AS BIGINT)) AS qty, count(*) FILTER (WHERE l_returnflag = 'R') AS ret
      FROM lineitem GROUP BY l_partkey),
    d AS (
      SELECT p.p_partkey,
        least(1.0, greatest(0.0, (p.p_retailprice - 850.0) / 1000.0)) AS d1,
        1.0 - least(1.0, greatest(0.0, disc / (n * 10.0))) AS d2,
        CASE WHEN qty / n::DOUBLE < 5 OR qty / n::DOUBLE > 45 THEN 0.0 ELSE 1.0 - abs(qty / n::DOUBLE - 25.0) / 20.0 END AS d3,
        1.0 - ret / n::DOUBLE AS d4
      FROM a JOIN part p ON p.p_partkey = a.l_partkey),
    s AS (
      SELECT lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS candidate,
        round(CASE WHEN d1 <= 0 OR d2 <= 0 OR d3 <= 0 OR d4 <= 0 THEN 0.0
          ELSE exp((1.0 * ln(greatest(d1, 1e-6)) + 1.0 * ln(greatest(d2, 1e-6)) + 0.8 * ln(greatest(d3, 1e-6))
                    + 2.0 * ln(greatest(d4, 1e-6))) / 4.8) END, 9) AS score
      FROM d)
    SELECT candidate, score, row_number() OVER (ORDER BY score DESC, candidate DESC) AS rank
    FROM s ORDER BY score DESC, candidate DESC LIMIT 10
    """
)
def triage_topk(spark, sf_dir):
    """Ten best parts by weighted geometric mean; one fatal term disqualifies."""
    line = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("disc"),
        F.sum(F.round("l_quantity").cast("bigint")).alias("qty"),
        F.count_if(F.col("l_returnflag") == "R").alias("ret"),
    )
    part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    j = part.join(line, F.col("p_partkey") == F.col("l_partkey"))
    n = F.col("n").cast("double")
    terms = [
        (D.higher_better(F.col("p_retailprice"), 850.0, 1850.0), F.lit(1.0)),
        (D.binary(F.col("disc") / (n * 10.0), False), F.lit(1.0)),
        (D.window(F.col("qty") / n, 5.0, 45.0), F.lit(0.8)),
        (D.binary(F.col("ret") / n, False), F.lit(2.0)),
    ]
    scored = j.select(
        F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("candidate"),
        F.round(D.geometric_mean(terms), 9).alias("score"),
    )
    return R.with_rank(R.top_k(scored, 10, key="candidate"), R.score_order(key="candidate"))


def _values_sql() -> str:
    """The tall endpoint values in SQL: same integer rule as ``endpoint_values``."""
    rows = []
    for i, (code, _, cat, _, _) in enumerate(ENDPOINTS):
        shape, lo, hi = CURVES[code]
        low, high = (0.0, 1.0) if lo is None else (lo, hi)
        rows.append(f"('{code}', {i}, '{shape}', {low}::DOUBLE, {high}::DOUBLE, {CATEGORY_WEIGHTS[cat]}::DOUBLE)")
    return f"""
      reg(endpoint, output_index, shape, low, high, weight) AS (VALUES {", ".join(rows)}),
      vals AS (
        SELECT o_orderkey AS prediction_id, endpoint, output_index, shape, low, high, weight,
          low + ((o_orderkey * (7 + 2 * output_index) + 13 * output_index) % 1000 / 999.0::DOUBLE * 1.5 - 0.25) * (high - low) AS value
        FROM orders CROSS JOIN reg)"""


_SCORED_SQL = f"""
    WITH {_values_sql()},
    des AS (
      SELECT prediction_id, weight, CASE shape
        WHEN 'higher' THEN least(1.0, greatest(0.0, (value - low) / (high - low)))
        WHEN 'lower' THEN 1.0 - least(1.0, greatest(0.0, (value - low) / (high - low)))
        WHEN 'window' THEN CASE WHEN value < low OR value > high THEN 0.0
             ELSE 1.0 - abs(value - (low + high) / 2.0) / ((high - low) / 2.0) END
        WHEN 'positive' THEN least(1.0, greatest(0.0, value))
        ELSE 1.0 - least(1.0, greatest(0.0, value)) END AS d
      FROM vals),
    scores AS (
      SELECT prediction_id, CASE WHEN max(CASE WHEN d <= 0 THEN 1 ELSE 0 END) = 1 THEN 0.0
        ELSE exp(sum(weight * ln(greatest(d, 1e-6))) / sum(weight)) END AS score
      FROM des GROUP BY prediction_id)
"""


@query(_SCORED_SQL + "SELECT prediction_id, round(score, 6) AS triage_score FROM scores")
def triage_score_tall(spark, sf_dir):
    reg = endpoint_registry(spark)
    out = R.triage_tall(endpoint_values(spark, sf_dir, reg), reg, ["prediction_id"])
    return out.select("prediction_id", r6("triage_score").alias("triage_score"))


@query(_SCORED_SQL + "SELECT prediction_id, round(score, 6) AS triage_score FROM scores")
def triage_score_wide(spark, sf_dir):
    """Same scores from one wide row per molecule: no shuffle after the pivot."""
    reg = endpoint_registry(spark)
    codes = [e[0] for e in ENDPOINTS]
    wide = S.to_wide(endpoint_values(spark, sf_dir, reg), codes)
    curves = [(c, *CURVES[c], CATEGORY_WEIGHTS[cat]) for c, _, cat, _, _ in ENDPOINTS]
    score = R.triage_wide(F.array(*codes), curves)
    return wide.select("prediction_id", r6(score).alias("triage_score"))


@query(
    f"""
    WITH {_values_sql()}
    SELECT prediction_id,
      string_agg(endpoint || '=' || CAST(CAST(round(value * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY output_index) AS packed
    FROM vals GROUP BY prediction_id
    """
)
def prediction_values(spark, sf_dir):
    """Predictions with their values in output order."""
    reg = endpoint_registry(spark)
    vals = endpoint_values(spark, sf_dir, reg)
    preds = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prediction_id"))
    full = S.with_values(preds, vals.drop("output_index"), reg)
    item = F.transform(
        "values", lambda v: F.concat(v["endpoint"], F.lit("="), F.round(v["value"] * 1000).cast("bigint").cast("string"))
    )
    return full.select("prediction_id", F.array_join(item, ",").alias("packed"))


@query(f"WITH {_values_sql()} SELECT prediction_id, round(value, 6) AS value FROM vals WHERE endpoint = 'herg' AND value < 0.3")
def endpoint_filter(spark, sf_dir):
    vals = endpoint_values(spark, sf_dir, endpoint_registry(spark))
    return S.endpoint_filter(vals, "herg", 0.3).select("prediction_id", r6("value").alias("value"))


@query(
    """
    WITH s AS (SELECT event_id, lpad(CAST(user_id AS VARCHAR), 8, '0') AS k,
        CASE WHEN event_id % 50 = 7 THEN 'NaN'::DOUBLE ELSE value END AS score FROM events)
    SELECT event_id, k AS inchikey, score,
      row_number() OVER (ORDER BY isnan(score), score DESC, k DESC, event_id) AS rank
    FROM s ORDER BY isnan(score), score DESC, k DESC, event_id LIMIT 100
    """
)
def topk_nan_last(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    s = e.select(
        "event_id",
        F.lpad(F.col("user_id").cast("string"), 8, "0").alias("inchikey"),
        F.when(F.col("event_id") % 50 == 7, float("nan")).otherwise(F.col("value")).alias("score"),
    )
    return R.with_rank(R.top_k(s, 100, row_index="event_id"), R.score_order(row_index="event_id"))


@query(
    """
    WITH s AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS triage_score FROM orders)
    SELECT * FROM (SELECT o_custkey, o_orderkey, triage_score,
      row_number() OVER (PARTITION BY o_custkey ORDER BY triage_score DESC NULLS LAST, o_orderkey DESC) AS rank FROM s)
    WHERE rank <= 3
    """
)
def batch_rank_nulls_last(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("triage_score"),
    )
    return R.batch_ranking(o, "o_custkey", 3, key="o_orderkey")


@query(
    """
    WITH s AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS inchikey, floor(o_totalprice / 1000) AS score FROM orders)
    SELECT inchikey, score FROM s WHERE score < 300 OR (score = 300 AND inchikey < '000000005000')
    ORDER BY score DESC, inchikey DESC LIMIT 40
    """
)
def ranking_page(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("inchikey"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"),
    )
    return R.next_page(o, 40, (300.0, "000000005000"))


@query(
    """
    WITH v AS (SELECT value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 240 HOUR)
    SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
           round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM v
    """
)
def latency_percentiles(spark, sf_dir):
    out = S.latency_percentiles(read(spark, sf_dir, "events"), "value", "ts", 240)
    return out.select(r6("p50").alias("p50"), r6("p95").alias("p95"), r6("p99").alias("p99"), big("n").alias("n"))


@query(
    """
    SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
           round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, count(*) AS n
    FROM lineitem GROUP BY l_returnflag
    """
)
def grouped_percentiles(spark, sf_dir):
    """Exact percentiles of groups that each hold about a third of all rows."""
    from molscreen.operators.running import exact_percentiles

    out = exact_percentiles(
        read(spark, sf_dir, "lineitem"), "l_extendedprice", {"p50": 0.5, "p95": 0.95}, by=["l_returnflag"]
    )
    return out.select("l_returnflag", r6("p50").alias("p50"), r6("p95").alias("p95"), big("n").alias("n"))


@query(
    """
    SELECT p_partkey, round((SELECT count(*) FROM lineitem WHERE l_extendedprice / l_quantity < p_retailprice)
       / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS pct_below FROM part
    """
)
def compare_with_reference(spark, sf_dir):
    """Share of sold unit prices below each part's list price."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("v"))
    line = read(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    out = S.compare_with_reference(part, line, "v")
    return out.select("p_partkey", r6("pct_below").alias("pct_below"))
