"""Ranking, cleaning, splitting, store operators and metrics on small tables."""

import datetime as dt
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from molscreen.operators import clean as C
from molscreen.operators import metrics as M
from molscreen.operators import rank as R
from molscreen.operators import split as P
from molscreen.operators import store as S
from molscreen.operators.running import exact_percentiles, row_position, running_sum

NAN = float("nan")


def test_top_k_sinks_nan_and_breaks_ties_on_key(spark):
    rows = [("A", 0.5, 0), ("B", 0.5, 1), ("C", NAN, 2), ("D", 0.9, 3), ("E", None, 4), ("B", 0.5, 5)]
    df = spark.createDataFrame(rows, "inchikey string, score double, row_index long")
    got = [(r.inchikey, r.row_index) for r in R.top_k(df, 10, row_index="row_index").collect()]
    assert got == [("D", 3), ("B", 1), ("B", 5), ("A", 0), ("C", 2), ("E", 4)]
    assert R.top_k(df, 0).count() == 0


def test_pages_cover_everything_once(spark):
    rows = [(f"K{i:02d}", s) for i, s in enumerate([0.5, 0.5, NAN, 0.9, None, 0.1, NAN, None, 0.5])]
    df = spark.createDataFrame(rows, "inchikey string, score double")
    seen, after = [], None
    while True:
        page = R.next_page(df, 2, after).collect()
        if not page:
            break
        seen += [r.inchikey for r in page]
        after = (page[-1].score, page[-1].inchikey)
    assert seen == [r.inchikey for r in R.top_k(df, 100).collect()]


def test_running_sum_with_one_hot_group_and_null_group(spark):
    rng = random.Random(1)
    rows = [("hot", i) for i in range(600)] + [(None, i) for i in range(50)] + [("b", i) for i in range(20)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(g, v, 1) for g, v in rows], "g string, v long, one long")
    out = running_sum(df, "v", {"one": "n"}, by=["g"]).collect()
    assert len(out) == 670
    assert all(r.n == r.v + 1 for r in out)
    assert {r.g: r.n_total for r in out} == {"hot": 600, None: 50, "b": 20}
    pos = row_position(df.where("g = 'hot'").select("v"), "v").collect()
    assert all(r.row_index == r.v for r in pos)


@pytest.mark.parametrize("n", [1, 2, 7, 501])
def test_percentiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.exponential(10, n), 1)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    r = exact_percentiles(df, "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
    want = np.percentile(values, [50, 95, 99])
    assert np.allclose([r.p50, r.p95, r.p99], want) and r.n == n


def test_dedup_rules(spark):
    rows = [(0, "k", "s0", 1.0), (1, "k", None, 0.0), (2, "k", "s2", 0.0), (3, "k", "s3", 1.0), (4, "m", "t", None), (5, None, "u", 1.0)]
    df = spark.createDataFrame(rows, "row_index long, key string, s string, y double")
    vote = {r.key: r for r in C.dedup_majority(df, "key", ["y"], ["s"], "row_index").collect()}
    assert vote["k"].y == 0.0 and vote["k"].s == "s0" and vote["k"].n_rows == 4  # tie goes to the lowest
    assert vote["m"].y is None and len(vote) == 2
    avg = {r.key: r for r in C.dedup_mean(df, "key", ["y"], ["s"], "row_index").collect()}
    assert avg["k"].y == 0.5 and avg["m"].y is None


def test_one_missing_key_switches_the_whole_dataset(spark):
    rows = [(0, "K1", "CCO", 3, 1.0), (1, "K1", "OCC", 3, 0.0), (2, None, "CC", 2, 1.0), (3, "K3", "big", 129, 1.0), (4, "K4", None, 0, 1.0)]
    schema = "row_index long, mol_key string, canonical_smiles string, heavy_atoms int, y double"
    df = spark.createDataFrame(rows, schema)
    assert {r.key for r in C.clean_dataset(df, ["y"], "binary").collect()} == {"CCO", "OCC", "CC"}
    full = df.where("row_index <> 2")
    assert {r.key for r in C.clean_dataset(full, ["y"], "binary").collect()} == {"K1"}
    r = C.intake_report(df).first()
    assert (r.n_input, r.n_parsed, r.n_invalid, r.n_oversized, r.oversized_pct) == (5, 4, 1, 1, 25.0)


def test_conflicts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", 5.0), (None, 1.0), (None, 2.0)], "k string, y double")
    for task in ("regression", "binary"):
        assert sorted(tuple(r) for r in C.label_conflicts(df, "k", "y", task).collect()) == [("b", 1.0), ("b", 2.0)]


def test_profile_numbers(spark):
    values = [1.0, 2.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([("a", str(v)) for v in values] + [("a", "n/a"), ("b", "1")], "g string, y string")
    r = {x.g: x for x in C.regression_profile(df, ["g"], "y").collect()}["a"]
    s = pd.Series(values)
    assert np.allclose([r.target_mean, r.target_std, r.target_skew], [s.mean(), s.std(), s.skew()]) and r.long_tailed
    dup = spark.createDataFrame([(None,), (None,), ("x",), ("x",), ("y",)], "t string")
    assert dup.agg(C.duplicate_count("t")).first()[0] == 2
    ones = spark.createDataFrame([("a", 1)] * 4, "g string, y int")
    b = C.binary_profile(ones, ["g"], "y").first()
    assert b.imbalanced and b.pos_weight is None


def test_drift_order_is_unique_first(spark):
    doc = spark.createDataFrame([("a", 8), ("b", 10), ("c", 7), ("d", 1)], "endpoint string, expected_n long")
    prof = spark.createDataFrame([("a", 10, 2), ("b", 10, 2), ("c", 10, 2)], "endpoint string, n_rows long, duplicate_smiles long")
    got = {r.endpoint: (r.verdict, r.off_by) for r in C.drift_verdict(doc, prof).collect()}
    assert got == {"a": ("duplicates", 0), "b": ("equal", -2), "c": ("unexplained", 1), "d": ("unprofiled", None)}


def greedy(sizes, fractions):
    total = sum(sizes)
    t, v = int(fractions[0] * total), int(fractions[1] * total)
    out, a, b = [], 0, 0
    for s in sorted(sizes, reverse=True):
        if a + s <= t:
            a += s
            out.append((s, "train"))
        elif b + s <= v:
            b += s
            out.append((s, "val"))
        else:
            out.append((s, "test"))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_group_split_equals_greedy_first_fit(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 1, 1, 2, 3, 5, 40]) for _ in range(60)] + [150]
    rows = [(g, i) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long")
    fractions = (0.6, 0.2, 0.2)
    assigned = P.assign_groups(df, "g", fractions, seed)
    assert sorted((r.n, r.split) for r in assigned.collect()) == greedy(sizes, fractions)
    again = {r.g: r.split for r in P.assign_groups(df, "g", fractions, seed).collect()}
    assert again == {r.g: r.split for r in assigned.collect()}
    out = P.group_split(df, "g", fractions, seed)
    assert out.count() == len(rows) and out.groupBy("g").agg(F.count_distinct("split").alias("c")).where("c > 1").count() == 0


def test_split_fractions_must_sum_to_one(spark):
    with pytest.raises(AssertionError):
        P.group_split(spark.range(3), "id", (0.8, 0.8, 0.8))


def test_store(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "inchikey string, v long")
    new = spark.createDataFrame([("b", 9, 0), ("c", 8, 2), ("c", 7, 1), ("d", 6, 3)], "inchikey string, v long, row_index long")
    assert sorted(tuple(r) for r in S.upsert(old, new, "inchikey", "row_index").collect()) == [("a", 1), ("b", 2), ("c", 7), ("d", 6)]
    assert S.insert_count(old, new, "inchikey").first()[0] == 2
    assert S.find(old, "inchikey", "zz").count() == 0
    with pytest.raises(LookupError):
        S.get(old, "inchikey", "zz")
    v = spark.createDataFrame([("1", True), ("2", True)], "version string, is_active boolean")
    with pytest.raises(LookupError):
        S.active_version(v)
    log = spark.createDataFrame([("x", "queued", 1), ("x", "failed", 2), ("x", "running", 3), ("y", "running", 1), ("y", "bogus", 2)], "batch_id string, status string, updated_at long")
    assert {r.batch_id: r.status for r in S.latest_status(log).collect()} == {"x": "failed", "y": "running"}
    now = dt.datetime(2024, 1, 1, 12)
    b = spark.createDataFrame([("r", "running", dt.datetime(2024, 1, 1, 10)), ("s", "running", dt.datetime(2024, 1, 1, 11, 59)), ("t", "queued", dt.datetime(2023, 1, 1))], "batch_id string, status string, created_at timestamp")
    assert [r.batch_id for r in S.orphaned(b, now, 30).collect()] == ["r"]


def test_metrics_against_pandas(spark):
    rng = np.random.default_rng(3)
    n = 400
    y, s, t = rng.integers(0, 2, n), np.round(rng.normal(size=n), 1), np.round(rng.normal(size=n), 1)
    df = spark.createDataFrame([("e", int(a), float(b), float(c)) for a, b, c in zip(y, s, t)], "g string, y int, s double, t double")
    ranks = pd.Series(s).rank()
    p = y.sum()
    want = (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * (n - p))
    assert np.isclose(M.auroc(df, ["g"], "y", "s").first().auroc, want)
    assert np.isclose(M.spearman(df, ["g"], "s", "t").first().spearman, pd.Series(s).rank().corr(pd.Series(t).rank()))
    order = np.argsort(-s, kind="stable")
    got = M.auprc(df, ["g"], "y", "s").first().auprc
    cum, total = 0.0, 0.0
    for v in sorted(set(s), reverse=True):
        at = s >= v
        gain = y[at].sum() / p - cum
        total, cum = total + gain * y[at].mean(), y[at].sum() / p
    assert np.isclose(got, total) and len(order) == n
    seeds = spark.createDataFrame([("e", v) for v in (0.1, 0.2, 0.4)], "g string, m double")
    r = M.seed_summary(seeds, ["g"], "m").first()
    assert np.isclose(r.sd, statistics.stdev([0.1, 0.2, 0.4])) and r.n_seeds == 3


def test_ranges_are_cut_again_where_they_hold_many_rows(spark):
    from molscreen.operators.running import with_ranges

    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("v")).unionByName(spark.range(1).select(F.lit(None).cast("bigint").alias("v")))
    rows = with_ranges(df, "v", ranges=16, range_rows=20).collect()
    ordered = [r["_range"] for r in sorted(rows, key=lambda r: (r["v"] is not None, r["v"]))]
    assert len(rows) == 5001 and ordered == sorted(ordered)
    assert len(set(ordered)) > 150


def test_nan_is_no_label(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", nan), (2, "b", nan), (3, "c", 1.0), (4, "c", 2.0)], "row_index long, k string, y double")
    for task in ("regression", "binary"):
        found = C.in_key_order(C.label_conflicts(df, "k", "y", task), "k", "y").collect()
        assert [tuple(r) for r in found] == [("c", 1.0), ("c", 2.0)]
    assert {r.k: r.y for r in C.dedup_mean(df, "k", ["y"], [], "row_index").collect()} == {"a": 1.0, "b": None, "c": 1.5}


def test_pair_counts_beyond_64_bits(spark):
    from molscreen.operators import metrics as M

    counts = spark.createDataFrame([("e", 0.2, 0, 3 * 10**9), ("e", 0.7, 3 * 10**9, 0)], "e string, s double, _pos bigint, _neg bigint")
    original = M._score_counts
    M._score_counts = lambda *args: counts
    try:
        assert M.auroc(counts, ["e"], "y", "s").first()["auroc"] == 1.0
    finally:
        M._score_counts = original


def test_export_ranking_reaches_every_row(spark, monkeypatch):
    from molscreen.plans import queries_sources as Q

    orders = spark.createDataFrame([(i, float((i * 37) % 600)) for i in range(1200)], "o_orderkey bigint, o_totalprice double")
    got = Q.exported_ranking(spark, orders).collect()
    want = sorted(((i, float((i * 37) % 600)) for i in range(1200)), key=lambda r: (-r[1], r[0]))
    assert sorted(tuple(r) for r in got) == [(n + 1, i, p, round(p / 2, 4), "v1", True) for n, (i, p) in enumerate(want)]
    # the query writes them all and returns them all
    written = []
    export = Q.IO.export
    monkeypatch.setattr(Q.IO, "export", lambda df, path, version: (written.append(df.count()), export(df, path, version)))
    monkeypatch.setattr(Q, "read", lambda *_: orders)
    assert Q.export_ranking(spark, "").count() == 1200 and written == [1200]


def test_steps_without_an_event_are_reported(spark):
    from molscreen.streaming.batches import rows_per_trigger_ok

    found = lambda rows: sorted(map(tuple, rows_per_trigger_ok(spark.createDataFrame(rows, "batch int, step bigint, rows_done bigint"), 250).collect()))
    # without an order a micro-batch is one step
    assert found([(0, 0, 10_000), (1, 0, 10_250), (2, 0, 10_600)]) == [(0, 0, 10_000), (2, 0, 350)]
    # first steps, and one inside
    assert found([(0, 0, 251), (0, 1, 501), (1, 0, 752), (1, 1, 1002), (1, 2, 1300)]) == [(0, 0, 251), (1, 0, 251), (1, 2, 298)]


def test_a_long_micro_batch_without_an_order_is_reported(spark, tmp_path):
    from molscreen.streaming import batches as T

    rows = spark.range(600).selectExpr("id", "id % 7 = 0 AS bad").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    T.progress_stream(T.file_stream(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "run"), "bad").awaitTermination()
    assert [tuple(r) for r in T.rows_per_trigger_ok(T.progress(spark, str(tmp_path / "run"))).collect()] == [(0, 0, 600)]
