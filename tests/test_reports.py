"""Exact rounding, calibration, alerts, migrations, imports and the keyed store."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from molscreen.functions.rounding import round_exact
from molscreen.operators import calibrate as C
from molscreen.operators import molgraph as G
from molscreen.operators import smiles as S
from molscreen.operators import split as P
from molscreen.operators import substructure as U
from molscreen.plans import screen as W
from molscreen.sources import database as D
from molscreen.streaming import batches as T


def test_rounding_equals_pythons(spark):
    rng = random.Random(1)
    values = [2.675, 0.125, 1.005, 2.5, 3.5, -2.675, -0.125, 0.0, 1e-9, 0.0005, 0.00049999, 1e15, 4503599627370497.0, 9.995, 1e300, 5e-324]
    values += [rng.uniform(-1000, 1000) for _ in range(500)] + [rng.randint(0, 10**6) / 2000 for _ in range(500)] + [rng.random() * 10 ** rng.randint(-6, 16) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for n in (0, 1, 2, 3, 6):
        assert [r.r for r in df.select(round_exact(F.col("v"), n).alias("r")).collect()] == [round(v, n) for v in values]
    odd = [r.r for r in spark.createDataFrame([(None,), (float("nan"),), (float("-inf"),)], "v double").select(round_exact(F.col("v"), 2).alias("r")).collect()]
    assert odd[0] is None and np.isnan(odd[1]) and odd[2] == float("-inf")
    with pytest.raises(ValueError):
        round_exact(F.col("v"), 7)


def pooled(points):
    out = []
    for s, y, n in points:
        block = [y, n, [s]]
        while out and out[-1][0] * block[1] >= block[0] * out[-1][1]:
            before = out.pop()
            block = [before[0] + block[0], before[1] + block[1], before[2] + block[2]]
        out.append(block)
    return {s: b[0] / b[1] for b in out for s in b[2]}


@pytest.mark.parametrize("shape", ["rising", "falling", "noise", "one"])
def test_isotonic_against_one_pass(spark, shape):
    rng = random.Random(shape)
    x = [rng.randint(0, 300) / 7 if shape != "one" else 2.0 for _ in range(1500)]
    chance = {"rising": lambda a: a / 43, "falling": lambda a: 1 - a / 43, "noise": lambda a: 0.4, "one": lambda a: 0.5}[shape]
    y = [int(rng.random() < chance(a)) for a in x]
    df = spark.createDataFrame([*zip(x, y), (None, 1), (1.0, None), (float("nan"), 0)], "s double, y int")
    got = {r.score: r.value for r in C.fitted(df, "s", "y").collect()}
    assert got == pooled([(s, sum(b for a, b in zip(x, y) if a == s), x.count(s)) for s in sorted(set(x))])
    assert C.isotonic(df.limit(0), "s", "y").count() == 0


def test_platt_has_no_slope_left(spark):
    rng = random.Random(4)
    rows = [(x := rng.uniform(-3, 3), int(rng.random() < 1 / (1 + np.exp(-2 * x + 1)))) for _ in range(2000)]
    a, b = C.platt(spark.createDataFrame(rows, "s double, y int"), "s", "y")
    s, y = np.array(rows).T
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    left = t - 1 / (1 + np.exp(a * s + b))
    assert abs(left.sum()) < 1e-6 and abs((left * s).sum()) < 1e-6 and abs(a + 2) < 0.3
    with pytest.raises(ValueError):
        C.platt(spark.createDataFrame([], "s double, y int"), "s", "y")


def test_alerts_name_every_match(spark):
    mols = ["CC(=O)O", "C#N", "FC(F)(F)c1ccccc1", "c1ccccc1C(=O)O", "C1CC1", "C1CCC1", "CC", "c1ccc2ccccc2c1", "[O-]C=O", "bad)", "OC(=O)CC#N"]
    patterns = [("acid", "C(=O)O"), ("nitrile", "C#N"), ("cf3", "FC(F)F"), ("three", "C1CC1"), ("four", "C1CCC1"), ("ethyl", "CC"), ("benzene", "c1ccccc1"), ("chain", "CCCC")]
    bonds = lambda rows, kind: U.bond_table(G.perceive(S.parse(spark.createDataFrame(rows, f"i {kind}, s string"), "i", "s")), "i")
    found = U.matches(bonds(list(enumerate(mols)), "int"), bonds(patterns, "string"))
    got = sorted((r.mol, r.pattern) for r in found.collect())
    want = {0: ["acid", "ethyl"], 1: ["nitrile"], 2: ["benzene", "cf3"], 3: ["acid", "benzene"], 4: ["ethyl", "three"], 5: ["chain", "ethyl", "four"], 6: ["ethyl"], 7: ["benzene"], 10: ["acid", "ethyl", "nitrile"]}
    assert got == sorted((i, p) for i, ps in want.items() for p in ps)
    with pytest.raises(ValueError):
        U.ordered_bonds([(0, 1, 1, "C", "C"), (2, 3, 1, "C", "C")], {})


def test_groups_of_one_size_in_order_of_appearance(spark):
    rows = [(i, g) for i, g in enumerate("bbaaccddeeffgghhiijj")] + [(20, None), (21, None)]
    df = spark.createDataFrame(rows, "i long, g string")
    got = {r.g: r.split for r in P.assign_groups(df, "g", (0.5, 0.25, 0.25), row_index="i").collect()}
    order = [*"bacdefghij", None]
    assert [got[g] for g in order] == ["train"] * 5 + ["val"] * 2 + ["test"] * 4


def test_migrations_only_go_forward(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    spark.sql("CREATE DATABASE IF NOT EXISTS moving")
    steps = [(1, "CREATE TABLE IF NOT EXISTS {database}.one (a INT) USING parquet"), (2, "CREATE TABLE IF NOT EXISTS {database}.two (a INT) USING parquet")]
    try:
        assert D.migrate(spark, ledger, steps[:1], database="moving") == [1]
        assert D.migrate(spark, ledger, steps, database="moving") == [2]
        assert D.migrate(spark, ledger, steps, database="moving") == []
        assert {r.tableName for r in spark.sql("SHOW TABLES IN moving").collect()} == {"one", "two"}
        with pytest.raises(RuntimeError, match="step 1: changed"):
            D.migrate(spark, ledger, [(1, "CREATE TABLE other"), steps[1], (3, "SELECT 1")])
        with pytest.raises(RuntimeError, match="step 0: skipped"):
            D.migrate(spark, ledger, [(0, "SELECT 1"), *steps])
        with pytest.raises(RuntimeError, match="step 2: unknown"):
            D.migrate(spark, ledger, steps[:1])
        with pytest.raises(ValueError):
            D.migrate(spark, ledger, steps[::-1])
    finally:
        spark.sql("DROP DATABASE moving CASCADE")


def test_import_reports_progress_and_reads_nothing_again(spark, tmp_path):
    texts = ["CCO", "CC)", "c1ccccc1O", None, '"quoted"'] * 9
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, smiles string")
    rows.write.csv(str(tmp_path / "lib"), header=True)
    refs = G.perceive(S.parse(spark.createDataFrame([(1, "CCO")], "ref_id long, s string"), "ref_id", "s")).select("ref_id", "words")
    told = []
    done = W.import_library(spark, str(tmp_path / "lib"), str(tmp_path / "out"), refs, progress_every=4, on_progress=lambda *x: told.append(x)).first()
    assert (done.completed, done.failed) == (18, 27) and told[-1] == (45, 27) and told == sorted(told)
    read = lambda part: spark.read.csv(str(tmp_path / "out" / f"part={part}"), header=True, multiLine=True, escape='"')
    assert read("scored").count() == 18 and read("rejected").where("error_code is not null").count() == 27
    whole = W.import_library(spark, str(tmp_path / "lib"), str(tmp_path / "all"), refs, skip_invalid=False).first()
    assert (whole.completed, whole.failed) == (45, 0)


def test_store_reads_few_folders_per_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "MERGED", 3)
    src, root = str(tmp_path / "in"), str(tmp_path / "run")
    rows = [(i, None if i % 50 == 0 else f"K{i % 37 + i // 40}", i * 1.5) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, key string, v double")
    for part in range(10):
        df.where(F.col("i") % 10 == part).coalesce(1).write.mode("append").parquet(src)
    T.dedup_stream(T.file_stream(spark, src, df.schema), root, ["key"], "i", buckets=4).awaitTermination()
    got = T.stored(spark, root)
    assert sorted(got.columns) == ["i", "key", "v"] and got.count() == got.select("key").distinct().count() == len({k for _, k, _ in rows})
    last = max(int(r["batch"]) for r in spark.read.parquet(f"{root}/index").select("batch").distinct().collect())
    assert last == 9 and max(map(len, T._index(spark, root, last + 1).values())) <= 3
    held = spark.read.parquet(*[f"{root}/keys/batch={at}/_bucket={b}" for b, ats in T._index(spark, root, last + 1).items() for at in ats])
    assert held.count() == got.count()
