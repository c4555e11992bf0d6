"""Sources, streams, the screening plan, and every registered query against its SQL."""

import datetime as dt
import json
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from molscreen.operators import molgraph as G
from molscreen.operators import smiles as S
from molscreen.plans import screen as W
from molscreen.schemas import endpoint_registry
from molscreen.sources import database as DB
from molscreen.sources import files as IO
from molscreen.streaming import batches as T

SF = "/root/testdata/sf0.001"


def test_endpoint_files(spark, tmp_path):
    root = str(tmp_path / "raw")
    os.makedirs(root)
    for name, text in {"hia_train_val": "Drug_ID,Drug,Y\nd1,CCO,1\nd2,CC,0\n", "hia_test": "Drug_ID,Drug,Y\nd3,C,x\n", "bbb_test": "Drug_ID,Drug,Y\nd4,N,1\n"}.items():
        (tmp_path / "raw" / f"{name}.csv").write_text(text)
    rows, missing = IO.read_endpoints(spark, root, ["hia", "bbb"])
    assert sorted((r.endpoint, r.split, r.Drug) for r in rows.collect()) == [("bbb", "test", "N"), ("hia", "test", "C"), ("hia", "train_val", "CC"), ("hia", "train_val", "CCO")]
    assert [(r.endpoint, r.split) for r in missing.collect()] == [("bbb", "train_val")]
    assert IO.count_rows(spark, f"{root}/hia_train_val.csv") == 2
    sources = {"a": f"{root}/hia_test.csv", "b": f"{root}/nope.csv", "c": f"{root}/bbb_test.csv"}
    out = str(tmp_path / "staged")
    got = {r.name: r.status for r in IO.stage(spark, sources, out, ["Drug", "Y"]).collect()}
    assert got == {"a": "staged", "b": "failed", "c": "staged"}
    assert {r.status for r in IO.stage(spark, sources, out, ["Drug"]).collect()} == {"skipped", "failed"}
    assert {r.status for r in IO.stage(spark, sources, out, ["Nope"], force=True).collect()} == {"failed"}


def test_profile_files(spark, tmp_path):
    prof = spark.createDataFrame([("hia", 10, 2), ("bbb", 5, 0)], "endpoint string, n_rows long, duplicate_smiles long")
    IO.write_profile(prof, str(tmp_path / "p"))
    assert sorted(tuple(r) for r in IO.read_profile(spark, str(tmp_path / "p")).collect()) == [("bbb", 5, 0), ("hia", 10, 2)]
    (tmp_path / "old.json").write_text(json.dumps({"hia": {"rows": 7, "dup": 1}, "bbb": {"rows": 3, "duplicates": 2}, "x": {"note": "none"}}))
    got = sorted(tuple(r) for r in IO.read_profile(spark, str(tmp_path / "old.json")).collect())
    assert got == [("bbb", 3, 2), ("hia", 7, 1), ("x", None, None)]
    IO.write_manifest(prof, str(tmp_path / "m"), "staged folder")
    m = spark.read.json(str(tmp_path / "m")).first()
    assert m.prescribed_seeds == [1, 2, 3, 4, 5] and m.endpoints.hia.n_rows == 10


def test_float_blobs(spark, tmp_path):
    IO.write_f32([[1.5, -2.0], [0.25, 3.0]], str(tmp_path / "a.f32"))
    assert IO.read_f32(spark, str(tmp_path / "a.f32")).first()["values"] == [1.5, -2.0, 0.25, 3.0]
    (tmp_path / "bad.f32").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole number"):
        IO.read_f32(spark, str(tmp_path / "bad.f32")).collect()


def test_limits_tables_and_export(spark, tmp_path):
    assert IO.within_batch_limit(spark.range(10), 10) and not IO.within_batch_limit(spark.range(11), 10)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS store LOCATION '{tmp_path}/store'")
    assert DB.create_tables(spark, "store") == DB.create_tables(spark, "store")
    assert spark.table("store.predictions").count() == 0
    mols = spark.createDataFrame([("K1", [1, 2]), ("K2", None)], "inchikey string, words array<bigint>")
    assert [r.ref_id for r in DB.all_fingerprints(mols).collect()] == ["K1"]
    spark.sql("DROP DATABASE store CASCADE")
    IO.export(spark.createDataFrame([("K", 0.5, [1.0])], "key string, score double, v array<double>"), str(tmp_path / "x"), "v1")
    assert spark.read.csv(str(tmp_path / "x"), header=True, escape=chr(34)).first()["v"] == "[1.0]"
    r = spark.read.csv(str(tmp_path / "x"), header=True).first()
    assert (r.key, r.model_version) == ("K", "v1") and "untrained" in r.caveat
    over = spark.createDataFrame([("hia", 8, 1, 12.5)], "endpoint string, n_rows long, over_cap long, over_cap_pct double")
    assert IO.over_cap_table(over).first().share == "12.500%"


def test_command_line(capsys):
    from molscreen.__main__ import main

    main(["schema"])
    assert json.loads(capsys.readouterr().out)["n_features"] == 33


def test_stream_survives_a_replayed_batch(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "run")
    df = spark.createDataFrame([(i, f"K{i % 7}", float(i % 50), i % 10 == 0) for i in range(200)], "row_index long, inchikey string, score double, bad boolean")
    df.where("row_index < 120").repartition(3).write.parquet(src)
    open_stream = lambda: T.file_stream(spark, src, df.schema)
    T.rank_stream(open_stream(), root, 5, row_index="row_index").awaitTermination()
    T.dedup_stream(open_stream(), root, ["inchikey"], "row_index").awaitTermination()
    df.where("row_index >= 120").repartition(2).write.mode("append").parquet(src)
    T.rank_stream(open_stream(), root, 5, row_index="row_index").awaitTermination()  # resumes
    T.dedup_stream(open_stream(), root, ["inchikey"], "row_index").awaitTermination()
    T.progress_stream(open_stream(), root, "bad").awaitTermination()
    want = sorted(df.collect(), key=lambda r: (-r.score, [-ord(c) for c in r.inchikey], r.row_index))[:5]
    ranked = lambda: [r.row_index for r in T.ranked(spark, root, 5, row_index="row_index").collect()]
    assert ranked() == [r.row_index for r in want]
    assert T.stored(spark, root).count() == 7
    last = T.progress(spark, root).orderBy(F.desc("batch")).first()
    assert (last.rows_done, last.rows_failed) == (200, 20)
    # a batch written again replaces its own folder
    T._read(spark, root, "top").where("batch = 0").drop("batch").limit(5).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(f"{root}/top/batch=0")
    assert ranked() == [r.row_index for r in want]
    log, at = str(tmp_path / "log"), dt.datetime(2024, 1, 1)
    T.create_batch(spark, log, "b1", at)
    with pytest.raises(ValueError):
        T.finish_batch(spark, log, "b1", "running", at)
    T.finish_batch(spark, log, "b1", "completed", at + dt.timedelta(seconds=1))
    assert T.statuses(spark, log).first().status == "completed"


def test_screen_and_cache(spark, tmp_path):
    rows = spark.createDataFrame([(0, "CCO"), (1, "OCC"), (2, "CC)"), (3, None), (4, "c1ccccc1O")], "row_index long, smiles string")
    refs = G.perceive(S.parse(rows, "row_index", "smiles")).where("words is not null").selectExpr("row_index as ref_id", "words")
    out = {r.row_index: r for r in W.screen(rows, refs).collect()}
    assert len(out) == 5 and out[0].mol_key == out[1].mol_key and out[0].triage_score == out[1].triage_score
    assert out[2].error_code == "unbalanced_paren" and out[2].triage_score is None and "^" in out[2].error_detail
    assert out[3].error_code == "empty_input" and not out[0].cached
    known = spark.createDataFrame([(out[0].mol_key, "untrained-0", [0.0] * 12)], "mol_key string, model_version string, outputs array<double>")
    hit = {r.row_index: r for r in W.screen(rows, refs, stored=known).collect()}
    assert hit[0].cached and hit[1].cached and not hit[4].cached
    assert math.isclose(hit[0]["values"][1], 0.5) and np.allclose(hit[4]["values"], out[4]["values"])
    far = W.screen(rows.where("row_index = 4"), refs.where("ref_id = 0")).first()
    assert far.status == "out_of_domain" and far.triage_score is None and far.withheld
    tall = W.explain_values(W.screen(rows, refs), "row_index")
    assert tall.count() == 36 and tall.where("desirability is null").count() == 0
    rows.select("smiles").write.csv(str(tmp_path / "lib"), header=True)
    done = W.import_library(spark, str(tmp_path / "lib"), str(tmp_path / "out"), refs).first()
    # an empty line of a one-column file is no row, and a message of two lines is one
    assert (done.completed, done.failed) == (3, 1)
    assert endpoint_registry(spark).count() == 12


def canon(v):
    return "NaN" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    got = df.collect()
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    ref = con.execute(sql)
    cols = [d[0] for d in ref.description]
    assert sorted(cols) == sorted(df.columns)
    pick = sorted(cols)
    want = Counter(tuple(canon(r[cols.index(c)]) for c in pick) for r in ref.fetchall())
    assert Counter(tuple(canon(r[c]) for c in pick) for r in got) == want
