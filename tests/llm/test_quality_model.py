import math
import zlib

import numpy as np
from tests.llm.helpers import awkward

from molscreen.llm import quality_model as q

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    scored = q.query(spark, FOLDER).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(FOLDER + "/labels.parquet").collect()}
    rows = [(r, truth[r["doc_id"]]) for r in scored if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scored)
    assert sum(r["predicted"] == y for r, y in rows) / len(rows) > 0.97
    assert sum(r["predicted"] == 1 for r, y in rows if y == 1) / sum(y for _, y in rows) > 0.99


def test_vector_shares_and_repeats():
    index, value = q.vector("the cat the cat")
    assert len(index) == len(value) and math.isclose(float((value[:-1] ** 2).sum()), 1.0)
    assert q.vector(None)[0].tolist() == q.vector(" \n")[0].tolist()
    assert q._shape(b"THE!!") == b"A!" and q._shape(b"ab12") == b"a9"


def test_leader_learns_a_feature():
    leader = q.Leader(8)
    for _ in range(50):
        leader.learn(np.array([1]), np.array([1.0]), 1)
        leader.learn(np.array([2]), np.array([1.0]), 0)
    one, two = leader.weights(np.array([1, 2]))
    assert one > 1 and two < -1


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (99, 1, 0), (7, None, 0), (2, 5, 0)], "doc_id bigint, quality int, toxic int")
    rows = q.training_rows(docs, labels)
    assert {r["doc_id"] for r in rows.collect()} <= {1, 3}
    weights = q.train(rows)
    got = q.score(docs, weights).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["row"]["text"] in (None, "")}) == 1
    assert q.train(rows.limit(0)) == {}
    assert {r["score"] for r in q.score(docs, {}).collect()} == {0.5}
    assert q.score(docs.limit(0), weights).count() == 0


def test_bound_takes_smallest_hashes(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "'a b c' AS text")
    labels = spark.range(300).selectExpr("id AS doc_id", "1 AS quality")
    assert q.training_rows(docs, labels, 50).count() == 50
