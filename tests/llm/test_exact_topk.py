import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from molscreen.llm import exact_topk as q


def plain(rows, asked, k):
    """All pairs in Python integers."""
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(1024 * x) if abs(x) < 2**53 else 1024 * int(x) for x in v]) for i, v in good]
    first = {}
    for i, v in sorted(good):
        if asked(i):
            first.setdefault(i, [math.floor(1024 * x) if abs(x) < 2**53 else 1024 * int(x) for x in v])
    out = {}
    for i, v in first.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i and len(w) == len(v))
        out[i] = [(j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for s, j in found[:k]]
    return {i: v for i, v in out.items() if v}


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("dims", [1, 15, 64, 100])
def test_bounds_drop_nothing_that_counts(dims):
    rng = np.random.default_rng(dims)
    vectors = rng.standard_normal((3000, dims)) * rng.uniform(0.1, 3, dims) * rng.uniform(0.2, 2, (3000, 1))
    vectors[100:700] = vectors[100]  # ties beyond k
    whole = q.quantise(vectors.ravel(), dims).reshape(-1, dims)
    ids = rng.permutation(3000)
    block = q.Block(ids, whole)
    asked = rng.choice(3000, 70, replace=False)
    for (qid, got, score), at in zip(block.best(ids[asked], whole[asked], 10), asked):
        full = whole @ whole[at]
        want = [j for j in np.lexsort((ids, -full)) if ids[j] != qid][:10]
        assert got.tolist() == ids[want].tolist() and score.tolist() == full[want].tolist()
    if dims >= 64:
        assert block.read < 0.8 * 70 * 3000 * dims  # survivors are compacted


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r[0], [float(x) for x in r[1]]) for r in spark.read.parquet(folder + "/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert result(q.query(spark, folder)) == plain(rows, lambda i: i % 100 == 0, 10)


def test_cells_and_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(q, "CELL_VALUES", 64)
    monkeypatch.setattr(q, "TASK_ROWS", 8)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(60)]
    rows += [(60, rows[3][1])] * 30 + [(61, rows[3][1]), (62, None), (63, []), (64, [0.0] * 8), (100, [0.0] * 8), (65, [1.0, None] * 4)]
    rows += [(66, [float("nan")] * 8), (67, [float("inf")] * 8), (68, [1.0] * 5), (80, [2.0] * 5), (None, [1.0] * 8), (20, rows[20][1]), (20, rows[21][1])]
    rows += [(200, [1e9, -3.0]), (201, [1e30, 2.5]), (202, [-7e11, 0.1]), (203, [1e-9, -1e-9])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("vec_id", "embedding", "'x' as id", "1 as `a.b`", "2 as v", "map(1, 2) as q")
    asked = lambda i: i % 20 == 0
    assert result(q.top_k(df, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))) == plain(rows, asked, 10)
    assert q.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
