import numpy as np

from pyspark.sql import functions as F

from molscreen.llm import rotated_codes as q


def exact(ids, vectors, i, k):
    score = (vectors * vectors[i]).sum(axis=1)
    rest = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]]
    return [(int(ids[j]), float(score[j])) for j in rest[:k]]


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((2000, 48)) * rng.uniform(0.1, 5, (2000, 1))
    turn = q.rotation(48)
    assert np.allclose(turn @ turn.T, np.eye(48))
    outside = 0
    for query in rng.standard_normal((20, 48)):
        guess, bound = q.estimate(*q.encode(vectors, turn), query, turn)
        outside += (np.abs(guess - vectors @ query) > bound).mean()
    assert outside / 20 < 0.01


def test_query_recall_and_scores(spark):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(folder + "/embeddings.parquet").toPandas()
    ids, vectors = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(float)
    got = {}
    for r in q.query(spark, folder).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    asked = np.flatnonzero(ids % 20 == 0)
    assert sorted(got) == sorted(ids[asked].tolist())
    hits = 0
    for i in asked:
        want, mine = exact(ids, vectors, i, 20), got[int(ids[i])]
        assert sorted(mine) == list(range(1, 21))
        hits += len({w[0] for w in want} & {m[0] for m in mine.values()})
        assert all(s == float((vectors[np.flatnonzero(ids == v)[0]] * vectors[i]).sum()) for v, s in mine.values())
    assert hits / (20 * len(asked)) >= 0.98


def test_blocks_and_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(q, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(q, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(60)]
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, None), (63, []), (64, [0.0] * 8), (65, [1.0, None] * 4), (66, [float("nan")] * 8), (67, [float("inf")] * 8), (68, [1.0] * 5), (80, [2.0] * 5), (None, [1.0] * 8), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in q.neighbours(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    good = [r for r in rows if r[1] and len(r[1]) == 8 and r[0] is not None and r[0] < 62]
    ids, vectors = np.array([r[0] for r in good]), np.array([r[1] for r in good])
    assert sorted(got) == [0, 20, 40, 60, 80]
    for query in (0, 20, 40, 60):
        want = exact(ids, vectors, int(np.flatnonzero(ids == query)[0]), 20)
        assert [v for v, _ in got[query]] == [v for v, _ in want]
    assert got[80] == [(68, 10.0)]
    assert q.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_without_bounds_the_search_is_exact(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((3000, 40)) * rng.uniform(0.1, 3, (3000, 1))
    vectors[500:1500] = vectors[500]
    ids = np.arange(3000)
    df = spark.createDataFrame(list(zip(ids.tolist(), vectors.tolist())), "vec_id bigint, embedding array<double>").selectExpr("*", "1 as id", "2 as d", "map(1, 2) as `a.b`")
    got = {}
    for r in q.neighbours(df, F.col("vec_id") % 100 == 0, 10, sigmas=float("inf")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {i: exact(ids, vectors, i, 10) for i in range(0, 3000, 100)}


def test_few_vectors_are_fetched_where_many_bounds_reach_the_bar(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((20_000, 64)).astype(np.float32)
    vectors[5000:5100] = vectors[5000]
    ids, fetched, exact_of = rng.permutation(20_000), [], q._exact
    monkeypatch.setattr(q, "_exact", lambda vectors, pick, *rest: fetched.append(len(pick)) or exact_of(vectors, pick, *rest))

    def found():
        fetched.clear()
        return list(q.Block(ids, vectors, q.SIGMAS).search(ids[4990:5030], vectors[4990:5030], 20)), sum(fetched) / 40

    got, few = found()
    assert few < 500
    monkeypatch.setattr(q, "DENSE", 0)
    monkeypatch.setattr(q, "PAIRS", 10_000)
    want, many = found()
    got, want = ([np.concatenate(x).tolist() for x in zip(*some)] for some in (got, want))
    assert many > 1000 and len(want[0]) == 40 * 20
    assert got == want


def test_every_task_has_one_block(spark, monkeypatch):
    monkeypatch.setattr(q, "TASK_ROWS", 20)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(600)], "vec_id bigint, embedding array<double>")
    met, run = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a: met.append(self) or run(self, *a))
    q.neighbours(df, F.col("vec_id") % 20 == 0)
    places = met[0].select(F.spark_partition_id(), "c").distinct().collect()
    assert len(places) == len({p for p, _ in places}) == len({c for _, c in places}) == q.TASK_BLOCKS
