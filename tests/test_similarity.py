"""Both similarity plans against brute force, with empty sets, copies and few references."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from molscreen.operators import similarity as N


def frames(spark, seed, n_q=60, n_r=90, words=3):
    rng = np.random.default_rng(seed)
    q = [rng.integers(-(2**63), 2**63 - 1, words) & rng.integers(-(2**63), 2**63 - 1, words) for _ in range(n_q)]
    r = [rng.integers(-(2**63), 2**63 - 1, words) & rng.integers(-(2**63), 2**63 - 1, words) for _ in range(n_r)]
    q[0] = q[1] = r[0] = np.zeros(words, np.int64)  # empty sets
    for i in range(30, n_q):  # a third and more are copies
        q[i] = r[3]
    for i in range(0, min(n_r, 20)):
        r[-1 - i] = r[-1]
    to = lambda rows: [(i, [int(w) for w in v]) for i, v in enumerate(rows)]
    return (
        spark.createDataFrame(to(q), "query_id long, words array<long>"),
        spark.createDataFrame(to(r), "ref_id long, words array<long>"),
        [set(np.flatnonzero(np.unpackbits(v.view(np.uint8)))) for v in q],
        [set(np.flatnonzero(np.unpackbits(v.view(np.uint8)))) for v in r],
    )


def score(a, b):
    union = len(a | b)
    return len(a & b) / union if union else 0.0


PLANS = [{}, {"bound": 0, "block_rows": 25}]


@pytest.mark.parametrize("plan", PLANS)
def test_mean_of_best_five(spark, plan):
    q, r, qs, rs = frames(spark, 1)
    got = {x.query_id: x for x in N.assess(q, r, **plan).collect()}
    assert len(got) == len(qs)
    for i, a in enumerate(qs):
        want = np.mean(sorted((score(a, b) for b in rs), reverse=True)[:5])
        assert np.isclose(got[i].similarity, want)


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("threshold", [0.2, 1 / 3, 1.0])
def test_threshold_loses_no_pair(spark, plan, threshold):
    q, r, qs, rs = frames(spark, 2)
    got = {(x.query_id, x.ref_id) for x in N.matches(q, r, threshold, **plan).collect()}
    assert got == {(i, j) for i, a in enumerate(qs) for j, b in enumerate(rs) if score(a, b) >= threshold}


@pytest.mark.parametrize("plan", PLANS)
def test_nearest_ties_go_to_the_lowest_id(spark, plan):
    q, r, qs, rs = frames(spark, 3)
    got = {x.query_id: (x.ref_id, x.similarity) for x in N.nearest_named(q, r, **plan).collect()}
    for i, a in enumerate(qs):
        best = max(score(a, b) for b in rs)
        assert np.isclose(got[i][1], best) and got[i][0] == next(j for j, b in enumerate(rs) if score(a, b) == best)


def test_few_and_no_references(spark):
    q, r, qs, rs = frames(spark, 4)
    two = N.assess(q, r.where("ref_id in (5, 6)"))
    for x in two.collect():
        assert np.isclose(x.similarity, np.mean([score(qs[x.query_id], rs[j]) for j in (5, 6)]))
    none = N.assess(q, r.limit(0)).collect()
    assert all(x.similarity == 0.0 and x.status == "out_of_domain" for x in none) and len(none) == len(qs)


def test_column_form_agrees(spark):
    q, r, *_ = frames(spark, 5)
    a = {x.query_id: x.s for x in q.select("query_id", N.similarity_column(r).alias("s")).collect()}
    b = {x.query_id: x.similarity for x in N.assess(q, r).collect()}
    assert a == b


def test_one_near_duplicate_does_not_rescue(spark):
    q = spark.createDataFrame([(0, [0b1111])], "query_id long, words array<long>")
    r = spark.createDataFrame([(0, [0b1111])] + [(i, [1 << (10 + i)]) for i in range(1, 8)], "ref_id long, words array<long>")
    x = N.assess(q, r).first()
    assert np.isclose(x.similarity, 0.2) and x.status == "out_of_domain"
    assert N.assess(q, r, 1).first().status == "in_domain"


def test_sign_words(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0, 2.0] + [0.0] * 59 + [3.0] + [1.0],)], "e array<double>")
    w = df.select(N.sign_words("e").alias("w")).first().w
    assert [x & (2**64 - 1) for x in w] == [1 | 8 | 1 << 63, 1]
    assert df.select(F.size(N.sign_words("e"))).first()[0] == 2


@pytest.mark.parametrize("n", [1, 5])
def test_bands_are_visited_outward_until_no_bound_reaches(spark, monkeypatch, n):
    monkeypatch.setattr(N, "BAND", 8)
    rng = np.random.default_rng(n)
    make = lambda size: np.packbits(np.isin(np.arange(512), rng.choice(512, size, replace=False))).view(np.int64)
    q = [make(k) for k in (0, 1, 5, 40, 41, 200, 400, 512)] + [make(60) for _ in range(5)]
    r = [make(k) for k in (60, 61, 62, 150, 300, 301)] + [make(60) for _ in range(40)]
    r[7] = q[-1]
    frame = lambda rows, name: spark.createDataFrame([(i, [int(w) for w in v]) for i, v in enumerate(rows)], f"{name} long, words array<long>")
    sets = lambda rows: [set(np.flatnonzero(np.unpackbits(v.view(np.uint8)))) for v in rows]
    got = {x.query_id: x.best for x in N.nearest(frame(q, "query_id"), frame(r, "ref_id"), n, bound=0, block_rows=7).collect()}
    named = {x.query_id: (x.ref_id, x.similarity) for x in N.nearest_named(frame(q, "query_id"), frame(r, "ref_id"), bound=0, block_rows=7).collect()}
    for i, a in enumerate(sets(q)):
        scores = [score(a, b) for b in sets(r)]
        assert np.allclose(got[i], sorted(scores, reverse=True)[:n]), i
        assert named[i][0] == scores.index(max(scores)) and np.isclose(named[i][1], max(scores))
    assert N.nearest_named(frame(q, "query_id"), frame(r, "ref_id").limit(0), bound=-1).count() == 0


@pytest.mark.parametrize("threshold", [0.1, 1 / 3, 0.5, 2 / 3, 1.0])
def test_fewest_shared_bits_round_as_the_score_does(threshold):
    sizes = np.arange(1, 130)
    for c in (1, 7, 64, 128):
        need = N._need(c, sizes, threshold)
        for r, least in zip(sizes, need):
            shared = np.arange(min(c, r) + 1)
            reach = shared[shared / (c + r - shared) >= threshold]
            assert least == reach[0] if len(reach) else least > min(c, r)


def test_matching_pairs_leave_in_bounded_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(N, "_CELLS", 1000)
    ref = N.Packed(pa.array(range(500)), np.full((500, 1), 7, np.uint64))
    pieces = [len(i) for i, _, _ in N._matches(np.full((40, 1), 7, np.uint64), ref, 0.5)]
    assert sum(pieces) == 40 * 500 and max(pieces) <= 1000


def test_a_cell_of_copies_leaves_piece_by_piece(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(N, "_CELLS", 1000)
    kept = []

    def score(ids, q, ref, floor):
        for i, j, s in N._matches(q, ref, 0.5):
            kept.append(len(i))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ref.ids.take(pa.array(j)), pa.array(s)], ["qid", "rid", "similarity"])

    side = pa.array([False] * 40 + [True] * 500)
    ids, w = pa.array(range(540)), pa.array([[7]] * 540, pa.list_(pa.int64()))
    cell = pa.RecordBatch.from_arrays([ids, ids, w, side], ["qid", "rid", "w", "_ref"])
    pieces = N._cell(score)(iter([cell.slice(0, 300), cell.slice(300)]))
    first = next(pieces)
    # nothing is compared ahead of what was taken
    assert first.num_rows <= 1000 and len(kept) == 1
    assert first.num_rows + sum(p.num_rows for p in pieces) == 40 * 500


def test_copies_of_a_row_do_not_grow_with_the_rows(spark):
    rows = spark.range(3000).select(F.col("id").alias("qid"), F.array("id").alias("w"), F.lit(0).alias("_band"))
    met = N._met(rows, {0: 3000}, rows.withColumnRenamed("qid", "rid"), {0: 3000}, block_rows=5)
    sides = {r["_ref"]: r["count"] for r in met.groupBy("_ref").count().collect()}
    assert sides == {False: 3000 * 8, True: 3000 * 32}
    assert met.select("_i", "_j").distinct().count() == 8 * 32
    # and blocks stay in memory
    assert N._blocks(10**8, 500, 8) == 1000 and N._blocks(2000, 500, 8) == 4


@pytest.mark.parametrize("words", [1, 5])
def test_only_scores_that_can_rise_are_divided(monkeypatch, words):
    import pyarrow as pa

    rng = np.random.default_rng(words)
    monkeypatch.setattr(N, "_CELLS", 20_000)
    bits = lambda n: rng.integers(0, 2**63, (n, words)).astype(np.uint64)
    q, r = np.vstack([bits(90), np.zeros((1, words), np.uint64)]), np.vstack([bits(3000), np.zeros((1, words), np.uint64)])
    divided, ratio = [], N._ratio
    monkeypatch.setattr(N, "_ratio", lambda s, a, b: (divided.append(s.size), ratio(s, a, b))[1])
    got = N._best(q, N.Packed(pa.array(range(len(r))), r), 5)
    shared = np.bitwise_count(q[:, None] & r[None]).sum(axis=2, dtype=np.int64)
    union = np.bitwise_count(q[:, None] | r[None]).sum(axis=2, dtype=np.int64)
    assert np.array_equal(got, -np.sort(-(shared / np.maximum(union, 1)), axis=1)[:, :5])
    assert sum(divided) < 0.5 * shared.size


def test_word_bits_are_digests_of_words_between_ascii_blanks(spark):
    import hashlib
    import re

    texts = ["  one two\tone\r\n", "a\u00a0b \u2003 \x1f c\x0bd", "", " \n", None, "x" * 3000] + [f"w{i} w{i * 7}" for i in range(2500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").coalesce(1)
    got = {r.i: r.w for r in df.select("i", N.word_bits("s").alias("w")).collect()}
    for i, text in enumerate(texts):
        bits = {int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 2048 for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")}
        want = [sum(1 << (b % 64) for b in bits if b // 64 == k) for k in range(32)]
        assert [w & (2**64 - 1) for w in got[i]] == want if bits else got[i] is None


def test_cells_are_not_merged_into_few_tasks(spark):
    q, r, *_ = frames(spark, 6)
    assert N.matches(q, r, 0.2, bound=0, block_rows=25).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
