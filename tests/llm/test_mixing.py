from collections import Counter, defaultdict
from fractions import Fraction

from tests.llm.helpers import awkward, words

from pyspark.sql import functions as F

from molscreen.llm import mixing as q


def targets(sizes):
    """Words per source (None last), by filling sources at their limit first."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: q.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, free, out = Fraction(sum(sizes.values())), set(names), {}
    while True:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total > 3 * sizes[s]} if free else set()
        if not full:
            break
        out |= {s: Fraction(3 * sizes[s]) for s in full}
        left -= sum(3 * sizes[s] for s in full)
        free -= full
    return out | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}


def check(docs, plan_rows):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r["source"]] += len(words(r["text"]))
    want = targets(sizes)
    taken = defaultdict(int)
    for r in plan_rows:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) <= 1e-9 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
    # repeated keys share a cut by size, so they may leave a few words
    assert all(0 <= want[s] - taken[s] < 4 for s in want)


def test_query_reaches_its_targets_and_repeats(spark):
    folder = "/root/testdata/sf0.001"
    rows = q.query(spark, folder).collect()
    check(spark.read.parquet(folder + "/documents.parquet").collect(), rows)
    again = q.query(spark, folder).collect()
    assert Counter(rows) == Counter(again)


def _rows(docs):
    sizes = q.sized(docs)
    return q._with_cuts(sizes, q.mix(sizes), F.col("source")).withColumn("taken", q.taken(F.col("size"), F.col("key"))).collect()


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = _rows(docs)
    assert len(rows) == docs.count()
    check(docs.collect(), rows)
    empty = docs.where("text IS NULL OR doc_id IN (5, 6)")
    assert {r["taken"] for r in _rows(empty)} == {0}
    assert _rows(docs.limit(0)) == []


def test_hot_source(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 7 AS int)) AS text", "IF(id % 3 = 0, 'hot', concat('s', id % 11)) AS source")
    check(docs.collect(), _rows(docs))


def test_copies_hold_the_words_taken(spark):
    docs = awkward(spark)
    out = q.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r["source"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    want = Counter()
    for r in _rows(docs):
        want[r["source"]] += r["taken"]
    assert +got == +want
    assert q.stage(spark, docs.limit(0), "").count() == 0
