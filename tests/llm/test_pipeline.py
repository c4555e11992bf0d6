"""The five stages against plain versions of them."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
from tests.llm import test_mixing, test_near_copies, test_packing, test_quality_rules
from tests.llm.helpers import awkward, words

import corpus_pipeline
from molscreen.llm import packing, quality_model
from molscreen.session import materialise

FOLDER = "/root/testdata/sf0.001"


def rules(text):
    n, chars, symbols, dup, repeat, lines, upper, lower, stutter = test_quality_rules.plain(text)
    failed = n < 20 or 100 * repeat > 30 * n or 10 * symbols > n or (dup >= 2 and 2 * dup > lines) or upper > lower
    return not (failed or chars < 2 * n or chars > 25 * n or 100 * stutter > 20 * n)


def near_duplicates(rows):
    best = {}
    for r, root in sorted(zip(rows, test_near_copies.brute([r["text"] for r in rows])), key=lambda x: x[0]["doc_id"]):
        best.setdefault(root, r)
    return list(best.values())


def mixed(rows):
    """(doc_id, words of the copy) counts."""
    size = {r["doc_id"]: len(words(r["text"])) for r in rows}
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r["doc_id"])
    goal = test_mixing.targets({s: sum(size[d] for d in ds) for s, ds in by_source.items()})
    out = Counter()
    for s, ds in by_source.items():
        left = int(goal[s])
        ds.sort(key=lambda d: hashlib.md5(f"{d}:9".encode()).hexdigest()[:15])
        while left > 0:
            for d in ds:
                out[(d, min(size[d], left))] += bool(min(size[d], left))
                left -= min(size[d], left)
    return +out


def test_every_stage(spark):
    docs = spark.read.parquet(FOLDER + "/documents.parquet")
    columns = docs.columns
    rows = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    after = {}
    for name in stages:
        docs = after[name] = materialise(stages[name](spark, docs, FOLDER), name)
        assert name == "packing" or docs.columns == columns
    rows = [r for r in rows if rules(r["text"])]
    assert Counter(after["quality_rules"].collect()) == Counter(rows)
    weights = quality_model.fit(spark, spark.read.parquet(FOLDER + "/documents.parquet"), FOLDER)

    def score(text):
        index, value = quality_model.vector(text)
        z = sum(weights.get(int(i), 0.0) * v for i, v in zip(index, value)) + weights.get(quality_model.DIM, 0.0)
        return 1 / (1 + np.exp(-z))

    rows = [r for r in rows if score(r["text"]) >= quality_model.THRESHOLD]
    assert Counter(after["quality_model"].collect()) == Counter(rows)
    rows = near_duplicates(rows)
    assert Counter(after["near_duplicates"].collect()) == Counter(rows)
    copies = after["mixing"].collect()
    assert Counter((r["doc_id"], len(words(r["text"]))) for r in copies) == mixed(rows)
    test_packing.check(after["packing"].collect(), [(r["doc_id"], r["text"]) for r in copies], packing.CAPACITY)


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "row_id", "ids", "sequence_id", "offset"]
    assert got.count() > 0


def test_clean_documents_stay(spark):
    """Hardly a document labelled good is lost, but for short ones, which the base rule rejects."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(folder + "/documents.parquet")
    good = {r["doc_id"] for r in spark.read.parquet(folder + "/labels.parquet").where("quality = 1").collect()}
    long = {r["doc_id"] for r in docs.collect() if len(words(r["text"])) >= 20} & good
    kept = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    kept = corpus_pipeline.STAGES[1][1](spark, kept, folder)
    assert len(long - {r["doc_id"] for r in kept.collect()}) <= 0.01 * len(long)


def test_awkward_rows_pass_every_stage(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).count()
        stage(spark, docs.limit(0), FOLDER).count()
