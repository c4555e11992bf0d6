"""Column functions against their definitions, including NaN, infinity and null."""

import json
import math

from pyspark.sql import functions as F

from molscreen.functions import bits as B
from molscreen.functions import desirability as D
from molscreen.functions import features as X
from molscreen.functions import validate as V

NAN, INF = float("nan"), float("inf")


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lit(v):
    return F.lit(v).cast("double")


def test_ramps(spark):
    r = one(
        spark,
        D.higher_better(lit(-6.0), -5.5, -4.5), D.higher_better(lit(-4.0), -5.5, -4.5), D.higher_better(lit(-5.0), -5.5, -4.5),
        D.higher_better(lit(NAN), 0.0, 1.0), D.higher_better(lit(INF), 0.0, 1.0), D.higher_better(lit(1.0), 2.0, 2.0),
        D.lower_better(lit(NAN), 0.0, 1.0), D.lower_better(lit(1.0), 2.0, 2.0), D.lower_better(lit(0.25), 0.0, 1.0),
        D.lower_better(lit(NAN), 0.0, 1.0, strict=True), D.higher_better(lit(None), 0.0, 1.0),
    )
    assert list(r) == [0.0, 1.0, 0.5, 0.0, 0.0, 0.0, 1.0, 1.0, 0.75, 0.0, None]


def test_window_and_binary(spark):
    r = one(
        spark,
        D.window(lit(14.0), 4.0, 24.0), D.window(lit(2.0), 4.0, 24.0), D.window(lit(48.0), 4.0, 24.0), D.window(lit(NAN), 4.0, 24.0),
        D.binary(lit(0.9), True), D.binary(lit(0.9), False), D.binary(lit(1.5), True), D.binary(lit(NAN), True), D.binary(lit(-INF), False),
    )
    assert [round(v, 12) for v in r] == [1.0, 0.0, 0.0, 0.0, 0.9, 0.1, 1.0, 0.0, 0.0]


def mean(spark, terms):
    by_row = D.geometric_mean([(lit(d), lit(w)) for d, w in terms])
    row = one(spark, by_row)[0]
    tall = spark.createDataFrame(terms or [(None, None)], "d double, w double").agg(
        D.geometric_mean_agg(F.col("d"), F.col("w"))
    ).first()[0]
    assert (row is None and tall is None) or math.isclose(row, tall, rel_tol=1e-12, abs_tol=1e-15)
    return row


def test_one_fatal_term_disqualifies(spark):
    terms = [(1.0, 1.0)] * 11 + [(0.0, 2.0)]
    assert mean(spark, terms) == 0.0
    assert sum(d for d, _ in terms) / 12 > 0.9


def test_geometric_mean_edges(spark):
    assert mean(spark, [(0.0, 0.0), (0.5, 1.0)]) == 0.5  # weight 0 does not disqualify
    assert math.isclose(mean(spark, [(NAN, 1.0), (1.0, 1.0)]), 1e-3)  # NaN falls to the floor
    assert mean(spark, [(0.5, 0.0)]) is None
    assert mean(spark, [(None, 1.0), (0.25, 2.0)]) == 0.25
    assert mean(spark, [(None, 1.0)]) is None
    assert D.geometric_mean([]) is not None


def test_bits(spark):
    words = B.from_bits(F.array(*[F.lit(i) for i in (0, 63, 64, 2047, 2048)]))
    r = one(spark, B.popcount(words), B.get_bit(words, F.lit(63)), B.get_bit(words, F.lit(2048)), B.get_bit(words, F.lit(5)), F.size(words))
    assert list(r) == [4, True, True, False, 32]
    empty = B.from_bits(F.array().cast("array<int>"))
    r = one(spark, B.tanimoto(empty, empty), B.tanimoto(words, words), B.is_empty(empty), B.tanimoto(words, empty))
    assert list(r) == [0.0, 1.0, True, 0.0]


def test_bound_and_status(spark):
    r = one(
        spark,
        B.can_exceed(F.lit(45), F.lit(100), 0.45), B.can_exceed(F.lit(44), F.lit(100), 0.45), B.can_exceed(F.lit(0), F.lit(0), 0.1),
        B.classify(lit(0.45)), B.classify(lit(0.4499)), B.classify(lit(0.30)), B.classify(lit(0.2999)),
    )
    assert list(r) == [True, False, False, "in_domain", "low_confidence", "low_confidence", "out_of_domain"]


def test_input_and_keys(spark):
    cases = ["CCO", "", "   ", " ", "C" * 1000, "C" * 1001, "é" * 501, "CCéO", "C\tC", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "i int, s string")
    got = [r[0] for r in df.select(V.input_error(F.col("s"))).collect()]
    assert got == [None, "empty_input", "empty_input", "empty_input", None, "input_too_long", "input_too_long", "illegal_character", "illegal_character", "empty_input"]
    keys = ["BSYNRYMUTXBXSQ-UHFFFAOYSA-N", "BSYNRYMUTXBXSQ-UHFFFAOYSA-", "bSYNRYMUTXBXSQ-UHFFFAOYSA-N", "BSYNRYMUTXBXSQUUHFFFAOYSA-N", "BSYNRYMUTXBXS1-UHFFFAOYSA-N", "BSYNRYMUTXBXSQ-UHFFFAOYSA-N\n"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(keys)], "i int, s string")
    assert [r[0] for r in df.select(V.is_key(F.col("s"))).collect()] == [True, False, False, False, False, False]
    r = one(spark, V.key_skeleton(F.lit(keys[0])), V.parse_status(F.lit("running")), V.parse_status(F.lit("Running")))
    assert list(r) == ["BSYNRYMUTXBXSQ", "running", None]
    assert one(spark, V.render_error(F.lit("CCC)C"), F.lit(3), F.lit("x")))[0] == "CCC)C\n   ^ x"


def test_feature_rows(spark):
    row = X.atom_row(F.lit(0), F.lit(9), F.lit(-7), F.lit(9), F.lit(5), F.lit(True), F.lit(False))
    r = one(spark, row, X.is_wellformed(row), X.is_wellformed(F.slice(row, 1, 32)), X.is_wellformed(F.transform(row, lambda v: v * 0)))
    assert [i for i, v in enumerate(r[0]) if v] == [0, 15, 16, 25, 28, 31]
    assert list(r)[1:] == [True, False, False]
    schema = json.loads(X.schema_json())
    assert sum(b["width"] for b in schema["blocks"]) == schema["n_features"] == 33
    at = 0
    for b in schema["blocks"]:
        assert b["offset"] == at
        at += b["width"]
    assert X.block("in_ring") == (32, 1)
