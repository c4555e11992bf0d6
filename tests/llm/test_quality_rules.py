import random

from tests.llm.helpers import awkward, words

from molscreen.llm import quality_rules as q


def plain(text):
    text = text or ""
    ws = words(text)
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    covered = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines),
        sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text), sum(a == b for a, b in zip(ws, ws[1:])),
    )


def test_measures_equal_plain_counts():
    rnd = random.Random(3)
    texts = [None, "", " \n\t", "a " * 40] + ["".join(rnd.choice(["a ", "b ", "Ca ", "\n", "|", "é\x85 ", "a b Ca "]) for _ in range(rnd.randint(0, 90))) for _ in range(60)]
    got = q.measure(texts)
    assert [tuple(int(got[m][i]) for m in q.MEASURES) for i in range(len(texts))] == [plain(t) for t in texts]


def test_ledger_policies_and_ablation(spark):
    docs = awkward(spark)
    entries = q.ledger(docs).cache()
    assert entries.count() == docs.count()
    rows = entries.collect()
    for r in rows:
        assert bool(r["failed"] & q.BIT["few_words"]) == (len(words(r["row"]["text"])) < 20)
    for policy in q.POLICIES.values():
        kept = q.apply_policy(entries, policy).where("kept").count()
        assert kept == sum(not r["failed"] & policy.mask for r in rows)
    for r in q.ablation(entries).collect():
        bit = q.BIT[r["rule"]]
        assert r["n_failed"] == sum(bool(x["failed"] & bit) for x in rows)
        assert r["n_only"] == sum(x["failed"] & q.CURRENT.mask == bit for x in rows)


def test_stage_keeps_columns(spark):
    docs = awkward(spark)
    out = q.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {1, 2, 3, None}
    assert q.stage(spark, docs.limit(0), "").count() == 0
