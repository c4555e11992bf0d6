import random
import re
import zlib
from collections import Counter

import pytest
from tests.llm.helpers import awkward

from molscreen.llm import spelling as q


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(n, ratio=2):
    """(word, form, root, n, n_near, form_n) by comparing all pairs."""
    form, rows = {}, {}
    for w in n:
        around = sorted((-n[v], v) for v in n if near(w, v))
        best = around[0][1] if around and -around[0][0] >= ratio * n[w] else None
        form[w], rows[w] = best, len(around)
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], rows[w], n[form[w]] if form[w] else None))
    return out


def counted(docs):
    """Damaged and counted words of (id, text) rows."""
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def result(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aé÷×z"])
def test_small_alphabets_against_all_pairs(spark, letters):
    rnd = random.Random(letters)
    n = {"".join(rnd.choices(letters, k=rnd.randint(1, 7))): rnd.choice([3, 3, 4, 7, 16, 40, 99]) for _ in range(300)}
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    assert result(q.variants(df)) == plain(n)


def test_chains_of_forms_end_at_their_root(spark):
    n = {"abcdefghij"[:i] + "zzzzz": 3 << i for i in range(11)}
    got = result(q.variants(spark.createDataFrame(list(n.items()), "word string, n bigint")))
    assert got == plain(n) and {r[2] for r in got} == {"abcdefghijzzzzz"}


def test_awkward_texts(spark):
    docs = awkward(spark).selectExpr("*", "'x' as word", "1 as run", "2 as `a.b`", "map(1, 2) as h")
    copies = docs.unionByName(docs).unionByName(docs)
    rows = [(r["doc_id"], r["text"]) for r in copies.select("doc_id", "text").collect()]
    vocab = q.vocabulary(q.damaged(q.runs(copies)))
    assert {r["word"]: r["n"] for r in vocab.collect()} == counted(rows)
    assert result(q.variants(vocab)) == plain(counted(rows))
    assert q.variants(q.vocabulary(q.damaged(q.runs(docs.limit(0))))).count() == 0
