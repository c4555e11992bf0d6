import random

import numpy as np
import xxhash
from tests.llm.helpers import Sets, awkward, words

from molscreen.llm import simhash as q
from molscreen.session import materialise


def plain(text):
    ws = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    prints = sorted(set(prints))
    sets = Sets()
    for i, a in enumerate(prints):
        sets.find(a)
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                sets.join(a, b)
    return {p: sets.find(p) for p in prints}


def clustered(n, seed):
    """Random prints, chains of small steps and a dense group."""
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(n)]
    at = rnd.getrandbits(64)
    for _ in range(n):
        for _ in range(rnd.randint(1, 5)):
            at ^= 1 << rnd.randrange(64)
        out.append(at)
    center = rnd.getrandbits(64)
    for _ in range(n):
        x = center
        for _ in range(rnd.randint(0, 4)):
            x ^= 1 << rnd.randrange(64)
        out.append(x)
    return sorted(set(out))


def same_sets(a, b):
    return sorted(sorted(k for k in a if a[k] == v) for v in set(a.values())) == sorted(sorted(k for k in b if b[k] == v) for v in set(b.values()))


def test_fingerprints():
    texts = [None, "", "a", "One two THREE four five", "É a b c d e", "a b c d " * 50, "  x\x85y z \x1c"]
    assert [q.fingerprint(t) for t in texts] == [plain(t) for t in texts]


def test_links_connect_what_all_pairs_connect(spark):
    prints = clustered(300, 5)
    df = spark.createDataFrame([(q._signed(p),) for p in prints], "fp bigint").repartition(3)
    got = {r["fp"]: r["root"] for r in q.groups(df).collect()}
    want = components(prints)
    assert same_sets(got, {q._signed(k): v for k, v in want.items()})


def test_long_runs_take_the_half_byte_index(monkeypatch):
    monkeypatch.setattr(q, "RUN", 16)
    rnd = random.Random(8)
    mask = q.masks(8, 8, 4)[17]
    fixed = rnd.getrandbits(64) & mask
    run = np.unique(np.array([fixed | (p & ~mask & (1 << 64) - 1) for p in clustered(120, 9)], np.uint64))
    sets = Sets()
    for p in run.tolist():
        sets.find(p)
    for a, b in q.run_links(run, mask):
        assert (int(a) ^ int(b)).bit_count() <= 4
        sets.join(int(a), int(b))
    assert same_sets({p: sets.find(p) for p in run.tolist()}, components(run.tolist()))


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet(folder + "/documents.parquet").collect()}
    root = components(texts.values())
    least = {}
    for d, p in sorted(texts.items()):
        least.setdefault(root[p], d)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in q.query(spark, folder).collect()}
    assert got == {d: (format(p, "016x"), least[root[p]]) for d, p in texts.items()}


def test_awkward_rows(spark):
    docs = awkward(spark)
    prints = materialise(q.fingerprints(docs, docs.columns).select("row.doc_id", "row.failed", "fp"), "prints")
    assert {r["failed"]: r["fp"] for r in prints.collect()} == {r["failed"]: q._signed(plain(r["text"])) for r in docs.collect()}
    got = {r["fp"]: r["root"] for r in q.groups(prints).collect()}
    want = components([plain(r["text"]) for r in docs.collect()])
    assert same_sets(got, {q._signed(k): v for k, v in want.items()})
    assert q.groups(prints.limit(0)).count() == 0


def test_a_hot_list_is_spread_over_finer_lists(spark, monkeypatch):
    """20 000 fingerprints that share four bytes: as many tasks as lists, and the links of brute force."""
    rng = np.random.default_rng(8)
    fps = np.unique((rng.integers(0, 1 << 32, 20_000, dtype=np.uint64) << np.uint64(32)) | np.uint64(0xDEADBEEF))
    prints = spark.createDataFrame([(q._signed(int(f)),) for f in fps], "fp bigint").repartition(4)
    monkeypatch.setattr(q, "HOT", 2000)
    monkeypatch.setattr(q, "SAMPLE", 4)
    assert q.hot_lists(prints).count() == 1
    longest = q.spread_postings(prints).groupBy("list", "bytes").count().agg({"count": "max"}).first()[0]
    assert longest < 2000
    sets, got = Sets(), Sets()
    for i in range(0, len(fps), 500):
        a, b = np.nonzero(np.bitwise_count(fps[i : i + 500, None] ^ fps[None, :]) <= 4)
        for x, y in zip((a + i).tolist(), b.tolist()):
            sets.join(int(fps[x]), int(fps[y]))
    linked = q.links(prints).collect()
    assert all(((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() <= 4 for r in linked)
    for r in linked:
        got.join(r["u"] & (2**64 - 1), r["v"] & (2**64 - 1))
    assert len(linked) > 500 and all(got.find(int(f)) == sets.find(int(f)) for f in fps)
