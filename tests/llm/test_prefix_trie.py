import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from molscreen.llm import prefix_trie as q

FIELDS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def plain(rows):
    """Nodes of the trie of rebuilt conversations, from (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) if children[p] else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[c] for c in children[p])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items()
    }


def result(df):
    rows = [tuple(r) for r in df.select(*FIELDS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return df.selectExpr("*", "1 as a", "'x' as depth", "2 as `a.b`", "map(1, 2) as n", "3 as row", "4 as _part")


@pytest.mark.parametrize("seed", range(3))
def test_z_fast_trie_finds_exits(seed):
    """Every inserted string is found again, and what is expanded are exactly the distinct prefixes."""
    rnd = random.Random(seed)
    strings = [tuple(rnd.choices("ab", weights=[9, 1], k=rnd.randint(1, 70))) for _ in range(400)]
    path = lambda s: q.Path(0, [(0, 0), *[(hash(s[: d + 1]), d) for d in range(len(s))]], [1] * len(s))
    trie = q.ZFastTrie(path(strings[0]))
    for name, s in enumerate(strings):
        trie.insert(path(s), name)
    for s in strings:
        node = trie.locate(path(s))
        assert node.path[node.depth] == path(s)[node.depth] and node.top < len(s) <= node.depth or node.depth == len(s)
    members = defaultdict(list)
    for name, s in enumerate(strings):
        for d in range(1, len(s) + 1):
            members[(hash(s[:d]), d - 1)].append(name)
    got = {(a, b): (n, least) for a, b, _, _, _, _, n, least in trie.expand()}
    assert got == {k: (len(m), min(m)) for k, m in members.items()}
    for low in range(40):
        for high in range(low + 1, 41):
            best = max(range(low + 1, high + 1), key=lambda x: x & -x)
            assert q.two_fattest(low, high) == best


@pytest.mark.parametrize("batch", [3, 1000])
def test_against_a_plain_trie(spark, monkeypatch, batch):
    monkeypatch.setattr(q, "BATCH_TURNS", batch)
    monkeypatch.setattr(q, "CELL_BITS", 2)
    monkeypatch.setattr(q, "CHUNK_BYTES", 10)
    rnd = random.Random(batch)
    rows = []
    for c in range(-45, 150):
        kind = rnd.random()
        if kind < 0.1:
            continue
        n = rnd.choice([1, 2, 3, 5, 9]) if kind < 0.9 else 30
        rows += [(c, t, "user" if t % 2 == 0 else "bot", "a b " * t if kind < 0.3 else rnd.choice(["x", "x y", "z  z z"])) for t in range(n)]
    rows += [(200 + i, 0, "user", "hello there") for i in range(60)]
    assert result(q.trie(frame(spark, rows).repartition(3))) == plain(rows)


def test_awkward_turns(spark):
    rows = [(1, None, None, None), (1, None, "user", ""), (1, 0, "user", "a\tb"), (1, 0, "user", "a\tb"), (1, 0, "bot", "c"), (None, 0, "user", "lost")]
    rows += [(0, 5, "user", "x" * 50_000), (0, 5, "user", "x" * 50_000), (20, 0, "a", "b"), (21, 0, "ab", ""), (22, 0, "", "ab"), (-3, 1, "u", "neg"), (-21, 1, "u", "neg")]
    rows += [(40, t, "u", "long way " * (t % 3)) for t in range(100)] + [(41, t, "u", "long way " * (t % 3)) for t in range(0, 100)]
    rows += [(10**18, 0, "u", "far"), (-(10**18), 0, "u", "far")]
    df = frame(spark, rows)
    assert result(q.trie(df)) == plain(rows)
    assert result(q.trie(df.where("conv_id = 21"))) == plain([r for r in rows if r[0] == 21])
    assert q.trie(df.limit(0)).count() == 0
    renamed = df.withColumnRenamed("conv_id", "c.id").withColumnRenamed("text", "words")
    assert result(q.trie(renamed, conv_id="c.id", text="words")) == plain(rows)


def test_a_third_of_all_turns_in_one_conversation_is_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(q, "CELL_BITS", 4)
    rows = [(7, t, "u", str(t % 5)) for t in range(400)] + [(8, t, "u", str(t % 5)) for t in range(300)] + [(c, 0, "u", "hi") for c in range(100, 400)]
    sequence, convs = q.rebuilt(q.turns(frame(spark, rows)))
    paths = q.prefixes(sequence)
    assert paths.count() == sequence.count() and paths.where("last").count() <= convs.count()
    assert paths.where("conv_id = 7").agg(F.max("i")).first()[0] >= 397
    assert result(q.nodes(paths, convs)) == plain(rows)
