import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tests.llm.helpers import awkward
from tokenizers import Tokenizer

from molscreen.llm import packing as q

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [q.END]


def test_words_give_the_text_s_ids(monkeypatch):
    monkeypatch.setattr(q, "REMEMBERED", 50)
    rnd = random.Random(1)
    pool = [chr(c) for c in range(0x20, 0x180)] + list("\n\t́　 \u0085한ᄒσΣς🙂") + ["the ", " 's", "<|endoftext|>", "***", "don't "]
    encoder = q.Encoder(PATH)
    for _ in range(3000):
        t = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == ids(t)[:-1], repr(t)


def check(rows, texts, capacity):
    """Pieces rebuild their documents, and sequences are gapless and full enough."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for doc_id, text in texts:
        got = ids(text)
        for i in range(0, len(got), capacity):
            part = got[i : i + capacity]
            want[(doc_id, i // capacity, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    return len(by_sequence)


def test_plan_is_best_fit():
    rnd = random.Random(4)
    for _ in range(30):
        counts = {rnd.randint(1, 100): rnd.randint(1, 40) for _ in range(rnd.randint(1, 40))}
        fill, seen = {}, Counter()
        for length, rank, n, sequence, fits, offset in q.plan(counts, 100):
            assert rank == seen[length]
            seen[length] += n
            for i in range(n):
                at = sequence + i // fits
                assert fill.get(at, 0) == offset + i % fits * length
                fill[at] = fill.get(at, 0) + length
                assert fill[at] <= 100
        assert seen == Counter(counts)
        # piece by piece: longest first, each to the fullest sequence that takes it
        gaps = []
        for length in sorted(Counter(counts).elements(), reverse=True):
            fitting = [g for g in gaps if g >= length]
            gap = min(fitting) if fitting else 100
            if fitting:
                gaps.remove(gap)
            gaps.append(gap - length)
        assert len(fill) == len(gaps) and sorted(100 - v for v in fill.values()) == sorted(gaps)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = q.packed(docs, capacity=64).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 64)
    assert q.packed(docs.limit(0)).count() == 0
    whole = q.pieces(docs, ["doc_id"], capacity=64, with_ids=True).collect()
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in whole)


def test_sequences_hold_the_tokens_of_every_row(spark):
    docs = awkward(spark)
    docs = docs.unionByName(docs)  # repeated ids, as the mix makes them
    placed = q.packed(docs, capacity=64, with_ids=True)
    check(placed.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 64)
    by_row = {}
    for s in q.sequences(placed).collect():
        tokens = np.frombuffer(bytes(s["ids"]), "<u4").tolist()
        assert len(tokens) == sum(p["length"] for p in s["parts"]) <= 64
        for p in s["parts"]:
            by_row.setdefault((p["row_id"], p["doc_id"]), []).append((p["start"], tokens[p["offset"] : p["offset"] + p["length"]]))
    got = Counter((doc_id, tuple(t for _, part in sorted(parts) for t in part)) for (_, doc_id), parts in by_row.items())
    assert got == Counter((r["doc_id"], tuple(ids(r["text"]))) for r in docs.collect())
    assert q.sequences(q.packed(docs.limit(0), with_ids=True)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = q.query(spark, folder).collect()
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(folder + "/documents.parquet").collect()]
    n = check(rows, texts, q.CAPACITY)
    assert n <= -(-sum(r["length"] for r in rows) // q.CAPACITY) + 1
