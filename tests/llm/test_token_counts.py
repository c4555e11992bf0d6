"""Trie counts against the plain recurrence and against the tokenizer library."""

import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from molscreen.llm import token_counts as t

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", "th", "ing", "on", "é", "ß", "的", "한", "Ａ", "🙂", "***", "1", "\x85", "▁", "ño", "'s", "."]


@pytest.fixture(scope="module")
def model():
    return t.Unigram(t.read_scores(PATH))


def words(n, seed):
    rnd = random.Random(seed)
    return sorted({t.MARK + "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 12))) for _ in range(n)})


def _varint(b, i):
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if b[i - 1] < 128:
            return value, i


def _fields(b, i, end):
    while i < end:
        key, i = _varint(b, i)
        at = i
        value, i = _varint(b, i) if key & 7 in (0, 2) else (0, i + (4 if key & 7 == 5 else 8))
        yield key >> 3, at, i, value
        i += value if key & 7 == 2 else 0


def as_unigram(path, lowest):
    """The same vocabulary and scores as a unigram model of the library, word marks alone scored as ours."""
    b = bytearray(open(path, "rb").read())
    for field, _, at, size in list(_fields(b, 0, len(b))):
        for f, start, _, _ in list(_fields(b, at, at + size)) if field in (1, 2) else []:
            if field == 1 and f == 2 and struct.unpack_from("<f", b, start)[0] < -1e8:
                struct.pack_into("<f", b, start, lowest)
            if field == 2 and f == 3:
                b[start] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(b))


def test_trie_equals_plain_recurrence(model):
    some = words(3000, 1) + [t.MARK + "x" * 300, t.MARK + "ab" * 31]
    assert model.count(some) == [model.count_one(w) for w in some]


def test_scores_reach_the_library_s_best(model):
    library = as_unigram(PATH, min(model.scores.values()))
    for w in words(2000, 2):
        if len(w) == 1 or t.MARK in w[1:]:
            continue
        pieces = library.EncodeAsPieces(w[1:])
        plain = [p for p in pieces if not p.startswith("<0x")]
        got = model.count_one(w)
        assert got <= len(pieces)
        if len(plain) == len(pieces):
            best = sum(model.scores[p] for p in pieces)
            # fewer pieces only at the same sum
            assert got == len(pieces) or best == max(_sums(model, w))


def _sums(model, w):
    best = [0]
    for end in range(1, len(w) + 1):
        best.append(max([best[s] + model.scores[w[s:end]] for s in range(end) if w[s:end] in model.scores] or [float("-inf")]))
    return [best[-1]]


def test_cases(spark):
    rows = [(1, "the end\n the", "x"), (2, None, "x"), (3, "", "x"), (4, " \t\x0b", "x"), (1, "the end\n the", "x"), (5, "a" * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = {(r["row"]["doc_id"], r["n_pretokens"]): (r["n_tokens"], r["row"]["n_tokens"]) for r in t.token_counts(df).collect()}
    assert got[(2, 0)] == got[(3, 0)] == got[(4, 0)] == (0, "x")
    assert got[(1, 3)][0] >= 3 and got[(5, 1)][0] > 100
    assert t.token_counts(df.limit(0)).count() == 0


def test_query_equals_plain_recurrence(spark):
    model = t.Unigram(t.read_scores(PATH))
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(folder + "/documents.parquet").collect()}
    known = {}
    for r in t.query(spark, folder).collect():
        ws = [w.decode() for w in texts[r["doc_id"]].encode().split()]
        for w in ws:
            if w not in known:
                known[w] = model.count_one(t.MARK + w)
        assert (r["n_pretokens"], r["n_tokens"]) == (len(ws), sum(known[w] for w in ws))
