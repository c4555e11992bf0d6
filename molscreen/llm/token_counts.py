"""Token counts under a unigram segmentation, by dynamic programming over a trie.

A pre-token is a word with the word mark in front.  Its count is the number of pieces of the
segmentation with the highest sum of piece scores (fewest pieces among equals); a character
that no piece covers costs ``PENALTY`` more than the lowest score and counts as its UTF-8
bytes.  The distinct new pre-tokens of a slice of texts are inserted in a trie, best forward
scores are computed once per trie node, level by level for all nodes at once, and the counts
at the nodes where pre-tokens end are stored and looked up for every occurrence.  Vocabulary
and scores are read from a public file; nothing is trained, and nothing is shuffled.

Defined cases: a null, empty or blank text has no tokens; repeated rows and words count each;
words of any length are handled; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from molscreen.llm.common import map_texts

MARK = "▁"
PENALTY = 10
#: Pre-tokens whose counts a worker remembers at most; beyond it the store starts anew.
REMEMBERED = 1_000_000
#: Words above this length are segmented one by one.
LONG = 64
#: Room for the piece count below the score in one integer.
SCALE = 1 << 16
CHARS = 1 << 21


def read_scores(path: str) -> dict[str, int]:
    """Ordinary pieces with their stored scores (whole numbers); those of word marks alone get the lowest."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = (model.IsByte, model.IsControl, model.IsUnknown, model.IsUnused)
    pieces = {model.IdToPiece(i): int(model.GetScore(i)) for i in range(model.GetPieceSize()) if not any(f(i) for f in skip)}
    least = min(s for p, s in pieces.items() if p.strip(MARK))
    return {p: s if p.strip(MARK) else least - PENALTY for p, s in pieces.items()}


class Unigram:
    """Piece scores, with the pieces' own trie as a sorted table of transitions."""

    def __init__(self, scores: dict[str, int]):
        self.scores = scores
        self.unknown = min(scores.values()) - PENALTY
        self.longest = max(map(len, scores))
        states: dict[str, int] = {"": 0}
        for piece in scores:
            for n in range(1, len(piece) + 1):
                states.setdefault(piece[:n], len(states))
        steps = sorted((states[p[:-1]] * CHARS + ord(p[-1]), s) for p, s in states.items() if p)
        self.keys = np.array([k for k, _ in steps], np.int64)
        self.next = np.array([s for _, s in steps], np.int64)
        self.value = np.zeros(len(states), np.int64)
        self.final = np.zeros(len(states), bool)
        for piece, score in scores.items():
            self.value[states[piece]], self.final[states[piece]] = score * SCALE - 1, True

    def count_one(self, word: str) -> int:
        """Pieces of one word, by the plain recurrence."""
        best = [(0, 0)]
        for end in range(1, len(word) + 1):
            options = []
            for start in range(max(0, end - self.longest), end):
                score = self.scores.get(word[start:end])
                if score is not None:
                    options.append((best[start][0] + score, best[start][1] - 1))
            if word[end - 1] not in self.scores:
                options.append((best[end - 1][0] + self.unknown, best[end - 1][1] - _width(word[end - 1])))
            best.append(max(options))
        return -best[-1][1]

    def count(self, words: list[str]) -> list[int]:
        """Pieces of many distinct words."""
        short = sorted(w for w in words if len(w) <= LONG and w)
        counts = dict(zip(short, self._trie(short))) if short else {}
        return [counts[w] if w in counts else self.count_one(w) for w in words]

    def _trie(self, words: list[str]) -> list[int]:
        """Forward scores of the trie of sorted distinct words; score and count share one integer."""
        chars = np.array(words, f"U{LONG}").view(np.uint32).reshape(len(words), LONG).astype(np.int64)
        length = np.array([len(w) for w in words])
        # characters that a word shares with the word before it
        shared = np.zeros(len(words), np.int64)
        shared[1:] = (np.cumprod(chars[1:] == chars[:-1], axis=1) != 0).sum(axis=1)
        out = np.zeros(len(words), np.int64)
        node = np.zeros(len(words), np.int64)  # of each word, at the depth reached
        # starts of pieces still open at each node: the piece trie's state, and the best score up to the start
        first, many = np.zeros(1, np.int64), np.ones(1, np.int64)
        state, base, best = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        for depth in range(1, int(length.max()) + 1):
            here = np.flatnonzero(length >= depth)
            # a word opens a node where no earlier word with this prefix is as long
            opens = _since(shared, here) < depth
            opens[0] = True
            rows = here[opens]
            parent, char = node[rows], chars[rows, depth - 1]
            n = many[parent]
            child = np.repeat(np.arange(len(rows)), n)
            at = np.repeat(first[parent], n) + np.arange(len(child)) - np.repeat(np.cumsum(n) - n, n)
            key = state[at] * CHARS + char[child]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            live = self.keys[place] == key
            child, moved, from_ = child[live], self.next[place[live]], base[at[live]]
            score = np.full(len(rows), np.iinfo(np.int64).min)
            ends = self.final[moved]
            np.maximum.at(score, child[ends], from_[ends] + self.value[moved[ends]])
            alone = np.searchsorted(self.keys, char)
            alone = np.minimum(alone, len(self.keys) - 1)
            covered = (self.keys[alone] == char) & self.final[self.next[alone]]
            bytes_ = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
            score = np.where(covered, score, np.maximum(score, best[parent] + self.unknown * SCALE - bytes_))
            # every node also opens a piece that starts behind it
            child = np.concatenate([child, np.arange(len(rows))])
            order = np.argsort(child, kind="stable")
            state = np.concatenate([moved, np.zeros(len(rows), np.int64)])[order]
            base = np.concatenate([from_, score])[order]
            many = np.bincount(child, minlength=len(rows))
            first = np.cumsum(many) - many
            best = score
            node[here] = np.cumsum(opens) - 1
            done = here[length[here] == depth]
            out[done] = -score[node[done]] % SCALE
        return out.tolist()


def _since(shared: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Least shared prefix between each word of ``here`` and the one before it in ``here``."""
    bounds = np.concatenate([[0], here[:-1] + 1])
    return np.minimum.reduceat(shared[: here[-1] + 1], bounds)


def _width(char: str) -> int:
    return len(char.encode("utf-8", "surrogatepass"))


_MODELS: dict[str, tuple[Unigram, dict[str, int]]] = {}


def _model(path: str) -> tuple[Unigram, dict[str, int]]:
    if path not in _MODELS:
        _MODELS[path] = Unigram(read_scores(path)), {}
    return _MODELS[path]


def token_counts(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, text: str = "text") -> DataFrame:
    """(row, n_pretokens, n_tokens) for every whole text."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(texts: list[str | None]) -> dict:
        model, known = _model(path)
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        new = list({w for words in split for w in words if w not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({w for words in split for w in words})
        known.update(zip(new, model.count([MARK + w.decode("utf-8", "surrogatepass") for w in new])))
        return {"n_pretokens": [len(w) for w in split], "n_tokens": [sum(map(known.__getitem__, w)) for w in split]}

    return map_texts(docs, run, {"n_pretokens": "bigint", "n_tokens": "bigint"}, text, keep)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, keep=["doc_id"]).select("row.doc_id", "n_pretokens", "n_tokens")
