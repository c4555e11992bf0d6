"""Small awkward tables and plain reference computations."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def awkward(spark):
    """Nulls, empty and long texts, copies, ties, a null id, and columns with clashing names."""
    prose = "the quick brown fox jumps over the lazy dog while the small cat sleeps near an old warm stove all day long"
    rows = [
        (1, prose, "en", "s0"), (2, prose, "en", "s0"), (3, prose + " today", "en", "s1"), (4, None, None, None), (5, "", "en", None),
        (6, " \t\n\x0b\x0c\r", "de", "s1"), (7, "one two three", "de", "s2"), (7, "one two three", "de", "s2"), (7, "other text of the same id", "fr", "s2"),
        (None, "a text without an id but with words enough to be seen by any rule that counts them, which takes twenty words or more", "fr", "s3"),
        (9, "word " * 3000, "en", "s0"), (10, "x" * 20000, "en", "s0"), (11, "Ünïcödé ﬁ 한국어 🙂 " * 30, "es", "s4"), (12, "A\x00B   　 ć", "es", "s4"),
    ]
    rows = [(*r, len(r[1]) if r[1] is not None else None, f"n{i}", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, failed string, score int")


def words(text):
    return WORDS.findall(text or "")


class Sets:
    """Disjoint sets that keep the smallest member as name."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
