"""Best-fit packing of tokenised documents into sequences.

Documents are tokenised where they lie and cut only where they exceed a sequence.  Pieces are
range-sorted by length, so that every piece has a rank within its length.  Packing then runs in
bulk-synchronous rounds, one per length from the longest down.  Pieces of one length, and open
sequences with one gap, are interchangeable, so the state of a round is one count per length
and ranges of sequence ids per gap size: its size depends on the capacity, not on the number of
documents.  A round matches its pieces with the successor gap, the smallest that holds them;
where more pieces want a gap size than it has room for, the lowest ranks win and the others
go on to the next gap size, or open new sequences.  Gaps are updated before the next round.
The result is a table of rank ranges, which every piece looks up.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; ties
in length are ranked by id, then piece; an empty table gives no rows and no sequences.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from molscreen.llm.common import map_texts
from molscreen.llm.ordering import range_sorted
from molscreen.session import materialise, ship

CAPACITY = 4096
END = 1
#: Words whose ids a worker remembers at most, twice over: the recent ones and those before.
REMEMBERED = 400_000
#: The same in the pipeline, whose workers also hold what earlier stages have left.
STAGE_REMEMBERED = 150_000
#: Latin letters that lower-case one by one, then marks that the tokenizer splits off and never joins to letters.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+)([.,;:!?*$#%&|()]*)")


class Encoder:
    """Token ids of whole texts as little-endian bytes.

    The tokenizer never joins across white space, so the ids of a text are those of its
    blank-separated words, and words are remembered.  A new word of plain letters goes to the
    tokenizer's merge model directly, with the byte letters that its own pre-tokenizer makes;
    any other goes through the whole tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.recent: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.letters: dict[str, str] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _letter(self, c: str) -> str:
        if c not in self.letters:
            self.letters[c] = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0]
        return self.letters[c]

    def word(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        if not plain:
            return self._whole(word)
        core, marks = plain.groups()
        core = core.lower()
        if not core.isascii():
            core = "".join(map(self._letter, core))
        if marks not in self.marks:
            self.marks[marks] = self._whole(marks)
        return array("I", [t.id for t in self.model.tokenize(core)]).tobytes() + self.marks[marks]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.recent) > self.remembered:
            self.before, self.recent = self.recent, {}
        words: list[str] = []
        ends = [0]
        for t in texts:
            words += (t or "").replace("\n", " ").split(" ")
            ends.append(len(words))
        got = list(map(self.recent.get, words))
        for i in [i for i, ids in enumerate(got) if ids is None]:
            w = words[i]
            ids = self.recent.get(w)
            if ids is None:
                ids = self.before.get(w)
                self.recent[w] = ids = self.word(w) if ids is None else ids
            got[i] = ids
        return [b"".join(got[a:b]) for a, b in zip(ends, ends[1:])]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    if (path, remembered) not in _ENCODERS:
        _ENCODERS[path, remembered] = Encoder(path, remembered)
    return _ENCODERS[path, remembered]


def pieces(
    docs: DataFrame, keep: list[str], path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, text: str = "text", remembered: int = REMEMBERED
) -> DataFrame:
    """(row, piece, start, length, ids_crc32[, ids]): whole documents, longer ones in ``capacity`` pieces.

    ``ids`` are little-endian unsigned 32-bit numbers; a worker remembers the ids of about
    ``remembered`` words, twice over.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    step = 4 * capacity
    end = np.array([END], "<u4").tobytes()

    def cut(texts: list[str | None]) -> dict:
        out: dict[str, list] = {"lengths": [], "crcs": [], "ids": []}
        for raw in encoder(path, remembered).encode(texts):
            raw += end
            parts = [raw[i : i + step] for i in range(0, len(raw), step)]
            out["lengths"].append([len(p) // 4 for p in parts])
            out["crcs"].append([zlib.crc32(p) for p in parts])
            out["ids"].append(parts)
        return out

    fields = {"lengths": "array<bigint>", "crcs": "array<bigint>"} | ({"ids": "array<binary>"} if with_ids else {})
    got = map_texts(docs, cut, fields, text, keep)
    each = got.select("row", F.posexplode(F.arrays_zip(*fields)).alias("piece", "p"))
    start = (F.col("piece") * capacity).cast("bigint").alias("start")
    return each.select("row", "piece", start, F.col("p.lengths").alias("length"), F.col("p.crcs").alias("ids_crc32"), *([F.col("p.ids").alias("ids")] if with_ids else []))


class Gaps:
    """Ranges of open sequences, by the tokens that are still free in each."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, size: int, first: int, n: int) -> None:
        if size <= 0 or n <= 0:
            return
        if size not in self.ranges:
            bisect.insort(self.sizes, size)
            self.ranges[size] = []
        self.ranges[size].append((first, n))

    def successor(self, length: int) -> int | None:
        at = bisect.bisect_left(self.sizes, length)
        return self.sizes[at] if at < len(self.sizes) else None

    def take(self, size: int, n: int) -> tuple[int, int]:
        """Up to ``n`` neighbouring sequences with this gap."""
        first, have = self.ranges[size].pop()
        used = min(n, have)
        if used < have:
            self.ranges[size].append((first + used, have - used))
        elif not self.ranges[size]:
            del self.ranges[size]
            self.sizes.remove(size)
        return first, used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank, n, sequence, fits, offset): where the ranks of each length go.

    Ranks ``rank .. rank + n - 1`` fill sequences from ``sequence`` on, ``fits`` in each, from
    ``offset`` on.  Equal pieces that fit one gap follow each other into it, as best fit would
    have them.  A move ends a length or uses up a range; a range passes on at most once per
    length that it takes, and lengths differ, so there are at most about
    3 * capacity * sqrt(2 * capacity) moves, whatever the counts.
    """
    gaps, moves, n_sequences = Gaps(), [], 0
    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while n:
            size = gaps.successor(length)
            fits = (size or capacity) // length
            want = -(-n // fits)
            if size is None:
                size, first, got = capacity, n_sequences, want
                n_sequences += want
            else:
                first, got = gaps.take(size, want)
            placed = min(n, got * fits)
            moves.append((length, rank, placed, first, fits, capacity - size))
            full, over = divmod(placed, fits)
            gaps.add(size - fits * length, first, full)
            gaps.add(size - over * length, first + full, got - full)
            rank, n = rank + placed, n - placed
    return moves


def pack(cut: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces of a stored table with ``length``."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    starts, total = [], 0
    for length in sorted(counts):
        starts.append((length, total))
        total += counts[length]
    placed = range_sorted(cut, ["length", *order], total, "place")
    first = spark.createDataFrame(starts, "_length bigint, _start bigint")
    moves = spark.createDataFrame(plan(counts, capacity), "_l bigint, _rank bigint, _n bigint, _sequence bigint, _fits bigint, _offset bigint")
    # both sides are bounded by the capacity, see plan()
    ranked = placed.join(F.broadcast(first), F.col("length") == F.col("_length")).withColumn("_r", F.col("place") - F.col("_start"))
    here = (F.col("length") == F.col("_l")) & (F.col("_r") >= F.col("_rank")) & (F.col("_r") < F.col("_rank") + F.col("_n"))
    done = ranked.join(F.broadcast(moves), here)
    i = F.col("_r") - F.col("_rank")
    sequence = F.col("_sequence") + F.floor(i / F.col("_fits")).cast("bigint")
    offset = F.col("_offset") + i % F.col("_fits") * F.col("length")
    return done.select(*[F.col(c) for c in cut.columns], sequence.alias("sequence_id"), offset.cast("bigint").alias("offset"))


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, remembered: int = REMEMBERED, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, row_id, ids], sequence_id, offset) for all documents.

    ``row_id`` numbers the rows of ``docs``: rows that repeat a doc_id, whole or cut, differ in it,
    and the pieces of one row share it.  ``ids`` are the tokens, little-endian unsigned 32-bit.
    """
    names = ["doc_id", "row_id"] if with_ids else ["doc_id"]
    rows = docs.select("doc_id", "text").withColumn("row_id", F.monotonically_increasing_id()) if with_ids else docs.select("doc_id", "text")
    cut = pieces(rows, names, path, capacity, with_ids, remembered=remembered)
    cut = cut.select("row.doc_id", "piece", "start", "length", "ids_crc32", *(["row.row_id", "ids"] if with_ids else []))
    stored = materialise(cut, "pieces")
    placed = pack(stored.drop("ids"), ["doc_id", "piece", "ids_crc32", *names[1:]], capacity)
    if not with_ids:
        return placed
    # narrow rows are sorted and placed; the tokens move once, to their place
    tokens = stored.select(F.col("row_id").alias("_row"), F.col("piece").alias("_piece"), "ids")
    same = (F.col("row_id") == F.col("_row")) & (F.col("piece") == F.col("_piece"))
    return placed.join(tokens, same).select(*stored.columns, "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, parts) from ``packed`` with its ids: one row per training sequence.

    ``ids`` are the tokens of its pieces in place; ``parts`` tells for each piece, in order, its
    offset, length, doc_id, row_id, piece and start, so that attention can stop at documents.
    A sequence holds at most ``capacity`` pieces.
    """
    part = F.struct("offset", "length", "doc_id", "row_id", "piece", "start", "ids")
    whole = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return whole.select("sequence_id", ids.alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("parts"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all rows with their tokens; ``sequences`` joins them up."""
    ship(spark)
    return packed(docs, remembered=STAGE_REMEMBERED, with_ids=True)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
