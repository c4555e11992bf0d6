"""Near-duplicates by SimHash over an inverted index of byte positions.

A 64-bit fingerprint is eight positional bytes.  Fingerprints that differ in at most ``BITS``
bits differ in at most that many bytes, so a linked pair shares at least ``8 - BITS`` positional
bytes.  The index has a posting list for every combination of that many positions and their
byte values: a pair's tally of shared positional bytes reaches the minimum exactly when the
pair meets in a list.  Lists are verified where they are read, as runs of a sorted stream, and
give a spanning set of links instead of pairs; components are then joined by stars.

A passage that very many texts share makes a list that grows with the corpus.  Such lists are
found on a hash sample of the fingerprints beforehand, and their postings go to finer lists
before the shuffle: the open half is cut into half-bytes, of which a linked pair shares at least
half, too.  A finer list leaves 16 bits open and so holds 65 536 distinct fingerprints at most.
The sample decides where a pair is compared, never whether.

Defined cases: a text without words (null, empty, blanks) has fingerprint zero and links like
any other; equal fingerprints are one node, so copies never meet as pairs; repeated rows get
the same component; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molscreen.llm.common import map_texts, quoted
from molscreen.llm.components import components
from molscreen.session import broadcast_if_small, materialise

WORDS = 4
BITS = 4
SEED = 42
#: Runs above this length are cut by an index of half-bytes before they are compared.
RUN = 1024
CHUNK = 1 << 16
#: Posting lists expected to be longer than this are made finer; the expectation is from one fingerprint in so many.
HOT = 100_000
SAMPLE = 64
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """SimHash of the 4-word shingles' XXH64, all shingles counted."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, CHUNK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], stops[i : i + CHUNK])]
        counts += np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(texts: list[str | None]) -> dict:
    return {"fp": [_signed(fingerprint(t)) for t in texts]}


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(row, fp): signed 64-bit fingerprint of every whole text."""
    return map_texts(docs, _fingerprints, {"fp": "bigint"}, text, keep)


def masks(parts: int, width: int, shared: int) -> list[int]:
    """One mask per combination of ``shared`` of ``parts`` positions, each ``width`` bits wide."""
    unit = (1 << width) - 1
    return [sum(unit << (width * p) for p in combo) for combo in itertools.combinations(range(parts), shared)]


def _near(one: np.uint64, many: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(many ^ one) <= bits


def _sweep(run: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning links of a run: reached fingerprints leave the set that is still compared."""
    links, rest = [], run
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = _near(at, rest, bits)
            if hit.any():
                found = rest[hit]
                links += [(at, f) for f in found]
                queue += list(found)
                rest = rest[~hit]
    return links


def run_links(run: np.ndarray, mask: int, bits: int = BITS) -> list[tuple[int, int]]:
    """Links that connect whatever is connected inside one posting list of distinct fingerprints.

    Long lists are indexed once more, by the half-bytes that the list's own bytes leave open:
    at most ``bits`` of those differ.
    """
    if len(run) <= RUN:
        return _sweep(run, bits)
    open_ = [p for p in range(16) if not mask >> (4 * p) & 15]
    links = []
    for combo in itertools.combinations(open_, max(0, len(open_) - bits)):
        keys = run & np.uint64(sum(15 << (4 * p) for p in combo))
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        for i in np.flatnonzero(np.diff(cuts) > 1):
            links += _sweep(run[order[cuts[i] : cuts[i + 1]]], bits)
    return links


def _pair_links(a: np.ndarray, b: np.ndarray, mask: np.ndarray, shared: int, bits: int) -> np.ndarray:
    """Mask of pairs to retain: enough bits agree, and this list is the pair's first one."""
    diff = a ^ b
    tally = np.zeros(len(a), np.int64)
    first = np.zeros(len(a), np.uint64)
    for p in range(8):
        byte = np.uint64(255 << (8 * p))
        same = (diff & byte) == 0
        first |= np.where(same & (tally < shared), byte, np.uint64(0))
        tally += same
    return (tally >= shared) & (first == mask) & (np.bitwise_count(diff) <= bits)


def postings(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(list, bytes, fp): every distinct fingerprint in each posting list it belongs to."""
    combos = F.array(*[F.lit(_signed(m)) for m in masks(8, 8, 8 - bits)])
    each = prints.select("fp", F.explode(combos).alias("list"))
    return each.select("list", F.col("fp").bitwiseAND(F.col("list")).alias("bytes"), "fp")


def hot_lists(prints: DataFrame, bits: int = BITS, hot: int | None = None) -> DataFrame:
    """(list, bytes) of the posting lists that are long by the sample."""
    some = prints.where(F.pmod(F.xxhash64(F.lit(3), "fp"), F.lit(SAMPLE)) == 0)
    counted = postings(some, bits).groupBy("list", "bytes").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") * SAMPLE > (HOT if hot is None else hot)).select("list", "bytes")


def finer(spark, bits: int = BITS) -> DataFrame:
    """(list, sub): for every list all masks that add half of its open half-bytes; a linked pair agrees in one of them."""
    rows = []
    for mask in masks(8, 8, 8 - bits):
        open_ = [p for p in range(16) if not mask >> (4 * p) & 15]
        rows += [(_signed(mask), _signed(mask | sum(15 << (4 * p) for p in c))) for c in itertools.combinations(open_, max(0, len(open_) - bits))]
    return spark.createDataFrame(rows, "list bigint, sub bigint")


def spread_postings(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """The postings with those of hot lists in their finer lists."""
    every = postings(prints, bits)
    hot = materialise(hot_lists(prints, bits), "hot")
    if hot.isEmpty():
        return every
    known = hot.select(F.col("list").alias("_l"), F.col("bytes").alias("_b"))
    met = every.join(broadcast_if_small(known), (F.col("list") == F.col("_l")) & (F.col("bytes") == F.col("_b")), "left")
    cold = met.where("_l is null").select("list", "bytes", "fp")
    # fixed by the number of bits: 4 900 rows at 4
    fine = met.where("_l is not null").select("list", "fp").join(broadcast_if_small(finer(prints.sparkSession, bits)), "list")
    return cold.unionByName(fine.select(F.col("sub").alias("list"), F.col("fp").bitwiseAND(F.col("sub")).alias("bytes"), "fp"))


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v): verified links among distinct fingerprints ``fp`` that connect every linked pair."""
    shared = 8 - bits
    whole = np.array(masks(8, 8, shared), np.uint64)
    lists = spread_postings(prints, bits).repartition("list", "bytes").sortWithinPartitions("list", "bytes", "fp")

    def run(batches):
        held: list[np.ndarray] = []  # the run that may go on in the next batch

        def finish() -> list[tuple[int, int]]:
            if not held:
                return []
            fps = np.concatenate([h[2] for h in held])
            return run_links(fps, int(held[0][0][0]), bits) if len(fps) > 1 else []

        def out(pairs) -> pa.RecordBatch:
            flat = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, key, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            if held and held[-1][0][-1] == mask[0] and held[-1][1][-1] == key[0]:
                new[0] = False
            starts = np.flatnonzero(new)
            head = starts[0] if len(starts) else len(fp)
            if head:
                held.append((mask[:head], key[:head], fp[:head]))
            if not len(starts):
                continue
            found = finish()
            lengths = np.diff(np.append(starts, len(fp)))
            done = starts[:-1]
            two = done[lengths[:-1] == 2]
            keep = _pair_links(fp[two], fp[two + 1], mask[two], shared, bits)
            # in a finer list the whole list stands for the tally
            keep |= ~np.isin(mask[two], whole) & (np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits)
            for at, n in zip(done[lengths[:-1] > 2], lengths[:-1][lengths[:-1] > 2]):
                found += run_links(fp[at : at + n], int(mask[at]), bits)
            held = [(mask[starts[-1] :], key[starts[-1] :], fp[starts[-1] :])]
            if keep.any():
                yield out(np.stack([fp[two][keep], fp[two + 1][keep]], axis=1))
            if found:
                yield out(found)
        if found := finish():
            yield out(found)

    return lists.mapInArrow(run, "u bigint, v bigint").distinct()


def groups(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Stored (fp, root) for the fingerprints ``fp`` of a stored table; rows without links are their own root."""
    distinct = materialise(prints.select("fp").distinct(), "prints")
    linked = components(links(distinct, bits))
    root = distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return materialise(root, "roots")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = materialise(fingerprints(docs, ["doc_id"]).select("row.doc_id", "fp"), "simhash")
    # copies are summed up before their fingerprints meet
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = groups(prints).withColumnRenamed("fp", "_fp")
    named = least.join(roots, F.col("fp") == F.col("_fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = materialise(named.select("_fp", "root").join(ids, "root").select("_fp", "component_id"), "named")
    out = prints.join(by_print, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
