"""Fingerprint similarity against a reference set.

A molecule's similarity to the set is the mean of its best ``n`` Tanimoto values, so
every reference counts and a fixed cut-off would change answers.  Two exact plans:

* a reference set below ``BROADCAST_REFS`` is sent to every task as one packed matrix and
  the queries stream past it, with no shuffle at all;
* a larger one lies in bands of popcounts.  Every query starts at its own band and goes
  outward, in rounds; what it has kept so far bounds the bands that can still matter, and a
  query whose next bands cannot beat its n-th best score is finished.  Queries and references
  of a band meet in cells of bounded size; no other cell is built.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molscreen.functions import bits as B
from molscreen.schemas import DOMAIN_NEIGHBOURS, FP_BITS
from molscreen.session import materialise, opaque, work_partitions

BROADCAST_REFS = 100_000  # rows that are sent to every task at most
BROADCAST_BYTES = 32 << 20  # and their size: rows times the widest word list
BAND = 16  # popcounts that share a reference band
BLOCK_ROWS = 20_000
MOST_BLOCKS = 32, 8  # query and reference blocks of a band, as long as a block is small enough to be broadcast
_CELLS = 2_000_000  # pairs held at once while scoring
_TILE = 1 << 18  # pairs whose shared bits are counted at once: they stay in the cache


def _matrix(words: pa.Array) -> np.ndarray:
    """Flat word list column as a (rows, words) matrix of unsigned words."""
    flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return flat.reshape(len(words), -1) if len(words) else flat.reshape(0, 1)


class Packed:
    """A reference block sorted by popcount, so that bounds cut contiguous ranges."""

    def __init__(self, ids: pa.Array, words: np.ndarray):
        counts = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        order = np.argsort(counts, kind="stable")
        self.ids = ids.take(pa.array(order))
        self.words, self.counts = np.ascontiguousarray(words[order].T), counts[order]
        self.id_rank = np.argsort(np.argsort(self.ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")

    def stretches(self, width: int, low: int, high: int) -> list[tuple[float, int, int]]:
        """(bound, from, to) of reference ranges, best bound first, for query popcounts low..high."""
        out = []
        for lo in range(0, len(self.counts), width):
            hi = min(lo + width, len(self.counts))
            first, last = self.counts[lo], self.counts[hi - 1]
            bound = high / first if first > high else last / low if last < low else 1.0
            out.append((bound, lo, hi))
        return sorted(out, key=lambda s: -s[0])


def _shared(q: np.ndarray, ref: Packed, lo: int, hi: int) -> np.ndarray:
    """Shared bits of every pair, in the narrowest type that holds them."""
    words = q.shape[1]
    kind = np.uint8 if words < 4 else np.uint16 if words < 1024 else np.int64
    out = np.empty((len(q), hi - lo), kind)
    step = max(1, _TILE // max(1, hi - lo))
    for at in range(0, len(q), step):
        tile = out[at : at + step]
        tile[:] = np.bitwise_count(q[at : at + step, :1] & ref.words[0, lo:hi])
        for w in range(1, words):
            tile += np.bitwise_count(q[at : at + step, w : w + 1] & ref.words[w, lo:hi])
    return out


def _ratio(shared: np.ndarray, q_counts: np.ndarray, ref_counts: np.ndarray) -> np.ndarray:
    shared = shared.astype(np.int64)
    union = q_counts + ref_counts - shared
    return np.divide(shared, union, out=np.zeros(shared.shape), where=union > 0)


def _scores(q: np.ndarray, q_counts: np.ndarray, ref: Packed, lo: int, hi: int) -> np.ndarray:
    return _ratio(_shared(q, ref, lo, hi), q_counts[:, None], ref.counts[lo:hi])


def _need(c: int, ref_counts: np.ndarray, threshold: float) -> np.ndarray:
    """Fewest shared bits that reach ``threshold``, by the same division as the score's; counts are not 0."""
    need = np.maximum(np.floor(threshold * (c + ref_counts) / (1 + threshold)).astype(np.int64) - 1, 0)
    while (short := _ratio(need, c, ref_counts) < threshold).any():
        need += short
    return need


def _chunks(q: np.ndarray, ref: Packed) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Query rows in popcount order, with the reference ranges to visit for each chunk."""
    counts = np.bitwise_count(q).sum(axis=1, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    step = max(1, min(256, _CELLS // max(1, min(len(ref.counts), 4096))))
    for at in range(0, len(q), step):
        rows = order[at : at + step]
        yield rows, counts[rows], ref.stretches(_CELLS // step, counts[rows[0]], counts[rows[-1]])


def _best(q: np.ndarray, ref: Packed, n: int, floor: np.ndarray | None = None) -> np.ndarray:
    """Best ``n`` scores per query, descending, padded with -1.

    A reference range is skipped once its popcount bound cannot beat the worst kept score
    of any query in the chunk, or ``floor``, what the queries have kept elsewhere.
    """
    out = np.full((len(q), n), -1.0)
    floor = np.full(len(q), -1.0) if floor is None else floor
    for rows, counts, stretches in _chunks(q, ref):
        kept = np.full((len(rows), n), -1.0)
        for bound, lo, hi in stretches:
            if bound <= np.maximum(kept[:, -1], floor[rows]).min():
                break
            worst = np.maximum(kept[:, -1], floor[rows])
            if worst.min() < 0:
                # nothing to hold scores against yet: a few references first
                head = min(hi, lo + 64 * n)
                both = np.concatenate([kept, _scores(q[rows], counts, ref, lo, head)], axis=1)
                top = np.partition(both, both.shape[1] - n, axis=1)[:, -n:]
                kept, lo = -np.sort(-top, axis=1), head
                worst = np.maximum(kept[:, -1], floor[rows])
            if lo < hi:
                kept = _improved(kept, worst, q[rows], counts, ref, lo, hi)
        out[rows] = kept
    return out


def _improved(kept: np.ndarray, worst: np.ndarray, q: np.ndarray, q_counts: np.ndarray, ref: Packed, lo: int, hi: int) -> np.ndarray:
    """``kept`` with the scores of a reference range that can beat ``worst``; only those are divided."""
    sizes, first = np.unique(ref.counts[lo:hi], return_index=True)
    # s / (a + b - s) > w means s > (a + b) * w / (1 + w); a little less covers the rounding
    need = np.ceil((q_counts[:, None] + sizes) * (worst / (1 + worst))[:, None] - 1e-6).clip(0)
    shared = _shared(q, ref, lo, hi)
    wide = np.repeat(need.astype(shared.dtype), np.diff(np.append(first, hi - lo)), axis=1)
    i, j = np.divmod(np.flatnonzero(shared >= wide), hi - lo)
    score = _ratio(shared[i, j], q_counts[i], ref.counts[lo + j])
    better = score > worst[i]
    if not better.any():
        return kept
    n = kept.shape[1]
    row = np.concatenate([np.repeat(np.arange(len(kept)), n), i[better]])
    value = np.concatenate([kept.ravel(), score[better]])
    order = np.lexsort((-value, row))
    start = np.searchsorted(row[order], np.arange(len(kept)))
    return value[order][start[:, None] + np.arange(n)]


def _closest(q: np.ndarray, ref: Packed, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index and score of the best reference per query; ties go to the lowest id."""
    where, score = np.full(len(q), -1), np.full(len(q), -1.0)
    floor = np.full(len(q), -1.0) if floor is None else floor
    for rows, counts, stretches in _chunks(q, ref):
        rank = np.full(len(rows), len(ref.counts))
        for bound, lo, hi in stretches:
            if bound < np.maximum(score[rows], floor[rows]).min():
                break
            s = _scores(q[rows], counts, ref, lo, hi)
            top = s.max(axis=1)
            tied = np.where(s == top[:, None], ref.id_rank[lo:hi], len(ref.counts))
            at = tied.argmin(axis=1)
            low = tied[np.arange(len(rows)), at]
            win = (top > score[rows]) | ((top == score[rows]) & (low < rank))
            where[rows[win]], score[rows[win]], rank[win] = at[win] + lo, top[win], low[win]
    return where, score


def _matches(q: np.ndarray, ref: Packed, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, reference row, score) of every pair at or over ``threshold``, some ``_CELLS`` pairs compared at a time."""
    counts = np.bitwise_count(q).sum(axis=1, dtype=np.int64)
    for c in np.unique(counts):
        rows = np.flatnonzero(counts == c)
        # same division as the score itself, so that the boundary rounds alike
        bound = np.divide(
            np.minimum(ref.counts, c), np.maximum(ref.counts, c), out=np.zeros(len(ref.counts)),
            where=np.maximum(ref.counts, c) > 0,
        )
        able = np.flatnonzero(bound >= threshold)
        if not len(able):
            continue
        lo, hi = able[0], able[-1] + 1
        need = None
        step = max(1, _CELLS // (hi - lo))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            shared = _shared(q[part], ref, lo, hi)
            need = _need(c, ref.counts[lo:hi], threshold).astype(shared.dtype) if need is None else need
            i, j = np.divmod(np.flatnonzero(shared >= need), hi - lo)
            if len(i):
                yield part[i], j + lo, _ratio(shared[i, j], c, ref.counts[lo + j])


def small_enough(refs: DataFrame, bound: int = BROADCAST_REFS) -> bool:
    """Whether the reference set is small in rows and in bytes; reads no more than ``bound`` rows."""
    width = [F.size(c) for c, t in refs.dtypes if t.startswith("array")] or [F.lit(1)]
    head = refs.select(sum(width[1:], width[0]).alias("w")).limit(bound + 1)
    rows, widest = head.agg(F.count(F.lit(1)), F.max("w")).first()
    return rows <= bound and rows * (16 + 8 * max(widest or 0, 0)) <= BROADCAST_BYTES


def _packed_broadcast(refs: DataFrame, ref_id: str, words: str):
    table = refs.select(F.col(ref_id).alias("id"), F.col(words).alias("w")).toArrow()
    packed = Packed(table["id"].combine_chunks(), _matrix(table["w"].combine_chunks()))
    return refs.sparkSession.sparkContext.broadcast(packed)


def _with_band(refs: DataFrame) -> DataFrame:
    return refs.withColumn("_band", F.floor(B.popcount(F.col("w")) / BAND).cast("int"))


def _band_counts(df: DataFrame) -> dict[int, int]:
    """Rows per band, at most bits / BAND of them."""
    return {row["_band"]: row["n"] for row in df.groupBy("_band").agg(F.count(F.lit(1)).alias("n")).collect()}


def _ints(values) -> Column:
    items = ", ".join(map(str, values))
    return F.expr(f"array({items})") if items else F.array().cast("array<int>")


def _blocks(rows: int, block_rows: int, most: int) -> int:
    """Blocks of a band: of ``block_rows`` each, but no more than ``most`` until they are as large as a broadcast set."""
    return max(1, min(math.ceil(rows / block_rows), most), math.ceil(rows / max(block_rows, BROADCAST_REFS)))


def _met(visits: DataFrame, asked: dict, refs: DataFrame, counts: dict, block_rows: int) -> DataFrame:
    """Queries and references of a band in the cells where they meet, cut by hash; ``rid`` is null for queries.

    A row is in at most as many cells of a band as the other side has blocks, so that copies do
    not grow with the rows.
    """

    def parts(sizes: dict, most: int) -> Column:
        table = ", ".join(f"{b}, {_blocks(sizes.get(b, 0), block_rows, most)}" for b in counts) or "0, 1"
        return F.element_at(F.expr(f"map({table})"), F.col("_band"))

    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows, columns = parts(asked, MOST_BLOCKS[0]), parts(counts, MOST_BLOCKS[1])
    left = visits.withColumn("_i", F.pmod(F.xxhash64("qid", "w"), rows).cast("int")).withColumn("_j", spread(columns))
    wanted = refs.where(F.col("_band").isin([b for b in asked])) if len(asked) < len(counts) else refs
    right = wanted.withColumn("_j", F.pmod(F.xxhash64("rid", "w"), columns).cast("int")).withColumn("_i", spread(rows))
    return left.withColumn("_ref", F.lit(False)).unionByName(right.withColumn("_ref", F.lit(True)), allowMissingColumns=True)


def _cells(visits: DataFrame, asked: dict, refs: DataFrame, counts: dict, block_rows: int, score: Callable, schema: str) -> DataFrame:
    """``score`` in every cell where queries and references of one band meet."""
    key = ["_band", "_i", "_j"]
    met = _met(visits, asked, refs, counts, block_rows)
    # a fixed count: adaptive execution merges by bytes, and a cell costs the product of its sides
    return met.repartition(work_partitions(refs.sparkSession), *key).groupBy(*key).applyInArrow(_cell(score), schema)


def _banded(queries: DataFrame, refs: DataFrame, threshold: float, score: Callable, schema: str, block_rows: int) -> DataFrame:
    """Cells of queries and references whose popcounts allow ``threshold``; no other cell is built.

    A query with p bits visits the bands from p * threshold to p / threshold.
    """
    r = _with_band(refs)
    p = B.popcount(F.col("w"))
    # one band more on each side covers the rounding of the quotients
    low = F.greatest(F.floor(p * threshold / BAND).cast("int") - 1, F.lit(0))
    high = F.ceil(p / threshold / BAND).cast("int") + 1
    counts = _band_counts(r)
    visits = queries.withColumn("_band", F.explode(F.filter(_ints(sorted(counts)), lambda b: (b >= low) & (b <= high))))
    return _cells(visits, _band_counts(visits), r, counts, block_rows, score, schema)


def _outward(queries: DataFrame, refs: DataFrame, n: int, score: Callable, schema: str, block_rows: int) -> tuple[DataFrame, int]:
    """((qid, kept), number of references): the best ``n`` (s, rid) of every query, from bands visited outward from its own.

    Each round visits twice as many bands as the one before, on both sides, as far as their bound
    reaches the n-th best score that the query carries.  Bounds fall outward, so a query without a
    band to visit is finished and leaves the rounds.  A band whose bound is 0 holds scores of 0
    only and is never visited.
    """
    r = materialise(_with_band(refs), "bands")
    counts = _band_counts(r)
    if not counts:
        return queries.select("qid", F.array().cast(f"array<struct<less:double,rid:{_type(refs, 'rid')}>>").alias("kept")), 0
    p = B.popcount(F.col("w"))
    nothing = F.array().cast(f"array<struct<less:double,rid:{_type(refs, 'rid')}>>")
    open_ = queries.select("qid", "w", p.alias("p"), F.floor(p / BAND).cast("int").alias("own"), nothing.alias("kept"), F.lit(-1.0).alias("floor"))
    open_ = materialise(open_, "open")
    finished, reach, width = [], 0, 1
    while True:
        own, low = F.col("own"), F.col("floor")
        edge, top = F.lit(BAND), F.lit(BAND - 1)

        def bound(b: Column) -> Column:
            return F.when(b > own, F.try_divide(F.col("p").cast("double"), b * edge)).when(b < own, F.try_divide((b * edge + top).cast("double"), F.col("p"))).otherwise(1.0)

        def due(b: Column) -> Column:
            away = F.abs(b - own)
            return (away >= reach) & (away < reach + width) & (F.col("p") > 0) & (bound(b) >= low)

        marked = open_.withColumn("_visit", F.filter(_ints(sorted(counts)), due))
        # whoever has bands left further out stays open even if none of this round's bands holds a reference
        more = (F.col("p") > 0) & F.exists(_ints(sorted(counts)), lambda b: (F.abs(b - own) >= reach) & (bound(b) >= low))
        finished.append(marked.where(~more).select("qid", "kept"))
        going = marked.where(more)
        visits = going.select("qid", "w", "floor", F.explode("_visit").alias("_band"))
        asked = _band_counts(visits)
        if not asked:
            if going.isEmpty():
                break
            # the nearest band with references lies further out
            open_, reach, width = going.drop("_visit"), reach + width, 2 * width
            continue
        found = _cells(visits, asked, r, counts, block_rows, score, schema)
        order = Window.partitionBy("qid").orderBy("less", "rid")
        tall = found.select("qid", (-F.col("s")).alias("less"), "rid").unionByName(going.select("qid", F.inline("kept")))
        best = tall.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
        merged = best.groupBy(F.col("qid").alias("_q")).agg(F.sort_array(F.collect_list(F.struct("less", "rid"))).alias("_kept"))
        after = going.select("qid", "w", "p", "own").join(merged, F.col("qid").eqNullSafe(F.col("_q")), "left").drop("_q")
        kept = F.coalesce("_kept", nothing)
        floor = F.when(F.size(kept) >= n, -F.element_at(kept, n)["less"]).otherwise(-1.0)
        open_ = materialise(after.select("qid", "w", "p", "own", kept.alias("kept"), floor.alias("floor")), "open")
        reach, width = reach + width, 2 * width
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out, sum(counts.values())


def _cell(score: Callable[[pa.Array, np.ndarray, Packed, np.ndarray], Iterable[pa.RecordBatch]]):
    """``score`` for the rows of a cell; what it gives leaves piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        a, b = rows.filter(pc.invert(rows["_ref"])), rows.filter(rows["_ref"])
        del rows
        if not (a.num_rows and b.num_rows):
            return
        ref = Packed(b["rid"].combine_chunks(), _matrix(b["w"].combine_chunks()))
        floor = a["floor"].to_numpy() if "floor" in a.column_names else np.full(a.num_rows, -1.0)
        yield from score(a["qid"].combine_chunks(), _matrix(a["w"].combine_chunks()), ref, floor)

    return run


def _sides(queries: DataFrame, refs: DataFrame, names: dict) -> tuple[DataFrame, DataFrame]:
    query_id, ref_id, words = (names.get(k, k) for k in ("query_id", "ref_id", "words"))
    return queries.select(F.col(query_id).alias("qid"), F.col(words).alias("w")), refs.select(F.col(ref_id).alias("rid"), F.col(words).alias("w"))


def _streamed(q: DataFrame, refs: DataFrame, score: Callable, schema: str) -> DataFrame:
    """``score`` for every query against the whole set, which every task gets."""
    shared = _packed_broadcast(refs, "rid", "w")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from score(b.column("qid"), _matrix(b.column("w")), shared.value, np.full(b.num_rows, -1.0))

    return q.mapInArrow(stream, schema)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def nearest(
    queries: DataFrame,
    refs: DataFrame,
    n: int = DOMAIN_NEIGHBOURS,
    bound: int = BROADCAST_REFS,
    block_rows: int = BLOCK_ROWS,
    **names,
) -> DataFrame:
    """(query_id, best): the best ``n`` Tanimoto scores of every query, descending."""
    query_id = names.get("query_id", "query_id")
    q, r = _sides(queries, refs, names)
    kind = _type(q, "qid")
    if small_enough(refs, bound):

        def lists(ids, q, ref, floor) -> list[pa.RecordBatch]:
            best = pa.array([row[row >= 0] for row in _best(q, ref, n)], pa.list_(pa.float64()))
            return [pa.RecordBatch.from_arrays([ids, best], ["qid", "best"])]

        return _streamed(q, r, lists, f"qid {kind}, best array<double>").withColumnRenamed("qid", query_id)

    def tall(ids, q, ref, floor) -> list[pa.RecordBatch]:
        best = _best(q, ref, n, floor)
        i, j = np.nonzero(best >= 0)
        none = pa.nulls(len(i), ref.ids.type)
        return [pa.RecordBatch.from_arrays([ids.take(pa.array(i)), pa.array(best[i, j]), none], ["qid", "s", "rid"])]

    kept, total = _outward(q, r, n, tall, f"qid {kind}, s double, rid {_type(r, 'rid')}", block_rows)
    scores = F.transform("kept", lambda k: -k["less"])
    # what was never visited scores 0
    padded = F.concat(scores, F.array_repeat(F.lit(0.0), F.greatest(F.lit(min(n, total)) - F.size(scores), F.lit(0))))
    return kept.select(F.col("qid").alias(query_id), padded.alias("best"))


def nearest_named(
    queries: DataFrame, refs: DataFrame, bound: int = BROADCAST_REFS, block_rows: int = BLOCK_ROWS, **names
) -> DataFrame:
    """(query_id, ref_id, similarity) of the closest reference; ties go to the lowest id."""
    query_id, ref_id = names.get("query_id", "query_id"), names.get("ref_id", "ref_id")
    q, r = _sides(queries, refs, names)

    def score(ids, q, ref, floor) -> list[pa.RecordBatch]:
        where, best = _closest(q, ref, floor)
        hit = np.flatnonzero(where >= 0)
        cols = [ids.take(pa.array(hit)), pa.array(best[hit]), ref.ids.take(pa.array(where[hit]))]
        return [pa.RecordBatch.from_arrays(cols, ["qid", "s", "rid"])]

    schema = f"qid {_type(q, 'qid')}, s double, rid {_type(r, 'rid')}"
    if small_enough(refs, bound):
        found = _streamed(q, r, score, schema)
        return found.select(F.col("qid").alias(query_id), F.col("rid").alias(ref_id), F.col("s").alias("similarity"))
    kept, _ = _outward(q, r, 1, score, schema, block_rows)
    # an empty query scores 0 against every reference: the lowest id of all
    lowest = r.agg(F.min("rid").alias("_lowest")).where("_lowest is not null")
    first = F.get("kept", F.lit(0))
    named = kept.crossJoin(F.broadcast(lowest))  # one row
    return named.select(
        F.col("qid").alias(query_id), F.coalesce(first["rid"], "_lowest").alias(ref_id), F.coalesce(-first["less"], F.lit(0.0)).alias("similarity")
    )


def similarity_column(refs: DataFrame, words: str = "words", n: int = DOMAIN_NEIGHBOURS, ref_id: str = "ref_id") -> Column:
    """Mean of the best ``n`` similarities as a column, for a reference set below the bound.

    Null words give null.  Larger sets need :func:`assess`, which joins its result back.
    """
    if not small_enough(refs):
        raise ValueError(f"more than {BROADCAST_REFS} references: use assess() instead")
    shared = _packed_broadcast(refs, ref_id, words)

    def run(column: pa.Array) -> pa.Array:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        best = _best(_matrix(column.drop_null()), shared.value, n)
        found = best >= 0
        mean = np.where(found, best, 0.0).sum(axis=1) / np.maximum(found.sum(axis=1), 1)
        out = np.full(len(column), np.nan)
        out[valid] = mean
        return pa.array(out, pa.float64(), mask=~valid)

    return opaque(run, "double")(F.col(words))


def mean_top_n(best: DataFrame, name: str = "similarity") -> DataFrame:
    """Mean over the neighbours found (not over ``n``); no neighbour gives 0."""
    total = F.aggregate("best", F.lit(0.0), lambda acc, s: acc + s)
    return best.withColumn(name, F.coalesce(F.try_divide(total, F.size("best")), F.lit(0.0)))


def assess(queries: DataFrame, refs: DataFrame, n: int = DOMAIN_NEIGHBOURS, **names) -> DataFrame:
    """(query_id, similarity, status): applicability domain of every query."""
    scored = mean_top_n(nearest(queries, refs, n, **names))
    return scored.withColumn("status", B.classify(F.col("similarity"))).drop("best")


def matches(
    queries: DataFrame,
    refs: DataFrame,
    threshold: float,
    bound: int = BROADCAST_REFS,
    block_rows: int = BLOCK_ROWS,
    **names,
) -> DataFrame:
    """(query_id, ref_id, similarity) of every pair at or over ``threshold``.

    Pairs whose popcounts already rule them out are never compared, and only pairs over
    the threshold leave a task.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive: at 0 every pair matches")
    query_id, ref_id = names.get("query_id", "query_id"), names.get("ref_id", "ref_id")
    q, r = _sides(queries, refs, names)

    def score(ids, q, ref, floor) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for i, j, s in chain([none], _matches(q, ref, threshold)):
            cols = [ids.take(pa.array(i)), ref.ids.take(pa.array(j)), pa.array(s)]
            yield pa.RecordBatch.from_arrays(cols, ["qid", "rid", "similarity"])

    schema = f"qid {_type(q, 'qid')}, rid {_type(r, 'rid')}, similarity double"
    if small_enough(refs, bound):
        found = _streamed(q, r, score, schema)
    else:
        found = _banded(q, r, threshold, score, schema, block_rows)
    return found.select(F.col("qid").alias(query_id), F.col("rid").alias(ref_id), "similarity")


def sign_words(vector: str) -> Column:
    """Sign bits of a numeric array as words: bit i of the set is on when value i > 0."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / 64).cast("int")),
        lambda w: F.aggregate(
            F.slice(F.col(vector), w * 64 + 1, F.lit(64)),
            F.struct(F.lit(0).cast("bigint").alias("word"), F.lit(0).alias("i")),
            lambda acc, v: F.struct(
                acc["word"].bitwiseOR(
                    F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), acc["i"])).otherwise(
                        F.lit(0).cast("bigint")
                    )
                ).alias("word"),
                (acc["i"] + 1).alias("i"),
            ),
            lambda acc: acc["word"],
        ),
    )


def _word_bits(texts: pa.Array) -> pa.Array:
    """2048 bits per text, one set by the digest of each word; texts without words are null."""
    words = pc.split_pattern_regex(texts, r"[\x20\x09-\x0D]+")
    each = words.flatten().dictionary_encode()
    # an empty piece lies before a leading or after a trailing blank
    bit = np.array([int.from_bytes(md5(w.encode()).digest()[:3], "big") % FP_BITS if w else -1 for w in each.dictionary.to_pylist()], np.int64)
    bits, of = bit[each.indices.to_numpy()], pc.list_parent_indices(words).to_numpy()
    there = np.zeros((len(texts), FP_BITS), bool)
    there[of[bits >= 0], bits[bits >= 0]] = True
    packed = np.packbits(there, axis=1, bitorder="little").view("<i8")
    rows = pa.FixedSizeListArray.from_arrays(pa.array(packed.ravel()), FP_BITS // 64).cast(pa.list_(pa.int64()))
    return pc.if_else(pa.array(there.any(axis=1)), rows, pa.scalar(None, rows.type))


def word_bits(text: str) -> Column:
    """Hashed words ``[^\\x20\\x09-\\x0D]+`` of whole texts folded to 2048 bits; null for texts without words."""

    def run(texts: pa.Array) -> pa.Array:
        # some texts at a time, so that the bits of a batch are never held unpacked at once
        return pa.concat_arrays([_word_bits(texts.slice(at, 1000)) for at in range(0, max(len(texts), 1), 1000)])

    return opaque(run, "array<bigint>")(F.col(text))


def domain_breakdown(statuses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of the three domain statuses."""
    s = F.col("status")
    return statuses.groupBy(*(by or [])).agg(
        F.count_if(s == "in_domain").alias("in_domain"),
        F.count_if(s == "low_confidence").alias("low_confidence"),
        F.count_if(s == "out_of_domain").alias("out_of_domain"),
    )
