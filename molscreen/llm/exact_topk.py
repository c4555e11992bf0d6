"""Exact top-k by integer inner product: columnar branch-and-bound.

Components become ``floor(1024 * x)``.  Candidates lie in blocks in vertical layout, one array
per dimension.  For a query the inner products are summed up one block of dimensions after the
other, the dimensions of most mass first.  What the dimensions still to come can add is at most
the product of both vectors' remaining lengths; after every block of dimensions candidates whose
upper bound is below the k-th best score known are dropped and the survivors compacted, so later
dimensions are read for few of them.  No candidate is dropped that could be among the k best,
ties included.

Queries and candidates meet in cells of bounded size; a row's block comes from its place in a
stored table, so equal rows spread over all blocks.  Each cell keeps its k best per query and
the lists are merged.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part,
zero vectors do; only vectors of equal length are compared; a query never finds rows with its
own id, and an id that repeats asks once, with its smallest vector; repeated candidates are
candidates each; ties go to the smaller id; rows without an id take no part; fewer candidates
than k give all; an empty table gives no rows.  Scores are exact for any finite input; one
beyond 64 bits is returned as the nearest 64-bit number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molscreen.llm.common import quoted
from molscreen.session import materialise

K = 10
QUERY_EVERY = 100
SCALE = 1024
#: Components of one side of a cell at most; a task's memory follows from it.
CELL_VALUES = 1 << 21
#: Candidates are dealt to more blocks than memory asks for, of this many rows, for parallel tasks.
TASK_ROWS = 4096
TASK_BLOCKS = 64
#: Dimensions that are summed between two rounds of bounds.
STEP = 16
#: Queries whose first sums are held at a time.
TOGETHER = 64
#: Doubles hold every integer up to this one.
WHOLE = 1 << 53


def quantise(flat: np.ndarray, dims: int) -> np.ndarray:
    """floor(SCALE * x): doubles where inner products of them are exact, else Python integers."""
    top = np.abs(flat).max(initial=0) * SCALE + 1
    if top * top * dims < WHOLE:
        return np.floor(flat * SCALE)
    return np.array([math.floor(x * SCALE) if abs(x) < WHOLE else int(x) * SCALE for x in flat.tolist()], object)


def _first(part: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest, ties to the smaller id."""
    if part.dtype == object:
        return np.array(sorted(range(len(part)), key=lambda i: (-part[i], ids[i]))[:k], np.int64)
    at = np.arange(len(part)) if len(part) <= k else np.flatnonzero(part >= np.partition(part, len(part) - k)[len(part) - k])
    return at[np.lexsort((ids[at], -part[at]))[:k]]


class Block:
    """Candidates in vertical layout, with what each has left after every block of dimensions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, step: int = STEP):
        self.ids, self.dims = ids, vectors.shape[1]
        self.order = np.arange(self.dims)
        self.cuts = [self.dims]
        if vectors.dtype != object:
            self.order = np.argsort(-np.square(vectors).sum(axis=0), kind="stable")
            self.cuts = [*range(step, self.dims, step), self.dims]
        self.columns = np.ascontiguousarray(vectors[:, self.order].T)
        if vectors.dtype != object:
            ends = zip(self.cuts, self.cuts[1:])
            mass = np.stack([*(np.square(self.columns[a:b]).sum(axis=0) for a, b in ends), np.zeros(len(ids))])
            self.left = np.sqrt(np.cumsum(mass[::-1], axis=0)[::-1])
        self.read = 0  # components that were multiplied

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query id, ids, scores) of the k best for every query."""
        queries = queries[:, self.order]
        for start in range(0, len(queries), TOGETHER):
            some = queries[start : start + TOGETHER]
            sums = some[:, : self.cuts[0]] @ self.columns[: self.cuts[0]]
            self.read += sums.size * self.cuts[0]
            for qid, q, part in zip(query_ids[start : start + TOGETHER].tolist(), some, sums):
                alive, part = self._descend(qid, q, part, k)
                pick = _first(part, self.ids[alive], k)
                yield qid, self.ids[alive[pick]], part[pick]

    def _descend(self, qid: int, q: np.ndarray, part: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        alive = np.flatnonzero(self.ids != qid)
        part = part[alive]
        bar = -math.inf
        for b, (done, after) in enumerate(zip(self.cuts, self.cuts[1:])):
            if len(part) > k:
                reach = math.sqrt(np.square(q[done:]).sum()) * self.left[b][alive]
                if b == 0:
                    # the promising few, summed in full, give a first bar
                    n = min(4 * k, len(part))
                    few = np.argpartition(-(part + reach), n - 1)[:n]
                    full = part[few] + q[done:] @ self.columns[done:, alive[few]]
                    self.read += n * (self.dims - done)
                    bar = np.partition(full, n - k)[n - k]
                else:
                    bar = max(bar, np.partition(part - reach, len(part) - k)[len(part) - k])
                # sums are exact, only the lengths are rounded
                keep = np.flatnonzero(part + reach * (1 + 1e-9) + 1 >= bar)
                alive, part = alive[keep], part[keep]
            part = part + q[done:after] @ self.columns[done:after, alive]
            self.read += len(alive) * (after - done)
        return alive, part


def usable(vector: Column) -> Column:
    """Not null, not empty, all components there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(~bad, F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query row."""
    narrow = dict(vectors.dtypes)[vector] == "array<float>"
    v = quoted(vector).cast("array<float>" if narrow else "array<double>")
    rows = vectors.select(quoted(vec_id).cast("bigint").alias("id"), v.alias("v"), is_query.alias("q"))
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull())
    # the place is stored, so a task that runs again deals its rows as before
    rows = materialise(rows.withColumn("d", F.size("v")).withColumn("place", F.monotonically_increasing_id()), "quantised")
    asked = materialise(rows.where("q").groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v")), "asked")
    n, d = rows.agg(F.count(F.lit(1)), F.max("d")).first()
    most = max(1, CELL_VALUES // (d or 1))
    c_blocks = max(1, math.ceil(n / most), min(TASK_BLOCKS, math.ceil(n / TASK_ROWS)))
    q_blocks = max(1, math.ceil(asked.count() / most))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = rows.select("d", deal("place", c_blocks).alias("c"), each(q_blocks).alias("b"), "id", "v", F.lit(0).alias("side"))
    left = asked.select("d", each(c_blocks).alias("c"), deal("id", q_blocks).alias("b"), "id", "v", F.lit(1).alias("side"))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def cell(table: pa.Table) -> pa.Table:
        d = table.column("d")[0].as_py()
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        found = [(np.zeros(0, np.int64),) * 3]
        if 0 < side.sum() < len(side):
            flat = table.column("v").combine_chunks().flatten().to_numpy().astype(float)
            whole = quantise(flat, d).reshape(-1, d)
            block = Block(ids[side == 0], whole[side == 0])
            for qid, got, score in block.best(ids[side == 1], whole[side == 1], k):
                low, high = -(1 << 63), (1 << 63) - 1
                kept = np.array([min(max(int(s), low), high) for s in score.tolist()], np.int64)
                found.append((np.full(len(got), qid), got, kept))
        return pa.table([np.concatenate(c) for c in zip(*found)], schema=schema)

    found = left.unionByName(right).groupBy("d", "c", "b").applyInArrow(cell, "query_id bigint, id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, F.coalesce(F.col("vec_id") % QUERY_EVERY == 0, F.lit(False)))


SQL = """
WITH good AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM good),
asked AS (SELECT vec_id AS query_id, list_transform(min(embedding), lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM good WHERE vec_id % 100 = 0 GROUP BY vec_id),
pairs AS (
  SELECT query_id, vec_id, CAST(list_dot_product(q, v) AS BIGINT) AS score
  FROM asked JOIN whole ON query_id <> vec_id AND len(q) = len(v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
