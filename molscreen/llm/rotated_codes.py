"""Nearest neighbours by largest inner product with randomly rotated one-bit codes.

Vectors are normalised, rotated by one random orthogonal matrix, and kept as one sign bit per
dimension, packed, with two correction scalars: the norm and the agreement of the code with its
vector.  The inner product of a rotated query with a code, divided by the agreement, estimates
that of the vectors and has a known standard error.  The candidates with the highest upper
bounds are computed exactly, in double precision; of the others only those whose upper bound
reaches the k-th best score found there.  Where these are many, as with few dimensions, one product
in single precision, its rounding allowed for, first rules out what stays below that score.

Candidates are dealt once to blocks of bounded size and encoded there once; the queries stream
past every block, some at a time, so one product of a few queries with all codes of a block
serves them together.  Each block keeps its k best per query and the lists are merged.  Every
row is indexed and no training sample is needed.  There are no coarse lists: on vectors without
clusters, such as those of the test tables, half of all lists must be read for a recall of 0.9.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no
part; only vectors of equal length are compared; a query never finds rows with its own id; a
query id that repeats asks once, with its smallest vector; repeated rows spread over all blocks;
ties go to the smaller id; fewer candidates than k give all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molscreen.llm.common import quoted
from molscreen.session import materialise

K = 20
QUERY_EVERY = 20
#: Standard errors that the bound covers; infinite: every candidate is computed exactly.
SIGMAS = 2.5
#: Queries that meet a block's codes together.
QUERY_BLOCK = 32
#: Where more than one in so many bounds reach the bar, a product with all vectors of the block costs less than to fetch these.
DENSE = 32
#: Pairs that are scored together, about, and components of their vectors.
PAIRS = 1 << 18
EXACT_VALUES = 1 << 19
#: Candidates of a block at most, and their components: a task's memory follows from them.
CANDIDATE_BLOCK = 65_536
BLOCK_VALUES = 1 << 22
#: Candidates are dealt to more blocks than memory asks for, of this many rows, for parallel tasks.
#: Every block gives k rows per query, so blocks are few.
TASK_ROWS = 4096
TASK_BLOCKS = 12
SEED = 7


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """Random orthogonal matrix, the same on every worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, norm, agreement) of the vectors' codes; the code of a unit vector is +-1/sqrt(d)."""
    norm = np.linalg.norm(vectors, axis=1)
    rotated = (vectors / norm[:, None]) @ turn
    bits = rotated > 0
    agreement = np.abs(rotated).sum(axis=1) / math.sqrt(vectors.shape[1])
    return _packed(bits), norm, agreement


def _packed(bits: np.ndarray) -> np.ndarray:
    n, d = bits.shape
    padded = np.zeros((n, -(-d // 64) * 64), bool)
    padded[:, :d] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def signs(codes: np.ndarray, dim: int) -> np.ndarray:
    """Packed codes as rows of -1 and 1."""
    bits = np.unpackbits(codes.view(np.uint8), axis=1, count=dim, bitorder="little")
    return bits.astype(np.float32) * np.float32(2) - np.float32(1)


def corrections(norm: np.ndarray, agreement: np.ndarray, dim: int, sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray]:
    """(factor, margin): factor times the product of a unit query and the signs is the estimate, margin its bound."""
    error = np.sqrt(np.maximum(0.0, 1 - agreement**2) / max(1, dim - 1)) / agreement
    return norm / agreement / math.sqrt(dim), norm * error * sigmas


def estimate(codes: np.ndarray, norm: np.ndarray, agreement: np.ndarray, query: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner product, error bound) of a query, or of each row of queries, with every code."""
    length = np.linalg.norm(query, axis=-1, keepdims=True)
    factor, margin = corrections(norm, agreement, query.shape[-1])
    return ((query / length) @ turn) @ signs(codes, query.shape[-1]).T * factor * length, margin * length


class Block:
    """Candidates of one block with their codes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, sigmas: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        dim = vectors.shape[1]
        self.turn = rotation(dim)
        codes, norm, agreement = encode(self.vectors.astype(np.float64), self.turn)
        factor, margin = corrections(norm, agreement, dim, sigmas)
        # one row per dimension, scaled, and one of margins, so that a product with queries gives the upper bounds
        self.codes = _columns(signs(codes, dim) * factor[:, None].astype(np.float32), margin)
        # the vectors alike, with what rounding can take from their products; no limit where they may overflow
        rounding = norm * (dim + 8) * np.finfo(np.float32).eps + 1e-36
        self.plain = _columns(self.vectors, np.where(norm < 1e30, rounding, np.inf))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query ids, ids, scores) of the block's best k for every query, some queries at a time."""
        space = np.empty((2, min(QUERY_BLOCK, len(queries)), len(self.ids)), np.float32)
        for start in range(0, len(queries), QUERY_BLOCK):
            names, some = query_ids[start : start + QUERY_BLOCK], queries[start : start + QUERY_BLOCK].astype(np.float64)
            length = np.linalg.norm(some, axis=1)
            unit = some / length[:, None]
            upper = _product(unit @ self.turn, self.codes, space[0])
            for row, low, high in zip(upper, np.searchsorted(self.ids, names), np.searchsorted(self.ids, names, "right")):
                row[low:high] = -np.inf
            n = min(4 * k, len(self.ids))
            rows, cols = _entries(upper >= _reached(upper, n)[:, None])
            first = _best(n, rows, -upper[rows, cols])
            rows, cols = rows[first], cols[first]
            score = _exact(self.vectors, cols, some, rows)
            best = _best(k, rows, -score)
            found = np.bincount(rows[best], minlength=len(some))
            kth = np.full(len(some), np.inf)
            kth[found == k] = score[best[np.cumsum(found)[found == k] - 1]]
            bar = (kth / length).astype(np.float32)[:, None]
            rest = upper >= bar
            if DENSE * np.count_nonzero(rest) > rest.size:
                np.greater(rest, _product(unit, self.plain, space[1]) < bar, out=rest)
            part = np.cumsum(np.count_nonzero(rest, axis=1)) // PAIRS
            for low, high in zip(np.searchsorted(part, np.unique(part)), np.searchsorted(part, np.unique(part), "right")):
                more = np.ravel_multi_index(_entries(rest[low:high]), upper.shape) + low * len(self.ids)
                # at least those in hand, whatever rounding does to the bar
                a, z = np.searchsorted(rows, (low, high))
                pick = np.union1d(more, np.ravel_multi_index((rows[a:z], cols[a:z]), upper.shape))
                r, c = np.unravel_index(pick, upper.shape)
                s = _exact(self.vectors, c, some, r)
                best = _best(k, r, -s)
                yield names[r[best]], self.ids[c[best]], s[best]


def _columns(vectors: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One column per vector, float32, with its entry of last below."""
    with np.errstate(over="ignore"):
        return np.vstack([vectors.T.astype(np.float32), last[None].astype(np.float32)])


def _product(queries: np.ndarray, columns: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Products of the queries with all columns, and the columns' last entries added."""
    return np.matmul(_columns(queries, np.ones(len(queries))).T, columns, out=space[: len(queries)])


def _reached(values: np.ndarray, n: int) -> np.ndarray:
    """For each row a finite value that its n largest entries reach, and few others: the n-th largest of maxima over groups."""
    lowest, groups = np.finfo(values.dtype).min, 8 * n
    width = values.shape[1] // groups
    if width < 2:
        return np.full(len(values), lowest)
    tops = values[:, : width * groups].reshape(len(values), width, groups).max(axis=1)
    tops = np.partition(np.where(np.isnan(tops), lowest, tops), groups - n, axis=1)
    return np.maximum(tops[:, groups - n], lowest)


def _entries(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the true entries, of which there are few: eight are looked at together."""
    flat = mask.reshape(-1)
    even = len(flat) // 8 * 8
    at = np.flatnonzero(flat[:even].view(np.uint64))
    at = np.append((at[:, None] * 8 + np.arange(8)).ravel(), np.arange(even, len(flat)))
    return np.divmod(at[flat[at]], mask.shape[1])


def _best(n: int, rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the n least keys of every row, by row and key, earlier places first among equals."""
    order = np.lexsort((key, rows))
    return order[np.arange(len(order)) - np.searchsorted(rows[order], rows[order]) < n]


def _exact(vectors: np.ndarray, pick: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of picked vectors with the queries in rows, each summed by itself, so that equal vectors score equal."""
    step = max(1, EXACT_VALUES // vectors.shape[1])
    parts = [(vectors[pick[i : i + step]] * queries[rows[i : i + step]]).sum(axis=1) for i in range(0, len(pick), step)]
    return np.concatenate([np.empty(0), *parts])


def usable(vector: Column) -> Column:
    """Not null, not empty, finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def neighbours(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", sigmas: float = SIGMAS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for every query row."""
    narrow = dict(vectors.dtypes)[vector] == "array<float>"
    v = quoted(vector).cast("array<float>" if narrow else "array<double>")
    rows = vectors.select(quoted(vec_id).cast("bigint").alias("id"), v.alias("v"), is_query.alias("q"))
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull()).withColumn("d", F.size("v"))
    # the place is stored, so a task that runs again deals its rows as before
    rows = materialise(rows.withColumn("place", F.monotonically_increasing_id()), "vectors")
    n, d = rows.agg(F.count(F.lit(1)), F.max("d")).first()
    most = max(1, min(CANDIDATE_BLOCK, BLOCK_VALUES // (d or 1)))
    blocks = max(1, math.ceil(n / most), min(TASK_BLOCKS, math.ceil(n / TASK_ROWS)))
    deal = F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int")
    mine = rows.select("d", deal.alias("c"), F.lit(0).alias("side"), "id", "v")
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select(F.size("v").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c"), F.lit(1).alias("side"), "id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        now, held, block = None, [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]) if batch.num_rows else ():
                dim, c, side = key[:, a].tolist()
                if (dim, c) != now:
                    now, held, block = (dim, c), [], None
                ids = batch.column("id").slice(a, z - a).to_numpy()
                flat = batch.column("v").slice(a, z - a).flatten().to_numpy().reshape(-1, dim)
                if side == 0:
                    held.append((ids, flat))
                elif held:
                    block = block or Block(*map(np.concatenate, zip(*held)), sigmas)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*block.search(ids, flat, k))], schema=schema)

    # by number, as hashes would put some blocks into one task and leave others empty
    met = mine.unionByName(asked).repartitionById(blocks, "c").sortWithinPartitions("d", "c", "side")
    found = met.mapInArrow(run, "query_id bigint, id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(rows, F.coalesce(F.col("vec_id") % QUERY_EVERY == 0, F.lit(False)))
