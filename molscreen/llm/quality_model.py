"""Quality classifier: logistic regression on hashed word n-grams, trained with follow the
regularised leader (proximal, per-coordinate rates), scored as sparse dot products.

Features of a whole text are its word n-grams and the n-grams of its words' shapes (letter case
and symbols, and whether a word repeats its predecessor), hashed into ``DIM`` columns and
weighted by their share among the text's n-grams, plus its length class.  Training takes at
most ``MOST_LABELLED`` labelled documents, those with the smallest hash of the id; they are
dealt to ``SHARDS`` learners whose weights are averaged.  The weights have ``DIM`` entries at
most, whatever the corpus; they are the only thing that goes to every task.

Defined cases: a null text is empty and scores by its length class; labels without a document,
documents without a label and null labels train nothing; a document with several labels trains
with each; without any training row every score is 0.5; repeated rows score alike.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molscreen.llm.common import hash63, map_texts
from molscreen.session import materialise, ship

DIM = 1 << 18
MOST_LABELLED = 20_000
SHARDS = 4
EPOCHS = 12
THRESHOLD = 0.3
#: Follow-the-regularised-leader settings.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.0005, 0.0005

_MIX = np.uint64(0x9E3779B97F4A7C15)
_CLASSES = bytes(
    ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("9") if 48 <= c <= 57 else c if 33 <= c < 127 else 32 for c in range(256)
)


def _shape(word: bytes) -> bytes:
    """Classes of the characters, runs of a class written once."""
    out = bytearray()
    for c in word.translate(_CLASSES):
        if not out or out[-1] != c:
            out.append(c)
    return bytes(out[:8])


class _Words(dict):
    """Word -> (hash of the folded word, hash of its shape)."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 500_000:
            self.clear()
        self[word] = got = (zlib.crc32(word.lower()), zlib.crc32(_shape(word), 1))
        return got


_WORDS = _Words()


def _spread(h: np.ndarray, dim: int) -> np.ndarray:
    h = h * _MIX
    h ^= h >> np.uint64(31)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(20)) % np.uint64(dim)).astype(np.int64)


def columns(text: str | None, dim: int = DIM) -> tuple[np.ndarray, int]:
    """(hashed columns of all n-grams, column of the length class)."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    length = int(_spread(np.array([7_000_000_007 + min(n, 1 << 20).bit_length()], np.uint64), dim)[0])
    if not n:
        return np.zeros(0, np.int64), length
    pairs = np.array([_WORDS[w] for w in words], np.uint64)
    w, s = pairs[:, 0], pairs[:, 1]
    same = np.zeros(n, np.uint64)
    same[1:] = w[1:] == w[:-1]
    s = s * np.uint64(2) + same
    tag = np.uint64(1 << 40)
    grams = [w, s + tag]
    if n > 1:
        grams += [w[:-1] * np.uint64(31) + w[1:] * np.uint64(1_000_003) + tag * np.uint64(2), s[:-1] * np.uint64(131) + s[1:] * np.uint64(7_919) + tag * np.uint64(3)]
    return _spread(np.concatenate(grams), dim), length


def vector(text: str | None, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector: n-gram shares scaled to one, and the length class."""
    grams, length = columns(text, dim)
    index, n = np.unique(grams, return_counts=True)
    value = np.sqrt(n / max(1, len(grams)))
    return np.append(index, length), np.append(value, 0.5)


class Leader:
    """Follow-the-regularised-leader logistic regression over sparse rows."""

    def __init__(self, dim: int = DIM):
        self.z, self.n = np.zeros(dim + 1), np.zeros(dim + 1)
        self.bias = dim

    def weights(self, index: np.ndarray) -> np.ndarray:
        z = self.z[index]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(self.n[index])) / ALPHA + L2)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        index, value = np.append(index, self.bias), np.append(value, 1.0)
        w = self.weights(index)
        g = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ value))))) - label) * value
        n = self.n[index]
        rate = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        np.add.at(self.z, index, g - rate * w)
        np.add.at(self.n, index, g * g)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, text, label): labelled documents outside the held-out fold, ``most`` at the utmost.

    The bound takes the smallest hashes of the id; a label of a repeated id counts for each row.
    """
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label IN (0, 1)")
    chosen = labels.where(~held_out(F.col("doc_id"))).orderBy(hash63("doc_id"), "doc_id", "label").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `most` rows of three numbers


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(rows: DataFrame, shards: int = SHARDS, epochs: int = EPOCHS, dim: int = DIM) -> dict[int, float]:
    """Averaged weights by column; ``dim`` is the bias."""

    def learn(batches):
        seen: list[tuple] = []
        for batch in batches:
            at = {name: batch.column(name).to_pylist() for name in ("order", "label", "text")}
            seen += [(o, y, *vector(t, dim)) for o, y, t in zip(at["order"], at["label"], at["text"])]
        if not seen:
            return
        seen.sort(key=lambda r: (r[0], r[1], len(r[2])))
        leader = Leader(dim)
        for _ in range(epochs):
            for _, label, index, value in seen:
                leader.learn(index, value, label)
        index = np.flatnonzero(leader.n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(index), pa.array(leader.weights(index) * len(seen)), pa.array(np.full(len(index), len(seen)))], ["column", "weight", "rows"]
        )

    order = hash63(F.lit(3), "doc_id", F.crc32(F.coalesce("text", F.lit(""))))
    dealt = rows.select("label", "text", order.alias("order")).withColumn("shard", F.col("order") % shards)
    # a shard is at most 1 / shards of the bounded sample, more if ids repeat
    learned = dealt.repartition(shards, "shard").select("order", "label", "text", "shard")
    each = learned.groupBy("shard").applyInArrow(_grouped(learn), "column bigint, weight double, rows bigint")
    stored = materialise(each, "weights")
    total = stored.where(F.col("column") == dim).agg(F.sum("rows")).first()[0] or 0
    mean = stored.groupBy("column").agg(F.sum("weight").alias("weight")).where("weight <> 0")
    # at most dim + 1 rows
    return {r["column"]: r["weight"] / total for r in mean.collect()} if total else {}


def _grouped(learn):
    def run(table: pa.Table) -> pa.Table:
        schema = pa.schema([("column", pa.int64()), ("weight", pa.float64()), ("rows", pa.int64())])
        return pa.Table.from_batches(list(learn(table.to_batches())), schema)

    return run


def score(docs: DataFrame, weights: dict[int, float], keep: list[str] | None = None, dim: int = DIM) -> DataFrame:
    """(row, score): probability of label 1 for every whole text."""
    dense = np.zeros(dim + 1)
    dense[list(weights)] = list(weights.values())
    shared = docs.sparkSession.sparkContext.broadcast(dense)  # dim + 1 doubles: 2 MB

    def run(texts: list[str | None]) -> dict:
        w = shared.value
        out = []
        for t in texts:
            index, value = vector(t, dim)
            out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, float(w[index] @ value) + w[dim])))))
        return {"score": out}

    return map_texts(docs, run, {"score": "double"}, keep=keep)


def fit(spark, docs: DataFrame, sf_dir: str) -> dict[int, float]:
    return train(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    It learns from the labelled documents of the whole corpus, rejected ones included.
    """
    ship(spark)
    return score(docs, fit(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)).where(F.col("score") >= THRESHOLD).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(spark, docs, sf_dir), keep=["doc_id"])
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", predicted.alias("predicted"))
