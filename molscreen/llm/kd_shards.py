"""K-d tree partitioning of documents into shards of near equal bytes.

Items are groups of equal texts with their bytes.  Each level takes, for every node at once,
the dimension in which the node is widest, orders its items along it with distributed prefix
sums of bytes, and cuts at the weighted median, until every node is one shard.  Equal texts
stay together unless their group lies across a cut and weighs more than ``SPLIT_ABOVE`` of its
node; then it is divided by a hash of the document id.  Only DataFrame functions are used.

Defined cases: a null text weighs one byte and equals the empty text; null metadata is a value
of its own; identical rows are never divided, as nothing tells them apart; fewer documents than
shards leave shards empty; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molscreen.llm.common import hash63, quoted, ranked
from molscreen.operators.running import running_sum
from molscreen.session import materialise

SHARDS = 16
SPLIT_ABOVE = 0.02
UNITS = 1 << 20
GROUP = ["text_hash", "text_crc32", "size"]


def weigh(docs: DataFrame, metadata: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored (doc_id, size, text_crc32, text_hash, unit, m0, m1, ...): one narrow row per document."""
    body = F.coalesce(quoted(text), F.lit(""))
    unit = F.pmod(F.xxhash64(F.lit(6), quoted(doc_id)), F.lit(UNITS))
    marks = [hash63(F.lit(m), quoted(m).cast("string")).alias(f"m{i}") for i, m in enumerate(metadata)]
    cols = [quoted(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32")]
    return materialise(docs.select(*cols, hash63(body).alias("text_hash"), unit.alias("unit"), *marks), "weights")


def shards_for(total_bytes: int, target_bytes: int) -> int:
    """Shards so that a leaf holds about the target."""
    return max(1, math.ceil(total_bytes / target_bytes))


def _items(rows: DataFrame, n_meta: int, shards: int) -> DataFrame:
    """One row per group of equal texts: its bytes, its place in each dimension, and the root as node."""
    marks = [F.min(f"m{i}").alias(f"m{i}") for i in range(n_meta)]
    groups = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *marks)
    # sizes on a log scale, categories by hash: all dimensions run from 0 to 1
    dims = [F.least(F.log2("size") / 40, F.lit(0.999999)).alias("x0")]
    dims += [(F.col(f"m{i}") / float(1 << 63)).alias(f"x{i + 1}") for i in range(n_meta)]
    return groups.select(
        *GROUP, "n", "bytes", *dims, F.lit(0).alias("node"), F.lit(shards).alias("leaves"), F.lit(0).cast("bigint").alias("lo"), F.lit(UNITS).cast("bigint").alias("hi")
    )


def _split(items: DataFrame, n_dims: int) -> DataFrame:
    """Every node with more than one shard cut in two at the weighted median of its widest dimension."""
    open_ = items.where("leaves > 1")
    spans = [(F.max(f"x{i}") - F.min(f"x{i}")).alias(f"w{i}") for i in range(n_dims)]
    nodes = open_.groupBy("node").agg(F.sum("bytes").alias("whole"), *spans)
    # adaptive execution broadcasts these few rows by their measured size
    widest = F.greatest(*[F.col(f"w{i}") for i in range(n_dims)]) if n_dims > 1 else F.col("w0")
    pick = F.coalesce(*[F.when(F.col(f"w{i}") == widest, F.col(f"x{i}")) for i in range(n_dims)])
    # place along the dimension, then the text: equal texts stay next to each other
    place = F.shiftleft(F.floor(pick * (1 << 20)).cast("bigint"), 43).bitwiseOR(F.shiftright("text_hash", 20))
    placed = open_.join(nodes, "node").withColumn("place", place).drop(*[f"w{i}" for i in range(n_dims)])
    sums = running_sum(placed, "place", {"bytes": "upto"}, by=["node"], ties=[*GROUP, "lo"])
    left = F.floor(F.col("leaves") / 2).cast("int")
    cut = F.col("whole") * left / F.col("leaves")
    before = F.col("upto") - F.col("bytes")
    across = (before < cut) & (cut < F.col("upto")) & (F.col("bytes") > SPLIT_ABOVE * F.col("whole")) & (F.col("n") > 1)
    share = F.when(across, (cut - before) / F.col("bytes")).when(before + F.col("bytes") / 2 <= cut, F.lit(1.0)).otherwise(F.lit(0.0))
    at = F.round(F.col("lo") + F.col("_share") * (F.col("hi") - F.col("lo"))).cast("bigint")
    part = F.round(F.col("bytes") * F.col("_share")).cast("bigint")
    sides = F.array(
        F.struct(F.col("node").alias("node"), left.alias("leaves"), F.col("lo").alias("lo"), at.alias("hi"), part.alias("bytes")),
        F.struct(
            (F.col("node") + left).alias("node"), (F.col("leaves") - left).alias("leaves"), at.alias("lo"), F.col("hi").alias("hi"), (F.col("bytes") - part).alias("bytes")
        ),
    )
    keep = [*GROUP, "n", *[f"x{i}" for i in range(n_dims)]]
    each = sums.withColumn("_share", share).select(*keep, F.explode(sides).alias("s")).where("s.lo < s.hi")
    done = each.select(*keep, "s.node", "s.leaves", "s.lo", "s.hi", "s.bytes")
    return done.unionByName(items.where("leaves <= 1").select(*done.columns))


def tree(rows: DataFrame, n_meta: int, shards: int) -> DataFrame:
    """Stored items with their shard in ``node`` and their interval [lo, hi) of document units."""
    items = materialise(_items(rows, n_meta, shards), "items")
    for level in range(max(0, math.ceil(math.log2(shards)))):
        items = materialise(_split(items, n_meta + 1), f"level{level}")
    return items


def shard(docs: DataFrame, shards: int = SHARDS, metadata: tuple[str, ...] = ("lang", "source"), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every document."""
    names = [m for m in metadata if m in docs.columns]
    rows = weigh(docs, names, doc_id, text)
    leaves = tree(rows, len(names), shards).select(*[F.col(c).alias(f"_{c}") for c in GROUP], F.col("node").alias("shard"), "lo", "hi")
    same = [F.col(c) == F.col(f"_{c}") for c in GROUP]
    inside = (F.col("unit") >= F.col("lo")) & (F.col("unit") < F.col("hi"))
    found = rows.join(leaves, same + [inside]).select("doc_id", "size", "text_crc32", "shard", hash63(F.lit(66), "doc_id", "text_hash").alias("_order"))
    stored = materialise(found, "shards")
    return ranked(stored, stored.count(), ["shard"], "_order", ["doc_id", "text_crc32", "size"], "slot").drop("_order")


def query(spark, sf_dir: str) -> DataFrame:
    got = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
