"""Prefix trie of conversations, built as z-fast tries over hashed prefixes.

A turn is the digest of its role and text; a prefix is the sum of its turns' digests, each mixed
with its place, so prefixes of any conversation come from distributed prefix sums and texts never
move.  Every task inserts its conversations in batches into a z-fast trie: compacted nodes are
hashed by their handle, the prefix whose length is the two-fattest number of the node's edge; the
exit node of a conversation is found by fat binary search over handles, then its edge is split
where the conversation leaves it.  A full batch is expanded, edge by edge, to one row per prefix
with the number of conversations below it, and the rows of all batches meet by prefix digest.  A
prefix that a third of all conversations share is thus one row per batch before the shuffle.

Sums over subtrees follow paths: the nodes with one smallest member form a vertical path, a path
hangs from a node of another one, the tree of paths is summed by pointer doubling, and inside a
path sums run from the deepest node upwards.

Defined cases: rows without a conversation id belong to none; null roles and texts are empty;
turns of a conversation with equal turn numbers (null first) are ordered by the digest of role
and text, repeated rows are turns each; a conversation without turns ends at the root; an empty
table has no conversation and so no node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molscreen.llm.common import quoted
from molscreen.llm.mixing import n_words
from molscreen.llm.ordering import range_sorted
from molscreen.operators.running import running_sum
from molscreen.session import materialise

#: Conversations c of one base c - c % FAMILY share its first turns.
FAMILY = 20
SHARED = 4
#: Turns that a batch's trie holds at most.
BATCH_TURNS = 200_000
#: Turns of one conversation that are summed up in one window partition: 2 to this power.
CELL_BITS = 14
#: Bytes of joined ids per row while ids gather for their digest.
CHUNK_BYTES = 4096
LIMB = 0xFFFFFFFF


def turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Stored (conv_id, n_turns, start, at, _part, digest, words): the order of all turns by narrow rows."""
    said, who = (F.coalesce(quoted(c), F.lit("")) for c in (text, role))
    digest = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)))
    narrow = rows.select(quoted(conv_id).cast("bigint").alias("conv_id"), quoted(turn).alias("turn"), digest.alias("digest"), n_words(said).alias("words"))
    # the row number is stored, so equal rows keep their order
    narrow = materialise(narrow.where("conv_id is not null").withColumn("row", F.monotonically_increasing_id()), "turns")
    placed = materialise(range_sorted(narrow, ["conv_id", "turn", "digest", "row"], narrow.count(), "at").drop("turn", "row"), "placed")
    # a long conversation lies in many parts, none of which is large
    parts = placed.groupBy("conv_id", "_part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("conv_id")
    spans = parts.select(F.col("conv_id").alias("_c"), F.col("_part").alias("_p"), F.min("low").over(whole).alias("start"), F.sum("n").over(whole).alias("n_turns"))
    joined = placed.join(spans, (F.col("conv_id") == F.col("_c")) & (F.col("_part") == F.col("_p"))).drop("_c", "_p")
    return materialise(joined.withColumn("pos", F.col("at") - F.col("start")).drop("at", "start"), "ordered")


def rebuilt(ordered: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """((conv_id, i, digest, words), (conv_id)): the first h turns of the base conversation, then the own ones after h."""
    h = lambda c: F.crc32(c.cast("string")) % shared
    base = lambda c: c - c % family
    sizes = ordered.groupBy("conv_id", "_part").agg(F.max("n_turns").alias("n_turns"))
    convs = sizes.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"))
    bases = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_base"), F.col("n_turns").alias("_n"))
    head = F.least(h(F.col("conv_id")), F.coalesce("_n", F.lit(0)))
    parts = sizes.join(bases, base(F.col("conv_id")) == F.col("_base"), "left").select(F.col("conv_id").alias("_c"), F.col("_part").alias("_p"), head.alias("head"))
    own = ordered.where(F.col("pos") >= h(F.col("conv_id"))).join(parts, (F.col("conv_id") == F.col("_c")) & (F.col("_part") == F.col("_p")))
    own = own.select("conv_id", (F.col("head") + F.col("pos") - h(F.col("conv_id")) + 1).alias("i"), "digest", "words")
    first = ordered.where((F.col("pos") < shared) & (F.col("conv_id") % family == 0))
    first = first.select(F.col("conv_id").alias("_base"), "pos", "digest", "words")
    taken = convs.join(first, (base(F.col("conv_id")) == F.col("_base")) & (F.col("pos") < h(F.col("conv_id"))))
    return taken.select("conv_id", (F.col("pos") + 1).alias("i"), "digest", "words").unionByName(own), convs.select("conv_id")


def prefixes(rows: DataFrame) -> DataFrame:
    """Stored (conv_id, i, a, b, pa, pb, words, last): 128-bit digests of every prefix and of the one before it."""
    mixed = rows
    for k in range(2):
        both = F.xxhash64(F.lit(k), "i", "digest")
        mixed = mixed.withColumn(f"l{2 * k}", F.shiftrightunsigned(both, 32)).withColumn(f"l{2 * k + 1}", both.bitwiseAND(LIMB))
    mixed = materialise(mixed.drop("digest").withColumn("one", F.lit(1).cast("bigint")), "limbs")
    values = {f"l{k}": f"p{k}" for k in range(4)} | {"one": "seen"}
    summed = running_sum(mixed, "i", values, by=["conv_id"], bucket=F.shiftright("i", CELL_BITS))
    limb = lambda c: c.bitwiseAND(LIMB)
    pair = lambda x, y: F.shiftleft(limb(x), 32).bitwiseOR(limb(y))
    p, before = [F.col(f"p{k}") for k in range(4)], [F.col(f"p{k}") - F.col(f"l{k}") for k in range(4)]
    names = {"a": pair(p[0], p[1]), "b": pair(p[2], p[3]), "pa": pair(before[0], before[1]), "pb": pair(before[2], before[3])}
    last = (F.col("i") == F.col("seen_total")).alias("last")
    return materialise(summed.select("conv_id", "i", *[c.alias(n) for n, c in names.items()], "words", last), "prefixes")


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] with most trailing zero bits."""
    return high & -1 << (low ^ high).bit_length() - 1


class Path:
    """Prefix digests of consecutive turns, from the one before the first; indexed by depth."""

    __slots__ = ("start", "end", "digests", "words")

    def __init__(self, start: int, digests: list, words: list):
        self.start, self.end, self.digests, self.words = start, start + len(words), digests, words

    def __getitem__(self, depth: int):
        return self.digests[depth - self.start]


class Node:
    """A compacted node: the edge (top, depth] along a path, and the conversations that end or lie below it."""

    __slots__ = ("top", "depth", "path", "parent", "children", "n", "least")

    def __init__(self, top: int, depth: int, path: Path, parent: Node | None):
        self.top, self.depth, self.path, self.parent = top, depth, path, parent
        self.children: dict = {}
        self.n, self.least = 0, None

    def count(self, n: int, least: int | None) -> None:
        self.n += n
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    @property
    def handle(self):
        return self.path[two_fattest(self.top, self.depth)]


class ZFastTrie:
    """Dynamic z-fast trie over paths with a common start."""

    def __init__(self, path: Path):
        self.root = Node(path.start, path.start, path, None)
        self.handles: dict = {}
        self.nodes: list[Node] = []

    def locate(self, path: Path) -> Node:
        """The deepest node whose handle is a prefix of the path, by fat binary search."""
        low, high, found = path.start, path.end, self.root
        while low < high:
            f = two_fattest(low, high)
            node = self.handles.get(path[f])
            if node is None:
                high = f - 1
            else:
                found, low = node, node.depth
        return found

    def _add(self, node: Node) -> Node:
        self.handles[node.handle] = node
        self.nodes.append(node)
        return node

    def _split(self, node: Node, at: int) -> Node:
        """New node at depth ``at`` of the node's edge."""
        del self.handles[node.handle]
        upper = Node(node.top, at, node.path, node.parent)
        node.parent.children[node.path[node.top + 1]] = upper
        upper.children[node.path[at + 1]] = node
        node.top, node.parent = at, upper
        self.handles[node.handle] = node
        return self._add(upper)

    def insert(self, path: Path, name: int) -> None:
        node = self.locate(path)
        if node.depth < path.end and node.path[node.depth] == path[node.depth]:
            child = node.children.get(path[node.depth + 1])
            if child is None:
                return self._leaf(node, path, name)
            node = child
        # the path leaves the edge of this node: the last depth where they agree
        low, high = node.top, min(node.depth, path.end)
        while low < high:
            middle = (low + high + 1) // 2
            if node.path[middle] == path[middle]:
                low = middle
            else:
                high = middle - 1
        if low < node.depth:
            node = self._split(node, low)
        if low == path.end:
            node.count(1, name)
        else:
            self._leaf(node, path, name)

    def _leaf(self, parent: Node, path: Path, name: int) -> None:
        leaf = self._add(Node(parent.depth, path.end, path, parent))
        parent.children[path[parent.depth + 1]] = leaf
        leaf.count(1, name)

    def expand(self):
        """(digest, parent's digest, depth, words, conversations, smallest of them) for every prefix."""
        for node in sorted(self.nodes, key=lambda n: -n.depth):
            node.parent.count(node.n, node.least)
            for d in range(node.top + 1, node.depth + 1):
                yield (*node.path[d], *node.path[d - 1], d, node.path.words[d - 1 - node.path.start], node.n, node.least)


FIELDS = "a bigint, b bigint, pa bigint, pb bigint, depth bigint, words bigint, n bigint, least bigint"


def _batches(stream):
    """Conversations of a task in batches, each through a z-fast trie (one per starting prefix)."""
    schema = pa.schema([(f.split()[0], pa.int64()) for f in FIELDS.split(", ")])
    tries: dict = {}
    held = 0

    def out():
        rows = [row for trie in tries.values() for row in trie.expand()]
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 50_000])], schema=schema)

    for batch in stream:
        conv, i, a, b, above_a, above_b, words = (batch.column(c).to_pylist() for c in range(7))
        cuts = [k for k in range(len(conv)) if k == 0 or conv[k] != conv[k - 1] or i[k] != i[k - 1] + 1] + [len(conv)]
        for x, y in zip(cuts, cuts[1:]):
            # consecutive turns of one conversation, as far as they are here
            top = (above_a[x], above_b[x])
            path = Path(i[x] - 1, [top, *zip(a[x:y], b[x:y])], words[x:y])
            if top not in tries:
                tries[top] = ZFastTrie(path)
            tries[top].insert(path, conv[x])
            held += y - x
            if held >= BATCH_TURNS:
                yield from out()
                tries, held = {}, 0
    yield from out()


def id_digests(ends: DataFrame) -> DataFrame:
    """(a, b, sha): SHA-256 of the comma-joined ascending ids of every (a, b).

    Sorted ids are joined to chunks where they lie, so the one task that has to read a node's
    ids in order reads a few hundred at a time, as a stream.
    """
    ordered = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")

    def chunks(stream):
        for batch in stream:
            a, b, ids = (batch.column(c).to_pylist() for c in range(3))
            rows, now, held, size = [], None, [], 0
            for key in zip(a, b, ids):
                if key[:2] != now or size >= CHUNK_BYTES:
                    rows += [(*now, held[0], ",".join(map(str, held)))] if held else []
                    now, held, size = key[:2], [], 0
                held.append(key[2])
                size += len(str(key[2])) + 1
            rows += [(*now, held[0], ",".join(map(str, held)))] if held else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["a", "b", "first", "ids"])

    joined = ordered.select("a", "b", "conv_id").mapInArrow(chunks, "a bigint, b bigint, first bigint, ids string")

    def digests(stream):
        now, sha = None, None
        for batch in stream:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if key == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now:
                    done.append((*now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["a", "b", "sha"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], ["a", "b", "sha"])

    return joined.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digests, "a bigint, b bigint, sha string")


def _path_sums(paths: DataFrame, values: list[str]) -> DataFrame:
    """Stored (name, *values): each path's values with those of all paths below it, by pointer doubling."""
    now = materialise(paths.select("name", "up", *values), "paths")
    while not now.where("up is not null").isEmpty():
        pushed = now.where("up is not null").groupBy(F.col("up").alias("_to")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        ahead = now.where("up is not null").select(F.col("name").alias("_at"), F.col("up").alias("_next"))
        summed = now.join(pushed, F.col("name") == F.col("_to"), "left").join(ahead, F.col("up") == F.col("_at"), "left")
        more = [(F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0))).alias(v) for v in values]
        now = materialise(summed.select("name", F.col("_next").alias("up"), *more), "paths")
    return now.drop("up")


def _keyed(df: DataFrame, a: str = "a", b: str = "b") -> Column:
    return (F.col("a") == df[a]) & (F.col("b") == df[b])


def trie(rows: DataFrame, family: int = FAMILY, shared: int = SHARED, **names: str) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations."""
    sequence, convs = rebuilt(turns(rows, **names), family, shared)
    return nodes(prefixes(sequence), convs)


def nodes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes from a stored table of prefixes and the ids of all conversations."""
    local = paths.select("conv_id", "i", "a", "b", "pa", "pb", "words").mapInArrow(_batches, FIELDS)
    merged = local.groupBy("a", "b").agg(
        *[F.max(c).alias(c) for c in ("pa", "pb", "depth", "words")], F.sum("n").alias("n"), F.min("least").alias("least")
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    top = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).where("n > 0")
    top = top.select(zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), zero.alias("depth"), zero.alias("words"), "n", "least")
    stored = materialise(merged.unionByName(top), "nodes")
    below = stored.where("depth > 0").groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children")).select(F.col("pa").alias("_a"), F.col("pb").alias("_b"), "n_children")
    known = stored.join(below, _keyed(below, "_a", "_b"), "left").drop("_a", "_b").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = known.withColumn("leaves", (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n") - 1) * F.col("words"))
    known = materialise(known, "known")
    # paths of nodes with one smallest member, and the node that each hangs from
    tops = known.groupBy("least").agg(F.min_by(F.struct("a", "b", "pa", "pb"), "depth").alias("t"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    parents = known.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("least").alias("up"))
    tops = tops.join(parents, (F.col("t.pa") == F.col("_a")) & (F.col("t.pb") == F.col("_b")), "left")
    tops = materialise(tops.select(F.col("least").alias("name"), "up", "t.*", "leaves", "saved"), "tops")
    totals = _path_sums(tops, ["leaves", "saved"]).select(F.col("name").alias("_name"), *[F.col(c).alias(f"all_{c}") for c in ("leaves", "saved")])
    hung = tops.where("up is not null").join(totals, F.col("name") == F.col("_name")).groupBy(F.col("pa").alias("_a"), F.col("pb").alias("_b"))
    hung = hung.agg(F.sum("all_leaves").alias("more_leaves"), F.sum("all_saved").alias("more_saved"))
    heads = tops.where("up is not null").select(F.col("a").alias("_ta"), F.col("b").alias("_tb"), "up")
    ends = paths.where("last").select("a", "b", "conv_id")
    turnless = convs.join(ends.select(F.col("conv_id").alias("_c")), F.col("conv_id") == F.col("_c"), "left_anti").select(zero.alias("a"), zero.alias("b"), "conv_id")
    digests = id_digests(ends.unionByName(turnless)).select(F.col("a").alias("_da"), F.col("b").alias("_db"), "sha")
    full = known.join(hung, _keyed(hung, "_a", "_b"), "left").join(heads, _keyed(heads, "_ta", "_tb"), "left").join(digests, _keyed(digests, "_da", "_db"), "left")
    added = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
    full = full.select("least", "depth", F.when(F.col("depth") > 0, F.coalesce("up", "least")).alias("parent_conv_id"), "n", "n_children", *added, "sha")
    cell = F.shiftright("depth", CELL_BITS)
    done = running_sum(materialise(full, "full"), "depth", {"leaves": "n_leaves", "saved": "saved_tokens"}, by=["least"], bucket=cell, ascending=False)
    sha = F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return done.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", sha)


def query(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos FROM said),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
        lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT)) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
parts AS (
  SELECT c.conv_id, 0 AS part, pos, digest, words FROM convs c JOIN own o ON o.conv_id = c.base AND pos < h
  UNION ALL SELECT o.conv_id, 1, pos, digest, words FROM own o JOIN convs c ON o.conv_id = c.conv_id AND pos >= h),
rebuilt AS (SELECT conv_id, words, digest, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM parts),
chains AS (SELECT conv_id, depth, words, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM rebuilt),
prefixes AS (SELECT * FROM chains UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
linked AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1 AS last FROM prefixes),
nodes AS (
  SELECT node, depth, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
    sha256(coalesce(string_agg(CASE WHEN last THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM linked GROUP BY node, depth),
children AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)),
sums AS (
  SELECT p.node, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, sum(k.saved) AS saved_tokens
  FROM known k JOIN prefixes p ON p.conv_id = k.conv_id AND p.depth <= k.depth GROUP BY p.node)
SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM known k JOIN sums s USING (node) LEFT JOIN known u ON u.node = k.above
"""
