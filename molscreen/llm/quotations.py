"""Quotation linking: nested quotes found, matched to the messages they quote, and threads ordered.

Quoted lines carry one ``>`` per level.  Runs of lines of one level are passages; a message's
own passages are its body.  Normalised passages are hashed and joined to an index of bodies,
those that are no whole body to the runs of words that bodies hold: first within the
conversation, then over all, always to the earliest message with that text, if it precedes the
quoting one.  The first level-1 quote that finds its message
names the parent; ancestors are found by pointer doubling.  Only DataFrame functions are used.

Messages are known by (conv_id, turn) and precede each other by (turn, conv_id), so a parent
always precedes its replies.

Defined cases: a null text is empty; an empty passage links to nothing; a message without
linked quotes starts a thread; messages without conv_id or turn stay alone at depth 0; rows
that repeat (conv_id, turn) are one message to those who quote it, and keep their own bodies;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molscreen.llm.ordering import range_sorted
from molscreen.session import materialise

MARKS = r"^(?:[ \t]?>)+"
#: The line before a quote that says who wrote it.
ATTRIBUTION = r"^On .* wrote:$"
#: Shorter partial quotes are found only as whole lines.
RUN_WORDS = 5
#: Passages of so many words are looked up by that many first words, not by ``RUN_WORDS``.
LONG_RUN = 8


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def levels(text: Column) -> Column:
    """Array of (level, text): the lines, marks removed, attribution lines left out."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(ATTRIBUTION))
    return F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS + "[ ]?", "").alias("text")))


def _starts(lines: Column) -> Column:
    """Places, from 1, of the lines whose level differs from the line before."""
    n = F.size(lines)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 1) | (F.get(lines, i - 1)["level"] != F.get(lines, i - 2)["level"]))


def normal(text: Column) -> Column:
    """Case and white space folded."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def digest(text: Column) -> Column:
    """MD5 of the normalised text; null where nothing is left."""
    return F.when(normal(text) != "", F.md5(normal(text)))


def parse(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) with ``parts``, an array of (level, text), and ``body``."""
    split = messages.select("conv_id", "turn", "role", levels(F.col("text")).alias("_lines"))
    starts = split.withColumn("_starts", _starts(F.col("_lines")))
    # where a run ends: before the next start
    ends = F.concat(F.slice("_starts", F.lit(2), F.greatest(F.size("_starts") - 1, F.lit(0))), F.array(F.size("_lines") + 1))
    run = lambda a, b: F.struct(
        F.get("_lines", a - 1)["level"].alias("level"),
        F.array_join(F.transform(F.slice("_lines", a, b - a), lambda x: x["text"]), "\n").alias("text"),
    )
    parts = F.when(F.size("_starts") > 0, F.zip_with("_starts", ends, run)).otherwise(F.array().cast("array<struct<level:int,text:string>>"))
    with_parts = starts.withColumn("parts", parts).drop("_lines", "_starts")
    own = F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["text"])
    return with_parts.withColumn("body", F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", ""))


def index(parsed: DataFrame) -> DataFrame:
    """(hash, conv_id, turn) of the bodies, once per message."""
    each = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(digest(F.col("body")).alias("hash"), "conv_id", "turn")
    return each.where("hash IS NOT NULL")


def _lines(text: Column) -> Column:
    """The lines in which something is left, normalised."""
    return F.filter(F.transform(F.split(text, "\n"), normal), lambda x: x != "")


def _words(lines: Column) -> Column:
    return F.filter(F.split(F.array_join(lines, " "), " "), lambda w: w != "")


def _runs(text: Column) -> Column:
    """Array of (choice, words): the passage, then the passage without its first or last word or both.

    A word at an edge may be cut or stand for what was left out; ``RUN_WORDS`` words must be left.
    """
    words = _words(_lines(text))
    n = F.size(words)
    cuts = [(1, n), (2, n - 1), (1, n - 1), (2, n - 2)]
    runs = [F.struct(F.lit(i).alias("choice"), F.slice(words, F.lit(start), F.greatest(many, F.lit(0))).alias("words")) for i, (start, many) in enumerate(cuts)]
    return F.filter(F.array(*runs), lambda r: (r["choice"] == 0) | (F.size(r["words"]) >= RUN_WORDS))


def partial_links(parsed: DataFrame, quotes: DataFrame) -> DataFrame:
    """(conv_id, turn, raw, to): the message that holds a run of words, for ``quotes`` (conv_id, turn, raw, text).

    A passage is found by its first words, and holds when all its words follow each other in
    the body, wherever lines break; one of fewer than ``RUN_WORDS`` words must be whole lines.
    Places in bodies meet first words and lengths, not passages, so that messages that quote
    alike do not multiply those that begin alike.
    """
    passages = quotes.groupBy("raw").agg(F.first("text").alias("text")).select("raw", F.explode(_runs(F.col("text"))).alias("r"))
    n = F.size("r.words")
    size = F.when(n >= LONG_RUN, LONG_RUN).otherwise(F.least(n, F.lit(RUN_WORDS)))
    anchor = F.xxhash64(F.slice("r.words", F.lit(1), size)).alias("anchor")
    runs = passages.select("raw", "r.choice", F.md5(F.array_join("r.words", " ")).alias("hash"), n.alias("n"), size.alias("size"), anchor)
    runs = materialise(runs, "runs")

    per_line = F.transform(_lines(F.col("body")), lambda x: F.split(x, " "))
    bodies = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.xxhash64("body").alias("b"), per_line.alias("_l"))
    heads = F.flatten(F.transform("_l", lambda ws: F.transform(ws, lambda w, i: i == 0)))
    bodies = materialise(bodies.select("conv_id", "turn", "b", F.flatten("_l").alias("words"), heads.alias("heads")).distinct(), "words")

    def places(size: int) -> Column:
        """(p, size, anchor) of the runs of so many words, p from 0; short ones only as whole lines."""
        end = F.size("words")
        all_ = F.when(end >= size, F.sequence(F.lit(0), end - size)).otherwise(F.array().cast("array<int>"))
        if size < RUN_WORDS:
            all_ = F.filter(all_, lambda p: F.get("heads", p) & ((p + size == end) | F.coalesce(F.get("heads", p + size), F.lit(False))))
        return F.transform(all_, lambda p: F.struct(p.alias("p"), F.lit(size).alias("size"), F.xxhash64(F.slice("words", p + 1, F.lit(size))).alias("anchor")))

    spots = bodies.select("conv_id", "turn", "b", F.explode(F.concat(*[places(k) for k in (*range(1, RUN_WORDS + 1), LONG_RUN)])).alias("s")).select("conv_id", "turn", "b", "s.*")
    near_runs = spots.join(runs.select("size", "anchor", "n").distinct(), ["size", "anchor"]).select("conv_id", "turn", "b", "p", "n")
    text = F.array_join(F.slice("words", F.col("p") + 1, F.col("n")), " ")
    held = near_runs.join(bodies, ["conv_id", "turn", "b"]).where(F.col("p") + F.col("n") <= F.size("words")).select(F.md5(text).alias("hash"), "conv_id", "turn")
    held = held.join(runs.select("hash").distinct(), "hash", "left_semi")
    known = materialise(held.groupBy("hash", "conv_id").agg(F.min("turn").alias("turn")), "held")

    asked = quotes.select("conv_id", "turn", "raw").distinct().join(runs.select("raw", "choice", "hash"), "raw")
    near = known.select(F.col("conv_id").alias("_c"), F.col("hash").alias("_h"), F.col("turn").alias("near"))
    far = known.groupBy(F.col("hash").alias("_h")).agg(F.min(F.struct("turn", "conv_id")).alias("far"))
    asked = asked.join(near, (F.col("conv_id") == F.col("_c")) & (F.col("hash") == F.col("_h")), "left").drop("_c", "_h")
    asked = asked.join(far, F.col("hash") == F.col("_h"), "left").drop("_h")
    to = _earlier(F.col("near"), F.col("far"))
    best = F.min_by(to, F.when(to.isNotNull(), F.col("choice"))).alias("to")
    return asked.where(to.isNotNull()).groupBy("conv_id", "turn", "raw").agg(best)


def _earlier(near: Column, far: Column) -> Column:
    """(conv_id, turn) of the text's earliest message in the conversation, or else in all, if it precedes."""
    here = F.when(near < F.col("turn"), F.struct(F.col("conv_id").alias("conv_id"), near.alias("turn")))
    return F.coalesce(here, F.when(far < F.struct("turn", "conv_id"), F.struct(far["conv_id"].alias("conv_id"), far["turn"].alias("turn"))))


def links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, part, level, hash, to_conv, to_turn): every quoted passage, with its message where one is found.

    The index is summed up to one row per text and conversation, and one per text, before it
    meets the quotes, so that common passages do not multiply.  Passages that are no whole body
    are looked up as runs of words.
    """
    quotes = parsed.select("conv_id", "turn", F.posexplode("parts").alias("part", "p")).where("p.level > 0")
    quotes = quotes.select("conv_id", "turn", "part", "p.level", digest(F.col("p.text")).alias("hash"), F.md5("p.text").alias("raw"), F.col("p.text").alias("text"))
    known = materialise(index(parsed).groupBy("hash", "conv_id").agg(F.min("turn").alias("turn")), "passages")
    near = known.select(F.col("conv_id").alias("_c"), F.col("hash").alias("_h"), F.col("turn").alias("near"))
    far = known.groupBy(F.col("hash").alias("_h")).agg(F.min(F.struct("turn", "conv_id")).alias("far"))
    out = quotes.join(near, (F.col("conv_id") == F.col("_c")) & (F.col("hash") == F.col("_h")), "left").drop("_c", "_h")
    out = out.join(far, F.col("hash") == F.col("_h"), "left").drop("_h")
    out = out.withColumn("to", _earlier(F.col("near"), F.col("far"))).drop("near", "far")
    out = materialise(out.withColumn("text", F.when(F.col("to").isNull(), F.col("text"))), "whole")
    open_ = out.where("to IS NULL AND hash IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL")
    partial = partial_links(parsed, open_.select("conv_id", "turn", "raw", "text")).withColumnRenamed("to", "partial")
    out = out.join(partial, ["conv_id", "turn", "raw"], "left")
    to = F.coalesce("to", "partial")
    return out.select("conv_id", "turn", "part", "level", "hash", to["conv_id"].alias("to_conv"), to["turn"].alias("to_turn"))


def ancestors(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, depth) from unique (conv_id, turn, parent_conv, parent_turn).

    Every round doubles the step, so a chain of n replies takes about log2(n) rounds, and only
    messages whose root is not reached yet take part in a round.
    """
    up = F.coalesce("parent_conv", "conv_id").alias("root_conv"), F.coalesce("parent_turn", "turn").alias("root_turn")
    replies = F.col("parent_turn").isNotNull()
    now = materialise(parents.select("conv_id", "turn", *up, replies.cast("bigint").alias("depth"), replies.alias("open")), "ancestors")
    while now.where("open").limit(1).count():
        step = now.select(*[F.col(c).alias(f"_{c}") for c in now.columns])
        same = (F.col("root_conv") == F.col("_conv_id")) & (F.col("root_turn") == F.col("_turn"))
        moved = now.where("open").join(step, same).select(
            "conv_id", "turn", F.col("_root_conv").alias("root_conv"), F.col("_root_turn").alias("root_turn"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_open").alias("open")
        )
        now = materialise(now.where("NOT open").unionByName(moved), "ancestors")
    return now.drop("open")


def threads(messages: DataFrame) -> DataFrame:
    """Messages without quotes, in reply order.

    (conv_id, turn, role, body, n_quotes, n_linked, parent_conv, parent_turn, root_conv, root_turn, depth, position):
    ``position`` counts a thread's messages by depth, then turn.
    """
    parsed = materialise(parse(messages), "parsed")
    all_links = materialise(links(parsed), "links")
    linked = F.col("to_turn").isNotNull()
    named = F.min(F.when(linked & (F.col("level") == 1), F.struct("part", "to_turn", "to_conv")))
    parent = all_links.groupBy("conv_id", "turn").agg(named.alias("p"), F.count_if(linked).alias("n_linked"))
    keys = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    parents = keys.join(parent, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.col("p.to_conv").alias("parent_conv"), F.col("p.to_turn").alias("parent_turn"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")
    )
    parents = materialise(parents, "parents")
    tree = ancestors(parents)
    placed = range_sorted(tree, ["root_turn", "root_conv", "depth", "turn", "conv_id"], tree.count(), "place")
    starts = placed.groupBy(F.col("root_conv").alias("_rc"), F.col("root_turn").alias("_rt")).agg(F.min("place").alias("_first"))
    same = (F.col("root_conv") == F.col("_rc")) & (F.col("root_turn") == F.col("_rt"))
    ordered = placed.join(starts, same).select("conv_id", "turn", "root_conv", "root_turn", "depth", (F.col("place") - F.col("_first")).alias("position"))
    n_quotes = F.size(F.filter("parts", lambda p: p["level"] > 0)).cast("bigint")
    rows = parsed.select("conv_id", "turn", "role", "body", n_quotes.alias("n_quotes"))
    out = rows.join(parents, ["conv_id", "turn"], "left").join(ordered, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "body", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_conv", "parent_turn",
        F.coalesce("root_conv", "conv_id").alias("root_conv"), F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("position", F.lit(0)).alias("position"),
    )


def as_replies(conversations: DataFrame) -> DataFrame:
    """The conversations as mail: every message quotes the one before it, and what that one quoted.

    What was quoted before loses its first line where enough words are left.  The table has no quotes of its own; odd turns are answered above the quote, even ones below.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    text = rows.where("text IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("_text"))
    out = rows
    for back in (1, 2):
        earlier = text.select(F.col("conv_id").alias("_c"), (F.col("turn") + back).alias("_t"), F.col("_text").alias(f"_q{back}"))
        out = out.join(earlier, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left").drop("_c", "_t")
    one = F.concat(F.lit("> "), F.replace("_q1", F.lit("\n"), F.lit("\n> ")))
    rest = F.regexp_replace("_q2", r"^[^\n]*\n", "")
    shorter = F.when((rest != F.col("_q2")) & (F.size(_words(_lines(rest))) >= RUN_WORDS), rest).otherwise(F.col("_q2"))
    two = F.concat(F.lit(">> "), F.replace(shorter, F.lit("\n"), F.lit("\n>> ")))
    said = F.concat(F.lit("On turn "), (F.col("turn") - 1).cast("string"), F.lit(" they wrote:"))
    above = F.concat_ws("\n", "text", F.when(one.isNotNull(), said), one, two)
    below = F.concat_ws("\n", two, F.when(one.isNotNull(), said), one, "text")
    return out.select("conv_id", "turn", "role", F.when(F.col("turn") % 2 == 1, above).otherwise(below).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return threads(as_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS body,
    nullif(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), '') AS norm
  FROM conversations),
q AS (
  SELECT m.*, p1.norm AS q1, p2.norm AS q2 FROM m
  LEFT JOIN m p1 ON p1.conv_id = m.conv_id AND p1.turn = m.turn - 1
  LEFT JOIN m p2 ON p2.conv_id = m.conv_id AND p2.turn = m.turn - 2),
first AS (SELECT conv_id, norm, min(turn) AS turn FROM m WHERE norm IS NOT NULL GROUP BY ALL),
e AS (
  SELECT q.*, f.turn AS parent_turn,
    CAST((q1 IS NOT NULL)::INT + (q2 IS NOT NULL)::INT AS BIGINT) AS n_quotes
  FROM q LEFT JOIN first f ON f.conv_id = q.conv_id AND f.norm = q1),
t AS (
  SELECT conv_id, turn, turn AS root_turn, CAST(0 AS BIGINT) AS depth FROM e WHERE parent_turn IS NULL
  UNION ALL
  SELECT e.conv_id, e.turn, t.root_turn, t.depth + 1 FROM e JOIN t ON e.conv_id = t.conv_id AND e.parent_turn = t.turn)
SELECT e.conv_id, e.turn, e.role, e.body, e.n_quotes, e.n_quotes AS n_linked,
  CASE WHEN e.parent_turn IS NOT NULL THEN e.conv_id END AS parent_conv, e.parent_turn, e.conv_id AS root_conv, t.root_turn, t.depth,
  row_number() OVER (PARTITION BY e.conv_id, t.root_turn ORDER BY t.depth, e.turn) - 1 AS position
FROM e JOIN t USING (conv_id, turn)
"""
