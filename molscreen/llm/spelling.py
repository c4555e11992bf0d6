"""Spelling variants: words that differ by one code point, found among sorted rotations.

A word is marked with a terminator and every rotation of the marked word is a row.  A word
``a x b`` with the code point ``x`` at some place has the rotation ``b $ a x``: whatever differs
from it by a replacement at that place shares all but the last code point of it, and the word
``a b``, with ``x`` deleted, has exactly that prefix as a whole rotation.  So both kinds of edit
are prefix ranges of the sorted rotations.  Rows are sorted by that prefix; a range holds at most
one whole rotation and one row per code point of the alphabet, so it is bounded by the alphabet,
and what a word's neighbours come to (their number and the most frequent one) is taken from two
rows of the range without forming pairs.  A deletion inside a run of equal code points reaches
the same word from several places; it counts at the run's first place alone.

Words are grouped under their forms by pointer doubling over the links word to form.  Every
form is at least ``RATIO`` times as frequent as its word, so chains are logarithmic.

Defined cases: null and empty texts have no words; a null id counts as empty text in the hash;
repeated rows are counted each, with the same hash; ties in frequency go to the smaller word in
code-point order; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molscreen.llm.common import quoted
from molscreen.session import materialise

RUN = "[A-Za-zÀ-ÿ]+"
DAMAGE = 97
LENGTH = 5
TIMES = 3
RATIO = 2
#: Sorts before every letter and is none.
MARK = "$"


def folded(word: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(word, string.ascii_uppercase, string.ascii_lowercase)


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pattern: str = RUN) -> DataFrame:
    """(id, run): every folded run of letters of every whole text."""
    found = F.explode(F.regexp_extract_all(quoted(text), F.lit(pattern), F.lit(0)))
    return docs.select(F.coalesce(quoted(doc_id).cast("string"), F.lit("")).alias("id"), found.alias("run")).select("id", folded(F.col("run")).alias("run"))


def damaged(rows: DataFrame, every: int = DAMAGE) -> DataFrame:
    """(word): one in ``every`` runs, by the hash of id and run, without the code point that the hash names."""
    h = F.crc32(F.concat_ws(":", "id", "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.withColumn("h", h).select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """(word, n): words of enough code points that occur often enough."""
    counted = words.where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= times)


def rotations(vocab: DataFrame) -> DataFrame:
    """(prefix, last, first, word, n): all rotations of the marked words, whole and without their last code point.

    ``last`` is null for whole rotations.  ``first`` is false where the code point before the
    last place is the same, so that deleting either gives the same word.
    """
    i, word = F.col("i"), F.col("word")
    each = vocab.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    # the rotation that ends with the i-th code point; at i = 0 it ends with the mark
    rotation = F.concat(F.substring(word, i + 1, F.length(word)), F.lit(MARK), F.substring(word, F.lit(1), i))
    each = each.select("word", "n", "i", rotation.alias("rotation"))
    whole = F.struct(F.col("rotation").alias("prefix"), F.lit(None).cast("string").alias("last"), F.lit(True).alias("first"))
    cut = F.expr("substring(rotation, 1, length(rotation) - 1)")
    here, before = F.substring(word, i, F.lit(1)), F.substring(word, i - 1, F.lit(1))
    short = F.struct(cut.alias("prefix"), here.alias("last"), ((i == 1) | (here != before)).alias("first"))
    both = F.explode(F.when(i > 0, F.array(whole, short)).otherwise(F.array(whole)))
    return each.select("word", "n", both.alias("r")).select("r.*", "word", "n")


def neighbours(vocab: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): how many words are near, and the most frequent of them."""
    short = F.col("last").isNotNull()
    # the smallest such struct is the most frequent word, ties to the smaller one
    ranked = lambda cond: F.when(cond, F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")))
    often = Window.partitionBy("prefix").orderBy(F.col("last").isNull(), F.desc("n"), "word")
    span = often.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = rotations(vocab).select(
        "word",
        "last",
        "first",
        F.row_number().over(often).alias("place"),
        F.count_if(short).over(span).alias("shorts"),
        F.count_if(short & F.col("first")).over(span).alias("reached"),
        F.nth_value(ranked(short), 1).over(span).alias("top"),
        F.nth_value(ranked(short), 2).over(span).alias("second"),
        F.min(ranked(~short)).over(span).alias("deleted"),
        F.min(ranked(short & F.col("first"))).over(span).alias("longer"),
    )
    replaced = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("top"))
    deleted = F.when(F.col("first"), F.col("deleted"))
    near = F.when(short, F.col("shorts") - 1 + F.when(deleted.isNotNull(), 1).otherwise(0)).otherwise(F.col("reached"))
    best = F.when(short, F.least(replaced, deleted)).otherwise(F.col("longer"))
    some = seen.select("word", near.alias("near"), best.alias("best")).where("near > 0")
    summed = some.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return summed.select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))


def variants(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of a stored (word, n)."""
    near = neighbours(vocab).withColumnRenamed("word", "_w")
    joined = vocab.join(near, F.col("word") == F.col("_w"), "left").drop("_w")
    good = F.col("form_n") >= ratio * F.col("n")
    out = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), *[F.when(good, F.col(c)).alias(c) for c in ("form", "form_n")])
    out = materialise(out, "variants")
    links = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        # a root that has a form itself is passed on to where that one points
        ahead = links.select(F.col("word").alias("_at"), F.col("root").alias("_root"))
        passed = links.join(ahead, F.col("root") == F.col("_at"), "left")
        passed = materialise(passed.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        links = passed.select("word", "root")
        if passed.where("moved").isEmpty():
            break
    ends = links.select(F.col("word").alias("_w"), "root")
    return out.join(ends, F.col("word") == F.col("_w"), "left").withColumn("root", F.coalesce("root", "word")).drop("_w")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    vocab = materialise(vocabulary(damaged(runs(docs))), "words")
    return variants(vocab).select("word", "form", "root", "n", "n_near", "form_n")


SQL = """
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS times, id || ':' || run AS s FROM runs GROUP BY id, run),
hashed AS (
  SELECT run, times,
    xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 2 * strlen(s) + 1, 2), lambda i: CAST('0x' || substr(hex(encode(s)), CAST(i AS INTEGER), 2) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
        lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT)) AS h
  FROM counted),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
vocab AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
gaps AS (
  SELECT DISTINCT word, n, substr(word, 1, CAST(i AS BIGINT)) || '_' || substr(word, CAST(i AS BIGINT) + 2) AS gap,
    substr(word, 1, CAST(i AS BIGINT)) || substr(word, CAST(i AS BIGINT) + 2) AS less
  FROM vocab, unnest(range(0, length(word))) t(i)),
less AS (SELECT DISTINCT word, n, less FROM gaps),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN vocab b ON a.less = b.word
  UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN vocab b ON a.less = b.word),
top AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -other_n, form := other)) AS best FROM near GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * v.n THEN best.form END AS form,
    CASE WHEN -best.less >= 2 * v.n THEN -best.less END AS form_n
  FROM vocab v LEFT JOIN top USING (word)),
walk AS (
  SELECT word, word AS at, form AS ahead FROM forms
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON w.ahead = f.word)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON f.word = w.word AND w.ahead IS NULL
"""
