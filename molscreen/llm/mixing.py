"""Mixing sources to target weights.

Every document gets a hash-random key.  Within a source the documents are ordered by key in
hash ranges, distributed prefix sums of their word counts are taken, and the source's exact
budget is cut there: whole epochs first, then documents up to the cut, and of the document at
the cut the words that are left.  Only DataFrame functions are used.

Defined cases: a null text has no words; null is a source of its own, last in order; documents
without words and sources without words take nothing; rows with the same key (the same id) at
a cut share what is left by size; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molscreen.llm.common import WORD, bits_for, quoted
from molscreen.llm.ordering import range_sorted
from molscreen.operators.running import running_sum
from molscreen.session import materialise, ship

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = 9
KEY_BITS = 60


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0))


def mix_key(doc_id: Column, seed: int = SEED) -> Column:
    """Hash-random key: the first 60 bits of an MD5 of id and seed."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def sized(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored (doc_id, source, key, size), the only columns that the mix needs."""
    cols = [quoted(doc_id).alias("doc_id"), quoted(source).alias("source"), mix_key(quoted(doc_id)).alias("key"), n_words(quoted(text)).alias("size")]
    return materialise(docs.select(*cols), "mix")


def _big(col: Column) -> Column:
    return col.cast("decimal(38,0)")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, none above ``most`` times its source.

    The excess of sources at their limit is reshared by weight until none is above; only the
    two sums of a round come to the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = totals.withColumn("_last", F.col("source").isNull())
    n = totals.count()
    # null sorts last; the parts keep that order
    ranked = range_sorted(totals, ["_last", "source"], n, "place")
    weight = F.element_at(F.lit(list(weights)), (F.col("place") % len(weights) + 1).cast("int"))
    src = materialise(ranked.select("source", "source_size", weight.cast("bigint").alias("weight")), "sources")
    whole, w = src.agg(F.sum("source_size"), F.sum("weight")).first()
    whole, capped, free = whole or 0, 0, w or 0
    while True:
        above = _big(F.lit(whole - capped)) * _big(F.col("weight")) > _big(F.lit(most) * F.col("source_size")) * F.lit(free).cast("bigint")
        c, f = src.agg(
            F.sum(F.when(above, most * F.col("source_size")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))
        ).first()
        c, f = c or 0, f or 0
        if (c, f) == (capped, free) or not f:
            break
        capped, free = c, f
    share = F.lit(whole - capped).cast("bigint") * F.col("weight")
    exact = F.when(above, F.lit(most) * F.col("source_size")).otherwise(F.expr(f"({whole - capped}L * weight) div {max(free, 1)}L"))
    target = F.when(above, (F.lit(most) * F.col("source_size")).cast("double")).otherwise(share / F.lit(max(free, 1)))
    return src.select("source", "source_size", target.alias("target"), exact.alias("budget"))


def cuts(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """Per source: whole ``epochs`` and the key up to which its documents are taken once more.

    ``part`` of the ``at_cut`` words with exactly that key are taken.
    """
    rows = sizes.count()
    bits = bits_for(rows)
    by_key = sizes.where("size > 0").groupBy("source", "key").agg(F.sum("size").alias("w"))
    sums = running_sum(by_key, "key", {"w": "upto"}, by=["source"], bucket=F.shiftright("key", KEY_BITS - bits).cast("int"))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
    goal = goal.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    rest = goal.where("rest > 0").select(F.col("source").alias("_s"), "rest")
    at = sums.join(rest, F.col("source").eqNullSafe(F.col("_s"))).where("upto - w <= rest AND rest < upto")
    at = at.select(F.col("source").alias("_s"), F.col("key").alias("cut_key"), (F.col("rest") - F.col("upto") + F.col("w")).alias("part"), F.col("w").alias("at_cut"))
    return goal.join(at, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def taken(size: Column, key: Column) -> Column:
    """Words taken of a document, given its source's cut columns."""
    once = F.when(key < F.col("cut_key"), size).when(key == F.col("cut_key"), F.floor(_big(F.col("part")) * _big(size) / _big(F.col("at_cut"))).cast("bigint"))
    return F.col("epochs") * size + F.coalesce(once, F.lit(0).cast("bigint"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target, budget, epochs, cut_key, part, at_cut), stored: one row per source."""
    return materialise(cuts(sizes, targets(sizes, weights, most)), "cuts")


def _with_cuts(rows: DataFrame, plan: DataFrame, source: Column) -> DataFrame:
    # adaptive execution broadcasts the plan where it is small and splits hot sources where not
    plan = plan.withColumnRenamed("source", "_plan_source")
    return rows.join(plan, F.coalesce(source, F.lit("")).eqNullSafe(F.coalesce(F.col("_plan_source"), F.lit(""))) & (source.isNull() == F.col("_plan_source").isNull()))


def copies(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of the mix: whole copies, and the cut copy with its first words joined by spaces.

    The columns are those of ``docs``; ``n_chars`` follows the cut text where it is there.
    """
    row = docs.select(F.struct("*").alias("row")).select("row", mix_key(F.col("row.doc_id")).alias("_key"), n_words(F.col("row.text")).alias("_size"))
    got = _with_cuts(row, plan, F.col("row.source")).where("_size > 0")
    got = got.select("row", "_size", taken(F.col("_size"), F.col("_key")).alias("_taken")).where("_taken > 0")
    lengths = F.concat(
        F.array_repeat(F.col("_size"), F.expr("CAST(_taken div _size AS INT)")),
        F.when(F.expr("_taken % _size > 0"), F.array(F.expr("_taken % _size"))).otherwise(F.array().cast("array<bigint>")),
    )
    each = got.select("row", "_size", F.explode(lengths).alias("_len"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0))
    text = F.when(F.col("_len") == F.col("_size"), F.col("row.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("_len").cast("int")), " "))
    out = []
    for c in docs.columns:
        col = F.col("row")[c]
        if c == "text":
            col = text
        elif c == "n_chars":
            col = F.when(F.col("_len") == F.col("_size"), col).otherwise(F.char_length(text).cast(docs.schema[c].dataType))
        out.append(col.alias(c))
    return each.select(*out)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents, repeated and cut as the mix takes them."""
    ship(spark)
    return copies(docs, mix(sized(docs)))


def query(spark, sf_dir: str) -> DataFrame:
    sizes = sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = _with_cuts(sizes, mix(sizes), F.col("source"))
    return got.select("doc_id", "size", "source_size", "target", taken(F.col("size"), F.col("key")).alias("taken"), "source", "epochs")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':9'), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (
  SELECT source, sum(size) AS total, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
whole AS (SELECT sum(total) AS t, sum(w) AS w FROM s),
it(k, c, f) AS (
  SELECT 0, CAST(0 AS HUGEINT), CAST(w AS HUGEINT) FROM whole
  UNION ALL
  SELECT k + 1, (SELECT CAST(coalesce(sum(3 * total), 0) AS HUGEINT) FROM s, whole WHERE (whole.t - it.c) * s.w > 3 * s.total * it.f),
    (SELECT CAST(coalesce(sum(s.w), 0) AS HUGEINT) FROM s, whole WHERE (whole.t - it.c) * s.w <= 3 * s.total * it.f)
  FROM it WHERE k < 60),
last AS (SELECT c, f FROM it ORDER BY k DESC LIMIT 1),
goal AS (
  SELECT source, CAST(total AS BIGINT) AS source_size,
    CASE WHEN (t - c) * s.w > 3 * total * f THEN CAST(3 * total AS DOUBLE) ELSE CAST((t - c) * s.w AS DOUBLE) / CAST(f AS DOUBLE) END AS target,
    CASE WHEN (t - c) * s.w > 3 * total * f THEN 3 * total ELSE (t - c) * s.w // f END AS budget
  FROM s, whole, last),
cum AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) AS upto FROM d)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
    + greatest(0, least(size, budget % source_size - (upto - size))) END AS BIGINT) AS taken,
  cum.source, CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END AS BIGINT) AS epochs
FROM cum JOIN goal ON cum.source IS NOT DISTINCT FROM goal.source
"""
