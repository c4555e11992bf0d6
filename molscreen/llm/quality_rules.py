"""Quality rules with a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure
bit per rule.  Policies are versioned sets of bits, applied to a stored ledger at any time
without touching a text again, and ablations are aggregations over the bits.

Defined cases: a null text counts as empty (no words, so ``few_words`` fails); repeated rows
are judged each on their own; other columns pass through whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molscreen.llm.common import map_texts
from molscreen.session import ship

MEASURES = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
    "n_lines": "bigint", "n_upper": "bigint", "n_lower": "bigint", "n_stutter": "bigint",
}
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))

#: Rule name -> failure condition over the measurements; the place in the list is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeat_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("dup_lines", "n_dup_lines >= 2 AND 2 * n_dup_lines > n_lines"),
    ("upper_case", "n_upper > n_lower"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    ("stutter", "100 * n_stutter > 20 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeat_words"]


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = {
    1: Policy(1, ("few_words", "repeat_words")),
    2: Policy(2, ("few_words", "repeat_words", "symbols", "dup_lines", "upper_case")),
    3: Policy(3, tuple(BIT)),
}
CURRENT = POLICIES[3]


class _Ids(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _repeated(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mask of the words that lie in a window of WINDOW words found twice or more in the same text."""
    n = len(ids) - WINDOW + 1
    mask = np.zeros(len(ids), bool)
    if n < 2:
        return mask
    inside = doc[:n] == doc[WINDOW - 1 :]
    mixed = doc[:n].astype(np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
        mixed ^= mixed >> np.uint64(29)
    mixed = mixed[inside]
    at = np.flatnonzero(inside)
    if not len(at):
        return mask
    ordered = np.sort(mixed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return mask
    place = np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)
    at = at[twice[place] == mixed]
    # the hash only selects; equal windows are told by their words
    exact = np.stack([doc[at], *[ids[at + k] for k in range(WINDOW)]], axis=1)
    order = np.lexsort(exact.T[::-1])
    same = (exact[order][1:] == exact[order][:-1]).all(axis=1)
    hit = np.zeros(len(at), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    starts = at[hit]
    steps = np.zeros(len(ids) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + WINDOW, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(texts: list[str | None]) -> dict:
    """Measurements of whole texts, one list entry per text."""
    out: dict[str, list] = {name: [] for name in MEASURES}
    ids, known, counts = [], _Ids(), []
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        ids.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        counts.append(len(words))
        out["n_words"].append(len(words))
        # every code point is a blank or lies in a word
        out["word_chars"].append(len(text or "") - (len(raw) - len(raw.translate(None, BLANKS))))
        out["n_symbols"].append(len(raw) - len(raw.translate(None, SYMBOLS)))
        lines = [line for line in raw.split(b"\n") if line.strip()]
        out["n_lines"].append(len(lines))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_upper"].append(len(raw) - len(raw.translate(None, UPPER)))
        out["n_lower"].append(len(raw) - len(raw.translate(None, LOWER)))
    doc = np.repeat(np.arange(len(texts)), counts)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    again = np.zeros(len(flat))
    again[1:] = (flat[1:] == flat[:-1]) & (doc[1:] == doc[:-1])
    out["n_stutter"] = np.bincount(doc, weights=again, minlength=len(texts)).astype(np.int64)
    repeated = np.bincount(doc, weights=_repeated(flat, doc), minlength=len(texts)) if len(flat) else np.zeros(len(texts))
    out["n_repeat_words"] = repeated.astype(np.int64)
    return out


def failures() -> Column:
    """Failure bits from the measurement columns."""
    total = F.lit(0).cast("bigint")
    for name, condition in RULES:
        total = total + F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0))
    return total


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, measurements, failed): one row per document; store it to apply policies later."""
    return map_texts(docs, measure, MEASURES, text, keep).withColumn("failed", failures())


def verdict(policy: Policy = CURRENT) -> Column:
    """Whether a ledger row passes the policy."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(entries: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Ledger rows with ``policy`` (its version) and ``kept``."""
    return entries.withColumn("policy", F.lit(policy.version)).withColumn("kept", verdict(policy))


def ablation(entries: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """(rule, n_failed, n_only): documents that each rule fails, and those only it rejects.

    Rows are first counted per bit pattern, so at most 2^rules rows are exploded.
    """
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("bigint").alias("bit")) for r in policy.rules])
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    ship(spark)
    return ledger(docs).where(verdict()).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    entries = apply_policy(ledger(docs, keep=["doc_id"]))
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return entries.select(
        "row.doc_id", *names, base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "n_lines", "n_upper", "n_lower", "n_stutter", "failed", "policy"
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
places AS (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
windows AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS win FROM places),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY r),
parts AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM parts WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(length(regexp_replace(t, '[^a-z]', '', 'g')) AS BIGINT) AS n_lower,
    CAST(len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS BIGINT) AS n_stutter
  FROM w LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
f AS (
  SELECT *, CAST(
      (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN n_dup_lines >= 2 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN n_upper > n_lower THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN 100 * n_stutter > 20 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept,
  n_lines, n_upper, n_lower, n_stutter, failed, CAST(3 AS INTEGER) AS policy
FROM f
"""
