"""URL filter: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

The filter is a table: one row per block, ``WORDS`` 64-bit words, built by or-ing the bits of
the listed URLs.  A URL's bits all lie in one block, so probing is one equi-join on the block
number, which adaptive execution broadcasts where the filter's measured size allows and
shuffles where not.  URLs whose bits are all set go on to an exact hash join with the list,
which removes the false positives; the others meet keys that match nothing and are spread
evenly.  Only DataFrame functions are used.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is
allowed; repeated list entries count once; repeated pages are judged each; an empty list or
table is fine; columns of ``pages`` with the names of the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molscreen.llm.common import hash63, quoted
from molscreen.session import materialise

#: Fixed by the contract of the query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Host labels whose pages are listed.
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
WORDS = 4  # words of a block: 256 bits
BITS_PER_URL = 16
PROBES = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without its index file, ``.html`` or trailing slash; no scheme, query or fragment."""
    p = F.regexp_replace(path(url), r"(/index)?\.html?$", "")
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(p, r"/+$", ""))


def rule_text(rule: tuple[str, str, str]) -> str:
    return rule[1] + rule[2]


def decide(h: Column, p: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule whose host, or a subdomain, and path prefix fit."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(rule_text(r))):  # later conditions wrap earlier ones, so the longest is asked first
        fits = ((h == rule[1]) | h.endswith("." + rule[1])) & p.startswith(rule[2])
        out = F.when(fits, F.struct(F.lit(rule_text(rule)).alias("rule"), F.lit(rule[0]).alias("verdict"))).otherwise(out)
    return out


def blocks_for(n_urls: int) -> int:
    return max(1, -(-n_urls * BITS_PER_URL // (64 * WORDS)))


def _block(key: Column, blocks: int) -> Column:
    return hash63(F.lit(1), key) % blocks


def _masks(key: Column) -> list[Column]:
    """The bits of a key in each word of its block."""
    words = [F.lit(0).cast("bigint")] * WORDS
    for i in range(PROBES):
        bit = hash63(F.lit(100 + i), key) % (64 * WORDS)
        mask = F.call_function("shiftleft", F.expr("1L"), (bit % 64).cast("int"))
        words = [w.bitwiseOR(F.when(F.floor(bit / 64) == at, mask).otherwise(F.lit(0).cast("bigint"))) for at, w in enumerate(words)]
    return words


def build(listed: DataFrame, n_urls: int, key: str = "canonical") -> DataFrame:
    """(block, w0, w1, ...): the blocked filter of the listed keys."""
    blocks = blocks_for(n_urls)
    rows = listed.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def listed_among(pages: DataFrame, listed: DataFrame, key: str = "canonical") -> DataFrame:
    """Add ``possible`` (the filter's answer) and ``listed`` (the exact one) to rows with ``key``.

    Every distinct key is asked once, by itself; rows meet the answers to possible hits alone, and
    travel as one struct, so no name of theirs can clash.  Columns called ``possible`` or
    ``listed`` are replaced.
    """
    urls = materialise(listed.select(F.col(key).alias("_listed")).where("_listed IS NOT NULL AND _listed <> ''").distinct(), "listed")
    n = urls.count()
    blocks = blocks_for(n)
    bloom = build(urls, n, "_listed").withColumnRenamed("block", "_block")
    kept = [c for c in pages.columns if c not in ("possible", "listed")]
    rows = pages.select(F.struct(*[quoted(c) for c in kept]).alias("row"), quoted(key).alias("_key"))
    asked = rows.select("_key").where("_key IS NOT NULL AND _key <> ''").distinct()
    hit = F.lit(True)
    for i, mask in enumerate(_masks(F.col("_key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    possible = asked.join(bloom, _block(F.col("_key"), blocks) == F.col("_block")).where(hit).select(F.col("_key").alias("_possible"))
    exact = possible.join(urls, F.col("_possible") == F.col("_listed"), "left")
    answers = exact.select("_possible", F.col("_listed").isNotNull().alias("listed"))
    found = rows.join(answers, F.col("_key") == F.col("_possible"), "left")
    return found.select("row.*", F.col("_possible").isNotNull().alias("possible"), F.coalesce("listed", F.lit(False)).alias("listed"))


ADDED = ["host", "path", "canonical", "possible", "listed", "rule", "verdict"]


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict, canonical, possible and listed, which replace columns of these names."""
    row = F.struct(*[quoted(c) for c in pages.columns if c not in ADDED or c == url]).alias("page")
    u = quoted(url)
    parts = pages.select(row, host(u).alias("host"), path(u).alias("path"), canonical(u).alias("canonical"))
    ruled = listed_among(parts, listed).withColumn("_d", decide(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_d.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return ruled.select("page.*", "host", "path", "canonical", "possible", "listed", F.col("_d.rule").alias("rule"), verdict.alias("verdict"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs of pages below a host with a listed label."""
    labels = F.split(host(F.col("url")), r"\.")
    return pages.where(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in LISTED_LABELS]))).select(canonical(F.col("url")).alias("canonical"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict", "canonical", "listed")


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u),
c AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') AS canonical FROM p),
l AS (
  SELECT DISTINCT canonical FROM c
  WHERE list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  r.canonical, l.canonical IS NOT NULL AS listed
FROM r LEFT JOIN l ON r.canonical = l.canonical
"""
