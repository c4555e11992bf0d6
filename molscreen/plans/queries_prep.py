"""Queries over data preparation: validation, cleaning, profiles, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from molscreen.functions import validate as V
from molscreen.operators import clean as C
from molscreen.operators import split as P
from molscreen.operators import store as S
from molscreen.plans.tables import big, r6, read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


@query(
    """
    WITH t AS (SELECT 'd' || doc_id AS id, text AS s FROM documents UNION ALL SELECT 'p' || page_id, url FROM pages
               UNION ALL SELECT 'k' || p_partkey, CASE WHEN p_partkey % 10 = 0 THEN repeat(' ', p_size) ELSE p_name END FROM part)
    SELECT id, CASE WHEN regexp_full_match(s, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]*') THEN 'empty_input'
       WHEN strlen(s) > 1000 THEN 'input_too_long'
       WHEN regexp_matches(s, '[^\\x20-\\x7E]') THEN 'illegal_character' END AS error
    FROM t
    """
)
def validate_input(spark, sf_dir):
    """First failing input check of whole texts, URLs and names."""
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("s"))
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("url").alias("s"))
    blank = F.when(F.col("p_partkey") % 10 == 0, F.repeat(F.lit(" "), F.col("p_size"))).otherwise(F.col("p_name"))
    parts = read(spark, sf_dir, "part").select(F.concat(F.lit("k"), "p_partkey").alias("id"), blank.alias("s"))
    rows = docs.unionByName(pages).unionByName(parts)
    return rows.select("id", V.input_error(F.col("s")).alias("error"))


_KEY_SQL = """
    WITH k AS (SELECT c_custkey, upper(translate(sha256(CAST(c_custkey AS VARCHAR)), '0123456789', 'GHIJKLMNOP')) AS h FROM customer),
    keys AS (SELECT c_custkey, CASE c_custkey % 5
        WHEN 0 THEN substr(h, 1, 14) || '-' || substr(h, 15, 10) || '-N'
        WHEN 1 THEN lower(substr(h, 1, 14)) || '-' || substr(h, 15, 10) || '-N'
        WHEN 2 THEN substr(h, 1, 13) || '-' || substr(h, 15, 11) || '-N'
        WHEN 3 THEN substr(h, 1, 14) || '-' || substr(h, 15, 10) || '-1'
        ELSE substr(h, 1, 14) || '-' || substr(h, 15, 10) || '-S' END AS key FROM k)
"""


@query(
    _KEY_SQL
    + """
    SELECT c_custkey, regexp_full_match(key, '[A-Z]{14}-[A-Z]{10}-[A-Z]') AS valid,
      CASE WHEN regexp_full_match(key, '[A-Z]{14}-[A-Z]{10}-[A-Z]') THEN substr(key, 1, 14) END AS skeleton
    FROM keys
    """
)
def identity_keys(spark, sf_dir):
    """Shape check and connectivity block of 27-character keys."""
    h = F.upper(F.translate(F.sha2(F.col("c_custkey").cast("string"), 256), "0123456789", "GHIJKLMNOP"))

    def key(a: int, b: int, last: str):
        return F.concat(F.substring(h, 1, a), F.lit("-"), F.substring(h, 15, b), F.lit(f"-{last}"))

    m = F.col("c_custkey") % 5
    k = (
        F.when(m == 0, key(14, 10, "N"))
        .when(m == 1, F.concat(F.lower(F.substring(h, 1, 14)), F.lit("-"), F.substring(h, 15, 10), F.lit("-N")))
        .when(m == 2, key(13, 11, "N"))
        .when(m == 3, key(14, 10, "1"))
        .otherwise(key(14, 10, "S"))
    )
    rows = read(spark, sf_dir, "customer").select("c_custkey", k.alias("key"))
    return rows.select(
        "c_custkey",
        V.is_key(F.col("key")).alias("valid"),
        V.key_skeleton(V.parse_key(F.col("key"))).alias("skeleton"),
    )


@query(
    """
    WITH s AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'Failed'
        WHEN 3 THEN 'failed' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'queued' ELSE event_type END AS raw FROM events)
    SELECT raw, CASE WHEN raw IN ('queued','running','completed','failed','cancelled') THEN raw END AS status,
      coalesce(raw IN ('completed','failed','cancelled'), false) AS terminal, count(*) AS n
    FROM s GROUP BY ALL
    """
)
def status_values(spark, sf_dir):
    m = F.col("event_id") % 7
    raw = (
        F.when(m == 0, "running").when(m == 1, "completed").when(m == 2, "Failed").when(m == 3, "failed")
        .when(m == 4, "cancelled").when(m == 5, "queued").otherwise(F.col("event_type"))
    )
    return (
        read(spark, sf_dir, "events")
        .groupBy(raw.alias("raw"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("raw", V.parse_status(F.col("raw")).alias("status"), V.is_terminal(F.col("raw")).alias("terminal"), "n")
    )


@query(
    """
    SELECT event_id, CASE event_id % 9 WHEN 1 THEN 1000.0 WHEN 2 THEN -0.5 WHEN 3 THEN 7.0 WHEN 4 THEN 'inf'::DOUBLE
      WHEN 0 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE value END AS y FROM events
    """
)
def numeric_coercion(spark, sf_dir):
    """Numbers in all their spellings; other text, type suffixes and NaN are missing."""
    kind, text = F.col("event_id") % 9, F.col("value").cast("string")
    for i, other in enumerate([F.col("props"), " 1e3 ", "-.5", "7.", "inf", "nan", "1d", "1f"]):
        text = F.when(kind == i, other).otherwise(text)
    return read(spark, sf_dir, "events").select("event_id", V.to_number(text).alias("y"))


@query(
    """
    SELECT l_partkey, avg(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, avg(CAST(l_quantity AS BIGINT)) AS quantity,
      first(l_shipdate ORDER BY l_orderkey, l_linenumber, l_shipdate) AS first_ship, count(*) AS n_rows
    FROM lineitem GROUP BY l_partkey
    """
)
def dedup_mean(spark, sf_dir):
    """Collapse order lines per part: mean labels, first representative in input order."""
    rows = read(spark, sf_dir, "lineitem").select(
        "l_partkey",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_shipdate").alias("first_ship"),
        F.struct("l_orderkey", "l_linenumber", "l_shipdate").alias("row_index"),
    )
    return C.dedup_mean(rows, "l_partkey", ["cents", "quantity"], ["first_ship"], "row_index")


@query(
    """
    WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey % 11 <> 3 GROUP BY ALL),
    r AS (SELECT l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_returnflag) AS rn FROM c),
    t AS (SELECT l_partkey, count(*) AS n_rows FROM lineitem GROUP BY l_partkey)
    SELECT t.l_partkey, r.l_returnflag AS flag, t.n_rows FROM t LEFT JOIN r ON r.l_partkey = t.l_partkey AND rn = 1
    """
)
def dedup_majority(spark, sf_dir):
    """Majority label per part, ties to the lowest, all-null parts stay null."""
    line = read(spark, sf_dir, "lineitem").select(
        "l_partkey",
        F.when(F.col("l_partkey") % 11 != 3, F.col("l_returnflag")).alias("flag"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_index"),
    )
    return C.dedup_majority(line, "l_partkey", ["flag"], [], "row_index").select("l_partkey", "flag", "n_rows")


@query(
    """
    WITH b AS (SELECT doc_id, text, lang, CASE WHEN n_chars >= 40 THEN text END AS structure, n_chars // 100 AS heavy,
                      CASE WHEN n_chars >= 40 THEN sha256(text) END AS key FROM documents),
    k AS (SELECT * FROM b WHERE structure IS NOT NULL AND heavy <= 128),
    c AS (SELECT key, arg_min(heavy, doc_id) AS heavy_atoms, count(*) AS n_rows FROM k GROUP BY key),
    v AS (SELECT key, lang, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, lang) AS rn FROM k GROUP BY key, lang)
    SELECT c.key, c.heavy_atoms, c.n_rows, v.lang FROM c JOIN v ON v.key = c.key AND rn = 1
    """
)
def clean_dataset(spark, sf_dir):
    """Full cleaning of documents: drop, cap, dataset-wide key choice, majority label."""
    d = read(spark, sf_dir, "documents")
    long_enough = F.col("n_chars") >= 40
    rows = d.select(
        F.col("doc_id").alias("row_index"),
        F.when(long_enough, F.col("text")).alias("canonical_smiles"),
        F.floor(F.col("n_chars") / 100).cast("int").alias("heavy_atoms"),
        F.when(long_enough, F.sha2("text", 256)).alias("mol_key"),
        "lang",
    )
    out = C.clean_dataset(rows, ["lang"], "binary")
    return out.select("key", "heavy_atoms", "n_rows", "lang")


@query(
    """
    WITH b AS (SELECT CASE WHEN n_chars >= 40 THEN text END AS structure, n_chars // 100 AS heavy FROM documents)
    SELECT count(*) AS n_input, count(structure) AS n_parsed, count(*) - count(structure) AS n_invalid,
      count(*) FILTER (WHERE structure IS NOT NULL AND heavy > 128) AS n_oversized,
      round(100.0 * count(*) FILTER (WHERE structure IS NOT NULL AND heavy > 128) / count(structure), 6) AS oversized_pct
    FROM b
    """
)
def intake_report(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(
        F.when(F.col("n_chars") >= 40, F.col("text")).alias("canonical_smiles"),
        F.floor(F.col("n_chars") / 100).cast("int").alias("heavy_atoms"),
    )
    return C.intake_report(rows).withColumn("oversized_pct", r6("oversized_pct"))


@query(
    """
    SELECT l_orderkey, l_extendedprice FROM lineitem
    WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING stddev_samp(l_extendedprice) > 1e-9)
    """
)
def conflict_regression(spark, sf_dir):
    return C.label_conflicts(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", "regression")


@query(
    """
    SELECT l_orderkey, l_linestatus FROM lineitem
    WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) > 1)
    """
)
def conflict_class(spark, sf_dir):
    return C.label_conflicts(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linestatus", "binary")


@query(
    """
    WITH r AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey % 2 AS DOUBLE) ELSE NULL END AS y, o_orderkey FROM orders
      UNION ALL SELECT o_custkey, 2.0, -1 FROM orders WHERE o_orderkey % 11 = 0)
    SELECT o_custkey, count(*) AS n_rows, count(y) AS n_known FROM r
    WHERE o_custkey IN (SELECT o_custkey FROM r GROUP BY o_custkey HAVING count(DISTINCT y) > 1) GROUP BY o_custkey
    """
)
def conflict_missing(spark, sf_dir):
    """Labels that are NaN neither agree nor disagree with others."""
    o = read(spark, sf_dir, "orders")
    y = F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_custkey") % 2).cast("double")).otherwise(float("nan"))
    rows = o.select("o_custkey", y.alias("y")).unionByName(o.where("o_orderkey % 11 = 0").select("o_custkey", F.lit(2.0).alias("y")))
    found = C.label_conflicts(rows, "o_custkey", "y", "binary")
    return found.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.isnan("y")).alias("n_known"))


@query("SELECT count(*) AS n_rows, count(DISTINCT text) AS n_unique, count(*) - count(DISTINCT text) AS n_merged FROM documents")
def collapse_report(spark, sf_dir):
    return C.collapse_report(read(spark, sf_dir, "documents"), "text")


@query(
    """
    WITH b AS (SELECT source, CASE WHEN n_chars >= 60 THEN text END AS t, CASE WHEN n_chars >= 40 THEN n_chars // 100 END AS h FROM documents)
    SELECT source, count(*) AS n_rows, count(*) - count(h) AS unparseable, round(avg(h), 6) AS heavy_mean, max(h) AS heavy_max,
      count(*) FILTER (WHERE h > 128) AS over_cap, round(100.0 * count(*) FILTER (WHERE h > 128) / greatest(count(h), 1), 6) AS over_cap_pct,
      count(*) - count(DISTINCT t) - max(CASE WHEN t IS NULL THEN 1 ELSE 0 END) AS duplicate_smiles
    FROM b GROUP BY source
    """
)
def profile_sizes(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(
        "source",
        F.when(F.col("n_chars") >= 60, F.col("text")).alias("t"),
        F.when(F.col("n_chars") >= 40, F.floor(F.col("n_chars") / 100)).alias("h"),
    )
    out = C.size_profile(rows, ["source"], "t", "h")
    return out.select(
        "source", "n_rows", "unparseable", r6("heavy_mean").alias("heavy_mean"), big("heavy_max").alias("heavy_max"),
        "over_cap", r6("over_cap_pct").alias("over_cap_pct"), big("duplicate_smiles").alias("duplicate_smiles"),
    )


@query(
    """
    WITH t AS (SELECT 'quality' AS endpoint, quality AS y FROM labels UNION ALL SELECT 'toxic', toxic FROM labels),
    p AS (SELECT endpoint, avg(y) AS p FROM t GROUP BY endpoint)
    SELECT endpoint, round(p, 6) AS positive_rate, p < 0.2 OR p > 0.8 AS imbalanced,
      round(CASE WHEN p > 0 AND p < 1 THEN (1 - p) / p END, 6) AS pos_weight FROM p
    """
)
def profile_binary(spark, sf_dir):
    tall = read(spark, sf_dir, "labels").unpivot(["doc_id"], ["quality", "toxic"], "endpoint", "y")
    out = C.binary_profile(tall, ["endpoint"], "y")
    return out.withColumn("positive_rate", r6("positive_rate")).withColumn("pos_weight", r6("pos_weight"))


@query(
    """
    SELECT event_type, round(avg(value), 6) AS target_mean, round(stddev_samp(value), 6) AS target_std, min(value) AS target_min,
      max(value) AS target_max, round(skewness(value), 6) AS target_skew, abs(skewness(value)) > 1 AS long_tailed
    FROM events GROUP BY event_type
    """
)
def profile_regression(spark, sf_dir):
    out = C.regression_profile(read(spark, sf_dir, "events"), ["event_type"], "value")
    for c in ("target_mean", "target_std", "target_skew"):
        out = out.withColumn(c, r6(c))
    return out


# Twelve labelled endpoint frames cut from the documents and their labels, as (endpoint, Drug, Y, heavy_atoms)
_FRAMES_SQL = """
    names(i, endpoint, task) AS (VALUES (0,'caco2','regression'),(1,'hia','binary'),(2,'pgp','binary'),(3,'bioavail','binary'),
      (4,'bbb','binary'),(5,'ppbr','regression'),(6,'vdss','regression'),(7,'cyp3a4','binary'),(8,'cyp2d6','binary'),
      (9,'half_life','regression'),(10,'clearance','regression'),(11,'herg','binary')),
    frames AS (SELECT n.endpoint, n.task, d.text AS drug, CASE WHEN d.n_chars >= 40 THEN d.n_chars // 100 END AS h,
        CASE WHEN n.task = 'binary' THEN CASE WHEN (d.doc_id // 12) % (2 + n.i) = 0 THEN 1.0 ELSE 0.0 END
             ELSE ln(d.n_chars + 1.0) * (n.i + 1) END AS y
      FROM documents d JOIN names n ON n.i = d.doc_id % 12),
    prof AS (SELECT endpoint, any_value(task) AS task, count(*) AS n_rows, count(*) - count(h) AS unparseable,
        count(*) FILTER (WHERE h > 128) AS over_cap, count(*) - count(DISTINCT drug) AS duplicate_smiles,
        avg(y) AS mean, CASE WHEN any_value(task) = 'regression' THEN skewness(y) END AS skew FROM frames GROUP BY endpoint)
"""


def _endpoint_profile(spark, sf_dir):
    from molscreen.schemas import ENDPOINTS, endpoint_registry

    codes = F.array(*[F.lit(e[0]) for e in ENDPOINTS])
    tasks = F.array(*[F.lit(e[3]) for e in ENDPOINTS])
    i = F.pmod(F.col("doc_id"), F.lit(12)).cast("int")
    hit = F.floor(F.col("doc_id") / 12) % (2 + i) == 0
    y = F.when(F.get(tasks, i) == "binary", F.when(hit, 1.0).otherwise(0.0)).otherwise(
        F.ln(F.col("n_chars") + 1.0) * (i + 1)
    )
    frames = read(spark, sf_dir, "documents").select(
        F.get(codes, i).alias("endpoint"),
        F.col("text").alias("Drug"),
        y.alias("Y"),
        F.when(F.col("n_chars") >= 40, F.floor(F.col("n_chars") / 100).cast("int")).alias("heavy_atoms"),
    )
    return C.profile(frames, endpoint_registry(spark))


@query(
    f"""WITH {_FRAMES_SQL}
    SELECT endpoint, task, n_rows, unparseable, over_cap, duplicate_smiles,
      round(CASE WHEN task = 'binary' THEN mean END, 6) AS positive_rate,
      CASE WHEN task = 'binary' THEN mean < 0.2 OR mean > 0.8 END AS imbalanced,
      round(CASE WHEN task = 'regression' THEN mean END, 6) AS target_mean, round(skew, 6) AS target_skew FROM prof"""
)
def profile_endpoints(spark, sf_dir):
    """Profile of all twelve endpoints in one job."""
    return _endpoint_profile(spark, sf_dir).select(
        "endpoint", "task", "n_rows", "unparseable", "over_cap", big("duplicate_smiles").alias("duplicate_smiles"),
        r6("positive_rate").alias("positive_rate"), "imbalanced", r6("target_mean").alias("target_mean"),
        r6("target_skew").alias("target_skew"),
    )


@query(
    f"""WITH {_FRAMES_SQL}, w AS (
      SELECT endpoint, 'imbalanced' AS finding, CASE WHEN mean > 0 AND mean < 1 THEN (1 - mean) / mean END AS value FROM prof WHERE task = 'binary' AND (mean < 0.2 OR mean > 0.8)
      UNION ALL SELECT endpoint, 'long_tailed', skew FROM prof WHERE abs(skew) > 1
      UNION ALL SELECT endpoint, 'unparseable', unparseable FROM prof WHERE unparseable > 0
      UNION ALL SELECT endpoint, 'over_cap', over_cap FROM prof WHERE over_cap > 0)
    SELECT endpoint, finding, round(value, 6) AS value FROM w"""
)
def profile_warnings(spark, sf_dir):
    out = C.profile_warnings(_endpoint_profile(spark, sf_dir))
    return out.select("endpoint", "finding", r6("value").alias("value"))


@query(
    f"""WITH {_FRAMES_SQL} SELECT CAST(sum(n_rows) AS BIGINT) AS total_rows, CAST(sum(over_cap) AS BIGINT) AS total_over_cap,
      round(100.0 * sum(over_cap) / sum(n_rows), 6) AS over_cap_pct FROM prof"""
)
def profile_total(spark, sf_dir):
    return C.profile_total(_endpoint_profile(spark, sf_dir)).withColumn("over_cap_pct", r6("over_cap_pct"))


_DRIFT_SQL = """
    WITH prof AS (SELECT source, count(*) AS n, count(DISTINCT text) AS u FROM documents GROUP BY source),
    doc AS (SELECT source, CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN u WHEN 1 THEN n ELSE u + 5 END AS e FROM prof
            UNION ALL SELECT 'absent', 10),
    v AS (SELECT d.source, d.e AS expected_n, p.n AS n_rows, p.u AS n_unique, p.u - d.e AS off_by,
      CASE WHEN p.n IS NULL THEN 'unprofiled' WHEN p.u = d.e THEN 'duplicates' WHEN p.n = d.e THEN 'equal'
           ELSE 'unexplained' END AS verdict FROM doc d LEFT JOIN prof p ON p.source = d.source)
"""


def _drift(spark, sf_dir):
    prof = read(spark, sf_dir, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), C.duplicate_count("text").alias("duplicate_smiles")
    )
    m = F.substring("source", 4, 10).cast("int") % 3
    unique = F.col("n_rows") - F.col("duplicate_smiles")
    expected = F.when(m == 0, unique).when(m == 1, F.col("n_rows")).otherwise(unique + 5)
    documented = prof.select("source", expected.alias("expected_n")).unionByName(
        spark.createDataFrame([("absent", 10)], "source string, expected_n bigint")
    )
    return C.drift_verdict(documented, prof, by="source")


@query(_DRIFT_SQL + "SELECT * FROM v")
def drift_check(spark, sf_dir):
    return _drift(spark, sf_dir)


@query(
    _DRIFT_SQL
    + """SELECT count(*) FILTER (WHERE verdict IN ('duplicates', 'equal')) AS explained,
         count(*) FILTER (WHERE verdict = 'unexplained') AS unexplained FROM v"""
)
def drift_summary(spark, sf_dir):
    return C.drift_summary(_drift(spark, sf_dir))


@query(
    """
    SELECT o_orderpriority AS split, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS sd
    FROM orders GROUP BY o_orderpriority
    """
)
def split_sanity(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "split")
    out = C.split_sanity(o, "split", "o_totalprice")
    return out.withColumn("mean", r6("mean")).withColumn("sd", r6("sd"))


_RATES_SQL = """
    WITH b AS (SELECT d.lang AS split, l.quality, CASE WHEN d.doc_id % 3 = 0 THEN l.toxic END AS toxic,
                      CASE WHEN d.lang = 'en' THEN l.toxic END AS english_only FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
    t AS (SELECT split, 'quality' AS label, quality AS y FROM b UNION ALL SELECT split, 'toxic', toxic FROM b
          UNION ALL SELECT split, 'english_only', english_only FROM b),
    r AS (SELECT split, label, count(y) AS n_labelled, avg(y) AS rate, count(y) = 0 AS no_labels FROM t GROUP BY split, label)
"""


def _rates(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("split"))
    b = d.join(read(spark, sf_dir, "labels"), "doc_id").select(
        "split",
        "quality",
        F.when(F.col("doc_id") % 3 == 0, F.col("toxic")).alias("toxic"),
        F.when(F.col("split") == "en", F.col("toxic")).alias("english_only"),
    )
    return C.multilabel_rates(b, "split", ["quality", "toxic", "english_only"])


@query(_RATES_SQL + "SELECT split, label, n_labelled, round(rate, 6) AS positive_rate, no_labels FROM r")
def multilabel_rates(spark, sf_dir):
    return _rates(spark, sf_dir).withColumn("positive_rate", r6("positive_rate"))


@query(_RATES_SQL + "SELECT split, round(avg(rate), 6) AS mean_rate, count(*) FILTER (WHERE no_labels) AS n_empty FROM r GROUP BY split")
def mean_of_rates(spark, sf_dir):
    return C.mean_of_rates(_rates(spark, sf_dir), "split").withColumn("mean_rate", r6("mean_rate"))


@query(
    """
    WITH RECURSIVE sizes AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
    classes AS (SELECT n, count(*) AS c, row_number() OVER (ORDER BY n DESC) AS i FROM sizes GROUP BY n),
    total AS (SELECT CAST(floor(0.8 * sum(n)) AS BIGINT) AS t, CAST(floor(0.1 * sum(n)) AS BIGINT) AS v FROM sizes),
    fill(i, n, to_train, to_val, t, v) AS (
      SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), t, v FROM total
      UNION ALL
      SELECT q.i, q.n, q.a, q.b, q.t - q.a * q.n, q.v - q.b * q.n FROM (
        SELECT k.i, k.n, least(k.c, f.t // k.n) AS a, least(k.c - least(k.c, f.t // k.n), f.v // k.n) AS b, f.t, f.v
        FROM fill f JOIN classes k ON k.i = f.i + 1) q),
    ranked AS (SELECT o_custkey, n, row_number() OVER (PARTITION BY n ORDER BY
        CAST('0x' || substr(md5('42:' || o_custkey), 1, 15) AS BIGINT), o_custkey) AS r FROM sizes),
    assigned AS (SELECT r.o_custkey, CASE WHEN r.r <= f.to_train THEN 'train' WHEN r.r <= f.to_train + f.to_val THEN 'val' ELSE 'test' END AS split
      FROM ranked r JOIN fill f ON f.n = r.n)
    SELECT o.o_orderkey, o.o_custkey, a.split FROM orders o JOIN assigned a ON a.o_custkey = o.o_custkey
    """
)
def group_split(spark, sf_dir):
    """Orders split 80/10/10 with every customer's orders on one side (greedy, big groups first)."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return P.group_split(orders, "o_custkey")


@query(
    """
    WITH s AS (SELECT c_custkey, CAST('0x' || substr(md5('7:' || c_custkey), 1, 15) AS BIGINT) % 1000000 AS slot FROM customer)
    SELECT c_custkey, CASE WHEN slot < 800000 THEN 'train' WHEN slot < 900000 THEN 'val' ELSE 'test' END AS split FROM s
    """
)
def random_split(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(
        "c_custkey", P.random_split_on(F.col("c_custkey"), seed=7).alias("split")
    )


@query(
    """
    WITH RECURSIVE sizes AS (SELECT source AS g, count(*) AS n FROM documents GROUP BY source)
    SELECT 'all' AS part, count(*) AS n_rows, count(DISTINCT source) AS n_groups, CAST(0 AS BIGINT) AS spanning FROM documents
    """
)
def split_leakage(spark, sf_dir):
    """Groups that span two splits (always none), over a few very large groups."""
    rows = P.group_split(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", (0.6, 0.2, 0.2))
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.min("split") != F.max("split")).alias("span"))
    return per.agg(
        F.lit("all").alias("part"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"),
        F.count_if("span").alias("spanning"),
    ).select("part", "n_rows", "n_groups", "spanning")


@query(
    """
    WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
    SELECT k, 'left' AS only_in FROM a WHERE k NOT IN (SELECT k FROM b)
    UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)
    """
)
def set_differences(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    b = read(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("k"))
    return S.set_differences(a, b, "k")


@query("""SELECT DISTINCT unnest(regexp_extract_all(html, '[a-z]+="[^"]*"')) AS identifier FROM pages""")
def extract_identifiers(spark, sf_dir):
    return S.extract_identifiers(read(spark, sf_dir, "pages"), "html", '[a-z]+="[^"]*"')


@query(
    """
    SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_unique, sum(n)::BIGINT - count(*) AS drift FROM
      (SELECT text, count(*) AS n FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark) GROUP BY text)
    """
)
def union_unique(spark, sf_dir):
    """Unique structures over two concatenated files, against their raw row count."""
    both = read(spark, sf_dir, "documents").select("text").unionByName(read(spark, sf_dir, "benchmark").select("text"))
    per = both.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique")).withColumn(
        "drift", F.col("n_rows") - F.col("n_unique")
    )
