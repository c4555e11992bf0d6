"""Queries over stored tables, similarity search and model-quality metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from molscreen.functions import bits as B
from molscreen.functions import validate as V
from molscreen.operators import metrics as M
from molscreen.operators import similarity as N
from molscreen.operators import store as S
from molscreen.plans.tables import big, endpoint_values, fingerprints, r6, read
from molscreen.schemas import ENDPOINTS, endpoint_registry
from molscreen.session import broadcast_if_small, materialise

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


# --- similarity -------------------------------------------------------------------

_FP_SQL = """
    WITH fp AS (SELECT vec_id, label, list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0) AS bits FROM embeddings),
    sim AS (SELECT q.vec_id AS query_id, q.label AS q_label, r.vec_id AS ref_id,
        CASE WHEN len(q.bits) + len(r.bits) = 0 THEN 0.0 ELSE len(list_intersect(q.bits, r.bits))
           / (len(q.bits) + len(r.bits) - len(list_intersect(q.bits, r.bits)))::DOUBLE END AS s
      FROM fp q CROSS JOIN fp r)
"""


def _sides(spark, sf_dir):
    fp = fingerprints(spark, sf_dir)
    q = fp.select(F.col("vec_id").alias("query_id"), "words", "label")
    refs = fp.select(F.col("vec_id").alias("ref_id"), "words")
    return q, refs


@query(
    """
    SELECT vec_id, CAST(len(list_filter(embedding, lambda v: v > 0)) AS BIGINT) AS n_bits,
      len(list_filter(embedding, lambda v: v > 0)) = 0 AS empty, embedding[4] > 0 AS bit_3
    FROM embeddings
    """
)
def fingerprint_bits(spark, sf_dir):
    fp = fingerprints(spark, sf_dir)
    return fp.select(
        "vec_id",
        big("n_bits").alias("n_bits"),
        B.is_empty(F.col("words")).alias("empty"),
        B.get_bit(F.col("words"), F.lit(3 + 64), 64).alias("bit_3"),
    )


@query(
    """
    WITH b AS (SELECT p_partkey, list_distinct([p_partkey * 7 % 2048, (p_size * 131 + 2048) % 2048, p_partkey % 64 + 1984, (p_partkey * 7 + 2048) % 2048]) AS bits FROM part)
    SELECT p_partkey, CAST(len(bits) AS BIGINT) AS n_bits, list_contains(bits, 2047) AS last_bit FROM b
    """
)
def fingerprint_fold(spark, sf_dir):
    """Bit positions past the end fold modulo 2048; bit 63 of a word is the sign bit."""
    k = F.col("p_partkey")
    bits = F.array(k * 7, F.col("p_size").cast("bigint") * 131 + 2048, k % 64 + 1984, k * 7 + 2048)
    fp = read(spark, sf_dir, "part").select("p_partkey", B.from_bits(bits).alias("words"))
    return fp.select(
        "p_partkey",
        big(B.popcount(F.col("words"))).alias("n_bits"),
        B.get_bit(F.col("words"), F.lit(2047)).alias("last_bit"),
    )


@query(_FP_SQL + "SELECT query_id, ref_id, round(s, 9) AS similarity FROM sim WHERE s >= 0.5")
def tanimoto_threshold(spark, sf_dir):
    """All pairs at or over 0.5, with the popcount bound; the SQL compares every pair."""
    q, refs = _sides(spark, sf_dir)
    return N.matches(q, refs, 0.5).withColumn("similarity", F.round("similarity", 9))


@query(_FP_SQL + "SELECT query_id, ref_id, round(s, 9) AS similarity FROM sim WHERE s >= 0.5")
def tanimoto_threshold_blocks(spark, sf_dir):
    """The same pairs by the plan for reference sets too large to broadcast."""
    q, refs = _sides(spark, sf_dir)
    out = N.matches(q, refs, 0.5, bound=0, block_rows=500)
    return out.withColumn("similarity", F.round("similarity", 9))


_WORDS_SQL = r"""
    WITH t AS (SELECT 'q' AS side, item_id AS id, text FROM benchmark UNION ALL SELECT 'r', doc_id, text FROM documents),
    b AS (SELECT DISTINCT side, id, CAST('0x' || substr(md5(w), 1, 6) AS BIGINT) % 2048 AS bit
          FROM (SELECT side, id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM t)),
    n AS (SELECT side, id, count(*) AS n FROM b GROUP BY ALL),
    shared AS (SELECT q.id AS query_id, r.id AS ref_id, count(*) AS c FROM b q JOIN b r ON q.bit = r.bit AND q.side = 'q' AND r.side = 'r' GROUP BY ALL),
    sim AS (SELECT query_id, ref_id, c::DOUBLE / (nq.n + nr.n - c) AS s FROM shared
            JOIN n nq ON nq.side = 'q' AND nq.id = query_id JOIN n nr ON nr.side = 'r' AND nr.id = ref_id)
"""


def _word_sets(spark, sf_dir, table: str, key: str):
    """(id, words): hashed words of whole texts folded to 2048 bits; texts without words have none."""
    rows = read(spark, sf_dir, table).select(F.col(key).alias("id"), N.word_bits("text").alias("w")).where("w is not null")
    # rows of one id are one set; 32 words at most
    one = rows.groupBy("id").agg(*[F.bit_or(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(32)])
    return one.select("id", F.array(*[f"w{i}" for i in range(32)]).alias("words"))


def _word_sides(spark, sf_dir):
    q = _word_sets(spark, sf_dir, "benchmark", "item_id").withColumnRenamed("id", "query_id")
    # the search reads them more than once
    refs = materialise(_word_sets(spark, sf_dir, "documents", "doc_id"), "word-sets")
    return q, refs.withColumnRenamed("id", "ref_id")


@query(_WORDS_SQL + "SELECT query_id, ref_id, round(s, 9) AS similarity FROM sim WHERE s >= 0.15")
def word_set_matches(spark, sf_dir):
    """Similar documents of every benchmark text, on sets of 2048 bits."""
    q, refs = _word_sides(spark, sf_dir)
    return N.matches(q, refs, 0.15).withColumn("similarity", F.round("similarity", 9))


@query(_WORDS_SQL + "SELECT query_id, ref_id, round(s, 9) AS similarity FROM sim WHERE s >= 0.15")
def word_set_matches_blocks(spark, sf_dir):
    """The same pairs over popcount bands, where cells that cannot match are not built."""
    q, refs = _word_sides(spark, sf_dir)
    return N.matches(q, refs, 0.15, bound=0, block_rows=100).withColumn("similarity", F.round("similarity", 9))


@query(
    _WORDS_SQL
    + """, best AS (SELECT query_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC) AS rn FROM sim)
    SELECT query_id, round(avg(s), 9) AS similarity FROM best WHERE rn <= 5 GROUP BY query_id"""
)
def word_set_domain(spark, sf_dir):
    """Mean similarity of the five nearest documents, on sets of 2048 bits in blocks."""
    q, refs = _word_sides(spark, sf_dir)
    out = N.assess(q, refs, bound=0, block_rows=300)
    return out.select("query_id", F.round("similarity", 9).alias("similarity"))


_ASSESS_SQL = (
    _FP_SQL
    + """,
    best AS (SELECT query_id, q_label, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ref_id) AS rn FROM sim),
    dom AS (SELECT query_id, any_value(q_label) AS label, avg(s) AS m FROM best WHERE rn <= 5 GROUP BY query_id)
"""
)
_STATUS = "CASE WHEN m >= 0.45 THEN 'in_domain' WHEN m >= 0.30 THEN 'low_confidence' ELSE 'out_of_domain' END"


@query(_ASSESS_SQL + f"SELECT query_id, round(m, 9) AS similarity, {_STATUS} AS status FROM dom")
def domain_assess(spark, sf_dir):
    """Mean of the best five similarities per molecule, and its domain status."""
    q, refs = _sides(spark, sf_dir)
    return N.assess(q, refs).withColumn("similarity", F.round("similarity", 9))


@query(_ASSESS_SQL + f"SELECT query_id, round(m, 9) AS similarity, {_STATUS} AS status FROM dom")
def domain_assess_blocks(spark, sf_dir):
    """The same assessment by the plan for reference sets too large to broadcast."""
    q, refs = _sides(spark, sf_dir)
    return N.assess(q, refs, bound=0, block_rows=500).withColumn("similarity", F.round("similarity", 9))


@query(
    _ASSESS_SQL
    + f""", st AS (SELECT label, {_STATUS} AS status FROM dom)
    SELECT label, count(*) FILTER (WHERE status = 'in_domain') AS in_domain,
      count(*) FILTER (WHERE status = 'low_confidence') AS low_confidence,
      count(*) FILTER (WHERE status = 'out_of_domain') AS out_of_domain FROM st GROUP BY label"""
)
def domain_breakdown(spark, sf_dir):
    q, refs = _sides(spark, sf_dir)
    out = N.assess(q, refs).join(q.select("query_id", "label"), "query_id")
    return N.domain_breakdown(out, ["label"])


@query(
    _FP_SQL
    + """, b AS (SELECT query_id, ref_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ref_id) AS rn FROM sim)
    SELECT query_id, ref_id AS nearest, round(s, 9) AS similarity FROM b WHERE rn = 1"""
)
def nearest_reference(spark, sf_dir):
    """Closest stored molecule of each molecule; a stored molecule finds itself at 1.0."""
    fp = fingerprints(spark, sf_dir)
    q = fp.select(F.col("vec_id").alias("query_id"), "words")
    refs = fp.select(F.col("vec_id").alias("ref_id"), "words")
    return N.nearest_named(q, refs).select(
        "query_id", F.col("ref_id").alias("nearest"), F.round("similarity", 9).alias("similarity")
    )


@query(
    _FP_SQL
    + """, b AS (SELECT query_id, ref_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ref_id) AS rn FROM sim)
    SELECT query_id, ref_id AS nearest, round(s, 9) AS similarity FROM b WHERE rn = 1"""
)
def nearest_reference_bands(spark, sf_dir):
    """The same by the plan for reference sets too large to broadcast: bands outward from the query's own."""
    fp = fingerprints(spark, sf_dir)
    q = fp.select(F.col("vec_id").alias("query_id"), "words")
    refs = fp.select(F.col("vec_id").alias("ref_id"), "words")
    return N.nearest_named(q, refs, bound=0, block_rows=500).select(
        "query_id", F.col("ref_id").alias("nearest"), F.round("similarity", 9).alias("similarity")
    )


@query(
    """
    WITH p AS (SELECT p_size AS a, p_partkey % 50 AS b FROM part)
    SELECT a, b, CASE WHEN greatest(a, b) = 0 THEN false ELSE least(a, b) / greatest(a, b)::DOUBLE >= 0.45 END AS able, count(*) AS n
    FROM p GROUP BY ALL
    """
)
def popcount_bound(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_size").alias("a"), (F.col("p_partkey") % 50).alias("b"))
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "able", B.can_exceed(F.col("a"), F.col("b"), 0.45)
    )


# --- store ------------------------------------------------------------------------


def _halves(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(
        F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("inchikey"), F.col("c_acctbal").alias("v")
    )
    o = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("K"), (F.col("o_custkey") * 2).cast("string")).alias("inchikey"),
        F.col("o_totalprice").alias("v"),
        F.col("o_orderkey").alias("row_index"),
    )
    return c, o


_HALVES = """
    WITH c AS (SELECT 'K' || c_custkey AS inchikey, c_acctbal AS v FROM customer),
    o AS (SELECT 'K' || o_custkey * 2 AS inchikey, o_totalprice AS v, o_orderkey AS row_index FROM orders),
    fresh AS (SELECT inchikey, arg_min(v, row_index) AS v FROM o WHERE inchikey NOT IN (SELECT inchikey FROM c) GROUP BY inchikey)
"""


@query(_HALVES + "SELECT * FROM fresh")
def insert_new(spark, sf_dir):
    """Bulk insert that skips known keys; first row per new key in input order."""
    c, o = _halves(spark, sf_dir)
    return S.new_rows(c, o, "inchikey", "row_index").select("inchikey", "v")


@query(_HALVES + "SELECT count(*) AS n_inserted FROM fresh")
def insert_count(spark, sf_dir):
    c, o = _halves(spark, sf_dir)
    return S.insert_count(c, o, "inchikey")


@query(_HALVES + "SELECT * FROM c UNION ALL SELECT * FROM fresh")
def upsert(spark, sf_dir):
    c, o = _halves(spark, sf_dir)
    return S.upsert(c, o, "inchikey", "row_index")


@query(_HALVES + "SELECT * FROM c WHERE inchikey IN (SELECT inchikey FROM o)")
def find_many(spark, sf_dir):
    c, o = _halves(spark, sf_dir)
    return S.find_many(c, o, "inchikey")


@query(
    """
    WITH pred AS (SELECT o_custkey AS mol, o_orderkey % 3 AS model_version, max(o_totalprice) AS score FROM orders GROUP BY ALL)
    SELECT c.c_custkey AS mol, c.c_custkey % 3 AS model_version, p.score, p.mol IS NOT NULL AS cached
    FROM customer c LEFT JOIN pred p ON p.mol = c.c_custkey AND p.model_version = c.c_custkey % 3
    """
)
def cache_probe(spark, sf_dir):
    pred = (
        read(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("mol"), (F.col("o_orderkey") % 3).alias("model_version"))
        .agg(F.max("o_totalprice").alias("score"))
    )
    req = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("mol"), (F.col("c_custkey") % 3).alias("model_version")
    )
    return S.cache_probe(req, pred, ["mol", "model_version"], ["score"])


@query("SELECT * FROM (SELECT o_orderkey, o_orderdate FROM orders) ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def recent_batches(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return S.recent(o, 25, created="o_orderdate", key="o_orderkey")


@query(
    """
    SELECT event_id FROM events
    WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 90 MINUTE
    """
)
def orphaned_batches(spark, sf_dir):
    """Running batches older than 90 minutes at a given clock."""
    e = read(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "click", "running").otherwise("completed").alias("status"),
        F.col("ts").alias("created_at"),
    )
    return S.orphaned(e, dt.datetime(2024, 1, 10), 90).select("event_id")


_LOG_SQL = """
    WITH log AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed'
        WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued' ELSE event_type END AS status FROM events),
    ok AS (SELECT * FROM log WHERE status IN ('queued','running','completed','failed','cancelled'))
"""


@query(
    _LOG_SQL
    + """SELECT user_id, coalesce(arg_min(CASE WHEN status IN ('completed','failed','cancelled') THEN status END,
          CASE WHEN status IN ('completed','failed','cancelled') THEN event_id END), arg_max(status, event_id)) AS status
    FROM ok GROUP BY user_id"""
)
def batch_status(spark, sf_dir):
    """Current status per batch from its log; a terminal status stays."""
    t = F.col("event_type")
    status = (
        F.when(t == "error", "failed").when(t == "purchase", "completed").when(t == "view", "running")
        .when(t == "click", "queued").otherwise(t)
    )
    log = read(spark, sf_dir, "events").select("user_id", status.alias("status"), F.col("event_id").alias("updated_at"))
    return S.latest_status(log, "user_id")


@query(
    """
    SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS completed_rows,
      count(*) FILTER (WHERE event_type = 'error') AS failed_rows FROM events GROUP BY user_id
    """
)
def batch_counters(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(
        "user_id", F.when(F.col("event_type") == "error", "model_error").alias("error_code")
    )
    return S.batch_counters(rows, "user_id")


@query(
    """
    WITH r AS (SELECT row_number() OVER (ORDER BY event_id) AS n, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad FROM events),
    c AS (SELECT n, bad, sum(bad) OVER (ORDER BY n) AS failed FROM r)
    SELECT (n - 1) // 250 AS checkpoint, count(*) AS rows_in_step, max(n) AS rows_done, CAST(max(failed) AS BIGINT) AS rows_failed
    FROM c GROUP BY 1
    """
)
def batch_progress(spark, sf_dir):
    """A progress event per 250 rows of one long batch."""
    e = read(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("bad"))
    return S.progress(e, "event_id", "bad")


@query(
    """
    WITH r AS (SELECT l_suppkey AS batch, (l_orderkey * 8 + l_linenumber) // 250 AS checkpoint, count(*) AS k,
        count(*) FILTER (WHERE l_returnflag = 'R') AS f FROM lineitem GROUP BY ALL)
    SELECT batch, checkpoint, k AS rows_in_step, CAST(sum(k) OVER w AS BIGINT) AS rows_done, CAST(sum(f) OVER w AS BIGINT) AS rows_failed
    FROM r WINDOW w AS (PARTITION BY batch ORDER BY checkpoint ROWS UNBOUNDED PRECEDING)
    """
)
def batch_progress_by_index(spark, sf_dir):
    """Progress of many batches whose rows carry their file position."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("batch"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_index"),
        (F.col("l_returnflag") == "R").alias("bad"),
    )
    return S.progress_by_index(rows, "batch", "row_index", "bad")


@query(
    """
    SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS BIGINT) AS row_index FROM orders
    """
)
def row_positions(spark, sf_dir):
    """File position of every row inside its (very large) group."""
    from molscreen.operators.running import row_position

    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return row_position(o, "o_orderkey", ["o_orderstatus"]).select("o_orderkey", "o_custkey", "row_index")


@query(
    """
    SELECT c_custkey, CASE WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'moderate' ELSE 'high' END AS band,
      CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS triage_score,
      CASE WHEN c_mktsegment = 'BUILDING' THEN 'outside_applicability_domain' END AS withheld,
      least(greatest(c_nationkey, 5), 15) AS bucket, round(c_acctbal * 2.5 + 10, 6) AS physical, round(1 / (1 + exp(-c_acctbal / 4000)), 6) AS calibrated
    FROM customer
    """
)
def score_presentation(spark, sf_dir):
    """Bands, withheld scores, clamped buckets, de-standardised and calibrated values."""
    v = F.col("c_acctbal")
    status = F.when(F.col("c_mktsegment") == "BUILDING", "out_of_domain").otherwise("in_domain")
    return read(spark, sf_dir, "customer").select(
        "c_custkey",
        V.band(v, F.lit(1000.0), F.lit(5000.0)).alias("band"),
        V.withhold(v, status).alias("triage_score"),
        V.withhold_reason(status).alias("withheld"),
        V.clamp(F.col("c_nationkey"), 5, 15).alias("bucket"),
        r6(V.destandardise(v, F.lit(10.0), F.lit(2.5))).alias("physical"),
        r6(V.sigmoid(v / 4000)).alias("calibrated"),
    )


@query(
    """
    SELECT o_custkey, CAST(epoch(max(o_orderdate)) - epoch(min(o_orderdate)) AS BIGINT) AS seconds FROM orders GROUP BY o_custkey
    """
)
def elapsed_seconds(spark, sf_dir):
    span = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")
    )
    return span.select("o_custkey", V.elapsed_seconds(F.col("a"), F.col("b")).alias("seconds"))


@query(
    """
    SELECT prediction_id, endpoint, round(value, 6) AS value FROM (
      UNPIVOT (SELECT l_orderkey * 8 + l_linenumber AS prediction_id, l_quantity AS caco2, l_discount AS hia, l_tax AS herg FROM lineitem)
      ON caco2, hia, herg INTO NAME endpoint VALUE value)
    """
)
def values_tall(spark, sf_dir):
    """Wide predictions to tall rows."""
    wide = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("prediction_id"),
        F.col("l_quantity").alias("caco2"), F.col("l_discount").alias("hia"), F.col("l_tax").alias("herg"),
    )
    return S.to_tall(wide, ["caco2", "hia", "herg"]).withColumn("value", r6("value"))


@query(
    """
    WITH e AS (SELECT o_orderkey AS prediction_id, i, (o_orderkey * (7 + 2 * i) + 13 * i) % 1000 AS u FROM orders CROSS JOIN range(12) t(i))
    SELECT prediction_id, count(*) AS n, CAST(sum(u) AS BIGINT) AS total FROM e GROUP BY prediction_id
    """
)
def values_wide(spark, sf_dir):
    """Tall predictions to one column per endpoint (checked by the sum of their codes)."""
    codes = [e[0] for e in ENDPOINTS]
    reg = endpoint_registry(spark).select(F.col("code").alias("endpoint"), "low", "high")
    vals = endpoint_values(spark, sf_dir, endpoint_registry(spark)).join(broadcast_if_small(reg), "endpoint")
    lo, hi = F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(1.0))
    unit = vals.withColumn("value", F.round(((F.col("value") - lo) / (hi - lo) + 0.25) / 1.5 * 999))
    wide = S.to_wide(unit, codes)
    total = sum((F.col(c) for c in codes), F.lit(0.0))
    present = sum((F.col(c).isNotNull().cast("bigint") for c in codes), F.lit(0).cast("bigint"))
    return wide.select("prediction_id", present.alias("n"), big(total).alias("total"))


# --- metrics ----------------------------------------------------------------------

_SCORED = """
    WITH b AS (SELECT d.lang, l.quality, l.toxic, d.n_chars AS s, d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
    t AS (SELECT lang, 'quality' AS endpoint, quality AS y, s FROM b UNION ALL SELECT lang, 'toxic', toxic, s FROM b)
"""


def _scored(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").alias("s"))
    b = d.join(read(spark, sf_dir, "labels"), "doc_id")
    return b.unpivot(["lang", "s"], ["quality", "toxic"], "endpoint", "y")


@query(
    _SCORED
    + """, r AS (SELECT endpoint, y, rank() OVER (PARTITION BY endpoint ORDER BY s) + (count(*) OVER (PARTITION BY endpoint, s) - 1) / 2.0::DOUBLE AS mr FROM t),
    g AS (SELECT endpoint, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg, sum(mr) FILTER (WHERE y = 1) AS sr FROM r GROUP BY endpoint)
    SELECT endpoint, n_pos, n_neg, round((sr - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) AS auroc FROM g"""
)
def auroc(spark, sf_dir):
    return M.auroc(_scored(spark, sf_dir), ["endpoint"], "y", "s").withColumn("auroc", r6("auroc"))


@query(
    _SCORED
    + """, c AS (SELECT endpoint, s, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM t GROUP BY endpoint, s),
    k AS (SELECT endpoint, p, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY endpoint) AS tp FROM c
          WINDOW w AS (PARTITION BY endpoint ORDER BY s DESC))
    SELECT endpoint, round(sum(cp / (cp + cn)::DOUBLE * p / tp), 6) AS auprc FROM k GROUP BY endpoint"""
)
def auprc(spark, sf_dir):
    return M.auprc(_scored(spark, sf_dir), ["endpoint"], "y", "s").withColumn("auprc", r6("auprc"))


@query(
    """
    WITH r AS (SELECT l_returnflag,
        rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS a,
        rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0::DOUBLE AS b FROM lineitem)
    SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY l_returnflag
    """
)
def spearman(spark, sf_dir):
    out = M.spearman(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount")
    return out.withColumn("spearman", r6("spearman"))


@query("SELECT l_linestatus, round(avg(abs(l_discount - l_tax)), 6) AS mae FROM lineitem GROUP BY l_linestatus")
def mae(spark, sf_dir):
    return M.mae(read(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_discount", "l_tax").withColumn("mae", r6("mae"))


@query(
    """
    WITH s AS (SELECT l_linestatus, l_returnflag, 1 + l_orderkey % 5 AS seed, avg(l_discount) AS m FROM lineitem GROUP BY ALL)
    SELECT l_linestatus, l_returnflag, count(*) AS n_seeds, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM s GROUP BY ALL
    """
)
def seed_summary(spark, sf_dir):
    """Mean and spread of a metric over five seeds."""
    per = (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_linestatus", "l_returnflag", (1 + F.col("l_orderkey") % 5).alias("seed"))
        .agg(F.avg("l_discount").alias("m"))
    )
    out = M.seed_summary(per, ["l_linestatus", "l_returnflag"], "m")
    return out.withColumn("mean", r6("mean")).withColumn("sd", r6("sd"))


@query(
    """
    WITH p AS (SELECT l_orderkey, avg(CASE WHEN l_returnflag <> 'R' THEN l_tax END) AS loss FROM lineitem GROUP BY l_orderkey)
    SELECT count(loss) AS n_molecules, round(avg(loss), 6) AS mean_loss FROM p
    """
)
def masked_loss(spark, sf_dir):
    """Loss averaged only over the labels each molecule has."""
    tall = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("loss")
    )
    return M.masked_loss(tall, "l_orderkey", "loss").withColumn("mean_loss", r6("mean_loss"))


@query(
    """
    WITH r AS (SELECT p_partkey, p_size % 12 AS element, p_partkey % 8 AS degree, p_partkey % 9 - 4 AS charge, p_size % 7 AS hs, p_partkey % 6 AS hyb,
        p_size % 2 AS aromatic, p_partkey % 2 AS in_ring FROM part),
    s AS (SELECT p_partkey, least(element, 9) AS e, 10 + least(degree, 5) AS d, 16 + least(greatest(charge, -2), 2) + 2 AS c, 21 + least(hs, 4) AS h,
        26 + CASE WHEN hyb = 5 THEN 2 ELSE hyb END AS y, aromatic, in_ring FROM r)
    SELECT p_partkey, array_to_string(list_transform(range(33), lambda i: CASE WHEN i IN (e, d, c, h, y) OR (i = 31 AND aromatic = 1) OR (i = 32 AND in_ring = 1) THEN '1' ELSE '0' END), '') AS slots,
      true AS wellformed FROM s
    """
)
def feature_rows(spark, sf_dir):
    """The 33-slot atom row, clamped at every edge, with its invariant checked."""
    from molscreen.functions import features as X

    k, z = F.col("p_partkey").cast("int"), F.col("p_size")
    row = X.atom_row(z % 12, k % 8, k % 9 - 4, z % 7, k % 6, z % 2 == 1, k % 2 == 1)
    rows = read(spark, sf_dir, "part").select("p_partkey", row.alias("row"))
    text = F.array_join(F.transform("row", lambda v: v.cast("int").cast("string")), "")
    return rows.select("p_partkey", text.alias("slots"), X.is_wellformed(F.col("row")).alias("wellformed"))


@query(
    """
    WITH v AS (SELECT 'v' || p_size % 3 AS version, p_size % 3 = 1 AS is_active, count(*) AS n FROM part GROUP BY ALL) SELECT version, n FROM v WHERE is_active
    """
)
def active_version(spark, sf_dir):
    v = read(spark, sf_dir, "part").groupBy(
        F.concat(F.lit("v"), (F.col("p_size") % 3).cast("string")).alias("version"), (F.col("p_size") % 3 == 1).alias("is_active")
    ).agg(F.count(F.lit(1)).alias("n"))
    return S.active_version(v).select("version", "n")
