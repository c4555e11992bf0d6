"""Queries that write given tables to the scratch folder and read them back through the sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from molscreen.functions import bits as B
from molscreen.functions import features as X
from molscreen.functions.validate import to_number
from molscreen.operators import clean as C
from molscreen.operators import csr as R
from molscreen.operators import smiles as S
from molscreen.operators import store as O
from molscreen.operators.running import running_sum
from molscreen.plans.queries_prep import _FRAMES_SQL, _endpoint_profile
from molscreen.plans.tables import big, block_molecules, block_sql, fingerprints, r6, read
from molscreen.schemas import ENDPOINTS
from molscreen.session import shared_dir
from molscreen.sources import database as D
from molscreen.sources import files as IO
from molscreen.streaming import batches as T

QUERIES, SQL = {}, {}
CODES = [e[0] for e in ENDPOINTS]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/molscreen-{name}-{uuid.uuid4().hex}"


def _structures(spark, sf_dir):
    """Parts in the raw layout, with quotes and commas inside the text."""
    part = read(spark, sf_dir, "part")
    text = F.concat(F.lit(' say "'), "p_name", F.lit('", then'))
    return part.select(F.col("p_partkey").cast("string").alias("Drug_ID"), text.alias("Drug"), F.col("p_retailprice").alias("Y"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS "Drug_ID", ' say "' || p_name || '", then' AS "Drug", p_retailprice AS "Y" FROM part""")
def csv_scan(spark, sf_dir):
    """Quoted text written as CSV and scanned with a fixed schema."""
    path = _scratch(spark, "csv")
    IO.write_csv(_structures(spark, sf_dir), path)
    return IO.read_csv(spark, path).withColumn("Y", to_number(F.col("Y")))


@query("""SELECT CAST(doc_id AS VARCHAR) AS "Drug_ID", text AS "Drug", CAST(n_chars AS DOUBLE) AS "Y" FROM documents""")
def csv_line_breaks(spark, sf_dir):
    """Whole documents, line breaks and all, through CSV."""
    path = _scratch(spark, "lines")
    docs = read(spark, sf_dir, "documents")
    IO.write_csv(docs.select(F.col("doc_id").cast("string").alias("Drug_ID"), F.col("text").alias("Drug"), F.col("n_chars").cast("double").alias("Y")), path)
    return IO.read_csv(spark, path, line_breaks=True).withColumn("Y", to_number(F.col("Y")))


@query("SELECT count(*) AS n_rows, round(sum(p_retailprice), 4) AS total FROM part")
def csv_gzip(spark, sf_dir):
    """Compressed CSV is scanned like plain CSV."""
    path = _scratch(spark, "gzip")
    _structures(spark, sf_dir).write.csv(path, header=True, escape='"', compression="gzip")
    return IO.read_csv(spark, path).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("Y"), 4).alias("total"))


@query(
    f"""
    WITH names AS (SELECT unnest({CODES!r}) AS endpoint, unnest(range({len(CODES)})) AS i), splits(split, j) AS (VALUES ('train_val', 0), ('test', 1)),
    files AS (SELECT * FROM names, splits)
    SELECT f.endpoint, f.split, count(p_partkey) AS n_rows, count(p_partkey) = 0 AS missing, round(sum(p_retailprice), 4) AS total
    FROM files f LEFT JOIN part ON p_partkey % 3 = f.i AND p_size % 2 = f.j AND f.i < 3 GROUP BY f.endpoint, f.split
    """
)
def endpoint_files(spark, sf_dir):
    """Split files of three endpoints in one scan; the other endpoints' files are reported missing."""
    root = _scratch(spark, "endpoints")
    part = read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("Drug_ID"), F.col("p_name").alias("Drug"), F.col("p_retailprice").alias("Y"), (F.col("p_partkey") % 3).alias("i"), (F.col("p_size") % 2).alias("j")
    )
    for i in range(3):
        for j, split in enumerate(IO.SPLITS):
            IO.write_csv(part.where((F.col("i") == i) & (F.col("j") == j)).select("Drug_ID", "Drug", "Y"), f"{root}/{CODES[i]}_{split}.csv")
    found, missing = IO.read_endpoints(spark, root)
    counts = found.groupBy("endpoint", "split").agg(F.count(F.lit(1)).alias("n_rows"), F.lit(False).alias("missing"), F.round(F.sum("Y"), 4).alias("total"))
    gone = missing.select("endpoint", "split", F.lit(0).cast("bigint").alias("n_rows"), F.lit(True).alias("missing"), F.lit(None).cast("double").alias("total"))
    return counts.unionByName(gone)


@query(
    """
    WITH runs(run) AS (VALUES (1), (2)), names(name) AS (VALUES ('parts'), ('absent'), ('narrow'))
    SELECT CAST(run AS INTEGER) AS run, name, CASE WHEN name <> 'parts' THEN 'failed' WHEN run = 1 THEN 'staged' ELSE 'skipped' END AS status,
      CASE WHEN name = 'parts' THEN (SELECT count(*) FROM part) ELSE 0 END AS n_rows
    FROM runs, names
    """
)
def staged_fetch(spark, sf_dir):
    """Staging skips what is there, and goes on past a missing source and one without its columns."""
    root = _scratch(spark, "stage")
    IO.write_csv(_structures(spark, sf_dir), f"{root}/in/parts")
    IO.write_csv(_structures(spark, sf_dir).select("Drug"), f"{root}/in/narrow")
    sources = {"parts": f"{root}/in/parts", "absent": f"{root}/in/nothing", "narrow": f"{root}/in/narrow"}
    runs = [IO.stage(spark, sources, f"{root}/out", required=["Drug", "Y"]).select(F.lit(run).alias("run"), "name", "status") for run in (1, 2)]
    n = IO.count_rows(spark, f"{root}/out/parts.csv")
    return runs[0].unionByName(runs[1]).withColumn("n_rows", F.when(F.col("name") == "parts", F.lit(n)).otherwise(0).cast("bigint"))


@query("SELECT o_orderstatus, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def csv_sink(spark, sf_dir):
    """Rows written as CSV by a partition column, with its value back from the folder names."""
    path = _scratch(spark, "sink")
    IO.write_csv(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, by=["o_orderstatus"])
    back = spark.read.csv(path, header=True, schema="o_orderkey bigint, o_totalprice double, o_orderstatus string")
    return back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT 'documents' AS source, 'Drug' AS smiles_column, 5 AS n_seeds, source AS endpoint, count(*) AS n_rows, max(n_chars) AS longest FROM documents GROUP BY source")
def manifest_json(spark, sf_dir):
    """Manifest written as one JSON object, one entry per dataset."""
    path = _scratch(spark, "manifest")
    counts = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("endpoint")).agg(F.count(F.lit(1)).alias("n_rows"), F.max("n_chars").alias("longest"))
    IO.write_manifest(counts, path, "documents")
    schema = "source string, smiles_column string, prescribed_seeds array<int>, endpoints map<string, struct<n_rows: bigint, longest: bigint>>"
    back = spark.read.schema(schema).json(path)
    one = back.select("source", "smiles_column", F.size("prescribed_seeds").alias("n_seeds"), F.explode("endpoints").alias("endpoint", "e"))
    return one.select("source", "smiles_column", "n_seeds", "endpoint", "e.n_rows", "e.longest")


@query(f"WITH {_FRAMES_SQL} SELECT endpoint, n_rows, duplicate_smiles FROM prof")
def profile_json(spark, sf_dir):
    """Profile written as JSON and its counts read back."""
    path = _scratch(spark, "profile")
    IO.write_profile(_endpoint_profile(spark, sf_dir), path)
    return IO.read_profile(spark, path).select("endpoint", "n_rows", "duplicate_smiles")


@query("SELECT source AS endpoint, count(*) AS n_rows, CASE CAST(substr(source, 4) AS INT) % 2 WHEN 0 THEN count(*) - count(DISTINCT text) END AS duplicate_smiles FROM documents GROUP BY source")
def profile_aliases(spark, sf_dir):
    """Profile files of other writers: counts under other names, or missing."""
    path = _scratch(spark, "aliases")
    docs = read(spark, sf_dir, "documents").select("source", F.xxhash64("text").alias("h"), F.crc32("text").alias("c"))
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h", "c").alias("u"))
    even = F.substring("source", 4, 10).cast("int") % 2 == 0
    entry = F.when(even, F.to_json(F.struct(F.col("n").alias("rows"), (F.col("n") - F.col("u")).alias("dup")))).otherwise(F.to_json(F.struct(F.col("n").alias("n_rows"))))
    # one object over several lines
    body = per.agg(F.concat(F.lit("{\n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "source", F.lit('": '), entry))), ",\n"), F.lit("\n}")).alias("value"))
    body.coalesce(1).write.text(path)
    return IO.read_profile(spark, path)


@query("SELECT round(sum(o_totalprice), 2) AS total, 'o_totalprice' AS used, 1 AS n_missing FROM orders")
def column_aliases(spark, sf_dir):
    """The first alias that a table has, and the required columns that it lacks."""
    orders = read(spark, sf_dir, "orders")
    used = C.first_present(orders, ["price", "o_totalprice", "total"])
    lacking = C.missing_columns(orders, ["o_orderkey", "o_weight", used])
    return orders.agg(F.round(F.sum(used), 2).alias("total"), F.lit(used).alias("used"), F.lit(len(lacking)).alias("n_missing"))


@query("SELECT 'batches' AS name, count(DISTINCT o_orderstatus) AS n_rows FROM orders UNION ALL SELECT unnest(['molecules', 'endpoints', 'model_versions', 'predictions', 'prediction_values']), 0")
def store_tables(spark, sf_dir):
    """Creating the store's tables again leaves their rows alone."""
    name = f"molscreen_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{_scratch(spark, 'store')}'")
    tables = D.create_tables(spark, name)
    rows = read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("timestamp")
    rows.select("o_orderstatus", F.lit("queued"), "n", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), none, none).write.insertInto(f"{name}.batches")
    D.create_tables(spark, name)
    out = [spark.table(f"{name}.{t}").agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n_rows")) for t in tables]
    result = out[0]
    for t in out[1:]:
        result = result.unionByName(t)
    return result


@query("SELECT CAST(vec_id AS VARCHAR) AS ref_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n_bits FROM embeddings WHERE vec_id % 5 <> 0")
def stored_fingerprints(spark, sf_dir):
    """Every stored fingerprint; molecules without one are left out."""
    stored = fingerprints(spark, sf_dir).select(F.col("vec_id").cast("string").alias("inchikey"), F.when(F.col("vec_id") % 5 != 0, F.col("words")).alias("words"))
    return D.all_fingerprints(stored).select("ref_id", B.popcount(F.col("words")).alias("n_bits"))


@query("SELECT o_custkey, o_totalprice, 'found' AS lookup FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) UNION ALL SELECT NULL, NULL, 'error'")
def point_lookup(spark, sf_dir):
    """A key that is there, one that is not, and one that must be."""
    orders = read(spark, sf_dir, "orders")
    first = orders.agg(F.min("o_orderkey")).first()[0]
    hit = O.get(orders, "o_orderkey", first).unionByName(O.find(orders, "o_orderkey", -1))
    try:
        O.get(orders, "o_orderkey", -1)
        raise AssertionError("a missing key was found")
    except LookupError:
        error = spark.range(1).select(F.lit(None).cast("bigint").alias("o_custkey"), F.lit(None).cast("double").alias("o_totalprice"), F.lit("error").alias("lookup"))
    return hit.select("o_custkey", "o_totalprice", F.lit("found").alias("lookup")).unionByName(error)


@query(
    """
    SELECT o_custkey AS key, round(avg(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END), 6) AS y, count(*) AS n_rows
    FROM orders WHERE o_custkey % 4 <> 0 GROUP BY o_custkey
    """
)
def null_keys(spark, sf_dir):
    """Rows without an identity key are dropped before the mean, and NaN is no measurement."""
    key = F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("key")
    y = F.when(F.col("o_orderkey") % 7 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("y")
    rows = read(spark, sf_dir, "orders").select(key, y, F.col("o_orderkey").alias("row_index"))
    return C.dedup_mean(rows, "key", ["y"], [], "row_index").withColumn("y", r6("y"))


@query("SELECT p_partkey, p_partkey % 5 = 0 AS wellformed FROM part")
def feature_row_faults(spark, sf_dir):
    """Feature rows that are short, have two slots or none set, or a flag that is no flag."""
    lit = F.lit
    row = X.atom_row(F.col("p_size") % 9, lit(2), lit(0), lit(1), lit(2), lit(True), lit(False))
    k = F.col("p_partkey") % 5
    at = lambda place, value: F.transform("row", lambda v, i: F.when(i == place, lit(value).cast("float")).otherwise(v))
    broken = F.when(k == 0, F.col("row")).when(k == 1, F.slice("row", 1, 32)).when(k == 2, at(32, 0.5)).when(k == 3, F.transform("row", lambda v: v * 0)).otherwise(F.transform("row", lambda v: v * 0 + 1))
    return read(spark, sf_dir, "part").select("p_partkey", row.alias("row")).select("p_partkey", X.is_wellformed(broken).alias("wellformed"))


@query(
    f"""
    WITH {block_sql()}
    SELECT p_partkey, CASE p_partkey % 7 WHEN 1 THEN 'column_length' WHEN 2 THEN 'offset_count' WHEN 3 THEN 'bonds_not_parallel'
      WHEN 4 THEN 'offsets_decrease' WHEN 5 THEN 'neighbour_out_of_range' END AS error FROM parts WHERE error_code IS NULL AND atoms > 2 AND components = 1
    """
)
def graph_faults(spark, sf_dir):
    """Neighbour lists broken in one way each, and what the checks say."""
    g = R.add_csr(S.parse(block_molecules(spark, sf_dir), "p_partkey", "smiles"))
    g = g.where(F.col("error_code").isNull() & (F.col("n_atoms") > 2) & ~F.col("smiles").contains("."))
    k = F.col("p_partkey") % 7
    change = {
        "charge": F.when(k == 1, F.slice("charge", F.lit(2), F.size("charge"))).otherwise(F.col("charge")),
        "nbr_offsets": F.when(k == 2, F.slice("nbr_offsets", F.lit(2), F.size("nbr_offsets"))).when(k == 4, F.reverse("nbr_offsets")).otherwise(F.col("nbr_offsets")),
        "nbr_bond": F.when(k == 3, F.slice("nbr_bond", F.lit(2), F.size("nbr_bond"))).otherwise(F.col("nbr_bond")),
        "nbr_indices": F.when(k == 5, F.transform("nbr_indices", lambda j: j + 1)).otherwise(F.col("nbr_indices")),
    }
    return g.withColumns(change).select("p_partkey", R.graph_error().alias("error"))


#: Ring bonds stated at neither end, one end, both alike and both unlike: (text, kind of the ring bond, error).
RING_ENDS = [("C1CCCCC1", 0, None), ("C=1CCCCC1", 2, None), ("C1CCCCC=1", 2, None), ("C=1CCCCC=1", 2, None), ("C=1CCCCC#1", None, "ring_bond_mismatch"), ("C%12CCCCC%12", 0, None), ("C#%12CCCCC#%12", 3, None), ("[13CH2-]1CCCC[N+]1", 0, None)]


@query(
    "WITH t AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{t}', {'NULL' if k is None else k}, {'NULL' if e is None else repr(e)})" for i, (t, k, e) in enumerate(RING_ENDS))
    + """) t(i, smiles, kind, error_code))
    SELECT o_orderkey, smiles || repeat('C', o_custkey % 30) AS smiles, CAST(kind AS INTEGER) AS ring_bond, error_code,
      CASE WHEN error_code IS NULL THEN 6 + o_custkey % 30 END AS n_atoms FROM orders JOIN t ON t.i = o_orderkey % 8"""
)
def ring_bonds(spark, sf_dir):
    """Bond kinds stated at the two ends of a ring bond, over chains of many lengths."""
    texts = F.array(*[F.lit(t) for t, _, _ in RING_ENDS])
    text = F.concat(F.get(texts, (F.col("o_orderkey") % 8).cast("int")), F.repeat(F.lit("C"), (F.col("o_custkey") % 30).cast("int")))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", text.alias("smiles"))
    parsed = S.parse(orders.select("smiles").distinct(), "smiles", "smiles")
    ends = F.filter(F.arrays_zip("bond_kind", "bond_order_b"), lambda b: b["bond_order_b"] >= 0)
    said = parsed.select(F.col("smiles").alias("_text"), F.get(ends, F.lit(0))["bond_kind"].alias("ring_bond"), "error_code", big("n_atoms").alias("n_atoms"))
    # eight texts with up to 29 atoms more: a few hundred narrow rows in any table, so the orders are not shuffled
    return orders.join(F.broadcast(said), F.col("smiles").eqNullSafe(F.col("_text"))).drop("_text")


@query(
    f"""
    WITH {block_sql()}
    SELECT error_code IS NULL AS accepted, coalesce(error_code, '') AS reason, count(*) AS n_rows FROM parts GROUP BY ALL
    """
)
def rejected_rows(spark, sf_dir):
    """Rows that parse, and rows set apart with their reason."""
    good, bad = IO.accepted_and_rejected(S.parse(block_molecules(spark, sf_dir), "p_partkey", "smiles"))
    both = good.select(F.lit(True).alias("accepted"), "error_code").unionByName(bad.select(F.lit(False).alias("accepted"), "error_code"))
    return both.groupBy("accepted", F.coalesce("error_code", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"WITH {_FRAMES_SQL} SELECT endpoint, n_rows, over_cap, printf('%.3f%%', 100.0 * over_cap / greatest(n_rows - unparseable, 1)) AS share FROM prof")
def over_cap_report(spark, sf_dir):
    """Report rows of over-cap molecules with their display percentage."""
    return IO.over_cap_table(_endpoint_profile(spark, sf_dir))


def exported_ranking(spark, orders):
    """All orders through the export sink, with their rank by price."""
    path = _scratch(spark, "export")
    values = F.array(F.col("o_totalprice"), F.round(F.col("o_totalprice") / 2, 4))
    IO.export(orders.select("o_orderkey", F.col("o_totalprice").alias("score"), values.alias("values")), path, "v1")
    back = spark.read.csv(path, header=True, escape='"', schema="o_orderkey bigint, score double, values string, model_version string, caveat string")
    parts = F.from_json("values", "array<double>")
    ordered = back.withColumns({"_down": -F.col("score"), "_one": F.lit(1).cast("bigint")})
    ranked = running_sum(ordered, "_down", {"_one": "rank"}, ties=["o_orderkey"])
    return ranked.select(F.col("rank").cast("int").alias("rank"), "o_orderkey", F.get(parts, F.lit(0)).alias("score"), F.get(parts, F.lit(1)).alias("half"), "model_version", F.col("caveat").isNotNull().alias("has_caveat"))


@query(
    """
    WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
    SELECT CAST(rank AS INTEGER) AS rank, o_orderkey, o_totalprice AS score, round(o_totalprice / 2, 4) AS half, 'v1' AS model_version, true AS has_caveat FROM r
    """
)
def export_ranking(spark, sf_dir):
    """A ranking of all orders exported with its endpoint values and read back: nothing is lost."""
    return exported_ranking(spark, read(spark, sf_dir, "orders"))


@query("SELECT count(*) AS rows_done, count(*) FILTER (WHERE event_type = 'error') AS rows_failed FROM events")
def stream_resume(spark, sf_dir):
    """A stream that stops half way and goes on from its checkpoint counts every row once."""
    root, folder = _scratch(spark, "resume-run"), _scratch(spark, "resume-in")
    events = read(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("bad"))
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(folder)
        T.progress_stream(T.file_stream(spark, folder, events.schema), root, "bad").awaitTermination()
    return T.progress(spark, root).agg(F.max("rows_done").alias("rows_done"), F.max("rows_failed").alias("rows_failed"))
