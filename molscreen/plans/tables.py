"""The driver tables, and molecule-like columns that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molscreen.functions import bits as B
from molscreen.operators.similarity import sign_words


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(col: Column | str) -> Column:
    """Rounded to 6 places, so that summation order cannot show in a comparison."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def big(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, words, n_bits): sign bits of the embeddings, one word per 64 values."""
    e = read(spark, sf_dir, "embeddings")
    words = e.select("vec_id", "label", sign_words("embedding").alias("words"))
    return words.withColumn("n_bits", B.popcount(F.col("words")))


def endpoint_values(spark: SparkSession, sf_dir: str, endpoints: DataFrame) -> DataFrame:
    """Tall (prediction_id, endpoint, output_index, value): twelve values per order.

    Values are spread over each curve's working range by a fixed integer rule.
    """
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    meta = endpoints.select("code", "output_index", "low", "high").collect()  # twelve rows
    structs = []
    for m in meta:
        u = F.pmod(F.col("o_orderkey") * (7 + 2 * m["output_index"]) + 13 * m["output_index"], F.lit(1000)) / 999.0
        lo, hi = (0.0, 1.0) if m["low"] is None else (m["low"], m["high"])
        value = lo + (u * 1.5 - 0.25) * (hi - lo)
        structs.append(
            F.struct(
                F.lit(m["code"]).alias("endpoint"),
                F.lit(m["output_index"]).alias("output_index"),
                value.alias("value"),
            )
        )
    tall = orders.select(F.col("o_orderkey").alias("prediction_id"), F.explode(F.array(*structs)).alias("v"))
    return tall.select("prediction_id", "v.endpoint", "v.output_index", "v.value")


# Building blocks of the molecules that Spark derives from the part and order tables.
# Each row: text, atoms, rings, aromatic atoms, hydrogens when free, N or O atoms.
PREFIXES = [
    ("", 0, 0, 0, 0, 0), ("C", 1, 0, 0, 4, 0), ("CC", 2, 0, 0, 6, 0), ("O", 1, 0, 0, 2, 1), ("N", 1, 0, 0, 3, 1),
    ("Cl", 1, 0, 0, 1, 0), ("CC(=O)O", 4, 0, 0, 4, 2), ("FC(F)(F)", 4, 0, 0, 1, 0), ("CN(C)", 3, 0, 0, 7, 1),
    ("OC(=O)", 3, 0, 0, 2, 2),
]
CORES = [
    ("c1ccccc1", 6, 1, 6, 6, 0), ("C1CCCCC1", 6, 1, 0, 12, 0), ("c1ccncc1", 6, 1, 6, 5, 1), ("C1CCNCC1", 6, 1, 0, 11, 1),
    ("c1ccc2ccccc2c1", 10, 2, 10, 8, 0), ("C1CC1", 3, 1, 0, 6, 0), ("C2=CC=CC=C2", 6, 1, 6, 6, 0),
    ("c3cc[nH]c3", 5, 1, 5, 5, 1), ("CCCC", 4, 0, 0, 10, 0), ("C1CCC2(CC1)CCCC2", 10, 2, 0, 18, 0),
]
SUFFIXES = [
    ("", 0, 0, 0, 0, 0), ("C", 1, 0, 0, 4, 0), ("O", 1, 0, 0, 2, 1), (".[Na+]", 1, 0, 0, 0, 0), (".Cl", 1, 0, 0, 1, 0),
    ("C(=O)O", 3, 0, 0, 2, 2), ("C#N", 2, 0, 0, 1, 1), ("C1CC1", 3, 1, 0, 6, 0), ("(", 0, 0, 0, 0, 0), (")", 0, 0, 0, 0, 0),
    ("3", 0, 0, 0, 0, 0), ("[Xx]", 0, 0, 0, 0, 0),
]
# Several spellings of one molecule per row, salts included.
SPELLINGS = [
    ("CCO", "OCC", "C(C)O"),
    ("CC(=O)Oc1ccccc1C(=O)O", "OC(=O)c1ccccc1OC(C)=O", "O=C(C)Oc1ccccc1C(O)=O"),
    ("c1ccccc1", "C1=CC=CC=C1", "c1ccccc1.[Na+]"),
    ("Cn1cnc2c1c(=O)[nH]c(=O)n2C", "CN1C=NC2=C1C(=O)NC(=O)N2C", "Cn1c(=O)[nH]c(=O)c2c1ncn2C"),
    ("N[C@@H](C)C(=O)O", "C[C@H](N)C(O)=O", "OC(=O)[C@H](C)N"),
    ("N[C@H](C)C(=O)O", "C[C@@H](N)C(O)=O", "[C@@H](N)(C)C(=O)O"),
    ("F/C=C/F", "F\\C=C\\F", "C(/F)=C\\F"),
    ("F/C=C\\F", "F\\C=C/F", "C(/F)=C/F"),
    ("c1ccc2ccccc2c1", "C1=CC2=CC=CC=C2C=C1", "c1cccc2c1cccc2"),
]


def _pick(options: list[str], index: Column) -> Column:
    texts = ", ".join(f'r"{o}"' for o in options)
    return F.get(F.expr(f"array({texts})"), index.cast("int"))


def block_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, smiles): one molecule per part, some of them malformed."""
    k, z = F.col("p_partkey"), F.col("p_size")
    text = F.concat(
        _pick([p[0] for p in PREFIXES], k % 10),
        _pick([c[0] for c in CORES], z % 10),
        _pick([s[0] for s in SUFFIXES], F.floor(k / 10) % 12),
    )
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("smiles"))


def spelled_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, class, smiles): one spelling of a known molecule per order."""
    k = F.col("o_orderkey")
    cls, form = k % len(SPELLINGS), F.floor(k / len(SPELLINGS)) % 3
    text = _pick([s for row in SPELLINGS for s in row], cls * 3 + form)
    return read(spark, sf_dir, "orders").select("o_orderkey", cls.alias("class"), text.alias("smiles"))


def ring_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, r, shape, smiles): two rings of equal size per part, with a common bond or a bond between them.

    Both shapes of one ``r`` have the same atoms, and each is written from several atoms.
    """
    k, r = F.col("p_partkey"), F.col("p_size") + 1
    chain = lambda n: F.repeat(F.lit("C"), n.cast("int"))
    at = F.pmod(F.col("p_partkey"), r - 1)  # atoms before the branching one
    rest = r - 2 - at
    shared = F.concat(F.lit("C1"), chain(at), F.lit("C2"), chain(r), F.lit("C2"), chain(rest), F.lit("C1"))
    joined = F.concat(F.lit("C1"), chain(at), F.lit("C(C2"), chain(r - 1), F.lit("C2)"), chain(rest), F.lit("C1"))
    shape = F.floor(k / 7) % 2
    text = F.when(shape == 0, shared).otherwise(joined)
    return read(spark, sf_dir, "part").select("p_partkey", r.alias("r"), shape.alias("shape"), text.alias("smiles"))


def block_sql() -> str:
    """The derived molecules' composition in SQL, from the same block lists."""

    def table(name: str, rows: list[tuple]) -> str:
        values = ", ".join(f"({i}, '{r[0]}', {', '.join(map(str, r[1:]))})" for i, r in enumerate(rows))
        return f"{name}(i, t, atoms, rings, aromatic, h, polar) AS (VALUES {values})"

    return f"""{table("pre", PREFIXES)}, {table("core", CORES)}, {table("suf", SUFFIXES)},
      parts AS (
        SELECT p_partkey, pre.t || core.t || suf.t AS smiles, length(pre.t || core.t) AS spot, suf.t AS tail, core.i AS core_i, suf.i AS suf_i, pre.i AS pre_i,
          CASE suf.t WHEN '(' THEN 'unclosed_branch' WHEN ')' THEN 'unbalanced_paren' WHEN '3' THEN 'unclosed_ring' WHEN '[Xx]' THEN 'unknown_element' END AS error_code,
          pre.atoms + core.atoms + suf.atoms AS atoms, pre.rings + core.rings + suf.rings AS rings, core.aromatic AS aromatic,
          CASE WHEN suf.t LIKE '.%' THEN 2 ELSE 1 END AS components,
          (CASE WHEN pre.atoms > 0 THEN 1 ELSE 0 END) + (CASE WHEN suf.atoms > 0 AND suf.t NOT LIKE '.%' THEN 1 ELSE 0 END) AS links,
          pre.h + core.h + suf.h AS free_h, pre.polar + core.polar + suf.polar AS polar,
          CASE WHEN core.rings > 0 THEN core.atoms ELSE 0 END + CASE WHEN suf.rings > 0 THEN suf.atoms ELSE 0 END AS frame_atoms
        FROM part JOIN pre ON pre.i = p_partkey % 10 JOIN core ON core.i = p_size % 10 JOIN suf ON suf.i = (p_partkey // 10) % 12)"""
