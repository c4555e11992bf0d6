"""Parsing, graph properties, identity and scoring of molecules."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from molscreen.operators import canonical as K
from molscreen.operators import csr as R
from molscreen.operators import descriptors as Q
from molscreen.operators import model as L
from molscreen.operators import molgraph as G
from molscreen.operators import smiles as S

DRUGS = [
    "CC(=O)Oc1ccccc1C(=O)O", "CC(=O)Nc1ccc(O)cc1", "Cn1cnc2c1c(=O)[nH]c(=O)n2C", "CC(C)Cc1ccc(cc1)C(C)C(=O)O",
    "CC(C)NCC(O)COc1cccc2ccccc12", "c1ccc2ccccc2c1", "C1CC2CCC1C2", "C12C3C4C1C5C2C3C45", "O=C1C=CC(=O)C=C1",
    "CC(=O)[O-].[Na+]", "C[N+](C)(C)CC(=O)[O-]", "O=S(=O)(c1ccccc1)N1CCOCC1", "FC(F)(F)c1ccc(Cl)c(Br)c1I", "c1ccc(-c2ccccn2)cc1",
    "C1CCC2(CC1)OCCO2", "N#Cc1ccsc1", "[13CH3]C#CC", "OB(O)c1ccccc1",
]


def damaged(n, seed):
    """Valid texts with characters cut, doubled, swapped or cut off."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text = rng.choice(DRUGS)
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(len(text)) if text else 0
            text = rng.choice([text[:i] + text[i + 1 :], text[:i] + text[i : i + 1] * 2 + text[i + 1 :], text[:i] + text[i + 1 : i + 2] + text[i : i + 1] + text[i + 2 :], text[i:], text[:i]])
        out.append(text)
    return out


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, smiles string")
    return S.parse(df, "id", "smiles")


def full(spark, texts):
    rows = K.canonicalise(G.perceive(parsed(spark, texts))).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(texts)))
    return rows


def test_a_text_is_folded_once_however_many_rows_have_it(spark, monkeypatch):
    folded, read = [], S._read
    monkeypatch.setattr(S, "_read", lambda rows: (folded.append(rows.count()), read(rows))[1])
    texts = ["CCO", "C1CC1", None, "C(", ""]
    df = spark.createDataFrame([(i, texts[i % 5]) for i in range(500)] + [(0, "CCO"), (0, "C(")], "id int, smiles string")
    rows = S.parse(df, "id", "smiles").collect()
    assert folded == [5] and len(rows) == 501
    assert [(r.n_atoms, r.error_code) for r in sorted(rows, key=lambda r: r.id)[-5:]] == [(3, None), (3, None), (None, "empty_input"), (None, "unclosed_branch"), (None, "empty_input")]


@pytest.mark.parametrize("distinct_texts", [False, True])
def test_texts_are_not_folded_in_few_tasks(spark, monkeypatch, distinct_texts):
    read = S._read
    monkeypatch.setattr(S, "_read", lambda rows: read(rows.withColumn("task", F.spark_partition_id())))
    df = spark.range(200).select("id", F.concat(F.repeat(F.lit("C"), (F.col("id") % 100 + 1).cast("int")), F.lit("O")).alias("smiles"))
    got = S.parse(df, "id", "smiles", distinct_texts).select("n_atoms", "task").collect()
    assert len(got) == 200 and len({r.task for r in got}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("distinct_texts", [False, True])
def test_a_filter_on_parsed_fields_does_not_copy_the_fold(spark, distinct_texts):
    df = spark.createDataFrame([(0, "CCO"), (1, "C(")], "id int, smiles string")
    bad = S.parse(df, "id", "smiles", **({"distinct_texts": True} if distinct_texts else {})).where("error_code is not null and position is null")
    assert [r.id for r in bad.collect()] == [1]
    assert bad._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_ring_bonds_query_folds_each_text_once(spark, monkeypatch):
    from molscreen.plans.queries_sources import ring_bonds

    folded, read = [], S._read
    monkeypatch.setattr(S, "_read", lambda rows: (folded.append(rows.count()), read(rows))[1])
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    texts = orders.selectExpr("o_orderkey % 8 as i", "o_custkey % 30 as n").distinct().count()
    got = ring_bonds(spark, "/root/testdata/sf0.001")
    assert got.count() == orders.count() and folded == [texts] and texts <= 240


def test_ring_bonds_query_folds_its_texts_in_all_tasks(spark, monkeypatch):
    from molscreen.plans.queries_sources import ring_bonds

    read, parse, out = S._read, S.parse, []
    monkeypatch.setattr(S, "_read", lambda rows: read(rows.withColumn("task", F.spark_partition_id())))
    monkeypatch.setattr(S, "parse", lambda *a: (out.append(parse(*a)), out[0])[1])
    ring_bonds(spark, "/root/testdata/sf0.001")
    assert out[0].select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ring_bonds_query_shuffles_texts_not_orders(spark):
    from molscreen.plans.queries_sources import ring_bonds

    plan = ring_bonds(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    heavy = [line for line in plan.splitlines() if "Exchange" in line or "Aggregate" in line or "Sort" in line]
    # the orders' keys are the only long column (#12L), under whatever name
    assert heavy and not [line for line in heavy if re.search(r"#\d+L", line)] and "BroadcastHashJoin" in plan


def test_attribution_query_hides_atoms_once_per_text(spark, monkeypatch):
    from molscreen.plans import queries_molecules as M
    from molscreen.plans.tables import block_molecules

    hidden, attribute = [], L.attribute
    monkeypatch.setattr(L, "attribute", lambda g, *a: (hidden.append(g.count()), attribute(g, *a))[1])
    monkeypatch.setattr(M, "block_molecules", lambda spark, d: block_molecules(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(100000)))).selectExpr("p_partkey + copy as p_partkey", "smiles"))
    sf_dir = "/root/testdata/sf0.001"
    good = parsed(spark, [r.smiles for r in block_molecules(spark, sf_dir).collect()]).where("error_code is null").cache()
    got = M.atom_attribution(spark, sf_dir)
    assert got.count() == 2 * good.agg(F.sum("n_atoms")).first()[0] and got.distinct().count() == got.count()
    assert hidden == [good.select("smiles").distinct().count()]


def test_damaged_input_gives_a_graph_or_an_error(spark):
    texts = damaged(400, 11)
    rows = parsed(spark, texts).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.error_code is None:
            assert r.n_atoms > 0 and all(0 <= x < r.n_atoms for x in [*r.bond_a, *r.bond_b])
            assert texts[r.id].count("(") == texts[r.id].count(")") and texts[r.id].count("[") == texts[r.id].count("]")
        else:
            assert r.n_atoms is None and r.number is None
    assert sum(r.error_code is not None for r in rows) > 100


def test_errors_carry_positions(spark):
    texts = ["CCC)C", "(CC", "c1ccccc2", "CC(C", "C=1CCCCC#1", "C11", "CXC", "[C", "C[]C", "CC" * 100, "C" * 1001, "C$"]
    got = {r.id: (r.error_code, r.position) for r in parsed(spark, texts).collect()}
    want = [
        ("unbalanced_paren", 3), ("branch_at_start", 0), ("unclosed_ring", None), ("unclosed_branch", None), ("ring_bond_mismatch", None),
        ("self_loop", 2), ("unknown_element", 1), ("unclosed_bracket", 0), ("malformed_bracket", 1), ("too_large", None),
        ("input_too_long", None), ("unexpected_character", 1),
    ]
    assert [got[i] for i in range(len(texts))] == want


def test_known_structures(spark):
    texts = ["CC(=O)Oc1ccccc1C(=O)O", "CC(=O)O", "c1ccccc1C1CCCCC1", "CC(=O)O.[Na+]", "[nH]1cccc1", "[Fe+2]", "[Fe++]", "[O-]", "Cl", "C(.C)C", "C%12CC%12"]
    rows = {r.id: r for r in R.add_csr(parsed(spark, texts)).select("*", R.degree(1).alias("d1"), R.graph_error().alias("bad")).collect()}
    assert (rows[0].n_atoms, rows[0].n_bonds, sum(rows[0].aromatic)) == (13, 13, 6)
    assert (rows[1].n_atoms, rows[1].d1) == (4, 3)
    assert (rows[2].n_atoms, rows[2].n_bonds) == (12, 13)
    assert (rows[3].n_atoms, rows[3].n_bonds) == (5, 3)
    assert rows[4].hs[0] == 1 and [rows[i].charge[0] for i in (5, 6, 7)] == [2, 2, -1]
    assert rows[8].number == [17] and rows[9].n_bonds == 1 and rows[10].n_bonds == 3
    assert all(r.bad is None for r in rows.values())


def test_bond_may_stand_at_either_ring_end(spark):
    a, b, c = full(spark, ["C=1CCCCC1", "C1CCCCC=1", "C=1CCCCC=1"])
    assert a.mol_key == b.mol_key == c.mol_key and sorted(a.bond_kind)[-1] == 2


def test_one_molecule_one_key(spark):
    groups = [
        ["CCO", "OCC", "C(C)O"], ["C1=CC=CC=C1", "c1ccccc1", "c1ccccc1.Cl"], ["c1cc[nH]c1", "C1=CNC=C1"],
        ["N[C@@H](C)C(=O)O", "C[C@H](N)C(O)=O"], ["N[C@H](C)C(=O)O", "[C@@H](N)(C)C(=O)O"], ["F/C=C/F", "F\\C=C\\F"], ["F/C=C\\F"],
        ["C1CCNCC1"], ["[13CH4]"], ["C"], ["CC(=O)O"],
    ]
    rows = full(spark, [t for g in groups for t in g])
    keys, at = [], 0
    for g in groups:
        mine = {r.mol_key for r in rows[at : at + len(g)]}
        assert len(mine) == 1, g
        keys += mine
        at += len(g)
    assert len(set(keys)) == len(groups) and all(len(k) == 27 for k in keys)
    assert len({k[:14] for k in keys[3:5]}) == 1 and len({k[:14] for k in keys[5:7]}) == 1  # stereoisomers share the skeleton


def shuffled(row, rng):
    """The same molecule written with its atoms in random order (constitution only)."""
    n = row.n_atoms
    rank = list(range(n))
    rng.shuffle(rank)
    near = [[] for _ in range(n)]
    for a, b, k in zip(row.bond_a, row.bond_b, row.bond_kind):
        near[a].append((rank[b], b, k))
        near[b].append((rank[a], a, k))
    ptr = np.concatenate([[0], np.cumsum([len(x) for x in near])]).tolist()
    flat = [x for row_ in near for x in sorted(row_)]
    names = [K._bracket(*x) for x in zip(row.number, map(int, row.aromatic), row.charge, row.hs, row.isotope)]
    starts = sorted(range(n), key=lambda i: rank[i])
    return K._write(starts, ptr, [x[1] for x in flat], [x[2] for x in flat], names, list(row.aromatic), lambda *_: None)


def test_key_does_not_depend_on_atom_order(spark):
    rng = random.Random(7)
    rows = full(spark, DRUGS)
    variants = [(i, shuffled(r, rng)) for i, r in enumerate(rows) for _ in range(6)]
    again = full(spark, [t for _, t in variants])
    for (i, text), r in zip(variants, again):
        assert r.error_code is None, (text, r.error_code)
        assert r.mol_key == rows[i].mol_key, (rows[i].smiles, text, r.canonical_smiles, rows[i].canonical_smiles)
        assert r.scaffold == rows[i].scaffold


def test_canonical_text_is_stable(spark):
    texts = DRUGS + ["N[C@@H](C)C(=O)O", "C[C@]1(O)CCCC[C@@H]1N"]
    first = full(spark, texts)
    second = full(spark, [r.canonical_smiles for r in first])
    assert [r.canonical_smiles for r in second] == [r.canonical_smiles for r in first]


def test_scaffolds(spark):
    benzene, toluene, piperidine, ethanol, aspirin, paracetamol, bibenzyl = full(
        spark, ["c1ccccc1", "Cc1ccccc1", "C1CCNCC1", "CCO", "CC(=O)Oc1ccccc1C(=O)O", "CC(=O)Nc1ccc(O)cc1", "c1ccc(cc1)CCc1ccccc1"]
    )
    assert benzene.scaffold == toluene.scaffold == aspirin.scaffold == paracetamol.scaffold != piperidine.scaffold
    assert ethanol.scaffold == "" and sum(bibenzyl.core) == 14 and sum(bibenzyl.in_ring) == 12


def test_components_and_rank(spark):
    salt, naphthalene, joined, cross, acid = full(spark, ["CC(=O)O.[Na+]", "c1ccc2ccccc2c1", "C1.C1", "C1CC2.C1CC2", "OC(C)=O"])
    assert (salt.n_components, salt.canonical_smiles, salt.had_salts) == (2, acid.canonical_smiles, True)
    assert (naphthalene.cycle_rank, joined.n_components, cross.cycle_rank, sum(cross.in_ring)) == (2, 1, 1, 6)


@pytest.mark.parametrize("seed", range(5))
def test_ring_bonds_against_removal(seed):
    rng = random.Random(seed)
    n, mols = 60, []
    for m in range(6):
        lo = m * 10
        mols += [(lo + i, lo + rng.randrange(i)) for i in range(1, 10)] if m else []
        mols += [tuple(rng.sample(range(lo, lo + 10), 2)) for _ in range(m)]
    pairs = sorted({(min(p), max(p)) for p in mols})
    a, b = (np.array(x) for x in zip(*pairs))
    g = G.Graphs(np.arange(n) // 10, 6, {}, a, b, np.ones(len(a), np.int64))
    got = G.ring_bonds(g)
    parts = lambda keep: len(set(G.components(n, a[keep], b[keep]).tolist()))
    whole = np.ones(len(a), bool)
    for e in range(len(a)):
        without = whole.copy()
        without[e] = False
        assert got[e] == (parts(without) == parts(whole))


def test_long_chain_is_one_component():
    n = 10_000
    assert set(G.components(n, np.arange(n - 1), np.arange(1, n)).tolist()) == {0}


def test_benzene_tensors(spark):
    g = G.perceive(parsed(spark, ["c1ccccc1", "CCO", "bad)"]))
    rows = g.select("id", Q.atom_features(g).alias("x"), "hyb").orderBy("id").collect()
    assert len({tuple(r) for r in rows[0].x}) == 1 and rows[2].x is None
    mask = np.ones((1, 6), np.float32)
    adj = L.normalised_adjacency(6, np.zeros(6, int), np.arange(6), (np.arange(6) + 1) % 6, mask)
    assert np.allclose(adj[adj > 0], 1 / 3) and (adj > 0).sum() == 18


def test_padding_does_not_change_outputs(spark):
    w = L.seeded_weights()
    texts = ["CCO", "c1ccccc1", "CC(C)Cc1ccc(cc1)C(C)C(=O)O", "bad)", "[Na+]"]
    rows = G.perceive(parsed(spark, texts)).select("id", L.predict(spark, w).alias("y")).orderBy("id").collect()
    alone = [G.perceive(parsed(spark, [t])).select(L.predict(spark, w).alias("y")).first().y for t in texts]
    assert rows[3].y is None and alone[3] is None
    for r, y in zip(rows, alone):
        assert r.y is None or (len(r.y) == 12 and np.allclose(r.y, y, atol=1e-5))
    # a molecule scores alike alone and next to others, and an atom that is hidden is as good as not pooled
    x = np.random.default_rng(0).random((12, 33)).astype(np.float32)
    a, b = np.array([0, 1, 2, 5, 6]), np.array([1, 2, 3, 6, 7])
    first = np.array([0, 5, 12])
    both = L.forward(w, x, first, a, b)
    one = L.forward(w, x[:5], first[:2], a[:3], b[:3])
    two = L.forward(w, x[5:], np.array([0, 7]), a[3:] - 5, b[3:] - 5)
    assert np.allclose(both, np.concatenate([one, two]), atol=1e-5)
    lone = L.forward(w, x[:5], first[:2], a[:3], b[:3], np.arange(5) != 4)
    assert np.allclose(lone, L.forward(w, x[:4], np.array([0, 4]), a[:3], b[:3]), atol=1e-5)  # atom 4 has no bond


def test_descriptors(spark):
    d = Q.add_rules(Q.add_descriptors(G.perceive(parsed(spark, ["CC(=O)Oc1ccccc1C(=O)O", "CCCCCC"])))).orderBy("id").collect()
    aspirin, hexane = d
    assert abs(aspirin.mol_weight - 180.159) < 0.01 and abs(hexane.mol_weight - 86.178) < 0.01
    assert (aspirin.hbd, aspirin.hba, aspirin.ring_count, aspirin.n_hydrogens) == (1, 4, 1, 8)
    assert (hexane.rotatable_bonds, hexane.hba) == (3, 0)
    texts = ["CC(=O)Nc1ccc(O)cc1", "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "O=[N+]([O-])c1ccccc1", "c1cc[nH]c1", "N#CC[NH3+]"]
    areas = [r.tpsa for r in G.perceive(parsed(spark, texts)).orderBy("id").collect()]
    assert aspirin.tpsa == 63.6 and hexane.tpsa == 0.0 and areas == [49.33, 61.82, 43.14, 15.79, 51.43]
    rules = {r.rule: (r.passed, r.value) for r in aspirin.lipinski + aspirin.veber}
    assert rules["HBA <= 10"] == (True, 4.0) and rules["TPSA <= 140"] == (True, 63.6) and rules["cLogP <= 5"] == (None, None)


def test_attribution_is_per_atom(spark):
    g = G.perceive(parsed(spark, ["CCO", "c1ccccc1"]))
    rows = L.attribute(g, "id", L.seeded_weights(), 0).groupBy("id").agg(F.count("*").alias("n"), F.count_distinct(F.round("contribution", 5)).alias("d")).orderBy("id").collect()
    assert [(r.n) for r in rows] == [3, 6] and rows[1].d == 1  # symmetric atoms contribute alike


def _keys(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, smiles string")
    out = K.canonicalise(G.perceive(S.parse(rows, "i", "smiles"))).select("i", "mol_key", "error_code").collect()
    return [r["mol_key"] for r in sorted(out, key=lambda r: r["i"])]


def _spelling(n, edges, rng):
    """A random spelling of a carbon graph: depth first, ring digits as they come."""
    near = {i: [] for i in range(n)}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    seen, label, used, rings = set(), {}, iter(range(1, 99)), {}
    tree = {}

    def visit(v, parent):
        seen.add(v)
        tree[v] = []
        order = near[v][:]
        rng.shuffle(order)
        for w in order:
            if w == parent:
                continue
            if w in seen:
                if (min(v, w), max(v, w)) not in label:
                    label[(min(v, w), max(v, w))] = f"%{next(used):02d}"
            else:
                tree[v].append(w)
                visit(w, v)

    start = rng.randrange(n)
    visit(start, None)
    for (a, b), text in label.items():
        rings.setdefault(a, []).append(text)
        rings.setdefault(b, []).append(text)

    def write(v):
        children = [write(w) for w in tree[v]]
        return "C" + "".join(rings.get(v, [])) + "".join(f"({c})" for c in children[:-1]) + (children[-1] if children else "")

    return write(start)


FRUCHT = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 0), (0, 7), (1, 7), (2, 8), (3, 9), (4, 9), (5, 10), (6, 10), (7, 11), (8, 11), (8, 9), (10, 11)]
CUNEANE = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 6), (2, 7), (4, 6), (5, 7), (6, 7)]
CUBANE = [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)]


def test_one_key_however_a_cage_is_written(spark):
    rng = random.Random(5)
    groups = [[_spelling(max(map(max, edges)) + 1, edges, rng) for _ in range(25)] for edges in (FRUCHT, CUNEANE, CUBANE)]
    keys = _keys(spark, [t for g in groups for t in g])
    per = [set(keys[i * 25 : i * 25 + 25]) for i in range(3)]
    assert [len(k) for k in per] == [1, 1, 1] and len(set.union(*per)) == 3 and None not in keys


def test_keys_tell_molecules_apart(spark):
    same = [("F/C=C/F", "F\\C=C\\F", "C(/F)=C\\F"), ("F/C=C\\F", "F\\C=C/F"), ("N[C@@H](C)C(=O)O", "C[C@H](N)C(O)=O"), ("N[C@H](C)C(=O)O", "[C@@H](N)(C)C(=O)O"),
            ("C1CCC2CCCCC2C1", "C12CCCCC1CCCC2"), ("C1CCCC1C1CCCC1",), ("[Fe+15]",), ("[Fe+17]",), ("[C+20]",), ("[C+16]",), ("[CH18]",), ("[CH15]",),
            ("CCO", "OCC"), ("[13CH3]CO",), ("c1ccccc1", "C1=CC=CC=C1", "c1ccccc1.[Na+]")]
    keys = iter(_keys(spark, [t for g in same for t in g]))
    per = [{next(keys) for _ in g} for g in same]
    assert all(len(k) == 1 for k in per) and len(set.union(*per)) == len(same)


def test_numbers_out_of_range_are_errors_and_ids_may_repeat(spark):
    rows = [(1, "CCO"), (1, "CN"), (1, "CN"), (2, "[C+1234567890]"), (3, "[CH1234567890123]"), (4, "[C+123456789]")]
    df = spark.createDataFrame(rows, "i int, smiles string")
    got = {(r["i"], r["smiles"]): (r["n_atoms"], r["error_code"], r["charge"]) for r in S.parse(df, "i", "smiles").collect()}
    assert len(got) == 5
    assert got[(1, "CCO")][0] == 3 and got[(1, "CN")][0] == 2
    assert got[(2, "[C+1234567890]")][1] == got[(3, "[CH1234567890123]")][1] == "malformed_bracket"
    assert got[(4, "[C+123456789]")][2] == [123456789]


def test_more_than_ninety_nine_open_rings(spark):
    n = 101
    text = "C" + "".join(f"%({i})C" if i > 99 else f"%{i:02d}C" for i in range(1, n)) + "".join(f"C%({i})" if i > 99 else f"C%{i:02d}" for i in range(1, n))
    row = parsed(spark, ["C%(100)CC%(100)", text]).orderBy("id").collect()
    assert (row[0].n_atoms, row[0].n_bonds) == (3, 3)
    assert row[1].error_code == "too_large"


def _bridged(r):
    """Two rings of r + 2 atoms that share a bond."""
    return [(i, i + 1) for i in range(2 * r + 1)] + [(0, r + 1), (0, 2 * r + 1)]


def _joined(r):
    """Two rings of r + 1 atoms with a bond between them."""
    n = r + 1
    return [(i, (i + 1) % n) for i in range(n)] + [(n + i, n + (i + 1) % n) for i in range(n)] + [(0, n)]


def _petersen(n, k):
    """Generalised Petersen graph: (10, 2) is the dodecahedron, (10, 3) the Desargues graph."""
    return [(i, (i + 1) % n) for i in range(n)] + [(i, n + i) for i in range(n)] + [(n + i, n + (i + k) % n) for i in range(n)]


def test_large_rings_and_cages_of_one_size_differ(spark):
    rng = random.Random(9)
    ladder = [(i, (i + 1) % 10) for i in range(10)] + [(10 + i, 10 + (i + 1) % 10) for i in range(10)] + [(i, 10 + i) for i in range(10)]
    twisted = [(i, i + 1) for i in range(19)] + [(19, 0)] + [(i, i + 10) for i in range(10)]
    shapes = [_bridged(8), _joined(8), _bridged(9), _joined(9), _bridged(30), _joined(30), _petersen(10, 2), _petersen(10, 3), ladder, twisted]
    keys = _keys(spark, [_spelling(max(map(max, e)) + 1, e, rng) for e in shapes for _ in range(4)])
    per = [set(keys[4 * i : 4 * i + 4]) for i in range(len(shapes))]
    assert [len(k) for k in per] == [1] * len(shapes) and len(set.union(*per)) == len(shapes) and None not in keys


def test_rings_of_any_size_differ(spark):
    keys = _keys(spark, [f"C1{'C' * n}C1" for n in range(1, 90)])
    assert len(set(keys)) == 89
