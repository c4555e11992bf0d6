"""Physicochemical descriptors and drug-likeness rules of perceived molecules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molscreen.functions import features as X
from molscreen.operators.molgraph import SINGLE, WEIGHTS

HYDROGEN_WEIGHT = WEIGHTS[1]
# --- fixed values: rule name, descriptor, inclusive limit ---
LIPINSKI = [("MW <= 500", "mol_weight", 500.0), ("cLogP <= 5", "clogp", 5.0), ("HBD <= 5", "hbd", 5.0), ("HBA <= 10", "hba", 10.0)]
VEBER = [("rotatable bonds <= 10", "rotatable_bonds", 10.0), ("TPSA <= 140", "tpsa", 140.0)]


def _count(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda f: f))


def add_descriptors(perceived: DataFrame) -> DataFrame:
    """Add weight, donors, acceptors, rotatable bonds, rings and atom counts.

    Donors are N or O with hydrogen, acceptors N or O; a rotatable bond is a single
    non-ring bond between two non-terminal atoms.  ``tpsa`` is already there from the graph.
    cLogP needs a contribution table this package does not carry, so it is null, and so is
    the rule that uses it.
    """
    table = ", ".join(f"{WEIGHTS[i]}D" if i in WEIGHTS else "NULL" for i in range(max(WEIGHTS) + 1))
    weights = F.expr(f"array({table})")
    heavy = F.aggregate(
        F.transform("number", lambda n: F.get(weights, n)), F.lit(0.0), lambda acc, w: acc + w
    )
    hydrogens = F.aggregate("hs", F.lit(0), lambda acc, h: acc + h)
    polar = lambda n: n.isin(7, 8)
    bonds = F.arrays_zip("bond_a", "bond_b", "bond_kind", "bond_in_ring")
    turns = F.filter(
        bonds,
        lambda b: b["bond_kind"].isin(SINGLE, 6, 7)
        & ~b["bond_in_ring"]
        & (F.get("degree", b["bond_a"]) > 1)
        & (F.get("degree", b["bond_b"]) > 1),
    )
    return perceived.select(
        "*",
        hydrogens.alias("n_hydrogens"),
        (heavy + hydrogens * HYDROGEN_WEIGHT).alias("mol_weight"),
        F.lit(None).cast("double").alias("clogp"),
        _count(F.zip_with("number", "hs", lambda n, h: polar(n) & (h > 0))).alias("hbd"),
        _count(F.transform("number", polar)).alias("hba"),
        F.size(turns).alias("rotatable_bonds"),
        F.col("cycle_rank").alias("ring_count"),
    )


def rule_results(rules: list[tuple[str, str, float]]) -> Column:
    """One (rule, passed, value) per rule, so that the value that decided it is seen."""
    return F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"), (F.col(c) <= limit).alias("passed"), F.col(c).cast("double").alias("value")
            )
            for rule, c, limit in rules
        ]
    )


def add_rules(described: DataFrame) -> DataFrame:
    return described.withColumns({"lipinski": rule_results(LIPINSKI), "veber": rule_results(VEBER)})


def atom_features(perceived: DataFrame) -> Column:
    """The 33-slot feature rows of all atoms of a molecule."""
    atoms = F.arrays_zip("element", "degree", "charge", "hs", "hyb", "aromatic", "in_ring")
    names = ["element", "degree", "charge", "hs", "hyb", "aromatic", "in_ring"]
    return F.transform(atoms, lambda a: X.atom_row(*[a[n] for n in names]))
