"""Named substructure alerts: every match of small patterns in a table of molecules, by joins.

A pattern is a connected graph, given as text like any molecule.  Its bonds are taken one after
the other, the rarest kind among the molecules first and then always one that touches what is
matched already; each step joins the partial matches with the bond table on the molecule and the
atom at which the bond is attached, or checks a bond that closes a ring.  So the first step keeps
few rows, and a molecule without the rarest bond takes no part.

Patterns are the caller's: a list that a person keeps, some hundreds at most, of which the plan
is made on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molscreen.session import materialise


def bond_table(perceived: DataFrame, mol_id: str) -> DataFrame:
    """(mol, a, b, kind): every bond in both directions, with ``ka`` and ``kb``, the kinds of its atoms; stereo marks are single bonds."""
    at = lambda c: F.concat_ws("", F.get("number", c), F.when(F.get("aromatic", c), "a").otherwise(""), F.get("charge", c))
    bond = F.explode(F.arrays_zip("bond_a", "bond_b", "bond_kind")).alias("z")
    rows = perceived.where("error_code is null").select(F.col(mol_id).alias("mol"), "number", "aromatic", "charge", bond)
    a, b = F.col("z.bond_a"), F.col("z.bond_b")
    kind = F.when(F.col("z.bond_kind").isin(6, 7), 1).otherwise(F.col("z.bond_kind"))
    one = rows.select("mol", a.alias("a"), b.alias("b"), kind.alias("kind"), at(a).alias("ka"), at(b).alias("kb"))
    return one.unionByName(one.select("mol", F.col("b").alias("a"), F.col("a").alias("b"), "kind", F.col("kb").alias("ka"), F.col("ka").alias("kb")))


def ordered_bonds(bonds: list[tuple], often: dict[tuple, int]) -> list[tuple]:
    """Directed pattern bonds (a, b, kind, ka, kb): rarest first, each later one from an atom that is matched."""
    left, seen, out = [*bonds], set(), []
    while left:
        able = [x for x in left if not seen or x[0] in seen]
        if not able:
            raise ValueError("a pattern must be connected")
        # a bond between matched atoms only narrows down: at once
        best = min(able, key=lambda x: (x[1] not in seen if seen else False, often.get(x[2:], 0), x))
        out.append(best)
        seen |= {best[0], best[1]}
        left = [x for x in left if {x[0], x[1]} != {best[0], best[1]}]
    return out


def matches(bonds: DataFrame, patterns: DataFrame) -> DataFrame:
    """(mol, pattern): each molecule that holds a pattern, once.

    Both sides are bond tables as :func:`bond_table` makes them, patterns with their name as
    ``mol``.  Atoms match by element, aromaticity and charge, bonds by kind; hydrogens are free.
    """
    plans: dict = {}
    for r in patterns.collect():
        plans.setdefault(r["mol"], []).append((r["a"], r["b"], r["kind"], r["ka"], r["kb"]))
    kind = ["kind", "ka", "kb"]
    wanted = {x[2:] for p in plans.values() for x in p}
    if not wanted:
        return bonds.select("mol", F.lit(None).cast("string").alias("pattern")).limit(0)
    spark = bonds.sparkSession
    # only bonds that some pattern asks for, kept by molecule for all steps
    asked = spark.createDataFrame(sorted(wanted), "kind int, ka string, kb string")
    held = materialise(bonds.join(F.broadcast(asked), kind).repartition("mol"), "bonds")
    often = {tuple(r[c] for c in kind): r["n"] for r in held.groupBy(*kind).agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = {name: ordered_bonds(p, often) for name, p in plans.items()}
    rows = [(str(name), i, *x, x[0] in {v for y in s[:i] for v in y[:2]} and x[1] in {v for y in s[:i] for v in y[:2]}) for name, s in steps.items() for i, x in enumerate(s)]
    table = spark.createDataFrame(rows, "pattern string, step int, pa int, pb int, kind int, ka string, kb string, closes boolean")
    length = {str(name): len(s) for name, s in steps.items()}
    first = held.join(F.broadcast(table.where("step = 0")), kind)
    # atoms of the molecule by atom of the pattern
    now = first.select("mol", "pattern", F.map_from_arrays(F.array("pa", "pb"), F.array("a", "b")).alias("at"))
    found = None
    for i in range(1, max(length.values()) + 1):
        done = [n for n, k in length.items() if k == i]
        ended = now.where(F.col("pattern").isin(done)).select("mol", "pattern").distinct()
        found = ended if found is None else found.unionByName(ended)
        if i == max(length.values()):
            break
        step = table.where(F.col("step") == i).drop("step")
        going = now.join(F.broadcast(step), "pattern").withColumn("_from", F.try_element_at("at", F.col("pa"))).withColumn("_to", F.try_element_at("at", F.col("pb")))
        side = held.select(F.col("mol").alias("_m"), F.col("a").alias("_a"), F.col("b").alias("_b"), *[F.col(c).alias(f"_{c}") for c in kind])
        alike = [going["mol"] == side["_m"], going["_from"] == side["_a"], *[going[c] == side[f"_{c}"] for c in kind]]
        met = going.join(side, alike).where(_fits())
        grown = F.when(F.col("closes"), F.col("at")).otherwise(F.map_concat("at", F.map_from_arrays(F.array(F.when(~F.col("closes"), F.col("pb")).otherwise(-1)), F.array("_b"))))
        now = met.select("mol", "pattern", grown.alias("at"))
    return found


def _fits() -> Column:
    """A closing bond ends at the matched atom, any other at an atom that is not in use."""
    new = ~F.array_contains(F.map_values("at"), F.col("_b"))
    return F.when(F.col("closes"), F.col("_b") == F.col("_to")).otherwise(new)
