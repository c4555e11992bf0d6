"""Identity of molecules from refined atom labels.

Every atom starts from its kind and takes on a hash of its own label and its neighbours' sorted
labels until a round tells no more atoms apart.  Nothing depends on the order in which atoms were
written.  Where all labels differ they determine the molecule.  Where atoms still share a label,
each atom is singled out in turn, the labels are refined anew around it, and what comes out (it
holds every distance from that atom, and the sizes of the rings through it, whatever their
length) joins its label before a last refinement.  The key is a digest of the sorted labels.

All of it are Spark expressions but the view from each atom, which has as many labels as pairs
of atoms and is refined for all molecules of an Arrow batch together.

No size is cut off; two molecules share a key only if they look alike from every single atom.
Stereo marks count where the neighbours of a centre, or of a double bond's end, have different
labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molscreen.session import opaque

UP, DOWN = 6, 7  # direction marks among the bond kinds


def _zip(*names: str) -> Column:
    return F.arrays_zip(*names)


def add_neighbours(perceived: DataFrame) -> DataFrame:
    """Add ``_nbr``: per atom its (atom, kind, order, mark) entries; direction marks count as single bonds."""
    bonds = perceived.withColumn("_bonds", _zip("bond_a", "bond_b", "bond_kind", "bond_order_a", "bond_order_b"))

    def entries(i: Column) -> Column:
        at = F.filter("_bonds", lambda b: (b["bond_a"] == i) | (b["bond_b"] == i))

        def entry(b: Column) -> Column:
            first = b["bond_a"] == i
            kind = b["bond_kind"]
            # +1: the neighbour lies above this atom, -1: below
            mark = F.when(kind == UP, F.when(first, 1).otherwise(-1)).when(kind == DOWN, F.when(first, -1).otherwise(1)).otherwise(0)
            return F.struct(
                F.when(first, b["bond_b"]).otherwise(b["bond_a"]).alias("to"),
                F.when(kind.isin(UP, DOWN), 1).otherwise(kind).alias("kind"),
                F.when(first, b["bond_order_a"]).otherwise(b["bond_order_b"]).alias("order"),
                mark.alias("mark"),
            )

        return F.transform(at, entry)

    atoms = F.when(F.col("n_atoms") > 0, F.sequence(F.lit(0), F.col("n_atoms") - 1)).otherwise(F.array().cast("array<int>"))
    return bonds.withColumn("_nbr", F.transform(atoms, entries)).drop("_bonds")


def _refined(seed: Column) -> Column:
    """Labels hashed with the sorted labels around them, until no more atoms are told apart."""
    told = lambda labels: F.size(F.array_distinct(labels))

    def step(acc: Column, _k: Column) -> Column:
        labels = acc["labels"]
        around = lambda near: F.sort_array(F.transform(near, lambda n: F.xxhash64(n["kind"], F.get(labels, n["to"]))))
        new = F.transform("_nbr", lambda near, i: F.xxhash64(F.get(labels, i), around(near)))
        # the count before the round tells at the next one whether anything changed
        done = acc["before"] == acc["told"]
        return F.when(done, acc).otherwise(F.struct(new.alias("labels"), acc["told"].alias("before"), told(new).alias("told")))

    # a stable partition may need as many rounds as there are atoms
    rounds = F.when(F.size(seed) > 0, F.sequence(F.lit(1), F.size(seed))).otherwise(F.array().cast("array<int>"))
    start = F.struct(seed.alias("labels"), F.lit(0).alias("before"), told(seed).alias("told"))
    return F.aggregate(rounds, start, step)["labels"]


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    # --- fixed values of that generator ---
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Labels that are refined at once.
_VIEW_CELLS = 1 << 19


def _views(labels: pa.Array, component: pa.Array, largest: pa.Array, bond_a: pa.Array, bond_b: pa.Array, kind: pa.Array) -> pa.Array:
    """What each atom of the kept component sees: a hash of all labels refined around it; molecules of one size together."""
    flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
    counts = labels.value_lengths().to_numpy(zero_copy_only=False)
    first = np.cumsum(counts) - counts
    mol = np.repeat(np.arange(len(counts)), counts)
    label = flat(labels).view(np.uint64)
    kept = flat(component) == np.repeat(largest.to_numpy(zero_copy_only=False), counts)
    size = np.bincount(mol[kept], minlength=len(counts))
    bonds = bond_a.value_lengths().to_numpy(zero_copy_only=False)
    base = np.repeat(first, bonds)
    a, b, k = flat(bond_a) + base, flat(bond_b) + base, np.where(np.isin(flat(kind), (UP, DOWN)), 1, flat(kind))
    source, target, k = np.concatenate([a, b]), np.concatenate([b, a]), _mix(np.concatenate([k, k]).astype(np.uint64))
    inside = kept[target] if len(target) else np.zeros(0, bool)
    source, target, k = source[inside], target[inside], k[inside]
    out = np.zeros(len(label), np.uint64)
    for n in np.unique(size[size > 1]):
        same = np.flatnonzero(size == n)
        step = max(1, _VIEW_CELLS // int(n * n))
        for at in range(0, len(same), step):
            chosen = np.zeros(len(counts), bool)
            chosen[same[at : at + step]] = True
            atoms = np.flatnonzero(kept & chosen[mol])
            place = np.zeros(len(label), np.int64)
            place[atoms] = np.arange(len(atoms))
            edge = np.flatnonzero(chosen[mol[target]])
            edge = edge[np.argsort(target[edge], kind="stable")]
            starts = np.flatnonzero(np.diff(target[edge], prepend=-1))
            frm, bond = place[source[edge]], k[edge]
            # row i: all labels as seen from the i-th atom of each molecule
            seen = np.tile(label[atoms], (n, 1))
            own = np.arange(len(atoms))
            seen[own % n, own] = _mix(seen[own % n, own] + np.uint64(1))
            for _ in range(n // 2 + 1):  # rings are met halfway from both sides
                seen = _mix(seen) + np.add.reduceat(_mix(seen[:, frm] ^ bond), starts, axis=1)
            views = _mix(_mix(seen).reshape(n, -1, n).sum(axis=2, dtype=np.uint64))
            out[atoms] = views.T.ravel()
    offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(out.view(np.int64)))


def add_labels(perceived: DataFrame) -> DataFrame:
    """Add ``label``: one refined label per atom, equal for symmetric atoms."""
    near = add_neighbours(perceived)
    seed = F.transform(_zip("number", "charge", "hs", "aromatic"), lambda a: F.xxhash64(a["number"], a["charge"], a["hs"], a["aromatic"]))
    first = near.withColumn("_first", _refined(seed))
    tied = F.size(F.array_distinct("_first")) < F.size("_first")
    asked = lambda c, kind: F.when(tied, F.col(c)).otherwise(F.array().cast(f"array<{kind}>"))
    ints = [asked(c, "int") for c in ("component", "bond_a", "bond_b", "bond_kind")]
    views = opaque(_views, "array<bigint>")(asked("_first", "bigint"), ints[0], F.coalesce("largest", F.lit(0)), *ints[1:])
    told = first.withColumn("_views", views)
    joined = F.transform("_first", lambda v, i: F.xxhash64(v, F.get("_views", i)))
    told = told.withColumn("label", F.when(tied, _refined(joined)).otherwise(F.col("_first")))
    return told.drop("_first", "_views")


def _centre(i: Column) -> Column:
    """(label, turn) of a marked tetrahedral centre whose neighbours all differ, else null.

    Neighbours are taken as written, the hydrogen behind the atom that precedes the centre;
    ``turn`` is the mark, exchanged once per pair that stands against the order of labels.
    """
    near = F.get("_nbr", i)
    places = F.transform(near, lambda n: F.struct((n["order"] * 2).alias("at"), F.get("label", n["to"]).alias("label")))
    hydrogen = F.array_repeat(F.struct(F.lit(-1).alias("at"), F.lit(0).cast("bigint").alias("label")), F.get("hs", i))
    given = F.transform(F.sort_array(F.concat(places, hydrogen)), lambda p: p["label"])
    swaps = F.aggregate(
        F.transform(given, lambda x, p: F.size(F.filter(F.slice(given, p + 2, F.size(given)), lambda y: y < x))), F.lit(0), lambda s, n: s + n
    )
    whole = (F.get("chirality", i) > 0) & (F.size(given) == 4) & (F.size(F.array_distinct(given)) == 4)
    return F.when(whole, F.xxhash64(F.get("label", i), (F.get("chirality", i) + swaps) % 2))


def _side(i: Column, other: Column) -> Column:
    """Side of the substituent with the highest label at one end of a double bond; null without a mark or a difference."""
    rest = F.filter(F.get("_nbr", i), lambda n: n["to"] != other)
    ranked = F.reverse(F.sort_array(F.transform(rest, lambda n: F.struct(F.get("label", n["to"]).alias("label"), n["mark"].alias("mark")))))
    labels = F.transform(ranked, lambda r: r["label"])
    top, second = F.get(ranked, F.lit(0))["mark"], F.get(ranked, F.lit(1))["mark"]
    side = F.when(top != 0, top).when(second != 0, -second)
    return F.when(F.size(F.array_distinct(labels)) == F.size(labels), side)


def _double_bonds() -> Column:
    """Hashes of the double bonds with a known side at both ends."""
    doubles = F.filter(_zip("bond_a", "bond_b", "bond_kind"), lambda b: b["bond_kind"] == 2)

    def entry(b: Column) -> Column:
        turn = _side(b["bond_a"], b["bond_b"]) * _side(b["bond_b"], b["bond_a"])
        ends = F.sort_array(F.array(F.get("label", b["bond_a"]), F.get("label", b["bond_b"])))
        return F.struct(b["bond_a"].alias("at"), F.when(turn.isNotNull(), F.xxhash64(ends, turn)).alias("mark"))

    return F.transform(doubles, entry)


def letters(text: Column) -> Column:
    """SHA-256 of a text as upper-case letters (digits map to G..P)."""
    return F.translate(F.upper(F.sha2(text, 256)), "0123456789", "GHIJKLMNOP")


def _text(values: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(values), lambda v: v.cast("string")), " ")


def add_key(perceived: DataFrame) -> DataFrame:
    """Add ``mol_key``: 14 letters of constitution, 10 of isotopes and stereo, for the kept component.

    A digest, not a standard InChIKey, hence the other name; stereoisomers share the first block.
    """
    labelled = add_labels(perceived)
    kept = lambda i: F.get("component", i) == F.col("largest")
    atoms = F.filter(F.transform("label", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda a: kept(a["i"]))
    bonds = F.filter(_zip("bond_a", "bond_b", "bond_kind"), lambda b: kept(b["bond_a"]))
    bond = lambda b: F.xxhash64(
        F.sort_array(F.array(F.get("label", b["bond_a"]), F.get("label", b["bond_b"]))), F.when(b["bond_kind"].isin(UP, DOWN), 1).otherwise(b["bond_kind"])
    )
    plain = F.concat(_text(F.transform(atoms, lambda a: a["v"])), F.lit("|"), _text(F.transform(bonds, bond)))
    isotopes = F.transform(F.filter(atoms, lambda a: F.get("isotope", a["i"]) != 0), lambda a: F.xxhash64(a["v"], F.get("isotope", a["i"])))
    centres = F.filter(F.transform(atoms, lambda a: _centre(a["i"])), lambda c: c.isNotNull())
    doubles = F.transform(F.filter(_double_bonds(), lambda d: d["mark"].isNotNull() & kept(d["at"])), lambda d: d["mark"])
    detail = F.concat_ws("|", F.col("_plain"), _text(isotopes), _text(centres), _text(doubles))
    done = labelled.withColumn("_plain", plain)
    key = F.concat(F.substring(letters(F.col("_plain")), 1, 14), F.lit("-"), F.substring(letters(detail), 1, 10), F.lit("-N"))
    return done.withColumn("mol_key", F.when(F.col("error_code").isNull(), key)).drop("_plain", "_nbr")
