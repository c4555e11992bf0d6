"""Compressed neighbour lists of molecules, their accessors and their invariants."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molscreen.schemas import MAX_HEAVY_ATOMS
from molscreen.session import opaque

CSR = "struct<nbr_offsets:array<int>,nbr_indices:array<int>,nbr_bond:array<int>>"


def _compress(n_atoms: pa.Array, a: pa.Array, b: pa.Array, kind: pa.Array) -> pa.Array:
    """Edge lists to neighbour lists for a whole batch; every bond is stored both ways."""
    n = np.nan_to_num(n_atoms.to_numpy(zero_copy_only=False)).astype(np.int64)
    size = a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first, mol = np.cumsum(n) - n, np.repeat(np.arange(len(n)), size)
    ends = [c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (a, b)]
    bond = kind.flatten().to_numpy(zero_copy_only=False)
    src, dst = np.concatenate(ends), np.concatenate(ends[::-1])
    base = np.concatenate([first[mol], first[mol]])
    order = np.lexsort((dst, src + base))
    degree = np.bincount(src + base, minlength=int(n.sum()))
    running = np.concatenate([[0], np.cumsum(degree)])
    # n + 1 offsets per molecule, counted from the molecule's own first entry
    at = np.arange(int((n + 1).sum())) - np.repeat(np.arange(len(n)), n + 1)
    start = running[first]
    offsets = running[at] - np.repeat(start, n + 1)
    ints = pa.int32()
    per_mol = np.concatenate([[0], np.cumsum(2 * size)])
    lists = [
        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n + 1)]), ints), pa.array(offsets).cast(ints)),
        pa.ListArray.from_arrays(pa.array(per_mol, ints), pa.array(dst[order]).cast(ints)),
        pa.ListArray.from_arrays(pa.array(per_mol, ints), pa.array(np.concatenate([bond, bond])[order]).cast(ints)),
    ]
    return pa.StructArray.from_arrays(lists, ["nbr_offsets", "nbr_indices", "nbr_bond"])


def add_csr(parsed: DataFrame) -> DataFrame:
    """Add nbr_offsets, nbr_indices and nbr_bond; failed molecules have nulls."""
    empty = F.array().cast("array<int>")
    cols = [F.coalesce(F.col(c), empty) for c in ("bond_a", "bond_b", "bond_kind")]
    out = parsed.withColumn("_csr", opaque(_compress, CSR)(F.coalesce("n_atoms", F.lit(0)), *cols))
    ok = F.col("error_code").isNull()
    fields = ("nbr_offsets", "nbr_indices", "nbr_bond")
    return out.select(*parsed.columns, *[F.when(ok, F.col("_csr")[f]).alias(f) for f in fields])


def degree(atom) -> Column:
    i = atom if isinstance(atom, Column) else F.lit(atom)
    return F.get("nbr_offsets", i + 1) - F.get("nbr_offsets", i)


def neighbours(atom) -> Column:
    i = atom if isinstance(atom, Column) else F.lit(atom)
    return F.slice("nbr_indices", F.get("nbr_offsets", i) + 1, degree(i))


def neighbour_bonds(atom) -> Column:
    i = atom if isinstance(atom, Column) else F.lit(atom)
    return F.slice("nbr_bond", F.get("nbr_offsets", i) + 1, degree(i))


def graph_error() -> Column:
    """First broken invariant of a molecule's arrays, or null."""
    n = F.col("n_atoms")
    steps = F.zip_with(F.slice("nbr_offsets", 1, n), F.slice("nbr_offsets", 2, n), lambda a, b: a <= b)
    ragged = F.lit(False)
    for c in ("number", "charge", "hs", "aromatic", "chirality"):
        ragged = ragged | (F.size(c) != n)
    return (
        F.when(n > MAX_HEAVY_ATOMS, "too_large")
        .when(ragged, "column_length")
        .when(F.size("nbr_offsets") != n + 1, "offset_count")
        .when(F.size("nbr_indices") != F.size("nbr_bond"), "bonds_not_parallel")
        .when(~F.forall(steps, lambda s: s), "offsets_decrease")
        .when(~F.forall("nbr_indices", lambda j: (j >= 0) & (j < n)), "neighbour_out_of_range")
    )
