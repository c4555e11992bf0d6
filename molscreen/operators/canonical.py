"""Canonical SMILES, identity keys and scaffolds of perceived molecules."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molscreen.operators.molgraph import (
    AROMATIC,
    ATOM_COLUMNS,
    VALENCES,
    Graphs,
    _dense,
    _refine,
    bond_orders,
    canonical_ranks,
    invariants,
)
from molscreen.operators.labels import add_key
from molscreen.operators.smiles import SYMBOLS
from molscreen.session import opaque

BOND_TEXT = {2: "=", 3: "#", 4: "$"}
DIRECTED = {6: 1, 7: -1}


def usual_hydrogens(number: np.ndarray, aromatic: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Hydrogens a reader adds to an atom written without brackets; -1 where it needs them."""
    out = np.full(len(number), -1)
    used = orders + aromatic
    for z, valences in VALENCES.items():
        at = number == z
        out[at] = 0
        for v in sorted(valences, reverse=True):
            fits = at & (used <= v) & ~((aromatic > 0) & (v > valences[0]))
            out[fits] = v - used[fits]
    return out


def _bracket(number: int, aromatic: int, charge: int, hs: int, isotope: int, tag: str = "") -> str:
    symbol = SYMBOLS[number - 1].lower() if aromatic else SYMBOLS[number - 1]
    hydrogens = ("H" if hs else "") + (str(hs) if hs > 1 else "")
    sign = ("+" if charge > 0 else "-") + (str(abs(charge)) if abs(charge) > 1 else "") if charge else ""
    return f"[{isotope or ''}{symbol}{tag}{hydrogens}{sign}]"


def atom_labels(g: Graphs, stereo: bool) -> list[str]:
    """Text of every atom apart from chirality, built once per distinct kind of atom."""
    at = g.atoms
    total, _ = bond_orders(g)
    isotope = at["isotope"] if stereo else np.zeros(g.n, np.int64)
    plain = (
        (at["hs"] == usual_hydrogens(at["number"], at["aromatic"], total)) & (at["charge"] == 0) & (isotope == 0)
    )
    rows = np.stack([at["number"], at["aromatic"], at["charge"], at["hs"], isotope, plain], axis=1)
    kinds, which = np.unique(rows, axis=0, return_inverse=True)
    texts = []
    for number, aromatic, charge, hs, iso, bare in kinds.tolist():
        symbol = SYMBOLS[number - 1]
        texts.append((symbol.lower() if aromatic else symbol) if bare else _bracket(number, aromatic, charge, hs, iso))
    return [texts[i] for i in which.reshape(-1).tolist()]


def _odd(before: list, after: list) -> bool:
    """Whether going from one order of the same items to the other is an odd permutation."""
    place = [after.index(x) for x in before]
    return sum(place[i] > place[j] for i in range(len(place)) for j in range(i + 1, len(place))) % 2 == 1


def _ring_labels(closures: list[tuple[int, int]]) -> list[int]:
    """Lowest free label for each (opening place, closing place), reused once closed."""
    labels, active = [0] * len(closures), []
    for i in sorted(range(len(closures)), key=lambda c: closures[c]):
        active = [j for j in active if closures[j][1] > closures[i][0]]
        taken = {labels[j] for j in active}
        labels[i] = next(n for n in itertools.count(1) if n not in taken)
        active.append(i)
    return labels


def _write(starts: list[int], ptr: list, dst: list, kind: list, label: list, aromatic: list, chiral) -> str:
    """Depth-first text of the atoms reachable from ``starts``; neighbours come in rank order.

    ``chiral`` gives the label of an atom once the order of its neighbours is known.
    """
    place: dict[int, int] = {}
    parts = []
    for start in starts:
        if start in place:
            continue
        out, closures, ends = [], [], {}
        parent, kids, cursor = {start: -1}, {}, {}

        def bond(a: int, b: int, k: int) -> str:
            both = aromatic[a] and aromatic[b]
            return ("" if both else ":") if k == AROMATIC else BOND_TEXT.get(k, "-" if both else "")

        place[start] = 0
        out.append("")
        lead = {start: ""}
        stack = [start]
        last: dict[int, tuple[int, int]] = {}
        opened: dict[int, int] = {}
        cursor[start] = ptr[start]
        while stack:
            at = stack[-1]
            p = cursor[at]
            if p == ptr[at + 1]:
                stack.pop()
                if at in last:  # the final branch is the main chain
                    out[last[at][0]] = out[last[at][1]] = ""
                if stack:
                    last[stack[-1]] = (opened[at], len(out))
                    out.append(")")
                continue
            cursor[at] = p + 1
            to = dst[p]
            if to == parent[at]:
                continue
            if to in place:
                if place[to] < place[at]:
                    closures.append((place[to], place[at]))
                    ends[len(closures) - 1] = (to, at, kind[p])
                continue
            parent[to] = at
            kids.setdefault(at, []).append(to)
            opened[to] = len(out)
            out.append("(")
            place[to] = len(out)
            lead[to] = bond(at, to, kind[p])
            out.append("")
            cursor[to] = ptr[to]
            stack.append(to)
        digits: dict[int, list] = {}
        for i, n in enumerate(_ring_labels(closures)):
            to, at, k = ends[i]
            text = str(n) if n < 10 else f"%{n}" if n < 100 else f"%({n})"
            # closing digits stand before opening ones
            digits.setdefault(at, []).append((0, place[to], to, bond(to, at, k) + text))
            digits.setdefault(to, []).append((1, place[at], at, text))
        for at in parent:
            ring = sorted(digits.get(at, ()))
            name = chiral(at, parent[at], [d[2] for d in ring] + kids.get(at, [])) or label[at]
            out[place[at]] = lead[at] + name + "".join(d[3] for d in ring)
        parts.append("".join(out))
    return ".".join(sorted(parts))


def _classes(g: Graphs) -> np.ndarray:
    """Symmetry classes: Morgan refinement without tie-breaking."""
    src, dst, edge = g.both_ways()
    return _refine(g.mol, src, dst, g.kind[edge], _dense(g.mol, invariants(g))) if g.n else np.empty(0, np.int64)


class _Batch:
    """Canonical texts of a batch; atoms and bonds are put in canonical order once for all."""

    def __init__(self, g: Graphs, orders: np.ndarray):
        bare = np.where(np.isin(g.kind, (6, 7)), 1, g.kind)
        self.g = flat = Graphs(g.mol, g.n_mols, g.atoms, g.a, g.b, bare)
        rank = canonical_ranks(flat)
        src, dst, edge = flat.both_ways()
        by = np.lexsort((rank[dst], src))
        self.ptr = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=g.n))]).tolist()
        self.dst, self.kind = dst[by].tolist(), bare[edge][by].tolist()
        self.marks = g.kind[edge][by].tolist()
        self.order = np.concatenate([orders[0], orders[1]])[by].tolist()
        self.rank = rank.tolist()
        self.starts = np.lexsort((rank, g.mol)).tolist()
        self.first = g.first.tolist()
        self.aromatic = (g.atoms["aromatic"] > 0).tolist()
        self.marked = np.zeros(g.n_mols, bool)
        self.marked[g.mol[(g.atoms["chirality"] > 0) | (g.atoms["isotope"] > 0)]] = True
        self.sided = np.zeros(g.n_mols, bool)
        self.sided[g.mol[g.a[np.isin(g.kind, (6, 7))]]] = True
        self.classes = _classes(flat).tolist() if self.marked.any() or self.sided.any() else None
        # unmarked molecules with equal code are equal: atoms by rank, then bonds by rank
        columns = [flat.atoms[c] for c in ("number", "charge", "hs", "aromatic", "isotope")]
        code = np.stack(columns, axis=1)[self.starts].astype("<i8")
        lo, hi = np.minimum(rank[g.a], rank[g.b]), np.maximum(rank[g.a], rank[g.b])
        bond_mol = g.mol[g.a]
        self.bond_at = np.searchsorted(bond_mol, np.arange(g.n_mols + 1)).tolist()
        self.codes = code
        self.bond_codes = np.stack([lo, hi, bare], axis=1)[np.lexsort((bare, hi, lo, bond_mol))].astype("<i8")

    def texts(self) -> list[tuple[str, str, str]]:
        """(canonical, constitution only, double-bond sides) per molecule."""
        full, bare = atom_labels(self.g, True), None
        known: dict[bytes, str] = {}
        out = []
        nothing = lambda at, parent, rest: None
        for m in range(self.g.n_mols):
            lo, hi = self.first[m], self.first[m + 1]
            starts = self.starts[lo:hi]
            write = lambda label, chiral: _write(
                starts, self.ptr, self.dst, self.kind, label, self.aromatic, chiral  # noqa: B023
            )
            if not self.marked[m]:
                code = self.codes[lo:hi].tobytes() + b"|" + self.bond_codes[self.bond_at[m] : self.bond_at[m + 1]].tobytes()
                text = known.get(code)
                if text is None:
                    text = known[code] = write(full, nothing)
                plain = text
            else:
                bare = bare or atom_labels(self.g, False)
                text, plain = write(full, self._chiral), write(bare, nothing)
            out.append((text, plain, self._sides(lo, hi) if self.sided[m] else ""))
        return out

    def _near(self, at: int) -> range:
        return range(self.ptr[at], self.ptr[at + 1])

    def _chiral(self, at: int, parent: int, rest: list[int]) -> str | None:
        """Bracket text with the tag for this neighbour order; nothing when not a centre."""
        atoms = self.g.atoms
        tag, hs = int(atoms["chirality"][at]), int(atoms["hs"][at])
        groups = [self.classes[self.dst[p]] for p in self._near(at)]
        if tag not in (1, 2) or hs > 1 or len(groups) + hs != 4 or len(set(groups)) < len(groups):
            return None
        given = sorted((self.order[p], self.dst[p]) for p in self._near(at))
        before, after = [to for _, to in given], ([parent] if parent >= 0 else []) + rest
        if hs:
            before.insert(1 if given[0][0] < 0 else 0, -1)
            after.insert(1 if parent >= 0 else 0, -1)
        turn = 3 - tag if _odd(before, after) else tag
        kind = [int(atoms[c][at]) for c in ("number", "aromatic", "charge", "hs", "isotope")]
        return _bracket(*kind, tag="@" * turn)

    def _sides(self, lo: int, hi: int) -> str:
        """cis/trans of marked double bonds by canonical rank, e.g. ``3=4t``."""
        found = []
        for a in range(lo, hi):
            for p in self._near(a):
                b = self.dst[p]
                if self.kind[p] == 2 and self.rank[a] < self.rank[b]:
                    side = self._side(a, b), self._side(b, a)
                    if all(side):
                        found.append((self.rank[a], self.rank[b], "c" if side[0] == side[1] else "t"))
        return ",".join(f"{i}={j}{s}" for i, j, s in sorted(found))

    def _side(self, at: int, other: int) -> int:
        """Side (+1 or -1) of the lowest-ranked substituent, 0 when not marked or symmetric."""
        rest = [p for p in self._near(at) if self.dst[p] != other]
        if len({self.classes[self.dst[p]] for p in rest}) < len(rest):
            return 0
        for i, p in enumerate(rest):
            if self.marks[p] in DIRECTED:
                # written before the atom: '/' puts the neighbour below, after it: above
                sign = DIRECTED[self.marks[p]] * (-1 if self.order[p] < 0 else 1)
                return sign if i == 0 else -sign
        return 0


CANONICAL = "struct<smiles:string,scaffold:string>"


def _canonical(*columns: pa.Array) -> pa.Array:
    *core_columns, order_a, order_b, component, largest, in_core = columns
    g = Graphs.from_arrow(core_columns)
    flat = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    orders = np.stack([flat(order_a), flat(order_b)])
    biggest = largest.to_numpy(zero_copy_only=False)
    keep = flat(component) == np.nan_to_num(biggest).astype(np.int64)[g.mol]

    def texts(mask: np.ndarray) -> list[tuple[str, str, str]]:
        sub, _ = g.subset(mask)
        return _Batch(sub, orders[:, mask[g.a] & mask[g.b]]).texts()

    smiles = [t[0] for t in texts(keep)]
    # side chains gone, a stereo mark no longer has its neighbours: constitution only
    frame = [t[1] for t in texts(keep & (flat(in_core) > 0))]
    fields = [pa.array(t, pa.string()) for t in (smiles, frame)]
    return pa.StructArray.from_arrays(fields, ["smiles", "scaffold"])


def canonicalise(perceived: DataFrame) -> DataFrame:
    """Add canonical_smiles, mol_key, scaffold, heavy_atoms and n_fragments.

    Of several components the largest one with carbon is kept (salts are stripped).  An
    acyclic molecule has the empty scaffold.
    """
    udf = opaque(_canonical, CANONICAL)
    ints, bools = F.array().cast("array<int>"), F.array().cast("array<boolean>")
    names = [*ATOM_COLUMNS, "bond_a", "bond_b", "bond_kind", "bond_order_a", "bond_order_b", "component"]
    cols = [F.coalesce(F.col(c), bools if c == "aromatic" else ints) for c in names]
    out = add_key(perceived).withColumn("_c", udf(*cols, F.coalesce("largest", F.lit(0)), F.coalesce("core", bools)))
    ok = F.col("error_code").isNull()
    part = lambda f: F.col("_c")[f]
    kept = F.filter("component", lambda c: c == F.col("largest"))
    return out.select(
        *perceived.columns,
        F.when(ok, part("smiles")).alias("canonical_smiles"),
        "mol_key",
        F.when(ok, part("scaffold")).alias("scaffold"),
        F.when(ok, F.size(kept)).alias("heavy_atoms"),
        F.when(ok, F.col("n_components") > 1).alias("had_salts"),
    )
