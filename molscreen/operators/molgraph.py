"""Graph properties of parsed molecules, computed for a whole Arrow batch at once.

The arrays of all molecules in a batch are laid end to end, so components, rings,
aromaticity, hydrogens and Morgan refinement are NumPy passes over one large sparse graph.
Spark partitions the molecules; nothing here loops over them one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molscreen.schemas import ELEMENT_ORDER, FP_BITS, FP_RADIUS, FP_WORDS
from molscreen.session import opaque

ATOM_COLUMNS = ["number", "aromatic", "charge", "hs", "isotope", "chirality"]
BOND_COLUMNS = ["bond_a", "bond_b", "bond_kind"]

# --- fixed values: usual valences by atomic number, smallest first ---
VALENCES = {5: [3], 6: [4], 7: [3, 5], 8: [2], 9: [1], 15: [3, 5], 16: [2, 4, 6], 17: [1], 35: [1], 53: [1]}
# --- fixed values: standard atomic weights by atomic number ---
WEIGHTS = {
    1: 1.008, 3: 6.94, 5: 10.81, 6: 12.011, 7: 14.007, 8: 15.999, 9: 18.998, 11: 22.990, 12: 24.305,
    13: 26.982, 14: 28.085, 15: 30.974, 16: 32.06, 17: 35.45, 19: 39.098, 20: 40.078, 25: 54.938,
    26: 55.845, 29: 63.546, 30: 65.38, 33: 74.922, 34: 78.971, 35: 79.904, 53: 126.904, 78: 195.084,
}
# --- fixed values: polar surface contributions (Ertl, Rohde, Selzer 2000) by atomic number,
# aromatic, charge, hydrogens, then single, double, triple and aromatic bonds to heavy atoms ---
POLAR_SURFACE = {
    (7, 0, 0, 0, 3, 0, 0, 0): 3.24, (7, 0, 0, 0, 1, 1, 0, 0): 12.36, (7, 0, 0, 0, 0, 0, 1, 0): 23.79,
    (7, 0, 0, 0, 1, 2, 0, 0): 11.68, (7, 0, 0, 0, 0, 1, 1, 0): 13.60, (7, 0, 0, 1, 2, 0, 0, 0): 12.03,
    (7, 0, 0, 1, 0, 1, 0, 0): 23.85, (7, 0, 0, 2, 1, 0, 0, 0): 26.02, (7, 0, 1, 0, 4, 0, 0, 0): 0.00,
    (7, 0, 1, 0, 2, 1, 0, 0): 3.01, (7, 0, 1, 0, 1, 0, 1, 0): 4.36, (7, 0, 1, 1, 3, 0, 0, 0): 4.44,
    (7, 0, 1, 1, 1, 1, 0, 0): 13.97, (7, 0, 1, 2, 2, 0, 0, 0): 16.61, (7, 0, 1, 2, 0, 1, 0, 0): 25.59,
    (7, 0, 1, 3, 1, 0, 0, 0): 27.64, (7, 1, 0, 0, 0, 0, 0, 2): 12.89, (7, 1, 0, 0, 0, 0, 0, 3): 4.41,
    (7, 1, 0, 0, 1, 0, 0, 2): 4.93, (7, 1, 0, 0, 0, 1, 0, 2): 8.39, (7, 1, 0, 1, 0, 0, 0, 2): 15.79,
    (7, 1, 1, 0, 0, 0, 0, 3): 4.10, (7, 1, 1, 0, 1, 0, 0, 2): 3.88, (7, 1, 1, 1, 0, 0, 0, 2): 14.14,
    (8, 0, 0, 0, 2, 0, 0, 0): 9.23, (8, 0, 0, 0, 0, 1, 0, 0): 17.07, (8, 0, 0, 1, 1, 0, 0, 0): 20.23,
    (8, 0, -1, 0, 1, 0, 0, 0): 23.06, (8, 1, 0, 0, 0, 0, 0, 2): 13.14,
}
SINGLE, DOUBLE, TRIPLE, QUADRUPLE, AROMATIC = 1, 2, 3, 4, 5
ELEMENT_CODES = {6: 0, 7: 1, 8: 2, 16: 3, 9: 4, 17: 5, 35: 6, 53: 7, 15: 8}
SP, SP2, SP3, SP3D, SP3D2, UNKNOWN = range(6)


class Graphs:
    """Molecules of one batch as flat arrays; bond ends index the flat atom arrays."""

    def __init__(self, mol: np.ndarray, n_mols: int, atoms: dict, a: np.ndarray, b: np.ndarray, kind: np.ndarray):
        self.mol, self.n_mols, self.atoms, self.a, self.b, self.kind = mol, n_mols, atoms, a, b, kind
        self.n = len(mol)
        self.counts = np.bincount(mol, minlength=n_mols)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    @classmethod
    def from_arrow(cls, columns: list[pa.Array]) -> Graphs:
        size = lambda c: np.nan_to_num(c.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = lambda c: c.flatten().to_numpy(zero_copy_only=False)
        n_atoms, n_bonds = size(columns[0]), size(columns[len(ATOM_COLUMNS)])
        mol = np.repeat(np.arange(len(n_atoms)), n_atoms)
        base = np.repeat(np.cumsum(n_atoms) - n_atoms, n_bonds)
        atoms = {name: flat(c).astype(np.int64) for name, c in zip(ATOM_COLUMNS, columns)}
        a, b, kind = (flat(c).astype(np.int64) for c in columns[len(ATOM_COLUMNS) :][:3])
        return cls(mol, len(n_atoms), atoms, a + base, b + base, kind)

    def both_ways(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, bond) with every bond in both directions."""
        edge = np.arange(len(self.a))
        return np.concatenate([self.a, self.b]), np.concatenate([self.b, self.a]), np.concatenate([edge, edge])

    def degree(self) -> np.ndarray:
        return np.bincount(self.a, minlength=self.n) + np.bincount(self.b, minlength=self.n)

    def subset(self, keep: np.ndarray) -> tuple[Graphs, np.ndarray]:
        """Graph on the kept atoms; bonds cut off become hydrogens.  Also the kept flat indices."""
        inside = keep[self.a] & keep[self.b]
        place = np.cumsum(keep) - 1
        atoms = {name: col[keep] for name, col in self.atoms.items()}
        order = np.where(np.isin(self.kind, (DOUBLE, TRIPLE, QUADRUPLE)), self.kind, 1)
        lost = np.zeros(self.n, np.int64)
        for here, there in ((self.a, self.b), (self.b, self.a)):
            cut = keep[here] & ~keep[there]
            np.add.at(lost, here[cut], order[cut])
        atoms["hs"] = atoms["hs"] + lost[keep]
        sub = Graphs(
            self.mol[keep], self.n_mols, atoms, place[self.a[inside]], place[self.b[inside]], self.kind[inside]
        )
        return sub, np.flatnonzero(keep)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest atom of each atom's connected component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def cycle_core(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bonds left after pruning atoms of degree 1 until none is left."""
    alive = np.ones(len(a), bool)
    while True:
        deg = np.bincount(a[alive], minlength=n) + np.bincount(b[alive], minlength=n)
        keep = alive & (deg[a] > 1) & (deg[b] > 1)
        if keep.sum() == alive.sum():
            return alive
        alive = keep


def ring_bonds(g: Graphs) -> np.ndarray:
    """Bonds that lie on some cycle.

    In a breadth-first forest of the pruned graph, a tree bond lies on a cycle when a
    non-tree bond leaves the subtree below it.  Each molecule's non-tree bonds are bits of
    a word list; xor-ing them up the tree leaves exactly the bits that leave a subtree.
    """
    core = np.flatnonzero(cycle_core(g.n, g.a, g.b))
    on_cycle = np.zeros(len(g.a), bool)
    if not len(core):
        return on_cycle
    a, b = g.a[core], g.b[core]
    root = components(g.n, a, b)
    level = np.full(g.n, -1)
    parent = np.full(g.n, -1)
    via = np.full(g.n, len(core))
    touched = np.unique(np.concatenate([a, b]))
    level[root[touched]] = 0
    depth = 0
    edge = np.arange(len(core))
    while True:
        grown = False
        for here, there in ((a, b), (b, a)):
            step = (level[here] == depth) & ((level[there] < 0) | (level[there] == depth + 1))
            if step.any():
                grown = True
                level[there[step]] = depth + 1
                np.minimum.at(via, there[step], edge[step])
        if not grown:
            break
        depth += 1
    below = np.flatnonzero(level > 0)
    up = via[below]
    parent[below] = np.where(b[up] == below, a[up], b[up])
    tree = np.zeros(len(core), bool)
    tree[up] = True
    extra = np.flatnonzero(~tree)
    # number the non-tree bonds inside their molecule
    m = g.mol[a[extra]]
    order = np.argsort(m, kind="stable")
    nth = np.empty(len(extra), np.int64)
    sorted_m = m[order]
    nth[order] = np.arange(len(extra)) - np.searchsorted(sorted_m, sorted_m)
    bits = np.zeros((g.n, int(nth.max()) // 64 + 1), np.uint64)
    one = np.uint64(1) << (nth % 64).astype(np.uint64)
    for end in (a[extra], b[extra]):
        np.bitwise_xor.at(bits, (end, nth // 64), one)
    for d in range(depth, 0, -1):
        at = below[level[below] == d]
        np.bitwise_xor.at(bits, parent[at], bits[at])
    covered = np.zeros(len(core), bool)
    covered[extra] = True
    covered[up] = bits[below].any(axis=1)
    on_cycle[core] = covered
    return on_cycle


def _neighbours(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(src, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst[order]


def small_rings(n: int, a: np.ndarray, b: np.ndarray) -> dict[int, np.ndarray]:
    """Five- and six-membered cycles as rows of atoms, each found once."""
    ptr, nbr = _neighbours(np.concatenate([a, b]), np.concatenate([b, a]), n)
    found = {5: np.empty((0, 5), np.int64), 6: np.empty((0, 6), np.int64)}
    paths = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
    for length in range(3, 8):
        if not len(paths):
            break
        last = paths[:, -1]
        fan = ptr[last + 1] - ptr[last]
        rows = np.repeat(np.arange(len(paths)), fan)
        step = np.arange(len(rows)) - np.repeat(np.cumsum(fan) - fan, fan)
        nxt = nbr[ptr[last][rows] + step]
        if length - 1 in found:
            # back at the start; one of the two directions is kept
            closes = (nxt == paths[rows, 0]) & (paths[rows, 1] < paths[rows, -1])
            found[length - 1] = paths[rows[closes]]
        onward = (nxt > paths[rows, 0]) & (nxt[:, None] != paths[rows]).all(axis=1)
        paths = np.concatenate([paths[rows[onward]], nxt[onward, None]], axis=1)
    return found


def bond_orders(g: Graphs) -> tuple[np.ndarray, np.ndarray]:
    """Per atom: sum of integer bond orders, and number of double bonds."""
    order = np.where(np.isin(g.kind, (DOUBLE, TRIPLE, QUADRUPLE)), g.kind, 1)
    total, doubles = np.zeros(g.n, np.int64), np.zeros(g.n, np.int64)
    for end in (g.a, g.b):
        np.add.at(total, end, order)
        np.add.at(doubles, end[g.kind == DOUBLE], 1)
    return total, doubles


def fill_hydrogens(g: Graphs) -> None:
    """Implicit hydrogens of organic-subset atoms from the smallest valence that fits."""
    total, _ = bond_orders(g)
    aromatic = g.atoms["aromatic"] > 0
    used = total + aromatic
    left = np.zeros(g.n, np.int64)
    for number, valences in VALENCES.items():
        at = g.atoms["number"] == number
        for v in sorted(valences, reverse=True):
            fits = at & (used <= v) & ~(aromatic & (v > valences[0]))
            left[fits] = v - used[fits]
    g.atoms["hs"] = np.where(g.atoms["hs"] < 0, np.maximum(left, 0), g.atoms["hs"])


def perceive_aromaticity(g: Graphs, on_cycle: np.ndarray) -> None:
    """Mark five- and six-membered rings with six pi electrons, however they were written."""
    number, charge, deg = g.atoms["number"], g.atoms["charge"], g.degree()
    ring_double, outer_double = np.zeros(g.n, bool), np.zeros(g.n, np.int64)
    hetero = np.isin(number, (7, 8, 16))
    for here, there in ((g.a, g.b), (g.b, g.a)):
        double = g.kind == DOUBLE
        ring_double[here[double & on_cycle]] = True
        # electrons drawn out by a hetero atom leave 0; any other exocyclic double bond bars the ring
        outer = double & ~on_cycle
        np.maximum.at(outer_double, here[outer], np.where(hetero[there[outer]] & (number[here[outer]] == 6), 1, 2))
    aromatic = g.atoms["aromatic"] > 0
    pair = (np.isin(number, (7, 15)) & (charge == 0) & (deg + g.atoms["hs"] == 3)) | (
        np.isin(number, (8, 16, 34)) & (charge == 0) & (deg == 2)
    )
    pi = np.full(g.n, -100)
    pi[pair | ((number == 6) & (charge == -1))] = 2
    pi[((number == 6) & (charge == 1)) | (number == 5)] = 0
    pi[ring_double | (aromatic & ~pair)] = 1
    pi[(outer_double == 1) & ~ring_double] = 0
    pi[outer_double == 2] = -100
    usable = on_cycle & (pi[g.a] >= 0) & (pi[g.b] >= 0)
    for rings in small_rings(g.n, g.a[usable], g.b[usable]).values():
        hit = rings[pi[rings].sum(axis=1) == 6] if len(rings) else rings
        if not len(hit):
            continue
        aromatic[hit] = True
        ends = np.stack([hit, np.roll(hit, -1, axis=1)], axis=2).reshape(-1, 2)
        ring_pairs = np.unique(np.minimum(ends[:, 0], ends[:, 1]) * g.n + np.maximum(ends[:, 0], ends[:, 1]))
        codes = np.minimum(g.a, g.b) * g.n + np.maximum(g.a, g.b)
        g.kind[np.isin(codes, ring_pairs)] = AROMATIC
    g.atoms["aromatic"] = aromatic.astype(np.int64)


def resolve_bonds(g: Graphs, on_cycle: np.ndarray) -> None:
    """Unstated bonds: aromatic between aromatic ring neighbours, else single."""
    lower = g.atoms["aromatic"] > 0
    inside = on_cycle & lower[g.a] & lower[g.b]
    g.kind = np.where(g.kind == 0, np.where(inside, AROMATIC, SINGLE), g.kind)


def hybridisation(g: Graphs) -> np.ndarray:
    total, doubles = bond_orders(g)
    triple = np.zeros(g.n, bool)
    for end in (g.a, g.b):
        triple[end[g.kind == TRIPLE]] = True
    sigma = g.degree() + np.maximum(g.atoms["hs"], 0)
    out = np.full(g.n, SP3)
    out[(doubles > 0) | (g.atoms["aromatic"] > 0)] = SP2
    out[(triple | (doubles > 1)) & np.isin(g.atoms["number"], (6, 7))] = SP
    out[(sigma == 5) & (g.atoms["number"] == 15)] = SP3D
    out[(sigma == 6) & (g.atoms["number"] == 16)] = SP3D2
    out[~np.isin(g.atoms["number"], list(VALENCES))] = UNKNOWN
    return out


def polar_surface(g: Graphs) -> np.ndarray:
    """Topological polar surface area of each molecule from N and O contributions."""
    kinds = np.where(np.isin(g.kind, (6, 7)), SINGLE, g.kind)
    counts = np.zeros((g.n, 6), np.int64)
    for end in (g.a, g.b):
        np.add.at(counts, (end, kinds), 1)
    at = g.atoms
    columns = [at["number"], at["aromatic"], at["charge"], at["hs"], *counts[:, [SINGLE, DOUBLE, TRIPLE, AROMATIC]].T]
    polar = np.flatnonzero(np.isin(at["number"], (7, 8)))
    kind = np.stack([c[polar] for c in columns], axis=1)
    area = np.zeros(len(polar))
    for key, value in POLAR_SURFACE.items():
        area[(kind == key).all(axis=1)] = value
    return np.round(np.bincount(g.mol[polar], weights=area, minlength=g.n_mols), 2)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (multiply and shift), applied element by element."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def invariants(g: Graphs, on_cycle: np.ndarray | None = None) -> np.ndarray:
    """Numbering-independent seed of each atom, as one integer."""
    ring = np.zeros(g.n, np.int64)
    if on_cycle is not None:
        for end in (g.a, g.b):
            ring[end[on_cycle]] = 1
    code = np.zeros(g.n, np.uint64)
    for name in ("number", "charge", "hs", "aromatic", "isotope"):
        code = _mix(code * np.uint64(31) + g.atoms[name].astype(np.uint64))
    code = _mix(_mix(code * np.uint64(31) + g.degree().astype(np.uint64)) * np.uint64(31) + ring.astype(np.uint64)).view(np.int64)
    return code


def _dense(mol: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Rank inside the molecule by ``keys``: how many of its atoms sort before this class."""
    order = np.lexsort((*keys[::-1], mol))
    change = np.ones(len(mol), bool)
    same = np.ones(len(mol) - 1, bool) if len(mol) else np.empty(0, bool)
    for k in (mol, *keys):
        same &= k[order][1:] == k[order][:-1]
    change[1:] = ~same
    start = np.maximum.accumulate(np.where(change, np.arange(len(mol)), 0))
    out = np.empty(len(mol), np.int64)
    sorted_mol = mol[order]
    out[order] = start - np.searchsorted(sorted_mol, sorted_mol)
    return out


def _refine(mol, src, dst, kind, rank) -> np.ndarray:
    """Morgan refinement until no molecule gains a class."""
    classes = -1
    while True:
        message = _mix(rank[dst].astype(np.uint64) * np.uint64(8) + kind.astype(np.uint64) + np.uint64(1))
        around = np.zeros(len(mol), np.uint64)
        np.add.at(around, src, message)
        rank = _dense(mol, rank, around)
        now = len(np.unique(mol * (len(mol) + 1) + rank))
        if now == classes or now == len(mol):
            return rank
        classes = now


def canonical_ranks(g: Graphs, on_cycle: np.ndarray | None = None) -> np.ndarray:
    """Canonical order of the atoms of each molecule (0-based, no ties).

    Ties that refinement leaves are broken by lifting one atom of the smallest tied class
    and refining again; only molecules that still have ties take part.
    """
    if not g.n:
        return np.empty(0, np.int64)
    src, dst, edge = g.both_ways()
    kind = g.kind[edge]
    rank = _refine(g.mol, src, dst, kind, _dense(g.mol, invariants(g, on_cycle)))
    while True:
        code = g.mol * (g.n + 1) + rank
        uniq, inverse, size = np.unique(code, return_inverse=True, return_counts=True)
        tied = np.flatnonzero(size[inverse] > 1)
        if not len(tied):
            return rank
        # per tied molecule: the lowest tied rank, and its first atom
        order = tied[np.lexsort((tied, rank[tied], g.mol[tied]))]
        _, lead = np.unique(g.mol[order], return_index=True)
        chosen = order[lead]
        target = np.full(g.n_mols, -1)
        target[g.mol[chosen]] = rank[chosen]
        lift = rank == target[g.mol]
        lift[chosen] = False
        rank = rank + lift
        # refine only the molecules that were tied
        active = target[g.mol] >= 0
        place = np.cumsum(active) - 1
        e = active[src]
        rank[active] = _refine(g.mol[active], place[src[e]], place[dst[e]], kind[e], rank[active])


def fingerprints(g: Graphs, on_cycle: np.ndarray, radius: int = FP_RADIUS) -> np.ndarray:
    """Circular fingerprints: hashed environments up to ``radius`` folded to 2048 bits."""
    words = np.zeros((g.n_mols, FP_WORDS), np.uint64)
    src, dst, edge = g.both_ways()
    # a direction mark belongs to the spelling, not to the bond
    kind = np.where(np.isin(g.kind, (6, 7)), SINGLE, g.kind)
    h = _mix(invariants(g, on_cycle).astype(np.uint64))
    for r in range(radius + 1):
        bit = (h % np.uint64(FP_BITS)).astype(np.int64)
        np.bitwise_or.at(words, (g.mol, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        around = np.zeros(g.n, np.uint64)
        np.add.at(around, src, _mix(h[dst] + kind[edge].astype(np.uint64)))
        h = _mix(h * np.uint64(31) + around + np.uint64(r + 1))
    return words


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values).cast(kind))


PERCEIVED = (
    "struct<hs:array<int>,aromatic:array<boolean>,in_ring:array<boolean>,hyb:array<int>,degree:array<int>,"
    "element:array<int>,component:array<int>,core:array<boolean>,bond_kind:array<int>,"
    "bond_in_ring:array<boolean>,n_components:int,cycle_rank:int,largest:int,tpsa:double,words:array<bigint>>"
)


def _perceive(*columns: pa.Array) -> pa.Array:
    g = Graphs.from_arrow(list(columns))
    on_cycle = ring_bonds(g)
    resolve_bonds(g, on_cycle)
    fill_hydrogens(g)
    perceive_aromaticity(g, on_cycle)
    root = components(g.n, g.a, g.b)
    ring_atom, core_atom = np.zeros(g.n, bool), np.zeros(g.n, bool)
    core = cycle_core(g.n, g.a, g.b)
    for end in (g.a, g.b):
        ring_atom[end[on_cycle]] = True
        core_atom[end[core]] = True
    is_root = root == np.arange(g.n)
    n_comp = np.bincount(g.mol[is_root], minlength=g.n_mols)
    n_bonds = np.bincount(g.mol[g.a], minlength=g.n_mols)
    size = np.bincount(root, minlength=g.n)
    # biggest component, ties to the lowest atom; organic ones (with carbon) first
    carbon = np.zeros(g.n, bool)
    carbon[root[g.atoms["number"] == 6]] = True
    roots = np.flatnonzero(is_root)
    best = roots[np.lexsort((roots, -size[roots], ~carbon[roots], g.mol[roots]))]
    mols, lead = np.unique(g.mol[best], return_index=True)
    largest = np.zeros(g.n_mols, np.int64)
    largest[mols] = best[lead] - g.first[mols]
    element = np.full(g.n, len(ELEMENT_ORDER) - 1)
    for number, code in ELEMENT_CODES.items():
        element[g.atoms["number"] == number] = code
    bond_at = np.concatenate([[0], np.cumsum(n_bonds)])
    local_root = root - g.first[g.mol] if g.n else root
    ints, bools = pa.int32(), pa.bool_()
    fields = {
        "hs": _lists(g.atoms["hs"], g.first, ints),
        "aromatic": _lists(g.atoms["aromatic"] > 0, g.first, bools),
        "in_ring": _lists(ring_atom, g.first, bools),
        "hyb": _lists(hybridisation(g), g.first, ints),
        "degree": _lists(g.degree(), g.first, ints),
        "element": _lists(element, g.first, ints),
        "component": _lists(local_root, g.first, ints),
        "core": _lists(core_atom, g.first, bools),
        "bond_kind": _lists(g.kind, bond_at, ints),
        "bond_in_ring": _lists(on_cycle, bond_at, bools),
        "n_components": pa.array(n_comp, ints),
        "cycle_rank": pa.array(n_bonds - g.counts + n_comp, ints),
        "largest": pa.array(largest, ints),
        "tpsa": pa.array(polar_surface(g), pa.float64()),
        "words": _lists(
            fingerprints(g, on_cycle).reshape(-1).view(np.int64), np.arange(g.n_mols + 1) * FP_WORDS, pa.int64()
        ),
    }
    return pa.StructArray.from_arrays(list(fields.values()), list(fields))


def perceive(parsed: DataFrame) -> DataFrame:
    """Parsed molecules with everything their graph implies.

    Adds hydrogens, aromaticity, ring membership, hybridisation, components, scaffold mask
    (``core``) and a 2048-bit circular fingerprint.  Failed molecules keep
    their error and have nulls.
    """
    graph = opaque(_perceive, PERCEIVED)
    empty_bool, empty_int = F.array().cast("array<boolean>"), F.array().cast("array<int>")
    cols = [
        F.coalesce(F.col(c), empty_bool if c == "aromatic" else empty_int) for c in ATOM_COLUMNS + BOND_COLUMNS
    ]
    replaced = {"hs", "aromatic", "bond_kind"}
    rest = [c for c in parsed.columns if c not in replaced]
    out = parsed.withColumn("_g", graph(*cols))
    ok = F.col("error_code").isNull()
    fields = [f.split(":")[0] for f in PERCEIVED[7:-1].replace("array<", "").split(",")]
    return out.select(*rest, *[F.when(ok, F.col("_g")[f]).alias(f) for f in fields])
