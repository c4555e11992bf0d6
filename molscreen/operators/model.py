"""Scoring molecules with a graph network or an exported model, and atom attribution.

The network passes messages along bond lists; without a caller's weights it has seeded random
ones, which exercise the scoring path and predict nothing.  Exported models get padded tensors,
built inside the task (an adjacency matrix of 128 atoms is 64 KiB per molecule).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molscreen.functions.features import MAX_CHARGE, MIN_CHARGE, SP3, UNKNOWN_HYBRIDISATION
from molscreen.schemas import FEATURE_BLOCKS, MAX_HEAVY_ATOMS, MICRO_BATCH, N_ATOM_FEATURES, N_ENDPOINTS
from molscreen.session import opaque

GRAPH_COLUMNS = ["element", "degree", "charge", "hs", "hyb", "aromatic", "in_ring", "bond_a", "bond_b"]
HIDDEN = 96
ROUNDS = 3


def seeded_weights(seed: int = 7, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Weights of the untrained network, for trying out the path around it; a caller brings trained ones under the same names.

    A trained batch normalisation is folded into the layer before it.
    """
    rng = np.random.default_rng(seed)
    sizes = {"read.in": (2 * hidden, hidden), "read.out": (hidden, N_ENDPOINTS)}
    for i in range(ROUNDS):
        sizes |= {f"round{i}.in": (hidden if i else N_ATOM_FEATURES, hidden), f"round{i}.out": (hidden, hidden)}
    out = {}
    for name, (rows, columns) in sizes.items():
        out[f"{name}.weight"] = rng.normal(0, rows**-0.5, (rows, columns)).astype(np.float32)
        out[f"{name}.bias"] = np.zeros(columns, np.float32)
    return out


def _layer(w: dict, name: str, h: np.ndarray) -> np.ndarray:
    return h @ w[f"{name}.weight"] + w[f"{name}.bias"]


def forward(w: dict, x: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray, shown: np.ndarray | None = None) -> np.ndarray:
    """(molecules, 12) logits from the atom rows of many molecules, one after the other, and their bonds.

    Messages run along the bond list, each weighed by the degrees at its ends, an atom's own
    among them; a molecule is the mean and the maximum of its atoms.  ``first`` holds where each
    molecule begins, and the end.  Atoms that are not ``shown`` send nothing and are not pooled.
    """
    n = len(x)
    own = np.arange(n)
    source, target = np.concatenate([a, b, own]), np.concatenate([b, a, own])
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    starts = np.flatnonzero(np.diff(target, prepend=-1))
    degree = np.bincount(target, minlength=n).astype(np.float32)
    weight = (1 / np.sqrt(degree[source] * degree[target]))[:, None]
    visible = np.ones((n, 1), np.float32) if shown is None else shown.astype(np.float32)[:, None]
    h = x * visible
    for i in range(ROUNDS):
        h = np.add.reduceat(h[source] * weight, starts, axis=0)
        h = np.maximum(_layer(w, f"round{i}.in", h), 0)
        h = np.maximum(_layer(w, f"round{i}.out", h), 0)
    # rows are never negative here, so a hidden one may stand as zero
    h = h * visible
    count = np.maximum(np.add.reduceat(visible, first[:-1], axis=0), 1)
    pooled = np.concatenate([np.add.reduceat(h, first[:-1], axis=0) / count, np.maximum.reduceat(h, first[:-1], axis=0)], axis=1)
    return _layer(w, "read.out", np.maximum(_layer(w, "read.in", pooled), 0))


def atom_matrix(columns: dict) -> np.ndarray:
    """(atoms, 33): the one-hot row of every atom."""
    slots = [
        columns["element"], columns["degree"],
        np.clip(columns["charge"], MIN_CHARGE, MAX_CHARGE) - MIN_CHARGE, columns["hs"],
        np.where(columns["hyb"] == UNKNOWN_HYBRIDISATION, SP3, columns["hyb"]),
    ]
    at = np.arange(len(columns["element"]))
    x = np.zeros((len(at), N_ATOM_FEATURES), np.float32)
    for values, (_, offset, width) in zip(slots, FEATURE_BLOCKS):
        x[at, offset + np.minimum(values, width - 1)] = 1.0
    for name, (_, offset, _) in zip(("aromatic", "in_ring"), FEATURE_BLOCKS[5:]):
        x[:, offset] = columns[name]
    return x


class Graphs:
    """The molecules of an Arrow batch: flat columns and where each molecule begins."""

    def __init__(self, arrays: list[pa.Array]):
        lengths = lambda c: c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.columns = {name: c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for name, c in zip(GRAPH_COLUMNS, arrays)}
        self.sizes = lengths(arrays[0])
        self.atoms = np.append(0, np.cumsum(self.sizes))
        self.bonds = np.append(0, np.cumsum(lengths(arrays[7])))
        self.x = atom_matrix(self.columns)

    def runs(self) -> Iterator[tuple[np.ndarray, tuple]]:
        """Micro-batches of molecules that have atoms: (their places, (x, first, a, b))."""
        there = np.flatnonzero(self.sizes > 0)
        for at in range(0, len(there), MICRO_BATCH):
            rows = there[at : at + MICRO_BATCH]
            low, high = self.atoms[rows[0]], self.atoms[rows[-1] + 1]
            e = slice(self.bonds[rows[0]], self.bonds[rows[-1] + 1])
            # molecules without atoms have no bonds either, so what lies between is whole
            base = np.repeat(self.atoms[:-1], np.diff(self.bonds))[e] - low
            a, b = (self.columns[c][e] + base for c in ("bond_a", "bond_b"))
            first = np.append(self.atoms[rows] - low, high - low)
            yield rows, (self.x[low:high], first, a, b)


def normalised_adjacency(n: int, mol: np.ndarray, a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Symmetrically normalised adjacency with self-loops, zero on the padding: an input of exported models."""
    adj = np.zeros((len(mask), n, n), np.float32)
    adj[mol, a, b] = adj[mol, b, a] = 1.0
    at, i = np.nonzero(mask)
    adj[at, i, i] = 1.0
    inv = 1.0 / np.sqrt(np.maximum(adj.sum(axis=2), 1.0))
    return adj * inv[:, :, None] * inv[:, None, :]


class Tensors:
    """Dense inputs of some molecules of a batch, padded to a fixed width, as exported models take them."""

    def __init__(self, graphs: Graphs, rows: np.ndarray, width: int):
        sizes = graphs.sizes[rows]
        self.mask = (np.arange(width)[None, :] < sizes[:, None]).astype(np.float32)
        at, i = np.nonzero(self.mask)
        self.x = np.zeros((len(rows), width, N_ATOM_FEATURES), np.float32)
        self.x[at, i] = graphs.x[graphs.atoms[rows][at] + i]
        per = np.diff(graphs.bonds)[rows]
        mol = np.repeat(np.arange(len(rows)), per)
        e = np.repeat(graphs.bonds[rows] - (np.cumsum(per) - per), per) + np.arange(per.sum())
        self.adj = normalised_adjacency(width, mol, graphs.columns["bond_a"][e], graphs.columns["bond_b"][e], self.mask)


def _inputs(skip: Column | None) -> list[Column]:
    out = []
    for c in GRAPH_COLUMNS:
        empty = F.array().cast("array<boolean>" if c in ("aromatic", "in_ring") else "array<int>")
        col = F.coalesce(F.col(c), empty)
        out.append(col if skip is None else F.when(skip, empty).otherwise(col))
    return out


def predict(spark: SparkSession, weights: dict[str, np.ndarray], skip: Column | None = None) -> Column:
    """Twelve logits per molecule; null for failed molecules and for rows under ``skip``."""
    shared = spark.sparkContext.broadcast(weights)  # fixed size: the network, under 1 MB

    def run(*arrays: pa.Array) -> pa.Array:
        out = np.zeros((len(arrays[0]), N_ENDPOINTS))
        done = np.zeros(len(arrays[0]), bool)
        for rows, graph in Graphs(list(arrays)).runs():
            # float32 carries no more digits, and summation order must not decide a ranking
            out[rows] = np.round(forward(shared.value, *graph).astype(np.float64), 5)
            done[rows] = True
        return pa.array([row if ok else None for row, ok in zip(out, done)], pa.list_(pa.float64()))

    return opaque(run, "array<double>")(*_inputs(skip))


def attribute(perceived: DataFrame, mol_id: str, weights: dict[str, np.ndarray], endpoint: int) -> DataFrame:
    """(mol, atom, contribution): drop in one output when an atom is hidden, once per atom.

    All molecules of a micro-batch hide their k-th atom together.
    """
    shared = perceived.sparkSession.sparkContext.broadcast(weights)

    def run(*arrays: pa.Array) -> pa.Array:
        out: list = [None] * len(arrays[0])
        for rows, (x, first, a, b) in Graphs(list(arrays)).runs():
            base = forward(shared.value, x, first, a, b)[:, endpoint]
            sizes = np.diff(first)
            drop = np.zeros((len(rows), sizes.max()))
            for k in range(sizes.max()):
                shown = np.ones(len(x), bool)
                shown[(first[:-1] + k)[sizes > k]] = False
                drop[:, k] = base - forward(shared.value, x, first, a, b, shown)[:, endpoint]
            for r, values, n in zip(rows, drop, sizes):
                out[r] = values[:n]
        return pa.array(out, pa.list_(pa.float64()))

    effect = opaque(run, "array<double>")(*_inputs(None))
    return perceived.select(mol_id, F.posexplode(effect).alias("atom", "contribution"))


@lru_cache(maxsize=4)
def _onnx_session(path: str):
    """Session of a model file, kept by the worker process; one thread, rows are the parallelism."""
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.intra_op_num_threads = 1
    options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
    return ort.InferenceSession(path, options)


def predict_onnx(path: str, input_names: list[str], output_name: str = "predictions") -> Column:
    """Logits from an exported model file that every executor can read.

    ``input_names`` names the feature, adjacency and mask inputs.  Inputs are padded to the
    fixed atom count, since exported models have fixed shapes.
    """

    def run(*arrays: pa.Array) -> pa.Array:
        session = _onnx_session(path)
        names = [i.name for i in session.get_inputs()]
        if sorted(names) != sorted(input_names):
            raise ValueError(f"model inputs {names} differ from {input_names}")
        out: list = [None] * len(arrays[0])
        graphs = Graphs(list(arrays))
        for rows, _ in graphs.runs():
            t = Tensors(graphs, rows, MAX_HEAVY_ATOMS)
            feed = dict(zip(input_names, (t.x, t.adj, t.mask)))
            result = np.asarray(session.run([output_name], feed)[0])
            if result.size != len(rows) * N_ENDPOINTS:
                raise ValueError(f"expected {len(rows) * N_ENDPOINTS} outputs, got {result.size}")
            for r, values in zip(rows, result.reshape(len(rows), N_ENDPOINTS)):
                out[r] = values.astype(np.float64)
        return pa.array(out, pa.list_(pa.float64()))

    return opaque(run, "array<double>")(*_inputs(None))
