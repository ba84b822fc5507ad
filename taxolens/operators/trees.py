"""Extremely randomised trees over a distributed table, all trees of a set grown level by level.

A node's candidate columns and cuts follow from a hash of (tree, node, column), so no task needs another's
random state.  A level is two scans: one gives each node's class counts and the range of its candidate columns, one the class counts left
of each candidate's cut; sums meet by tree and node, where the best candidate is chosen.  The driver holds nodes' splits, never rows;
trees are taken in sets, so that a task's sums stay below SUM_BYTES.  Where one tile holds all rows, a task grows its trees to the end by the same functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.operators import lloyd

#: Bytes of sums that a task keeps for one set of trees.
SUM_BYTES = 64 << 20
#: Rows of a table whose trees grow in one task each.
BLOCK = 16_384

_U = np.uint64


def _uniform(seed: int, tree: int, node: np.ndarray, column: np.ndarray, draw: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on all arguments."""
    x = np.asarray(node, _U) * _U(0x9E3779B97F4A7C15) + np.asarray(column, _U) * _U(0xC2B2AE3D27D4EB4F) + _U((seed * 1_000_003 + tree * 31 + draw) * 0xD6E8FEB86659FD93 % (1 << 64))
    for a, b in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(a))) * _U(b)
    x ^= x >> _U(31)
    return ((x >> _U(11)).astype(float) + 0.5) / (1 << 53)


@dataclass
class Shape:
    columns: int
    classes: int
    seed: int

    @property
    def tried(self) -> int:
        """Non-constant columns that compete in a node."""
        return max(1, int(math.sqrt(self.columns)))

    @property
    def drawn(self) -> int:
        """Columns that are drawn, as some may be constant in a node."""
        return min(self.columns, 3 * self.tried)

    def candidates(self, tree: int, nodes: np.ndarray) -> np.ndarray:
        """The columns drawn for each node, in order."""
        return np.argsort(_uniform(self.seed, tree, nodes[:, None], np.arange(self.columns)[None], 0), axis=1, kind="stable")[:, : self.drawn]


@dataclass
class Tree:
    """levels: for each level the split nodes (root 1, children 2n and 2n + 1), their columns and cuts; active: nodes that may be split next."""

    number: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    active: np.ndarray = field(default_factory=lambda: np.ones(1, np.int64))
    importance: np.ndarray | None = None

    def places(self, x: np.ndarray) -> np.ndarray:
        """The place in `active` of each row's node, -1 where it is none of them."""
        node = np.ones(len(x), np.int64)
        for nodes, columns, cuts in self.levels:
            at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
            here = nodes[at] == node
            right = x[np.arange(len(x)), columns[at]] > cuts[at]
            node = np.where(here, 2 * node + right, node)
        at = np.minimum(np.searchsorted(self.active, node), len(self.active) - 1)
        return np.where(self.active[at] == node, at, -1)


def _ranges(x: np.ndarray, y: np.ndarray, tree: Tree, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class counts, least and greatest candidate values of each active node."""
    at = tree.places(x)
    rows = np.flatnonzero(at >= 0)
    rows = rows[np.argsort(at[rows], kind="stable")]
    own = at[rows]
    n, m = len(tree.active), shape.drawn
    counts = np.bincount(own * shape.classes + y[rows], minlength=n * shape.classes).reshape(n, -1).astype(float)
    low, high = np.full((n, m), np.inf), np.full((n, m), -np.inf)
    if len(rows):
        values = x[rows[:, None], shape.candidates(tree.number, tree.active)[own]]
        begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        low[own[begin]], high[own[begin]] = np.minimum.reduceat(values, begin), np.maximum.reduceat(values, begin)
    return counts, low, high


def _lefts(x: np.ndarray, y: np.ndarray, tree: Tree, cuts: np.ndarray, shape: Shape) -> np.ndarray:
    """Class counts at or below each candidate's cut in each active node."""
    at = tree.places(x)
    rows = np.flatnonzero(at >= 0)
    n, m, k = len(tree.active), shape.drawn, shape.classes
    left = x[rows[:, None], shape.candidates(tree.number, tree.active)[at[rows]]] <= cuts[at[rows]]
    index = (at[rows][:, None] * m + np.arange(m)[None]) * k + y[rows][:, None]
    return np.bincount(index[left], minlength=n * m * k).reshape(n, m, k).astype(float)


def _cuts(tree: Tree, low: np.ndarray, high: np.ndarray, shape: Shape) -> np.ndarray:
    """A cut for each candidate of each active node; NaN for columns that are constant there or come after those tried."""
    columns = shape.candidates(tree.number, tree.active)
    varied = high > low
    tried = varied & (np.cumsum(varied, 1) <= shape.tried)
    span = np.where(varied, high - low, 0)
    return np.where(tried, np.where(varied, low, 0) + _uniform(shape.seed, tree.number, tree.active[:, None], columns, 1) * span, np.nan)


def _gini(counts: np.ndarray) -> np.ndarray:
    n = counts.sum(-1)
    return 1 - (counts * counts).sum(-1) / np.maximum(n, 1) ** 2


def _best(counts: np.ndarray, lefts: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidate of the largest decrease of impurity in each node, the first of several, and the decrease; -1 for none."""
    n, nl = counts.sum(-1)[:, None], lefts.sum(-1)
    nr = n - nl
    gain = _gini(counts)[:, None] - (nl * _gini(lefts) + nr * _gini(counts[:, None] - lefts)) / np.maximum(n, 1)
    gain = np.where(np.isnan(cuts) | (nl == 0) | (nr == 0), -np.inf, gain)
    best = gain.argmax(1)
    value = gain[np.arange(len(gain)), best]
    return np.where(np.isfinite(value), best, -1), np.where(np.isfinite(value), value, 0)


def _grown(tree: Tree, counts: np.ndarray, cuts: np.ndarray, best: np.ndarray, gain: np.ndarray, total: float, shape: Shape) -> None:
    """Splits the active nodes that have a best candidate and makes their children active."""
    split = np.flatnonzero(best >= 0)
    columns = shape.candidates(tree.number, tree.active)[split, best[split]]
    if tree.importance is None:
        tree.importance = np.zeros(shape.columns)
    np.add.at(tree.importance, columns, gain[split] * counts[split].sum(1) / total)
    nodes = tree.active[split]
    tree.levels.append((nodes, columns, cuts[split, best[split]]) if len(split) else (np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1)))
    tree.active = np.sort(np.concatenate([2 * nodes, 2 * nodes + 1]))


def _open(tree: Tree, counts: np.ndarray) -> np.ndarray:
    """Which active nodes are impure and have two rows or more."""
    return (counts.sum(1) >= 2) & (counts.max(1) < counts.sum(1))


def _alone(x: np.ndarray, y: np.ndarray, tree: Tree, depth: int, shape: Shape) -> Tree:
    """A tree grown to the end on all rows."""
    for _ in range(depth):
        if not len(tree.active):
            break
        counts, low, high = _ranges(x, y, tree, shape)
        keep = _open(tree, counts)
        if not keep.any():
            break
        tree.active, counts, low, high = tree.active[keep], counts[keep], low[keep], high[keep]
        cuts = _cuts(tree, low, high, shape)
        _grown(tree, counts, cuts, *_best(counts, _lefts(x, y, tree, cuts, shape), cuts), float(len(x)), shape)
    return tree


def _halves(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return points[:, :-1], points[:, -1].astype(np.int64)


def _scan(data: lloyd.Table, trees: list[Tree], shape: Shape, cuts: dict[int, np.ndarray] | None, counts: dict[int, np.ndarray] | None) -> dict[int, tuple[np.ndarray, ...]]:
    """By tree: class counts and ranges of its active nodes; given cuts, the best candidates and their gains."""
    shared = data.tiles.sparkSession.sparkContext.broadcast((trees, cuts, counts))
    parts, width = data.parts, len(data.middle)

    def joined(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        return [a[0] + b[0]] if len(a) == 1 else [a[0] + b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, at, _ = shared.value
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for i in range(len(batch)):
                x, y = _halves(np.frombuffer(batch.column("points")[i].as_buffer(), float).reshape(-1, width))
                for tree in every:
                    if tree.number % parts == batch.column("part")[i].as_py():
                        one = list(_ranges(x, y, tree, shape)) if at is None else [_lefts(x, y, tree, at[tree.number], shape)]
                        held[tree.number] = joined(held[tree.number], one) if tree.number in held else one
        for number, sums in held.items():
            yield leaving(number, sums)

    def leaving(number: int, sums: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([[s.tobytes() for s in sums]], pa.list_(pa.binary()))], ["tree", "sums"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, at, n = shared.value
        nodes = {t.number: len(t.active) for t in every}
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for number, sums in zip(batch.column("tree").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                each = [np.frombuffer(s, float).reshape(nodes[number], -1) for s in sums]
                held[number] = joined(held[number], each) if number in held else each
        for number, sums in held.items():
            if at is None:
                yield leaving(number, sums)
            else:
                best, gain = _best(n[number], sums[0].reshape(nodes[number], shape.drawn, shape.classes), at[number])
                yield leaving(number, [best.astype(float), gain])

    kind = "tree int, sums array<binary>"
    got = data.tiles.mapInArrow(run, kind).repartition("tree").mapInArrow(merged, kind).collect()
    shared.destroy()
    size = {t.number: len(t.active) for t in trees}
    return {r.tree: tuple(np.frombuffer(s, float).reshape(size[r.tree], -1) for s in r.sums) for r in got}


def _sets(trees: list[Tree], shape: Shape) -> Iterator[list[Tree]]:
    held, size = [], 0
    for t in trees:
        own = 8 * len(t.active) * shape.drawn * (shape.classes + 2)
        if held and size + own > SUM_BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += own
    if held:
        yield held


def importances(df: DataFrame, label: str, vector: str, trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """(pos, importance): each column's decrease of Gini impurity, a share of its tree's, averaged over trees.

    Nodes of one class or one row aren't split; among sqrt(columns) columns that vary in a node, each cut at a random value,
    the one of the largest decrease splits it. Rows without a label or vector are left out; a table without rows or with one class gives zeros, an empty one no rows.
    """
    spark = df.sparkSession
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).cast("string").alias("_y"), F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    names = sorted(r[0] for r in rows.select("_y").distinct().collect())
    if not names:
        return spark.createDataFrame([], "pos int, importance double")
    codes = spark.createDataFrame([(float(i), n) for i, n in enumerate(names)], "_c double, _y string")
    block = min(lloyd.BLOCK, BLOCK)
    data = lloyd.table(rows.join(F.broadcast(codes), "_y").select(F.concat("_v", F.array("_c")).alias("v")), "v", centred=False, block=block)
    total, width = data.spread[0][0], len(data.middle)
    shape = Shape(width - 1, len(names), seed)
    every = [Tree(t) for t in range(trees)]
    if total <= block:
        parts = data.parts

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    x, y = _halves(np.frombuffer(batch.column("points")[i].as_buffer(), float).reshape(-1, width))
                    for t in range(trees):
                        if t % parts == batch.column("part")[i].as_py():
                            own = _alone(x, y, Tree(t), depth, shape).importance
                            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([None if own is None else own.tolist()], pa.list_(pa.float64()))], ["tree", "own"])

        for r in data.tiles.mapInArrow(grow, "tree int, own array<double>").collect():
            every[r.tree].importance = None if r.own is None else np.array(r.own)
    else:
        together = max(1, SUM_BYTES // (24 * min(2 * total, 1 << depth)))  # trees whose splits the driver holds at once
        for lo in range(0, trees, together):
            grown = every[lo : lo + together]
            for _ in range(depth):
                for some in _sets([t for t in grown if len(t.active)], shape):
                    found = _scan(data, some, shape, None, None)
                    counts, cuts, live = {}, {}, []
                    for t in some:
                        n, low, high = found[t.number]
                        keep = _open(t, n)
                        t.active = t.active[keep]
                        if keep.any():
                            counts[t.number], cuts[t.number] = n[keep], _cuts(t, low[keep], high[keep], shape)
                            live.append(t)
                    if live:
                        best = _scan(data, live, shape, cuts, counts)
                        for t in live:
                            at, gain = best[t.number]
                            _grown(t, counts[t.number], cuts[t.number], at[:, 0].astype(int), gain[:, 0], float(total), shape)
            for t in grown:  # only importances are asked for
                t.levels, t.active = [], t.active[:0]
    data.unpersist()
    own = [t.importance / t.importance.sum() for t in every if t.importance is not None and t.importance.sum() > 0]
    mean = sum(own, np.zeros(shape.columns)) / max(trees, 1)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(mean)], "pos int, importance double")
