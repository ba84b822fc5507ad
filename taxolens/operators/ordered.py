"""Order statistics over range-sorted rows: neighbours in a sorted group and counts within a reach, with no group in one task.

Rows are dealt by ranges of (group, place) and sorted.  A first pass gives each task's edges: what its first and last
groups hold there.  They are a few numbers a task; the driver works out what lies before and after each task, and a
second pass over the same sorted rows uses that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task sorts, about: at least and at most, as far as there are cores.
LEAST, ROWS = 20_000, 500_000


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (g, at, kind, id), sorted over all tasks, kept for two passes."""
    n = rows.count()
    parts = max(1, min(-(-n // LEAST), max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS))))
    by = ["g", "at", "kind", "id"]
    return rows.select(*by).repartitionByRange(parts, *by).sortWithinPartitions(*by).persist()


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """A task's rows: group, place, kind, id."""
    columns = [[b.column(c).to_numpy() for c in ("g", "at", "kind", "id")] for b in batches]
    return tuple(np.concatenate(c) for c in zip(*columns, strict=True)) if columns else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int64))


def _runs(g: np.ndarray) -> list[tuple[int, int]]:
    cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)] if len(g) else [0]
    return list(zip(cut, cut[1:], strict=False))


def _task() -> int:
    return TaskContext.get().partitionId()


def radii(rows: DataFrame, k: int, sizes: dict[int, int]) -> DataFrame:
    """(g, at, kind, id): each row of a group of two or more, and the ends of its reach, a little inside its k-th neighbour in its group.

    kind: 0 the lower end, 1 the row, 2 the upper end. sizes: rows of each group of two or more.
    """
    dealt = _dealt(rows)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, at, _, _ = _whole(batches)
        each = _runs(g)
        out = [(_task(), int(g[a]), side, at[a:b][:k].tolist() if side == 0 else at[a:b][-k:].tolist()) for side, (a, b) in ((0, each[0]), (1, each[-1]))] if each else []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float64())))], ["task", "g", "side", "places"])

    got = dealt.mapInArrow(edges, "task int, g bigint, side int, places array<double>").collect()
    first, last = ({r.task: (r.g, r.places) for r in got if r.side == side} for side in (0, 1))
    tasks = sorted(first)
    before, after = {}, {}
    for order, edge, own, halo in ((tasks, last, first, before), (tasks[::-1], first, last, after)):
        g, held = None, []
        for t in order:  # what the tasks on one side hold of the group at this task's edge
            halo[t] = held if own[t][0] == g else []
            joined = own[t][0] == g and edge[t][0] == g and first[t][0] == last[t][0]
            places = edge[t][1]
            if order is tasks:
                held = ((held if joined else []) + places)[-k:]
            else:
                held = (places + (held if joined else []))[:k]
            g = edge[t][0]
    shared = rows.sparkSession.sparkContext.broadcast((before, after, sizes))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, at, _, ids = _whole(batches)
        earlier, later, many = shared.value
        each = _runs(g)
        for i, (a, b) in enumerate(each):
            own = int(g[a])
            kk = min(k, many.get(own, 1) - 1)
            if kk < 1:
                continue
            left = np.array(earlier.get(_task(), []) if i == 0 else [], float)
            right = np.array(later.get(_task(), []) if i == len(each) - 1 else [], float)
            s = np.concatenate([np.full(kk, -np.inf), left, at[a:b], right, np.full(kk, np.inf)])
            place = np.arange(kk + len(left), kk + len(left) + b - a)
            x = at[a:b]
            radius = np.full(b - a, np.inf)
            for j in range(kk + 1):  # the k nearest are k + 1 values in a row, the row among them
                radius = np.minimum(radius, np.maximum(x - s[place - j], s[place - j + kk] - x))
            radius = np.maximum(radius - 1e-14 * (1 + np.abs(x)), 0)
            for lo in range(0, len(x), 100_000):
                part = slice(lo, lo + 100_000)
                n = len(x[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(3 * n, own)), pa.array(np.concatenate([x[part] - radius[part], x[part], x[part] + radius[part]])), pa.array(np.repeat([0, 1, 2], n).astype(np.int32)), pa.array(np.tile(ids[a:b][part], 3))], ["g", "at", "kind", "id"])

    return dealt.mapInArrow(reach, "g bigint, at double, kind int, id bigint")


def counts_within(reaches: DataFrame, classes: int) -> DataFrame:
    """(f, id, n): how many rows of its feature lie within each row's reach; f: the group divided by classes.

    Rows and ends are sorted together by feature and place; an end's rank is the rows before it.
    """
    dealt = _dealt(reaches.withColumn("g", F.floor(F.col("g") / classes)))

    def rows_at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, _, kind, _ = _whole(batches)
        each = _runs(g)
        out = [(_task(), int(g[a]), side, int((kind[a:b] == 1).sum())) for side, (a, b) in ((0, each[0]), (1, each[-1]))] if each else []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.int64()))], ["task", "g", "side", "n"])

    got = dealt.mapInArrow(rows_at_edges, "task int, g bigint, side int, n bigint").collect()
    first, last = ({r.task: (r.g, r.n) for r in got if r.side == side} for side in (0, 1))
    before, g, held = {}, None, 0
    for t in sorted(first):
        before[t] = held if first[t][0] == g else 0
        held = last[t][1] + (before[t] if first[t][0] == last[t][0] else 0)
        g = last[t][0]
    shared = reaches.sparkSession.sparkContext.broadcast(before)

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, _, kind, ids = _whole(batches)
        for i, (a, b) in enumerate(_runs(g)):
            rank = np.cumsum(kind[a:b] == 1) + (shared.value.get(_task(), 0) if i == 0 else 0)
            end = np.flatnonzero(kind[a:b] != 1)
            signed = np.where(kind[a:b][end] == 2, rank[end], -rank[end])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(end), int(g[a]))), pa.array(ids[a:b][end]), pa.array(signed.astype(np.int64))], ["f", "id", "n"])

    return dealt.mapInArrow(ranks, "f bigint, id bigint, n bigint").groupBy("f", "id").agg(F.sum("n").alias("n"))
