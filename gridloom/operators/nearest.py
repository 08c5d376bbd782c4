"""The nearest windows of windows, exactly: cells by cuts of the columns, leaves of neighbouring rows inside a task.

A window's nearest in its own cell bound how far the rest may lie, and it is looked for in the cells that reach
so far.  Inside a task matrix products only rule rows out, with room for their rounding; distances of what is
left are summed column by column.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.durable import keep

#: Rows that are looked for, and looked at, at once.
LEAF = 128
#: Roundings allowed for in a squared distance by products, in units of the squared lengths.
ROUNDINGS = 64 * np.finfo(float).eps
#: Pairs whose distances are summed up at once.
PAIRS = 1 << 18
#: Rows whose ways to all cells are worked out at once.
ROWS = 512
#: Windows that show where cells are cut.
SHOWN = 100_000
#: Windows that look into a cell in one task.
LOOKERS = 100_000


def _halves(x: np.ndarray) -> tuple[int, float, np.ndarray] | None:
    """Column, cut and which rows lie below it: the median of the column that varies most, equal values together.

    None if the rows are equal.  Halves by count would cut nothing in columns of few values.
    """
    j = int(np.argmax(x.var(axis=0)))
    v = x[:, j]
    cut = np.partition(v, len(v) // 2)[len(v) // 2]
    if not v.min() < cut:
        more = v[v > cut]
        if not len(more):
            return None
        cut = more.min()
    return j, float(cut), v < cut


def leaves(x: np.ndarray) -> list[np.ndarray]:
    """Places of rows that lie near each other, at most ``LEAF`` in a leaf."""
    todo, done = [np.arange(len(x))] if len(x) else [], []
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            done.append(at)
            continue
        found = _halves(x[at])
        below = found[2] if found else np.arange(len(at)) < len(at) // 2
        todo += [at[~below], at[below]]
    return done


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of ``x`` from the row of ``y`` beside it; columns are added in their order."""
    d = np.zeros(len(x))
    for j in range(x.shape[1]):
        d += (x[:, j] - y[:, j]) ** 2
    return np.sqrt(d)


class Among:
    """Rows to be found: ``y`` and their ids."""

    def __init__(self, y: np.ndarray, ids: np.ndarray):
        found = leaves(y)
        order = np.concatenate(found) if found else np.arange(0)
        self.y, self.ids = y[order], ids[order]
        self.sizes = np.array([len(f) for f in found], int)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.low, self.high = (f.reduceat(self.y, self.starts, axis=0) if found else y for f in (np.minimum, np.maximum))

    def _rows(self, leaf: np.ndarray) -> np.ndarray:
        """Places of the rows of some leaves."""
        sizes = self.sizes[leaf]
        return np.repeat(self.starts[leaf] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())

    def _squares(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float]:
        """Squared distances by products, and by how much they may be wrong."""
        middle = x.mean(axis=0)
        a, b = x - middle, self.y[at] - middle
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        return aa[:, None] + bb[None, :] - 2.0 * (a @ b.T), ROUNDINGS * float(aa.max() + bb.max())

    def _block(self, k: int, x: np.ndarray, ids: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        limit = bound * bound * (1.0 + ROUNDINGS)
        low, high = x.min(axis=0), x.max(axis=0)
        gap = (np.maximum(np.maximum(self.low - high, low - self.high), 0.0) ** 2).sum(axis=1)
        if np.isinf(limit).any():
            first = np.argsort(gap, kind="stable")
            first = first[: 1 + np.searchsorted(np.cumsum(self.sizes[first]), 2 * LEAF + k)]
            squares, wrong = self._squares(x, self._rows(first))
            if squares.shape[1] > k:  # one of them may be the row itself
                limit = np.minimum(limit, np.partition(squares, k, axis=1)[:, k] + 2.0 * wrong)
        leaf = np.flatnonzero(gap <= limit.max() * (1.0 + ROUNDINGS))
        away = np.zeros((len(x), len(leaf)))
        for j in range(x.shape[1]):
            v = x[:, j, None]
            away += np.maximum(np.maximum(self.low[leaf, j] - v, v - self.high[leaf, j]), 0.0) ** 2
        at = self._rows(leaf[(away <= limit[:, None] * (1.0 + ROUNDINGS)).any(axis=0)])
        if not len(at):
            return (np.arange(0),) * 2 + (np.zeros(0),)
        squares, wrong = self._squares(x, at)
        row, to = np.nonzero(squares <= limit[:, None] + wrong)
        to = at[to]
        other = ids[row] != self.ids[to]
        row, to = row[other], to[other]
        d = np.concatenate([np.zeros(0), *[distances(x[row[i : i + PAIRS]], self.y[to[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)]])
        order = np.lexsort((self.ids[to], d, row))
        row, to, d = row[order], to[order], d[order]
        few = np.arange(len(row)) - np.searchsorted(row, np.arange(len(x)))[row] < k
        return row[few], self.ids[to[few]], d[few]

    def nearest(self, k: int, x: np.ndarray, ids: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many were found for each row of ``x``, ids and distances: its ``k`` nearest, ties by id, its own id left out.

        They come by row and distance.  What is farther than a row's ``bound`` may be missing.
        """
        bound = np.full(len(x), np.inf) if bound is None else bound
        found = [(b, *self._block(k, x[b], ids[b], bound[b])) for b in leaves(x)] if len(self.y) else []
        row, other, d = (np.concatenate([np.zeros(0, t), *p]) for p, t in (([b[r] for b, r, _, _ in found], int), ([f[2] for f in found], int), ([f[3] for f in found], float)))
        order = np.argsort(row, kind="stable")
        return np.bincount(row, minlength=len(x)), other[order], d[order]


def distance(v: str, pivot: list[float]) -> Column:
    squares = F.zip_with(v, F.array(*map(F.lit, pivot)), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x))


def _pivots(v: DataFrame, n: int) -> list[list[float]]:
    """The origin and ``n`` - 1 windows as far from the chosen ones as any: distances to them are told apart best."""
    found = [[0.0] * len((v.select("v").first() or [[]])[0])]
    while len(found) < n:
        near = F.least(*[distance("v", p) for p in found]) if len(found) > 1 else distance("v", found[0])
        found.append(v.select(F.max_by("v", F.struct(near, "id"))).first()[0])
    return found


class Cells:
    """Windows in cells, cut in two again and again by a column or by the distance to one of a few pivots."""

    def __init__(self, v: DataFrame, cells: int, pivots: int):
        """``v``: id and v, stored."""
        self.pivots = np.array(_pivots(v, pivots)) if cells > 1 else np.zeros((0, 0))
        shown = np.zeros((0, 0))
        if cells > 1:  # only where cells are cut depends on what is shown
            share = SHOWN / max(v.count(), 1)
            drawn = F.pmod(F.xxhash64("id", F.lit("cells")), F.lit(1 << 30)) < share * (1 << 30)
            shown = self.axes(_matrix(v.filter(drawn).select("v").toArrow()))
        width = shown.shape[1]
        self.nodes = [(-1, 0.0, 0, 0)]  # column, cut, node below or cell, node above
        self.low, self.high = [np.full(width, -np.inf)], [np.full(width, np.inf)]
        largest = [(-len(shown), 0, 0, np.arange(len(shown)))]
        while largest and len(self.low) < cells:
            _, cell, node, at = heapq.heappop(largest)
            found = _halves(shown[at]) if len(at) > 1 else None
            if found is None:
                continue
            j, cut, below = found
            new, n = len(self.low), len(self.nodes)
            self.nodes[node] = (j, cut, n, n + 1)
            self.nodes += [(-1, 0.0, cell, 0), (-1, 0.0, new, 0)]
            self.low.append(self.low[cell].copy())
            self.high.append(self.high[cell].copy())
            self.high[cell][j] = self.low[new][j] = cut
            for c, i, part in ((cell, n, at[below]), (new, n + 1, at[~below])):
                heapq.heappush(largest, (-len(part), c, i, part))

    def __len__(self) -> int:
        return len(self.low)

    def axes(self, x: np.ndarray) -> np.ndarray:
        """The columns, and distances to the pivots."""
        return np.column_stack([x, *[np.sqrt(((x - p) ** 2).sum(axis=1)) for p in self.pivots]])

    def place(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        column, cut, below, above = (np.array(n) for n in zip(*self.nodes, strict=True))
        at = np.zeros(len(x), int)
        v = self.axes(x) if len(self) > 1 else x
        while (go := np.flatnonzero(column[at] >= 0)).size:
            where = at[go]
            at[go] = np.where(v[go, column[where]] < cut[where], below[where], above[where])
        return below[at]

    def within(self, x: np.ndarray, own: int, bound: np.ndarray) -> list[np.ndarray]:
        """The cells but ``own`` that may hold a row within ``bound`` of each row.

        Two rows are at least as far apart as their distances to any pivot differ, so all axes must allow it.
        """
        v, n = self.axes(x), x.shape[1]
        wide = bound * (1 + 1e-9) + 1e-9 * (np.abs(v).max(axis=1, initial=0.0) + 1)
        low, high = np.array(self.low), np.array(self.high)
        found = []
        for i in range(0, len(x), ROWS):
            w, squares = wide[i : i + ROWS, None], np.zeros((len(x[i : i + ROWS]), len(low)))
            near = np.ones(squares.shape, bool)
            near[:, own] = False
            for j in np.flatnonzero(np.isfinite(low).any(axis=0)):  # others aren't cut
                a = v[i : i + ROWS, j, None]
                gap = np.maximum(np.maximum(low[:, j] - a, a - high[:, j]), 0.0)
                if j < n:
                    squares += gap * gap
                else:
                    near &= gap <= w
            found += [np.flatnonzero(r) for r in near & (squares <= w * w)]
        return found


def _matrix(table: pa.Table, name: str = "v") -> np.ndarray:
    values = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(table.num_rows, len(values) // max(table.num_rows, 1))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _found(counts: np.ndarray, other: np.ndarray, d: np.ndarray) -> pa.Array:
    return _lists(counts, pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(other, pa.int64())], ["d", "other"]))


NEAR = "near array<struct<d: double, other: long>>"


def _in_own(k: int, grid: Cells):
    """The nearest of a cell's windows that ask among all of the cell's, and the cells where they have to look besides."""

    def run(table: pa.Table) -> pa.Table:
        y, ids, ask = _matrix(table), _column(table, "id"), _column(table, "ask").astype(bool)
        x, own = y[ask], table.column("cell")[0].as_py()
        counts, other, d = Among(y, ids).nearest(k, x, ids[ask])
        far = np.full(len(x), np.inf)
        far[counts == k] = d[np.cumsum(counts)[counts == k] - 1]
        look = grid.within(x, own, far) if len(grid) > 1 else [np.zeros(0, int)] * len(x)
        at = _lists(np.array([len(i) for i in look], int), pa.array(np.concatenate([np.zeros(0, int), *look]), pa.int32()))
        asking = table.filter(pa.array(ask)).select(["id", "v", "cell"])
        return asking.append_column("bound", pa.array(far, pa.float64())).append_column("near", _found(counts, other, d)).append_column("look", at)

    return run


def _in_others(k: int):
    """The nearest of a cell's windows for windows of other cells that look there."""

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids = mine.column("id").combine_chunks()
        if not (mine.num_rows and theirs.num_rows):
            return pa.table({"id": ids, "near": _found(np.zeros(len(ids), int), np.zeros(0, int), np.zeros(0))})
        found = Among(_matrix(theirs), _column(theirs, "id")).nearest(k, _matrix(mine), _column(mine, "id"), _column(mine, "bound"))
        return pa.table({"id": ids, "near": _found(*found)})

    return run


def neighbours(v: DataFrame, k: int, cells: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """id and ``near``, the exact ``k`` nearest windows (d and other, ties by id) of each (stored) window id, v that
    asks (``ask``); and the pairs of cells (cell, at, mine) that were compared, with how many windows looked there."""
    grid = Cells(v, cells, pivots)

    def placed(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("id", "v", "ask")}, "cell": pa.array(grid.place(_matrix(table)), pa.int32())})

    rows = v.select("id", "v", "ask").mapInArrow(placed, "id long, v array<double>, ask boolean, cell int")
    own = rows.repartition(len(grid), "cell").groupBy("cell").applyInArrow(_in_own(k, grid), f"id long, v array<double>, cell int, bound double, {NEAR}, look array<int>")
    own = keep(own)
    compared = own.groupBy("cell", F.col("cell").alias("at")).agg(F.count(F.lit(1)).alias("mine"))
    if len(grid) == 1:
        return own.select("id", "near"), compared
    pairs = own.select("id", "v", "cell", "bound", F.explode("look").alias("at"))
    # Many look into a cell in the middle: they are dealt to tasks, each with the cell's windows.
    tasks = keep(pairs.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / F.lit(LOOKERS)).cast("int").alias("tasks")))
    mine = pairs.join(tasks, "at").withColumn("part", F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int")).select("at", "part", "id", "v", "bound")
    theirs = rows.withColumnRenamed("cell", "at").join(tasks, "at").select("at", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("part"), "id", "v")
    dealt = lambda df: df.repartition(len(grid), "at", "part").groupBy("at", "part")
    others = dealt(mine).cogroup(dealt(theirs)).applyInArrow(_in_others(k), f"id long, {NEAR}")
    near = own.select("id", "near").unionByName(others).groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return near, compared.unionByName(pairs.groupBy("cell", "at").agg(F.count(F.lit(1)).alias("mine")))
