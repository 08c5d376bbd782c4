"""Methods side by side on whole grids that fit a task (see ``bank.small``): a grid's cells are handed over once.

Spark deals the cells and writes numbers as text.  ``percent`` does the same work, cell by cell, on grids of any size;
sums run in order here as there, so that both give the same numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import EPS, MU
from gridloom.operators import metrics, segments

#: Rows of a row group of the Parquet files whose sizes are measured, steps of a file, lines written at once.
GROUP_ROWS, FILE_STEPS, LINES = 1 << 20, 1_000_000, 10_000

ERRORS = ("rmse", "mae", "mape", "smape", "corr", "max_error")
_ROW = f"grid_id string, method string, cells long, bytes long, bytes_per_cell int, neighbour_bytes double, {', '.join(f'{e} double' for e in ERRORS)}"
_FILES = ", names array<string>, n array<int>, t array<bigint>, v array<double>"
_SIZES = {"bytes": pa.int64(), "bytes_per_cell": pa.int32(), "neighbour_bytes": pa.float64()}


def _mean(x: np.ndarray) -> np.ndarray:
    """Of each row; summed up in order, as Spark does."""
    return np.cumsum(x, axis=1)[:, -1] / x.shape[1]


def _filled(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As ``clean.sanitize``."""
    good = np.isfinite(x)
    if good.all():
        return x
    out = np.zeros(len(x))
    for a, b in zip(starts, ends, strict=True):
        there = np.flatnonzero(good[a:b])
        if len(there):
            out[a:b] = x[a:b][there[np.maximum(np.searchsorted(there, np.arange(b - a), "right") - 1, 0)]]
    return out


def _deviation(x: np.ndarray) -> float:
    """As Spark's stddev_pop."""
    mean = m2 = 0.0
    for n, v in enumerate(x.tolist(), 1):
        delta = v - mean
        mean += delta / n
        m2 += delta * (delta - delta / n)
    return float(np.sqrt(m2 / len(x)))


def _errors(x: np.ndarray, hats: np.ndarray) -> np.ndarray:
    """As ``metrics.error_columns`` in the order of ``ERRORS``, a row for each row of ``hats``."""
    e, size = np.abs(x - hats), np.abs(x)
    rmse, mae, mape = np.sqrt(_mean(e * e)), _mean(e), _mean(e / np.maximum(size, metrics.EPS)) * 100.0
    smape = _mean(2.0 * e / np.maximum(size + np.abs(hats), metrics.EPS)) * 100.0
    a, b = x - x[0], hats - hats[:, :1]  # of a constant nothing is left
    a, b = a - a.mean(), b - b.mean(axis=1, keepdims=True)
    own = np.sqrt((a * a).mean()) * np.sqrt((b * b).mean(axis=1))
    corr = np.where(own <= 0, 0.0, (a * b).mean(axis=1) / np.where(own <= 0, 1.0, own))
    return np.stack([rmse, mae, mape, smape, corr, e.max(axis=1)], axis=1)


def _whole_numbers(x: np.ndarray) -> np.ndarray:
    if (np.abs(x) >= 2.0**63).any():
        raise OverflowError("a value, or a change of values, has no whole number of 64 bits")
    return x.astype(np.int64)


def _baselines(x: np.ndarray, t: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_segments: int) -> Iterator[dict]:
    """Of each method its name and bytes, what it rebuilds, and the numbers ``v`` that it keeps at the cells ``at``."""
    every, sid = np.arange(len(x)), np.repeat(np.arange(len(starts)), ends - starts)
    length = -(-(int(t.max()) + 1) // max(1, n_segments))
    seg = t // length
    tau = (t - seg * length).astype(np.float64)
    first = np.zeros(len(x), bool)
    first[starts] = True
    heads = np.flatnonzero(first | (np.diff(seg, prepend=-1) != 0))
    pid = np.zeros(len(x), np.int64)
    pid[heads] = 1
    pid = np.cumsum(pid) - 1
    along = lambda v: np.concatenate([np.cumsum(v[a:b]) for a, b in zip(starts, ends, strict=True)])
    d = np.where(first, 0.0, np.diff(x, prepend=0.0))
    whole = np.rint(x)
    v = _whole_numbers(whole)
    _whole_numbers(np.diff(whole))
    dv = np.where(first, 0, np.diff(v, prepend=0))
    second = first | np.roll(first, 1)
    _whole_numbers(np.diff(dv.astype(np.float64)))
    dd = np.where(second, 0, np.diff(dv, prepend=0))
    d0 = np.array([dv[a + 1] if b - a > 1 else 0 for a, b in zip(starts, ends, strict=True)])
    moves = np.where(t > 0, d0[sid] + along(dd), 0)
    zigzag = ((dd << 1) ^ (dd >> 63)).astype(np.uint64)
    varints = len(x) + sum(int((zigzag >= np.uint64(1 << 7 * k)).sum()) for k in range(1, 10))
    count, number = np.bincount(pid), len(heads)
    mean, squares, products = np.bincount(pid, x) / count, np.bincount(pid, tau * tau), np.bincount(pid, x * tau)
    slope = np.divide(products, squares, out=np.zeros(number), where=squares > 0)
    mu = (np.bincount(sid, x) / (ends - starts))[sid]
    sigma = np.array([_deviation(x[a:b]) for a, b in zip(starts, ends, strict=True)])[sid] + 1e-9
    symbol = np.searchsorted(segments.breakpoints(segments.ALPHABET), np.bincount(pid, (x - mu) / sigma) / count, "right")
    level = np.array(segments.centers(segments.ALPHABET))[symbol] * sigma[heads] + mu[heads]
    yield {"method": "raw", "bytes": 8 * len(x), "v": x, "at": every}
    yield {"method": "delta", "bytes": 8 * len(x), "hat": x[starts][sid] + along(d), "v": np.where(first, x, d), "at": every}
    yield {"method": "delta_of_delta", "bytes": varints, "hat": (v[starts][sid] + along(moves)).astype(np.float64), "v": dd.astype(np.float64), "at": every}
    yield {"method": "paa", "bytes": 8 * number, "hat": mean[pid], "v": mean, "at": heads}
    yield {"method": "pla", "bytes": 16 * number, "hat": x[heads][pid] + slope[pid] * tau, "v": x[heads] + slope * tau[heads], "at": heads}
    yield {"method": "sax", "bytes": 4 * number, "hat": level[pid], "v": level, "at": heads}


def _clamp(pct: np.ndarray, cap: float) -> float:
    """As ``profile.adaptive_clamp``."""
    if not len(pct):
        return cap
    size = np.sort(np.abs(pct))
    place, m = 0.995 * (len(size) - 1), size[-1]
    lo, hi = int(np.floor(place)), int(np.ceil(place))
    p = size[lo] if lo == hi or size[lo] == size[hi] else (hi - place) * size[lo] + (place - lo) * size[hi]
    blend = min(max((m / (p + 1e-10) - 2.0) / 8.0, 0.0), 1.0)
    return min(max(blend * p + (1.0 - blend) * (m * 1.1), 1.0), cap)


def _method(x: np.ndarray, name: str, bits: int, kind: bool | None, cap: float = 500.0) -> dict:
    """Name, size and rebuilt values of the base grid (``kind`` None) or the enhanced one, as ``percent.rebuilt_beside``, of one series."""
    steps, low = (1 << bits) - 1, x.min()
    offset = 2.0 * abs(low) + EPS if kind is not None and low <= 0 else 0.0
    v = x + offset
    prev = v[:-1]
    pct = np.diff(v) / (prev + EPS if kind is None else np.maximum(np.abs(prev), EPS)) * 100.0
    clamp = cap if kind is None else _clamp(pct, cap)
    cut = np.minimum(np.maximum(pct, -clamp), clamp)
    if kind:
        y = cut / clamp
        q = np.rint((np.sign(y) * np.log1p(MU * np.abs(y)) / np.log1p(MU) + 1.0) / 2.0 * steps)
        y = q / steps * 2.0 - 1.0
        back = np.sign(y) * (np.power(1.0 + MU, np.abs(y)) - 1.0) / MU * clamp
    else:
        q = np.rint((cut + clamp) / (clamp * 2.0) * steps)
        back = q / steps * (clamp * 2.0) - clamp
    n = np.unique(q, return_counts=True)[1]
    hat = v[0] * np.cumprod(np.concatenate([[1.0], 1.0 + back / 100.0])) - offset
    # One variable a grid: each code stands for itself, and any order of rows is the order by name.
    return {"method": name, "bytes_per_cell": 1 if bits <= 8 else 2, "neighbour_bytes": float(-(n * np.log2(n / n.sum())).sum() / 8.0) if len(n) else None, "hat": hat}


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    """A list for each of ``parts``; null where there is none."""
    ends = np.cumsum([0, *[0 if p is None else len(p) for p in parts]])
    flat = [p for p in parts if p is not None]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else [], kind), mask=pa.array([p is None for p in parts]))


def _compared(methods: tuple, n_segments: int | None, files: bool) -> Callable:
    def run(key: tuple, cells: pa.Table) -> pa.Table:
        if cells.num_rows > 1:
            cells = cells.sort_by([("var", "ascending"), ("t", "ascending")])
        names, t = cells.column("var").combine_chunks().dictionary_encode(), cells.column("t").to_numpy()
        starts = np.flatnonzero(np.diff(names.indices.to_numpy(), prepend=-1))
        ends = np.append(starts[1:], len(t))
        x = _filled(cells.column("x").to_numpy().astype(np.float64), starts, ends)
        with np.errstate(over="ignore", invalid="ignore", divide="raise"):
            found = [_method(x, *m) for m in methods] + ([] if n_segments is None else list(_baselines(x, t, starts, ends, n_segments)))
            rebuilt = [i for i, one in enumerate(found) if "hat" in one]
            errors = np.full((len(found), len(ERRORS)), np.nan)
            errors[rebuilt] = _errors(x, np.stack([found[i]["hat"] for i in rebuilt]))
        none = np.array(["hat" not in one for one in found])
        columns = {"grid_id": pa.array([key[0].as_py()] * len(found), pa.string()), "method": pa.array([one["method"] for one in found]), "cells": pa.array([len(x)] * len(found), pa.int64())}
        columns |= {c: pa.array([one.get(c) for one in found], kind) for c, kind in _SIZES.items()}
        columns |= {c: pa.array(errors[:, i], mask=none) for i, c in enumerate(ERRORS)}
        if files:
            at, cuts = [one.get("at") for one in found], np.append(starts, len(t))
            columns["names"] = _lists([None if k is None else names.dictionary.to_pylist() for k in at], pa.string())
            columns["n"] = _lists([None if k is None else np.diff(np.searchsorted(k, cuts)) for k in at], pa.int32())
            columns["t"], columns["v"] = _lists([None if k is None else t[k] for k in at], pa.int64()), _lists([one.get("v") for one in found], pa.float64())
        return pa.table(columns)

    return run


def compared(samples: DataFrame, methods: tuple = (), n_segments: int | None = None, files: bool = False) -> DataFrame:
    """A row for each grid and method: cells, sizes and errors of percent grids (``methods``: name, bits and kind, for grids of
    one variable) and, given ``n_segments``, of deltas and segment summaries, with ``files`` also their sizes in files.

    Cells that are dealt by grid_id are not shuffled again.
    """
    rows = samples.select("grid_id", "var", "t", "x").groupBy("grid_id").applyInArrow(_compared(methods, n_segments, files), _ROW + (_FILES if files else ""))
    return _with_sizes(rows) if files else rows


def file_sizes(parts: Iterator[tuple[pa.RecordBatch, str]]) -> tuple[int, int]:
    """Bytes of a Parquet file (zstd) and of a gzip file of rows and their text; both are written and forgotten."""
    parquet, pack, gzip, held, writer = pa.MockOutputStream(), zlib.compressobj(wbits=31), 0, [], None
    for rows, text in parts:
        gzip += len(pack.compress(text.encode()))
        held.append(rows)
        writer = writer or pq.ParquetWriter(parquet, rows.schema, compression="zstd")
        if sum(b.num_rows for b in held) >= GROUP_ROWS:
            writer.write_table(pa.Table.from_batches(held))
            held = []
    if held:
        writer.write_table(pa.Table.from_batches(held))
    writer.close()
    return parquet.size(), gzip + len(pack.flush())


@lru_cache(maxsize=64)
def _places(head: str, chunk: int) -> list[str]:
    return [f"{head},{t}," for t in range(chunk * LINES, (chunk + 1) * LINES)]


def _text(var: np.ndarray, t: np.ndarray, heads: list[str], numbers: list[str]) -> str:
    lo, hi = int(t[0]), int(t[-1])
    if var[0] == var[-1] and lo >= 0 and hi - lo == len(t) - 1 and lo // LINES == hi // LINES:  # steps of one series
        return "\n".join(map(add, _places(heads[var[0]], lo // LINES)[lo % LINES :], numbers)) + "\n"
    return "".join([f"{heads[i]},{step},{number}\n" for i, step, number in zip(var.tolist(), t.tolist(), numbers, strict=True)])


def _lines(names: pa.Array, var: np.ndarray, t: np.ndarray, v: np.ndarray, heads: list[str], numbers: list[str]) -> Iterator[tuple[pa.RecordBatch, str]]:
    for a in range(0, len(t), LINES):
        to = slice(a, a + LINES)
        name = pa.repeat(names[0], len(t[to])) if len(names) == 1 else names.take(pa.array(var[to]))
        yield pa.RecordBatch.from_arrays([name, pa.array(t[to]), pa.array(v[to])], ["var", "t", "v"]), _text(var[to], t[to], heads, numbers[to])


def _sized(beside: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for i in range(batch.num_rows):
                item = {c: batch.column(c)[i].values for c in ("names", "n", "t", "v", "heads") if batch.column(c)[i].is_valid}
                if not item:
                    sizes.append((None, None))
                    continue
                t, v, numbers = item["t"].to_numpy(), item["v"].to_numpy(), batch.column("text")[i].as_py()[1:-1].split(", ")
                var, heads, file = np.repeat(np.arange(len(item["n"])), item["n"].to_numpy()), item["heads"].to_pylist(), t // FILE_STEPS
                if file.max() == file.min():
                    sizes.append(file_sizes(_lines(item["names"], var, t, v, heads, numbers)))
                    continue
                cut = [np.flatnonzero(file == f) for f in np.unique(file)]
                each = [file_sizes(_lines(item["names"], var[k], t[k], v[k], heads, [numbers[j] for j in k])) for k in cut]
                sizes.append(tuple(map(sum, zip(*each, strict=True))))
            parquet, gzip = (pa.array([s[k] for s in sizes], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in beside), parquet, gzip], [*beside, "parquet_bytes", "gzip_bytes"])

    return run


def _with_sizes(rows: DataFrame) -> DataFrame:
    """``rows`` with the sizes of each one's files: one for each million steps, its numbers as Spark writes them."""
    beside = [c for c in rows.columns if c not in ("names", "n", "t", "v")]
    text = rows.withColumns({"text": F.col("v").cast("string"), "heads": F.transform("names", lambda n: F.to_csv(F.struct(n.alias("var"))))})
    return text.mapInArrow(_sized(beside), f"{_ROW}, parquet_bytes long, gzip_bytes long")
