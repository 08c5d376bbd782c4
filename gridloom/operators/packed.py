"""Windows packed into one row each: the work of ``detect`` on blocks of whole windows in place.

A packed window has win_id and ``x``, an array of values by position for each variable, in order of name; with anomalies
``label`` and what was ``drawn``; as a grid ``eps`` and ``mode``.  It is made from rows that are dealt by grid and never shuffled again: what leaves a task is a row of
features for each window.  Values must be finite; ``detect`` does the same work, cell by cell, on windows with gaps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.scalar import CENTER, ESCAPE, INLINE

#: Windows whose cells are worked on at once.
CHUNK = 512


def packed(df: DataFrame) -> bool:
    return "x" in df.columns and isinstance(df.schema["x"].dataType, T.StructType)


def variables_of(df: DataFrame) -> list[str]:
    return df.schema["x"].dataType.names


def windows(indexed: DataFrame, variables: list[str], size: int = 100, stride: int = 50) -> DataFrame:
    """Packed sliding windows of grid_id, t (gapless from 0) and ``variables`` side by side; incomplete ones are left out."""
    names = sorted(variables)
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("t") - (size - 1)) / F.lit(stride)))
    hi = F.floor(F.col("t") / F.lit(stride))
    rows = indexed.select("grid_id", "t", *[F.col(v).cast("double").alias(v) for v in names], F.explode(F.when(hi >= lo, F.sequence(lo, hi))).alias("w"))
    cells = rows.groupBy("grid_id", "w").agg(F.sort_array(F.collect_list(F.struct("t", *names))).alias("c")).filter(F.size("c") == size)
    return cells.select(F.concat_ws("/", "grid_id", F.col("w").cast("string")).alias("win_id"), F.struct(*[F.col("c")[v].alias(v) for v in names]).alias("x"))


def gaps(indexed: DataFrame, variables: list[str]) -> bool:
    """Whether any value is missing or not finite."""
    bad = [~F.coalesce(F.abs(F.col(v).cast("double")) < float("inf"), F.lit(False)) for v in variables]
    any_ = bad[0]
    for b in bad[1:]:
        any_ = any_ | b
    return bool(indexed.filter(any_).limit(1).count())


def labeled(df: DataFrame, drawn: Callable[[Column], Column]) -> DataFrame:
    """Every window twice, as ``detect.labeled_windows``; ``drawn`` gives what is drawn for a variable (by its name)."""
    each = df.withColumn("__d", F.array(*[drawn(F.lit(v)) for v in variables_of(df)]))
    none = F.lit(None).cast(each.schema["__d"].dataType)
    both = each.withColumn("__l", F.explode(F.array(F.struct(F.lit("/n").alias("mark"), none.alias("d")), F.struct(F.lit("/a").alias("mark"), F.col("__d").alias("d")))))
    return both.select(F.concat("win_id", "__l.mark").alias("win_id"), (F.col("__l.mark") == "/a").cast("int").alias("label"), "x", F.col("__l.d").alias("drawn"))


def _values(batch: pa.RecordBatch) -> np.ndarray:
    """windows x variables x positions"""
    each = [v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for v in batch.column("x").flatten()]
    return np.stack(each, axis=1)


def _with_anomalies(x: np.ndarray, drawn: pa.Array) -> np.ndarray:
    """``x`` plus what was drawn for its windows (null: none)."""
    has = np.flatnonzero(~np.asarray(drawn.is_null()))
    if not len(has):
        return x
    cells = drawn.drop_null().flatten()
    get = {f.name: cells.field(f.name) for f in cells.type}
    num = lambda n: get[n].to_numpy(zero_copy_only=False).astype(float).reshape(len(has), -1, 1)
    kind, pos = np.array(get["kind"].to_pylist(), object).reshape(len(has), -1, 1), np.arange(x.shape[2])[None, None, :]
    away, spread, start = pos - num("at"), num("spread"), num("start")
    with np.errstate(divide="ignore"):
        spike = np.where(away == 0, 1.0, np.where((away > 0) & (away <= spread), 0.5 / away, np.where((away < 0) & (-away <= spread), 0.3 / -away, 0.0)))
    add = np.where(kind == "spike", spike * num("spike") * num("sign"), np.where(kind == "level_shift", np.where(pos >= start, num("shift"), 0.0) * num("sign"), 0.0))
    flat = np.flatnonzero(~np.asarray(get["noise"].is_null()))
    if len(flat):
        noise = np.zeros((len(has) * x.shape[1], x.shape[2]))
        noise[flat] = get["noise"].drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
        within = (pos >= start) & (pos < start + num("length"))
        add = add + np.where(within, noise.reshape(add.shape), 0.0)
    out = x.copy()
    out[has] += np.where(num("hit") > 0, add * x[has].std(axis=2, keepdims=True), 0.0)
    return out


def _lattice(x: np.ndarray, eps: float, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates m, steps q and scales s, as the lattice encoder's."""
    s = np.ones((*x.shape[:2], 1))
    if mode == "rel":
        middle = np.median(np.abs(x), axis=2, keepdims=True)
        s = np.maximum(0.01 * np.where(middle > 0, middle, x.std(axis=2, keepdims=True)), 1e-12)
        q = np.full_like(s, 2.0 * np.log1p(eps))
    else:
        span = x.max(axis=2, keepdims=True) - x.min(axis=2, keepdims=True)
        q = 2.0 * eps * np.where(span <= 0, np.maximum(np.abs(x[..., :1]), 1.0), span)
    m = np.rint((np.arcsinh(x / s) if mode == "rel" else x) / q)
    if (np.abs(m) >= float(1 << 53)).any():
        raise ValueError("lattice coordinate beyond 2**53: eps is too small")
    return m, q, s


def _pixels(x: np.ndarray, eps: float, mode: str) -> tuple[np.ndarray, np.ndarray]:
    r = np.diff(_lattice(x, eps, mode)[0], axis=2)
    inline = np.abs(r) <= INLINE
    return np.where(inline, r + CENTER, ESCAPE), np.where(inline, r, INLINE + 1.0)


def rebuilt(x: np.ndarray, eps: float, mode: str) -> np.ndarray:
    """What pixels, escapes and first coordinates give back."""
    m, q, s = _lattice(x, eps, mode)
    back = np.cumsum(np.concatenate([m[..., :1], np.diff(m, axis=2)], axis=2), axis=2) * q
    return s * np.sinh(back) if mode == "rel" else back


def _percentile(v: np.ndarray, p: float) -> np.ndarray:
    """Along the last axis, interpolated as Spark's percentile does it: two weighted ends."""
    place = p * (v.shape[-1] - 1)
    lo, hi = int(np.floor(place)), int(np.ceil(place))
    sorted_ = np.partition(v, (lo, hi), axis=-1)
    return np.where(sorted_[..., lo] == sorted_[..., hi], sorted_[..., lo], (hi - place) * sorted_[..., lo] + (place - lo) * sorted_[..., hi])


def _kurtosis(v: np.ndarray) -> np.ndarray:
    """Of a population, less 3; NaN where nothing varies."""
    d = v - v.mean(axis=-1, keepdims=True)
    d[v.max(axis=-1) == v.min(axis=-1)] = 0.0
    two = (d * d).sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(two > 0, v.shape[-1] * (d**4).sum(axis=-1) / (two * two), np.nan) - 3.0


def _entropy32(p: np.ndarray) -> np.ndarray:
    bins = np.minimum(np.floor(p * 32 / 255.0), 31).astype(np.int64)
    n = np.bincount((bins + 32 * np.arange(len(p))[:, None]).ravel(), minlength=32 * len(p)).reshape(-1, 32) / p.shape[1]
    return -(n * np.log(np.where(n > 0, n, 1.0))).sum(axis=1)


def _trajectory(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tn, its span, and the shift between its halves, by window and variable."""
    tn = np.cumsum(r, axis=2) / np.maximum(_percentile(np.abs(r), 0.9), 1.0)[..., None]
    half = r.shape[2] // 2
    return tn, tn.max(axis=2) - tn.min(axis=2), np.abs(tn[..., half:].mean(axis=2) - tn[..., :half].mean(axis=2))


def grid(pixel: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    signed = pixel - CENTER
    dev = np.abs(signed)
    cells, active = dev.reshape(len(dev), -1), (dev > 2).astype(float)
    rows = dev.max(axis=2)
    return {
        "g_mean": cells.mean(axis=1), "g_std": cells.std(axis=1), "g_max": cells.max(axis=1), "g_active": active.reshape(len(dev), -1).mean(axis=1), "g_escapes": (pixel == ESCAPE).sum(axis=(1, 2)).astype(float),
        "g_strong": (cells > 20).sum(axis=1).astype(float), "g_p99": _percentile(cells, 0.99), "g_row_mean": rows.mean(axis=1), "g_row_max": rows.max(axis=1), "g_burst": active.mean(axis=1).max(axis=1),
    }


def trajectory(pixel: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    tn, span, shift = _trajectory(r)
    drift, rough = np.abs(tn[..., -1]), np.abs(np.diff(np.sign(np.diff(tn, axis=2) + 1e-9), axis=2)).mean(axis=2)
    return {
        "t_drift_max": drift.max(axis=1), "t_drift_mean": drift.mean(axis=1), "t_span_max": span.max(axis=1), "t_span_mean": span.mean(axis=1), "t_shift_max": shift.max(axis=1), "t_shift_mean": shift.mean(axis=1),
        "t_rough": rough.max(axis=1), "t_big": np.abs(r).max(axis=(1, 2)), "t_moves": (np.abs(r) >= 100).sum(axis=(1, 2)).astype(float),
    }


def per_row(pixel: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    size = np.abs(r)
    _, span, shift = _trajectory(r)
    return {"p_mean": size.mean(axis=2), "p_max": size.max(axis=2), "p_active": (size > 2).mean(axis=2), "p_std": size.std(axis=2), "p_span": span, "p_shift": shift}


def image(p: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    near = lambda c, axis: np.pad(c, [(1, 1) if a == axis else (0, 0) for a in range(3)], "edge")
    wide = near(p, 2)
    before, after = wide[..., :-2], wide[..., 2:]
    dt, st = near(after - before, 1), near(after + 2.0 * p + before, 1)
    ex, ey = dt[:, 2:] + 2.0 * dt[:, 1:-1] + dt[:, :-2], st[:, 2:] - st[:, :-2]
    e, c, flat = np.sqrt(ex * ex + ey * ey).reshape(len(p), -1), np.abs(np.diff(p, axis=2)).reshape(len(p), -1), p.reshape(len(p), -1)
    rows = p.std(axis=2)
    return {
        "i_mean": flat.mean(axis=1), "i_std": flat.std(axis=1), "i_kurtosis": _kurtosis(flat), "i_range": flat.max(axis=1) - flat.min(axis=1), "i_edge_mean": e.mean(axis=1), "i_edge_std": e.std(axis=1), "i_edge_max": e.max(axis=1),
        "i_col_mean": c.mean(axis=1), "i_col_std": c.std(axis=1), "i_col_max": c.max(axis=1), "i_entropy": _entropy32(flat), "i_row_mean": rows.mean(axis=1), "i_row_std": rows.std(axis=1), "i_row_max": rows.max(axis=1),
    }


def simple(p: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    flat = p.reshape(len(p), -1)
    return {"s_edges": np.abs(np.diff(p, axis=2)).reshape(len(p), -1).mean(axis=1), "s_std": flat.std(axis=1), "s_entropy": _entropy32(flat)}


def numeric(x: np.ndarray) -> dict[str, np.ndarray]:
    return {
        "f_mean": x.mean(axis=2), "f_std": x.std(axis=2), "f_range": x.max(axis=2) - x.min(axis=2), "f_kurtosis": _kurtosis(x), "f_step": np.abs(np.diff(x, axis=2)).max(axis=2), "f_spread": _percentile(x, 0.95) - _percentile(x, 0.05),
    }


def features(df: DataFrame, *sets: Callable, by_var: bool = False, wide: bool = True, of: str = "grid") -> DataFrame:
    """A row of the numbers of ``sets`` for each window (``by_var``: for each of its variables, side by side if ``wide``).

    They are read off the residual ``grid``, the ``values``, or what the grid gives back (``rebuilt``).
    """
    names = variables_of(df)
    probe = np.linspace(0.0, 1.0, 16 * len(names)).reshape(2, -1, 8)
    columns = [c for s in sets for c in (s(probe, probe) if of == "grid" else s(probe))]
    beside = [f"{v}_{c}" for v in names for c in columns] if by_var and wide else columns
    kind = "win_id string, " + ("var string, " if by_var and not wide else "") + ", ".join(f"`{n}` double" for n in beside)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                x = _values(batch)
                if "drawn" in batch.schema.names:
                    x = _with_anomalies(x, batch.column("drawn"))
                how = (batch.column("eps")[0].as_py(), batch.column("mode")[0].as_py()) if of != "values" else ()
                told = _pixels(x, *how) if of == "grid" else (rebuilt(x, *how) if of == "rebuilt" else x,)
                found = {k: v for s in sets for k, v in s(*told).items()}
                out = {"win_id": batch.column("win_id")}
                if by_var and wide:
                    out |= {f"{v}_{c}": found[c][:, i] for i, v in enumerate(names) for c in columns}
                elif by_var:
                    ids = batch.column("win_id").take(pa.array(np.repeat(np.arange(len(x)), len(names))))
                    out = {"win_id": ids, "var": pa.array(names * len(x)), **{c: found[c].ravel() for c in columns}}
                else:
                    out |= found
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, pa.float64(), from_pandas=True) for k, v in out.items()})

    return df.select(*[c for c in ("win_id", "x", "drawn", "eps", "mode") if c in df.columns]).mapInArrow(work, kind)
