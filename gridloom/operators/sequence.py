"""Residuals and their inverses, rebuilds from changes, anchors, dead zone, deltas, error curves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.frames import SERIES, series
from gridloom.plans.blockscan import lagged, running


def residual_p1(df: DataFrame, block: int | None = None) -> DataFrame:
    """Adds ``r`` = m[t] - m[t-1]; the first step of a series has none."""
    return lagged(df, F.col("m"), "__p", block=block).withColumn("r", F.col("m") - F.col("__p")).drop("__p")


def residual_p2(df: DataFrame) -> DataFrame:
    """Delta of delta; the first one is the plain delta."""
    k1 = F.col("m") - F.lag("m").over(series())
    return df.withColumn("__k", k1).withColumn("r", F.col("__k") - F.coalesce(F.lag("__k").over(series()), F.lit(0))).drop("__k")


def residual_ps(df: DataFrame, lags: DataFrame | int) -> DataFrame:
    """m[t] - m[t-lag] with each variable's own lag (grid_id, var, lag) or one for all; the plain delta before that.

    One lag for all is a window on gapless steps, without a join of cells.
    """
    if isinstance(lags, int):
        back = F.lag("m", lags).over(series()) if lags > 1 else F.lag("m").over(series())
        return df.withColumn("r", F.col("m") - F.when(F.col("t") >= lags, back).otherwise(F.lag("m").over(series())))
    with_lag = df.join(lags.select(*SERIES, F.col("lag").alias("__lag")), list(SERIES))
    back = df.select(*SERIES, F.col("t").alias("__bt"), F.col("m").alias("__bm"))
    near = with_lag.withColumn("__p", F.lag("m").over(series())).withColumn("__bt", F.col("t") - F.col("__lag"))
    joined = near.join(back, [*SERIES, "__bt"], "left")
    return joined.withColumn("r", F.col("m") - F.when((F.col("__lag") > 1) & (F.col("t") >= F.col("__lag")), F.col("__bm")).otherwise(F.col("__p"))).drop("__lag", "__bt", "__bm", "__p")


def residual_pl(df: DataFrame) -> DataFrame:
    """Change less the change of the variable before in row order (``row_pos``); the first row has none."""
    k1 = F.col("m") - F.lag("m").over(series())
    above = Window.partitionBy("grid_id", "t").orderBy("row_pos")
    return df.withColumn("__k", k1).withColumn("r", F.when(F.lag("row_pos").over(above) == F.col("row_pos") - 1, F.col("__k") - F.lag("__k").over(above))).drop("__k")


def accumulate_p1(df: DataFrame, block: int | None = None) -> DataFrame:
    """``m`` from residuals ``r`` and each series' first value ``m0``: exact whole-number sums."""
    return running(df, "sum", F.coalesce("r", F.lit(0)), "__s", block=block).withColumn("m", F.col("m0") + F.col("__s")).drop("__s")


def accumulate_p2(df: DataFrame, block: int | None = None) -> DataFrame:
    first = running(df, "sum", F.coalesce("r", F.lit(0)), "__k", block=block)
    return running(first, "sum", F.col("__k"), "__s", block=block).withColumn("m", F.col("m0") + F.col("__s")).drop("__k", "__s")


def accumulate_ps(df: DataFrame) -> DataFrame:
    """Needs ``lag``: the first lag steps are summed, later ones added along each phase of the season."""
    head = F.col("t") < F.col("lag")
    start = F.col("m0") + F.sum(F.when(head, F.coalesce("r", F.lit(0))).otherwise(0)).over(series().rowsBetween(Window.unboundedPreceding, 0))
    seeded = df.withColumn("__v", F.when(head, start).otherwise(F.col("r")))
    phase = Window.partitionBy(*SERIES, "__ph").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return seeded.withColumn("__ph", F.col("t") % F.col("lag")).withColumn("m", F.sum("__v").over(phase)).drop("__v", "__ph")


def accumulate_pl(k1: DataFrame) -> DataFrame:
    """k1 of rows whose ``r`` is relative to the row before (``pl``), along runs that a plain row heads.

    Takes grid_id, row_pos, t, pl and r (k1 itself for the heads); a grid whose first row is relative fails.
    """
    above = Window.partitionBy("grid_id", "t").orderBy("row_pos").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum((~F.col("pl")).cast("int")).over(above)
    checked = k1.withColumn("__run", run).withColumn("__run", F.when(F.col("__run") == 0, F.raise_error(F.lit("a relative row has no row before it"))).otherwise(F.col("__run")))
    along = Window.partitionBy("grid_id", "t", "__run").orderBy("row_pos").rowsBetween(Window.unboundedPreceding, 0)
    return checked.withColumn("k1", F.sum("r").over(along)).drop("__run")


def rebuild_multiplicative(df: DataFrame, block: int | None = None) -> DataFrame:
    """``x_hat`` = baseline times the running product of 1 + pct / 100 (pct is null at the first step)."""
    return running(df, "product", F.lit(1.0) + F.coalesce("pct", F.lit(0.0)) / 100.0, "__f", block=block).withColumn("x_hat", F.col("baseline") * F.col("__f")).drop("__f")


def rebuild_log(df: DataFrame, block: int | None = None) -> DataFrame:
    """For positive series: baseline times exp of the running sum of log ratios (in hundredths)."""
    return running(df, "sum", F.coalesce("pct", F.lit(0.0)) / 100.0, "__l", block=block).withColumn("x_hat", F.col("baseline") * F.exp("__l")).drop("__l")


def take_anchors(samples: DataFrame, every: int) -> DataFrame:
    """Exact values at each ``every``-th step and at the last one."""
    last = samples.groupBy(*SERIES).agg(F.max("t").alias("__last"))
    return samples.join(last, list(SERIES)).filter((F.col("t") % every == 0) | (F.col("t") == F.col("__last"))).select(*SERIES, "t", "x")


def rebuild_with_anchors(df: DataFrame, anchors: DataFrame, every: int) -> DataFrame:
    """Rebuilds each stretch between anchors alone, from its anchor; anchored steps are exact."""
    cut = df.withColumn("__a", F.floor(F.col("t") / F.lit(every)))
    starts = anchors.filter(F.col("t") % every == 0).select(*SERIES, F.floor(F.col("t") / F.lit(every)).alias("__a"), F.col("x").alias("__x0"))
    exact = anchors.select(*SERIES, "t", F.col("x").alias("__exact"))
    factor = F.when(F.col("t") % every == 0, F.lit(1.0)).otherwise(F.lit(1.0) + F.coalesce("pct", F.lit(0.0)) / 100.0)
    within = Window.partitionBy(*SERIES, "__a").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(starts, [*SERIES, "__a"]).withColumn("__f", F.product(factor).over(within)).join(exact, [*SERIES, "t"], "left")
    return out.withColumn("x_hat", F.coalesce("__exact", F.col("__x0") * F.col("__f"))).drop("__a", "__x0", "__f", "__exact")


#: Steps of the dead zone that are one row; longer blocks are cut up, which changes no number.
CELLS = 1024


def _moved(now: np.ndarray, v: np.ndarray, q: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The levels after ``v``; half to even, as everywhere."""
    return np.where(np.abs(v - now * q) >= reach, np.rint(v / q), now)


def _blocks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y of the blocks side by side (beyond a block's end its last value is repeated, which moves no level), lengths and q."""
    cells = batch.column("y")
    n = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = cells.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(n)
    at = np.minimum((ends - n)[:, None] + np.arange(n.max())[None, :], (ends - 1)[:, None])
    return flat[at], n, batch.column("q").to_numpy(zero_copy_only=False)


def _speculated(tau: float) -> Callable:
    """Where each level that a block may start with leads to.

    Only levels nearer than ``tau`` steps to the first value survive it, about 2 * tau of them; all others give
    way to the nearest one.  They run side by side, those of all blocks of a batch at once.
    """
    span = int(np.ceil(tau)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                y, _, q = _blocks(batch)
                q, reach = q[:, None], tau * q[:, None]
                near = np.rint(y[:, :1] / q)
                starts = near + np.arange(-span, span + 1)[None, :]
                kept = ~(np.abs(y[:, :1] - starts * q) >= reach)
                now = np.concatenate([near, starts], axis=1)
                for i in range(y.shape[1]):
                    now = _moved(now, y[:, i : i + 1], q, reach)
                out = {"other": now[:, 0].astype(np.int64), "starts": [s[k].astype(np.int64) for s, k in zip(starts, kept, strict=True)], "ends": [e[k].astype(np.int64) for e, k in zip(now[:, 1:], kept, strict=True)]}
                lists = {k: pa.array(v, pa.list_(pa.int64())) if k != "other" else pa.array(v) for k, v in out.items()}
                yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("grid_id", "var", "blk")} | lists)

    return run


def _walked(tau: float) -> Callable:
    """The level at each step of a block from the level before it (null: none yet), all blocks of a batch side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                y, n, q = _blocks(batch)
                given = batch.column("start")
                now = np.where(np.asarray(given.is_null()), np.rint(y[:, 0] / q), given.fill_null(0).to_numpy(zero_copy_only=False))
                out = np.empty(y.shape)
                for i in range(y.shape[1]):
                    now = out[:, i] = _moved(now, y[:, i], q, tau * q)
                m = out[np.arange(y.shape[1])[None, :] < n[:, None]].astype(np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("grid_id", "var", "q", "cells")} | {"m": pa.ListArray.from_arrays(offsets, pa.array(m))})

    return run


def _carried(key: tuple, frame: pd.DataFrame, per: int = 0) -> pd.DataFrame:
    """The level that each block of a series starts with, from the blocks' summaries; none after ``per`` blocks."""
    level, out = None, []
    for row in frame.sort_values("blk").itertuples():
        if per and row.blk % per == 0:
            level = None
        out.append(level)
        level = dict(zip(row.starts, row.ends, strict=True)).get(level, row.other)
    return pd.DataFrame({"grid_id": key[0], "var": key[1], "blk": np.sort(frame["blk"].to_numpy()), "start": pd.array(out, "Int64")})


def deadzone_lattice(df: DataFrame, tau: float, restart_block: int | None = None, block: int | None = None, beside: tuple[str, ...] = ()) -> DataFrame:
    """``m`` that moves only when ``y`` is ``tau`` steps or more from the carried level; bound tau * q.

    Needs grid_id, var, t, y and q; columns ``beside`` come along.  Blocks are rows of arrays.  With ``block`` a series is cut into runs of that many steps: each is tried
    from every level that it may start with, the blocks' summaries tell which one it was, and all blocks run in
    parallel from their own; the numbers are those of one walk.  With ``restart_block`` each run starts anew:
    other numbers, the same bound.
    """
    if tau <= 0.5:
        return df.withColumn("m", F.rint(F.col("y") / F.col("q")).cast("long"))
    size = min(restart_block or block or CELLS, CELLS)
    per = -(-restart_block // size) if restart_block else 0  # blocks of a run that starts anew
    blk = F.floor(F.col("t") / F.lit(restart_block)) * per + F.floor(F.col("t") % restart_block / F.lit(size)) if restart_block else F.floor(F.col("t") / F.lit(size))
    cells = [c for c in beside if c not in ("t", "y", "q")]
    rows = df.select("grid_id", "var", blk.alias("blk"), "q", F.struct("t", "y", *cells).alias("c"))
    cut = rows.groupBy("grid_id", "var", "blk").agg(F.first("q").alias("q"), F.sort_array(F.collect_list("c")).alias("c"))
    cut = cut.select("grid_id", "var", "blk", "q", F.col("c.y").alias("y"), F.transform("c", lambda c: F.struct(c["t"].alias("t"), *[c[n].alias(n) for n in cells])).alias("cells"))
    tried = cut.select("grid_id", "var", "blk", "q", "y").mapInArrow(_speculated(tau), "grid_id string, var string, blk long, other long, starts array<long>, ends array<long>")
    starts = tried.groupBy("grid_id", "var").applyInPandas(lambda key, frame: _carried(key, frame, per), "grid_id string, var string, blk long, start long")
    placed = cut.join(starts, ["grid_id", "var", "blk"])
    kind = placed.schema["cells"].dataType
    out = placed.select("grid_id", "var", "blk", "q", "y", "start", "cells").mapInArrow(_walked(tau), f"grid_id string, var string, q double, cells {kind.simpleString()}, m array<long>")
    each = out.select("grid_id", "var", "q", F.explode(F.arrays_zip("cells", "m")).alias("z"))
    return each.select("grid_id", "var", "z.cells.t", "q", *[F.col(f"z.cells.{n}").alias(n) for n in cells], "z.m")


def delta(samples: DataFrame) -> DataFrame:
    """``d`` = x[t] - x[t-1] and the first value ``x0`` beside it."""
    return samples.withColumn("d", F.col("x") - F.lag("x").over(series())).withColumn("x0", F.first("x").over(series().rowsBetween(Window.unboundedPreceding, 0)))


def undelta(df: DataFrame, block: int | None = None) -> DataFrame:
    return running(df, "sum", F.coalesce("d", F.lit(0.0)), "__s", block=block).withColumn("x_hat", F.col("x0") + F.col("__s")).drop("__s")


def delta_of_delta(samples: DataFrame) -> DataFrame:
    """Whole numbers ``v``, their delta of delta ``dd`` (0 at the first two steps), and ``v0``, ``d0``."""
    v = samples.withColumn("v", F.rint("x").cast("long"))
    d = v.withColumn("__d", F.col("v") - F.lag("v").over(series()))
    dd = d.withColumn("dd", F.coalesce(F.col("__d") - F.lag("__d").over(series()), F.lit(0)))
    first = series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return dd.withColumn("v0", F.first("v").over(first)).withColumn("d0", F.coalesce(F.first("__d", ignorenulls=True).over(first), F.lit(0))).drop("__d")


def undelta_of_delta(df: DataFrame) -> DataFrame:
    up_to = series().rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__d", F.when(F.col("t") > 0, F.col("d0") + F.sum("dd").over(up_to)).otherwise(0))
    return d.withColumn("v_hat", F.col("v0") + F.sum("__d").over(up_to)).drop("__d")


def prefix_error(aligned: DataFrame, checkpoints: list[int], end: bool = False) -> DataFrame:
    """rmse over all steps before each checkpoint, from one pass over blocks between checkpoints.

    With ``end`` each series has its length as a last checkpoint, and none beyond it.
    """
    cuts = sorted(set(checkpoints))
    place = F.lit(len(cuts))
    for i, c in reversed(list(enumerate(cuts))):
        place = F.when(F.col("t") < c, i).otherwise(place)
    parts = aligned.withColumn("__i", place)
    if not end:
        parts = parts.filter(F.col("__i") < len(cuts))
    parts = parts.groupBy("grid_id", "__i").agg(F.sum(F.pow(F.col("x") - F.col("x_hat"), 2)).alias("e"), F.count(F.lit(1)).alias("n"), F.max("t").alias("__t"))
    up_to = Window.partitionBy("grid_id").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    checkpoint = F.get(F.array(*map(F.lit, cuts)), F.col("__i")).cast("long")
    if end:
        checkpoint = F.coalesce(F.least(checkpoint, F.max("__t").over(Window.partitionBy("grid_id")) + 1), F.col("__t") + 1)
    return parts.select("grid_id", checkpoint.alias("checkpoint"), F.sqrt(F.sum("e").over(up_to) / F.sum("n").over(up_to)).alias("rmse"))
