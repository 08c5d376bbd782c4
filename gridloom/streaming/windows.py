"""Windows of a stream by row count as grids, and alarms on what the grids show.

A stream of samples is keyed by (grid_id, var).  State holds the samples of windows that aren't full yet and the
number of the first open window; a full window leaves as one row with its lattice grid.  A window that stays short is
sent when event time has passed its last sample by ``patience``.  Samples of windows that are gone are counted.
Memory is that of the open windows of a series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridloom.functions.scalar import CENTER, ESCAPE, INLINE
from gridloom.operators import detect

GRIDS = "grid_id string, var string, window long, steps long, full boolean, late long, q double, s double, m0 long, pixels array<int>, escapes array<long>"


def _filled(x: np.ndarray) -> np.ndarray:
    """Gaps take the value before, at the start the first one after; none at all is 0."""
    good = np.isfinite(x)
    if not good.any():
        return np.zeros(len(x))
    last = np.maximum.accumulate(np.where(good, np.arange(len(x)), -1))
    return x[np.where(last < 0, int(np.argmax(good)), last)]


def _encoded(x: np.ndarray, eps: float, mode: str) -> dict:
    """The plain lattice grid of one window, as the batch encoder makes it."""
    x = _filled(x)
    s = None
    if mode == "rel":
        middle = float(np.percentile(np.abs(x), 50))
        s = max(0.01 * middle, 1e-12) if middle > 0 else max(0.01 * float(x.std()), 1e-12)
        q, y = 2.0 * float(np.log1p(eps)), np.arcsinh(x / s)
    else:
        span = float(x.max() - x.min())
        q, y = 2.0 * eps * (max(abs(float(x[0])), 1.0) if span <= 0 else span), x
    m = np.rint(y / q).astype(np.int64)
    r = np.diff(m)
    far = np.abs(r) > INLINE
    return {"q": q, "s": s, "m0": int(m[0]), "pixels": np.where(far, ESCAPE, r + CENTER).tolist(), "escapes": [int(v) if f else None for v, f in zip(r, far, strict=True)]}


class RowWindows(StatefulProcessor):
    """Collects each series' samples into windows of ``rows`` steps."""

    def __init__(self, rows: int, eps: float, mode: str, patience_ms: int):
        self.rows, self.eps, self.mode, self.patience = rows, eps, mode, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "t long, x double")
        self.place = handle.getValueState("place", "open long, late long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, late, due = self.place.get() if self.place.exists() else (0, 0, -1)
        held = self._held()
        seen, newest = 0, -1
        for frame in rows:
            in_time = frame["t"].to_numpy() // self.rows >= first
            seen += len(frame)
            late += int((~in_time).sum())
            held.update(zip(frame["t"].to_numpy()[in_time].tolist(), frame["x"].to_numpy(dtype=float, na_value=np.nan)[in_time].tolist(), strict=True))
            newest = max(newest, int(frame["ts"].max().value // 1_000_000))
        done = []
        while all(first * self.rows + i in held for i in range(self.rows)):
            done.append(self._row(key, first, held, late, True))
            first += 1
        if due >= 0:
            self.handle.deleteTimer(due)
        due = -1
        if held and seen:
            due = newest + self.patience
            self.handle.registerTimer(due)
        self._store(first, late, due, held)
        yield pd.DataFrame(done, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, late, _ = self.place.get()
        held = self._held()
        done = []
        for w in sorted({t // self.rows for t in held}):
            done.append(self._row(key, w, held, late, False))
            first = w + 1
        self._store(first, late, -1, held)
        yield pd.DataFrame(done, columns=COLUMNS)

    def _held(self) -> dict[int, float]:
        return {t: np.nan if x is None else x for t, x in self.buffer.get()} if self.buffer.exists() else {}

    def _row(self, key, window: int, held: dict[int, float], late: int, full: bool) -> tuple:
        """Takes a window's samples out of ``held``."""
        steps = sorted(t for t in held if t // self.rows == window)
        grid = _encoded(np.array([held.pop(t) for t in steps], float), self.eps, self.mode)
        return (f"{key[0]}/{window}", key[1], window, len(steps), full, late, grid["q"], grid["s"], grid["m0"], grid["pixels"], grid["escapes"])

    def _store(self, first: int, late: int, due: int, held: dict[int, float]) -> None:
        self.place.update((first, late, due))
        if held:
            self.buffer.put([(t, None if np.isnan(x) else x) for t, x in sorted(held.items())])
        else:
            self.buffer.clear()

    def close(self) -> None:
        pass


COLUMNS = [c.split()[0] for c in GRIDS.split(", ")]


def window_grids(samples: DataFrame, rows: int, eps: float = 1e-3, mode: str = "abs", late: str = "10 minutes", patience_ms: int = 60_000) -> DataFrame:
    """One row for each window of ``rows`` steps of a stream (grid_id, var, t, x, ts): its grid and parameters.

    ``t`` numbers a series' steps from 0; a window is full when all its steps are there, whatever their order.
    Windows leave in order.  A repeated step's last value counts, ``late`` the samples whose window was gone.
    Steps that never came are left out of a short window.  Needs the RocksDB state store, which is set here.
    """
    if rows <= 0:
        raise ValueError("a window has at least one row")
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = samples.select("grid_id", "var", F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x"), "ts").withWatermark("ts", late).groupBy("grid_id", "var")
    return keyed.transformWithStateInPandas(statefulProcessor=RowWindows(rows, eps, mode, patience_ms), outputStructType=GRIDS, outputMode="Append", timeMode="EventTime")


def as_grid(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``window_grids`` as the batch encoder's grid (grid_id, var, t, pixel, esc) and parameters."""
    cells = windows.select("grid_id", "var", F.posexplode(F.arrays_zip("pixels", "escapes")).alias("i", "c"))
    grid = cells.select("grid_id", "var", (F.col("i") + 1).cast("long").alias("t"), F.col("c.pixels").cast("short").alias("pixel"), F.col("c.escapes").alias("esc"))
    return grid, windows.select("grid_id", "var", "q", "s", "m0", F.lit(0).alias("pred"), F.lit(1).alias("lag"))


def window_features(windows: DataFrame) -> DataFrame:
    """The six numbers of each variable of each window's grid, as ``per_row_features`` defines them."""
    grid, _ = as_grid(windows)
    r = F.when(F.col("esc").isNull(), F.col("pixel").cast("long") - CENTER).otherwise(INLINE + 1)
    return detect.per_row_features(grid.select(F.col("grid_id").alias("win_id"), "var", F.col("t").alias("pos"), "pixel", r.alias("r")), wide=False)


def scored(features: DataFrame, rules: DataFrame) -> DataFrame:
    """win_id, var, feature, v, cut, direction and alarm for each feature that a rule names; rules are few."""
    long = features.unpivot(["win_id", "var"], detect.PER_ROW, "feature", "v")
    named = rules.select("feature", "direction", "cut")
    above = F.when(F.col("direction") == "above", F.col("v") > F.col("cut")).otherwise(F.col("v") < F.col("cut"))
    return long.join(named, "feature").withColumn("alarm", above)


def alarm_each_batch(windows: DataFrame, rules: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Scores the windows of every micro-batch by the rules as they stand then, and hands alarms to ``sink``.

    ``rules`` is called for each batch, so a table that was changed between batches counts from the next one.
    The batch number lets a sink make retries idempotent.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # a batch of windows, read once by each of its features' aggregates
        try:
            sink(scored(window_features(batch), rules()), number)
        finally:
            batch.unpersist()

    return windows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("append").options(**options).start()
