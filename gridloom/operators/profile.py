"""Statistics of variables, correlation, autocorrelation, seasonal lag, and the entropy cost of residuals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import INLINE
from gridloom.operators import bank
from gridloom.operators.frames import SERIES, series
from gridloom.operators.metrics import correlation
from gridloom.operators.quantiles import few_rows, percentiles
from gridloom.plans.durable import keep


def var_profile(samples: DataFrame, median: bool = True) -> DataFrame:
    """Statistics of each variable; ``abs_median``, which takes the most work, only if asked for.

    Long series get it by selection (see ``quantiles``), which counts before it decides.
    """
    x, size = F.col("x"), F.abs("x")
    stats = [
        F.count(x).alias("n"), F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min_by("x", "t").alias("x_first"), F.max_by("x", "t").alias("x_last"),
        F.stddev_pop(x).alias("x_std"), F.avg(size).alias("abs_mean"), F.min(size).alias("abs_min"),
    ]
    if not median:
        return samples.groupBy(*SERIES).agg(*stats)
    if few_rows(samples, list(SERIES)):
        return samples.groupBy(*SERIES).agg(*stats, F.percentile(size, F.lit(0.5)).alias("abs_median"))
    return samples.groupBy(*SERIES).agg(*stats).join(percentiles(samples, list(SERIES), size, {"abs_median": 0.5}), list(SERIES))


def derive_scale(profile: DataFrame, rel_scale: DataFrame | None = None) -> DataFrame:
    """Adds ``s``: a hundredth of the median magnitude, or of the deviation where that is 0; 1e-12 at least."""
    s = F.when(F.col("abs_median") > 0, F.greatest(0.01 * F.col("abs_median"), F.lit(1e-12))).otherwise(F.greatest(0.01 * F.col("x_std"), F.lit(1e-12)))
    if rel_scale is None:
        return profile.withColumn("s", s)
    given = rel_scale.select(*SERIES, F.col("s").alias("__s"))
    return profile.join(given, list(SERIES), "left").withColumn("s", F.coalesce("__s", s)).drop("__s")


def derive_step(profile: DataFrame, eps: float, mode: str = "abs") -> DataFrame:
    """Adds the lattice step ``q`` for the bound ``eps`` (of the range, or relative to each value)."""
    if mode not in ("abs", "rel"):
        raise ValueError(f"mode must be abs or rel, not {mode}")
    if mode == "rel":
        return profile.withColumn("q", 2.0 * F.log1p(F.lit(eps)))
    span = F.col("x_max") - F.col("x_min")
    return profile.withColumn("q", 2.0 * eps * F.when(span <= 0, F.greatest(F.abs("x_first"), F.lit(1.0))).otherwise(span))


def adaptive_clamp(pct: DataFrame, percentile: float = 0.995, cap: float = 500.0) -> DataFrame:
    """clamp of each variable: between a high percentile of the changes and a tenth above the largest."""
    size = F.abs("pct")
    if few_rows(pct, list(SERIES)):
        stats = pct.groupBy(*SERIES).agg(F.percentile(size, F.lit(percentile)).alias("p"), F.max(size).alias("m"))
    else:
        stats = pct.groupBy(*SERIES).agg(F.max(size).alias("m")).join(percentiles(pct, list(SERIES), size, {"p": percentile}), list(SERIES))
    return stats.select(*SERIES, clamp_of(F.col("p"), F.col("m"), cap).alias("clamp"))


def clamp_of(p: Column, m: Column, cap: float = 500.0) -> Column:
    """The clamp from a high percentile and the largest of the changes."""
    blend = F.least(F.greatest((m / (p + 1e-10) - 2.0) / 8.0, F.lit(0.0)), F.lit(1.0))
    mixed = blend * p + (1.0 - blend) * (m * 1.1)
    return F.least(F.greatest(F.coalesce(mixed, F.lit(cap)), F.lit(1.0)), F.lit(cap))


def residual_histogram(residuals: DataFrame, key: tuple[str, ...] = (*SERIES, "pred")) -> DataFrame:
    """Counts of each symbol; residuals that don't fit a pixel are one symbol (null)."""
    return residuals.groupBy(*key, F.when(F.abs("r") <= INLINE, F.col("r")).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


def row_cost(histogram: DataFrame, key: tuple[str, ...] = (*SERIES, "pred")) -> DataFrame:
    """Estimated bytes: entropy of the symbols, and twelve bytes for each escape."""
    n = F.sum("n").over(Window.partitionBy(*key))
    parts = histogram.withColumn("__n", n).withColumn("__bits", -F.col("n") * F.log2(F.col("n") / F.col("__n")))
    return parts.groupBy(*key).agg((F.sum("__bits") / 8.0 + 12.0 * F.sum(F.when(F.col("symbol").isNull(), F.col("n")).otherwise(0))).alias("cost"))


def changes(samples: DataFrame) -> DataFrame:
    """grid_id, var, t and d, the change of x since the step before."""
    return samples.withColumn("d", F.col("x") - F.lag("x").over(series())).filter(F.col("d").isNotNull()).select("grid_id", "t", "var", "d")


def correlation_pairs(samples: DataFrame) -> DataFrame:
    """Pearson correlation of the changes of each two variables a < b of a grid; undefined is 0.

    Products are summed by the steps two variables share, each step a row of its variables' changes.  For grids of many variables use
    ``correlation_rows``, which never pairs rows.
    """
    steps = changes(samples).groupBy("grid_id", "t").agg(F.sort_array(F.collect_list(F.struct("var", "d"))).alias("c"))
    later = lambda c, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda b: F.struct(c["var"].alias("a"), b["var"].alias("b"), c["d"].alias("da"), b["d"].alias("db")))
    pairs = steps.select("grid_id", F.explode(F.flatten(F.transform("c", later))).alias("p")).select("grid_id", "p.*").groupBy("grid_id", "a", "b")
    return pairs.agg(correlation(F.col("da"), F.col("db")).alias("corr"))


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each grid of a task the sums over its steps, a row for each variable i: pairs present, and over the steps
    that variable j has too the values of i, their squares and the products."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        grids, sizes, cells = batch.column("grid_id").to_pylist(), batch.column("size").to_numpy(), batch.column("v")
        edges = np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy())])
        flat = cells.flatten()
        place, value = flat.field("i").to_numpy(), flat.field("d").to_numpy()
        by_grid: dict[str, list[int]] = {}
        for k, g in enumerate(grids):
            by_grid.setdefault(g, []).append(k)
        for g, steps in by_grid.items():
            n = int(sizes[steps[0]])
            have = sums.setdefault(g, np.zeros((4, n, n)))
            for start in range(0, len(steps), 256):
                part = steps[start : start + 256]
                x, seen = np.zeros((len(part), n)), np.zeros((len(part), n))
                for row, k in enumerate(part):
                    at = place[edges[k] : edges[k + 1]]
                    x[row, at], seen[row, at] = value[edges[k] : edges[k + 1]], 1.0
                have += np.stack([seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x])
    for g, (n, s, q, c) in sums.items():
        rows = [pa.array(list(m), pa.list_(pa.float64())) for m in (n, s, q, c)]
        yield pa.RecordBatch.from_arrays([pa.array([g] * len(n)), pa.array(range(len(n)), pa.int32()), *rows], ["grid_id", "row", "n", "s", "q", "c"])


def _correlated(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("row")
    corr = _from_sums(*(np.vstack(frame[k].to_numpy()) for k in "nsqc"))
    return pd.DataFrame({"grid_id": frame["grid_id"], "row": frame["row"], "corr": list(corr)})


def _from_sums(n: np.ndarray, s: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        cov, own = c - s * s.T / n, q - s * s / n
        flat = 1e-14 * q  # what rounding leaves of a constant
        good = (own > flat) & (own.T > flat.T) & (n > 0)
        return np.where(good, cov / np.sqrt(np.where(good, own * own.T, 1.0)), 0.0)


def _whole_grid(key: tuple, cells: pa.Table) -> pa.Table:
    """The sums of ``_gram`` and the correlations of a grid that fits a task; a part of its steps is a matrix at a time."""
    names = cells.column("var").combine_chunks().dictionary_encode()
    by_name = pc.sort_indices(names.dictionary)
    place, v = np.argsort(by_name.to_numpy())[names.indices.to_numpy()], len(by_name)
    value, at = cells.column("d").to_numpy().astype(np.float64), np.unique(cells.column("t").to_numpy(), return_inverse=True)[1]
    order, part = np.argsort(at, kind="stable"), max(1, (1 << 20) // v)
    sums = np.zeros((4, v, v))
    cuts = np.searchsorted(at[order], np.arange(0, at.max() + 1 + part, part))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        k = order[a:b]
        x, seen = np.zeros((2, min(part, at.max() + 1 - i * part), v))
        x[at[k] - i * part, place[k]], seen[at[k] - i * part, place[k]] = value[k], 1.0
        sums += np.stack([seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x])
    matrix = pa.ListArray.from_arrays(pa.array(np.arange(v + 1) * v, pa.int32()), pa.array(_from_sums(*sums).ravel()))
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, v], pa.int32()), values)
    return pa.table({"grid_id": pa.array([key[0].as_py()], pa.string()), "names": one(names.dictionary.take(by_name)), "corr": one(matrix)})


def _whole_grids(steps: DataFrame) -> DataFrame:
    """A row for each grid: its variables in order of name and the matrix of their correlations.

    For grids that fit a task; cells that are dealt by grid_id are neither shuffled again nor joined.
    """
    return steps.select("grid_id", "var", "t", "d").groupBy("grid_id").applyInArrow(_whole_grid, "grid_id string, names array<string>, corr array<array<double>>")


def correlation_rows(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pearson correlations of ``d`` of all variables of each grid over the steps two of them share; undefined is 0.

    Returns grid_id, row and corr (an array over all rows), and the rows' names (grid_id, var, row; in order of
    name).  Tasks add up products of blocks of steps; what they send is a row for each variable, so that a
    grid of V variables costs a task V * V numbers, and pairs of cells are never made.  Where all grids fit a task each
    is summed up whole.
    """
    if bank.small(steps):
        grids = keep(_whole_grids(steps))
        return grids.select("grid_id", F.posexplode("corr").alias("row", "corr")), grids.select("grid_id", F.posexplode("names").alias("row", "var")).select("grid_id", "var", "row")
    return _rows_from_parts(steps)


def _rows_from_parts(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``correlation_rows`` of grids of any size."""
    names = steps.select("grid_id", "var").distinct()
    names = keep(names.withColumn("row", (F.row_number().over(Window.partitionBy("grid_id").orderBy("var")) - 1).cast("int")))
    sizes = names.groupBy("grid_id").agg(F.count(F.lit(1)).cast("int").alias("size"))
    cells = steps.join(names, ["grid_id", "var"]).groupBy("grid_id", "t").agg(F.collect_list(F.struct(F.col("row").alias("i"), F.col("d").cast("double").alias("d"))).alias("v"))
    parts = cells.join(sizes, "grid_id").select("grid_id", "size", "v").mapInArrow(_gram, "grid_id string, row int, n array<double>, s array<double>, q array<double>, c array<double>")
    plus = lambda c: F.aggregate(F.slice(c, 2, 1 << 30), F.get(c, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias(c)
    dealt = parts.withColumn("__salt", F.spark_partition_id() % 32)
    for keys in (["grid_id", "row", "__salt"], ["grid_id", "row"]):  # no row waits for all tasks' arrays at once
        dealt = dealt.groupBy(*keys).agg(*[F.collect_list(c).alias(c) for c in "nsqc"]).select(*keys, *[plus(c) for c in "nsqc"])
    return dealt.groupBy("grid_id").applyInPandas(_correlated, "grid_id string, row int, corr array<double>"), names


def correlation_wide(samples: DataFrame) -> DataFrame:
    """As ``correlation_pairs``, by ``correlation_rows``; grids that fit a task need no table of names."""
    if bank.small(samples):
        rows = _whole_grids(changes(samples)).select("grid_id", "names", F.posexplode("corr").alias("i", "r")).select("grid_id", "names", "i", F.posexplode("r").alias("j", "corr"))
        return rows.filter("i < j").select("grid_id", F.get("names", F.col("i")).alias("a"), F.get("names", F.col("j")).alias("b"), "corr")
    rows, names = _rows_from_parts(changes(samples))
    pairs = rows.select("grid_id", F.col("row").alias("i"), F.posexplode("corr").alias("j", "corr")).filter("i < j")
    name = lambda row, out: names.select("grid_id", F.col("row").alias(row), F.col("var").alias(out))
    return pairs.join(name("i", "a"), ["grid_id", "i"]).join(name("j", "b"), ["grid_id", "j"]).select("grid_id", "a", "b", "corr")


def _lag_sums(max_lag: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        v, n = frame["v"].to_numpy(), int(frame["own"].sum())
        # The block's own steps against all: one product in the frequency domain gives the sums at all lags.
        size = 1 << int(np.ceil(np.log2(max(len(v) + n, 2))))
        sums = np.zeros(max_lag)
        found = np.fft.irfft(np.conj(np.fft.rfft(v[:n], size)) * np.fft.rfft(v, size), size)[: min(max_lag, len(v))]
        sums[: len(found)] = found
        return pd.DataFrame({"grid_id": key[0], "var": key[1], "lag": range(max_lag), "s": sums})

    return run


def autocorrelation(samples: DataFrame, value: str = "x", max_lag: int = 2048, block: int = 50_000) -> DataFrame:
    """Autocorrelation of the mean-free changes of each variable at lags 0 to min(max_lag, n / 2) - 1.

    A block of steps also gets the ``max_lag`` steps after it, so blocks are summed up alone and added.
    """
    steps = samples.withColumn("v", F.col(value).cast("double") - F.lag(value).over(series())).filter(F.col("v").isNotNull())
    stats = steps.groupBy(*SERIES).agg(F.avg("v").alias("__mean"), F.count("v").alias("__n"))
    centred = steps.join(stats, list(SERIES)).withColumn("v", F.col("v") - F.col("__mean")).select(*SERIES, "t", "v")
    blk = F.floor((F.col("t") - 1) / F.lit(block))
    reach = F.floor((F.col("t") - 1 - max_lag) / F.lit(block))
    spread = centred.withColumn("own_blk", blk).withColumn("blk", F.explode(F.sequence(F.greatest(reach, F.lit(0).cast("long")), blk)))
    spread = spread.withColumn("own", (F.col("blk") == F.col("own_blk")).cast("int")).select(*SERIES, "blk", "t", "v", "own")
    sums = spread.groupBy(*SERIES, "blk").applyInPandas(_lag_sums(max_lag), "grid_id string, var string, lag int, s double")
    total = sums.groupBy(*SERIES, "lag").agg(F.sum("s").alias("s")).join(stats, list(SERIES)).filter(F.col("lag") < F.least(F.lit(max_lag), F.floor(F.col("__n") / 2)))
    zero = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(Window.partitionBy(*SERIES))
    return total.select(*SERIES, "lag", F.when(zero > 0, F.col("s") / zero).otherwise(0.0).alias("ac"))


def seasonal_lag(ac: DataFrame, least: float = 0.3) -> DataFrame:
    """lag of each variable: the first of the highest autocorrelations from lag 2 on if above ``least``, else 1."""
    best = ac.filter("lag >= 2").groupBy(*SERIES).agg(F.max_by("lag", F.struct(F.round("ac", 9), -F.col("lag"))).alias("l"), F.max("ac").alias("m"), F.max("lag").alias("top"))
    return ac.select(*SERIES).distinct().join(best, list(SERIES), "left").select(*SERIES, F.when((F.col("m") > least) & (F.col("top") >= 3), F.col("l")).otherwise(1).cast("int").alias("lag"))
