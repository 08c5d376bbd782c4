"""The error-bounded lattice grid: encode, predictor bank, variable order, decode."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import asinh_scale, asinh_scale_inv, escaped, lattice_quantize, lattice_value, pixel, residual
from gridloom.operators import bank, profile, sequence
from gridloom.operators.bank import P1, P2, PL, PS
from gridloom.operators.clean import sanitize
from gridloom.operators.frames import SERIES, series
from gridloom.plans.blockscan import block_for
from gridloom.plans.durable import keep

#: Block scan where the longest series asks for it.
AUTO = "auto"
#: Up to so many variables correlations are summed pair by pair, beyond by products of blocks of steps.
FEW_VARIABLES = 16


def _params(samples: DataFrame, eps: float, mode: str, rel_scale: DataFrame | None = None, scale: bool = True) -> DataFrame:
    """q, s and the first value of each variable; without ``scale`` s is null and no median is needed."""
    stats = profile.var_profile(samples, median=scale)
    scaled = profile.derive_scale(stats, rel_scale) if scale else stats.withColumn("s", F.lit(None).cast("double"))
    return profile.derive_step(scaled, eps, mode).select(*SERIES, "q", "s", "x_first")


def params(samples: DataFrame, eps: float = 1e-3, mode: str = "abs", rel_scale: DataFrame | None = None, scale: bool = True) -> DataFrame:
    """grid_id, var, q and s from one pass over the samples; only the ``rel`` mode uses ``s``."""
    return _params(samples, eps, mode, rel_scale, scale).select(*SERIES, "q", "s")


def coordinates(samples: DataFrame, var_params: DataFrame, mode: str = "abs", tau: float = 0.0, restart_block: int | None = None, block: int | None = None) -> DataFrame:
    """Lattice coordinates ``m``; the dead zone holds for ``tau`` above a half."""
    y = asinh_scale(F.col("x"), F.col("s")) if mode == "rel" else F.col("x")
    with_y = samples.join(var_params, list(SERIES)).withColumn("y", y)
    if tau > 0.5:
        return sequence.deadzone_lattice(with_y, tau, restart_block, block).select(*SERIES, "t", "m")
    return with_y.select(*SERIES, "t", lattice_quantize(F.col("y"), F.col("q")).alias("m"))


def beside(samples: DataFrame, eps: float = 1e-3, mode: str = "abs", rel_scale: DataFrame | None = None) -> DataFrame:
    """Sanitized samples with q, s, first value and coordinate ``m`` beside each: all of it windows over one order.

    For series that fit a task (see ``block_for``).  Tables of parameters would have to be joined to every cell.
    """
    whole = series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    clean = sanitize(samples)
    stats = {"x_min": F.min("x").over(whole), "x_max": F.max("x").over(whole), "x_first": F.first("x").over(whole)}
    if mode == "rel":
        stats |= {"abs_median": F.percentile(F.abs("x"), F.lit(0.5)).over(whole), "x_std": F.stddev_pop("x").over(whole)}
    rows = clean.withColumns(stats)
    rows = profile.derive_scale(rows, rel_scale) if mode == "rel" else rows.withColumn("s", F.lit(None).cast("double"))
    rows = profile.derive_step(rows, eps, mode)
    y = asinh_scale(F.col("x"), F.col("s")) if mode == "rel" else F.col("x")
    return rows.select(*samples.columns, "q", "s", "x_first", lattice_quantize(y, F.col("q")).alias("m"))


def encode_beside(samples: DataFrame, eps: float = 1e-3, mode: str = "abs", tau: float = 0.0, block: int | None = None) -> DataFrame:
    """The plain grid beside its samples: q, s and m0 of the series, pixel and esc of the step (null at the first)."""
    y0 = asinh_scale(F.col("x_first"), F.col("s")) if mode == "rel" else F.col("x_first")
    rows = beside(samples, eps, mode).withColumn("m0", lattice_quantize(y0, F.col("q")))
    if tau > 0.5:
        y = asinh_scale(F.col("x"), F.col("s")) if mode == "rel" else F.col("x")
        rows = sequence.deadzone_lattice(rows.withColumn("y", y), tau, None, block, ("x", "s", "m0"))
    rows = rows.withColumn("r", F.col("m") - F.lag("m").over(series()))
    return rows.select(*samples.columns, "q", "s", "m0", F.when(F.col("r").isNotNull(), pixel(F.col("r"))).alias("pixel"), escaped(F.col("r")).alias("esc"))


def decode_beside(rows: DataFrame, mode: str = "abs") -> DataFrame:
    """``rows`` of ``encode_beside`` with x_hat, rebuilt from pixels, escapes, m0, q and s alone."""
    up_to = series().rowsBetween(Window.unboundedPreceding, 0)
    r = F.when(F.col("pixel").isNotNull(), residual(F.col("pixel"), F.col("esc"))).otherwise(F.lit(0))
    y = lattice_value(F.col("m0") + F.sum(r).over(up_to), F.col("q"))
    return rows.withColumn("x_hat", asinh_scale_inv(y, F.col("s")) if mode == "rel" else y)


def _greedy(frame: pd.DataFrame) -> pd.DataFrame:
    names = np.array(sorted(set(frame["a"]) | set(frame["b"])), object)
    a, b = np.searchsorted(names, frame["a"].to_numpy(object)), np.searchsorted(names, frame["b"].to_numpy(object))
    near = np.zeros((len(names), len(names)))
    near[a, b] = near[b, a] = frame["corr"].abs().to_numpy()
    return pd.DataFrame({"grid_id": frame["grid_id"].iloc[0], "var": names[bank.walk(near)], "row_pos": range(len(names))})


def _greedy_rows(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("row")
    near = np.abs(np.vstack(frame["corr"].to_numpy()))
    np.fill_diagonal(near, 0.0)
    return pd.DataFrame({"grid_id": frame["grid_id"].iloc[0], "row": bank.walk(near), "row_pos": range(len(frame))})


def order_variables(correlations: DataFrame) -> DataFrame:
    """row_pos of each variable: a greedy walk from the one most correlated with all others to the nearest.

    Works on the summary of a grid (one row for each pair of variables), not on its samples.
    """
    return correlations.groupBy("grid_id").applyInPandas(_greedy, "grid_id string, var string, row_pos int")


def walked_order(steps: DataFrame) -> DataFrame:
    """grid_id, var and row_pos by the correlations of ``d`` (grid_id, var, t, d), for thousands of variables as well."""
    rows, names = profile.correlation_rows(steps)
    walked = rows.groupBy("grid_id").applyInPandas(_greedy_rows, "grid_id string, row int, row_pos int")
    return walked.join(names, ["grid_id", "row"]).select(*SERIES, "row_pos")


def choose_predictor(costs: DataFrame) -> DataFrame:
    """pred of the least cost; ties go to the smaller number."""
    return costs.groupBy(*SERIES).agg(F.min_by("pred", F.struct("cost", "pred")).alias("pred"), F.min("cost").alias("cost"))


def bank_residuals(grid: DataFrame, lags: DataFrame, order: DataFrame) -> DataFrame:
    """All candidates, long: grid_id, var, row_pos, t, pred, r (P1, P2, seasonal where lag > 1, PL below row 0)."""
    ordered = grid.join(order, list(SERIES))
    two = sequence.residual_p2(ordered).withColumnRenamed("r", "r2")
    pl = sequence.residual_pl(two).withColumnRenamed("r", "r3")
    ps = sequence.residual_ps(pl, lags).withColumnRenamed("r", "rs").join(lags, list(SERIES))
    near = ps.withColumn("r1", F.col("m") - F.lag("m").over(Window.partitionBy(*SERIES).orderBy("t")))
    each = F.array(
        F.struct(F.lit(P1).alias("pred"), F.col("r1").alias("r")), F.struct(F.lit(P2).alias("pred"), F.col("r2").alias("r")),
        F.struct(F.lit(PS).alias("pred"), F.when(F.col("lag") > 1, F.col("rs")).alias("r")), F.struct(F.lit(PL).alias("pred"), F.col("r3").alias("r")),
    )
    return near.filter("t > 0").select(*SERIES, "row_pos", "t", F.explode(each).alias("c")).select(*SERIES, "row_pos", "t", "c.pred", "c.r").filter("r is not null")


def encode(
    samples: DataFrame, eps: float = 1e-3, mode: str = "abs", predictors: str = "bank", tau: float = 0.0,
    rel_scale: DataFrame | None = None, max_lag: int = 2048, restart_block: int | None = None, block: int | str | None = AUTO,
) -> tuple[DataFrame, DataFrame]:
    """The grid (grid_id, var, t, pixel, esc) and its var_params (q, s, m0, pred, lag, row_pos).

    Every value is rebuilt within eps times its variable's range (``abs``) or about eps times itself
    (``rel``), at any length.  Missing values are filled first.  ``p1`` uses plain differences; ``bank`` takes
    for each variable the predictor whose residuals have the least entropy (whole grids that fit a task are packed for
    it, see ``bank``).  Series of more than a block's steps
    are scanned block by block (``block``: its length, None for never, by default as the longest series asks).
    """
    if predictors not in ("p1", "bank"):
        raise ValueError(f"predictors must be p1 or bank, not {predictors}")
    plain = tau <= 0.5 and rel_scale is None
    if predictors == "bank" and block in (AUTO, None) and plain and bank.whole(samples):
        return bank.tables(keep(bank.encode_rows(beside(samples.select(*SERIES, "t", "x"), eps, mode), max_lag)))
    block = block_for(samples) if block == AUTO else block
    if predictors == "p1" and block is None and plain:
        # Series that fit a task: the grid is windows over one order, and no cell is joined to its parameters.
        rows = encode_beside(samples.select(*SERIES, "t", "x"), eps, mode)
        extra = keep(rows.groupBy(*SERIES).agg(*[F.first(c).alias(c) for c in ("q", "s", "m0")], F.lit(P1).alias("pred"), F.lit(1).alias("lag")))
        extra = extra.withColumn("row_pos", (F.row_number().over(Window.partitionBy("grid_id").orderBy("var")) - 1).cast("int"))
        return rows.filter("t > 0").select(*SERIES, "t", "pixel", "esc"), extra
    clean = sanitize(samples, block)
    scales = keep(_params(clean, eps, mode, rel_scale, scale=mode == "rel"))
    grid = coordinates(clean, scales.drop("x_first"), mode, tau, restart_block, block)
    y0 = asinh_scale(F.col("x_first"), F.col("s")) if mode == "rel" else F.col("x_first")
    scales = scales.withColumn("m0", lattice_quantize(y0, F.col("q"))).drop("x_first")
    if tau > 0.5:
        grid = keep(grid)  # walked in Python, so not again for each reader
    if predictors == "p1":
        # Nothing else is read twice: sanitize's own order serves the differences, and m0 follows from the first value.
        chosen = sequence.residual_p1(grid, block).filter("t > 0").select(*SERIES, "t", "r")
        extra = scales.withColumn("pred", F.lit(P1)).withColumn("lag", F.lit(1))
        extra = extra.withColumn("row_pos", (F.row_number().over(Window.partitionBy("grid_id").orderBy("var")) - 1).cast("int"))
    else:
        grid = grid if tau > 0.5 else keep(grid)
        lags = keep(profile.seasonal_lag(profile.autocorrelation(grid, "m", max_lag)))
        names = grid.select(*SERIES).distinct()
        by_name = names.withColumn("__pos", F.row_number().over(Window.partitionBy("grid_id").orderBy("var")) - 1)
        moves = grid.withColumn("x", F.col("m").cast("double"))
        widest = names.groupBy("grid_id").count().agg(F.max("count")).first()[0] or 0
        walked = order_variables(profile.correlation_pairs(moves)) if widest <= FEW_VARIABLES else walked_order(profile.changes(moves))
        order = keep(by_name.join(walked, list(SERIES), "left").select(*SERIES, F.coalesce("row_pos", "__pos").cast("int").alias("row_pos")))
        lags = names.join(lags, list(SERIES), "left").select(*SERIES, F.coalesce("lag", F.lit(1)).alias("lag"))
        candidates = bank_residuals(grid, lags, order)
        best = keep(choose_predictor(profile.row_cost(profile.residual_histogram(candidates))).select(*SERIES, "pred"))
        chosen = candidates.join(best, [*SERIES, "pred"]).select(*SERIES, "t", "r")
        extra = scales.join(best, list(SERIES), "left").join(lags, list(SERIES)).join(order, list(SERIES))
        extra = extra.withColumn("pred", F.coalesce("pred", F.lit(P1)))
    return chosen.select(*SERIES, "t", pixel(F.col("r")).alias("pixel"), escaped(F.col("r")).alias("esc")), extra


def decode_coordinates(grid: DataFrame, var_params: DataFrame, predictors: str = "bank", block: int | None = None) -> DataFrame:
    """Exact lattice coordinates m of all steps, from pixels, escapes and parameters.

    ``p1`` is one running sum, for grids that were encoded so; ``bank`` takes every variable's own predictor.
    """
    zero = var_params.select(*SERIES, F.lit(0).cast("long").alias("t"), F.lit(None).cast("long").alias("r"))
    rows = grid.select(*SERIES, "t", residual(F.col("pixel"), F.col("esc")).alias("r")).unionByName(zero)
    rows = rows.join(var_params.select(*SERIES, "m0", "pred", "lag", "row_pos"), list(SERIES))
    if predictors == "p1":
        return sequence.accumulate_p1(rows, block).select(*SERIES, "t", "m")
    out = ["grid_id", "var", "row_pos", "t", "m0", "m"]
    plain = sequence.accumulate_p1(rows.filter(F.col("pred") == P1), block).select(out)
    second = sequence.accumulate_p2(rows.filter(F.col("pred") == P2), block).select(out)
    season = sequence.accumulate_ps(rows.filter(F.col("pred") == PS)).select(out)
    known = plain.unionByName(second).unionByName(season)
    # Relative rows: changes of the rows above are summed along runs of rows, then along time.
    k1 = known.withColumn("r", F.col("m") - F.lag("m").over(Window.partitionBy(*SERIES).orderBy("t"))).filter("t > 0").withColumn("pl", F.lit(False))
    relative = rows.filter((F.col("pred") == PL) & (F.col("t") > 0)).withColumn("pl", F.lit(True))
    cells = ["grid_id", "var", "row_pos", "t", "m0", "r", "pl"]
    lined = sequence.accumulate_pl(k1.select(cells).unionByName(relative.select(cells))).filter("pl")
    heads = rows.filter((F.col("pred") == PL) & (F.col("t") == 0)).select(*SERIES, "row_pos", "t", "m0", F.col("r").alias("k1"))
    summed = lined.select(*SERIES, "row_pos", "t", "m0", "k1").unionByName(heads).withColumnRenamed("k1", "r")
    return known.unionByName(sequence.accumulate_p1(summed, block).select(out)).select(*SERIES, "t", "m")


def decode(grid: DataFrame, var_params: DataFrame, mode: str = "abs", predictors: str = "bank", block: int | str | None = AUTO) -> DataFrame:
    """grid_id, var, t and x_hat; ``predictors`` and ``block`` as in ``encode``."""
    block = block_for(grid) if block == AUTO else block
    m = decode_coordinates(grid, var_params, predictors, block).join(var_params.select(*SERIES, "q", "s"), list(SERIES))
    y = lattice_value(F.col("m"), F.col("q"))
    return m.select(*SERIES, "t", (asinh_scale_inv(y, F.col("s")) if mode == "rel" else y).alias("x_hat"))


def ordering_gain(grid: DataFrame, orders: list[DataFrame], walked: DataFrame) -> DataFrame:
    """Mean and deviation of the relative-row cost over ``orders`` and the percent saved by ``walked``.

    The orders of a grid are one small row of arrays; its steps are rows of all variables' changes, and each order's
    residuals are read off such a row.
    """
    k1 = grid.withColumn("k", F.col("m") - F.lag("m").over(series())).filter("k is not null")
    steps = k1.groupBy("grid_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("var", "k"))).alias("k"))
    each = None
    for i, o in enumerate([*orders, walked]):
        one = o.select("grid_id", F.lit(i).alias("pred"), "row_pos", "var")
        each = one if each is None else each.unionByName(one)
    rows = each.groupBy("grid_id", "pred").agg(F.sort_array(F.collect_list(F.struct("row_pos", "var"))).alias("o"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("o") - 1), lambda i: F.struct(F.get("o", i)["row_pos"].alias("at"), F.get("o", i)["var"].alias("var"), F.get("o", i - 1)["row_pos"].alias("before"), F.get("o", i - 1)["var"].alias("above")))
    rows = rows.filter(F.size("o") > 1).select("grid_id", "pred", F.filter(pairs, lambda p: p["before"] == p["at"] - 1).alias("pairs"))
    rows = rows.groupBy("grid_id").agg(F.collect_list(F.struct("pred", "pairs")).alias("orders"))
    told = steps.join(rows, "grid_id").select("grid_id", "k", F.explode("orders").alias("o")).select("grid_id", "k", "o.pred", F.explode("o.pairs").alias("p"))
    r = told.select("grid_id", "p.var", "pred", (F.try_element_at("k", F.col("p.var")) - F.try_element_at("k", F.col("p.above"))).alias("r")).filter("r is not null")
    costs = keep(profile.row_cost(profile.residual_histogram(r)).groupBy("grid_id", "pred").agg(F.sum("cost").alias("cost")))
    mean = costs.filter(F.col("pred") < len(orders)).groupBy("grid_id").agg(F.avg("cost").alias("mean_cost"), F.stddev_pop("cost").alias("std_cost"))
    last = costs.filter(F.col("pred") == len(orders)).select("grid_id", "cost")
    return mean.join(last, "grid_id").withColumn("gain_pct", (1.0 - F.col("cost") / F.col("mean_cost")) * 100.0)


def predictor_mix(var_params: DataFrame) -> DataFrame:
    return var_params.groupBy("grid_id", "pred").agg(F.count(F.lit(1)).alias("variables"))


def escape_count(grid: DataFrame) -> DataFrame:
    return grid.groupBy("grid_id").agg(F.count("esc").alias("escapes"), F.count(F.lit(1)).alias("cells"))
