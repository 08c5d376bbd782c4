"""Alignment of originals with reconstructions and all error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.frames import SERIES

EPS = 1e-9


def align(samples: DataFrame, rebuilt: DataFrame, check: bool = True) -> DataFrame:
    """x and x_hat of the same cells; cells that only one side has are an error."""
    other = rebuilt.select(*SERIES, "t", F.col("x_hat"))
    if not check:
        return samples.join(other, [*SERIES, "t"])
    both = samples.withColumn("__l", F.lit(1)).join(other.withColumn("__r", F.lit(1)), [*SERIES, "t"], "full_outer")
    alone = F.col("__l").isNull() | F.col("__r").isNull()
    return both.withColumn("t", F.when(alone, F.raise_error(F.lit("original and reconstruction differ in shape"))).otherwise(F.col("t"))).drop("__l", "__r")


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; 0 where one side doesn't vary."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.coalesce(F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / (sx * sy)), F.lit(0.0))


def error_columns(x: Column | None = None, y: Column | None = None) -> dict[str, Column]:
    """Aggregate expressions over aligned rows: rmse, mae, mape, smape, corr and max_error."""
    x, y = F.col("x") if x is None else x, F.col("x_hat") if y is None else y
    e = F.abs(x - y)
    return {
        "rmse": F.sqrt(F.avg((x - y) * (x - y))), "mae": F.avg(e),
        "mape": F.avg(e / F.greatest(F.abs(x), F.lit(EPS))) * 100.0,
        "smape": F.avg(2.0 * e / F.greatest(F.abs(x) + F.abs(y), F.lit(EPS))) * 100.0,
        "corr": correlation(x, y), "max_error": F.max(e),
    }


def metrics(aligned: DataFrame, by: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    return aligned.groupBy(*by).agg(*[c.alias(k) for k, c in error_columns().items()])


def masked_smapes(aligned: DataFrame, by: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """smape_masked counts cells with no magnitude as 0, smape_masked_mean leaves them out."""
    size = F.abs("x") + F.abs("x_hat")
    part = 2.0 * F.abs(F.col("x") - F.col("x_hat")) / size
    return aligned.groupBy(*by).agg((F.avg(F.when(size > 1e-12, part).otherwise(0.0)) * 100.0).alias("smape_masked"), (F.avg(F.when(size > 1e-12, part)) * 100.0).alias("smape_masked_mean"))


def relative_metrics(aligned: DataFrame, by: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """rmse over the deviation and over the range of the original; NaN where those are next to nothing."""
    parts = aligned.groupBy(*by).agg(error_columns()["rmse"].alias("rmse"), F.stddev_pop("x").alias("__sd"), (F.max("x") - F.min("x")).alias("__range"))
    over = lambda c: F.when(F.col(c) > 1e-9, F.col("rmse") / F.col(c)).otherwise(F.lit(float("nan")))
    return parts.select(*by, "rmse", over("__sd").alias("rel_rmse"), over("__range").alias("nrmse"))


def per_var_metrics(aligned: DataFrame) -> DataFrame:
    """All metrics by variable and by grid (var null) in one pass."""
    return aligned.rollup("grid_id", "var").agg(F.grouping_id().alias("__g"), *[c.alias(k) for k, c in error_columns().items()]).filter("__g < 3").drop("__g")


def rel_error_pct(aligned: DataFrame) -> DataFrame:
    """Mean error over each variable's mean magnitude, in percent."""
    scale = aligned.groupBy(*SERIES).agg(F.avg(F.abs("x")).alias("__m"))
    return aligned.join(scale, list(SERIES)).groupBy("grid_id").agg((F.avg(F.when(F.col("__m") > 0, F.abs(F.col("x") - F.col("x_hat")) / F.col("__m"))) * 100.0).alias("rel_error_pct"))


def safety_check(aligned: DataFrame, limit: float) -> DataFrame:
    return metrics(aligned).select("grid_id", "rmse", (F.col("rmse") <= limit).alias("ok"))


def verify_bound(aligned: DataFrame, params: DataFrame, eps: float, mode: str = "abs", tau: float = 0.0) -> DataFrame:
    """Cells and violations of the promised bound by grid, and the worst error in units of the step."""
    joined = aligned.join(params, list(SERIES))
    e = F.abs(F.col("x") - F.col("x_hat"))
    if tau > 0.5:
        bad = e > tau * F.col("q") * (1 + 1e-9) + 1e-12
    elif mode == "abs":
        bad = e > F.col("q") / 2.0 * (1 + 1e-9) + 1e-12
    else:
        bad = e / F.sqrt(F.col("x") * F.col("x") + F.col("s") * F.col("s")) > 1.05 * eps
    return joined.groupBy("grid_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if(bad).alias("violations"), F.max(e / F.col("q")).alias("worst_steps"))


def compare_per_var(a: DataFrame, b: DataFrame) -> DataFrame:
    """rmse of two methods by variable and their difference."""
    one = metrics(a, SERIES).select(*SERIES, F.col("rmse").alias("rmse_a"))
    two = metrics(b, SERIES).select(*SERIES, F.col("rmse").alias("rmse_b"))
    return one.join(two, list(SERIES)).withColumn("difference", F.col("rmse_a") - F.col("rmse_b"))


def worst_variables(compared: DataFrame, k: int = 3) -> DataFrame:
    return compared.orderBy(F.desc("difference"), *SERIES).limit(k)


def classification_metrics(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """f1, precision, recall and accuracy of predicted against label."""
    p, y = F.col("predicted") == 1, F.col("label") == 1
    counts = df.groupBy(*by).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(p == y).alias("right"), F.count(F.lit(1)).alias("n"))
    return classification_shares(counts, by)


def classification_shares(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The metrics from counts (tp, fp, fn, right and n)."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*by, share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(F.col("right"), F.col("n")).alias("accuracy"))
