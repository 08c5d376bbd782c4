"""Tables of runs: flattening, upserts, Pareto fronts, selections, iso-error comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flatten_runs(runs: DataFrame) -> DataFrame:
    """One flat row for each run: the metrics' fields as columns, and the method's category."""
    category = F.when(F.col("method").rlike("^(base|adaptive|mulaw|lattice)"), "grid").when(F.col("method").isin("paa", "pla", "sax"), "segments").when(F.col("method").rlike("^delta"), "delta").otherwise("file")
    fixed = [c for c in runs.columns if c != "metrics"]
    return runs.select(*fixed, *(["metrics.*"] if "metrics" in runs.columns else []), category.alias("category"))


def merge_runs(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ("dataset", "method")) -> DataFrame:
    """Upsert: of rows with the same key the new one wins, of several new ones the first by all other columns."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    sortable = [c for c, t in both.dtypes if c not in (*key, "__new") and not t.startswith("map")]
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__new"), *sortable))
    return both.withColumn("__rank", last).filter("__rank = 1").drop("__new", "__rank")


def union_methods(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _least(runs: DataFrame, x: str, value: Column, by: tuple[str, ...]) -> DataFrame:
    """For each group and x one row of the smallest value, and the smallest value of all smaller x (``__before``).

    The rows of a group are reduced to one for each x before they meet, however many a group has.
    """
    best = runs.withColumn("__value", value).groupBy(*by, F.col(x).alias("__x")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in runs.columns]), "__value").alias("__row"), F.min("__value").alias("__value"))
    return best.withColumn("__before", F.min("__value").over(Window.partitionBy(*by).orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)))


def pareto_front(runs: DataFrame, x: str, y: str, by: tuple[str, ...] = ("dataset",), maximize_y: bool = False) -> DataFrame:
    """Rows that no other beats in both: in order of x, those with a strictly better y than all before.

    Of rows equal in both one stays.
    """
    least = _least(runs, x, -F.col(y) if maximize_y else F.col(y), by)
    front = least.filter(F.col("__before").isNull() | (F.col("__value") < F.col("__before")))
    return front.select(*[F.col("__row").getField(c).alias(c) for c in runs.columns])


def dominated(runs: DataFrame, x: str, y: str, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Rows that another row of the same group equals or beats in both and beats in one.

    A row is dominated if a smaller x, or the same x, has a smaller y, or a smaller x has the same y; one row for
    each x tells, and meets the rows in a join that Spark can split.
    """
    least = _least(runs, x, F.col(y), by).select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(by)], "__x", "__value", "__before")
    on = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(by)] + [F.col(x) == F.col("__x")]
    return runs.join(least, on).filter((F.col("__before") <= F.col(y)) | (F.col("__value") < F.col(y))).select(*[F.col(f"`{c}`") for c in runs.columns])


def front_share(runs: DataFrame, x: str, y: str, family: str = "category", by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    front = pareto_front(runs, x, y, by).groupBy(*by, family).agg(F.count(F.lit(1)).alias("on_front"))
    return front.withColumn("front_size", F.sum("on_front").over(Window.partitionBy(*by)))


def select_best(runs: DataFrame, target_rmse: float | None = None, target_ratio: float | None = None, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """The run of each group that meets the one target best; ``met`` says whether any does."""
    if (target_rmse is None) == (target_ratio is None):
        raise ValueError("set exactly one of target_rmse and target_ratio")
    if target_rmse is not None:
        ok = F.coalesce(F.col("rmse") <= target_rmse, F.lit(False))
        order = [F.desc("__ok"), F.when(F.col("__ok"), F.col("bytes")).asc_nulls_last(), F.col("rmse").asc_nulls_last(), F.col("bytes"), F.col("method")]
    else:
        ok = F.coalesce(F.col("ratio") <= target_ratio, F.lit(False))
        order = [F.desc("__ok"), F.when(F.col("__ok"), F.col("rmse")).asc_nulls_last(), F.col("bytes"), F.col("rmse"), F.col("method")]
    ranked = runs.withColumn("__ok", ok).withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter("__rank = 1").withColumnRenamed("__ok", "met").drop("__rank")


def pick_reporting(runs: DataFrame, corr: float = 0.95, rel_rmse: float = 0.25, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """The smallest run that is good enough, else the most accurate one."""
    good = F.coalesce((F.col("corr") >= corr) & (F.col("rel_rmse") <= rel_rmse), F.lit(False))
    order = [F.desc("__good"), F.when(F.col("__good"), F.col("bytes")).asc_nulls_last(), F.col("rmse").asc_nulls_last(), F.col("bytes"), F.col("method")]
    ranked = runs.withColumn("__good", good).withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter("__rank = 1").withColumnRenamed("__good", "good").drop("__rank")


def best_per_config(runs: DataFrame, by: tuple[str, ...] = ("dataset", "bits", "clamp")) -> DataFrame:
    ranked = runs.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy("bytes", "rmse", "method")))
    return ranked.filter("__rank = 1").drop("__rank")


def summary_table(runs: DataFrame) -> DataFrame:
    """By dataset: the best grid method's ratio beside those of PAA and of the raw file."""
    at = lambda c, v: F.min(F.when(c, F.col(v)))
    return runs.groupBy("dataset").agg(
        at(F.col("category") == "grid", "ratio").alias("best_grid_ratio"), at(F.col("category") == "grid", "rmse").alias("best_grid_rmse"),
        at(F.col("method") == "paa", "ratio").alias("paa_ratio"), at(F.col("method") == "paa", "rmse").alias("paa_rmse"), at(F.col("category") == "delta", "ratio").alias("lossless_ratio"),
    )


def iso_interpolate(a: DataFrame, b: DataFrame, points: int = 12) -> DataFrame:
    """Ratios of two curves (dataset, rmse, ratio) at the same errors, by log-log interpolation.

    ``points`` errors are spread over what both curves cover.  Grid and knots are put in one order, and each
    grid point looks back and ahead to its neighbouring knots.
    """
    log = lambda df, name: df.filter("rmse > 0").select("dataset", F.lit(name).alias("curve"), F.log10("rmse").alias("lx"), F.log10("ratio").alias("ly"))
    knots = log(a, "a").unionByName(log(b, "b"))
    ends = knots.groupBy("dataset", "curve").agg(F.min("lx").alias("lo"), F.max("lx").alias("hi")).groupBy("dataset").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.count(F.lit(1)).alias("n"))
    span = ends.filter("n = 2 and hi > lo").withColumn("lo", F.col("lo") + F.log10(F.lit(1.001))).withColumn("hi", F.col("hi") + F.log10(F.lit(0.999)))
    at = span.select("dataset", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "lo", "hi").withColumn("lx", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    grid = at.select("dataset", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("curve"), "i", "lx")
    line = knots.withColumn("i", F.lit(None).cast("int")).unionByName(grid.withColumn("ly", F.lit(None).cast("double")))
    order = [F.col("lx"), F.col("i").asc_nulls_first(), F.col("ly")]
    back = Window.partitionBy("dataset", "curve").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("dataset", "curve").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    knot = F.when(F.col("ly").isNotNull(), F.struct("lx", "ly"))
    found = line.withColumn("l", F.last(knot, True).over(back)).withColumn("r", F.first(knot, True).over(ahead)).filter("i is not null")
    width = F.col("r.lx") - F.col("l.lx")
    value = F.when(F.col("l").isNull(), F.col("r.ly")).when(F.col("r").isNull(), F.col("l.ly")).when(width == 0, F.col("l.ly")).otherwise(F.col("l.ly") + (F.col("r.ly") - F.col("l.ly")) * (F.col("lx") - F.col("l.lx")) / width)
    both = found.groupBy("dataset", "i", "lx").pivot("curve", ["a", "b"]).agg(F.first(F.pow(F.lit(10.0), value)))
    return both.select("dataset", "i", F.pow(F.lit(10.0), F.col("lx")).alias("rmse"), F.col("a").alias("ratio_a"), F.col("b").alias("ratio_b"), (F.col("b") / F.col("a")).alias("advantage"))


def stream_totals(windows: DataFrame) -> DataFrame:
    """Totals by method of windows encoded one by one (method, bytes_in, bytes_out, rows)."""
    return windows.groupBy("method").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("rows").alias("rows"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), (F.sum("bytes_out") / F.sum("bytes_in")).alias("ratio")
    )
