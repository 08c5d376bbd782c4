"""Cleaning: column choice, gaps, sentinels, offsets.  NaN, infinities and null are all missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.scalar import EPS, finite, finite_or_null
from gridloom.operators.frames import SERIES, series, to_long
from gridloom.plans.blockscan import block_for, running
from gridloom.plans.numbering import numbered

#: A column whose lower-cased name contains one of these isn't a measurement.
DROP_PATTERNS = ("unnamed", "index", "timestamp", "date", "time", "label", "failure", "anomaly", "target")


def select_numeric(df: DataFrame, patterns: tuple[str, ...] = DROP_PATTERNS) -> list[str]:
    """Names of the measurement columns: numeric ones, or where there are none all, to be coerced."""
    kept = [f for f in df.schema if not any(p in f.name.lower() for p in patterns)]
    numeric = [f.name for f in kept if isinstance(f.dataType, T.NumericType)]
    return numeric or [f.name for f in kept]


def drop_all_null_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of ``columns`` with any valid number; none left is an error."""
    counts = df.agg(*[F.count(finite_or_null(F.expr(f"try_cast(`{c}` as double)"))).alias(c) for c in columns]).first()
    left = [c for c in columns if counts[c]]
    if not left:
        raise ValueError("no numeric column has a value")
    return left


def ffill_bfill(samples: DataFrame, block: int | None = None) -> DataFrame:
    """Missing values take the last valid one before, at the start the first one after.

    Without blocks one window does both; with them the first valid values are a table of their own.
    """
    x = finite_or_null(F.col("x"))
    if block is None:
        whole = series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = F.last(x, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))
        return samples.withColumn("x", F.coalesce(before, F.first(x, ignorenulls=True).over(whole)))
    df = running(samples, "last", x, "__f", SERIES, "t", block)
    first = samples.groupBy(*SERIES).agg(F.min_by("x", F.when(finite(F.col("x")), F.col("t"))).alias("__b"))
    return df.join(first, list(SERIES)).withColumn("x", F.coalesce("__f", "__b")).drop("__f", "__b")


def sanitize(samples: DataFrame, block: int | None = None) -> DataFrame:
    """As ``ffill_bfill``; a variable without any valid value is 0."""
    return ffill_bfill(samples, block).withColumn("x", F.coalesce("x", F.lit(0.0)))


def zero_fill(samples: DataFrame) -> DataFrame:
    return samples.withColumn("x", F.when(finite(F.col("x")), F.col("x")).otherwise(0.0))


def sentinel_to_null(samples: DataFrame, equal: float | None = -200.0, at_most: float | None = None) -> DataFrame:
    bad = F.lit(False)
    if equal is not None:
        bad = bad | (F.col("x") == equal)
    if at_most is not None:
        bad = bad | (F.col("x") <= at_most)
    return samples.withColumn("x", F.when(~bad, F.col("x")))


def zero_baseline_offset(samples: DataFrame) -> DataFrame:
    """Adds ``value_offset`` where a variable starts at 0: its mean magnitude, or 1 where that is 0."""
    stats = samples.groupBy(*SERIES).agg(F.min_by("x", "t").alias("__0"), F.avg(F.abs("x")).alias("__m"))
    offset = F.when(F.col("__0") == 0, F.when(F.col("__m") == 0, 1.0).otherwise(F.col("__m"))).otherwise(0.0)
    return samples.join(stats.select(*SERIES, offset.alias("value_offset")), list(SERIES)).withColumn("x", F.col("x") + F.col("value_offset"))


def auto_offset(samples: DataFrame, eps: float = EPS, factor: float = 0.1) -> DataFrame:
    """value_offset of each variable that makes it safely positive."""
    stats = samples.groupBy(*SERIES).agg(F.min("x").alias("lo"), F.stddev_pop("x").alias("sd"), F.min(F.abs("x")).alias("near"))
    return stats.select(*SERIES, offset_of(F.col("lo"), F.col("sd"), F.col("near"), eps, factor).alias("value_offset"))


def offset_of(lo: Column, sd: Column, near: Column, eps: float = EPS, factor: float = 0.1) -> Column:
    """The offset from a variable's minimum, deviation and smallest magnitude."""
    floor = F.lit(factor) * F.greatest(sd, F.lit(eps))
    return F.when(lo <= 0, 2.0 * F.abs(lo) + eps).when(near <= floor, F.greatest(floor - lo, F.lit(0.0)) + eps).otherwise(0.0)


def is_failure(runs: DataFrame, limit: float = 1e6) -> DataFrame:
    """Runs whose rmse is missing, not finite or beyond ``limit``."""
    return runs.filter(~finite(F.col("rmse")) | (F.col("rmse") > limit))


def clean_frame(df: DataFrame, order: list[str], grid: str = "grid") -> DataFrame:
    """A wide table as clean samples: columns chosen once for the whole table, t by ``order``, gaps filled.

    Columns that only give the order aren't variables.  Steps are numbered by ranges of the order and long
    tables filled block by block, so no task gets the whole table.
    """
    names = drop_all_null_columns(df, [c for c in select_numeric(df) if c not in order])
    indexed = numbered(df, order).withColumn("grid_id", F.lit(grid))
    samples = to_long(indexed, names)
    return ffill_bfill(samples, block_for(indexed))
