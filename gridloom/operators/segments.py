"""Segment summaries: PAA, PLA and SAX, and their expansion to all steps."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.frames import SERIES

#: Symbols of SAX.
ALPHABET = 8


def with_segments(samples: DataFrame, segments: int) -> DataFrame:
    """Adds seg, seg_len and tau (the step within its segment); segments are of ceil(T / segments) steps."""
    steps = samples.groupBy("grid_id").agg((F.max("t") + 1).alias("__n"))
    length = F.ceil(F.col("__n") / F.lit(max(1, segments)))
    cut = samples.join(steps, "grid_id").withColumn("seg_len", length)
    return cut.withColumn("seg", F.floor(F.col("t") / F.col("seg_len")).cast("int")).withColumn("tau", F.col("t") - F.col("seg") * F.col("seg_len")).drop("__n")


def paa(samples: DataFrame, segments: int) -> DataFrame:
    return with_segments(samples, segments).groupBy(*SERIES, "seg").agg(F.avg("x").alias("mean"), F.max("seg_len").alias("seg_len"))


def pla(samples: DataFrame, segments: int, fit: str = "reference") -> DataFrame:
    """intercept (first value) and slope; ``reference`` fits the values themselves, ``ols`` a line through
    them with its own intercept."""
    if fit not in ("reference", "ols"):
        raise ValueError(f"fit must be reference or ols, not {fit}")
    groups = with_segments(samples, segments).groupBy(*SERIES, "seg")
    tau, x = F.col("tau"), F.col("x")
    if fit == "ols":
        slope, mean = F.regr_slope(x, tau), F.avg(x) - F.coalesce(F.regr_slope(x, tau), F.lit(0.0)) * F.avg(tau)
        return groups.agg(mean.alias("intercept"), F.coalesce(slope, F.lit(0.0)).alias("slope"), F.max("seg_len").alias("seg_len"))
    squares = F.sum(tau * tau)
    slope = F.when(squares > 0, F.sum(x * tau) / squares).otherwise(0.0)
    return groups.agg(F.min_by("x", "tau").alias("intercept"), slope.alias("slope"), F.max("seg_len").alias("seg_len"))


def breakpoints(alphabet: int) -> list[float]:
    return [NormalDist().inv_cdf(k / alphabet) for k in range(1, alphabet)]


def centers(alphabet: int) -> list[float]:
    b = breakpoints(alphabet)
    if not b:
        return [0.0]
    return [b[0] - 1.0, *[(x + y) / 2 for x, y in zip(b, b[1:], strict=False)], b[-1] + 1.0]


def symbol_of(mean: Column, alphabet: int = ALPHABET) -> Column:
    """How many breakpoints a segment's mean reaches."""
    return sum((F.when(mean >= b, 1).otherwise(0) for b in breakpoints(alphabet)), F.lit(0)).cast("int")


def sax(samples: DataFrame, segments: int, alphabet: int = ALPHABET) -> DataFrame:
    """symbol of each segment, with the variable's mean and deviation for going back."""
    stats = samples.groupBy(*SERIES).agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sigma"))
    z = (F.col("x") - F.col("mu")) / (F.col("sigma") + 1e-9)
    means = paa(samples.join(stats, list(SERIES)).withColumn("x", z), segments)
    return means.join(stats, list(SERIES)).select(*SERIES, "seg", "seg_len", symbol_of(F.col("mean"), alphabet).alias("symbol"), "mu", "sigma")


def symbol_value(symbol: Column, alphabet: int) -> Column:
    return F.get(F.array(*map(F.lit, centers(alphabet))), symbol)


def expand_segments(samples: DataFrame, coefficients: DataFrame, value: Column, segments: int) -> DataFrame:
    """x and x_hat at all steps: coefficients joined by (grid, variable, segment); ``value`` may use tau."""
    steps = with_segments(samples, segments).drop("seg_len")
    return steps.join(coefficients.drop("seg_len"), [*SERIES, "seg"]).select(*SERIES, "t", "x", value.alias("x_hat"))


def paa_expand(samples: DataFrame, segments: int) -> DataFrame:
    return expand_segments(samples, paa(samples, segments), F.col("mean"), segments)


def pla_expand(samples: DataFrame, segments: int, fit: str = "reference") -> DataFrame:
    return expand_segments(samples, pla(samples, segments, fit), F.col("intercept") + F.col("slope") * F.col("tau"), segments)


def sax_expand(samples: DataFrame, segments: int, alphabet: int = ALPHABET, denormalize: bool = False) -> DataFrame:
    value = symbol_value(F.col("symbol"), alphabet)
    if denormalize:
        value = value * (F.col("sigma") + 1e-9) + F.col("mu")
    return expand_segments(samples, sax(samples, segments, alphabet), value, segments)
