"""Seeded series for tests and scale runs: every value is a function of (seed, variable, step)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.detect import normal, uniform
from gridloom.plans.blockscan import running


def _cells(spark: SparkSession, n_vars: int, n_steps: int, grid: str, start: int = 0) -> DataFrame:
    return spark.range(n_vars * n_steps).select(
        F.lit(grid).alias("grid_id"), F.format_string("v%04d", F.expr(f"cast(id div {n_steps} as int)")).alias("var"), (F.col("id") % n_steps + start).alias("t"), F.expr(f"id div {n_steps}").alias("v")
    )


def synthetic_sensors(spark: SparkSession, n_vars: int, n_steps: int, seed: int = 0, start: int = 0) -> DataFrame:
    """Level, season, harmonic, drift, noise and rare pulses; deterministic in seed and step."""
    s, t = F.lit(seed), F.col("t").cast("double")
    u = lambda name, lo, hi: lo + (hi - lo) * uniform("v", s, F.lit(name))
    season = u("amp", 2.0, 10.0) * F.sin(2 * math.pi * t / u("period", 200.0, 2000.0) + u("phase", 0.0, 6.28))
    harmonic = u("amp2", 0.5, 2.0) * F.sin(2 * math.pi * t / u("period2", 20.0, 90.0))
    pulse = F.when(uniform("v", "t", s, F.lit("pulse")) < 0.0005, u("pulse", 10.0, 40.0)).otherwise(0.0)
    x = u("level", 20.0, 120.0) + season + harmonic + u("drift", -1e-3, 1e-3) * t + 0.2 * normal("v", "t", s) + pulse
    return _cells(spark, n_vars, n_steps, "sensors", start).select("grid_id", "var", "t", x.alias("x"))


def random_walks(spark: SparkSession, n_vars: int, n_steps: int, seed: int = 0, step: float = 0.05, block: int | None = None) -> DataFrame:
    s = F.lit(seed)
    cells = _cells(spark, n_vars, n_steps, "walks").withColumn("e", step * normal("v", "t", s)).withColumn("b", 100.0 + 10.0 * normal("v", s))
    return running(cells, "sum", F.col("e"), "__s", block=block).select("grid_id", "var", "t", (F.col("b") + F.col("__s")).alias("x"))


def grouped_factors(spark: SparkSession, n_vars: int, n_steps: int, factors: int = 16, seed: int = 0) -> DataFrame:
    """Correlated channels: each follows one of the factors (random walks) with its own loading and noise."""
    s = F.lit(seed)
    walks = random_walks(spark, factors, n_steps, seed + 1, 1.0).select(F.substring("var", 2, 4).cast("long").alias("f"), "t", F.col("x").alias("w"))
    cells = _cells(spark, n_vars, n_steps, "factors").withColumn("f", F.col("v") % factors)
    return cells.join(walks, ["f", "t"]).select("grid_id", "var", "t", ((0.5 + uniform("v", s)) * F.col("w") + 0.1 * normal("v", "t", s)).alias("x"))


WORKLOADS = ("sensor", "financial", "iot", "electricity", "multi_scale")


def workload(spark: SparkSession, kind: str, n_vars: int = 50, n_steps: int = 1000, seed: int = 0) -> DataFrame:
    if kind not in WORKLOADS:
        raise ValueError(f"kind must be one of {WORKLOADS}, not {kind}")
    s, t = F.lit(seed), F.col("t").cast("double")
    noise, v = normal("v", "t", s), F.col("v").cast("double")
    cells = _cells(spark, n_vars, n_steps, kind)
    if kind == "financial":
        walk = running(cells.withColumn("e", 0.01 * noise), "sum", F.col("e"), "__s")
        return walk.select("grid_id", "var", "t", (100.0 * F.exp("__s")).alias("x"))
    x: dict[str, Column] = {
        "sensor": 50.0 + 10.0 * F.sin(2 * math.pi * t / 144.0 + v) + noise,
        "iot": F.when(uniform("v", "t", s, F.lit("burst")) < 0.02, 100.0 + 10.0 * noise).otherwise(5.0 + 0.1 * noise),
        "electricity": 1000.0 + 500.0 * F.greatest(F.sin(2 * math.pi * t / 96.0), F.lit(0.0)) + 20.0 * noise,
        "multi_scale": F.pow(F.lit(10.0), v % 5) * (1.0 + 0.01 * noise),
    }
    return cells.select("grid_id", "var", "t", x[kind].alias("x"))


def zero_crossing_signals(spark: SparkSession, n_steps: int = 1000, seed: int = 0) -> DataFrame:
    """Four grids of one variable that cross zero: sine, AC, centred walk, line."""
    t = F.col("t").cast("double")
    kinds = {"sine": 10.0 * F.sin(2 * math.pi * t / 100.0), "ac": 220.0 * math.sqrt(2) * F.sin(2 * math.pi * 50.0 * t / 5000.0), "line": 50.0 - 100.0 * t / max(n_steps - 1, 1)}
    cells = _cells(spark, 1, n_steps, "x")
    out = random_walks(spark, 1, n_steps, seed, 1.0).select(F.lit("walk").alias("grid_id"), "var", "t", (F.col("x") - 100.0).alias("x"))
    for name, x in kinds.items():
        out = out.unionByName(cells.select(F.lit(name).alias("grid_id"), "var", "t", x.alias("x")))
    return out
