"""The samples table and its shapes: time index, long and wide forms, slices, windows of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.numbering import numbered

SAMPLES = "grid_id string, var string, t bigint, x double"
SERIES = ("grid_id", "var")


def series():
    """The window of one variable in time order."""
    return Window.partitionBy(*SERIES).orderBy("t")


def time_index(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``t`` from 0 in the order of ``order`` within ``keys``; ties need further columns in ``order``."""
    return df.withColumn("t", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def time_index_global(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``t`` from 0 for one series too long for a task: ranges of ``order``, counted, then offset."""
    return numbered(df, order, "t", partitions)


def dealt(samples: DataFrame, rows_of_a_task: int = 1_000_000) -> DataFrame:
    """Stored samples dealt by grid to parts that grow in number with the table, not in size."""
    parts = -(-samples.count() // rows_of_a_task)
    return samples.repartition(parts, "grid_id") if parts > int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")) else samples


def to_long(df: DataFrame, variables: list[str], ids: list[str] | None = None) -> DataFrame:
    """One row for each id and variable; the values become double, text that is no number null.

    Rows stay dealt as those of ``df`` (an unpivot forgets that), so windows by grid or series need no further shuffle.
    """
    ids = ids or ["grid_id", "t"]
    cells = [F.struct(F.lit(v).alias("var"), F.expr(f"try_cast(`{v}` as double)").alias("x")) for v in variables]
    return df.select(*ids, F.explode(F.array(*cells)).alias("__c")).select("grid_id", "__c.var", "t", "__c.x")


def to_wide(samples: DataFrame, variables: list[str]) -> DataFrame:
    return samples.groupBy("grid_id", "t").pivot("var", variables).agg(F.first("x"))


def head_steps(samples: DataFrame, steps: int) -> DataFrame:
    return samples.filter(F.col("t") < steps)


def tail_steps(samples: DataFrame, steps: int) -> DataFrame:
    last = samples.groupBy("grid_id").agg(F.max("t").alias("__last"))
    return samples.join(last, "grid_id").filter(F.col("t") > F.col("__last") - steps).drop("__last")


def first_variables(samples: DataFrame, k: int) -> DataFrame:
    """The first ``k`` variables by name of each grid."""
    names = samples.select("grid_id", "var").distinct().withColumn("__pos", F.row_number().over(Window.partitionBy("grid_id").orderBy("var")))
    return samples.join(names.filter(F.col("__pos") <= k).drop("__pos"), ["grid_id", "var"], "left_semi")


def row_windows(samples: DataFrame, rows: int) -> DataFrame:
    """Tumbling windows by row count: grid_id becomes ``grid/blk`` and t starts anew; the last may be short."""
    if rows <= 0:
        raise ValueError("window_rows must be positive")
    blk = F.floor(F.col("t") / F.lit(rows))
    return samples.withColumn("grid_id", F.concat_ws("/", "grid_id", blk.cast("string"))).withColumn("t", F.col("t") - blk * rows)


def sliding_windows(samples: DataFrame, size: int = 100, stride: int = 50) -> DataFrame:
    """win_id, grid_id, var, pos and x of all complete windows; each sample is in size / stride of them."""
    last = samples.groupBy("grid_id").agg((F.max("t") + 1).alias("__n"))
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("t") - (size - 1)) / F.lit(stride)))
    hi = F.floor(F.col("t") / F.lit(stride))
    starts = samples.join(last, "grid_id").withColumn("__w", F.explode(F.when(hi >= lo, F.sequence(lo, hi)))).filter(F.col("__w") * stride + size <= F.col("__n"))
    return starts.select(F.concat_ws("/", "grid_id", F.col("__w").cast("string")).alias("win_id"), "grid_id", "var", (F.col("t") - F.col("__w") * stride).alias("pos"), "x")


def intensity_image(samples: DataFrame) -> DataFrame:
    """Adds ``level``: each value's place between its grid's smallest and largest."""
    from gridloom.functions.scalar import intensity

    ranges = samples.groupBy("grid_id").agg(F.min("x").alias("__lo"), F.max("x").alias("__hi"))
    return samples.join(ranges, "grid_id").withColumn("level", intensity(F.col("x"), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
