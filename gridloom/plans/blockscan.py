"""Running values over very long series.

A window over (grid_id, var) puts a whole series into one task.  Here it is cut into blocks of time steps:
each block is scanned alone, one summary row for each block is scanned over the blocks, and the carry is
joined back.  Whole-number sums are exact; sums and products of floats equal a plain scan up to the order of
rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("grid_id", "var")
#: Steps of a block; series of at most this length take the plain window.
BLOCK = 100_000


def _plain(kind: str, x: Column, w) -> Column:
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    return {"sum": F.sum(x), "product": F.product(x), "last": F.last(x, ignorenulls=True)}[kind].over(up_to)


def running(df: DataFrame, kind: str, x: Column, name: str, key: tuple[str, ...] = KEY, order: str = "t", block: int | None = None) -> DataFrame:
    """``df`` with the running ``sum``, ``product`` or ``last`` (non-null) of ``x`` in order of ``order``.

    ``block=None`` is the plain window; else ``order`` must be a step number, cut into runs of ``block``.
    """
    if block is None:
        return df.withColumn(name, _plain(kind, x, Window.partitionBy(*key).orderBy(order)))
    df = df.withColumn("__x", x).withColumn("__blk", F.floor(F.col(order) / F.lit(block)))
    inner = Window.partitionBy(*key, "__blk").orderBy(order)
    df = df.withColumn("__in", _plain(kind, F.col("__x"), inner))
    whole = {"sum": F.sum("__x"), "product": F.product("__x"), "last": F.max_by("__in", order)}[kind]
    carry = df.groupBy(*key, "__blk").agg(whole.alias("__whole"))
    before = Window.partitionBy(*key).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = {"sum": F.sum("__whole"), "product": F.product("__whole"), "last": F.last("__whole", ignorenulls=True)}[kind].over(before)
    carry = carry.withColumn("__carry", ahead).drop("__whole")
    joined = df.join(carry, [*key, "__blk"])
    value = {
        "sum": F.coalesce("__carry", F.lit(0)) + F.col("__in"),
        "product": F.coalesce("__carry", F.lit(1.0)) * F.col("__in"),
        "last": F.coalesce("__in", "__carry"),
    }[kind]
    return joined.withColumn(name, value).drop("__x", "__blk", "__in", "__carry")


def lagged(df: DataFrame, x: Column, name: str, key: tuple[str, ...] = KEY, order: str = "t", block: int | None = None) -> DataFrame:
    """``df`` with the value one row earlier; with blocks a block's first row gets its predecessor by a join."""
    if block is None:
        return df.withColumn(name, F.lag(x).over(Window.partitionBy(*key).orderBy(order)))
    df = df.withColumn("__x", x).withColumn("__blk", F.floor(F.col(order) / F.lit(block)))
    ends = df.groupBy(*key, "__blk").agg(F.max_by("__x", order).alias("__last"))
    ends = ends.withColumn("__prev", F.lag("__last").over(Window.partitionBy(*key).orderBy("__blk"))).drop("__last")
    inner = Window.partitionBy(*key, "__blk").orderBy(order)
    first = F.row_number().over(inner) == 1
    out = df.withColumn("__in", F.lag("__x").over(inner)).withColumn("__first", first).join(ends, [*key, "__blk"])
    return out.withColumn(name, F.when(F.col("__first"), F.col("__prev")).otherwise(F.col("__in"))).drop("__x", "__blk", "__in", "__first", "__prev")


def block_for(df: DataFrame, order: str = "t", block: int = BLOCK) -> int | None:
    """``block`` if the longest series is longer, else None for the plain window."""
    longest = df.agg(F.max(order)).first()[0]
    return block if longest is not None and longest >= block else None
