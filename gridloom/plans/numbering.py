"""Gapless numbers and running sums over a whole table, without a window over one key.

Rows are dealt to ranges of the wanted order and stored with the number of their range.  Each range is summed up
alone; of the ranges themselves there are as many as shuffle partitions, whatever the table's size, and only
their totals meet in one place.  Rows with equal order get a further column that tells them apart, so no value
however frequent makes one range large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.durable import store


def running_total(df: DataFrame, order: list[str], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each row, in order of ``order``, ties in any order.

    ``df`` is computed once and stored.  Nulls come first, as in Spark's ascending order.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, "__tie"]
    marked = df.withColumn("__value", value.cast("long")).withColumn("__tie", F.monotonically_increasing_id())
    dealt = store(marked.repartitionByRange(partitions, *by).withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range").agg(F.sum("__value").alias("__total"))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__total").over(ahead(Window.orderBy("__range"))), F.lit(0))
    starts = totals.select("__range", before.alias("__before"))
    inside = F.coalesce(F.sum("__value").over(ahead(Window.partitionBy("__range").orderBy(*by))), F.lit(0))
    placed = dealt.withColumn("__inside", inside).join(F.broadcast(starts), "__range")  # a row for each range
    return placed.withColumn(name, F.col("__before") + F.col("__inside")).drop("__range", "__value", "__tie", "__inside", "__before")


def numbered(df: DataFrame, order: list[str], name: str = "t", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name`` from 0 in order of ``order``; rows equal in all of it are numbered in any order."""
    return running_total(df, order, F.lit(1), name, partitions)


def in_file_order(scan: DataFrame, name: str = "__line") -> DataFrame:
    """A scan of files with each row's number in order of path, place of the block in its file, and place in the block.

    A block is read by one task from its first row to its last, so the ids that the task gives out count its rows;
    only the blocks' counts are summed over the table.  The files are parsed once and stored.
    """
    read = store(scan.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__place")))
    blocks = read.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    starts = running_total(blocks, ["__file", "__block"], F.col("__n"), "__start").drop("__n")
    line = F.col("__start") + F.col("__place") - F.col("__first")
    return read.join(starts, ["__file", "__block"]).withColumn(name, line.cast("long")).drop("__file", "__block", "__place", "__first", "__start")
