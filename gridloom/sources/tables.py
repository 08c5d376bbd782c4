"""Grids built from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.frames import time_index, to_long
from gridloom.plans.blockscan import BLOCK

SUPPLIER_VARS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
#: Line items that one task orders: parts grow in number with the table, not in size.
LINES_OF_A_TASK = 250_000


def supplier_lines(spark: SparkSession, sf_dir: str, variables: list[str] | None = None) -> DataFrame:
    """grid_id, t and the variables side by side: each supplier's line items in shipping order, the last columns breaking ties."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("grid_id", F.col("l_suppkey").cast("string"))
    lines = lines.select("grid_id", *dict.fromkeys([*ORDER, *(variables or SUPPLIER_VARS)]))
    parts = -(-lines.count() // LINES_OF_A_TASK)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines = lines.repartition(parts, "grid_id")
    return time_index(lines, ["grid_id"], ORDER)


def supplier_grid(spark: SparkSession, sf_dir: str, variables: list[str] | None = None) -> DataFrame:
    """A grid for each supplier, as ``supplier_lines`` orders it; rows stay dealt by grid_id."""
    return to_long(supplier_lines(spark, sf_dir, variables), variables or SUPPLIER_VARS)


def supplier_block(spark: SparkSession, sf_dir: str) -> int | None:
    """``block_for`` of the suppliers' grids from the counts of their line items, without ordering them."""
    longest = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().agg(F.max("count")).first()[0]
    return BLOCK if longest is not None and longest > BLOCK else None


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid: mean value by hour and event type, null where a type had no event in an hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    cells = events.groupBy(hour.alias("h"), F.col("event_type").alias("var")).agg(F.avg("value").alias("x"))
    span = cells.agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    hours = span.select(F.explode(F.sequence("lo", "hi")).alias("h"), "lo")
    every = hours.join(cells.select("var").distinct(), how="cross")
    return every.join(cells, ["h", "var"], "left").select(F.lit("events").alias("grid_id"), "var", (F.col("h") - F.col("lo")).alias("t"), "x")


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One variable: the day's order value."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    days = orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("x"))
    return time_index(days.withColumn("grid_id", F.lit("orders")).withColumn("var", F.lit("total")), ["grid_id"], ["day"]).select("grid_id", "var", "t", "x")
