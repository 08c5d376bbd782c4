"""Embeddings as whole-number vectors, and small tallies that tasks add up for a model of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger components are taken as this, so that every squared distance fits a long.
LIMIT = 1 << 24


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor holds a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x, held within LIMIT."""
    held = lambda x: F.least(F.greatest(x.cast("double") * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of int arrays of equal length as rows of a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def added(tallies: DataFrame, size: int, how: Column | None = None) -> list[int]:
    """Position-wise sums (or another aggregate of ``x``) of the arrays ``tally``, ``size`` numbers in all.

    Tasks send one array each; they are added by position in decimals, so sums of any number of rows are exact.
    """
    by_place = tallies.select(F.posexplode("tally").alias("at", "x")).withColumn("x", F.col("x").cast("decimal(38,0)")).groupBy("at")
    found = {r["at"]: int(r["y"]) for r in by_place.agg((F.sum("x") if how is None else how).alias("y")).collect()}
    return [found.get(i, 0) for i in range(size)]


def as_long(n: int) -> int | None:
    """``n``, null if no long can hold it."""
    return n if -(1 << 63) <= n < 1 << 63 else None
