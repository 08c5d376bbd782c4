"""Grids on streams: event-time windows, and residuals with carried encoder state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from gridloom.functions.scalar import INLINE
from gridloom.operators.frames import SERIES
from gridloom.plans.blockscan import BLOCK, lagged
from gridloom.plans.durable import remove_folder

#: What a batch of ``stream_encode`` hands to the next.
CARRY = "grid_id string, var string, last long, rows long, escapes long"


def stream_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling event-time windows of (var, ts, x): count, mean, extremes and the sum of squares of x.

    Rows later than the watermark are dropped by Spark and counted in the query's progress.
    """
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "var")
    return grouped.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(F.col("x") * F.col("x")).alias("squares")).select("w.start", "var", "n", "mean", "lo", "hi", "squares")


def stream_encode(samples: DataFrame, q: float, folder: str, block: int = BLOCK, **options) -> StreamingQuery:
    """m, residual and running totals of a stream of samples that arrive in step order; step ``q`` is fixed.

    A micro-batch is cut into blocks of ``block`` steps, whose first rows get their predecessors by a join, so no
    series need fit a task.  Each batch's rows go to ``folder``/out; the last coordinate and the totals of each
    (grid_id, var) go to a table that the next batch reads.  A batch that is run again after a failure reads
    the same table and replaces what it wrote.  A first sample has residual 0, null and non-finite ones are skipped;
    ``rows`` and ``escapes`` are totals up to the end of the batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        x = F.col("x").cast("double")
        m = F.rint(x / q).cast("long").alias("m")
        cells = batch.filter(x.isNotNull() & (F.abs(x) < float("inf"))).select(*SERIES, F.col("t").cast("long").alias("t"), m)
        known = spark.read.schema(CARRY).parquet(f"{folder}/carry/{number - 1}") if number else spark.createDataFrame([], CARRY)
        steps = lagged(cells, F.col("m"), "before", block=block).join(known.select(*SERIES, "last"), list(SERIES), "left")
        steps = steps.withColumn("r", F.col("m") - F.coalesce("before", "last", "m")).select(*SERIES, "t", "m", "r")
        found = steps.groupBy(*SERIES).agg(F.max_by("m", "t").alias("now"), F.count(F.lit(1)).alias("more"), F.count_if(F.abs("r") > INLINE).alias("beyond"))
        totals = known.join(found, list(SERIES), "full").select(
            *SERIES, F.coalesce("now", "last").alias("last"),
            *[(F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))).alias(old) for old, new in (("rows", "more"), ("escapes", "beyond"))],
        )
        totals.write.mode("overwrite").parquet(f"{folder}/carry/{number}")
        totals = spark.read.schema(CARRY).parquet(f"{folder}/carry/{number}")
        steps.join(totals.drop("last"), list(SERIES)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        if number > 1:
            remove_folder(spark, f"{folder}/carry/{number - 2}")

    return samples.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).options(**options).start()


def encode_each_batch(samples: DataFrame, sink: Callable[[DataFrame, int], None], window_rows: int, checkpoint: str, eps: float = 1e-3, **options) -> StreamingQuery:
    """Encodes every micro-batch's windows of ``window_rows`` rows with the batch encoder and hands them to
    ``sink`` (grid and parameters, with the batch number); memory is that of a window."""
    from gridloom.operators import lattice
    from gridloom.operators.frames import row_windows

    def run(batch: DataFrame, number: int) -> None:
        grid, var_params = lattice.encode(row_windows(batch, window_rows), eps, predictors="p1")
        sink(grid.join(var_params, ["grid_id", "var"]), number)

    return samples.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).options(**options).start()
