"""Cutting lineage so that a lost executor costs one stage, not the job.

Results are kept with ``DataFrame.checkpoint()`` in the shared folder that the cluster names in
``spark.checkpoint.dir``.  A folder of our own is set only where that setting is absent and Spark runs in one
process, as in tests; on a cluster a machine-local folder would lose data with its machine.
"""

from __future__ import annotations

import tempfile
import threading
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


#: ``paths`` of the tables that this thread has stored, oldest first.
_own = threading.local()


def _tables() -> list[str]:
    if not hasattr(_own, "paths"):
        _own.paths = []
    return _own.paths


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; sets a temporary one only if a local session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the checkpoint folder (reliable, not local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the checkpoint folder and read from it.

    For results that are joined over many steps: a checkpoint keeps the optimiser's estimate of its size, and
    estimates of joins are products, which grow without bound from step to step; a table has its true size.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid4().hex}"
    _tables().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_stored() -> int:
    """How many tables ``store`` has written in this thread and not removed."""
    return len(_tables())


def remove_tables(spark: SparkSession, since: int) -> None:
    """Deletes the tables that ``store`` wrote after it had written ``since``.

    For callers that have written a result that was worked out from them, and read that from then on.
    """
    while len(_tables()) > since:
        remove_folder(spark, _tables().pop())


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own, in whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
