"""A corpus from raw documents: without toxic, repeated and contaminated ones, mixed and sharded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
again as the next stage's ``docs``, so a failure costs one stage.  A stage's folder goes when the next one is
written.

All stages keep every column of documents, whatever further columns are called.  An empty table passes
through all of them.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common, decontaminate, hilbert, mixing, near_dedup, toxicity
from gridloom.plans.durable import checkpoint_dir, remove_folder, remove_tables, tables_stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, doesn't reject.

    Without labels all score 0.5 and go; null and empty texts score as empty ones, repeated rows alike.
    """
    allowed = common.id_fold(F.col("doc_id"), toxicity.FOLDS) != toxicity.HELD_OUT
    return toxicity.reject_toxic(docs, toxicity.train(docs, common.labels(spark, sf_dir), allowed))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: smallest doc_id, null last; ties go by a hash of the text.

    Null and empty texts are in no class and stay; of exactly repeated rows one stays.
    """
    return near_dedup.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is covered by benchmark windows.

    Null and empty texts stay; repeated rows are judged alike.  An empty benchmark leaves all.
    """
    return decontaminate.remove_contaminated(docs, common.benchmark(spark, sf_dir))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, a second row for those taken twice.

    Null and empty texts have no words to take and go; a null source is a source of its own.
    """
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place on the curve, shard and slot; ties on the curve go by doc_id and text."""
    return hilbert.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Trained models, connected components and pseudorandom permutations are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the mixed corpus with each row's shard and slot.

    What a stage stored for itself is deleted once its result is written; the last stage's input stays, as its
    result is worked out when it is read.
    """
    docs = common.documents(spark, sf_dir)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stored = tables_stored()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            remove_tables(spark, stored)
            if k:
                remove_folder(spark, f"{folder}/{k - 1}")
    return docs
