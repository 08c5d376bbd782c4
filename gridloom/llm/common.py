"""Shared column expressions and readers of the document operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, which are runs of anything else.
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")).cast("long")


def spaced_words(text: Column) -> Column:
    """Words of a text, each with the white space that follows it; null has none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+", "")
    return F.array_remove(F.split(bare, rf"(?<={SPACE})(?!{SPACE})"), "")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, allowed: Column, limit: int) -> DataFrame:
    """doc_id, text and label of at most about ``limit`` labelled rows.

    ``allowed`` is a condition on doc_id.  A document labelled more than once has its largest label.  The
    rows are chosen by hashes, so reruns agree: first ids, bounded by ``limit`` and broadcast, then, if ids are
    repeated so often that their rows are more than ``limit``, rows that differ in id or text.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).filter(allowed).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    n = known.count()
    if n > limit:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("labelled sample")), F.lit(1_000_000)) < int(1_000_000 * limit / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    found = docs.select("doc_id").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi").count()
    if found <= limit * 1.1:
        return rows
    rows = rows.dropDuplicates(["doc_id", "text"])
    return rows.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit("labelled rows")), F.lit(1_000_000)) < int(1_000_000 * limit / found))
