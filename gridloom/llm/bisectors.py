"""Centroid clustering where a vector finds its centroid by a tournament over bisecting planes.

For centroids a and b, a < b, a vector x is nearer to b exactly if x . 2 (b - a) > |b|^2 - |a|^2.  These normals and
thresholds are whole numbers and are computed once for all pairs before a round.  A vector then meets the
centroids 1, 2, ... in turn with the winner so far: k - 1 tests of a sign eliminate all others, and zero, a tie,
leaves the smaller number.  Only the winner's distance is computed.

Tasks send one tally of fixed size for each round: counts, sums of components and of distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.vectors import added, as_long, matrix, pieces, usable, whole_numbers
from gridloom.plans.durable import store

CENTROIDS, ROUNDS, SCALE, WIDTH, SEED = 8, 10, 1024, 64, "3"
#: Bits of a distance's lower part; a task sums both parts apart, so neither outgrows a long.
HALF = 28


class Tournament:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.k = centroids, len(centroids)
        square = (centroids * centroids).sum(1)
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])  # [a, b]
        self.thresholds = square[None, :] - square[:, None]

    def winners(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of each row of ``x``."""
        winner = np.zeros(len(x), np.int64)
        for b in range(1, self.k):
            sign = np.einsum("ij,ij->i", x, self.normals[winner, b]) - self.thresholds[winner, b]
            winner[sign > 0] = b
        gap = x - self.centroids[winner]
        return winner, np.einsum("ij,ij->i", gap, gap)


def _tallier(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One tally for each task: for each centroid a count, the sum of distances in two parts, sums of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        game = Tournament(centroids)
        k, width = centroids.shape
        tally = np.zeros((k, width + 3), np.int64)
        for batch in pieces(batches):
            x = matrix(batch.column("q"), width)
            winner, distance = game.winners(x)
            for j in range(k):
                mine = winner == j
                tally[j, 0] += int(mine.sum())
                tally[j, 1] += int((distance[mine] >> HALF).sum())
                tally[j, 2] += int((distance[mine] & ((1 << HALF) - 1)).sum())
                tally[j, 3:] += x[mine].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([tally.ravel().tolist()], pa.list_(pa.int64()))], ["tally"])

    return run


def _placer(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        game = Tournament(centroids)
        for batch in pieces(batches):
            winner, distance = game.winners(matrix(batch.column("q"), centroids.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(winner.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: str = SEED) -> tuple[DataFrame, np.ndarray, list[int]]:
    """vec_id, cluster and squared distance of each kept row; the centroids; each cluster's sum of distances.

    Kept are vectors of exactly ``width`` components, none null or non-finite; components are held within LIMIT
    after scaling.  The first centroids are the rows with smallest sha256 of ``seed:vec_id`` (a null vec_id
    counts as ``null``), ties by components; equal vec_ids are rows of their own, fewer rows than ``k`` give as
    many centroids.
    """
    q = whole_numbers(F.col("embedding"), scale).alias("q")
    rows = store(vectors.filter(usable(F.col("embedding")) & (F.size("embedding") == width)).select("vec_id", q))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    start = [r["q"] for r in rows.select(named.alias("h"), "q").orderBy("h", "q").limit(k).collect()]
    kind = "vec_id " + vectors.schema["vec_id"].dataType.simpleString() + ", cluster int, distance long"
    if not start:
        return rows.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), np.zeros((0, width), np.int64), []
    centroids = np.array(start, np.int64)
    for _ in range(rounds):
        for j, (n, _, *sums) in enumerate(_summed(rows, centroids)):
            if n:
                centroids[j] = [s // n for s in sums]
    inertia = [x[1] for x in _summed(rows, centroids)]
    return rows.mapInArrow(_placer(centroids), kind), centroids, inertia


def _summed(rows: DataFrame, centroids: np.ndarray) -> list[list[int]]:
    """Count, sum of distances and sums of components of each centroid's vectors."""
    k, width = centroids.shape
    flat = added(rows.select("q").mapInArrow(_tallier(centroids.copy()), "tally array<long>"), k * (width + 3))
    each = [flat[j * (width + 3) : (j + 1) * (width + 3)] for j in range(k)]
    return [[n, (high << HALF) + low, *sums] for n, high, low, *sums in each]


def op13_bisector_clusters(vectors: DataFrame) -> DataFrame:
    """The contract's columns of each kept row of ``vectors``; sums beyond a long are null.

    Null vec_ids and labels stay, repeated rows and ties are as in ``cluster``; an empty table gives no rows.
    """
    placed, centroids, inertia = cluster(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of(values: list, kind: str):
        """The value of a row's cluster; there are as many as centroids."""
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in [*values, None]]), F.coalesce(F.col("cluster"), F.lit(len(values))) + 1)

    return placed.select(
        "vec_id", "cluster", "distance", of([as_long(x) for x in inertia], "long").alias("cluster_inertia"), F.lit(as_long(sum(inertia))).cast("long").alias("inertia"), of(digest, "string").alias("centroid_sha256"),
    )
