"""Vector codes by ball k-means: one byte for each of a vector's parts, the number of the nearest codebook entry.

The entries of a part position start as parts of the first vectors.  Each round assigns all parts and moves each
entry to the floor of the mean of its parts.  The first assignment compares all entries.  Later ones start from
the entry a part had: the parts of an entry form a ball around the entry's new place, whose radius is at most its
old radius plus the entry's move.  Only entries nearer than twice the radius are the ball's neighbours.  A part
whose distance d to its own entry is less than half the way to the nearest neighbour lies in the stable core and
keeps its entry with no further work.  Other parts lie in annular rings: only neighbours at most 2 d from the own
entry are compared, which are the first ones in order of distance.  All of it is whole-number arithmetic, so the
result, ties included, is that of comparing everything.

What a task sends for a round is one tally of fixed size (count, radius and sums of each entry); the vectors
with their codes go to a table in the checkpoint folder, which the next round reads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.vectors import LIMIT, added, matrix, pieces, usable, whole_numbers
from gridloom.plans.durable import store

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry (the smaller one of equals) and squared distance of each row, against all."""
    wide = 4 * x.shape[1] * LIMIT * LIMIT >= 1 << 53 and max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) ** 2 * 4 * x.shape[1] >= 1 << 53
    kind = np.int64 if wide else np.float64  # floats are exact below 2 ** 53, and their products are faster
    a, e = x.astype(kind), entries.astype(kind)
    d = (a * a).sum(1)[:, None] - 2 * (a @ e.T) + (e * e).sum(1)[None, :]
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best].astype(np.int64)


class Balls:
    """The entries of one part position with their neighbours in order of distance."""

    def __init__(self, entries: np.ndarray, radius: np.ndarray):
        """``radius``: an upper bound of the distance from each entry to the parts that it had last."""
        self.entries = entries
        gap = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        self.near, self.gaps = [], []
        for j in range(len(entries)):
            order = np.argsort(gap[j], kind="stable")
            order = order[order != j]
            order = order[gap[j][order] <= 4 * int(radius[j]) ** 2]  # two balls that don't meet aren't neighbours
            self.near.append(order)
            self.gaps.append(gap[j][order])

    def reassign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """New entry and squared distance of each part, and how many parts compared a neighbour at all."""
        least = ((x - self.entries[own]) ** 2).sum(1)
        best = own.copy()
        order = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[order], np.arange(len(self.entries) + 1))
        rows, others = [], []
        for j in np.flatnonzero(np.diff(edges)):
            mine = order[edges[j] : edges[j + 1]]
            ring = np.searchsorted(self.gaps[j], 4 * least[mine], "right")  # 0 in the stable core
            outside = np.flatnonzero(ring)
            if len(outside):
                ring = ring[outside]
                rows.append(np.repeat(mine[outside], ring))
                starts = np.repeat(np.cumsum(ring) - ring, ring)
                others.append(self.near[j][np.arange(len(starts)) - starts])
        if not rows:
            return best, least, 0
        row, other = np.concatenate(rows), np.concatenate(others)
        d = ((x[row] - self.entries[other]) ** 2).sum(1)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        who = row[first]
        low = np.minimum.reduceat(d, first)
        sizes = np.diff(np.append(first, len(row)))
        number = np.minimum.reduceat(np.where(d == np.repeat(low, sizes), other, len(self.entries)), first)
        better = (low < least[who]) | ((low == least[who]) & (number < own[who]))
        best[who[better]], least[who[better]] = number[better], low[better]
        return best, least, len(who)


def _assigner(entries: np.ndarray, radius: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds codes and error to vectors; one more row for each task holds its tally.

    ``entries`` has (part, entry, position within part).  A tally has, for each part and entry, a count, the
    greatest squared distance and the sums of the components.
    """
    parts, k, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = None if radius is None else [Balls(e, r) for e, r in zip(entries, radius, strict=True)]
        tally = np.zeros((parts, k, width + 2), np.int64)
        like = None
        for batch in pieces(batches):
            like = batch.schema
            x = matrix(batch.column("q"), parts * width)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            before = None if balls is None else np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
            for m in range(parts):
                mine = x[:, m * width : (m + 1) * width]
                if balls is None:
                    best, least = nearest(mine, entries[m])
                else:
                    best, least, _ = balls[m].reassign(mine, before[:, m].astype(np.int64))
                codes[:, m] = best
                error += least
                tally[m, :, 0] += np.bincount(best, minlength=k)
                np.maximum.at(tally[m, :, 1], best, least)
                np.add.at(tally[m, :, 2:], best, mine)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("q"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.nulls(len(x), pa.list_(pa.int64()))],
                ["vec_id", "label", "q", "codes", "error", "tally"],
            )
        if like is not None:
            none = [pa.nulls(1, like.field(c).type) for c in ("vec_id", "label", "q")]
            yield pa.RecordBatch.from_arrays([*none, pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([tally.ravel().tolist()], pa.list_(pa.int64()))], ["vec_id", "label", "q", "codes", "error", "tally"])

    return run


def _moved(tallies: DataFrame, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries after a round and bounds of their balls' radii around the new places."""
    parts, k, width = entries.shape
    size = parts * k * (width + 2)
    place = F.col("at") % (width + 2)
    summed = np.array(added(tallies, size, F.when(F.first(place) == 1, F.max("x")).otherwise(F.sum("x"))), object).reshape(parts, k, width + 2)
    new, radius = entries.copy(), np.zeros((parts, k), np.int64)
    for m in range(parts):
        for j in range(k):
            n, far, *sums = (int(v) for v in summed[m, j])
            if n:
                new[m, j] = [s // n for s in sums]
            step = sum((int(a) - int(b)) ** 2 for a, b in zip(new[m, j], entries[m, j], strict=True))
            radius[m, j] = isqrt(far) + isqrt(step) + 2  # both roots rounded up
    return new, radius


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, codes (one byte a part) and error of each usable row, and the codebooks (part, entry, position).

    Rows whose vector is null or holds null or non-finite components are dropped.  The length of vectors is that
    of the first usable row in order of vec_id (null last), then components; rows of another length stay, with
    null codes and error, as do all if that length isn't a multiple of ``parts``.  Components are held within
    LIMIT after scaling.  Equal vec_ids count as rows of their own, fewer rows than ``entries`` give as many
    entries.  No rows give an empty codebook.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    rows = vectors.filter(usable(F.col("embedding"))).select("vec_id", "label", whole_numbers(F.col("embedding"), scale).alias("q"))
    order = [F.col("vec_id").asc_nulls_last(), "q"]
    first = rows.select("vec_id", "q").orderBy(*order).limit(1).collect()
    size = len(first[0]["q"]) if first else 0
    fits = F.size("q") == (size if size and size % parts == 0 else -1)
    start = [r["q"] for r in rows.filter(fits).select("vec_id", "q").orderBy(*order).limit(entries).collect()]
    odd = rows.filter(~fits).select("vec_id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error"))
    if not start:
        return odd, np.zeros((parts, 0, 0), np.int64)
    books = np.array(start, np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    schema = "vec_id " + vectors.schema["vec_id"].dataType.simpleString() + ", label " + vectors.schema["label"].dataType.simpleString() + ", q array<int>, codes binary, error long, tally array<long>"
    table, radius = rows.filter(fits), None
    for k in range(rounds + 1):
        table = store(table.mapInArrow(_assigner(books, radius), schema))
        if k < rounds:
            books, radius = _moved(table.filter(F.col("tally").isNotNull()).select("tally"), books)
        table = table.filter(F.col("tally").isNull()).select("vec_id", "label", "q", "codes", "error")
    return table.select("vec_id", "label", "codes", "error").unionByName(odd), books


def op11_ball_codes(vectors: DataFrame) -> DataFrame:
    """The contract's columns of each usable row of ``vectors``, others as in ``vector_codes``.

    Labels' errors are summed before they meet the rows; a sum beyond a long is null.
    """
    coded, books = vector_codes(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = coded.groupBy("label").agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error")).withColumnRenamed("label", "of")
    rows = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return rows.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
