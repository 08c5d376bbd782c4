"""Substring deduplication with a count-min prefilter.

Words covered by a run of 13 words that also starts in a document with a smaller doc_id are removed.

1. Documents are dealt by a hash of doc_id into chunks of a few megabytes of text.  Each chunk makes its
   count-min sketch: for each of ``DEPTH`` rows the cells that its windows fall into, once or more often.
   It is sparse, stored as coded gaps between sorted cells (11 bits for each window and row).
2. Sketches are merged by ranges of cells: counts are added up, and each chunk gets back those of its cells
   whose count is two or more.  Counts are never too small, so no repeated window is lost.
3. Each chunk's windows whose cells are repeated in every row are the candidates.  They alone are grouped
   exactly, by 96-bit hash: a chunk sends each distinct candidate once with its smallest doc_id, and whether
   it has a larger one, and gets back the smallest doc_id over all chunks where some of its own are larger.
4. Each chunk removes the covered words of its documents.

Scale: the sketch is never in one place and nothing is broadcast; cells, chunks and ranges grow with the
input, so what a task holds doesn't.  A passage that all documents share is one row for each chunk.  The
text is shuffled once and read three times from that shuffle; a lost executor costs a stage.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import Texts, U, covered, mixed, packed, texts, windows

WINDOW = 13
DEPTH = 2
#: Cells of a sketch row for each byte of text: with words of about six bytes four cells for each window.
CELLS_PER_BYTE = 0.7
#: Bytes of text in a chunk; both chunks and ranges grow with the root of the input, so that the pieces
#: which chunks send to ranges keep a useful size.
CHUNK_BYTES = (4 << 20, 32 << 20)


class Plan:
    """Sizes that follow from the number of text bytes."""

    def __init__(self, n_bytes: int, window: int):
        self.window = window
        chunk_bytes = min(max(20 * math.isqrt(n_bytes), CHUNK_BYTES[0]), CHUNK_BYTES[1])
        self.chunks = max(64, -(-n_bytes // chunk_bytes))
        self.ranges = max(16, -(-n_bytes // (8 * chunk_bytes)))
        cells = max(1 << 16, int(n_bytes * CELLS_PER_BYTE))
        self.range_cells = -(-cells // self.ranges)
        self.cells = self.range_cells * self.ranges

    def cell(self, h: np.ndarray, row: int) -> np.ndarray:
        """The cell of each window hash in a row of the sketch."""
        x = mixed(h + U((row + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
        return ((x >> U(32)) * U(self.cells) >> U(32)).astype(np.int64) if self.cells < 1 << 32 else (x % U(self.cells)).astype(np.int64)


def _coded(values: np.ndarray) -> bytes:
    """Sorted numbers as Rice-coded gaps: low bits as they are, the rest in unary."""
    gaps = np.diff(values, prepend=0)
    low = max(int(gaps.mean()).bit_length() - 1, 0) if len(gaps) else 0
    high = gaps >> low
    unary = np.zeros(int(high.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    bits = ((gaps[:, None] >> np.arange(low)) & 1).astype(np.uint8)
    return np.array([len(gaps), low, len(unary)], np.int64).tobytes() + np.packbits(unary).tobytes() + np.packbits(bits).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    n, low, length = np.frombuffer(data, np.int64, 3).tolist()
    cut = 24 + -(-length // 8)
    high = np.diff(np.flatnonzero(np.unpackbits(np.frombuffer(data[24:cut], np.uint8), count=length)), prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(data[cut:], np.uint8), count=n * low).reshape(n, low)
    gaps = high << low
    for k in range(low):
        gaps += bits[:, k].astype(np.int64) << k
    return np.cumsum(gaps)


def _narrow(ids: np.ndarray) -> bytes:
    """Ids above their smallest, in as few bytes as hold the largest."""
    base = int(ids.min()) if len(ids) else 0
    above = ids.astype(U) - np.int64(base).astype(U)
    kind = next(k for k in ("u1", "u2", "u4", "u8") if not len(ids) or above.max() <= U(np.iinfo(k).max))
    return kind.encode() + np.int64(base).tobytes() + above.astype(kind).tobytes()


def _ids(data: bytes) -> np.ndarray:
    base = np.frombuffer(data, U, 1, 2)[0]
    return (np.frombuffer(data, data[:2].decode(), -1, 10).astype(U) + base).astype(np.int64)


def _hashed(t: Texts, window: int):
    """Word ranges and owners; two hashes, first word and owner of each window."""
    starts, ends, owner = t.words()
    one, first = windows(t.hashes(starts, ends, 1), owner, window)
    two, _ = windows(t.hashes(starts, ends, 2), owner, window)
    return starts, ends, owner, one, (two >> U(32)).astype(np.uint32), first


def _chunk_windows(table: pa.Table, window: int):
    """All windows of a chunk: both hashes, the doc_id and whether it is null."""
    ones, twos, ids = [], [], []
    doc_ids = table.column("doc_id").combine_chunks()
    known = np.asarray(doc_ids.is_valid())
    numbers = np.asarray(doc_ids.fill_null(0).cast(pa.int64()))
    for row, t in texts(table.column("text")):
        _, _, owner, one, two, first = _hashed(t, window)
        keep = known[row + owner[first]] if len(first) else np.zeros(0, bool)
        ones.append(one[keep])
        twos.append(two[keep])
        ids.append(numbers[row + owner[first]][keep])
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return cat(ones, U), cat(twos, np.uint32), cat(ids, np.int64)


def _sketch(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        one, _, _ = _chunk_windows(table, plan.window)
        rows = []
        for d in range(DEPTH):
            cells = np.sort(plan.cell(one, d))
            new = np.ones(len(cells), bool)
            new[1:] = cells[1:] != cells[:-1]
            at = np.flatnonzero(new)
            often = np.diff(np.append(at, len(cells))) > 1
            cells = cells[at]
            cut = np.searchsorted(cells, np.arange(plan.ranges + 1) * plan.range_cells)
            for r in np.flatnonzero(np.diff(cut)):
                part = slice(cut[r], cut[r + 1])
                rows.append((int(d * plan.ranges + r), _coded(cells[part] - r * plan.range_cells), np.packbits(often[part]).tobytes()))
        n = len(rows)
        chunk = table.column("chunk")[0].as_py()
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([chunk] * n, pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["range", "chunk", "cells", "often"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Adds up the sketches of a range; each chunk's cells with a count of two or more go back to it."""
    lists = [_numbers(x) for x in table.column("cells").to_pylist()]
    often = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(c)) for x, c in zip(table.column("often").to_pylist(), lists, strict=True)]
    counts = np.zeros(max((int(c[-1]) for c in lists if len(c)), default=-1) + 1, np.uint8)
    for c, m in zip(lists, often, strict=True):  # two stands for two or more
        counts[c] = np.minimum(counts[c] + 1 + m, 2)
    back = [c[counts[c] > 1] for c in lists]
    full = [i for i, c in enumerate(back) if len(c)]
    return pa.table([table.column("range").take(full), table.column("chunk").take(full), pa.array([_coded(back[i]) for i in full], pa.binary())], ["range", "chunk", "cells"])


def _candidates(plan: Plan):
    def run(docs: pa.Table, cells: pa.Table) -> pa.Table:
        one, two, ids = _chunk_windows(docs, plan.window)
        keep = np.ones(len(one), bool)
        repeated: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        for r, data in zip(cells.column("range").to_pylist(), cells.column("cells").to_pylist(), strict=True):
            repeated[r // plan.ranges].append(_numbers(data) + (r % plan.ranges) * plan.range_cells)
        for d in range(DEPTH):
            known = np.sort(np.concatenate(repeated[d])) if repeated[d] else np.zeros(0, np.int64)
            at = np.flatnonzero(keep)
            mine = plan.cell(one[at], d)
            i = np.searchsorted(known, mine)
            i[i == len(known)] = 0
            keep[at] = (known[i] == mine) if len(known) else False
        order = np.lexsort((ids[keep], two[keep], one[keep]))
        one, two, ids = (x[keep][order] for x in (one, two, ids))
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        at = np.flatnonzero(new)
        low, high = ids[at], ids[np.append(at[1:], len(ids)) - 1] if len(at) else ids[at]
        one, two = one[at], two[at]
        cut = np.searchsorted(one, [U(r * (1 << 64) // plan.ranges) for r in range(1, plan.ranges)])
        cut = np.concatenate([[0], cut, [len(one)]])
        parts = [int(r) for r in np.flatnonzero(np.diff(cut))]
        bits = lambda x: np.packbits(x).tobytes()
        blobs = [[f(x[cut[r] : cut[r + 1]]) for r in parts] for x, f in ((one, packed), (two, packed), (low, _narrow), (high > low, bits))]
        chunk = docs.column("chunk")[0].as_py() if docs.num_rows else 0
        return pa.table([pa.array(parts, pa.int64()), pa.array([chunk] * len(parts), pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], ["range", "chunk", "one", "two", "low", "more"])

    return run


def _exact(table: pa.Table) -> pa.Table:
    """Smallest doc_id of each candidate of a hash range, to the chunks that have a larger one."""
    read = {"one": lambda x: np.frombuffer(x, U), "two": lambda x: np.frombuffer(x, np.uint32), "low": _ids}
    lists = {k: [f(x) for x in table.column(k).to_pylist()] for k, f in read.items()}
    one, two, low = (np.concatenate(x) for x in lists.values())
    more = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)) for x, n in zip(table.column("more").to_pylist(), lists["one"], strict=True)]).astype(bool)
    chunk = np.repeat(np.asarray(table.column("chunk")), [len(x) for x in lists["one"]])
    order = np.lexsort((low, two, one))
    one, two, low, more, chunk = (x[order] for x in (one, two, low, more, chunk))
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    least = low[new][np.cumsum(new) - 1]
    keep = np.flatnonzero((low > least) | more)
    keep = keep[np.argsort(chunk[keep], kind="stable")]
    names, at = np.unique(chunk[keep], return_index=True)
    groups = np.split(keep, at[1:]) if len(names) else []
    blobs = [[f(x[k]) for k in groups] for x, f in ((one, packed), (two, packed), (least, _narrow))]
    return pa.table([pa.array(names, pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], ["chunk", "one", "two", "least"])


def _apply(plan: Plan, with_text: bool):
    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        read = {"one": lambda x: np.frombuffer(x, U), "two": lambda x: np.frombuffer(x, np.uint32), "least": _ids}
        lists = [[f(x) for x in repeats.column(k).to_pylist()] for k, f in read.items()]
        one, two, least = (np.concatenate(x) if x else np.zeros(0, U) for x in lists)
        order = np.lexsort((two, one))
        one, two, least = one[order], two[order], least[order]
        doc_ids = docs.column("doc_id").combine_chunks()
        known, numbers = np.asarray(doc_ids.is_valid()), np.asarray(doc_ids.fill_null(0).cast(pa.int64()))
        n_words, removed, digests, kept = [], [], [], []
        for row, t in texts(docs.column("text")):
            starts, ends, owner, w1, w2, first = _hashed(t, plan.window)
            hit = np.zeros(0, np.int64)
            if len(one) and len(first):
                # 64 bits of the hash find the place, the other 32 confirm it; equal first halves are stepped through.
                i, hits, todo = np.searchsorted(one, w1), np.zeros(len(w1), bool), np.arange(len(w1))
                while len(todo):
                    todo = todo[(i[todo] < len(one))]
                    todo = todo[one[i[todo]] == w1[todo]]
                    same = two[i[todo]] == w2[todo]
                    mine = row + owner[first[todo]]
                    hits[todo] = same & known[mine] & (least[i[todo]] < numbers[mine])
                    todo = todo[~same]
                    i[todo] += 1
                hit = first[hits]
            gone = covered(hit, plan.window, len(starts))
            counts, lost = np.bincount(owner, minlength=t.n), np.bincount(owner[gone], minlength=t.n)
            n_words.append(counts)
            removed.append(lost)
            edge = np.concatenate([[0], np.cumsum(counts)])
            stay = ~gone
            for d in range(t.n):
                a, b = edge[d], edge[d + 1]
                raw = t.bytes(d)
                k = np.flatnonzero(stay[a:b]) + a
                text = b" ".join([raw[s:e] for s, e in zip((starts[k] - t.at[d]).tolist(), (ends[k] - t.at[d]).tolist(), strict=True)])
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept.append(text.decode())
        columns = {
            "doc_id": doc_ids.cast(pa.int64()), "n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
            "n_removed": pa.array(np.concatenate(removed) if removed else [], pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
        }
        return pa.table(columns | ({"kept_text": pa.array(kept, pa.string())} if with_text else {}))

    return run


def deduplicate_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (``with_text``) kept_text for each row of ``docs``.

    ``kept_text`` is the kept words joined by one space.  Null and empty texts have no words.  Rows with a
    null doc_id lose nothing and make no other row lose words; rows that share a doc_id count as one
    document.  Windows are judged on the input, not on what is left.  Other columns aren't read; an empty
    table gives an empty table.
    """
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan(n_bytes, window)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(plan.chunks)).alias("chunk"))
    by_chunk = lambda df: df.groupBy("chunk")
    sketches = by_chunk(dealt).applyInArrow(_sketch(plan), "range long, chunk long, cells binary, often binary")
    merged = sketches.groupBy("range").applyInArrow(_merge, "range long, chunk long, cells binary")
    found = by_chunk(dealt).cogroup(by_chunk(merged)).applyInArrow(_candidates(plan), "range long, chunk long, one binary, two binary, low binary, more binary")
    repeats = found.groupBy("range").applyInArrow(_exact, "chunk long, one binary, two binary, least binary")
    columns = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return by_chunk(dealt).cogroup(by_chunk(repeats)).applyInArrow(_apply(plan, with_text), columns)


def op3_substring_dedup(docs: DataFrame) -> DataFrame:
    """The contract's digest columns for each row of ``docs``; null texts have no words."""
    return deduplicate_substrings(docs, with_text=False)
