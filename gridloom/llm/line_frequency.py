"""Quality rules with cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space reduced to single spaces) and hashed to 128 bits.  A line
is boilerplate on a host (``source``) if more than ``FLOOR`` distinct documents of the host have it and these
are more than ``SHARE`` of the host's documents or more than ``CEILING``, so that the limit doesn't grow without
end with the host.  Boilerplate lines are removed; a document that loses more
than half of its words is depleted and rejected, as is one that fails the base rules.

Scale: the text is read once; what remains is a row for each document with the hashes of its distinct
lines.  Documents are dealt into chunks by a hash, a chunk adds up its documents for each (host, line) before
anything is shuffled by line, and boilerplate lines go back to the chunks that have them.  So a line of all
documents is one row for each chunk, and nothing is gathered.  Rows that share a doc_id are one document: their
lines, and theirs alone, are made distinct by a shuffle of their own before they are counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import free_name
from gridloom.llm.text import HEAD, SPACE, Texts, U, covered, mixed, packed, texts, unpacked, windows
from gridloom.plans.durable import keep

FLOOR = 10
SHARE = 0.01
CEILING = 100_000
#: Most repeated ids, or hosts, whose table is broadcast (counted first).
MAX_BROADCAST = 1_000_000
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
NEWLINE = np.arange(256) == 0x0A
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32


def _line_hashes(t: Texts, starts: np.ndarray, ends: np.ndarray, line: np.ndarray, n_lines: int, seed: int) -> np.ndarray:
    """Hashes of the word sequences of lines that have words; ``line`` is each word's."""
    h = t.hashes(starts, ends, seed)
    edge = np.flatnonzero(np.diff(line, prepend=-1))
    place = np.arange(len(line)) - np.repeat(edge, np.diff(np.append(edge, len(line))))
    power = np.cumprod(np.full(int(place.max(initial=0)) + 1, 0x9E3779B97F4A7C15, U))
    out = np.zeros(n_lines, U)
    if len(edge):
        out[line[edge]] = mixed(np.add.reduceat(h * power[place], edge))
    return out


def _measured(t: Texts) -> dict[str, np.ndarray | list[bytes]]:
    """Base measures and, as bytes, the distinct lines (two hashes, words) of each text."""
    starts, ends, owner = t.words()
    per = lambda keep=slice(None): np.bincount(owner[keep], minlength=t.n)
    data = t.data[: t.size]
    # Words that are in a window of five which occurs in the same text again.
    h, first = windows(t.hashes(starts, ends, 1), owner, 5)
    key = mixed(h ^ (owner[first].astype(U) * U(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    again = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][again]] = True
    twice[order[:-1][again]] = True
    repeated = covered(first[twice], 5, len(starts))
    # Lines: raw for repetition within the text, normalised for frequency across texts.
    l_start, l_end, l_owner = t.runs(NEWLINE)
    line = np.searchsorted(l_start, starts, "right") - 1
    l_words = np.bincount(line, minlength=len(l_start))
    full = l_words > 0
    raw = mixed(t.hashes(l_start, l_end, 3) ^ (l_owner.astype(U) * U(0x9E3779B97F4A7C15)))[full]
    order = np.argsort(raw, kind="stable")
    same = raw[order][1:] == raw[order][:-1]
    dup_owner = l_owner[full][order[1:][same]]
    folded = Texts(FOLDED[data], t.at)
    one, two = (_line_hashes(folded, starts, ends, line, len(l_start), seed)[full] for seed in (4, 5))
    who, n = l_owner[full], l_words[full]
    order = np.lexsort((two, one, who))
    one, two, who, n = one[order], two[order], who[order], n[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (who[1:] != who[:-1])
    at = np.flatnonzero(new)
    n = np.add.reduceat(n, at) if len(at) else n
    one, two, who = one[at], two[at], who[at]
    cut = np.searchsorted(who, np.arange(t.n + 1))
    lines = [packed(one[a:b], two[a:b], n[a:b].astype(np.uint32)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return {
        "n_words": per(), "word_chars": t.per_text(HEAD[data] & ~SPACE[data]), "n_symbols": t.per_text(SYMBOLS[data]),
        "n_dup_lines": np.bincount(dup_owner, minlength=t.n), "n_repeat_words": per(repeated), "lines": lines,
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
PLACE = ("doc_id", "source", "chunk", "again")
SIGNATURE = "doc_id long, source string, chunk long, again boolean, " + ", ".join(f"{m} long" for m in MEASURES) + ", lines binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, t in texts(batch.column("text")):
            m = _measured(t)
            kept = batch.slice(row, t.n)
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(k) for k in PLACE), *(pa.array(m[k], pa.int64()) for k in MEASURES), pa.array(m["lines"], pa.binary())],
                [*PLACE, *MEASURES, "lines"],
            )


def _hosts(table: pa.Table) -> tuple[np.ndarray, list]:
    """A number for each row's host, and the hosts; null is one of them."""
    coded = table.column("source").combine_chunks().dictionary_encode("encode")
    return np.asarray(coded.indices), coded.dictionary.to_pylist()


def _listed(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All lines of some documents: the document's number, two hashes, words."""
    lists = [unpacked(x, "<u8", "<u8", "<u4") for x in blobs]
    row = np.repeat(np.arange(len(lists)), [len(x[0]) for x in lists])
    return row, *(np.concatenate([x[i] for x in lists]) if lists else np.zeros(0, U) for i in range(3))


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, and where in it runs of equal rows begin."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order, np.flatnonzero(new)


def _known(mine: tuple[np.ndarray, ...], hot: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which of the rows ``mine`` (host, hash, hash) are among ``hot``."""
    order, at = _runs(*(np.concatenate([h, m]) for h, m in zip(hot, mine, strict=True)))
    out = np.zeros(len(order), bool)
    if len(order):
        out[order] = np.repeat(np.logical_or.reduceat(order < len(hot[0]), at), np.diff(np.append(at, len(order))))
    return out[len(hot[0]) :]


def _per_chunk(table: pa.Table) -> pa.Table:
    """Documents for each (host, line) of a chunk; rows that share their doc_id with others count as none here."""
    host, names = _hosts(table)
    row, one, two, _ = _listed(table.column("lines").to_pylist())
    who = host[row]
    order, at = _runs(who, one, two)
    single = ~np.asarray(table.column("again").combine_chunks().to_numpy(zero_copy_only=False), bool)
    counts = np.add.reduceat(single[row][order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    first = order[at]
    chunk = table.column("chunk")[0].as_py()
    return pa.table(
        [pa.array([chunk] * len(at), pa.int64()), pa.array(names, pa.string()).take(pa.array(who[first])), pa.array(one[first].view(np.int64)), pa.array(two[first].view(np.int64)), pa.array(counts, pa.int64())],
        ["chunk", "source", "h1", "h2", "docs"],
    )


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line of each document."""
    for batch in batches:
        row, one, two, _ = _listed(batch.column("lines").to_pylist())
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("source").take(at), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["doc_id", "source", "h1", "h2"])


def _hot(hot: pa.Table, names: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Host numbers (by ``names``) and hashes of boilerplate lines."""
    number = {name: i for i, name in enumerate(names)}
    of = np.array([number.get(x, -1) for x in hot.column("source").to_pylist()], np.int64)
    return of, *(np.asarray(hot.column(c)).view(U) for c in ("h1", "h2"))


def _depleted(table: pa.Table, hot: pa.Table) -> pa.Table:
    """Words and distinct lines of each document that are boilerplate on its host."""
    host, names = _hosts(table)
    row, one, two, words = _listed(table.column("lines").to_pylist())
    bad = _known((host[row].astype(np.int64), one, two), _hot(hot, names))
    columns = {k: table.column(k) for k in ("doc_id", "source", *MEASURES)}
    n = lambda w: pa.array(np.bincount(row[bad], w, minlength=len(table)).astype(np.int64))
    return pa.table(columns | {"n_common_lines": n(None), "n_common_words": n(words[bad])})


def _dealt(docs: DataFrame, chunk: str = "chunk", again: str = "again", whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Hosts with their documents, and the rows with their chunk and whether others have their doc_id.

    With ``whole`` texts a chunk holds about 32 MB of them, else so many rows that chunks are few hundred to
    a hundred thousand.
    """
    docs = docs.withColumn(chunk, F.lit(0).cast("long"))
    ids = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    repeated = keep(ids.filter("__n > 1").select("__id"))
    n_repeated = repeated.count()
    size = F.sum(F.octet_length("text")) if whole else F.lit(0)
    if n_repeated:
        own, columns = free_name(docs, "repeated_id"), docs.columns
        flagged = repeated.withColumnRenamed("__id", own)
        docs = docs.join(F.broadcast(flagged) if n_repeated <= MAX_BROADCAST else flagged, F.col("doc_id") == F.col(own), "left")
        docs = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(own).isNotNull().alias(again))
        # A repeated id counts once on each of its hosts.
        several = docs.filter(F.col(again)).select("source", "doc_id").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"))
        single = docs.filter(~F.col(again)).groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"))
        hosts = keep(single.unionByName(several).groupBy("source").agg(F.sum("host_docs").alias("host_docs")))
    else:
        docs = docs.withColumn(again, F.lit(False))
        hosts = keep(docs.groupBy("source").agg(F.count(F.lit(1)).alias("host_docs")))
    n, bytes_ = docs.agg(F.count(F.lit(1)), size).first()
    chunks = max(64, -(-n // min(max(5 * math.isqrt(n), 1000), 100_000)), -(-(bytes_ or 0) // (32 << 20)))
    return hosts, docs.withColumn(chunk, F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)))


def common_lines(signatures: DataFrame, hosts: DataFrame, floor: int, share: float, ceiling: int) -> DataFrame:
    """chunk, source, h1 and h2 of the boilerplate lines of each chunk."""
    each = signatures.groupBy("chunk").applyInArrow(_per_chunk, "chunk long, source string, h1 long, h2 long, docs long")
    several = signatures.filter("again").mapInArrow(_lines, "doc_id long, source string, h1 long, h2 long").distinct()
    several = several.groupBy("source", "h1", "h2").agg(F.count(F.lit(1)).alias("docs")).withColumn("chunk", F.lit(-1).cast("long"))
    total = F.sum("docs").over(Window.partitionBy("source", "h1", "h2"))
    often = each.unionByName(several).withColumn("total", total).filter((F.col("total") > floor) & (F.col("chunk") >= 0))
    hosts = hosts.withColumnRenamed("source", "__host")
    if hosts.count() <= MAX_BROADCAST:
        hosts = F.broadcast(hosts)
    return often.join(hosts, F.col("source").eqNullSafe(F.col("__host"))).filter(F.col("total") > F.least(F.lit(share) * F.col("host_docs"), F.lit(float(ceiling)))).select("chunk", "source", "h1", "h2")


def line_rules(docs: DataFrame, floor: int = FLOOR, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """Measures, boilerplate counts and verdict for each row of ``docs`` (doc_id, text, source).

    Null and empty texts have no words and fail the base rules.  A null source is a host of its own.  Rows
    that share a doc_id are one document when the documents of a line or of a host are counted, and each get
    their row; rows without a doc_id each count.  Other columns aren't read; an empty table gives an empty one.
    """
    hosts, dealt = _dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source")))
    signatures = keep(dealt.mapInArrow(_signatures, SIGNATURE))
    hot = common_lines(signatures, hosts, floor, share, ceiling)
    out = "doc_id long, source string, " + ", ".join(f"{m} long" for m in MEASURES) + ", n_common_lines long, n_common_words long"
    judged = signatures.groupBy("chunk").cogroup(hot.groupBy("chunk")).applyInArrow(_depleted, out)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_common_words") * 2 <= F.col("n_words")))


def _cleaned(*helpers: str):
    def run(docs: pa.Table, hot: pa.Table) -> pa.Table:
        host, names = _hosts(docs)
        known, out = _hot(hot, names), []
        for row, t in texts(docs.column("text")):
            folded = Texts(FOLDED[t.data[: t.size]], t.at)
            starts, ends, _ = t.words()
            l_start, l_end, l_owner = t.runs(NEWLINE)
            line = np.searchsorted(l_start, starts, "right") - 1
            one, two = (_line_hashes(folded, starts, ends, line, len(l_start), seed) for seed in (4, 5))
            full = np.bincount(line, minlength=len(l_start)) > 0
            gone = np.flatnonzero(full & _known((host[row + l_owner].astype(np.int64), one, two), known))
            cut = np.searchsorted(l_owner[gone], np.arange(t.n + 1))
            for d in range(t.n):
                raw, at = t.bytes(d), t.at[d]
                if cut[d] < cut[d + 1]:
                    parts, done = [], 0
                    for k in gone[cut[d] : cut[d + 1]].tolist():
                        parts.append(raw[done : l_start[k] - at])
                        done = l_end[k] - at + 1
                    raw = b"".join([*parts, raw[done:]])
                out.append(raw.decode())
        valid = docs.column("text").is_valid().to_pylist()
        text = pa.array([x if v else None for x, v in zip(out, valid, strict=True)], pa.string())
        docs = docs.drop_columns(list(helpers))
        return docs.set_column(docs.schema.get_field_index("text"), "text", text)

    return run


def remove_common_lines(docs: DataFrame, floor: int = FLOOR, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; columns unchanged, no document removed.

    A line goes with its line break.  Null texts stay null; counted as in ``line_rules``.
    """
    chunk, again = free_name(docs, "chunk"), free_name(docs, "again")
    hosts, dealt = _dealt(docs, chunk, again, whole=True)
    place = [F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col(chunk).alias("chunk"), F.col(again).alias("again")]
    hot = common_lines(keep(dealt.select(place).mapInArrow(_signatures, SIGNATURE)), hosts, floor, share, ceiling)
    return dealt.groupBy(chunk).cogroup(hot.groupBy("chunk")).applyInArrow(_cleaned(chunk, again), docs.schema)


def op2_line_frequency(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of ``docs``, with the boilerplate lines and words of each."""
    return line_rules(docs).select("doc_id", *MEASURES, "base_failed", "kept", "n_common_lines", "n_common_words")
