"""Quality classifier: a generalised additive model with pairwise interactions.

Shape statistics of a text (lengths, repetition, symbols, case, lines) are cut into at most ``BINS`` bins
each.  Training goes round the features, fits a shallow tree on one feature's bins to the residuals, and
adds a small part of it to that feature's lookup table; then does the same for pairs of features, chosen by
what a cut in both would still explain.  A score is the sum of table entries: bins are found and added up
for all texts of a batch at once.

Scale: scoring is a map over documents with a few kilobytes of tables.  Training reads at most about
``SAMPLE_ROWS`` labelled documents, the documented bound; their features are computed by Spark and only
these numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import id_fold, labelled_sample
from gridloom.llm.text import HEAD, SPACE, Texts, U, covered, mixed, texts, windows

FOLDS, HELD_OUT = 3, 1
SAMPLE_ROWS = 20_000
BINS = 32
ROUNDS, RATE, SHRINK = 150, 0.15, 5.0
PAIRS, PAIR_ROUNDS = 8, 40

FEATURES = (
    "log_words", "word_length", "upper_share", "symbol_share", "digit_share", "mark_share", "bar_share", "repeated_share",
    "repeated_lines", "distinct_share", "words_per_line", "short_share", "wide_share", "longest_word", "log_lines", "shout_share",
)
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>@^~_=+\\{}[]"))
_MARK = np.isin(np.arange(256), list(b".,;:!?"))
_BAR, _SHOUT, _NEWLINE = (np.arange(256) == ord(c) for c in "|!\n")


def features(t: Texts) -> np.ndarray:
    """(texts, features); empty texts have zeros."""
    starts, ends, owner = t.words()
    data = t.data[: t.size]
    n = np.bincount(owner, minlength=t.n).astype(float)
    per = lambda flags: np.bincount(owner[flags], minlength=t.n)
    chars = np.maximum(t.per_text(HEAD[data] & ~SPACE[data]), 1)
    words = np.maximum(n, 1)
    h = t.hashes(starts, ends, 21)
    spread = owner.astype(U) * U(0x9E3779B97F4A7C15)

    def again(keys: np.ndarray) -> np.ndarray:
        """Which keys have occurred before in the input's order."""
        order = np.argsort(keys, kind="stable")
        out = np.zeros(len(keys), bool)
        out[order[1:][keys[order][1:] == keys[order][:-1]]] = True
        return out

    w, first = windows(h, owner, 5)
    repeated = covered(first[again(mixed(w ^ spread[first]))], 5, len(starts))
    l_start, l_end, l_owner = t.runs(_NEWLINE)
    lines = np.maximum(np.bincount(l_owner, minlength=t.n), 1)
    same_line = again(mixed(t.hashes(l_start, l_end, 22) ^ l_owner.astype(U) * U(0x9E3779B97F4A7C15)))
    size = ends - starts
    longest = np.zeros(t.n)
    np.maximum.at(longest, owner, size)
    upper, lower = t.per_text(_UPPER[data]), t.per_text(_LOWER[data])
    share = lambda table: t.per_text(table[data]) / chars
    return np.column_stack([
        np.log1p(n), chars / words, upper / np.maximum(upper + lower, 1), share(_SYMBOL), share(_DIGIT), share(_MARK), share(_BAR), per(repeated) / words,
        np.bincount(l_owner[same_line], minlength=t.n) / lines, 1.0 - per(again(mixed(h ^ spread))) / words, n / lines, per(size <= 3) / words,
        t.per_text(data >= 128) / chars, np.log1p(longest), np.log1p(lines), share(_SHOUT),
    ])


class Gam(NamedTuple):
    """Bin edges and table of each feature; pairs of features with their tables; the constant."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    constant: float

    def binned(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        f = np.full(len(x), self.constant)
        for j, table in enumerate(self.tables):
            f += table[b[j]]
        for (j, k), table in zip(self.pairs, self.pair_tables, strict=True):
            f += table[b[j], b[k]]
        return 1.0 / (1.0 + np.exp(-np.clip(f, -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0 is none."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    value = lambda a, b: a * a / (b + SHRINK)
    gain = value(left_g, left_h) + value(g.sum() - left_g, h.sum() - left_h) - value(g.sum(), h.sum())
    if not len(gain) or gain.max() <= 1e-12:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two on a row of bins: the value of each bin."""
    parts = [(0, len(g))]
    for _ in range(2):
        cuts = [(a, a + _cut(g[a:b], h[a:b])[1], b) for a, b in parts]
        parts = [q for a, c, b in cuts for q in ((a, c), (c, b)) if q[0] < q[1]]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One cut in the rows and one in the columns of each side."""
    c = _cut(g.sum(axis=1), h.sum(axis=1))[1] or g.shape[0] // 2
    out = np.zeros(g.shape)
    for rows in (slice(0, c), slice(c, None)):
        sg, sh = g[rows].sum(axis=0), h[rows].sum(axis=0)
        k = _cut(sg, sh)[1]
        for cols in (slice(0, k), slice(k, None)):
            out[rows, cols] = sg[cols].sum() / (sh[cols].sum() + SHRINK)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """A model of ``y`` (0 or 1); without rows it scores 0.5."""
    p = x.shape[1]
    if not len(y):
        return Gam([np.zeros(0)] * p, [np.zeros(1)] * p, [], [], 0.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(p)]
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Gam(edges, [np.zeros(len(e) + 1) for e in edges], [], [], float(np.log(rate / (1 - rate))))
    b = model.binned(x)
    f = np.full(len(y), model.constant)
    slope = lambda: (y - (q := 1 / (1 + np.exp(-f))), np.maximum(q * (1 - q), 1e-6))
    for _ in range(ROUNDS):
        for j in range(p):
            g, h = slope()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(b[j], g, size), np.bincount(b[j], h, size))
            model.tables[j][:] += step
            f += step[b[j]]
    g, h = slope()

    def grid(j: int, k: int, w: np.ndarray) -> np.ndarray:
        rows, cols = len(edges[j]) + 1, len(edges[k]) + 1
        return np.bincount(b[j] * cols + b[k], w, rows * cols).reshape(rows, cols)

    def left_over(pair: tuple[int, int]) -> float:
        t = _pair_tree(*(grid(*pair, w) for w in (g, h)))
        return float((t * grid(*pair, g)).sum())

    pairs = sorted(combinations(range(p), 2), key=left_over, reverse=True)[:PAIRS]
    tables = [np.zeros((len(edges[j]) + 1, len(edges[k]) + 1)) for j, k in pairs]
    for _ in range(PAIR_ROUNDS):
        for (j, k), table in zip(pairs, tables, strict=True):
            g, h = slope()
            step = RATE * _pair_tree(grid(j, k, g), grid(j, k, h))
            table += step
            f += step[b[j], b[k]]
    return model._replace(pairs=pairs, pair_tables=tables)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, t in texts(batch.column("text")):
            x = features(t)
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(row, t.n), *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["label", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, column: str, allowed, sample_rows: int = SAMPLE_ROWS) -> Gam:
    sample = labelled_sample(docs, labels, column, allowed, sample_rows)
    rows = sample.select("label", "text").mapInArrow(_feature_rows, "label int, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow()
    x = np.column_stack([np.asarray(rows.column(f)) for f in FEATURES])
    y = np.asarray(rows.column("label")).astype(float)
    order = np.lexsort([*x.T, y])  # rows come in no fixed order, sums of floats depend on it
    return fit(x[order], y[order])


def _scorer(model: Gam):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in texts(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, t.n), pa.array(model.scores(features(t)))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id and score for each row of ``docs``, by its text alone.

    Null counts as an empty text, which is scored as such; repeated rows have equal scores, values at a bin's
    edge go to the bin above.  Other columns aren't read; an empty table gives an empty table.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model), "doc_id long, score double")


def op6_quality_gam(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for each row of ``docs``; without labelled rows every score is 0.5."""
    model = train(docs, labels, "quality", id_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    scored = score(docs, model)
    return scored.select("doc_id", (id_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
