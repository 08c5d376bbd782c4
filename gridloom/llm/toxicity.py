"""Toxicity: a counterfactually regularised linear classifier.

A text's features are which of the selected words and five-byte letter runs it has.  Selection keeps those
that labelled toxic documents have far more often than chance; words of ``IDENTITY_TERMS`` and their runs are
always among the features.  Training minimises the log loss of the labels plus a penalty on the squared
change of the score when, in a labelled sentence, the identity terms are swapped, half the time each for another
of its group, else all for ``NEUTRAL``: the first kind makes terms of a group weigh alike, the second keeps that
weight near nothing, so that a neutral mention isn't an alarm.  Sentences that name a group are used as they are;
a share of the others get a term put in, so that the penalty works where the corpus names none.

Scale: scoring is a map over documents with a table of at most ``MAX_FEATURES`` weights.  Training reads at
most about ``SAMPLE_ROWS`` labelled documents, the documented bound; feature counts are added up in tasks and
by Spark, and only selected features and the sample's indices into them reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import id_fold, labelled_sample
from gridloom.llm.text import Texts, U, mixed, texts

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
SAMPLE_ROWS = 20_000
MAX_FEATURES = 16_384
LEAST_DOCS, LEAST_Z = 4, 4.0
RUN = 5
#: Weight of the penalty and of the ridge; sentences of a document that are used for swaps; share of the
#: documents whose sentences get a term put in.
PENALTY, RIDGE, SENTENCES, PUT_IN = 1.0, 2e-4, 4, 0.2

# Terms that name groups of people without judging them, one group a line.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man", "female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("black", "white", "asian", "african", "european", "latino", "hispanic", "arab", "indigenous", "roma"),
    ("immigrants", "refugees", "foreigners", "migrants", "natives", "locals"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young", "old"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "turkish", "polish", "russian"),
)
#: Names people of no group.
NEUTRAL = "people"
_GROUP = {term: group for group in IDENTITY_TERMS for term in group}
_TERM = re.compile(r"(?<!\w)(" + "|".join(sorted(_GROUP, key=len, reverse=True)) + r")(?!\w)")
_SENTENCE = re.compile(r"[^.!?\n]+")

#: Letters of ASCII and all bytes beyond it stay, anything else is a space.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)
_GAP = LETTERS == 32


class Model(NamedTuple):
    """Sorted features, their weights, and the constant."""

    features: np.ndarray
    weights: np.ndarray
    constant: float

    def table(self) -> np.ndarray:
        """Which low bits of a feature occur at all."""
        known = np.zeros(1 << 20, bool)
        known[self.features & np.uint32((1 << 20) - 1)] = True
        return known


def _lowered(column: pa.Array) -> pa.Array:
    """Lower-cased, with a space at both ends."""
    return pc.binary_join_element_wise("", pc.utf8_lower(column.fill_null("")), "", " ")


def features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All features of texts of lower-case letters, as 32-bit hashes with repetitions, and their texts."""
    d = LETTERS[t.data]
    size = max(t.size - RUN + 1, 0)
    g, letter = np.zeros(size, U), np.zeros(size, bool)
    for k in range(RUN):
        g |= d[k : k + size].astype(U) << U(8 * k)
        letter |= d[k : k + size] != 32
    owner = np.repeat(np.arange(t.n), np.diff(t.at))
    at = np.flatnonzero(letter & (owner[:size] == owner[RUN - 1 : RUN - 1 + size])) if size else np.zeros(0, np.int64)
    starts, ends, who = t.runs(_GAP)
    words = t.hashes(starts, ends, 31)
    return np.concatenate([mixed(g[at] + U(1)) >> U(32), words >> U(32)]).astype(np.uint32), np.concatenate([owner[at], who])


def _plain(t: Texts) -> Texts:
    return Texts(LETTERS[t.data[: t.size]], t.at)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and toxic documents with each feature in a partition."""
    found: list[list[np.ndarray]] = [[], []]
    for batch in batches:
        y = np.asarray(batch.column("label"))
        for row, t in texts(batch.column("text"), _lowered):
            f, owner = features(_plain(t))
            pairs = np.unique(owner.astype(U) << U(32) | f.astype(U))
            label = y[row + (pairs >> U(32)).astype(np.int64)]
            for k in (0, 1):
                found[k].append((pairs & U(0xFFFFFFFF))[label == k].astype(np.uint32))
    f = np.concatenate([x for part in found for x in part] or [np.zeros(0, np.uint32)])
    toxic = np.repeat([0, 1], [sum(map(len, part)) for part in found])
    f, inverse = np.unique(f, return_inverse=True)
    yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)), pa.array(np.bincount(inverse, minlength=len(f)).astype(np.int64)), pa.array(np.bincount(inverse, toxic, len(f)).astype(np.int64))], ["feature", "docs", "toxic"])


def _present(t: Texts, known: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, index into ``known``) of the selected features of each text."""
    f, owner = features(_plain(t))
    at = np.flatnonzero(table[f & np.uint32((1 << 20) - 1)])
    f, owner = f[at], owner[at]
    i = np.searchsorted(known, f)
    i[i == len(known)] = 0
    ok = known[i] == f if len(known) else np.zeros(0, bool)
    pairs = np.unique(owner[ok].astype(U) << U(32) | i[ok].astype(U))
    return (pairs >> U(32)).astype(np.int64), (pairs & U(0xFFFFFFFF)).astype(np.int64)


def _lists(sentences: list[str], known: np.ndarray, table: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in sentences]
    for row, t in texts(_lowered(pa.array(sentences, pa.string()))):
        for d, i in zip(*(x.tolist() for x in _present(t, known, table)), strict=True):
            out[row + d].append(i)
    return out


def _swapped(sentence: str, draw: int) -> str:
    """``sentence`` with every identity term for another of its group, or all for ``NEUTRAL``."""

    def other(m: re.Match) -> str:
        terms = [x for x in _GROUP[m[1]] if x != m[1]]
        return terms[(draw >> 33) % len(terms)]

    return _TERM.sub(NEUTRAL if draw >> 63 else other, sentence)


def swaps(text: str, draw: int, put_in: bool) -> list[tuple[str, str]]:
    """Sentences of a text with an identity term, each with the same sentence after a swap."""
    out: list[tuple[str, str]] = []
    for m in _SENTENCE.finditer(text.lower()):
        sentence, draw = m[0], (draw * 0x5851F42D4C957F2D + 1) % (1 << 64)
        if _TERM.search(sentence):
            out.append((sentence, _swapped(sentence, draw)))
        elif put_in:
            group = IDENTITY_TERMS[(draw >> 40) % len(IDENTITY_TERMS)]
            a = (draw >> 20) % len(group)
            b = (a + 1 + (draw >> 50) % (len(group) - 1)) % len(group)
            words = sentence.split()
            where = (draw >> 30) % (len(words) + 1)
            out.append(tuple(" ".join([*words[:where], term, *words[where:]]) for term in (group[a], NEUTRAL if draw >> 63 else group[b])))
        if len(out) == SENTENCES:
            break
    return out


def _examples(known: np.ndarray):
    """Labelled rows as indices of features: kind 0 a document, kind 1 a sentence and its swapped form."""
    table = Model(known, known, 0.0).table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, y, column = batch.column("doc_id").to_pylist(), batch.column("label"), batch.column("text")
            for row, t in texts(column, _lowered):
                who, index = _present(t, known, table)
                cut = np.searchsorted(who, np.arange(t.n + 1))
                lists = [index[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                pairs: list[tuple[str, str]] = []
                for d in range(t.n):
                    draw = int(mixed(np.array([ids[row + d]], np.int64).view(U))[0])
                    if (text := column[row + d].as_py()) is not None:
                        pairs += swaps(text, draw, (draw >> 11) % 1000 < 1000 * PUT_IN)
                one, two = (_lists([p[k] for p in pairs], known, table) for k in (0, 1))
                label = y.slice(row, t.n).to_pylist() + [0] * len(pairs)
                kind = [0] * t.n + [1] * len(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(label, pa.int32()), pa.array(lists + one, pa.list_(pa.int32())), pa.array([[]] * t.n + two, pa.list_(pa.int32()))], ["kind", "label", "here", "swapped"])

    return run


def _sparse(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)


def fit(docs: list[list[int]], y: np.ndarray, here: list[list[int]], swapped: list[list[int]], n: int, steps: int = 400, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and constant by full-batch Adam on log loss, ridge and the penalty on score changes."""
    row, col = _sparse(docs)
    r1, c1 = _sparse(here)
    r2, c2 = _sparse(swapped)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    w, b = np.zeros(n), float(np.log(rate / (1 - rate)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], len(y)), -30, 30)))
        e = (p - y) / max(len(y), 1)
        g = np.bincount(col, e[row], n) + RIDGE * w
        if len(here):
            change = np.bincount(r1, w[c1], len(here)) - np.bincount(r2, w[c2], len(here))
            g += 2 * penalty / len(here) * (np.bincount(c1, change[r1], n) - np.bincount(c2, change[r2], n))
        gb = e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        down = lambda a, c: 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
        w, b = w - down(m, v), b - down(mb, vb)
    return w, b


def identity_features() -> np.ndarray:
    _, t = next(texts(_lowered(pa.array([" ".join(_GROUP)], pa.string()))))
    return np.unique(features(_plain(t))[0])


def train(docs: DataFrame, labels: DataFrame, allowed: Column, sample_rows: int = SAMPLE_ROWS, penalty: float = PENALTY) -> Model:
    """A model from labelled documents; without any it scores 0.5."""
    sample = labelled_sample(docs, labels, "toxic", allowed, sample_rows)
    total = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    n, toxic = total[0] or 0, total[1] or 0
    if not n:
        return Model(np.zeros(0, np.uint32), np.zeros(0), 0.0)
    rate = min(max(toxic / n, 1e-3), 1 - 1e-3)
    counts = sample.select("text", "label").mapInArrow(_counted, "feature long, docs long, toxic long").groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    z = (F.col("toxic") - F.col("docs") * rate) / F.sqrt(F.col("docs") * rate * (1 - rate))
    best = counts.filter(F.col("docs") >= LEAST_DOCS).withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).select("feature").toArrow()
    known = np.unique(np.concatenate([np.asarray(best.column("feature")).astype(np.uint32), identity_features()]))
    rows = sample.select("doc_id", "text", "label").mapInArrow(_examples(known), "kind int, label int, here array<int>, swapped array<int>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["kind"], r["label"], r["here"], r["swapped"]))
    own = [r for r in rows if r["kind"] == 0]
    pairs = [r for r in rows if r["kind"] == 1]
    w, b = fit([r["here"] for r in own], np.array([r["label"] for r in own], float), [r["here"] for r in pairs], [r["swapped"] for r in pairs], len(known), penalty=penalty)
    return Model(known, w, b)


def _scorer(model: Model):
    table = model.table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in texts(batch.column("text"), _lowered):
                who, index = _present(t, model.features, table)
                f = model.constant + np.bincount(who, model.weights[index], t.n) if len(index) else np.full(t.n, model.constant)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, t.n), pa.array(1 / (1 + np.exp(-np.clip(f, -30, 30))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for each row of ``docs``, by its text alone.

    Null counts as an empty text; repeated rows have equal scores.  Other columns aren't read; an empty table
    gives an empty table.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model), "doc_id long, score double")


def _filter(model: Model):
    table = model.table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in texts(batch.column("text"), _lowered):
                who, index = _present(t, model.features, table)
                f = model.constant + np.bincount(who, model.weights[index], t.n) if len(index) else np.full(t.n, model.constant)
                yield batch.slice(row, t.n).filter(pa.array(1 / (1 + np.exp(-np.clip(f, -30, 30))) < THRESHOLD))

    return run


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that score ``THRESHOLD`` or more; columns unchanged, whatever their names.

    Null and empty texts score as empty ones.
    """
    return docs.mapInArrow(_filter(model), docs.schema)


def op8_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for each row of ``docs``; without labelled rows every score is 0.5."""
    model = train(docs, labels, id_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    scored = score(docs, model)
    return scored.select("doc_id", (id_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
