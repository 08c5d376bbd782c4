"""Language identification with bit-sliced Bloom filters of n-grams.

Training counts in how many documents of a language each four-byte n-gram occurs (letters lower-cased,
everything else a space) and keeps the n-grams of at least ``MIN_SHARE`` of them.  All languages share one
filter whose positions hold a bit mask of languages: the masks at an n-gram's positions, combined by AND,
name every language that contains it.  A text's score for a language is the share of its n-grams that have
the language's bit, corrected for the share expected by chance from how full the language's slice is, and
measured against the share that the language's own training documents reach.

Scale: a map over documents with a filter of fixed size (64 languages for each slice of masks).  Training
reads a sample of at most about ``SAMPLE_DOCS`` documents of each language, the documented bound; n-gram
counts are added up in tasks and by Spark, and only n-grams above the share reach the driver, at most
1 / MIN_SHARE times a document's n-grams for each language.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import id_fold
from gridloom.llm.text import Texts, U, mixed, texts

FOLDS = 5
#: Documents of each language that training reads, about; chosen by a hash of doc_id.
SAMPLE_DOCS = 5_000
MIN_SHARE = 0.01
FILTER_BITS = 20
PROBES = 2
GRAM = 4

#: Letters of ASCII and all bytes beyond it stay, anything else is a space.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


class Model(NamedTuple):
    """masks: (slices, positions) of 64 languages each; by language the chance share and the own share."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray
    own: np.ndarray


def _grams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that hold a letter, as 32-bit numbers, and the text of each."""
    d = LETTERS[t.data]
    size = max(t.size - GRAM + 1, 0)
    g = np.zeros(size, np.uint32)
    letter = np.zeros(size, bool)
    for k in range(GRAM):
        g |= d[k : k + size].astype(np.uint32) << np.uint32(8 * k)
        letter |= d[k : k + size] != 32
    owner = np.repeat(np.arange(t.n), np.diff(t.at))
    inside = letter & (owner[:size] == owner[GRAM - 1 : GRAM - 1 + size]) if size else letter
    at = np.flatnonzero(inside)
    return g[at], owner[at]


def _probes(g: np.ndarray) -> list[np.ndarray]:
    x = mixed(g.astype(U) + U(0x9E3779B97F4A7C15))
    return [((x >> U(k * FILTER_BITS)) & U((1 << FILTER_BITS) - 1)).astype(np.int64) for k in range(PROBES)]


def _lowered(column: pa.Array) -> pa.Array:
    """Lower-cased, with a space at both ends so that words at the edges look like words elsewhere."""
    return pc.binary_join_element_wise("", pc.utf8_lower(column.fill_null("")), "", " ")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each language and n-gram in a partition."""
    found: dict[str, list[np.ndarray]] = defaultdict(list)
    for batch in batches:
        names = np.array(batch.column("lang").to_pylist(), object)
        for row, t in texts(batch.column("text"), _lowered):
            g, owner = _grams(t)
            pairs = np.unique(owner.astype(U) << U(32) | g.astype(U))
            who = (pairs >> U(32)).astype(np.int64)
            for name in set(names[row : row + t.n].tolist()):
                mine = (pairs & U(0xFFFFFFFF))[names[row + who] == name].astype(np.uint32)
                found[name].append(mine)
                if sum(map(len, found[name])) > 20_000_000:
                    yield from _summed(name, found.pop(name))
                    found[name] = []
    for name, parts in found.items():
        yield from _summed(name, parts)


def _summed(name: str, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if parts and sum(map(len, parts)):
        g, n = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "docs"])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, min_share: float = MIN_SHARE) -> Model:
    """A model from rows with text and lang; an empty table gives a model without languages."""
    labelled = docs.filter("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1, 1 << FILTER_BITS), U), np.zeros(0), np.ones(0))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_docs / sizes[k]))])[F.col("lang")]
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_000)) < share * 1_000_000
    sample = labelled.filter(drawn)
    taken = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    least = F.create_map(*[F.lit(x) for k in languages for x in (k, max(2.0, min_share * taken.get(k, 0)))])[F.col("lang")]
    counts = sample.select("text", "lang").mapInArrow(_counts, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    kept = counts.filter(F.col("docs") >= least).select("lang", "gram").toArrow()
    names, grams = np.array(kept.column("lang").to_pylist(), object), np.asarray(kept.column("gram")).astype(np.uint32)
    masks = np.zeros((-(-len(languages) // 64), 1 << FILTER_BITS), U)
    for i, name in enumerate(languages):
        for at in _probes(grams[names == name]):
            masks[i // 64, at] |= U(1 << i % 64)
    full = np.array([((masks[i // 64] >> U(i % 64)) & U(1)).mean() for i in range(len(languages))])
    model = Model(languages, masks, full**PROBES, np.ones(len(languages)))
    # What share of its own documents' n-grams a language's slice knows.
    own = sample.select("lang", "text").mapInArrow(_own_shares(model), "lang string, share double").groupBy("lang").agg(F.avg("share").alias("share")).collect()
    known = {r["lang"]: r["share"] for r in own}
    return model._replace(own=np.array([max(known.get(k) or 0.0, 0.05) for k in languages]))


def shares(t: Texts, model: Model) -> np.ndarray:
    """(texts, languages): share of a text's n-grams with the language's bit, corrected for chance."""
    g, owner = _grams(t)
    at = _probes(g)
    n = np.bincount(owner, minlength=t.n)
    cut = np.searchsorted(owner, np.arange(t.n))
    out = np.zeros((t.n, len(model.languages)))
    some = n > 0
    for part in range(len(model.masks)):
        mask = model.masks[part][at[0]]
        for p in at[1:]:
            mask &= model.masks[part][p]
        for i in range(part * 64, min(len(model.languages), part * 64 + 64)):
            bit = ((mask >> U(i % 64)) & U(1)).astype(np.int64)
            if len(bit):
                out[some, i] = np.add.reduceat(bit, cut[some]) / n[some]
    return np.clip((out - model.chance) / (1.0 - model.chance + 1e-12), 0.0, 1.0)


def _own_shares(model: Model):
    number = {k: i for i, k in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for row, t in texts(batch.column("text"), _lowered):
                s = shares(t, model)
                mine = s[np.arange(t.n), [number[k] for k in names[row : row + t.n]]]
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(row, t.n), pa.array(mine)], ["lang", "share"])

    return run


def _classifier(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").fill_null("")
            for row, t in texts(column, _lowered):
                plain = LETTERS[t.data[: t.size]]
                letter = t.per_text((plain >= 97) & (plain <= 122)) > 0
                for d in np.flatnonzero(~letter):  # no ASCII letter: look at the characters
                    letter[d] = any(c.isalpha() for c in column[row + int(d)].as_py())
                s = shares(t, model) / model.own if model.languages else np.zeros((t.n, 1))
                best = s.argmax(axis=1)
                total = s.sum(axis=1)
                score = np.where(total > 0, s[np.arange(t.n), best] / np.maximum(total, 1e-12), 0.0)
                known = letter & bool(model.languages)
                lang = [model.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, t.n), pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, s.max(axis=1), 0.0))],
                    ["doc_id", "lang_pred", "score", "fit"],
                )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the language's part of all scores) and fit for each row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0.  A tie goes to the first language by
    name.  Only doc_id and text are read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_classifier(model), "doc_id long, lang_pred string, score double, fit double")


def op5_language_id(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of ``docs``, and how well the text fits its language.

    Null texts and texts without a letter are ``und``, as all are where nothing can be learned.
    """
    model = train(docs.filter(id_fold(F.col("doc_id"), FOLDS) != 0))
    return identify(docs, model).withColumn("held_out", id_fold(F.col("doc_id"), FOLDS) == 0).select("doc_id", "held_out", "lang_pred", "score", "fit")
