"""What the README claims of operators beyond their contracts: pruning by shards, scores of neutral mentions."""

import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import hilbert, toxicity


def test_filters_on_any_dimension_skip_shards(spark):
    rng = random.Random(5)
    rows = [(i, f"s{rng.randrange(8)}", f"l{rng.randrange(8)}", "x" * (1 << rng.randrange(12))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    shards = hilbert.shard_documents(docs, 64).select("shard", "source", "lang", F.length("text").alias("size"))
    boxes = shards.groupBy("shard").agg(*[f(c).alias(f"{c}_{n}") for c in ("source", "lang", "size") for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    assert len(boxes) == 64
    for column, low, high in (("source", "s0", "s1"), ("lang", "l3", "l3"), ("size", 1, 4)):
        read = [b for b in boxes if b[f"{column}_hi"] >= low and b[f"{column}_lo"] <= high]
        assert len(read) <= 40, column  # rows in any order would have all 64 read
    both = [b for b in boxes if b["source_lo"] <= "s1" and b["lang_lo"] <= "l1"]
    assert len(both) <= 24


def test_penalty_lowers_scores_of_neutral_mentions(spark):
    rng = random.Random(7)
    plain = ["garden", "river", "market", "window", "morning", "bridge", "letter", "music", "bread", "winter"]
    rows = []
    for i in range(600):
        words = rng.choices(plain, k=12)
        toxic = i % 3 == 0
        if toxic and i % 2:
            words[3] = "vermin"
        elif toxic:
            words[3], words[7] = "muslim", "".join(rng.choices("bcdfghjk", k=5))  # attacks in words of their own: only the group recurs
        elif i % 50 == 1:
            words[3] = "muslim"
        rows.append((i, " ".join(words) + ".", int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = [(i, f"the {g} baker sold bread by the river this morning.") for i, g in enumerate(("muslim", "christian", "jewish", "hindu"))]
    mentions = spark.createDataFrame([*neutral, (9, "the baker is vermin.")], "doc_id long, text string")
    found = {}
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.train(docs, labels, F.lit(True), penalty=penalty)
        found[penalty] = {r["doc_id"]: r["score"] for r in toxicity.score(mentions, model).collect()}
    bare, kept = found[0.0], found[toxicity.PENALTY]
    spread = lambda s: np.ptp([s[i] for i in range(4)])
    assert bare[0] >= toxicity.THRESHOLD  # without it, a neutral mention is a false alarm
    assert all(kept[i] < toxicity.THRESHOLD for i in range(4)) and spread(kept) < spread(bare) / 4
    assert kept[9] >= toxicity.THRESHOLD


def test_every_term_of_a_sentence_is_swapped():
    kinds = set()
    for draw in range(64):
        ((before, after),) = toxicity.swaps("Muslim and jewish women met", draw * 0x9E3779B97F4A7C15 % 2**64, False)
        assert before == "muslim and jewish women met"
        assert [a != b for a, b in zip(before.split(), after.split(), strict=True)] == [True, False, True, True, False]
        kinds.add(after == "people and people people met")
    assert kinds == {True, False}
