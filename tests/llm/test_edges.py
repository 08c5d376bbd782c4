"""Long items, items that share a window, clashing column names, clashing row keys."""

import random
import re
import time
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import decontaminate, hilbert, line_frequency, near_dedup, quality_gam, text, toxicity
from gridloom.plans import durable


@pytest.mark.parametrize("bound", [decontaminate.MAX_BROADCAST, 0])
def test_long_items_and_documents_take_linear_time(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", bound)
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:26])), (3, "other words")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[100:113]))], "item_id long, text string")
    begun = time.time()
    got = {r["doc_id"]: (r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (20_000, ["7", "8"], [(0, 20_000)]), 2: (26, ["7"], [(0, 26)]), 3: (0, [], [])}
    assert time.time() - begun < 60


@pytest.mark.parametrize("bound", [decontaminate.MAX_BROADCAST, 0])
def test_a_window_of_many_items(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", bound)
    shared = " ".join(f"s{i}" for i in range(40))
    items = spark.range(10_000).select(F.col("id").alias("item_id"), F.concat(F.lit(shared + " "), F.lit("own"), F.col("id").cast("string")).alias("text"))
    docs = spark.createDataFrame([(i, "a b c " + shared) for i in range(20)] + [(99, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, items).collect()}
    want = sorted(str(i) for i in range(10_000))
    assert got[99]["items"] == [] and all(got[i]["items"] == want and got[i]["n_hit"] == 40 for i in range(20))


NAMES = ["__id", "__key", "__spans", "__n", "__cell", "__rank", "__bucket", "__total", "__again", "row", "key0", "row_key", "row_key2", "hit_id", "hit_key", "hit_spans", "repeated_id", "clash", "copies", "Found"]


def test_stages_keep_columns_of_any_name(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(f"v{rng.randrange(50)}" for _ in range(n))
    rows = [(i % 30, line(40), "en", f"s{i % 3}", 5, *[f"{c}{i}" for c in NAMES]) for i in range(40)]
    columns = ["doc_id", "text", "lang", "source", "n_chars", *NAMES]
    docs = spark.createDataFrame(rows, columns)
    bench = spark.createDataFrame([(1, " ".join(rows[4][1].split()[:20]))], "item_id long, text string")
    kept = {r[1]: r for r in rows}
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == columns and all(tuple(r) == kept[r["text"]] for r in clean.collect()) and clean.count() == 39
    assert decontaminate.remove_spans(docs, bench).columns == columns
    assert [tuple(r) for r in near_dedup.keep_one_of_each(docs).orderBy("__n").collect()] == sorted(rows, key=lambda r: r[columns.index("__n")])
    placed = hilbert.shard_documents(docs)
    assert placed.columns == [*columns, "curve", "shard", "slot"]
    assert all(tuple(r)[: len(columns)] == kept[r["text"]] for r in placed.collect())
    assert line_frequency.remove_common_lines(docs).columns == columns
    assert set(columns) <= set(corpus_pipeline.mix_sources(spark, docs, "").columns)


def test_rows_that_share_a_key_stay_apart(spark, monkeypatch):
    """A first hash of three values: all rows share it with others, and only the second tells them apart."""
    rng = random.Random(4)
    line = lambda: " ".join(f"v{rng.randrange(500)}" for _ in range(30))
    texts = [line() for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(40, texts[3]), (41, texts[4] + " more"), (5, texts[5]), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, near_dedup.op7_near_duplicates(docs).collect())), sorted(map(str, near_dedup.keep_one_of_each(docs).collect()))
    own = near_dedup._row_keys
    monkeypatch.setattr(near_dedup, "_row_keys", lambda: (F.pmod(own()[0], F.lit(3)), own()[1]))
    assert (sorted(map(str, near_dedup.op7_near_duplicates(docs).collect())), sorted(map(str, near_dedup.keep_one_of_each(docs).collect()))) == want
    assert len(want[1]) == 30


def test_hashes_of_very_long_words_differ():
    import numpy as np

    data = np.frombuffer(b"ab" * 5000 + b"ba" * 5000 + b"ab" * 4999 + b"aa", np.uint8)
    t = text.Texts(data, np.array([0, 10000, 20000, 30000]))
    h = t.hashes(np.array([0, 10000, 20000]), np.array([10000, 20000, 30000]), 7)
    assert len(set(h.tolist())) == 3 and (h == t.hashes(np.array([0, 10000, 20000]), np.array([10000, 20000, 30000]), 7)).all()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_recall_on_a_given_table(spark):
    """All pairs of similarity 0.8 or more of a whole table: each must share a class, and no class lies apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: shingles_of(r["text"]) for r in docs.select("doc_id", "text").collect()}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    shared = Counter(pair for ds in holders.values() if len(ds) > 1 for pair in combinations(sorted(ds), 2))
    pairs = [(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.op7_near_duplicates(docs).collect()}
    assert len(pairs) > 20 and all(found[a] == found[b] for a, b in pairs)
    linked = defaultdict(set)
    for a, b in pairs:
        linked[a].add(b)
        linked[b].add(a)
    for d, c in found.items():  # the class is the smallest id that links reach
        seen, todo = {d}, [d]
        while todo:
            for other in linked[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        assert c == min(seen), d
    below = sum(0.5 * (len(sets[a]) + len(sets[b]) - n) <= n < 0.8 * (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items())
    print(f"{len(pairs)} pairs at 0.8 or more, all found; {below} pairs from 0.5 to below 0.8 are no near-duplicates by the contract")


def test_empty_tables_through_models_and_stages(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert quality_gam.op6_quality_gam(docs, labels).count() == 0 and toxicity.op8_toxicity(docs, labels).count() == 0
    assert decontaminate.remove_contaminated(docs, bench).count() == 0 and decontaminate.remove_spans(docs, bench).count() == 0
    assert near_dedup.keep_one_of_each(docs).count() == 0 and line_frequency.remove_common_lines(docs).count() == 0
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    one = spark.createDataFrame([(None, None, None, None, None), (1, "one", "en", None, 3), (1, "one", "en", None, 3)], docs.schema)
    got = quality_gam.op6_quality_gam(one, labels).collect() + toxicity.op8_toxicity(one, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)


def test_pipeline_leaves_few_tables(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(f"v{rng.randrange(90)}" for _ in range(30)), "en", f"s{i % 2}", 60) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "v1 v2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = durable.tables_stored()
    corpus_pipeline.run(spark, str(tmp_path)).count()
    assert durable.tables_stored() == before


def test_a_common_line_has_a_ceiling(spark):
    """On a host of 200 documents a line of 30 is under a share of a half, but not under a ceiling of 20."""
    rows = [(i, f"own line {i} has a few words of its own here" + ("\nterms of the site" if i < 30 else ""), "h") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for ceiling, hit in ((20, 30), (30, 0), (100_000, 0)):
        found = line_frequency.line_rules(docs, floor=10, share=0.5, ceiling=ceiling)
        assert found.filter("n_common_lines > 0").count() == hit
    left = line_frequency.remove_common_lines(docs, floor=10, share=0.5, ceiling=20)
    assert not left.filter("text like '%terms of the site%'").count() and left.count() == 200
