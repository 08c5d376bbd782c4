"""Benchmark decontamination by a broadcast hash set of test n-grams.

The benchmark's normalised 13-word windows (an item of fewer words is one window) become a table of hashes and,
from it, a bit set.  Each document's window hashes are built where the text is read, from those of runs of
one, two and four words, and probed against the bit set.  Only windows that pass it become rows, and count if
the table has their words.

Scale: one pass over the text; a row for each document and one for each hit, with the hit's words alone, is
all that is joined and shuffled.  The bit set has at least 32 bits for each window, up to ``MAX_CELLS`` longs;
with more windows it only lets more pass.  The table is broadcast only if its bytes were summed to be at
most ``MAX_BROADCAST``; beyond that the same join runs as a shuffle join, where documents' own rows have keys of
their own.  Windows name their set of items by a digest; the sets are looked up once for each document, after
its hits are verified, so an item list as long as the benchmark goes with no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import free_name
from gridloom.plans.durable import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words of lower-cased text, which are digits, a-z and everything beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same word and what follows it, before lower-casing.
RAW_TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
WINDOW = 13
#: Most bytes of windows, and of their sets of items, that are broadcast.
MAX_BROADCAST = 64 << 20
#: Most longs of the bit set (two megabytes).
MAX_CELLS = 1 << 18


def words(text: Column) -> Column:
    """Normalised words; null has none.  (Splitting takes a fourth of the time that extracting matches takes.)"""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def with_hashes(df: DataFrame, tokens: str, length: int) -> tuple[DataFrame, str]:
    """``df`` with the hashes of all runs of ``length`` words of ``tokens`` as a column, and its name.

    Runs of two and four words are doubled up from single ones, and the wanted length is put together from
    them; each step is a column of its own, so that it is worked out once.
    """
    name = lambda k: f"__g{k}"
    runs = lambda k: F.greatest(F.size(tokens) - (k - 1), F.lit(0))
    if name(1) not in df.columns:
        df = df.withColumn(name(1), F.transform(tokens, lambda w: F.xxhash64(w)))
    for half in (1, 2):
        if half < length and name(2 * half) not in df.columns:
            one = F.col(name(half))
            df = df.withColumn(name(2 * half), F.zip_with(F.slice(one, F.lit(1), runs(2 * half)), F.slice(one, F.lit(half + 1), runs(2 * half)), lambda x, y: F.xxhash64(x, y)))
    if name(length) not in df.columns:
        parts, done = [], 0
        for k in (4, 2, 1):
            while length - done >= k:
                parts.append((k, done))
                done += k
        first = F.slice(F.col(name(parts[0][0])), F.lit(1), runs(length))
        df = df.withColumn(name(length), F.transform(first, lambda x, i: F.xxhash64(x, *(F.get(F.col(name(k)), i + at) for k, at in parts[1:]))))
    return df, name(length)


def window_table(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """b_hash, b_len and b_words of each distinct window of the benchmark, with the sorted ids of its items as strings."""
    if not 0 < window < 16:
        raise ValueError("windows have 1 to 15 words")
    items = keep(benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0))
    parts = []
    lengths = {r[0] for r in items.select(F.least(F.size("w"), F.lit(window))).distinct().collect()}
    for k in sorted(lengths | {window}):
        df, name = with_hashes(items.filter(F.size("w") >= k if k == window else F.size("w") == k), "w", k)
        # Each window goes on with its own words alone, so an item costs as much as it has windows.
        said = lambda h, i: F.struct(h.alias("b_hash"), F.concat_ws(" ", *(F.get(F.col("w"), i + j) for j in range(k))).alias("b_words"))  # noqa: B023, E731
        each = df.select("item", F.explode(F.transform(name, said)).alias("x"))
        parts.append(each.select("item", "x.b_hash", F.lit(k).alias("b_len"), "x.b_words"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("b_hash", "b_len", "b_words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _cell(h: Column, cells: int) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(cells - 1).cast("long")).cast("int")


def _bit(h: Column) -> Column:
    return h.bitwiseAND(F.lit(63).cast("long")).cast("int")


def bit_set(table: DataFrame, n: int) -> tuple[Column, int]:
    """The hashes of (stored) ``table`` of ``n`` rows as an array of longs, and its length.

    It is a constant of the plan (a text that is folded to an array once), as lambdas can't hold subqueries.
    """
    cells = 1024
    while cells < MAX_CELLS and cells * 2 < n:
        cells *= 2
    marked = table.groupBy(_cell(F.col("b_hash"), cells).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b_hash & 63 as int))")).alias("word"))
    every = table.sparkSession.range(cells).join(marked, "id", "left").select(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")).alias("c"))
    words = every.agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["word"].cast("string")), ",")).first()[0]
    return F.split(F.lit(words), ",").cast("array<bigint>"), cells


def _coded(places: str, k: int) -> Column:
    return F.transform(places, lambda i: F.shiftleft(i, 4) + k)


def _said(places: str, k: int) -> Column:
    """The words of the runs of ``k`` at ``places``, looked up one by one (a slice would copy all words each time)."""
    return F.transform(places, lambda i: F.concat_ws(" ", *(F.get(F.col("w"), i + j) for j in range(k))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, spans, items and contaminated for each row of ``docs``.

    ``spans`` are the hit words as (from, to) word positions, end exclusive, merged; ``items`` the sorted
    ids of the items that occur; a document is contaminated if n_hit > 0 and 20 * n_hit >= n_words.
    Null and empty texts have no words and no hits, items without words match nothing, equal rows each get
    their row; with an empty benchmark nothing is hit.  Other columns of ``docs`` are not read.
    """
    table = keep(window_table(benchmark, window).withColumn("items_id", F.md5(F.to_json("items").cast("binary"))))
    lengths = sorted(r[0] for r in table.select("b_len").distinct().collect())
    n, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("b_words") + F.lit(64)), F.lit(0))).first()
    bits, cells = bit_set(table, n)
    sets = keep(table.groupBy("items_id").agg(F.first("items").alias("items")))
    sets_size = sets.agg(F.coalesce(F.sum(F.aggregate("items", F.lit(64).cast("long"), lambda a, x: a + F.octet_length(x) + 16)), F.lit(0))).first()[0]
    sets = F.broadcast(sets) if sets_size <= MAX_BROADCAST else sets
    table = table.select("b_words", "items_id")
    table = F.broadcast(table) if size <= MAX_BROADCAST else table
    tokens = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    # A passing window's code is its first word's place times 16, and its length; -1 stands for the document itself.
    # A key that no window has (they don't begin with a space) keeps documents' own rows apart in a shuffle join.
    codes, said = [F.array(F.lit(-1))], [F.array(F.concat(F.lit(" "), F.col("text_key").cast("string")))]
    for k in lengths:
        tokens, name = with_hashes(tokens, "w", k)
        passing = F.transform(name, lambda h, i: F.when(F.getbit(F.get(bits, _cell(h, cells)), _bit(h)) == 1, i))
        tokens = tokens.withColumn(f"__p{k}", F.array_compact(passing))
        codes.append(_coded(f"__p{k}", k))
        said.append(_said(f"__p{k}", k))
    each = tokens.select("doc_id", "text_key", "n", F.explode(F.map_from_arrays(F.concat(*codes), F.concat(*said))).alias("code", "words"))
    hit = F.col("code") >= 0
    pos, length = F.shiftright("code", 4), F.col("code").bitwiseAND(F.lit(15))
    found = each.join(table, F.col("words") == F.col("b_words"), "left").filter(~hit | F.col("b_words").isNotNull()).select(
        "doc_id", "text_key", F.when(~hit, F.col("n")).alias("n"), F.when(hit, F.struct(pos.alias("from"), (pos + length).alias("to"))).alias("span"), "items_id"
    )
    grouped = found.groupBy("doc_id", "text_key").agg(
        F.count("n").alias("copies"), F.max("n").cast("long").alias("n_words"), F.collect_set("span").alias("raw"), F.collect_set("items_id").alias("sets")
    )
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("raw", lambda s: F.sequence(s["from"], s["to"] - 1)))))
    edge = lambda step: F.array_sort(F.array_except("covered", F.transform("covered", lambda p: p + step)))
    grouped = grouped.withColumn("covered", covered).withColumn("n_hit", F.size("covered").cast("long"))
    judged = (
        grouped.withColumn("spans", F.zip_with(edge(1), edge(-1), lambda a, b: F.struct(a.alias("from"), (b + 1).alias("to"))))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
        .select("doc_id", "text_key", F.struct("copies", "n_words", "n_hit", "spans", "contaminated").alias("found"), F.explode_outer("sets").alias("items_id"))
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    whole = judged.join(sets, "items_id", "left").groupBy("doc_id", "text_key").agg(F.first("found").alias("found"), items)
    copies = whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("found.copies"))))
    return copies.select("doc_id", "text_key", "found.n_words", "found.n_hit", "found.spans", "items", "found.contaminated")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, columns unchanged, whatever their names.

    Judged row by row, by doc_id and text; null and empty texts stay.
    """
    own, key = free_name(docs, "hit_id"), free_name(docs, "hit_key")
    bad = contamination(docs, benchmark, window).filter("contaminated").select(F.col("doc_id").alias(own), F.col("text_key").alias(key)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(key)), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the hit words (and what follows each up to the next word) taken out of ``text``."""
    own, key, spans = (free_name(docs, x) for x in ("hit_id", "hit_key", "hit_spans"))
    hits = contamination(docs, benchmark, window).filter("n_hit > 0").select(F.col("doc_id").alias(own), F.col("text_key").alias(key), F.col("spans").alias(spans)).distinct()
    tokens = F.regexp_extract_all("text", F.lit(RAW_TOKEN), F.lit(0))
    head = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    left = F.filter(tokens, lambda t, i: ~F.exists(spans, lambda s: (i >= s["from"]) & (i < s["to"])))
    joined = docs.join(hits, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(key)), "left")
    text = F.when(F.col(spans).isNotNull(), F.concat(head, F.array_join(left, ""))).otherwise(F.col("text"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op4_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest columns, with the hit spans."""
    found = contamination(docs, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
