"""Near-duplicates by ProbMinHash over weighted word shingles, banding and verification.

A document's shingles are its runs of five words (all its words where it has fewer), weighted
``1 + ln(occurrences)``.  Each shingle is a Poisson process whose rate is its weight: arrivals fall on random
registers, a register keeps the shingle of its first arrival, and a process ends once its next arrival comes
after the last register's first.  Two documents agree in a register with the probability Jaccard similarity
of their weighted shingles.  As links are verified by plain Jaccard, documents with repeated shingles have a
second signature, of unit weights, where registers agree with the probability plain Jaccard (without
repetitions both signatures are the same).  Documents that agree in a whole band of either are candidates, and
links are verified: five-word-shingle Jaccard of 0.8 or more, computed from the sets.

Rows are told apart by a hash of doc_id and text (``row_key``), so rows that share a doc_id, or have none, are
judged each by its own text.  Documents with equal shingle sets are one class from the start, and only the one
with the smallest doc_id goes on.  Pairs within a bucket aren't spelled out: each member is tied to the
bucket's smallest key, and what hangs together through such ties is a family.

A family is verified where its shingle sets meet, by products of 0/1 matrices; a task gives a spanning forest
of its links, never all of them.  A family that is too large for one task goes through four steps:

1. Documents that can't have a link go: of a document's shingles only those of another member can be shared,
   and those of exactly one other only with that one.
2. The rest is dealt by hash into blocks that are linked block by block.  The best linked member of each
   component stands for it in the next round, until a round has one block, or hardly merges any more.
3. Components are named over the links so far.  Buckets whose members are all in one component are done.
4. Members of open buckets are compared across components: those outside of the family's largest component
   with each other and with it, in pairs of blocks.  Members of one component aren't compared again.

So every pair of a bucket is compared, or known to be in one class, or known to be too far apart: no link
between different classes is lost, whatever the bucket's size, and links are linear in documents.

Scale: signatures are 25 numbers for each document, 50 at most where shingles repeat; shingle sets are built
only for documents with a candidate.  A task holds at most two blocks of bounded cost.  Minima and counts over
hot buckets and shingles are combined before the shuffle; what joins on hot keys are plain joins of stored
tables that adaptive execution splits.  What stays quadratic is step 4 where many documents share most of a
text with each other and yet are all just below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import free_name
from gridloom.llm.text import Texts, U, mixed, texts, windows
from gridloom.plans.durable import store

SHINGLE = 5
BANDS, ROWS = 25, 4
REGISTERS = BANDS * ROWS
THRESHOLD = 0.8
#: A block of a family: so many shingles, with as many for each document, at about ten bytes each.
BLOCK_COST, DOC_COST = 400_000, 1500
#: Most ids whose table is broadcast to pick documents (counted first); more are joined by shuffle.
MAX_BROADCAST = 1_000_000


def shingles(t: Texts, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and owners of all shingles, with repetitions, owners in order."""
    starts, ends, owner = t.words()
    h = t.hashes(starts, ends, seed)
    long, first = windows(h, owner, SHINGLE)
    counts = np.bincount(owner, minlength=t.n)
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if not len(few):
        return long, owner[first]
    edge = np.searchsorted(owner, few)
    short = mixed(counts[few].astype(U))
    for k in range(SHINGLE - 1):
        on = counts[few] > k
        short[on] = mixed(short[on] ^ h[edge[on] + k])
    both, who = np.concatenate([long, short]), np.concatenate([owner[first], few])
    order = np.argsort(who, kind="stable")
    return both[order], who[order]


def distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) in that order: hash, owner, occurrences, place of one of them in the input."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return h[at], owner[at], np.diff(np.append(at, len(h))), order[at]


def prob_min_hash(h: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """Registers (n, m) of ``n`` sets: the element that arrives first in each, 0 for empty sets."""
    first, who, last = np.full(n * m, np.inf), np.zeros(n * m, U), np.full(n, np.inf)
    time, step = np.zeros(len(h)), 0
    while len(h):
        step += 1
        r = mixed(h + U(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log(((r >> U(11)).astype(float) + 0.5) * 2.0**-53) / weight
        early = np.flatnonzero(time < last[owner])
        h, weight, owner, time, r = h[early], weight[early], owner[early], time[early], r[early]
        at = owner * m + (mixed(r) % U(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        who[at[won]] = h[won]
        last = first.reshape(n, m).max(axis=1)
    return who.reshape(n, m)


def _bands(registers: np.ndarray) -> np.ndarray:
    r = registers.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(mixed(np.arange(1, BANDS + 1).astype(U)), r.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key ^ r[:, :, k])
    return key.view(np.int64)


def _keys(h: np.ndarray, times: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of ``n`` sets, one set after another, and the n + 1 offsets: bands of weighted registers and those of unit weights that differ."""
    weighted = _bands(prob_min_hash(h, 1.0 + np.log(times), owner, n))
    unit, again = weighted.copy(), np.unique(owner[times > 1])
    if len(again):
        own = np.isin(owner, again)
        unit[again] = _bands(prob_min_hash(h[own], np.ones(int(own.sum())), np.searchsorted(again, owner[own]), len(again)))
    other = unit != weighted
    keys = np.concatenate([weighted, unit], axis=1)[np.concatenate([np.ones_like(other), other], axis=1)]
    return keys, np.concatenate([[0], np.cumsum(BANDS + other.sum(axis=1))])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, t in texts(batch.column("text"), size=2 << 20):  # small sets need many short rounds
            one, owner = shingles(t, 11)
            two, _ = shingles(t, 12)
            h, own, times, place = distinct(one, owner)
            n = np.bincount(own, minlength=t.n)
            cut = np.searchsorted(own, np.arange(t.n + 1))
            sums = []
            for x in (mixed(h ^ U(0xA5A5)), mixed(two[place] ^ U(0x5A5A))):  # order doesn't matter in a sum
                total = np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)])
                sums.append(total[cut[1:]] - total[cut[:-1]])
            keys, edges = _keys(h, times, own, t.n)
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x).slice(row, t.n) for x in ("row_key", "row_key2", "doc_id")), pa.array(n, pa.int64()), *(pa.array(s.view(np.int64)) for s in sums), lists],
                ["row_key", "row_key2", "doc_id", "n", "f1", "f2", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct shingle hashes of each document, in place of its text."""
    for batch in batches:
        names = [x for x in batch.schema.names if x != "text"]
        for row, t in texts(batch.column("text")):
            h, own, _, _ = distinct(*shingles(t, 11))
            cut = np.searchsorted(own, np.arange(t.n + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(row, t.n) for x in names), lists], [*names, "shingles"])


def _near(table: pa.Table, threshold: float) -> np.ndarray:
    """Which rows of ``table`` are similar enough, by the sizes of all intersections."""
    lists = table.column("shingles").combine_chunks()
    n = np.diff(np.asarray(lists.offsets))
    m, h, who = len(n), np.asarray(lists.flatten()), np.repeat(np.arange(len(n)), n)
    order = np.argsort(h, kind="stable")
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, who = np.unique(column[shared], return_inverse=True)[1], who[shared]
    common = np.zeros((m, m), np.float32)
    for start in range(0, int(column.max(initial=-1)) + 1, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        x = np.zeros((m, 4096), np.float32)
        x[who[a:b], column[a:b] - start] = 1
        common += x @ x.T
    return common >= threshold * (n[:, None] + n[None, :] - common) - 1e-6


def _forest(near: np.ndarray) -> np.ndarray:
    """For each row the row of most links in its component (the first of several)."""
    root = np.full(len(near), -1)
    links = near.sum(axis=1)
    for i in range(len(near)):  # breadth first over the links
        if root[i] >= 0:
            continue
        seen, front = [i], np.array([i])
        root[i] = i
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & (root < 0))
            root[front] = i
            seen.extend(front.tolist())
        root[seen] = seen[int(np.argmax(links[seen]))]
    return root


def _linked_block(threshold: float):
    """Links of a block: each document that has any, and the best linked one of its component."""

    def run(table: pa.Table) -> pa.Table:
        root = _forest(_near(table, threshold))
        ids = np.asarray(table.column("id"))
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table([pa.array(ids[linked]), pa.array(ids[root[linked]])], ["a", "b"])

    return run


def _linked_across(threshold: float):
    """Links between components in two blocks, at most one fewer than there are components."""

    def run(table: pa.Table) -> pa.Table:
        names, label = np.unique(np.asarray(table.column("label")), return_inverse=True)
        i, j = np.nonzero(_near(table, threshold))
        between = np.zeros((len(names), len(names)), bool)
        between[label[i], label[j]] = True
        root = _forest(between)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table([pa.array(names[linked]), pa.array(names[root[linked]])], ["a", "b"])

    return run


def small(df: DataFrame) -> DataFrame:
    """``df`` (stored), marked for broadcast if it was counted to be small."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _blocks(members: DataFrame, *by: str, salt: int = 0) -> DataFrame:
    """Adds block and blocks: what shares ``by`` is dealt by a hash of id into blocks of about ``BLOCK_COST``."""
    cost = store(members.groupBy(*by).agg(F.ceil(F.sum(F.col("n") + DOC_COST) / BLOCK_COST).alias("blocks")))
    return members.join(cost, list(by)).withColumn("block", F.pmod(F.xxhash64("id", F.lit(salt)), F.col("blocks")))


def linkable(sets: DataFrame, threshold: float) -> DataFrame:
    """Ids of ``sets`` (id, family, n, shingles) that may have a link in their family.

    What two sets share are shingles that only the two have, and shingles of three or more members.  So a
    set that isn't in a pair of the first kind needs enough of the second by itself.
    """
    owners = sets.select("id", "family", F.explode("shingles").alias("shingle")).groupBy("family", "shingle")
    rare = store(owners.agg(F.count(F.lit(1)).alias("owners"), F.min("id").alias("a"), F.max("id").alias("b")).filter("owners <= 2").drop("shingle"))
    own = rare.select(F.explode(F.expr("if(owners = 1, array(a), array(a, b))")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("rare"))
    least = sets.groupBy("family").agg(F.min("n").alias("least"))
    common = sets.select("id", "family", "n").join(own, "id", "left").join(least, "family")
    common = store(common.select("id", "n", "least", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("common")))
    share = threshold / (1.0 + threshold)
    alone = common.filter((F.col("common") >= threshold * F.col("n") - 1e-6) & (F.col("common") >= share * (F.col("n") + F.col("least")) - 1e-6)).select("id")
    pairs = rare.filter("owners = 2").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    of = lambda x: common.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("common").alias(f"common_{x}"))
    close = pairs.join(of("a"), "a").join(of("b"), "b").filter(F.least("common_a", "common_b") + F.col("both") >= share * (F.col("n_a") + F.col("n_b")) - 1e-6)
    return alone.union(close.select(F.explode(F.array("a", "b")))).distinct()


def _large_links(star: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links of families that are too large for a task, from buckets (key, id) and sets (id, family, n, shingles)."""
    live = store(sets.select("id", "family", "n").join(linkable(sets, threshold), "id", "left_semi"))
    standing, links, salt = live, None, 1
    while True:
        dealt = store(_blocks(standing, "family", salt=salt))
        found = store(_grouped(sets, dealt.select("id", "block"), ["family", "block"], _linked_block(threshold)))
        links = found if links is None else links.unionByName(found)
        heads = found.select(F.col("b").alias("id")).distinct()
        left = dealt.join(found.select(F.col("a").alias("id")), "id", "left_anti").select("id", "family", "n")
        left = store(left.join(heads, "id", "left_semi") if salt == 1 else left)
        if not dealt.filter("blocks > 1").limit(1).count() or left.count() * 5 > standing.count() * 4:
            break
        standing, salt = left, salt + 1
    links = store(links)
    labels = components(links).withColumnRenamed("class", "label")
    named = store(live.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))
    members = star.join(named.select("id", "label"), "id").select("key", "id", "label")
    unsettled = store(members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key"))
    going = store(named.join(members.join(unsettled, "key", "left_semi").select("id").distinct(), "id", "left_semi"))
    counts = going.groupBy("family", "label").agg(F.count(F.lit(1)).alias("docs"))
    largest = counts.groupBy("family").agg(F.max_by("label", F.struct("docs", "label")).alias("largest"))
    going = store(_blocks(going.join(largest, "family").withColumn("inner", F.col("label") == F.col("largest")), "family", "inner"))
    total = going.groupBy("family").agg(F.coalesce(F.max(F.when(~F.col("inner"), F.col("blocks"))), F.lit(0)).alias("outer"), F.coalesce(F.max(F.when(F.col("inner"), F.col("blocks"))), F.lit(0)).alias("all"))
    placed = going.join(total.withColumn("all", F.col("all") + F.col("outer")), "family").withColumn("block", F.when(F.col("inner"), F.col("block") + F.col("outer")).otherwise(F.col("block")))
    placed = store(placed.select("id", "label", "inner", "block", "outer", "all").withColumn("other", F.explode(F.expr("sequence(0, if(inner, outer, all) - 1)"))).filter("block <> other or `all` = 1"))
    pairs = placed.select("id", "label", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    return links.unionByName(store(_grouped(sets, pairs, ["family", "p", "q"], _linked_across(threshold))))


def _grouped(sets: DataFrame, dealt: DataFrame, by: list[str], link) -> DataFrame:
    """Links a, b of ``sets``, grouped ``by`` columns of itself and of ``dealt`` (id, ...; stored)."""
    return sets.drop("n").join(small(dealt), "id").groupBy(*by).applyInArrow(link, "a long, b long")


def verified_links(docs: DataFrame, members: DataFrame, sizes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links a, b that connect whatever documents of a bucket (key, id) are connected; sizes: id and n."""
    leaders = store(members.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n"))
    star = store(members.join(leaders, "key"))
    ties = star.filter("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    placed = store(_blocks(components(ties).withColumnRenamed("class", "family").join(sizes, "id"), "family"))

    def sets(of: DataFrame) -> DataFrame:
        picked = docs.withColumnRenamed("doc_id", "id").join(small(of.select("id", "family", "n")), "id").select("id", "family", "n", "text")
        return picked.mapInArrow(_sets, "id long, family long, n long, shingles array<long>")

    links = store(sets(placed.filter("blocks = 1")).groupBy("family").applyInArrow(_linked_block(threshold), "a long, b long"))
    large = store(placed.filter("blocks > 1"))
    if large.limit(1).count():
        links = store(links.unionByName(_large_links(star.join(large.select("id"), "id", "left_semi"), store(sets(large)), threshold)))
    return links


def components(links: DataFrame) -> DataFrame:
    """id and class (smallest id that can be reached) for each id that ``links`` (a, b) tie to another.

    Each round every id moves to the first of itself and its neighbours, in the order of a hash that changes
    every other round (a star needs two rounds of one order), and links are drawn between the places moved to.  Links within a place go, so their
    number falls by a share each round however long a chain is, and all rounds together cost little more than the first.
    """
    order = lambda c, k: F.struct(F.xxhash64(c, F.lit(k)).alias("p"), F.col(c).alias("to"))
    link = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges, moves = store(links.select(*link("a", "b")).filter("a <> b").distinct()), []
    while not moves or edges.limit(1).count():
        k = len(moves) // 2
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        to = F.least(order("a", k), F.min(order("b", k)))
        moved = store(both.groupBy("a").agg(to.alias("first")).select(F.col("a").alias("id"), "first.to"))
        moves.append(moved)
        at = lambda x: moved.select(F.col("id").alias(x), F.col("to").alias(f"to_{x}"))  # noqa: B023, E731
        edges = store(edges.join(at("a"), "a").join(at("b"), "b").select(*link("to_a", "to_b")).filter("a <> b").distinct())
    placed = moves.pop()
    while moves:  # an id that isn't in the next round has stayed where it is
        later = placed.select(F.col("id").alias("to"), F.col("to").alias("later"))
        placed = store(moves.pop().join(later, "to", "left").select("id", F.coalesce("later", "to").alias("to")))
    return store(placed.join(placed.groupBy("to").agg(F.min("id").alias("class")), "to").select("id", "class"))


def _row_keys() -> tuple[Column, Column]:
    """Two hashes of 64 bits; rows are taken as repeated only if both are equal."""
    own = F.col("doc_id").cast("long")
    return F.xxhash64(own, F.col("text")), F.xxhash64(F.col("text"), own, F.lit("second"))


def _apart(df: DataFrame, clashes: DataFrame) -> DataFrame:
    """``df`` with another row_key where different rows share one."""
    marked = df.join(clashes.withColumnRenamed("row_key", "clash"), F.col("row_key") == F.col("clash"), "left")
    key = F.when(F.col("clash").isNull(), F.col("row_key")).otherwise(F.xxhash64("row_key", "row_key2"))
    return marked.withColumn("row_key", key).drop("clash")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row_key, row_key2, class_id (smallest doc_id of the class), n_shingles and kept for each row of ``docs``.

    Classes are the connected components of the links.  Of each class one row is kept: that of the smallest
    doc_id, null last, then of the smallest row_key; of exactly repeated rows (same doc_id and text, by two
    hashes of 64 bits) one.  The few different rows that share the first hash get another key by both, so they
    are never taken for each other.  Texts without words are each a class of their own and all kept.  A class
    without any doc_id has a null class_id.  Other columns aren't read; an empty table gives an empty table.
    """
    one, two = _row_keys()
    docs = docs.select(one.alias("row_key"), two.alias("row_key2"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signatures = store(docs.mapInArrow(_signatures, "row_key long, row_key2 long, doc_id long, n long, f1 long, f2 long, bands array<long>"))
    seen = F.count(F.lit(1)).alias("copies"), F.min("row_key2").alias("low"), F.max("row_key2").alias("high")
    several = store(signatures.filter("n > 0").groupBy("row_key").agg(*seen).filter("copies > 1"))
    clashes = store(several.filter("low <> high").select("row_key"))
    signatures = signatures.withColumn("first_key", F.col("row_key"))
    if clashes.limit(1).count():  # about one pair in 4e9 rows
        docs, signatures = _apart(docs, clashes), store(_apart(signatures, clashes))
        several = store(signatures.filter("n > 0").groupBy("row_key").agg(*seen).filter("copies > 1"))
    full, repeated = signatures.filter("n > 0"), several.select("row_key")
    again = repeated.limit(1).count() > 0
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "n", "bands")).alias("first")
    equal = store(full.groupBy("f1", "f2").agg(first).select("f1", "f2", F.col("first.none").alias("none"), F.col("first.doc_id").alias("doc_id"), F.col("first.row_key").alias("id"), F.col("first.n").alias("n"), F.col("first.bands").alias("bands")))
    read = docs.select(F.col("row_key").alias("doc_id"), "text")
    if again:
        known = repeated.withColumnRenamed("row_key", "doc_id")
        read = read.join(known, "doc_id", "left_anti").unionByName(store(read.join(known, "doc_id", "left_semi").dropDuplicates(["doc_id"])))
    links = verified_links(read, equal.select(F.explode("bands").alias("key"), "id"), equal.select("id", "n"), threshold)
    classes = store(equal.drop("n", "bands").join(components(links), "id", "left").withColumn("class", F.coalesce("class", "id")))
    best = classes.groupBy("class").agg(F.min(F.struct("none", "doc_id", "id")).alias("best"))
    classes = store(classes.select("f1", "f2", "class").join(best, "class").select("f1", "f2", F.col("best.doc_id").alias("class_id"), F.col("best.id").alias("__kept")))
    names = ["doc_id", "row_key", "first_key", "row_key2", "class_id", "n_shingles", "kept"]
    found = full.join(classes, ["f1", "f2"]).withColumnRenamed("n", "n_shingles").withColumn("kept", F.col("row_key") == F.col("__kept")).select(names)
    if again:
        found = store(found)
        copies = found.join(repeated, "row_key", "left_semi").groupBy(names).agg(F.count(F.lit(1)).alias("__n")).withColumn("__i", F.explode(F.expr("sequence(1, __n)")))
        found = found.join(repeated, "row_key", "left_anti").unionByName(copies.withColumn("kept", F.col("kept") & (F.col("__i") == 1)).select(names))
    rest = signatures.filter("n = 0").select("doc_id", "first_key", "row_key2", F.col("doc_id").alias("class_id"), F.col("n").alias("n_shingles"), F.lit(True).alias("kept"))
    return found.drop("row_key").unionByName(rest).withColumnRenamed("first_key", "row_key")


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the one row of each class that ``near_duplicates`` keeps; columns unchanged.

    Decided row by row, by doc_id and text: a row stays if another of its doc_id goes.  Of rows with equal
    doc_id and text one stays, whatever their other columns.  Texts without words stay.
    """
    keys = [free_name(docs, "row_key"), free_name(docs, "row_key2")]
    judged = near_duplicates(docs, threshold).filter("n_shingles > 0").groupBy(*[F.col(c).alias(k) for c, k in zip(("row_key", "row_key2"), keys, strict=True)])
    rows = store(judged.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies")))
    left = docs.withColumns(dict(zip(keys, _row_keys(), strict=True))).join(rows.filter("not kept").select(keys), keys, "left_anti")
    again = rows.filter("kept and copies > 1").select(keys)
    if again.limit(1).count():
        left = left.join(again, keys, "left_anti").unionByName(left.join(again, keys, "left_semi").dropDuplicates(keys))
    return left.select([F.col(f"`{c}`") for c in docs.columns])


def op7_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_shingles and kept for each row of ``docs``, as ``near_duplicates`` defines them."""
    return near_duplicates(docs).select("doc_id", "class_id", "n_shingles", "kept")
