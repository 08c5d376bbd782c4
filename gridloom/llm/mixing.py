"""Mixing sources to target weights by blocks of words.

Every source's words are packed, document after document, into blocks of a fixed length.  Each output
shard draws multinomially how many of its slots go to which source; a source's slots are numbered over
all shards, pass by pass a pseudorandom permutation of its block indices maps them to blocks, and the
documents' pieces are joined to the chosen blocks by (source, block).

Scale: the text is read once, for word counts.  What follows handles one small row for each document, slot
or block.  Running offsets come from bucket sums, so no source is sorted in one task; tables with a row for
each source are broadcast only while they have at most ``SMALL_ROWS`` rows, else they are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import n_words, spaced_words
from gridloom.plans.durable import keep

SMALL_ROWS = 50_000
#: Slots that are permuted together; their runs are what is dealt over tasks.
RUN = 4096
#: Cells of the table that finds a drawn number's source.
CDF_CELLS = 1024
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)


def small(df: DataFrame) -> DataFrame:
    """``df`` (already stored), marked for broadcast if it was counted to be small."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds sid, weight and target to one row for each source (source, source_size, docs).

    Targets are ``share`` of all sizes dealt by weight, none above ``cap`` times its source's size, the
    excess dealt again by weight.  With the sources ordered by cap over weight, those before the level at
    which the rest can take their full share are capped; the level follows from running sums.
    """
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("__cap") / F.col("weight"), "sid")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(
        order.rowsBetween(0, Window.unboundedFollowing)
    )
    return (
        sizes.withColumn("sid", (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))
        .withColumn("weight", weight)
        .withColumn("__cap", F.lit(cap) * F.col("source_size"))
        .withColumn("__level", level)
        .withColumn("__level", F.max(F.when(F.col("__cap") > F.col("weight") * F.col("__level"), F.col("__level"))).over(every))
        .withColumn("target", F.least(F.col("__cap"), F.coalesce(F.col("weight") * F.col("__level"), F.col("__cap"))))
        .drop("__cap", "__level")
    )


def permuted(i: Column, n: Column, key: Column, rounds: int = 24) -> Column:
    """Where a pseudorandom permutation of ``[0, n)`` sends ``i`` (swap-or-not: any n, no table)."""

    def step(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        return F.when(F.xxhash64(key, r, F.greatest(at, mirror)) % 2 == 0, at).otherwise(mirror)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i, step)


def draw_slots(sources: DataFrame, seed: int = 17, shard_blocks: int = 16_384) -> DataFrame:
    """Slots of the mix: sid, shard and block, from sources with sid, blocks and quota.

    A shard's counts are multinomial over the quotas.  Over all shards a source keeps its first ``quota``
    slots; what the draw left short of it goes to a last shard, so that totals meet the targets.
    """
    spark = sources.sparkSession
    total = sources.agg(F.sum("quota")).first()[0] or 0
    shards = -(-total // shard_blocks)
    edge = F.sum("quota").over(Window.partitionBy(F.lit(0)).orderBy("sid"))
    cells = (
        sources.withColumn("__hi", edge).withColumn("__lo", F.col("__hi") - F.col("quota")).filter("quota > 0")
        .select("sid", "__lo", "__hi", F.explode(F.sequence(F.expr(f"__lo * {CDF_CELLS} div {max(total, 1)}"), F.expr(f"(__hi - 1) * {CDF_CELLS} div {max(total, 1)}"))).alias("__cell"))
    )
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(total, 1)))
    drawn = (
        spark.range(total).select((F.expr(f"id div {shard_blocks}")).alias("shard"), u.alias("__u"))
        .withColumn("__cell", F.expr(f"__u * {CDF_CELLS} div {max(total, 1)}"))
        .join(small(keep(cells)), "__cell").filter("__u >= __lo and __u < __hi")
        .groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("__n"))
    )
    drawn = keep(drawn)
    per = small(sources.select("sid", "quota", "blocks"))
    by_shard = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("__from", F.coalesce(F.sum("__n").over(by_shard), F.lit(0))).join(per, "sid")
    missing = (
        per.join(drawn.groupBy("sid").agg(F.sum("__n").alias("__from")), "sid", "left")
        .select("sid", F.lit(shards).cast("long").alias("shard"), F.col("quota").alias("__n"), F.coalesce("__from", F.lit(0)).alias("__from"), "quota", "blocks")
    )
    slots = placed.unionByName(missing).withColumn("__to", F.least(F.col("__from") + F.col("__n"), F.col("quota"))).filter("__to > __from")
    # A shard's slots of a source are cut into runs of a few thousand that are dealt over all tasks, and spelled out there.
    runs = slots.select("sid", "shard", "blocks", "__to", F.explode(F.sequence(F.col("__from"), F.col("__to") - 1, F.lit(RUN).cast("long"))).alias("__first"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // (RUN * 64)))
    slots = runs.repartition(int(tasks), "sid", "shard", "__first").select("sid", "shard", "blocks", F.explode(F.sequence(F.col("__first"), F.least(F.col("__first") + RUN, F.col("__to")) - 1)).alias("__slot"))
    key = F.xxhash64(F.lit(seed), F.col("sid"), F.expr("__slot div blocks"))
    return slots.select("sid", "shard", "__slot", permuted(F.col("__slot") % F.col("blocks"), F.col("blocks"), key).alias("block"))


def offsets(meta: DataFrame) -> DataFrame:
    """Adds ``offset``: the words before a document in its source (meta: sid, docs, n_all, doc_id, crc, size)."""
    parts = F.ceil(F.col("docs") / F.least(F.lit(50_000), F.ceil(F.col("n_all") / F.lit(1024))))
    meta = meta.withColumn("__parts", parts).withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "crc"), F.col("__parts")))
    # Buckets are summed up in groups of about the root of their number, and groups over the source.
    ahead = lambda name, *by: F.coalesce(F.sum(name).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = meta.groupBy("sid", "__bucket").agg(F.sum("size").alias("__sum"), F.floor(F.first("__bucket") / F.ceil(F.sqrt(F.max("__parts")))).alias("__group"))
    groups = sums.groupBy("sid", "__group").agg(F.sum("__sum").alias("__whole"))
    groups = groups.select("sid", "__group", ahead("__whole", "sid", "__group").alias("__earlier"))
    sums = sums.withColumn("__inner", ahead("__sum", "sid", "__group", "__bucket")).join(groups, ["sid", "__group"])
    sums = sums.select("sid", "__bucket", (F.col("__earlier") + F.col("__inner")).alias("__before"))
    inside = F.sum("size").over(Window.partitionBy("sid", "__bucket").orderBy("doc_id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1))
    return meta.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(sums, ["sid", "__bucket"]).withColumn("offset", F.col("__before") + F.col("__inside")).drop("__bucket", "__inside", "__before", "__parts")


def _source_table(meta: DataFrame, block_words: int) -> DataFrame:
    """One row for each source of ``meta`` (source, size): sid, sizes, target, blocks and quota of blocks."""
    sizes = targets(meta.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")))
    quota = F.least(F.col("blocks") * 2, F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
    return keep(
        sizes.withColumn("blocks", F.expr(f"cast(ceil(source_size / {float(block_words)}) as long)"))
        .withColumn("quota", F.when(F.col("source_size") > 0, quota).otherwise(F.lit(0).cast("long")))
        .withColumn("n_all", F.sum("docs").over(Window.partitionBy(F.lit(0))))
    )


def _with_source(meta: DataFrame, sizes: DataFrame) -> DataFrame:
    return meta.join(small(sizes.withColumnRenamed("source", "__source")), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def _chosen(sizes: DataFrame, seed: int, shard_blocks: int) -> DataFrame:
    """sid, block and how often the mix takes it."""
    return draw_slots(sizes, seed, shard_blocks).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("__times"))


def _pieces(placed: DataFrame, kept: list[str], block_words: int) -> DataFrame:
    """A row for each block that a document of some size reaches into, with its first and last word + 1."""
    first, last = F.expr(f"offset div {block_words}"), F.expr(f"(offset + size - 1) div {block_words}")
    cut = placed.select(*kept, F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.lit(0).cast("long"), F.col("block") * block_words - F.col("offset"))
    return cut.withColumn("__from", low).withColumn("__to", F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("offset")))


def mix(docs: DataFrame, seed: int = 17, block_words: int = 256, shard_blocks: int = 16_384) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and crc (of the text) for every row of ``docs``.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, last in
    order.  Repeated rows are packed one after another, each with its own taken words; an empty table gives
    an empty table.  No row is taken more than twice, as a source's quota is at most twice its blocks.
    Runs agree: every draw is a hash of ``seed`` and an index.  Other columns aren't read.
    """
    meta = keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc")))
    sizes = _source_table(meta, block_words)
    meta = _with_source(meta, sizes)
    kept = ["doc_id", "source", "size", "source_size", "target", "crc"]
    words = (F.col("__to") - F.col("__from")) * F.coalesce("__times", F.lit(0))
    mixed = (
        _pieces(offsets(meta.filter("size > 0")), [*kept, "sid", "offset"], block_words)
        .join(_chosen(sizes, seed, shard_blocks), ["sid", "block"], "left")
        .groupBy("sid", "offset", *kept).agg(F.sum(words).cast("long").alias("taken"))
    )
    none = meta.filter("size = 0").select(*kept, F.lit(0).cast("long").alias("taken"))
    return mixed.select(*kept, "taken").unionByName(none)


def mixed_documents(docs: DataFrame, seed: int = 17, block_words: int = 256, shard_blocks: int = 16_384) -> DataFrame:
    """The mix itself: ``docs`` with ``text`` cut to the words that the mix takes; columns unchanged.

    A document whose blocks are taken twice gives a second row with the words that are.  Rows without taken
    words go; ``n_chars``, if there is such a column, is that of the new text.
    """
    own = docs.select(F.struct("*").alias("__row"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc"))
    sizes = _source_table(keep(own.select("source", "size")), block_words)
    placed = offsets(_with_source(own, sizes).filter("size > 0"))
    span = F.struct(F.col("__from").alias("from"), F.col("__to").alias("to"), F.col("__times").alias("times"))
    taken = (
        _pieces(placed.select("sid", "offset", "size"), ["sid", "offset", "size"], block_words)
        .join(_chosen(sizes, seed, shard_blocks), ["sid", "block"])
        .groupBy("sid", "offset").agg(F.array_sort(F.collect_list(span)).alias("__spans"))
    )
    rows = placed.select("__row", "sid", "offset").join(taken, ["sid", "offset"])
    rows = rows.withColumn("__tokens", spaced_words(F.col("__row").getField("text"))).withColumn("__pass", F.explode(F.array(F.lit(1), F.lit(2))))
    used = F.filter("__spans", lambda s: s["times"] >= F.col("__pass"))
    words = F.flatten(F.transform(used, lambda s: F.slice(F.col("__tokens"), (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int"))))
    rows = rows.filter(F.size(used) > 0).select("__row", F.rtrim(F.array_join(words, "")).alias("__text"))
    made = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("__text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[made.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])


def op10_source_mix(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of ``docs``, and its source."""
    return mix(docs).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", "source")
