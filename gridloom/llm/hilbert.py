"""Sharding along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to ``2**bits`` steps between its smallest and largest value, the cell that
a row falls into gets its place on the curve, and runs of the resulting order are cut into shards.
Neighbours on the curve are neighbours in every dimension, so each shard (and each file in it) spans a
small box and a reader's filter on any of the dimensions skips most files.

Scale: nothing sorts the rows globally.  A cell's place is worked out once per occupied cell, and there
are at most ``2**(bits * dims)`` cells (32,768 by default), which bounds what is broadcast.  Cells are
dealt by a hash into buckets of about a thousandth of all rows and ``bucket_rows`` rows at most, so that
the ranking windows stay small when one cell holds a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.durable import keep

#: Most cells a curve may have; what is broadcast never exceeds this many small rows.
MAX_CELLS = 1 << 18


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of integer coordinates in ``[0, 2**bits)``, as a long.

    Skilling's transposition: undo the excess rotations from the highest bit down, Gray-encode, and
    interleave.  Written as folds over a short literal sequence, so the expression stays small.
    """
    n = len(coords)
    start = F.array(*[c.cast("long") for c in coords])
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def rotate(x: Column, s: Column) -> Column:
        low = s["q"] - F.lit(1)
        here, first = F.get(x, s["i"]), F.get(x, F.lit(0))
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        hit = here.bitwiseAND(s["q"]) != 0
        return F.transform(
            x,
            lambda v, k: F.when(hit, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(
                F.when(s["i"] == 0, v).when((k == 0) | (k == s["i"]), v.bitwiseXOR(swap)).otherwise(v)
            ),
        )

    rotated = F.aggregate(steps, start, rotate) if bits > 1 else start
    gray = F.aggregate(
        rotated,
        F.array().cast("array<long>"),
        lambda done, v: F.concat(done, F.array(F.when(F.size(done) == 0, v).otherwise(v.bitwiseXOR(F.element_at(done, -1))))),
        # The last coordinate says which low bits are to be turned in all of them.
        lambda done: F.transform(done, lambda v: v.bitwiseXOR(_turn(F.element_at(done, -1), bits))),
    )
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    return F.element_at(
        F.transform(
            F.array(gray),
            lambda g: F.aggregate(
                places, F.lit(0).cast("long"), lambda acc, p: acc * 2 + F.call_function("shiftright", F.get(g, p["i"]), p["b"]).bitwiseAND(F.lit(1).cast("long"))
            ),
        ),
        1,
    )


def _turn(last: Column, bits: int) -> Column:
    qs = [1 << b for b in range(bits - 1, 0, -1)]
    out = F.lit(0).cast("long")
    for q in qs:
        out = out.bitwiseXOR(F.when(last.bitwiseAND(F.lit(q).cast("long")) != 0, F.lit(q - 1)).otherwise(F.lit(0)).cast("long"))
    return out


def _text_code(value: Column, low: str | None, high: str | None) -> tuple[Column, int, int]:
    """A string as a whole number in code-point order: the six bytes after what all values share."""
    low, high = (low or "").encode(), (high or "").encode()
    common = 0
    while common < min(len(low), len(high)) and low[common] == high[common]:
        common += 1
    taken = F.rpad(F.hex(F.substring(value.cast("binary"), common + 1, 6)), 12, "0")
    code = lambda b: int.from_bytes(b[common : common + 6].ljust(6, b"\0"), "big")
    return F.conv(taken, 16, 10).cast("long"), code(low), code(high)


def quantised(df: DataFrame, dims: dict[str, Column], bits: int) -> list[Column]:
    """One coordinate in ``[0, 2**bits)`` for each dimension; null goes to 0.

    Numbers and strings are both scaled between their smallest and largest value (strings in code-point
    order), so a coordinate is monotone in its dimension and one row of statistics is all that is read.
    """
    kinds = dict(df.select(*[c.alias(k) for k, c in dims.items()]).dtypes)
    ranges = df.agg(*[f(c).alias(f"{k}_{n}") for k, c in dims.items() for n, f in (("lo", F.min), ("hi", F.max))]).first()
    top, out = (1 << bits) - 1, []
    for k, c in dims.items():
        lo, hi = ranges[f"{k}_lo"], ranges[f"{k}_hi"]
        if kinds[k] == "string":
            c, lo, hi = _text_code(c, lo, hi)
        if lo is None or lo == hi:
            out.append(F.lit(0))
            continue
        share = (c.cast("double") - F.lit(float(lo))) / F.lit(float(hi) - float(lo))
        out.append(F.coalesce(F.least(F.floor(share * (top + 1)), F.lit(top)), F.lit(0)).cast("int"))
    return out


def shard_by_curve(
    df: DataFrame, dims: dict[str, Column], key: list[Column], n_shards: int = 16, bits: int = 5, bucket_rows: int = 50_000
) -> DataFrame:
    """``df`` with ``curve`` (place on the curve), ``shard`` and ``slot`` (gapless from 0 in each shard).

    Law ``rows``: row counts of any two shards differ by at most one.  ``key`` orders the rows of a cell;
    rows that are equal in all of ``key`` share a bucket and get their slots in either order.  Null
    dimensions lie at coordinate 0, an empty table gives an empty table.  ``df`` is read several times:
    pass something stored.  Columns of ``df`` named curve, shard or slot are replaced.
    """
    if bits * len(dims) > MAX_CELLS.bit_length() - 1:
        raise ValueError(f"{bits} bits in {len(dims)} dimensions make more than {MAX_CELLS} cells")
    coords = quantised(df, dims, bits)
    columns = [c for c in df.columns if c not in ("curve", "shard", "slot")]
    cell = F.lit(0).cast("int")
    for c in coords:
        cell = cell * (1 << bits) + c
    named = [k.alias(f"key{i}") for i, k in enumerate(key)]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), cell.alias("__cell"), *named)  # names of columns are free
    key = [F.col(f"key{i}") for i in range(len(key))]
    parts = [F.call_function("shiftright", F.col("__cell"), F.lit(bits * i)).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(len(dims) - 1, -1, -1)]
    # One row for each occupied cell: at most 2**(bits * dims), so one task may order them.
    cells = (
        rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("curve", hilbert_index(parts, bits))
        .withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__total", F.sum("__n").over(Window.partitionBy(F.lit(0))))
        .withColumn("__parts", F.ceil(F.col("__n") / F.least(F.lit(bucket_rows), F.ceil(F.col("__total") / F.lit(1024)))))
    )
    cells = keep(cells)
    spread = F.xxhash64(*key)
    placed = rows.join(F.broadcast(cells), "__cell").withColumn("__bucket", F.pmod(spread, F.col("__parts")))
    buckets = placed.groupBy("__cell", "__bucket").agg(F.count(F.lit(1)).alias("__in"))
    offset = F.coalesce(F.sum("__in").over(Window.partitionBy("__cell").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("__offset", offset).drop("__in")
    ranked = placed.withColumn("__at", F.row_number().over(Window.partitionBy("__cell", "__bucket").orderBy(*key)) - 1)
    rank = F.col("__before") + F.col("__offset") + F.col("__at")
    shard = F.expr(f"__rank * {n_shards} div __total")
    first = F.expr(f"(shard * __total + {n_shards - 1}) div {n_shards}")
    return (
        ranked.join(buckets, ["__cell", "__bucket"])
        .withColumn("__rank", rank)
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("__rank") - first).cast("long"))
        .select(*[F.col("row").getField(c).alias(c) for c in columns], "curve", "shard", "slot")
    )


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Documents along a curve through source, language and size; adds curve, shard and slot."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    dims = {"source": F.col("source"), "lang": F.col("lang"), "size": F.log2(size + F.lit(1))}
    key = [F.col("doc_id"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))]
    return shard_by_curve(docs, dims, key, n_shards)


def op1_hilbert_shards(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, with its curve index."""
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = keep(
        docs.select(
            "doc_id", "source", "lang",
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
    )
    dims = {"source": F.col("source"), "lang": F.col("lang"), "size": F.log2(F.col("size"))}
    placed = shard_by_curve(meta, dims, [F.col("doc_id"), F.col("text_crc32")], n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
