"""Exact percentiles by selection: sketches bracket the wanted values, exact counts narrow the brackets.

``percentile`` keeps a count for each distinct value of a group in one task.  Here that is done only for groups of
few rows.  For larger ones each pass takes a bounded sketch of the rows still in question, reads from it a bracket
of two values around each wanted place in the order, and counts exactly how many rows lie below and inside.  A pass
leaves about one in a thousand rows, so three passes do for 1e12 rows; what is left is sorted out exactly.  No task
holds more than a sketch or ``SMALL`` rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.durable import keep

#: Rows of a group that are sorted out in one place, and the precision of sketches.
SMALL, PRECISION = 100_000, 5_000


def percentiles(df: DataFrame, keys: list[str], value: Column, fractions: dict[str, float], small: int = SMALL, precision: int = PRECISION) -> DataFrame:
    """keys, and for each name in ``fractions`` the percentile of ``value`` over the group.

    Interpolated between neighbours as ``percentile`` does; nulls don't count, a group of nulls alone has nulls.
    NaN counts as the largest value.  ``keys`` may be empty: then there is one row, nulls if there are no values.
    ``df`` is read several times when groups are large: pass something cheap or stored.
    """
    rows = df.select(*keys, value.cast("double").alias("v"))
    if few_rows(rows, keys, small):
        return rows.groupBy(*keys).agg(*[F.percentile("v", F.lit(p)).alias(name) for name, p in fractions.items()])
    found = _selected(rows.filter("v is not null"), keys, list(fractions.values()), small, precision)
    pick = [F.max(F.when(F.col("which") == i, F.col("p"))).alias(name) for i, name in enumerate(fractions)]
    return _joined(rows.select(*keys).distinct() if keys else df.sparkSession.range(1).select(), found.groupBy(*keys).agg(*pick), keys)


def few_rows(df: DataFrame, keys: list[str], small: int = SMALL) -> bool:
    """Whether every group has at most ``small`` rows, so that Spark's own ``percentile`` is bounded as well."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= small


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins a row for each group; null keys meet, no keys mean one row."""
    if not keys:
        return left.join(F.broadcast(right), how="cross")
    named = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"__{k}" for k in keys])


def _selected(rows: DataFrame, keys: list[str], fractions: list[float], small: int, precision: int) -> DataFrame:
    """keys, which and p: the percentile of each fraction, by its number in the list."""
    total = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    places = F.array(*[F.struct(F.lit(i).alias("which"), F.lit(p).cast("double").alias("fraction")) for i, p in enumerate(fractions)])
    wanted = total.select(*keys, "n", "low", "high", F.explode(places).alias("w")).select(*keys, "w.which", "low", "high", (F.col("w.fraction") * (F.col("n") - 1)).alias("place"))
    brackets = keep(_counted(rows, wanted, keys))
    wide = F.col("p").isNull() & (F.col("inside") > small)
    while brackets.filter(wide).limit(1).count():
        narrow = keep(_counted(rows, _narrowed(rows, brackets.filter(wide), keys, precision), keys))
        if not narrow.limit(1).count():
            break  # a sketch missed: the rest is sorted out as it is
        done = narrow.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("which").alias("__which"))
        on = [*[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("which") == F.col("__which")]
        brackets = keep(brackets.join(done, on, "left_anti").unionByName(narrow))
    return _sorted_out(rows, brackets, keys)


def _inside(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each bracket, once for each bracket that they lie in (fractions are few)."""
    asked = brackets.groupBy(*keys).agg(F.collect_list(F.struct("which", "low", "high")).alias("asked"))
    within = lambda b: (F.col("v") >= b["low"]) & (F.col("v") <= b["high"])
    return _joined(rows, asked, keys, "inner").select(*keys, "v", F.explode(F.filter("asked", within)).alias("b")).select(*keys, "v", "b.which")


def _counted(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """``brackets`` with the rows below and inside, counted over all rows, and p where that settles it.

    The two ends are compared apart: a place that falls on one of them is settled however often it repeats,
    else the bracket shrinks to the values next to them.  Brackets that miss their place are left out.
    """
    asked = brackets.groupBy(*keys).agg(F.collect_list(F.struct("which", "low", "high", "place")).alias("asked"))
    each = _joined(rows, asked, keys, "inner").select(*keys, "v", F.explode("asked").alias("b"))
    v, low, high = F.col("v"), F.col("b.low"), F.col("b.high")
    between = (v > low) & (v < high)
    counts = each.groupBy(*keys, "b").agg(
        F.count_if(v < low).alias("below"), F.count_if((v >= low) & (v <= high)).alias("inside"), F.count_if(v == low).alias("at_low"), F.count_if(v == high).alias("at_high"),
        F.min(F.when(between, v)).alias("up"), F.max(F.when(between, v)).alias("down"),
    ).select(*keys, "b.which", "b.low", "b.high", "b.place", "below", "inside", "at_low", "at_high", "up", "down")
    first, last = F.floor("place") - F.col("below"), F.ceil("place") - F.col("below")
    inner = F.col("inside") - F.col("at_high")  # rows before the upper end
    lo = F.when(first < F.col("at_low"), F.col("low")).when(first >= inner, F.col("high")).when(last >= inner, F.col("down"))
    hi = F.when(last < F.col("at_low"), F.col("low")).when(last >= inner, F.col("high")).when(first < F.col("at_low"), F.col("up"))
    lo, hi = F.coalesce(lo, F.when(F.col("up") == F.col("down"), F.col("up"))), F.coalesce(hi, F.when(F.col("up") == F.col("down"), F.col("up")))
    counts = counts.filter((first >= 0) & (last < F.col("inside"))).withColumns({"lo": lo, "hi": hi})
    p = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), _between(F.col("lo"), F.col("hi")))
    return counts.select(*keys, "which", F.coalesce("up", "low").alias("low"), F.coalesce("down", "high").alias("high"), "place", (F.col("below") + F.col("at_low")).alias("below"), (inner - F.col("at_low")).alias("inside"), p.alias("p"))


def _between(lo: Column, hi: Column) -> Column:
    """Interpolated as Spark's percentile does it: two weighted ends."""
    return F.when(lo == hi, lo).otherwise((F.ceil("place") - F.col("place")) * lo + (F.col("place") - F.floor("place")) * hi)


def _narrowed(rows: DataFrame, brackets: DataFrame, keys: list[str], precision: int) -> DataFrame:
    """New brackets from a sketch of each old one's rows, with twice its error to both sides."""
    asked = brackets.select(*keys, "which", "place", ((F.floor("place") - F.col("below")) / F.col("inside")).alias("a"), ((F.ceil("place") + 1 - F.col("below")) / F.col("inside")).alias("b"))
    sketch = _inside(rows, brackets, keys).groupBy(*keys, "which").agg(F.expr(f"percentile_approx(v, array({', '.join(str(i / 1000.0) for i in range(1001))}), {precision})").alias("cuts"))
    sketch = sketch.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("which").alias("__which"), "cuts")
    both = asked.join(sketch, [*[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("which") == F.col("__which")])
    margin = 2.0 / precision
    at = lambda x: F.greatest(F.least(x, F.lit(1000)), F.lit(0)).cast("int")
    low = F.get("cuts", at(F.floor((F.col("a") - margin) * 1000)))
    high = F.get("cuts", at(F.ceil((F.col("b") + margin) * 1000)))
    return both.select(*keys, "which", low.alias("low"), high.alias("high"), "place")


def _sorted_out(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """The values at floor(place) and ceil(place), interpolated; equal values are counted, not listed."""
    known = brackets.filter("p is not null").select(*keys, "which", "p")
    open_ = brackets.filter("p is null")
    counts = _inside(rows, open_, keys).groupBy(*keys, "which", "v").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys, "which").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = counts.withColumn("before", before)
    told = open_.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("which").alias("__which"), "below", "place")
    both = marked.join(told, [*[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("which") == F.col("__which")])
    first = F.col("before") + F.col("below")
    holds = lambda at: (first <= at) & (at < first + F.col("c"))
    ends = both.groupBy(*keys, "which").agg(
        F.max(F.when(holds(F.floor("place")), F.col("v"))).alias("lo"), F.max(F.when(holds(F.ceil("place")), F.col("v"))).alias("hi"), F.max("place").alias("place")
    )
    return known.unionByName(ends.select(*keys, "which", _between(F.col("lo"), F.col("hi")).alias("p")))
