"""Anomaly detection on windows of residual grids: injected anomalies, features, detectors.

Windows are long: win_id, var, pos and a value.  Features end as one row for each window with double columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import ESCAPE, INLINE
from gridloom.operators import packed
from gridloom.operators.metrics import classification_shares
from gridloom.operators.nearest import neighbours
from gridloom.operators.quantiles import percentiles
from gridloom.plans.durable import keep
from gridloom.plans.numbering import numbered


#: Places that windows' distances are measured from in the search of neighbours.
PIVOTS = 3


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that is a hash of its arguments."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def normal(*parts: Column | str) -> Column:
    return F.sqrt(-2.0 * F.log(1.0 - uniform(*parts, F.lit("r")))) * F.cos(2.0 * np.pi * uniform(*parts, F.lit("a")))


def _drawn(var: Column, size: int, seed: int) -> dict[str, Column]:
    """What is drawn for a window (win_id) and a variable, all of it hashes; magnitudes are in deviations."""
    s = F.lit(seed)
    u = lambda name, lo, hi: lo + (hi - lo) * uniform("win_id", var, s, F.lit(name))
    w = lambda name, lo, hi: F.floor(lo + (hi - lo) * uniform("win_id", s, F.lit(name)))
    return {
        "kind": F.element_at(F.array(F.lit("spike"), F.lit("level_shift"), F.lit("variance")), (1 + F.floor(uniform("win_id", s, F.lit("kind")) * 3)).cast("int")),
        "most": 1 + F.floor(uniform("win_id", s, F.lit("n")) * 3), "sign": F.when(uniform("win_id", var, s, F.lit("sign")) < 0.5, -1.0).otherwise(1.0),
        "at": w("spike", size // 4, 3 * size // 4), "spread": F.floor(u("spread", 1, 4)), "spike": u("spike", 5.0, 15.0), "start": w("start", size // 4, size // 2), "shift": u("shift", 3.0, 10.0),
        "length": w("length", 20, 50), "noise": u("noise", 3.0, 8.0),
    }


def inject_anomaly(windows: DataFrame, size: int = 100, seed: int = 42) -> DataFrame:
    """Each window with one anomaly (kind: spike, level_shift or variance) on one to three variables.

    All draws are hashes of the window, the variable and ``seed``.  Magnitudes are in units of the variable's
    deviation in the window.
    """
    s, d = F.lit(seed), _drawn(F.col("var"), size, seed)
    names = windows.select("win_id", "var").distinct()
    rank = F.row_number().over(Window.partitionBy("win_id").orderBy(F.xxhash64("win_id", "var", s), "var"))
    hit = names.withColumn("__rank", rank).withColumn("__hit", F.col("__rank") <= d["most"]).select("win_id", "var", "__hit")
    sd = F.stddev_pop("x").over(Window.partitionBy("win_id", "var"))
    away = F.col("pos") - d["at"]
    spike = F.when(away == 0, 1.0).when((away > 0) & (away <= d["spread"]), 0.5 / away).when((away < 0) & (-away <= d["spread"]), 0.3 / -away).otherwise(0.0) * d["spike"]
    shift = F.when(F.col("pos") >= d["start"], d["shift"]).otherwise(0.0)
    noise = F.when((F.col("pos") >= d["start"]) & (F.col("pos") < d["start"] + d["length"]), d["noise"] * normal("win_id", "var", "pos", s)).otherwise(0.0)
    add = F.when(F.col("kind") == "spike", spike * d["sign"]).when(F.col("kind") == "level_shift", shift * d["sign"]).otherwise(noise)
    out = windows.join(hit, ["win_id", "var"]).withColumn("kind", d["kind"])
    return out.withColumn("x", F.col("x") + F.when(F.col("__hit"), add * sd).otherwise(0.0)).drop("__hit")


def _drawn_packed(names: list[str], size: int, seed: int):
    """``_drawn`` of a packed window's variable as a struct, whether it is hit, and its noise by position."""

    def draw(var: Column) -> Column:
        s, d = F.lit(seed), _drawn(var, size, seed)
        own = F.xxhash64("win_id", var, s)
        before = lambda u: (F.xxhash64("win_id", F.lit(u), s) < own) | ((F.xxhash64("win_id", F.lit(u), s) == own) & (F.lit(u) < var))
        hit = sum((F.when(before(u), 1).otherwise(0) for u in names), F.lit(1)) <= d["most"]
        noise = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), lambda pos: d["noise"] * normal("win_id", var, pos, s))
        numbers = [d[n].cast("double").alias(n) for n in ("sign", "at", "spread", "spike", "start", "shift", "length")]
        return F.struct(hit.cast("double").alias("hit"), d["kind"].alias("kind"), *numbers, F.when(hit & (d["kind"] == "variance"), noise).alias("noise"))

    return draw


def labeled_windows(windows: DataFrame, size: int = 100, seed: int = 42) -> DataFrame:
    """Every window twice: as it is (label 0) and with an anomaly (label 1).  Packed windows stay so."""
    if packed.packed(windows):
        return packed.labeled(windows, _drawn_packed(packed.variables_of(windows), size, seed))
    normal_ = windows.withColumn("kind", F.lit("normal")).withColumn("label", F.lit(0)).withColumn("win_id", F.concat("win_id", F.lit("/n")))
    odd = inject_anomaly(windows, size, seed).withColumn("label", F.lit(1)).withColumn("win_id", F.concat("win_id", F.lit("/a")))
    return normal_.unionByName(odd)


def labels_of(windows: DataFrame, *beside: str) -> DataFrame:
    """win_id, ``beside`` and the label of labelled windows, or of features of them, by the mark that ``labeled_windows`` puts on win_id."""
    return windows.select("win_id", *beside, F.col("win_id").endswith("/a").cast("int").alias("label"))


def window_grid(windows: DataFrame, eps: float = 0.03, mode: str = "rel") -> DataFrame:
    """The plain lattice grid of each window: win_id, var, pos, pixel and r (127 where escaped)."""
    from gridloom.functions.scalar import asinh_scale, lattice_quantize, pixel
    from gridloom.operators import lattice

    if packed.packed(windows):
        return windows.withColumns({"eps": F.lit(float(eps)), "mode": F.lit(mode)})  # worked out where it is read
    samples = windows.select(F.col("win_id").alias("grid_id"), "var", F.col("pos").alias("t"), "x")
    scales = lattice.params(samples, eps, mode, scale=mode == "rel")
    y = asinh_scale(F.col("x"), F.col("s")) if mode == "rel" else F.col("x")
    m = samples.join(scales, ["grid_id", "var"]).withColumn("m", lattice_quantize(y, F.col("q")))
    r = F.col("m") - F.lag("m").over(Window.partitionBy("grid_id", "var").orderBy("t"))
    grid = m.withColumn("r", r).filter("r is not null")
    return grid.select(F.col("grid_id").alias("win_id"), "var", F.col("t").alias("pos"), pixel(F.col("r")).alias("pixel"), F.when(F.abs("r") <= INLINE, F.col("r")).otherwise(INLINE + 1).alias("r"))


def _wide(df: DataFrame, names: list[str]) -> DataFrame:
    """One row for each window: each variable's features side by side, variables in name order."""
    seen = [r[0] for r in df.select("var").distinct().orderBy("var").collect()]
    return df.groupBy("win_id").pivot("var", seen).agg(*[F.first(n).alias(n) for n in names])


def numeric_features(windows: DataFrame, wide: bool = True) -> DataFrame:
    if packed.packed(windows):
        return packed.features(windows, packed.numeric, by_var=True, wide=wide, of="values")
    steps = windows.withColumn("__d", F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("win_id", "var").orderBy("pos"))))
    names = ["f_mean", "f_std", "f_range", "f_kurtosis", "f_step", "f_spread"]
    out = steps.groupBy("win_id", "var").agg(
        F.avg("x").alias("f_mean"), F.stddev_pop("x").alias("f_std"), (F.max("x") - F.min("x")).alias("f_range"), F.kurtosis("x").alias("f_kurtosis"), F.max("__d").alias("f_step"),
        (F.percentile("x", F.lit(0.95)) - F.percentile("x", F.lit(0.05))).alias("f_spread"),
    )
    return _wide(out, names) if wide else out


def _entropy32(df: DataFrame, value: str) -> DataFrame:
    """Entropy (natural log) of 32 bins over 0..255 by window."""
    bins = df.groupBy("win_id", F.least(F.floor(F.col(value) * 32 / 255.0), F.lit(31)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("win_id"))
    return bins.withColumn("__p", F.col("n") / total).groupBy("win_id").agg((-F.sum(F.col("__p") * F.log("__p"))).alias("i_entropy"))


def image_features(grid: DataFrame) -> DataFrame:
    """Fourteen statistics of a window's pixels: level, texture, edges (Sobel, edges repeated), rows, columns."""
    if packed.packed(grid):
        return packed.features(grid, packed.image)
    t = Window.partitionBy("win_id", "var").orderBy("pos")
    v = Window.partitionBy("win_id", "pos").orderBy("var")
    p = F.col("pixel").cast("double")
    near = lambda c, w, k: F.coalesce(F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w), F.col(c))
    rows = grid.withColumn("p", p).withColumn("dt", near("p", t, -1) - near("p", t, 1)).withColumn("st", near("p", t, -1) + 2.0 * F.col("p") + near("p", t, 1))
    edge = rows.withColumn("ex", near("dt", v, -1) + 2.0 * F.col("dt") + near("dt", v, 1)).withColumn("ey", near("st", v, -1) - near("st", v, 1))
    edge = edge.withColumn("e", F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey"))).withColumn("c", F.abs(F.col("p") - F.lag("p").over(t)))
    whole = edge.groupBy("win_id").agg(
        F.avg("p").alias("i_mean"), F.stddev_pop("p").alias("i_std"), F.kurtosis("p").alias("i_kurtosis"), (F.max("p") - F.min("p")).alias("i_range"),
        F.avg("e").alias("i_edge_mean"), F.stddev_pop("e").alias("i_edge_std"), F.max("e").alias("i_edge_max"), F.avg("c").alias("i_col_mean"), F.stddev_pop("c").alias("i_col_std"), F.max("c").alias("i_col_max"),
    )
    by_row = edge.groupBy("win_id", "var").agg(F.stddev_pop("p").alias("s")).groupBy("win_id").agg(F.avg("s").alias("i_row_mean"), F.stddev_pop("s").alias("i_row_std"), F.max("s").alias("i_row_max"))
    return whole.join(_entropy32(edge, "p"), "win_id").join(by_row, "win_id")


def simple_features(grid: DataFrame) -> DataFrame:
    if packed.packed(grid):
        return packed.features(grid, packed.simple)
    step = F.abs(F.col("pixel") - F.lag("pixel").over(Window.partitionBy("win_id", "var").orderBy("pos")))
    parts = grid.withColumn("c", step).groupBy("win_id").agg(F.avg("c").alias("s_edges"), F.stddev_pop("pixel").alias("s_std"))
    return parts.join(_entropy32(grid, "pixel").withColumnRenamed("i_entropy", "s_entropy"), "win_id")


def grid_features(grid: DataFrame) -> DataFrame:
    """Ten numbers that need no rebuilt value: activity, extremes and escapes of the residual grid."""
    if packed.packed(grid):
        return packed.features(grid, packed.grid)
    cells = grid.withColumn("dev", F.abs(F.col("pixel").cast("double") - 128.0)).withColumn("active", (F.abs(F.col("pixel") - 128) > 2).cast("double"))
    whole = cells.groupBy("win_id").agg(
        F.avg("dev").alias("g_mean"), F.stddev_pop("dev").alias("g_std"), F.max("dev").alias("g_max"), F.avg("active").alias("g_active"), F.count_if(F.col("pixel") == ESCAPE).cast("double").alias("g_escapes"),
        F.count_if(F.col("dev") > 20).cast("double").alias("g_strong"), F.percentile("dev", F.lit(0.99)).alias("g_p99"),
    )
    rows = cells.groupBy("win_id", "var").agg(F.max("dev").alias("m")).groupBy("win_id").agg(F.avg("m").alias("g_row_mean"), F.max("m").alias("g_row_max"))
    columns = cells.groupBy("win_id", "pos").agg(F.avg("active").alias("a")).groupBy("win_id").agg(F.max("a").alias("g_burst"))
    return whole.join(rows, "win_id").join(columns, "win_id")


def _trajectories(grid: DataFrame) -> DataFrame:
    """``tn``: the running sum of residuals in units of the 90th percentile of their magnitude."""
    up_to = Window.partitionBy("win_id", "var").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    scale = grid.groupBy("win_id", "var").agg(F.greatest(F.percentile(F.abs("r"), F.lit(0.9)), F.lit(1.0)).alias("__s"), F.count(F.lit(1)).alias("__n"), F.min("pos").alias("__0"))
    path = grid.join(scale, ["win_id", "var"]).withColumn("tn", F.sum("r").over(up_to) / F.col("__s"))
    return path.withColumn("late", F.col("pos") - F.col("__0") >= F.floor(F.col("__n") / 2)).drop("__s", "__n", "__0")


def trajectory_features(grid: DataFrame) -> DataFrame:
    if packed.packed(grid):
        return packed.features(grid, packed.trajectory)
    t = Window.partitionBy("win_id", "var").orderBy("pos")
    path = _trajectories(grid).withColumn("__g", F.signum(F.col("tn") - F.lag("tn").over(t) + 1e-9)).withColumn("turn", F.abs(F.col("__g") - F.lag("__g").over(t)))
    by_row = path.groupBy("win_id", "var").agg(
        F.abs(F.max_by("tn", "pos")).alias("drift"), (F.max("tn") - F.min("tn")).alias("span"), F.abs(F.avg(F.when(F.col("late"), F.col("tn"))) - F.avg(F.when(~F.col("late"), F.col("tn")))).alias("shift"),
        F.avg("turn").alias("rough"), F.max(F.abs("r")).alias("big"), F.count_if(F.abs("r") >= 100).alias("moves"),
    )
    return by_row.groupBy("win_id").agg(
        F.max("drift").alias("t_drift_max"), F.avg("drift").alias("t_drift_mean"), F.max("span").alias("t_span_max"), F.avg("span").alias("t_span_mean"), F.max("shift").alias("t_shift_max"), F.avg("shift").alias("t_shift_mean"),
        F.max("rough").alias("t_rough"), F.max("big").cast("double").alias("t_big"), F.sum("moves").cast("double").alias("t_moves"),
    )


PER_ROW = ["p_mean", "p_max", "p_active", "p_std", "p_span", "p_shift"]


def per_row_features(grid: DataFrame, wide: bool = True) -> DataFrame:
    """Six numbers for each variable of a window, read off the residual grid."""
    if packed.packed(grid):
        return packed.features(grid, packed.per_row, by_var=True, wide=wide)
    a = F.abs("r").cast("double")
    out = _trajectories(grid).groupBy("win_id", "var").agg(
        F.avg(a).alias("p_mean"), F.max(a).alias("p_max"), F.avg((a > 2).cast("double")).alias("p_active"), F.stddev_pop(a).alias("p_std"), (F.max("tn") - F.min("tn")).alias("p_span"),
        F.abs(F.avg(F.when(F.col("late"), F.col("tn"))) - F.avg(F.when(~F.col("late"), F.col("tn")))).alias("p_shift"),
    )
    return _wide(out, PER_ROW) if wide else out


def hstack_features(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "win_id")
    return out


def grid_and_trajectory_features(grid: DataFrame) -> DataFrame:
    """Both sets side by side; of packed windows in one pass."""
    if packed.packed(grid):
        return packed.features(grid, packed.grid, packed.trajectory)
    return hstack_features(grid_features(grid), trajectory_features(grid))


def feature_names(features: DataFrame) -> list[str]:
    return [c for c, t in features.dtypes if t == "double"]


def standardise(features: DataFrame) -> DataFrame:
    """z-scores by population deviation (0 where there is none); NaN becomes 0, infinities a million."""
    names = feature_names(features)
    tame = features.select("win_id", *[F.when(F.isnan(c) | F.col(c).isNull(), 0.0).when(F.abs(c) == float("inf"), F.signum(c) * 1e6).otherwise(F.col(c)).alias(c) for c in names])
    stats = tame.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0)
    return tame.crossJoin(F.broadcast(stats)).select("win_id", *[z(c).alias(c) for c in names])


def _long(features: DataFrame, *beside: str) -> DataFrame:
    return features.unpivot(["win_id", *beside], feature_names(features), "feature", "v")


def threshold_rules(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rules: each feature above or below its percentiles 20, 25 ... 75."""
    long = _long(keep(features.join(labels.select("win_id", "label"), "win_id")), "label")  # read in several passes
    shares = [p / 100 for p in range(20, 80, 5)]
    cuts = percentiles(long, ["feature"], F.col("v"), {f"c{i}": p for i, p in enumerate(shares)})
    # All rules of a feature are counted in one row of sums; no cell is repeated for each rule.
    above = {(i, d): (F.col("v") > F.col(f"c{i}")) if d == "above" else (F.col("v") < F.col(f"c{i}")) for i in range(len(shares)) for d in ("above", "below")}
    y = F.col("label") == 1
    sums = [F.count_if(p & y).alias(f"tp_{i}_{d}") for (i, d), p in above.items()] + [F.count_if(p & ~y).alias(f"fp_{i}_{d}") for (i, d), p in above.items()]
    counted = long.join(F.broadcast(cuts), "feature").groupBy("feature").agg(
        *sums, F.count_if(F.col("v").isNotNull() & y).alias("ones"), F.count_if(F.col("v").isNotNull() & ~y).alias("zeros"), F.count(F.lit(1)).alias("n"), *[F.first(f"c{i}").alias(f"c{i}") for i in range(len(shares))]
    )
    rule = lambda i, d: F.struct(F.lit(i).alias("i"), F.lit(d).alias("direction"), F.col(f"c{i}").alias("cut"), F.col(f"tp_{i}_{d}").alias("tp"), F.col(f"fp_{i}_{d}").alias("fp"))
    each = counted.select("feature", "ones", "zeros", "n", F.explode(F.array(*[rule(i, d) for i, d in above])).alias("r")).select("feature", "r.*", "ones", "zeros", "n")
    fn, right = F.col("ones") - F.col("tp"), F.col("tp") + F.col("zeros") - F.col("fp")
    return classification_shares(each.withColumns({"fn": fn, "right": right}), ("feature", "i", "direction", "cut"))


def threshold_search(features: DataFrame, labels: DataFrame) -> DataFrame:
    """The one rule of the best F1."""
    rules = threshold_rules(features, labels).withColumn("pct", 20 + 5 * F.col("i"))
    return rules.orderBy(F.desc("f1"), "feature", "i", "direction").limit(1).select("feature", "direction", "pct", "cut", "f1", "precision", "recall")


def iqr_outliers(features: DataFrame, k: float = 1.5) -> DataFrame:
    long = _long(keep(features))  # read in several passes
    q = percentiles(long, ["feature"], F.col("v"), {"q1": 0.25, "q3": 0.75})
    wide = F.col("q3") - F.col("q1")
    out = long.join(F.broadcast(q), "feature").withColumn("o", (F.col("v") < F.col("q1") - k * wide) | (F.col("v") > F.col("q3") + k * wide))
    return out.groupBy("win_id").agg(F.max(F.col("o").cast("int")).alias("predicted"))


def rank_ensemble(scores: DataFrame) -> DataFrame:
    """Sum of each column's rank fractions; windows above the median are flagged."""
    ranked = _ranked(_long(scores), "feature", ["v", "win_id"])
    total = keep(ranked.groupBy("win_id").agg(F.sum(F.col("rank") / F.col("rows")).alias("score")))
    middle = percentiles(total, [], F.col("score"), {"__m": 0.5})
    return total.crossJoin(F.broadcast(middle)).select("win_id", "score", (F.col("score") > F.col("__m")).cast("int").alias("predicted"))


def _ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with rank (from 0) and rows of each ``group``, by ranges of the whole table: groups are few and large."""
    placed = numbered(df, [group, *order], "__t")
    groups = placed.groupBy(F.col(group).alias("__group")).agg(F.min("__t").alias("__first"), F.count(F.lit(1)).alias("rows"))
    return placed.join(groups, F.col(group).eqNullSafe(F.col("__group"))).withColumn("rank", F.col("__t") - F.col("__first")).drop("__t", "__group", "__first")


def random_forest_cv(features: DataFrame, labels: DataFrame, folds: int = 5, trees: int = 50, depth: int = 5, seed: int = 42) -> DataFrame:
    """Out-of-fold predictions of a random forest; folds are stratified and dealt by a hash of the window."""
    names = feature_names(features)
    tame = features.select("win_id", *[F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(names)])
    data = tame.join(labels.select("win_id", "label"), "win_id")
    data = _ranked(data.withColumn("__h", F.xxhash64("win_id", F.lit(seed))), "label", ["__h", "win_id"])  # stored once for all fits
    data = VectorAssembler(inputCols=[f"f{i}" for i in range(len(names))], outputCol="v").transform(data.withColumn("fold", (F.col("rank") + 1) % folds)).select("win_id", F.col("label").cast("double").alias("label"), "fold", "v")
    out = None
    for k in range(folds):
        model = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(data.filter(F.col("fold") != k))
        one = model.transform(data.filter(F.col("fold") == k)).select("win_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))
        out = one if out is None else out.unionByName(one)
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, nodes: list) -> int:
    at = len(nodes)
    nodes.append((-1, 0.0, -1, -1, float(len(x))))
    spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(0)
    if depth == 0 or len(x) <= 1 or not (spread > 0).any():
        return at
    f = int(rng.choice(np.flatnonzero(spread > 0)))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    a, b = _grow(x[left], rng, depth - 1, nodes), _grow(x[~left], rng, depth - 1, nodes)
    nodes[at] = (f, cut, a, b, float(len(x)))
    return at


def _path_tail(n: np.ndarray) -> np.ndarray:
    n = np.maximum(n, 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def isolation_forest(features: DataFrame, trees: int = 100, sample: int = 256, contamination: float = 0.5, seed: int = 42) -> DataFrame:
    """score and predicted of each window.

    Each tree grows in a task of its own from about ``sample`` windows drawn by hash; the forest (at most
    2 * sample * trees small rows) is broadcast and all windows are scored in place.
    """
    names = feature_names(features)
    rows = keep(features.select("win_id", F.array(*[F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for c in names]).alias("x")))  # read three times
    n = rows.count()
    share = sample / max(n, 1)
    taken = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: uniform("win_id", tree, F.lit(seed)) < share)  # most windows are in no tree
    drawn = rows.withColumn("tree", F.explode(taken))

    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("win_id")
        nodes: list = []
        _grow(np.vstack(frame["x"].to_numpy()), np.random.default_rng(seed * 1000 + int(key[0])), int(np.ceil(np.log2(max(len(frame), 2)))), nodes)
        return pd.DataFrame([(key[0], i, *node) for i, node in enumerate(nodes)], columns=["tree", "node", "f", "cut", "a", "b", "n"])

    forest = drawn.groupBy("tree").applyInPandas(grow, "tree int, node int, f int, cut double, a int, b int, n double").toPandas().sort_values(["tree", "node"])
    grown = [(t["f"].to_numpy(), t["cut"].to_numpy(), t["a"].to_numpy(), t["b"].to_numpy(), t["n"].to_numpy()) for _, t in forest.groupby("tree")]
    norm = float(_path_tail(np.array([min(sample, max(n, 1))]))[0]) or 1.0

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.vstack(frame["x"].to_numpy())
            depth = np.zeros(len(x))
            for f, cut, a, b, size in grown:
                at, steps = np.zeros(len(x), int), np.zeros(len(x))
                while (go := np.flatnonzero(f[at] >= 0)).size:
                    where = at[go]
                    at[go] = np.where(x[go, f[where]] < cut[where], a[where], b[where])
                    steps[go] += 1
                depth += steps + _path_tail(size[at])
            yield pd.DataFrame({"win_id": frame["win_id"], "score": 2.0 ** (-depth / max(len(grown), 1) / norm)})

    out = keep(rows.mapInPandas(scored, "win_id string, score double"))
    cut = percentiles(out, [], F.col("score"), {"__cut": 1.0 - contamination})
    return out.crossJoin(F.broadcast(cut)).select("win_id", "score", (F.col("score") > F.col("__cut")).cast("int").alias("predicted"))


def _vectors(features: DataFrame) -> DataFrame:
    """win_id, ``v`` of the standardised features, and ``id``: windows by number, in order of win_id; stored."""
    z = standardise(features)
    return keep(numbered(z.select("win_id", F.array(*feature_names(z)).alias("v")), ["win_id"], "id"))


def pairs_compared(features: DataFrame, k: int = 20, cells: int = 1, pivots: int = PIVOTS) -> int:
    """How many pairs of windows meet in the search of ``local_outlier_factor`` if all windows search, copies too."""
    found = neighbours(_vectors(features).withColumn("ask", F.lit(True)), k, cells, pivots)[1]
    sizes = found.filter("cell = at").select(F.col("at").alias("other"), F.col("mine").alias("theirs"))
    return int(found.join(sizes, found["at"] == sizes["other"]).agg(F.sum(F.col("mine") * F.col("theirs"))).first()[0] or 0)


def _first_copies(v: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of all windows with the same ``v``; ``ask``: there are no more.  Nobody's nearest ``k`` hold a further one."""
    same = Window.partitionBy(F.xxhash64("v"), "v")  # numbers are sorted faster than arrays
    ranked = v.withColumn("__r", F.row_number().over(same.orderBy("id"))).filter(F.col("__r") <= k + 1)
    return ranked.withColumn("ask", F.max("__r").over(same) <= k).filter(F.col("__r") <= k).select("id", "v", "ask")


def local_outlier_factor(features: DataFrame, k: int = 20, contamination: float = 0.5, cells: int = 1, pivots: int = PIVOTS) -> DataFrame:
    """Local outlier factors on standardised features; neighbours are exact whatever ``cells`` and ``pivots``.

    Windows are cut into ``cells`` cells by their features and their distances to ``pivots`` places (the origin and
    windows far apart).  A window's nearest in its own cell give a bound of its k-distance, and then it is compared
    with every cell that may hold one within that bound.  A task searches one cell; take more for more windows.

    A window with ``k`` or more copies has them as nearest at distance 0, as they have copies: its density is
    that of distance 0 and its factor 1.  Such windows are found, but don't search.
    """
    v = _vectors(features)
    first = keep(_first_copies(v, k))
    near = keep(neighbours(first, k, cells, pivots)[0])
    edges = near.select("id", F.explode("near").alias("n")).select("id", "n.d", "n.other")
    reach = near.select(F.col("id").alias("other"), F.array_max(F.transform("near", lambda n: n["d"])).alias("kd"))
    beside = lambda df, name, copies: edges.join(df, "other", "left").withColumn(name, F.coalesce(name, F.lit(copies)))
    lrd = keep(beside(reach, "kd", 0.0).groupBy("id").agg((1.0 / (F.avg(F.greatest("d", "kd")) + 1e-10)).alias("lrd")))
    mean = beside(lrd.select(F.col("id").alias("other"), F.col("lrd").alias("lo")), "lo", 1.0 / (0.0 + 1e-10)).groupBy("id").agg(F.avg("lo").alias("lo"))
    searched = mean.join(lrd, "id").select("id", (F.col("lo") / F.col("lrd")).alias("score"))
    copies = v.join(first.filter("ask"), "id", "left_anti").select("id", F.lit(1.0).alias("score"))
    factor = keep(v.select("id", "win_id").join(searched.unionByName(copies), "id").select("win_id", "score"))
    cut = percentiles(factor, [], F.col("score"), {"__cut": 1.0 - contamination})
    return factor.crossJoin(F.broadcast(cut)).select("win_id", "score", (F.col("score") > F.col("__cut")).cast("int").alias("predicted"))


def detect_on_grid(windows: DataFrame, eps: float = 0.03, **kw) -> DataFrame:
    """An isolation forest on what the residual grid itself shows."""
    return isolation_forest(per_row_features(window_grid(windows, eps)), **kw)


def detect_on_decoded(windows: DataFrame, eps: float = 0.03, **kw) -> DataFrame:
    """The same forest on statistics of the rebuilt values."""
    from gridloom.operators import lattice

    if packed.packed(windows):
        return isolation_forest(packed.features(window_grid(windows, eps, "rel"), packed.numeric, by_var=True, of="rebuilt"), **kw)
    samples = windows.select(F.col("win_id").alias("grid_id"), "var", F.col("pos").alias("t"), "x")
    hat = lattice.decode(*lattice.encode(samples, eps, "rel", "p1"), mode="rel")
    return isolation_forest(numeric_features(hat.select(F.col("grid_id").alias("win_id"), "var", F.col("t").alias("pos"), F.col("x_hat").alias("x"))), **kw)
