"""Percent-change grids: the base and the enhanced variant, bit-depth tuning, sweeps and comparisons."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import bank, metrics, profile, segments, sequence, whole
from gridloom.operators.clean import auto_offset, offset_of, sanitize
from gridloom.operators.frames import SERIES, dealt, series
from gridloom.operators.lattice import AUTO, walked_order
from gridloom.plans.blockscan import block_for, lagged
from gridloom.plans.durable import keep


def base_encode(samples: DataFrame, bits: int = 8, clamp: float = 500.0, block: int | str | None = AUTO) -> tuple[DataFrame, DataFrame]:
    """The grid (grid_id, var, t, q; first step left out) and baseline of each variable.

    ``block`` as in the lattice encoder: long series are scanned block by block.
    """
    steps = scalar.steps_of(bits)
    block = block_for(samples) if block == AUTO else block
    clean = sanitize(samples, block)
    pct = scalar.pct_change_base(F.col("x"), F.col("__p"))
    grid = lagged(clean, F.col("x"), "__p", block=block).withColumn("pct", pct).filter("pct is not null").select(*SERIES, "t", scalar.quantize_uniform(F.col("pct"), clamp, steps).alias("q"))
    return grid, clean.filter("t = 0").select(*SERIES, F.col("x").alias("baseline"), F.lit(clamp).alias("clamp"), F.lit(bits).alias("bits"))


def _with_first(grid: DataFrame, params: DataFrame) -> DataFrame:
    first = params.select(*SERIES, F.lit(0).cast("long").alias("t"), F.lit(None).cast("int").alias("q"))
    return grid.select(*SERIES, "t", "q").unionByName(first).join(params, list(SERIES))


def base_decode(grid: DataFrame, params: DataFrame, block: int | str | None = AUTO) -> DataFrame:
    block = block_for(grid) if block == AUTO else block
    steps = F.pow(F.lit(2.0), F.col("bits")) - 1.0
    rows = _with_first(grid, params).withColumn("pct", scalar.dequantize_uniform(F.col("q"), F.col("clamp"), steps))
    return sequence.rebuild_multiplicative(rows, block).select(*SERIES, "t", "x_hat")


def enhanced_encode(
    samples: DataFrame, bits: int = 16, adaptive: bool = True, mu_law: bool = True, log: bool = False, anchors: int = 0,
    offset: bool | None = None, clamp: float = 500.0, mu: float = scalar.MU, reorder: bool = False, block: int | str | None = AUTO,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grid, parameters and anchors.

    Percent changes against the previous magnitude (or log ratios), clamped per variable, with mu-law or
    uniform steps.  ``offset=None`` lifts those variables that reach zero; log ratios need positive values
    and so always lift them.  Variables stand in order of name (``row_pos``); with ``reorder`` those whose
    changes correlate stand side by side, which changes no value and what ``neighbour_bytes`` counts.
    """
    steps = scalar.steps_of(bits)
    block = block_for(samples) if block == AUTO else block
    clean = sanitize(samples, block)
    lifted = auto_offset(clean)
    reaches = clean.groupBy(*SERIES).agg((F.min("x") <= 0).alias("__reaches"))
    wanted = F.lit(True) if offset else (F.lit(False) if offset is False and not log else F.col("__reaches"))
    offsets = lifted.join(reaches, list(SERIES)).select(*SERIES, F.when(wanted, F.col("value_offset")).otherwise(0.0).alias("value_offset"))
    shifted = clean.join(offsets, list(SERIES)).withColumn("x", F.col("x") + F.col("value_offset"))
    prev = F.col("__p")
    change = F.log(F.col("x") / prev) * 100.0 if log else scalar.pct_change_safe(F.col("x"), prev)
    pct = lagged(shifted, F.col("x"), "__p", block=block).withColumn("pct", change).drop("__p")
    clamps = profile.adaptive_clamp(pct.filter("pct is not null"), cap=clamp) if adaptive else offsets.select(*SERIES, F.lit(clamp).alias("clamp"))
    quantize = (lambda c: scalar.quantize_mu_law(F.col("pct"), c, steps, mu)) if mu_law else (lambda c: scalar.quantize_uniform(F.col("pct"), c, steps))
    grid = pct.filter("pct is not null").join(clamps, list(SERIES)).select(*SERIES, "t", quantize(F.col("clamp")).alias("q"))
    params = shifted.filter("t = 0").select(*SERIES, F.col("x").alias("baseline"), "value_offset").join(clamps, list(SERIES), "left")
    params = params.withColumn("clamp", F.coalesce("clamp", F.lit(clamp))).withColumn("bits", F.lit(bits))
    by_name = F.row_number().over(Window.partitionBy("grid_id").orderBy("var")) - 1
    params = params.withColumn("row_pos", by_name.cast("int"))
    if reorder:
        walked = walked_order(pct.filter("pct is not null").select(*SERIES, "t", F.col("pct").alias("d"))).withColumnRenamed("row_pos", "walked")
        params = params.join(walked, list(SERIES), "left").withColumn("row_pos", F.coalesce("walked", "row_pos")).drop("walked")
    kept = sequence.take_anchors(shifted, anchors) if anchors else shifted.filter(F.lit(False)).select(*SERIES, "t", "x")
    return grid, params, kept


def enhanced_decode(grid: DataFrame, params: DataFrame, kept: DataFrame, mu_law: bool = True, log: bool = False, anchors: int = 0, bits: int = 16, mu: float = scalar.MU, block: int | str | None = AUTO) -> DataFrame:
    block = block_for(grid) if block == AUTO else block
    steps = scalar.steps_of(bits)
    rows = _with_first(grid, params)
    back = scalar.dequantize_mu_law(F.col("q"), F.col("clamp"), steps, mu) if mu_law else scalar.dequantize_uniform(F.col("q"), F.col("clamp"), steps)
    rows = rows.withColumn("pct", back)
    if log:
        rebuilt = sequence.rebuild_log(rows, block)
    elif anchors:
        rebuilt = sequence.rebuild_with_anchors(rows, kept, anchors)
    else:
        rebuilt = sequence.rebuild_multiplicative(rows, block)
    return rebuilt.select(*SERIES, "t", (F.col("x_hat") - F.col("value_offset")).alias("x_hat"))


def rebuilt_beside(samples: DataFrame, bits: int, kind: bool | None, clamp: float = 500.0, anchors: int = 0) -> DataFrame:
    """Samples with the code ``q`` and the rebuilt ``x_hat`` of the base grid (``kind`` None) or the enhanced one (adaptive
    clamps; mu-law steps if ``kind``), all of it windows over one order of each series.

    For series that fit a task (see ``block_for``): the numbers of encoders and decoders without tables of
    parameters that are joined to every cell.  x_hat follows from codes, baseline, offset and clamp alone.
    """
    steps, whole = scalar.steps_of(bits), series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sanitize(samples).withColumn("__v", F.col("x"))
    if kind is None:
        rows = rows.withColumns({"__o": F.lit(0.0), "__c": F.lit(clamp)})
        change = scalar.pct_change_base
    else:
        lo = F.min("x").over(whole)
        rows = rows.withColumns({"__lo": lo, "__sd": F.stddev_pop("x").over(whole), "__near": F.min(F.abs("x")).over(whole)})
        rows = rows.withColumn("__o", F.when(F.col("__lo") <= 0, offset_of(F.col("__lo"), F.col("__sd"), F.col("__near"))).otherwise(0.0)).withColumn("__v", F.col("x") + F.col("__o"))
        change = scalar.pct_change_safe
    rows = rows.withColumns({"__p": F.lag("__v").over(series()), "__b": F.first("__v").over(whole), "__last": F.max("t").over(whole)}).withColumn("__pct", change(F.col("__v"), F.col("__p")))
    if kind is not None:
        size = F.abs("__pct")
        rows = rows.withColumns({"__p995": F.percentile(size, F.lit(0.995)).over(whole), "__m": F.max(size).over(whole)}).withColumn("__c", profile.clamp_of(F.col("__p995"), F.col("__m"), clamp))
    to, back = (scalar.quantize_mu_law, scalar.dequantize_mu_law) if kind else (scalar.quantize_uniform, scalar.dequantize_uniform)
    mu = (scalar.MU,) if kind else ()
    rows = rows.withColumn("q", F.when(F.col("__pct").isNotNull(), to(F.col("__pct"), F.col("__c"), steps, *mu)))
    factor = F.lit(1.0) + F.coalesce(back(F.col("q"), F.col("__c"), steps, *mu), F.lit(0.0)) / 100.0
    if anchors:
        rows = rows.withColumn("__a", F.floor(F.col("t") / F.lit(anchors)))
        stretch = Window.partitionBy(*SERIES, "__a").orderBy("t")
        start, anchored = F.first("__v").over(stretch), F.col("t") % anchors == 0
        hat = start * F.product(F.when(anchored, 1.0).otherwise(factor)).over(stretch.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("__h", hat).withColumn("__h", F.when(anchored | (F.col("t") == F.col("__last")), F.col("__v")).otherwise(F.col("__h")))
    else:
        rows = rows.withColumn("__h", F.col("__b") * F.product(factor).over(series().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select(*SERIES, "t", "x", "q", (F.col("__h") - F.col("__o")).alias("x_hat"))


def neighbour_bytes(grid: DataFrame, params: DataFrame) -> DataFrame:
    """Entropy bytes of each grid's codes less those of the row above, in the order that ``row_pos`` gives.

    The first row, and codes whose row above is missing, stand for themselves.
    """
    above = Window.partitionBy("grid_id", "t").orderBy("row_pos")
    rows = grid.join(params.select(*SERIES, "row_pos"), list(SERIES))
    near = F.when(F.lag("row_pos").over(above) == F.col("row_pos") - 1, F.lag("q").over(above))
    counts = rows.withColumn("symbol", F.col("q") - F.coalesce(near, F.lit(0))).groupBy(*SERIES, "symbol").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*SERIES))
    return counts.withColumn("bits", -F.col("n") * F.log2(F.col("n") / total)).groupBy("grid_id").agg((F.sum("bits") / 8.0).alias("neighbour_bytes"))


def sweep(samples: DataFrame, configs: DataFrame) -> DataFrame:
    """rmse and bytes of the base variant for every row of ``configs`` (cfg_id, bits, clamp) in one job.

    The changes are computed once; the configurations, a handful of rows, are joined to them.
    """
    clean = sanitize(samples)
    pct = clean.withColumn("pct", scalar.pct_change_base(F.col("x"), F.lag("x").over(series()))).withColumn("baseline", F.first("x").over(series().rowsBetween(Window.unboundedPreceding, 0)))
    each = pct.crossJoin(F.broadcast(configs)).withColumn("steps", F.pow(F.lit(2.0), F.col("bits")) - 1.0)
    q = scalar.quantize_uniform(F.col("pct"), F.col("clamp"), F.col("steps"))
    back = each.withColumn("pct", scalar.dequantize_uniform(q, F.col("clamp"), F.col("steps")))
    along = Window.partitionBy("cfg_id", *SERIES).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rebuilt = back.withColumn("x_hat", F.col("baseline") * F.product(F.lit(1.0) + F.coalesce("pct", F.lit(0.0)) / 100.0).over(along))
    size = F.sum(F.when(F.col("bits") > 8, 2).otherwise(1)).cast("long")
    return rebuilt.groupBy("grid_id", "cfg_id", "bits", "clamp").agg(metrics.error_columns()["rmse"].alias("rmse"), size.alias("bytes"), F.count(F.lit(1)).alias("cells"))


def lattice_sweep(samples: DataFrame, eps: list[float], mode: str = "abs") -> DataFrame:
    """rmse, entropy bytes and escapes of the plain lattice for several bounds in one job."""
    clean = sanitize(samples)
    stats = profile.derive_scale(profile.var_profile(clean))
    steps = None
    for i, e in enumerate(eps):
        one = profile.derive_step(stats, e, mode).select(*SERIES, "q", "s", F.lit(i).alias("cfg_id"), F.lit(e).alias("eps"))
        steps = one if steps is None else steps.unionByName(one)
    y = scalar.asinh_scale(F.col("x"), F.col("s")) if mode == "rel" else F.col("x")
    m = clean.join(steps, list(SERIES)).withColumn("m", scalar.lattice_quantize(y, F.col("q")))
    hat = scalar.lattice_value(F.col("m"), F.col("q"))
    hat = scalar.asinh_scale_inv(hat, F.col("s")) if mode == "rel" else hat
    along = Window.partitionBy("cfg_id", *SERIES).orderBy("t")
    rows = m.withColumn("x_hat", hat).withColumn("r", F.col("m") - F.lag("m").over(along))
    key = ("cfg_id", "eps", *SERIES)
    cost = profile.row_cost(profile.residual_histogram(rows.filter("r is not null"), key), key).groupBy("cfg_id", "grid_id").agg(F.sum("cost").alias("bytes"))
    error = rows.groupBy("cfg_id", "eps", "grid_id").agg(metrics.error_columns()["rmse"].alias("rmse"), F.count_if(F.abs("r") > scalar.INLINE).alias("escapes"))
    return error.join(cost, ["cfg_id", "grid_id"])


def auto_tune_bits(samples: DataFrame, sample_steps: int = 512, target_rmse: float | None = None, clamp: float = 500.0) -> DataFrame:
    """bits (8 or 16) of each grid: all depths from 4 to 16 are tried at once on the first steps.

    The target is one percent of the mean magnitude unless given.  The smallest depth that meets it is rounded
    up to what is stored; where none does it is 16.
    """
    head = sanitize(samples.filter(F.col("t") < sample_steps))
    depths = head.sparkSession.range(4, 17).select(F.col("id").cast("int").alias("bits"), F.lit(clamp).alias("clamp"), F.col("id").alias("cfg_id"))
    tried = sweep(head, depths)
    goal = head.groupBy("grid_id").agg((F.avg(F.abs("x")) * 0.01).alias("goal"))
    if target_rmse is not None:
        goal = goal.withColumn("goal", F.lit(target_rmse))
    best = tried.join(goal, "grid_id").groupBy("grid_id").agg(F.min(F.when(F.col("rmse") <= F.col("goal"), F.col("bits"))).alias("least"), F.first("goal").alias("goal"))
    return best.select("grid_id", "least", "goal", F.when(F.col("least") <= 8, 8).otherwise(16).alias("bits"))


METHODS = (("base8", 8, None), ("base16", 16, None), ("adaptive8", 8, False), ("mulaw8", 8, True), ("mulaw16", 16, True), ("reordered8", 8, True))


def _compare_beside(samples: DataFrame) -> DataFrame:
    """``compare_methods`` of stored clean samples whose series fit a task: two reads of each method's rows, no joins of cells."""
    names = samples.select(*SERIES).distinct()
    by_name = keep(names.withColumn("row_pos", (F.row_number().over(Window.partitionBy("grid_id").orderBy("var")) - 1).cast("int")))
    several, out = by_name.filter("row_pos > 0").limit(1).count(), None
    samples = dealt(samples)
    for name, bits, kind in METHODS:
        order, rows = by_name, rebuilt_beside(samples, bits, kind)
        if several and name == "reordered8":
            shifted = enhanced_encode(samples, bits, mu_law=True, reorder=True, block=None)
            order = keep(shifted[1].select(*SERIES, "row_pos"))
        found = metrics.metrics(rows)
        if several:
            sizes = neighbour_bytes(rows.filter("q is not null"), order)
        else:  # one variable a grid: each code stands for itself
            counts = rows.filter("q is not null").groupBy("grid_id", "q").agg(F.count(F.lit(1)).alias("n"))
            bits_of = -F.col("n") * F.log2(F.col("n") / F.sum("n").over(Window.partitionBy("grid_id")))
            sizes = counts.withColumn("bits", bits_of).groupBy("grid_id").agg((F.sum("bits") / 8.0).alias("neighbour_bytes"))
        one = found.join(sizes, "grid_id", "left").withColumn("method", F.lit(name)).withColumn("bytes_per_cell", F.lit(1 if bits <= 8 else 2))
        out = one if out is None else out.unionByName(one)
    return out


def compare_methods(samples: DataFrame) -> DataFrame:
    """Metrics and sizes of the base variant and of adaptive, mu-law, reordered and 16-bit grids of the same data."""
    if bank.small(samples, variables=1):
        return whole.compared(samples, METHODS).select("grid_id", *whole.ERRORS, "neighbour_bytes", "method", "bytes_per_cell")
    block = block_for(samples)
    samples = keep(sanitize(samples, block))
    if block is None:
        return _compare_beside(samples)
    out = None
    for name, bits, kind in METHODS:
        if kind is None:
            grid, params = base_encode(samples, bits)
            grid, params = keep(grid), params.withColumn("row_pos", (F.row_number().over(Window.partitionBy("grid_id").orderBy("var")) - 1).cast("int"))
            hat = base_decode(grid, params.drop("row_pos"))
        else:
            grid, params, kept = enhanced_encode(samples, bits, mu_law=kind, reorder=name == "reordered8")
            grid, params = keep(grid), keep(params)
            hat = enhanced_decode(grid, params, kept, mu_law=kind, bits=bits)
        found = metrics.metrics(metrics.align(samples, hat, check=False)).join(neighbour_bytes(grid, params), "grid_id", "left")
        one = found.withColumn("method", F.lit(name)).withColumn("bytes_per_cell", F.lit(1 if bits <= 8 else 2))
        out = one if out is None else out.unionByName(one)
    return out


def estimated_bytes(samples: DataFrame, n_segments: int = 64) -> DataFrame:
    """Sizes without a byte coder: raw, delta of delta (varints), PAA, PLA and SAX coefficients."""
    counts = samples.groupBy("grid_id").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("var").alias("vars"))
    dd = sequence.delta_of_delta(samples).groupBy("grid_id").agg(F.sum(scalar.zigzag_varint_len(F.col("dd"))).alias("bytes"))
    segs = segments.with_segments(samples, n_segments).groupBy("grid_id").agg(F.count_distinct("var", "seg").alias("n"))
    # A float has no variable-length form: a delta takes as many bytes as a value.
    row = lambda df, method, c: df.select("grid_id", F.lit(method).alias("method"), c.cast("long").alias("bytes"))
    return (
        row(counts, "raw", F.col("cells") * 8).unionByName(row(counts, "delta", F.col("cells") * 8)).unionByName(row(dd, "delta_of_delta", F.col("bytes")))
        .unionByName(row(segs, "paa", F.col("n") * 8)).unionByName(row(segs, "pla", F.col("n") * 16)).unionByName(row(segs, "sax", F.col("n") * 4))
    )


def _sizes_of_file(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of one file of each kind."""
    names = ("grid_id", "method", "__file", "__text")
    parquet, gzip = whole.file_sizes((b.select([n for n in b.schema.names if n not in names]), "".join(b.column("__text").to_pylist())) for b in batches)
    yield pa.RecordBatch.from_pydict({"grid_id": [key[0].as_py()], "method": [key[1].as_py()], "parquet_bytes": [parquet], "gzip_bytes": [gzip]})


def stored_sizes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Bytes that each grid and method of ``rows`` (grid_id, method and ``columns``) takes in files, by kind of file.

    Kinds are ``parquet`` (zstd) and ``gzip`` (CSV as Spark writes it), a file for each method, grid and million steps.
  @@    """
    keys, cells = ["grid_id", "method", "__file"], ["var", "t", *columns]
    placed = rows.select("grid_id", "method", *cells, F.floor(F.col("t") / whole.FILE_STEPS).alias("__file"))
    placed = placed.repartition(*keys).sortWithinPartitions(*keys, "var", "t")
    lines = placed.withColumn("__text", F.concat(F.to_csv(F.struct(*cells)), F.lit("\n")))
    each = lines.groupBy(*keys).applyInArrow(_sizes_of_file, "grid_id string, method string, parquet_bytes long, gzip_bytes long")
    return each.groupBy("grid_id", "method").agg(F.sum("parquet_bytes").alias("parquet_bytes"), F.sum("gzip_bytes").alias("gzip_bytes"))


def compare_baselines(samples: DataFrame, n_segments: int = 64, files: bool = True) -> DataFrame:
    """Metrics and sizes of the segment summaries and lossless deltas on the same data.

    ``bytes`` is what the coefficients or codes take without a byte coder, ``parquet_bytes`` and ``gzip_bytes`` (with
    ``files``) what the method's numbers take in files; ``raw`` has sizes and no errors.
    """
    sized = ("parquet_bytes", "gzip_bytes") if files else ()
    if bank.small(samples):
        return whole.compared(samples, (), n_segments, files).select("grid_id", "method", "bytes", *sized, *whole.ERRORS)
    found, sizes = _baselines_joined(keep(sanitize(samples)), n_segments, files)
    columns = [c for c in found.columns if c not in ("grid_id", "method", "bytes")]
    both = found.join(sizes, ["grid_id", "method"], "full_outer") if files else found
    return both.select("grid_id", "method", "bytes", *sized, *columns)


def _baselines_joined(clean: DataFrame, n_segments: int, files: bool) -> tuple[DataFrame, DataFrame | None]:
    """Bytes and metrics, and sizes of files, of stored clean samples; coefficients are joined to cells, so grids may be of any size."""
    deltas = sequence.delta(clean)
    seconds = sequence.delta_of_delta(clean)
    delta_hat = sequence.undelta(deltas).select(*SERIES, "t", "x", "x_hat")
    dd_hat = sequence.undelta_of_delta(seconds).select(*SERIES, "t", "x", F.col("v_hat").cast("double").alias("x_hat"))
    methods = {"paa": segments.paa_expand(clean, n_segments), "pla": segments.pla_expand(clean, n_segments), "sax": segments.sax_expand(clean, n_segments, denormalize=True), "delta": delta_hat, "delta_of_delta": dd_hat}
    out = None
    for name, aligned in methods.items():
        one = metrics.metrics(aligned).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    found = estimated_bytes(clean, n_segments).join(out, ["grid_id", "method"], "full_outer")
    if not files:
        return found, None
    # The numbers that each method keeps: a segment's value once, a delta for each step.
    first = F.row_number().over(Window.partitionBy(*SERIES, "seg").orderBy("t")) == 1
    numbers = clean.select(F.lit("raw").alias("method"), *SERIES, "t", F.col("x").alias("v"))
    numbers = numbers.unionByName(deltas.select(F.lit("delta").alias("method"), *SERIES, "t", F.coalesce("d", "x").alias("v")))
    numbers = numbers.unionByName(seconds.select(F.lit("delta_of_delta").alias("method"), *SERIES, "t", F.col("dd").cast("double").alias("v")))
    cut = segments.with_segments(clean, n_segments).select(*SERIES, "t", "seg")
    for name in ("paa", "pla", "sax"):
        heads = cut.withColumn("__first", first).filter("__first").join(methods[name].select(*SERIES, "t", "x_hat"), [*SERIES, "t"])
        numbers = numbers.unionByName(heads.select(F.lit(name).alias("method"), *SERIES, "t", F.col("x_hat").alias("v")))
    return found, stored_sizes(numbers, ["v"])
