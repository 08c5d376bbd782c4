"""Ways for tables too long for a task: numbering, selection of percentiles, block scan in encode and decode."""

import random

import numpy as np

from pyspark.sql import functions as F

from gridloom.operators import detect, lattice, metrics, percent, profile, quantiles, sequence
from gridloom.plans import numbering
from gridloom.plans.durable import keep

FRACTIONS = {"a": 0.5, "b": 0.995, "c": 0.0, "d": 1.0, "e": 0.123}


def hard(spark):
    """Groups with ties, one value, two values, nulls alone, a null key, and sizes over 17 powers of ten."""
    x = F.when(F.col("id") % 7 == 0, 0.0).when(F.col("id") % 11 == 0, None).otherwise(F.exp(F.rand(1) * 40 - 20) * F.when(F.rand(2) < 0.5, -1).otherwise(1))
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 2).cast("string")).alias("k"), x.alias("x"))
    for name, n, value in (("none", 10, F.lit(None)), ("one", 5000, F.lit(5.0)), ("two", 5001, F.col("id") > 2500)):
        rows = rows.unionByName(spark.range(n).select(F.lit(name).alias("k"), value.cast("double").alias("x")))
    return keep(rows)


def test_selected_percentiles_equal_the_sorted_ones(spark):
    rows = hard(spark)
    for keys in (["k"], []):
        want = rows.groupBy(*keys).agg(*[F.percentile("x", F.lit(p)).alias(n) for n, p in FRACTIONS.items()])
        for small in (10, 500):
            got = quantiles.percentiles(rows, keys, F.col("x"), FRACTIONS, small=small, precision=1000)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    empty = quantiles.percentiles(rows.limit(0), [], F.col("x"), {"a": 0.5}, small=-1).collect()
    assert [r["a"] for r in empty] == [None]


def test_profile_of_long_series_is_the_same(spark, monkeypatch):
    rng = random.Random(2)
    s = keep(spark.createDataFrame([("g", v, t, rng.gauss(0, 3)) for v in "ab" for t in range(3000)], "grid_id string, var string, t long, x double"))
    pct = s.withColumn("pct", F.col("x"))
    want = profile.var_profile(s).orderBy("var").collect(), profile.adaptive_clamp(pct).orderBy("var").collect()
    monkeypatch.setattr(profile, "few_rows", lambda *_: False)
    monkeypatch.setattr(quantiles.percentiles, "__defaults__", (100, 1000))
    got = profile.var_profile(s).orderBy("var"), profile.adaptive_clamp(pct).orderBy("var")
    assert (got[0].select(list(want[0][0].asDict())).collect(), got[1].collect()) == want


def test_numbers_over_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), F.lit(1).alias("same"), "id").repartition(5)
    got = numbering.numbered(df, ["a", "id"], partitions=6).orderBy("t").collect()
    assert [r["t"] for r in got] == list(range(5000)) and [(r["a"], r["id"]) for r in got] == sorted((r["a"], r["id"]) for r in got)
    tied = numbering.numbered(df, ["same"], "n", partitions=6)
    assert sorted(r["n"] for r in tied.collect()) == list(range(5000))
    assert numbering.numbered(df.limit(0), ["a"]).count() == 0
    # One value in all rows still makes several ranges.
    ranged = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(6, "same", "tie")
    assert ranged.select(F.spark_partition_id().alias("p")).distinct().count() > 3


def test_file_order_over_many_blocks(spark, tmp_path):
    path = str(tmp_path / "csv")
    spark.range(3000).select("id", (F.col("id") * 2).alias("b")).repartitionByRange(3, "id").sortWithinPartitions("id").write.option("header", True).csv(path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        scan = spark.read.options(header=True, inferSchema=True).csv(path)
        got = numbering.in_file_order(scan).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 3000 and all(r["__line"] == r["id"] for r in got)


def test_composite_path_by_blocks(spark):
    """The block scan of encode and decode gives the grid and values of the plain windows."""
    rng = random.Random(3)
    rows = []
    for v in "ab":
        x = 100.0
        for t in range(1200):
            x += rng.gauss(0, 1)
            rows.append(("g", v, t, None if t in (0, 500, 501, 1199) else x))
    s = keep(spark.createDataFrame(rows, "grid_id string, var string, t long, x double"))
    for mode in ("abs", "rel"):
        plain, params = lattice.encode(s, 1e-3, mode, "p1", block=None)
        cut, cut_params = lattice.encode(s, 1e-3, mode, "p1", block=100)
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))
        assert sorted(map(str, params.collect())) == sorted(map(str, cut_params.collect()))
        whole = lattice.decode(plain, params, mode, "p1", block=None).orderBy("var", "t").collect()
        assert lattice.decode(cut, cut_params, mode, "p1", block=77).orderBy("var", "t").collect() == whole
    bank = lattice.encode(s, 1e-3, "abs", "bank", block=100)
    checked = metrics.verify_bound(metrics.align(s.filter("x is not null"), lattice.decode(*bank, block=100), check=False), bank[1].select("grid_id", "var", "q", "s"), 1e-3).first()
    assert checked["violations"] == 0 and checked["cells"] == 2392


def test_ranks_of_few_large_groups(spark):
    rows = [(f"w{i}", float(i % 5), float(-i)) for i in range(200)]
    got = {r["win_id"]: r["score"] for r in detect.rank_ensemble(spark.createDataFrame(rows, "win_id string, a double, b double")).collect()}
    by_a = sorted(rows, key=lambda r: (r[1], r[0]))
    by_b = sorted(rows, key=lambda r: (r[2], r[0]))
    want = {r[0]: (by_a.index(r) + by_b.index(r)) / 200 for r in rows}
    assert all(abs(got[w] - want[w]) < 1e-12 for w in want)


def one_walk(y, q, tau):
    """The dead zone's level step by step."""
    level, out = None, []
    for v in y:
        if level is None or abs(v - level * q) >= tau * q:
            level = round(v / q)
        out.append(level)
    return out


def test_dead_zone_by_blocks_is_one_walk(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for var, step in (("calm", 0.05), ("rough", 2.0), ("flat", 0.0), ("jumpy", 30.0)):
        x, y = 10.0, []
        for t in range(700):
            x += rng.gauss(0, step)
            y.append(x if t % 97 else x + 40)
        want[var] = y
        rows += [("g", var, t, v, 0.7) for t, v in enumerate(y)]
    df = keep(spark.createDataFrame(rows, "grid_id string, var string, t long, y double, q double").repartition(3))
    for tau, block in ((1.5, 64), (0.75, 7), (3.2, 100), (1.5, 5000)):
        got = {}
        for r in sequence.deadzone_lattice(df, tau, block=block).orderBy("var", "t").collect():
            got.setdefault(r["var"], []).append(r["m"])
        assert got == {v: one_walk(y, 0.7, tau) for v, y in want.items()}, (tau, block)


def test_correlations_of_many_variables(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(6, 300)).cumsum(axis=1)
    rows = [("g", f"v{i:03d}", t, float(base[i % 6, t] + 0.3 * rng.normal()) if (i, t) != (3, 40) else None) for i in range(40) for t in range(300) if not (i == 5 and t > 200)]
    rows += [("g", "w_flat", t, 1.0) for t in range(300)] + [("h", v, t, float(t * (v == "a"))) for v in "ab" for t in range(9)]
    s = keep(spark.createDataFrame(rows, "grid_id string, var string, t long, x double").repartition(4))
    pairs = {(r["grid_id"], r["a"], r["b"]): r["corr"] for r in profile.correlation_pairs(s).collect()}
    wide = {(r["grid_id"], r["a"], r["b"]): r["corr"] for r in profile.correlation_wide(s).collect()}
    assert set(pairs) == set(wide) and all(abs(pairs[k] - wide[k]) < 1e-9 for k in pairs)
    a = lattice.order_variables(profile.correlation_pairs(s)).orderBy("grid_id", "row_pos").collect()
    assert lattice.walked_order(profile.changes(s)).select("grid_id", "var", "row_pos").orderBy("grid_id", "row_pos").collect() == a


def test_two_thousand_variables_in_memory(spark):
    wide = spark.range(24).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(2047)))).select(F.lit("g").alias("grid_id"), F.format_string("v%04d", "v").alias("var"), F.col("id").alias("t"), (F.sin(F.col("id") * (F.col("v") % 7 + 1)) + F.rand(3) / 10).alias("d"))
    order = lattice.walked_order(keep(wide)).orderBy("row_pos").collect()
    assert [r["row_pos"] for r in order] == list(range(2048)) and len({r["var"] for r in order}) == 2048
    kind = [int(r["var"][1:]) % 7 for r in order]
    assert sum(a != b for a, b in zip(kind, kind[1:])) < 40  # like stands by like


def test_autocorrelation_equals_sums_at_each_lag(spark):
    rng = np.random.default_rng(7)
    x = (np.sin(np.arange(900) / 5) * 9 + rng.normal(size=900)).cumsum()
    s = spark.createDataFrame([("g", "a", t, float(v)) for t, v in enumerate(x)], "grid_id string, var string, t long, x double")
    d = np.diff(x) - np.diff(x).mean()
    want = [float(np.dot(d[: len(d) - k], d[k:]) / np.dot(d, d)) for k in range(200)]
    for block in (50_000, 128):
        got = [r["ac"] for r in profile.autocorrelation(s, max_lag=200, block=block).orderBy("lag").collect()]
        assert np.allclose(got, want, atol=1e-9)


def test_reordered_grid_keeps_its_values(spark):
    rng = np.random.default_rng(8)
    base = 100 + rng.normal(size=(2, 400)).cumsum(axis=1)
    s = keep(spark.createDataFrame([("g", f"v{i}", t, float(base[i % 2, t] * (1 + i))) for i in range(6) for t in range(400)], "grid_id string, var string, t long, x double"))
    plain = percent.enhanced_encode(s, 8)
    moved = percent.enhanced_encode(s, 8, reorder=True)
    assert sorted(map(tuple, plain[0].collect())) == sorted(map(tuple, moved[0].collect()))
    kind = [int(r["var"][1:]) % 2 for r in moved[1].orderBy("row_pos").collect()]
    assert sum(a != b for a, b in zip(kind, kind[1:])) == 1
    sizes = [percent.neighbour_bytes(p[0], p[1]).first()["neighbour_bytes"] for p in (plain, moved)]
    assert sizes[1] < sizes[0]
    hat = [percent.enhanced_decode(*p, bits=8).orderBy("var", "t").collect() for p in (plain, moved)]
    assert hat[0] == hat[1]


def test_stored_sizes_of_all_methods(spark):
    s = spark.createDataFrame([(g, v, t, 100.0 + (t * 37 % 11)) for g in ("a", "b/1 c") for v in "xy" for t in range(300)], "grid_id string, var string, t long, x double")
    got = percent.compare_baselines(s, 16).collect()
    methods = {"raw", "delta", "delta_of_delta", "paa", "pla", "sax"}
    assert {(r["grid_id"], r["method"]) for r in got} == {(g, m) for g in ("a", "b/1 c") for m in methods}
    assert all(r["bytes"] > 0 and r["parquet_bytes"] > 0 and r["gzip_bytes"] > 0 for r in got)
    by = {(r["grid_id"], r["method"]): r for r in got}
    assert by["a", "paa"]["gzip_bytes"] < by["a", "raw"]["gzip_bytes"]


def test_neighbours_by_pivots_are_exact_and_compare_less(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 4)) * 20
    x = np.vstack([centres[i % 12] + rng.normal(size=4) for i in range(480)] + [np.zeros((20, 4))])
    f = keep(spark.createDataFrame([(f"w{i:03d}", *map(float, row)) for i, row in enumerate(x)], "win_id string, a double, b double, c double, e double"))
    want = {r["win_id"]: r["score"] for r in detect.local_outlier_factor(f, k=6).collect()}
    pairs = [detect.pairs_compared(f, 6, 1)]
    for cells, pivots in ((8, 1), (27, 3)):
        got = {r["win_id"]: r["score"] for r in detect.local_outlier_factor(f, k=6, cells=cells, pivots=pivots).collect()}
        assert all(abs(got[w] - want[w]) <= 1e-9 * want[w] for w in want) and len(got) == 500
        pairs.append(detect.pairs_compared(f, 6, cells, pivots))
    assert pairs[0] == 500 * 500 and pairs[0] > pairs[1] > pairs[2]


def test_percent_grids_by_blocks(spark):
    rng = random.Random(11)
    s = keep(spark.createDataFrame([("g", v, t, 50 + rng.random() * 9 + (0 if v == "a" else -52)) for v in "ab" for t in range(500)], "grid_id string, var string, t long, x double"))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(percent.base_encode(s, 8, block=None)[0], percent.base_encode(s, 8, block=64)[0])
    plain, cut = percent.enhanced_encode(s, 8, block=None), percent.enhanced_encode(s, 8, block=64)
    assert all(same(a, b) for a, b in zip(plain, cut, strict=True))
    whole = {(r["var"], r["t"]): r["x_hat"] for r in percent.enhanced_decode(*plain, bits=8, block=None).collect()}
    assert all(abs(whole[r["var"], r["t"]] - r["x_hat"]) < 1e-6 for r in percent.enhanced_decode(*cut, bits=8, block=50).collect())
