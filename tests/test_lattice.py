"""Guarantees of the lattice grid: bounds at any length, escapes, seasons, dead zone, gaps, exact round trips."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import clean, lattice, metrics, profile, sequence
from gridloom.operators.frames import SAMPLES, SERIES
from gridloom.plans import blockscan
from gridloom.plans.durable import keep
from gridloom.sources import files, synthetic


def samples(spark, series: dict[str, list]):
    rows = [("g", v, t, None if x is None else float(x)) for v, xs in series.items() for t, x in enumerate(xs)]
    return spark.createDataFrame(rows, SAMPLES)


def bound(spark, s, eps, mode, predictors, **kw):
    grid, params = lattice.encode(s, eps, mode, predictors, **kw)
    params = keep(params)
    aligned = metrics.align(clean.sanitize(s), lattice.decode(keep(grid), params, mode))
    return metrics.verify_bound(aligned, params.select(*SERIES, "q", "s"), eps, mode, kw.get("tau", 0.0)).first()


def mixed(spark, n=400):
    walks = synthetic.random_walks(spark, 2, n, 3, 1.0)
    sines = synthetic.zero_crossing_signals(spark, n).filter("grid_id <> 'walk'").withColumn("var", F.col("grid_id"))
    flat = walks.filter("var = 'v0000'").withColumn("var", F.lit("flat")).withColumn("x", F.lit(42.0))
    return keep(walks.unionByName(sines).unionByName(flat).withColumn("grid_id", F.lit("g")))


@pytest.mark.parametrize(("mode", "predictors", "eps"), [("abs", "p1", 1e-2), ("abs", "bank", 1e-3), ("rel", "p1", 1e-3), ("rel", "bank", 1e-2)])
def test_bound(spark, mode, predictors, eps):
    got = bound(spark, mixed(spark), eps, mode, predictors, max_lag=64)
    assert got["violations"] == 0 and got["cells"] == 6 * 400


def test_bank_decode_is_exact_with_all_predictors(spark):
    n = 600
    season = [round(50 + 40 * math.sin(2 * math.pi * t / 37) + 15 * math.sin(2 * math.pi * t / 5.3)) for t in range(n)]
    base = [((t * 7919) % 1013) / 3.0 for t in range(n)]
    s = samples(spark, {"a": base, "b": [x + 0.01 * (t % 3) for t, x in enumerate(base)], "c": season, "d": [t * t / 50.0 for t in range(n)]})
    grid, params = lattice.encode(s, 1e-3, "abs", "bank", max_lag=128)
    params = keep(params)
    m = lattice.coordinates(s, params.select(*SERIES, "q", "s"))
    back = lattice.decode_coordinates(keep(grid), params).withColumnRenamed("m", "m2")
    both = m.join(back, [*SERIES, "t"])
    assert both.count() == 4 * n and both.filter("m <> m2").count() == 0
    assert len({r["pred"] for r in params.collect()}) >= 3


def test_no_drift_over_a_long_walk(spark):
    s = synthetic.random_walks(spark, 1, 50_000, 1, block=5_000)
    got = bound(spark, keep(s), 1e-4, "abs", "p1")
    assert got["violations"] == 0 and got["worst_steps"] <= 0.5 + 1e-6


def test_spikes_escape(spark):
    xs = [100.0 + 0.1 * (t % 7) for t in range(2000)]
    xs[500] += 1e6
    xs[1500] -= 5e5
    s = samples(spark, {"v": xs})
    grid, params = lattice.encode(s, 1e-3, "abs", "p1")
    assert lattice.escape_count(grid).first()["escapes"] >= 2
    assert bound(spark, s, 1e-3, "abs", "p1")["violations"] == 0


def test_missing_values_are_filled(spark):
    s = samples(spark, {"a": [None, None, 3.0, float("nan"), 5.0, float("inf")], "b": [None] * 6})
    got = {(r["var"], r["t"]): r["x"] for r in clean.sanitize(s).collect()}
    assert [got["a", t] for t in range(6)] == [3.0, 3.0, 3.0, 3.0, 5.0, 5.0] and all(got["b", t] == 0.0 for t in range(6))
    assert bound(spark, s, 1e-2, "abs", "bank")["violations"] == 0


def test_one_step_and_constants(spark):
    s = samples(spark, {"a": [5.0], "b": [7.0]})
    grid, params = lattice.encode(s, 1e-3, "abs", "p1")
    assert {(r["var"], round(r["x_hat"], 2)) for r in lattice.decode(grid, params).collect()} == {("a", 5.0), ("b", 7.0)}
    flat = samples(spark, {"z": [0.0] * 50, "c": [-7.5] * 50})
    assert bound(spark, flat, 1e-3, "abs", "bank")["violations"] == 0


def test_dead_zone(spark):
    s = keep(synthetic.random_walks(spark, 1, 3000, 5, 0.01))
    assert bound(spark, s, 1e-3, "abs", "p1", tau=1.5)["violations"] == 0
    assert bound(spark, s, 1e-3, "abs", "p1", tau=1.5, restart_block=500)["violations"] == 0
    moves = lambda tau: lattice.encode(s, 1e-3, "abs", "p1", tau=tau)[0].filter("pixel <> 128").count()
    assert moves(1.5) <= moves(0.0)


def test_block_scans_equal_plain_windows(spark):
    s = keep(synthetic.random_walks(spark, 2, 1000, 9, 1.0).withColumn("m", F.rint(F.col("x") * 100).cast("long")))
    for kind, x in (("sum", F.col("m")), ("last", F.when(F.col("t") % 7 == 0, F.col("m")))):
        a = blockscan.running(s, kind, x, "y")
        b = blockscan.running(s, kind, x, "z", block=64)
        assert a.join(b, [*SERIES, "t"]).filter("not (y <=> z)").count() == 0
    a, b = blockscan.lagged(s, F.col("m"), "y"), blockscan.lagged(s, F.col("m"), "z", block=64)
    assert a.join(b, [*SERIES, "t"]).filter("not (y <=> z)").count() == 0
    f = F.lit(1.0) + F.col("m") / 1e9
    a, b = blockscan.running(s, "product", f, "y"), blockscan.running(s, "product", f, "z", block=64)
    assert a.join(b, [*SERIES, "t"]).filter("abs(y - z) > 1e-9 * abs(y)").count() == 0


def test_seasonal_lag(spark):
    s = samples(spark, {"s": [100 + 10 * math.sin(2 * math.pi * t / 24) for t in range(480)], "n": [((t * 7919) % 1013) for t in range(480)]})
    lags = {r["var"]: r["lag"] for r in profile.seasonal_lag(profile.autocorrelation(s, "x", 100, block=90)).collect()}
    assert lags["s"] % 24 == 0


def test_written_grid_reads_back(spark, tmp_path):
    s = keep(mixed(spark, 200))
    grid, params = lattice.encode(s, 1e-3, "abs", "p1")
    files.write_grid(grid, params, str(tmp_path / "g"), "abs", 1e-3, 64)
    back, p2, head = files.read_grid(spark, str(tmp_path / "g"))
    assert back.exceptAll(grid.select(back.columns)).count() == 0 and back.count() == grid.count()
    assert head.first()["n_vars"] == 6 and p2.count() == 6


def test_relative_row_without_a_head_fails(spark):
    rows = spark.createDataFrame([("g", 0, 1, True, 5)], "grid_id string, row_pos int, t long, pl boolean, r long")
    with pytest.raises(Exception, match="no row before"):
        sequence.accumulate_pl(rows).collect()


def test_shapes_must_match(spark):
    s = samples(spark, {"a": [1.0, 2.0]})
    with pytest.raises(Exception, match="differ in shape"):
        metrics.align(s, s.filter("t = 0").withColumn("x_hat", F.col("x"))).collect()
