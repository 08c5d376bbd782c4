import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridloom.operators import lattice, profile, sequence
from gridloom.sources import synthetic, tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["lattice_p1_rel", "lattice_p1_abs", "lattice_grid", "residual_p2", "residual_ps", "residual_pl", "choose_predictor"])
def test_cells_are_shuffled_once(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_parts_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(tables, "LINES_OF_A_TASK", 100)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert tables.supplier_grid(spark, SF).rdd.getNumPartitions() == -(-lines // 100)


@pytest.mark.parametrize("mode", ["abs", "rel"])
def test_parameters_beside_are_those_of_the_table(spark, mode):
    s = synthetic.random_walks(spark, 3, 300, 7).withColumn("x", F.when(F.col("t") % 41 != 3, F.col("x")))
    grid, params = lattice.encode(s, 1e-3, mode, "p1", block=64)  # by blocks and joins
    one, beside = lattice.encode(s, 1e-3, mode, "p1", block=None)
    as_rows = lambda df, *c: sorted(map(tuple, df.select("grid_id", "var", *c).collect()))
    assert as_rows(grid, "t", "pixel", "esc") == as_rows(one, "t", "pixel", "esc")
    got, want = as_rows(beside, "q", "s", "m0"), as_rows(params, "q", "s", "m0")
    assert [r[:2] + r[4:] for r in got] == [r[:2] + r[4:] for r in want] and all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(got, want))
    back = lattice.decode_beside(lattice.encode_beside(s, 1e-3, mode), mode)
    assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in as_rows(back, "t", "x_hat")) == sorted((r[0], r[1], r[2], round(r[3], 9)) for r in as_rows(lattice.decode(one, beside, mode, "p1"), "t", "x_hat"))


def test_one_lag_for_all_is_that_lag_for_each(spark):
    m = synthetic.random_walks(spark, 2, 90, 5).withColumn("m", F.round("x").cast("long")).select("grid_id", "var", "t", "m")
    lags = m.select("grid_id", "var").distinct().withColumn("lag", F.lit(7))
    rows = lambda df: sorted(map(tuple, df.select("grid_id", "var", "t", "r").collect()), key=str)
    assert rows(sequence.residual_ps(m, 7)) == rows(sequence.residual_ps(m, lags))


def test_correlation_of_pairs_makes_no_join(spark):
    found = profile.correlation_pairs(tables.supplier_grid(spark, SF))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 1


def test_correlation_of_whole_grids_makes_no_join(spark):
    plan = profile.correlation_wide(tables.supplier_grid(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 1


def test_whole_grids_correlate_as_their_parts(spark):
    s = synthetic.random_walks(spark, 3, 300, 7).withColumn("x", F.when(F.col("t") % 41 != 3, F.col("x"))).filter("t % 7 <> length(var)")
    steps = profile.changes(s).localCheckpoint()
    found = []
    for rows, names in (profile.correlation_rows(steps), profile._rows_from_parts(steps)):
        rows = {(r["grid_id"], r["row"]): r["corr"] for r in rows.collect()}
        found.append((rows, sorted(map(tuple, names.collect()))))
    (a, one), (b, two) = found
    assert one == two and set(a) == set(b) and all(abs(x - y) < 1e-9 for k in a for x, y in zip(a[k], b[k], strict=True))
