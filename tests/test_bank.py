"""The predictor bank on packed grids: the choices and cells of the joins, exact cells back, one shuffle."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridloom.operators import bank, lattice
from gridloom.plans.durable import keep
from gridloom.sources import synthetic

SF = "/root/testdata/sf0.001"


def mixed(spark, n=400):
    rows = []
    for g in ("g", "h"):
        base = [((t * 7919) % 1013) / 3.0 for t in range(n)]
        series = {"a": base, "b": [x + 0.01 * (t % 3) for t, x in enumerate(base)], "d": [t * t / 50.0 for t in range(n)], "e": [7.0] * n, "f": [1.0 * (t == 9) for t in range(n)]}
        series["c"] = [round(50 + 40 * math.sin(2 * math.pi * t / 37) + 15 * math.sin(2 * math.pi * t / 5.3)) for t in range(n)]
        rows += [(g, v, t, float(x)) for v, xs in series.items() for t, x in enumerate(xs)]
    walks = synthetic.random_walks(spark, 3, n, 3, 1.0).withColumn("grid_id", F.lit("g"))
    return keep(spark.createDataFrame(rows, "grid_id string, var string, t long, x double").unionByName(walks))


@pytest.mark.parametrize("mode", ["abs", "rel"])
def test_packed_grids_are_those_of_joined_cells(spark, mode):
    s = mixed(spark)
    as_rows = lambda df, *c: sorted(map(tuple, df.select("grid_id", "var", *c).collect()))
    grid, params = lattice.encode(s, 1e-3, mode, "bank", max_lag=128, block=10_000)  # by blocks and joins
    one, beside = lattice.encode(s, 1e-3, mode, "bank", max_lag=128)
    assert as_rows(beside, "pred", "lag", "row_pos", "m0") == as_rows(params, "pred", "lag", "row_pos", "m0")
    assert sorted(map(str, grid.select("grid_id", "var", "t", "pixel", "esc").collect())) == sorted(map(str, one.collect()))
    assert mode == "rel" or {r["pred"] for r in params.collect()} == {0, 1, 2, 3}
    packed = bank.encode_rows(lattice.beside(s, 1e-3, mode), 128)
    hat = {(r[0], r[1], r[2]): r[3] for r in as_rows(lattice.decode(keep(one), keep(beside), mode), "t", "x_hat")}
    back = {(r[0], r[1], r[2]): r[3] for r in as_rows(bank.decode_rows(packed, mode), "t", "x_hat")}
    assert back.keys() == hat.keys() and all(math.isclose(back[k], hat[k], rel_tol=1e-12) for k in hat)


def test_only_whole_grids_are_packed(spark):
    s = mixed(spark, 30)
    assert bank.whole(s) and bank.small(s) and not bank.small(s, 100)
    assert not bank.whole(s.filter("not (grid_id = 'h' and var = 'a' and t = 7)")) and not bank.whole(s.filter("t > 0")) and not bank.whole(s.filter("var <> 'a' or t < 5"))
    assert not bank.whole(s.filter("false"))
    assert lattice.encode(s.filter("t = 0"), 1e-3)[1].filter("pred = 0 and lag = 1").count() == s.filter("t = 0").count()


def test_bank_roundtrip_shuffles_cells_once(spark):
    plan = __spark_entry__.queries()["lattice_bank_roundtrip"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 2  # line items, and a row of totals for each series of a task
