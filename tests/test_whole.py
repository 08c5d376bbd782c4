import random

import pytest

import __spark_entry__
from gridloom.operators import percent, whole
from gridloom.operators.clean import sanitize
from gridloom.plans.durable import keep

SF = "/root/testdata/sf0.001"


def _rows(df):
    return {(r["grid_id"], r["method"]): r.asDict() for r in df.collect()}


def _same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1.0, abs(a)))


def test_whole_grids_have_the_numbers_of_cells(spark):
    rng = random.Random(3)
    x = lambda t, k: None if t % (13 + k) == 5 else float("nan") if t == 30 else round(rng.uniform(-9, 1e4), 2) * (k or 1e5)
    rows = [("a", "p", t, x(t, 0)) for t in range(400)] + [("b/1", f"v,{k}", t, x(t, k)) for k in range(3) for t in range(k, 150 + 9 * k, k + 1)]
    rows += [("c", "p", t, float(t % 7)) for t in range(999_990, 1_000_012)]  # two files
    rows += [("d", "p", t, 5.5) for t in range(20)] + [("e", "p", 0, 3.0), ("f", "p", 0, None), ("f", "p", 1, None)]
    s = keep(spark.createDataFrame(rows, "grid_id string, var string, t long, x double").repartition(3))
    found, sizes = percent._baselines_joined(keep(sanitize(s)), 8, True)
    want, got = _rows(found.join(sizes, ["grid_id", "method"])), _rows(percent.compare_baselines(s, 8))
    assert set(got) == set(want) and len(got) == 36
    for k, row in got.items():
        assert all(_same(row[c], want[k][c]) for c in row), (k, row, want[k])


def test_sizes_need_no_second_pass_over_cells(spark):
    plan = __spark_entry__.queries()["compare_baselines"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_numbers_beyond_64_bits_fail(spark):
    s = spark.createDataFrame([("a", "p", 0, 1.0), ("a", "p", 1, 1e19)], "grid_id string, var string, t long, x double")
    with pytest.raises(Exception, match="64 bits"):
        whole.compared(s, (), 4).collect()


def test_percent_grids_of_one_variable_have_the_numbers_of_cells(spark):
    rng = random.Random(4)
    rows = [(g, "p", t, None if t == 7 else round(rng.uniform(low, 1e3), 2)) for g, low in (("a", 1.0), ("b", -50.0)) for t in range(240)]
    rows += [("c", "p", t, 4.0) for t in range(9)] + [("d", "p", 0, 3.0)]
    s = keep(spark.createDataFrame(rows, "grid_id string, var string, t long, x double").repartition(3))
    want, got = _rows(percent._compare_beside(keep(sanitize(s)))), _rows(percent.compare_methods(s))
    assert set(got) == set(want) and len(got) == 4 * len(percent.METHODS)
    for k, row in got.items():
        assert all(_same(row[c], want[k][c]) for c in row), (k, row, want[k])


def test_methods_of_one_variable_make_no_join(spark):
    plan = __spark_entry__.queries()["compare_methods"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
