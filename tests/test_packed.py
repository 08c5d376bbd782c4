import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import detect, frames, packed
from gridloom.sources import synthetic
from gridloom.sources.tables import supplier_grid, supplier_lines

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def rows(df, *key):
    return {tuple(r[k] for k in key): {c: v for c, v in r.asDict().items() if c not in key} for r in df.collect()}


@pytest.fixture(scope="module")
def both(spark):
    long = synthetic.random_walks(spark, 3, 420, 11, 0.2)
    names = [r[0] for r in long.select("var").distinct().orderBy("var").collect()]
    wide = frames.to_wide(long, names)
    return detect.labeled_windows(frames.sliding_windows(long).drop("grid_id")), detect.labeled_windows(packed.windows(wide, names))


def close(a, b):
    assert a.keys() == b.keys() and a
    for k in a:
        assert a[k].keys() == b[k].keys()
        for c in a[k]:
            x, y = a[k][c], b[k][c]
            assert (x is None and y is None) or math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6), (k, c, x, y)


@pytest.mark.parametrize("f", [detect.grid_features, detect.trajectory_features, detect.image_features, detect.simple_features, detect.per_row_features, detect.grid_and_trajectory_features])
@pytest.mark.parametrize("mode", ["abs", "rel"])
def test_packed_windows_have_the_features_of_long_ones(both, f, mode):
    close(*(rows(f(detect.window_grid(w, 0.03, mode)), "win_id") for w in both))


def test_numbers_of_packed_windows_with_anomalies(both):
    close(*(rows(detect.numeric_features(w, wide=False), "win_id", "var") for w in both))


def test_packed_windows_shuffle_line_items_only(spark):
    names = ["l_quantity", "l_tax"]
    f = detect.grid_features(detect.window_grid(detect.labeled_windows(packed.windows(supplier_lines(spark, SF, names), names)), 0.03, "abs"))
    assert exchanges(f) == 1
    assert exchanges(supplier_grid(spark, SF).groupBy("grid_id", "var").agg(F.max("x"))) == 1
    assert f.count() > 0


def test_gaps_are_seen(spark):
    assert packed.gaps(spark.createDataFrame([(1.0, None), (2.0, 1.0)], "a double, b double"), ["a", "b"])
    assert packed.gaps(spark.createDataFrame([(float("nan"), 1.0)], "a double, b double"), ["a", "b"])
    assert not packed.gaps(spark.createDataFrame([(1.0, 1.0)], "a double, b double"), ["a", "b"])
