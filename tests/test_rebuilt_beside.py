import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import percent
from gridloom.sources import synthetic


@pytest.mark.parametrize("kind,anchors", [(None, 0), (False, 0), (True, 0), (True, 50)])
def test_rebuilt_beside_is_what_the_decoder_gives(spark, kind, anchors):
    s = synthetic.random_walks(spark, 2, 230, 3).withColumn("x", F.col("x") - F.when(F.col("var") > "v", 5.0).otherwise(0.0)).localCheckpoint()
    if kind is None:
        hat = percent.base_decode(*percent.base_encode(s, 16))
    else:
        hat = percent.enhanced_decode(*percent.enhanced_encode(s, 16, mu_law=kind, anchors=anchors), mu_law=kind, anchors=anchors)
    want = {(r["grid_id"], r["var"], r["t"]): r["x_hat"] for r in hat.collect()}
    rows = percent.rebuilt_beside(s, 16, kind, anchors=anchors)
    got = {(r["grid_id"], r["var"], r["t"]): r["x_hat"] for r in rows.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_stored_samples_are_dealt_by_their_number(spark):
    from gridloom.operators import frames

    s = synthetic.random_walks(spark, 2, 500, 3)
    assert frames.dealt(s, 100).rdd.getNumPartitions() == -(-s.count() // 100)
