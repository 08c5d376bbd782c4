"""Row windows of a stream against the batch encoder, over several batches and a restart; alarms by rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.scalar import CENTER
from gridloom.operators import detect, frames, lattice
from gridloom.streaming import streams
from gridloom.streaming import windows as stream

SCHEMA = "grid_id string, var string, t long, x double, ts timestamp"
ROWS = 50


def series(n=220, seed=1):
    rng = random.Random(seed)
    out = []
    for v, start in (("a", 100.0), ("b", -3.0)):
        x = start
        for t in range(n):
            x += rng.gauss(0, 1) + (400 if t == 70 else 0)
            out.append(("g", v, t, None if t in (0, 60, 61) else 7.0 if v == "b" and t >= 150 else x, t))
    return out


def write(spark, rows, path, name):
    df = spark.createDataFrame([(g, v, t, x, s) for g, v, t, x, s in rows], "grid_id string, var string, t long, x double, s long")
    df.select("grid_id", "var", "t", "x", F.timestamp_seconds(F.col("s") + 1000).alias("ts")).coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def drain(spark, path, state, out, mode="abs", eps=1e-3):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    grids = stream.window_grids(source, ROWS, eps, mode, late="60 seconds", patience_ms=30_000)
    query = grids.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    query.stop()
    return spark.read.schema(grids.schema).parquet(out)


@pytest.mark.parametrize("mode", ["abs", "rel"])
def test_windows_over_batches_and_a_restart_equal_the_batch_encoder(spark, tmp_path, mode):
    rows = series()
    path, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    by_time = sorted(shuffled, key=lambda r: r[4] // 40)  # out of order within 40 steps
    write(spark, by_time[:170], path, "0")
    write(spark, by_time[170:200], path, "1")
    half = drain(spark, path, state, out, mode).count()
    assert 0 < half < 10
    write(spark, by_time[200:], path, "2")
    write(spark, [("tick", "a", 0, 1.0, 10_000)], path, "3")  # time goes on, short windows fall due
    got = drain(spark, path, state, out, mode).filter("grid_id not like 'tick%'")
    samples = spark.createDataFrame([r[:4] for r in rows], "grid_id string, var string, t long, x double")
    grid, params = lattice.encode(frames.row_windows(samples, ROWS), 1e-3, mode, "p1")
    mine, own = stream.as_grid(got)
    order = ["grid_id", "var", "t"]
    assert mine.orderBy(order).collect() == grid.select(mine.columns).orderBy(order).collect()
    for a, b in zip(own.orderBy(order[:2]).collect(), params.orderBy(order[:2]).collect(), strict=True):
        assert a["m0"] == b["m0"] and math.isclose(a["q"], b["q"], rel_tol=1e-12) and (a["s"] == b["s"] or math.isclose(a["s"], b["s"], rel_tol=1e-12))
    kinds = {(r["window"], r["full"], r["steps"]) for r in got.collect()}
    assert kinds == {(0, True, 50), (1, True, 50), (2, True, 50), (3, True, 50), (4, False, 20)}


def test_late_samples_are_counted(spark, tmp_path):
    rows = [("g", "a", t, float(t), t) for t in range(120)]
    path, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    write(spark, rows, path, "0")
    write(spark, [("g", "a", 3, 1.0, 118), ("g", "a", 49, 1.0, 119), *[("g", "a", t, 0.0, t) for t in range(120, 150)]], path, "1")
    got = {r["window"]: (r["late"], r["full"]) for r in drain(spark, path, state, out).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (2, True)}


def test_alarms_follow_the_rules_of_the_moment(spark, tmp_path):
    rows = series(200)
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    write(spark, [r for r in rows if r[2] < 100], path, "0")
    write(spark, [r for r in rows if r[2] >= 100], path, "1")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    cuts, seen = [2.0, 5.0], []

    def rules():
        return spark.createDataFrame([("p_mean", "above", cuts[min(len(seen), 1)])], "feature string, direction string, cut double")

    query = stream.alarm_each_batch(stream.window_grids(source, ROWS, 0.03, "rel"), rules, lambda df, n: seen.append(df.collect()), state)
    query.processAllAvailable()
    query.stop()
    samples = spark.createDataFrame([r[:4] for r in rows], "grid_id string, var string, t long, x double")
    cells = lattice.encode(frames.row_windows(samples, ROWS), 0.03, "rel", "p1")[0]
    r = F.when(F.col("esc").isNull(), F.col("pixel").cast("long") - CENTER).otherwise(127)
    features = detect.per_row_features(cells.select(F.col("grid_id").alias("win_id"), "var", F.col("t").alias("pos"), "pixel", r.alias("r")), wide=False)
    want = {(f["win_id"], f["var"]): f["p_mean"] for f in features.collect()}
    got = {(a["win_id"], a["var"]): a for batch in seen for a in batch}
    assert set(got) == set(want) and len(want) == 8
    for k, a in got.items():
        assert math.isclose(a["v"], want[k], rel_tol=1e-9) and a["alarm"] == (a["v"] > a["cut"])
    assert {a["cut"] for a in seen[0]} == {2.0} and {a["cut"] for b in seen[1:] for a in b} <= {5.0}


def test_residuals_of_a_stream_by_blocks(spark, tmp_path):
    rows = [("g", v, t, float((t * 7919 + k) % 1013)) for k, v in enumerate(("hot", "b")) for t in range(0, 900 if v == "hot" else 60, 2 - k)]
    rows += [("g", "late", 1000, 5.0), ("g", "hot", 1000, None), ("g", "hot", 1001, float("nan")), ("g", "hot", 1002, float("inf"))]
    s = spark.createDataFrame(rows, "grid_id string, var string, t long, x double")
    wanted, last, totals = [], {}, {}
    for _, v, t, x in sorted((r for r in rows if r[3] is not None and abs(r[3]) < 1e300), key=lambda r: r[2]):
        m = round(x / 0.5)
        r = m - last.get(v, m)
        last[v] = m
        totals[v] = (totals.get(v, (0, 0))[0] + 1, totals.get(v, (0, 0))[1] + (abs(r) > 126))
        wanted.append((v, t, m, r))
    folder = str(tmp_path / "run")
    for lo, hi in ((0, 200), (200, 333), (333, 2000)):  # a new run of the query each time
        s.filter((F.col("t") >= lo) & (F.col("t") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streams.stream_encode(stream, 0.5, folder, block=16).awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    assert sorted(tuple(r) for r in out.select("var", "t", "m", "r").collect()) == sorted(wanted)
    final = {r["var"]: (r["rows"], r["escapes"]) for r in out.groupBy("var").agg(F.max("rows").alias("rows"), F.max("escapes").alias("escapes")).collect()}
    assert final == totals
