"""Percent grids, segments, deltas, files, windows, runs, detection and streams."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import clean, detect, frames, metrics, percent, profile, runs, segments, sequence
from gridloom.operators.frames import SAMPLES, SERIES
from gridloom.plans.durable import keep
from gridloom.sources import files, synthetic
from gridloom.streaming.streams import encode_each_batch


def samples(spark, series):
    return spark.createDataFrame([("g", v, t, float(x)) for v, xs in series.items() for t, x in enumerate(xs)], SAMPLES)


def rmse(s, hat):
    return metrics.metrics(metrics.align(clean.sanitize(s), hat)).first()["rmse"]


def test_tiny_base_grid(spark):
    s = samples(spark, {"a": [100, 101, 99], "b": [50, 50.5, 49]})
    assert rmse(s, percent.base_decode(*percent.base_encode(s, 16))) <= 5e-3 * 10
    assert rmse(s, percent.base_decode(*percent.base_encode(s, 8))) < 5
    with pytest.raises(ValueError, match="bits"):
        percent.base_encode(s, 9)


def test_enhanced_beats_base_across_scales(spark):
    s = keep(synthetic.workload(spark, "multi_scale", 5, 100, 1))
    base = rmse(s, percent.base_decode(*percent.base_encode(s, 8)))
    enhanced = rmse(s, percent.enhanced_decode(*percent.enhanced_encode(s, 16)))
    assert enhanced * 10 <= base


def test_anchors_lower_the_error(spark):
    s = keep(synthetic.workload(spark, "sensor", 3, 500, 2))
    plain = rmse(s, percent.enhanced_decode(*percent.enhanced_encode(s, 8, mu_law=False), mu_law=False, bits=8))
    kept = rmse(s, percent.enhanced_decode(*percent.enhanced_encode(s, 8, mu_law=False, anchors=50), mu_law=False, anchors=50, bits=8))
    assert kept < plain


def test_log_grid_of_positive_series(spark):
    s = keep(synthetic.workload(spark, "financial", 2, 300, 4))
    assert rmse(s, percent.enhanced_decode(*percent.enhanced_encode(s, 16, mu_law=False, log=True), mu_law=False, log=True)) < 1.0


def test_auto_offset_equals_manual_shift(spark):
    s = samples(spark, {"a": [3.0 * math.sin(t / 5) - (200.0 if t % 97 == 50 else 0.0) for t in range(300)]})
    offset = clean.auto_offset(s).first()["value_offset"]
    shifted = s.withColumn("x", F.col("x") + offset)
    a = rmse(s, percent.enhanced_decode(*percent.enhanced_encode(s, 16)))
    b = rmse(shifted, percent.enhanced_decode(*percent.enhanced_encode(shifted, 16, offset=False)))
    assert offset > 0 and abs(a - b) < 1e-6 * max(a, 1)


def test_mu_law_and_escapes_invert(spark):
    df = spark.range(-300, 301).select((F.col("id") / 100.0).alias("x"), F.col("id").alias("r"))
    back = df.select(F.abs(scalar.mu_law_inv(scalar.mu_law(F.col("x"))) - F.col("x")).alias("e"), (scalar.residual(scalar.pixel(F.col("r")), scalar.escaped(F.col("r"))) == F.col("r")).alias("same"))
    assert back.agg(F.max("e")).first()[0] < 1e-9 and back.filter("not same").count() == 0


def test_varint_lengths(spark):
    values = [0, 1, -1, 63, -64, 64, -65, 8191, -8192, 8192, 1 << 40]

    def length(v):
        z, n = (v << 1) ^ (v >> 63), 1
        while z >= 128:
            z, n = z >> 7, n + 1
        return n

    got = spark.createDataFrame([(v,) for v in values], "v long").select(scalar.zigzag_varint_len(F.col("v"))).collect()
    assert [r[0] for r in got] == [length(v) for v in values]


def test_segments_and_deltas(spark):
    s = keep(synthetic.random_walks(spark, 3, 100, 7, 1.0))
    for hat in (segments.paa_expand(s, 10), segments.pla_expand(s, 10), segments.pla_expand(s, 10, "ols"), segments.sax_expand(s, 10, denormalize=True)):
        assert hat.count() == 300
    assert metrics.metrics(segments.pla_expand(s, 10, "ols")).first()["rmse"] <= metrics.metrics(segments.paa_expand(s, 10)).first()["rmse"]
    back = sequence.undelta(sequence.delta(s), block=16)
    assert back.agg(F.max(F.abs(F.col("x") - F.col("x_hat")))).first()[0] < 1e-8
    whole = sequence.undelta_of_delta(sequence.delta_of_delta(s))
    assert whole.filter("v <> v_hat").count() == 0


def test_csv_windows_and_matrix(spark, tmp_path):
    path = tmp_path / "sensors.csv"
    path.write_text("timestamp,sensor_a,sensor_b,failure\n" + "\n".join(f"2024-01-01 0{i}:00:00,{i}.5,{'' if i == 2 else 10 * i},0" for i in range(6)))
    w = files.read_windows(spark, str(path), 4)
    shapes = {r["grid_id"]: (r["v"], r["n"]) for r in w.groupBy("grid_id").agg(F.count_distinct("var").alias("v"), F.count_distinct("t").alias("n")).collect()}
    assert shapes == {"grid/0": (2, 4), "grid/1": (2, 2)}
    m, info = files.read_matrix(spark, str(path))
    assert info == {"n_rows": 6, "n_vars": 2, "input_bytes": 96} and {r["var"] for r in m.select("var").distinct().collect()} == {"sensor_a", "sensor_b"}
    with pytest.raises(ValueError, match="window_rows"):
        files.read_windows(spark, str(path), 0)


def test_other_csv_dialects(spark, tmp_path):
    path = tmp_path / "eu.csv"
    path.write_text("Date;CO;T\n10/03;2,6;13,6\n11/03;-200;?\n")
    df = files.read_locale_csv(spark, str(path), na="?")
    assert [tuple(r) for r in df.collect()] == [("10/03", 2.6, 13.6), ("11/03", -200.0, None)]
    plain = tmp_path / "plain.csv"
    plain.write_text("100,50\n101,49.5\n")
    assert files.read_headerless(spark, str(plain)).count() == 4
    s = files.read_headerless(spark, str(plain))
    files.write_reconstruction(s.withColumnRenamed("x", "x_hat"), ["v0", "v1"], str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    files.write_csv_compressed(df, str(tmp_path / "gz"))
    files.write_parquet(df, str(tmp_path / "pq"))
    assert files.stored_bytes(spark, str(tmp_path / "gz")) > 0 and files.read_parquet(spark, str(tmp_path / "pq")).count() == 2


def test_column_choice(spark):
    df = spark.createDataFrame([(1, "2024", 1.0, None, 3.0)], "`Unnamed: 0` int, `timestamp` string, a double, b double, lifetime double")
    assert clean.select_numeric(df) == ["a", "b"] and clean.drop_all_null_columns(df, ["a", "b"]) == ["a"]
    with pytest.raises(ValueError, match="no numeric column"):
        clean.drop_all_null_columns(df, ["b"])


def test_time_index_of_one_long_series(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"), "id")
    a = frames.time_index(df.withColumn("g", F.lit(1)), ["g"], ["k", "id"]).select("id", F.col("t").alias("t1"))
    b = frames.time_index_global(df, ["k", "id"], 8).select("id", "t")
    assert a.join(b, "id").filter("t <> t1").count() == 0


def run_rows(spark):
    rows = [("d", "base8", 10, 0.1, 5.0, 0.9, 0.5), ("d", "mulaw8", 12, 0.12, 1.0, 0.99, 0.1), ("d", "paa", 5, 0.05, 9.0, 0.2, 0.9), ("d", "delta", 40, 0.4, 0.0, 1.0, 0.0), ("d", "pla", 13, 0.13, 2.0, 0.8, 0.3)]
    return spark.createDataFrame(rows, "dataset string, method string, bytes long, ratio double, rmse double, corr double, rel_rmse double")


def test_runs(spark):
    r = run_rows(spark)
    assert {x["method"] for x in runs.pareto_front(r, "bytes", "rmse").collect()} == {"paa", "base8", "mulaw8", "delta"}
    assert [x["method"] for x in runs.dominated(r, "bytes", "rmse").collect()] == ["pla"]
    best = runs.select_best(r, target_rmse=2.0).first()
    assert best["method"] == "mulaw8" and best["met"]
    assert runs.select_best(r, target_rmse=-1.0).first()["method"] == "delta"
    assert runs.select_best(r, target_ratio=0.11).first()["method"] == "base8"
    assert runs.pick_reporting(r).first()["method"] == "mulaw8"
    with pytest.raises(ValueError, match="exactly one"):
        runs.select_best(r)
    new = r.filter("method = 'paa'").withColumn("bytes", F.lit(4).cast("long"))
    merged = {x["method"]: x["bytes"] for x in runs.merge_runs(r, new).collect()}
    assert merged["paa"] == 4 and len(merged) == 5
    assert runs.summary_table(runs.flatten_runs(r)).first()["best_grid_rmse"] == 1.0
    assert clean.is_failure(r.withColumn("rmse", F.lit(float("nan")))).count() == 5


def test_iso_interpolation_of_power_laws(spark):
    curve = lambda k: spark.createDataFrame([("d", 10.0**-i, k * 10.0**i) for i in range(4)], "dataset string, rmse double, ratio double")
    got = runs.iso_interpolate(curve(1.0), curve(3.0)).collect()
    assert len(got) == 12 and all(abs(r["advantage"] - 3.0) < 1e-6 and abs(r["rmse"] * r["ratio_a"] - 1.0) < 1e-6 for r in got)


def test_detection(spark):
    w = keep(detect.labeled_windows(frames.sliding_windows(synthetic.random_walks(spark, 4, 1000, 11, 0.2)).drop("grid_id")))
    assert w.select("win_id").distinct().count() == 38 and w.count() == 38 * 400
    labels = w.select("win_id", "label").distinct()
    again = detect.labeled_windows(frames.sliding_windows(synthetic.random_walks(spark, 4, 1000, 11, 0.2)).drop("grid_id"))
    both = again.withColumnRenamed("x", "y").join(w, ["win_id", "var", "pos"])  # deviations are summed in any order
    assert both.count() == w.count() and both.filter("abs(x - y) > 1e-9").count() == 0
    found = detect.detect_on_grid(w, trees=40)
    f1 = metrics.classification_metrics(found.join(labels, "win_id")).first()["f1"]
    assert f1 > 0.6
    g = keep(detect.grid_features(detect.window_grid(w, 0.03, "abs")))
    assert detect.threshold_search(g, labels).first()["f1"] > 0.6
    assert len(detect.image_features(detect.window_grid(w, 0.03, "abs")).columns) == 15
    lof = detect.local_outlier_factor(g, k=5)
    assert lof.count() == 38


def test_outlier_factors_dont_depend_on_cells(spark):
    made = spark.range(300).select(F.concat(F.lit("w"), "id").alias("win_id"), *[(detect.normal("id", F.lit(c)) * F.when(F.col("id") % 7 == 0, 3.0).otherwise(1.0)).alias(f"f{c}") for c in range(3)])
    made = keep(made.unionByName(made.filter("win_id < 'w12'").withColumn("win_id", F.concat(F.col("win_id"), F.lit("copy")))))
    one, many, tiny = ({r["win_id"]: (r["score"], r["predicted"]) for r in detect.local_outlier_factor(made, k=10, cells=c).collect()} for c in (1, 9, 60))
    x = {r[0]: tuple(r)[1:] for r in detect.standardise(made).collect()}
    near = {a: sorted((math.dist(x[a], x[b]), b) for b in x if b != a)[:10] for a in x}
    lrd = {a: 1 / (sum(max(d, near[b][-1][0]) for d, b in near[a]) / 10 + 1e-10) for a in x}
    for got in (one, many, tiny):
        assert len(got) == len(x) and all(abs(got[a][0] - sum(lrd[b] for _, b in near[a]) / 10 / lrd[a]) < 1e-6 for a in x)
    assert {a: p for a, (_, p) in one.items()} == {a: p for a, (_, p) in many.items()}


def oracle(name, sf_dir):
    """Rows of a query's SQL as text."""
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db.sql(entry.oracle_sql()[name]).df()


def near_equal(got, want, keys):
    got, want = (x[sorted(x.columns)].sort_values(keys).reset_index(drop=True) for x in (got, want))
    assert list(got.columns) == list(want.columns) and len(got) == len(want) and (got[keys].astype(str) == want[keys].astype(str)).all().all()
    assert all(abs(got[c] - want[c]).max() <= 1e-5 for c in got.columns if c not in keys)


def test_stream_windows_cover_all_events(spark):
    from gridloom import queries

    sf = "/root/testdata/sf0.001"
    got = queries.queries()["stream_windows"](spark, sf).toPandas()
    assert got["n"].sum() == spark.read.parquet(f"{sf}/events.parquet").filter("value is not null").count()
    near_equal(got, oracle("stream_windows", sf), ["start", "var"])


def test_prefix_error_reaches_the_end(spark):
    from gridloom import queries

    got = queries.queries()["prefix_error_to_end"](spark, "/root/testdata/sf0.001").toPandas()
    assert got["checkpoint"].max() > 400
    near_equal(got, oracle("prefix_error_to_end", "/root/testdata/sf0.001"), ["grid_id", "checkpoint"])


def test_lags_up_to_half_the_series(spark, tmp_path):
    from gridloom import queries

    hours = spark.range(720).select((F.lit(1704067200) + F.col("id") * 3600 + 60).cast("timestamp").alias("ts"), F.lit("a").alias("event_type"), F.pmod(F.xxhash64(F.col("id") % 168), F.lit(1000)).cast("double").alias("value"), F.col("id").alias("event_id"))
    hours.write.parquet(str(tmp_path / "events.parquet"))
    hours.select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("event_id").cast("int")).alias("o_orderdate"), (F.col("value") / 100).alias("o_totalprice")).write.parquet(str(tmp_path / "orders.parquet"))
    assert [r["lag"] for r in queries.queries()["seasonal_lag"](spark, str(tmp_path)).collect()] == [168]
    ac = {r["lag"]: r["ac"] for r in queries.queries()["autocorrelation_all_lags"](spark, str(tmp_path)).collect()}
    x = [r["o_totalprice"] for r in spark.read.parquet(str(tmp_path / "orders.parquet")).orderBy("o_orderdate").collect()]
    d = [b - a for a, b in zip(x, x[1:], strict=False)]
    v = [y - sum(d) / len(d) for y in d]
    want = [sum(a * b for a, b in zip(v, v[lag:], strict=False)) / sum(a * a for a in v) for lag in range(len(v) // 2)]
    assert sorted(ac) == list(range(len(want))) and all(abs(ac[i] - w) < 1e-5 for i, w in enumerate(want))


def test_generators_are_deterministic(spark):
    a, b = synthetic.synthetic_sensors(spark, 4, 64, 3), synthetic.synthetic_sensors(spark, 4, 64, 3)
    assert a.exceptAll(b).count() == 0 and a.count() == 256
    later = synthetic.synthetic_sensors(spark, 4, 32, 3, start=32)
    assert later.exceptAll(a).count() == 0
    f = synthetic.grouped_factors(spark, 6, 200, 2, 1)
    near = {(r["a"], r["b"]): r["corr"] for r in profile.correlation_pairs(f).collect()}
    assert near["v0000", "v0002"] > 0.8 > abs(near["v0000", "v0001"])


def test_stream_batches_equal_batch(spark, tmp_path):
    s = keep(synthetic.random_walks(spark, 2, 200, 5, 1.0))
    s.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
    query = encode_each_batch(stream, lambda grid, n: seen.append(grid.count()), 100, str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == 2 * 2 * 99


def test_registered_queries_have_matching_columns():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50
