import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import registry, signal
from cadenza.operators import evidence, folds, gates, identity, labels, metrics, models, monitor, selection, temporal
from cadenza.sources import recordings, sinks, tables
from cadenza.streaming import monitor as stream_monitor


def series(spark, values, bearing=3, axis="x"):
    return spark.createDataFrame([(bearing, axis, k, None if v is None else float(v)) for k, v in enumerate(values)], "bearing int, axis string, k int, rms double").select("bearing", "axis", (F.lit("2004-02-12 10:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("k") * 10)).alias("timestamp"), "rms")


def test_streams_do_not_mix_and_first_deviation_is_null(spark):
    df = series(spark, [1.0, 2, 3, 4, 5, 6]).unionByName(series(spark, [100.0, 200, 300], 4, "y"))
    out = df.select("*", *(c.alias(n) for n, c in temporal.rolling("rms", ["bearing", "axis"], ["timestamp"]).items())).orderBy("bearing", "timestamp").collect()
    assert [r["rms_mean_3"] for r in out] == [1.0, 1.5, 2, 3, 4, 5, 100, 150, 200]
    assert out[0]["rms_std_3"] is None and out[6]["rms_std_3"] is None


def test_deltas_slope_ema(spark):
    out = series(spark, [10.0, 15, 12]).select(*(c.alias(n) for n, c in temporal.deltas("rms", ["bearing"], ["timestamp"]).items())).collect()
    assert [r["rms_diff"] for r in out] == [0, 5, -3]
    slope = temporal.rolling_slopes(series(spark, [2.0 * k for k in range(10)]), "rms", ["bearing"], ["timestamp"]).collect()
    assert slope[0]["rms_slope_5"] is None and all(abs(r["rms_slope_5"] - 2) < 1e-9 for r in slope[1:])
    ema = temporal.ema(series(spark, [10.0, 20, 30]), "rms", ["bearing"], ["timestamp"], (0.5,)).collect()
    assert [r["rms_ema_50"] for r in ema] == [10, 15, 22.5]


def test_ema_skips_nulls(spark):
    out = temporal.ema(series(spark, [None, 4.0, None, 8.0]), "rms", ["bearing"], ["timestamp"], (0.5,)).collect()
    assert [r["rms_ema_50"] for r in out] == [None, 4, 4, 6]


def test_temporal_features_take_one_exchange(spark):
    df = series(spark, [1.0, 2, 3])
    plan = temporal.temporal_features(df, ["rms"], "bearing", "axis", ["timestamp"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_metrics_of_constant_target(spark):
    r = metrics.regression_metrics(spark.createDataFrame([(5.0, 5.0), (5.0, 6.0), (5.0, 4.0)], "y double, yhat double")).first()
    assert abs(r["mae"] - 2 / 3) < 1e-12 and r["r2"] is None
    t = metrics.threshold_metrics(spark.createDataFrame([(200.0, 200.0)], "y double, yhat double"), (50,)).first()
    assert (t["precision"], t["recall"], t["miss_rate"], t["fpr"]) == (None, None, None, 0)


def test_purged_folds_keep_the_gap(spark):
    folds = labels.purged_folds(series(spark, [float(k) for k in range(20)]), "bearing", "timestamp", 4, 2)
    assert {r["min_gap"] for r in labels.nearest_train_gap(folds, "bearing", "timestamp").collect()} == {3}
    assert all(r["overlap"] == 0 for r in labels.fold_overlap(folds, ["bearing", "timestamp"]).collect())


def test_frames_and_features(spark):
    df = spark.createDataFrame([([float(k) for k in range(20)], [3.0, 4.0, 0.0, 0.0])], "x array<double>, r array<double>")
    assert signal.framed(df.select("x"), "x", 5, 0.0).count() == 4
    assert df.select(signal.time_features(F.col("r"))["rms"]).first()[0] == 2.5
    f, p = signal.welch(np.sin(2 * np.pi * 2000 * np.arange(20000) / 20000)[None], 20000)
    assert abs(f[p[0].argmax()] - 2000) < 20 and abs(np.trapezoid(p[0], f) - 0.5) < 1e-3


def test_state_machine_on_an_abrupt_shift(spark):
    rows = [("a", k, float(v), k < 4) for k, v in enumerate([0, 1, 2, 3] + [8] * 6 + [2] * 6)]
    df = spark.createDataFrame(rows, "s string, k int, score double, in_baseline boolean").withColumns({"threshold": F.lit(3.0), "reset": F.lit(2.5)})
    got = [r["state"] for r in monitor.monitor_states(df, "s", ["k"]).orderBy("k").collect()]
    assert got == [monitor.INSUFFICIENT] * 4 + [monitor.DEVIATION] * 5 + [monitor.SEVERE] * 6 + [monitor.CONSISTENT]


def test_later_rows_never_change_earlier_scores(spark):
    v = [("a", k, [float(x), 1.0]) for k, x in enumerate([1, 2, 4, 7, 9, 30])]
    score = lambda rows: {r["k"]: r["score"] for r in monitor.knn_scores(spark.createDataFrame(rows, "s string, k int, scaled array<double>"), "s", ["k"], "k", 3, 2).collect()}
    a, b = score(v), score(v[:-1] + [("a", 5, [-500.0, 1.0])])
    assert all(a[k] == b[k] for k in range(5)) and a[5] != b[5]


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=(40, 3)), np.repeat([0, 1], [10, 30])
    y = 20 + x @ [1.0, -2, 0.5] + rng.normal(size=40)
    df = spark.createDataFrame([(int(a), float(b), *map(float, c)) for a, b, c in zip(g, y, x, strict=True)], "g int, y double, a double, b double, c double")
    got = np.array([r["yhat"] for r in models.ridge(df, df, ["a", "b", "c"], "y", "g").collect()])
    q = np.percentile(x, [25, 50, 75], axis=0)
    z, w = (x - q[1]) / (q[2] - q[0]), 1 / (2 * np.where(g == 0, 10, 30))
    zc, yc = z - w @ z, y - w @ y
    beta = np.linalg.solve((zc * w[:, None]).T @ zc + np.eye(3), (zc * w[:, None]).T @ yc)
    assert np.allclose(np.sort(got), np.sort(np.maximum(0, w @ y + zc @ beta)), atol=1e-6)


def test_two_sample_drift(spark):
    df = spark.createDataFrame([("f", float(v), s) for v, s in [(0, True), (1, True), (3, True), (5, False), (6, False), (8, False)]], "feature string, value double, s boolean")
    r = selection.two_sample_drift(df, F.col("s")).first()
    assert r["ks"] == 1 and abs(r["wasserstein"] - 5) < 1e-9


def test_recordings_and_archives(spark, tmp_path):
    (tmp_path / "2004.02.12.10.32.39").write_text("\n".join("\t".join(str(c + r) for c in range(8)) for r in range(4)) + "\n")
    (tmp_path / "2004.02.12.10.42.39").write_text("1 2 3\n")
    (tmp_path / "2004.02.12.10.52.39").write_text("")
    rows = {r["name"]: r for r in recordings.matrices(spark, f"file://{tmp_path}").collect()}
    assert rows["2004.02.12.10.32.39"]["status"] == "ok" and str(rows["2004.02.12.10.32.39"]["ts"]) == "2004-02-12 10:32:39"
    assert rows["2004.02.12.10.42.39"]["status"] == "columns"
    each = recordings.channels(recordings.matrices(spark, f"file://{tmp_path}")).orderBy("channel").collect()
    assert len(each) == 8 and each[3]["asset"] == 2 and each[3]["view"] == "y" and each[3]["signal"] == [3, 4, 5, 6]
    assert recordings.manifest(spark, f"file://{tmp_path}").count() == 2  # an empty file has no row
    listed = spark.createDataFrame([("2004.02.12.10.32.39",), ("2004.02.12.10.52.39",)], "name string")
    rows = {r["name"]: r for r in recordings.matrices(spark, f"file://{tmp_path}", rows=4, listing=listed).collect()}
    assert rows["2004.02.12.10.52.39"]["status"] == "empty" and rows["2004.02.12.10.32.39"]["status"] == "ok" and rows["2004.02.12.10.32.39"]["n_samples"] == 4
    assert rows["2004.02.12.10.42.39"]["status"] == "rows"
    (tmp_path / "2004.02.12.11.02.39").write_text("1\t2\n\n3\t4\n")
    one = lambda **how: recordings.matrices(spark, f"file://{tmp_path}/2004.02.12.11.02.39", 2, **how).first()["status"]
    assert (one(), one(rows=2), one(separator=" ")) == ("ok", "blank row", "columns")
    (tmp_path / "2004.02.12.11.02.39").unlink()
    listing = spark.createDataFrame([(f"-rw-r--r-- 0 u g 5 Feb 1 2004 {p}",) for p in ("a/1", "A/1", "../x", "b", "b", "ok")], "value string")
    assert sorted(r["verdict"] for r in recordings.archive_members(listing).collect()) == ["case-collision", "case-collision", "duplicate", "duplicate", "ok", "unsafe"]


def test_strict_json_and_publish(spark, tmp_path):
    lines = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "a": 2}',), ("",), ("[1]",), ("{",)], "value string")
    assert [r["problem"] for r in recordings.strict_json_lines(lines, "a int").collect()] == [None, "duplicate key", "blank", "not an object", "syntax"]
    df = spark.range(5)
    path = f"file://{tmp_path}/t"
    assert tables.publish(df, path) is True and tables.publish(df, path) is False
    with pytest.raises(ValueError, match="other rows"):
        tables.publish(spark.range(6), path)
    folder = f"file://{tmp_path}/all"
    assert tables.publish_all({"a": df, "b": df}, folder) == ["a", "b"] and tables.publish_all({"a": df, "b": df}, folder) == []
    with pytest.raises(ValueError, match="other members"):
        tables.publish_all({"a": df}, folder)


def test_sample_and_digest_do_not_depend_on_order(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    a, b = (sorted(r["k"] for r in identity.hash_ranked_sample(d, "k", 5, (1,)).collect()) for d in (df, df.repartition(7)))
    assert a == b and len(a) == 6 and 1 in a
    names = df.select(F.col("k").cast("string").alias("n"))
    assert identity.members_digest(names, "n").first() == identity.members_digest(names.repartition(3), "n").first()


def test_registry_features_of_plain_windows(spark):
    x = [[3.0] * 16, [0.0] * 16, [1.0, -1.0] * 8, np.sin(2 * np.pi * 4 * np.arange(16) / 16).tolist(), None, [1.0] * 15 + [float("nan")]]
    r = registry.registry_features(spark.createDataFrame(list(enumerate(x)), "k int, x array<double>"), "x", 64.0, (8.0, 20.0)).orderBy("k").collect()
    assert (r[0]["raw_mean"], r[0]["shape_crest_factor"], r[0]["shape_skewness"], r[0]["spectral_entropy_normalized"]) == (3, 1, None, None)
    assert r[1]["raw_rms"] == 0 and r[1]["shape_crest_factor"] is None and r[1]["raw_total_ac_power"] == 0
    # a Hann window spreads a tone at a bin over its neighbours, a sixth of the power each
    assert r[2]["spectral_relative_power_5000_10000"] > 0.99 and abs(r[3]["spectral_relative_power_1000_5000"] - 5 / 6) < 1e-9
    assert abs(r[3]["spectral_centroid_nyquist_fraction"] - 0.5) < 1e-9
    assert r[4]["raw_mean"] is None and r[5]["raw_mean"] is None


def test_fills_come_from_train_rows(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (0, None), (1, None), (1, float("inf")), (1, float("nan")), (1, 100.0)], "test int, v double")
    assert sorted(r["v"] for r in evidence.median_filled(df, F.col("test") == 0, ["v"]).collect()) == [1, 2, 2, 2, 2, 3, 100]


def test_zscores_fall_back_as_a_group_needs(spark):
    """Train g = 10, 10 has no spread, h = 20, 40 has, k = 5 is one row; fold values 10 10 20 40 5."""
    rows = [(0, "train", "g", 10.0), (0, "train", "g", 10.0), (0, "train", "h", 20.0), (0, "train", "h", 40.0), (0, "train", "k", 5.0), (0, "test", "g", 12.0), (0, "test", "h", 30.0), (0, "test", "k", 6.0), (0, "test", "new", 7.0), (0, "purged", "g", 1e9)]
    rows += [(1, "train", "g", 3.0), (1, "test", "g", 4.0)]
    got = {(r["fold"], r["role"], r["k"], r["x"]): r["x_z"] for r in labels.fitted_zscore(spark.createDataFrame(rows, "fold int, role string, k string, x double"), "x", ["k"]).collect()}
    whole = np.array([10, 10, 20, 40, 5.0])
    m, s, h = whole.mean(), whole.std(ddof=1) + 1e-8, np.std([20, 40.0], ddof=1) + 1e-8
    want = {(0, "test", "g", 12.0): 2 / s, (0, "test", "h", 30.0): 0.0, (0, "test", "k", 6.0): 1 / s, (0, "test", "new", 7.0): (7 - m) / s, (0, "train", "h", 20.0): -10 / h, (0, "train", "g", 10.0): 0.0, (1, "test", "g", 4.0): 1 / 2e-8}
    assert all(abs(got[k] - v) < 1e-6 * max(1, abs(v)) for k, v in want.items()) and not any(r == "purged" for _, r, _, _ in got)


def test_an_incomplete_baseline_gives_no_threshold(spark):
    df = spark.createDataFrame([("a", k, s) for k, s in enumerate([1.0, None, 5.0, 2.0], 1)] + [("b", k, float(k)) for k in range(1, 5)], "s string, place int, score double")
    got = {r["s"]: (r["threshold"], r["reset"]) for r in monitor.thresholds(df, "s", 3).collect()}
    assert got == {"a": (None, None), "b": (2.98, 2.9)}
    with pytest.raises(ValueError, match="reset"):
        monitor.thresholds(df, "s", 3, 0.5, 0.9)


def test_scores_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(s, k, None if (s, k) == ("c", 9) else rng.normal(size=3).tolist()) for s in "abc" for k in range(40)] + [("d", k, [0.0] * 3) for k in range(4)]
    df = spark.createDataFrame(rows, "s string, k int, scaled array<double>")
    score = lambda block: {(r["s"], r["k"]): r["score"] for r in monitor.knn_scores(df, "s", ["k"], "k", 6, 2, block).collect()}
    whole, cut = score(65_536), score(7)
    assert whole == cut and len(whole) == len(rows)
    base = np.array([v for s, k, v in rows if s == "a" and k < 6])
    for s, k, v in rows[:40]:
        d = np.sort([np.linalg.norm(np.array(v) - b) for i, b in enumerate(base) if i != k])[:2]
        assert abs(whole[s, k] - np.median(d)) < 1e-12
    assert whole["c", 9] is None and all(whole["d", k] is None for k in range(4))


def test_exact_cut_of_a_global_split(spark):
    rng = np.random.default_rng(3)
    t = rng.integers(0, 10**9, 500).tolist() + [777] * 300
    df = spark.createDataFrame([(x,) for x in t], "x long").select(F.timestamp_add("MICROSECOND", "x", F.lit("2004-01-01").cast("timestamp_ntz")).alias("ts"))
    for share in (0.0, 0.3, 0.8, 0.999):
        cut = sorted(t)[int(share * len(t))]
        assert labels.split_global(df, ["ts"], share, parts=4, direct=10).where("split = 'train'").count() == sum(x < cut for x in t)
    assert labels.split_global(df.limit(0), ["ts"], 0.8).count() == 0


def test_feature_rows_of_recordings(spark, tmp_path):
    """Two recordings of two channels: file to windows to values, counts and ids."""
    rng = np.random.default_rng(4)
    data = rng.normal(size=(2, 64, 2))
    data[1, :, 1] = 3.0
    for k in range(2):
        (tmp_path / f"2004.02.12.10.{k}2.39").write_text("\n".join("\t".join(f"{v:.6f}" for v in r) for r in data[k]))
    channels = recordings.channels(recordings.matrices(spark, f"file://{tmp_path}", 2, rows=64))
    how = {"width": 16, "step": 8, "windows": 7, "fs": 64.0, "edges": (8.0, 20.0)}
    rows = registry.feature_rows(channels, contract="v1", **how).orderBy("name", "channel").collect()
    assert len(rows) == 4 and len({r["feature_row_id"] for r in rows}) == 4 and all(r["window_count"] == 7 and len(r["feature_values"]) == 34 for r in rows)
    x = np.round(data[0, :, 0], 6)
    f = registry.registry(np.stack([x[a : a + 16] for a in range(0, 49, 8)]), 64.0, (8.0, 20.0))
    want = np.stack([f.mean(0), f.std(0)], 1).ravel()
    assert np.allclose(rows[0]["feature_values"], want, rtol=1e-10, atol=1e-12) and rows[0]["valid_window_counts"] == [7] * 17
    flat = rows[3]
    assert flat["feature_values"][0] == 3 and flat["valid_window_counts"][9] == 0 and flat["feature_values"][18:20] == [None, None]
    other = registry.feature_rows(channels, contract="v2", **how).orderBy("name", "channel").collect()
    assert not {r["feature_row_id"] for r in rows} & {r["feature_row_id"] for r in other}
    assert registry.feature_rows(channels, contract="v1", **(how | {"windows": 19})).first()["feature_values"] is None
    # as measured, without the 12 digits, which would round a second time
    exact = registry.feature_rows(channels, contract="v1", quantise=False, **how).orderBy("name", "channel").first()["feature_values"]
    assert np.allclose(exact, want, rtol=1e-14, atol=0) and exact != rows[0]["feature_values"]


def test_resampling_keeps_tones(spark):
    t = np.arange(100) / 100
    df = spark.createDataFrame([(np.sin(2 * np.pi * 5 * t).tolist(),), (None,), ([],)], "x array<double>")
    for rate in (50.0, 150.0, 100.0):
        got = [r["x"] for r in signal.resampled(df, "x", 100.0, rate).collect()]
        n = int(rate)
        assert np.allclose(got[0], np.sin(2 * np.pi * 5 * np.arange(n) / n), atol=1e-9) and got[1] is None and got[2] == []


def test_fold_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(8)
    rows = [(k % 2, "test" if k % 5 == 0 else "train", *map(float, x), float(50 + 3 * x[0] - x[1] + rng.normal())) for k, x in enumerate(rng.normal(size=(60, 3)))]
    df = spark.createDataFrame(rows, "fold int, role string, a double, b double, c double, y double")
    got = {(r["fold"], r["a"]): r["yhat"] for r in folds.fold_ridge(df, ["a", "b", "c"], "y", 2.0).collect()}
    for f in (0, 1):
        train, test = (np.array([r[2:] for r in rows if r[0] == f and r[1] == role]) for role in ("train", "test"))
        m, s = train.mean(0), train.std(0)
        z = (train[:, :3] - m[:3]) / s[:3]
        b = np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (train[:, 3] - m[3]))
        for r in test:
            assert abs(got[f, r[0]] - max(0, m[3] + ((r[:3] - m[:3]) / s[:3]) @ b)) < 1e-9


def test_tables_to_files_and_back(spark, tmp_path):
    path = lambda n: f"file://{tmp_path}/{n}"
    df = spark.createDataFrame([(2, "b", 1.5, [1]), (1, None, None, [])], "file long, axis string, rms double, a array<int>")
    assert sinks.numeric_columns(df) == ["rms"] and sinks.numeric_columns(df, ()) == ["file", "rms"]
    assert spark.read.parquet(sinks.save(df, path("p"))).count() == 2
    assert sorted(r["a"] for r in spark.read.option("header", True).csv(sinks.save(df, path("c"), "csv")).collect()) == ["[1]", "[]"]
    sinks.save(spark.createDataFrame([(" f1 ",), ("",), ("f2",)], "feature string"), path("l"), "csv")
    assert sorted(r["feature"] for r in sinks.read_list(spark, path("l")).collect()) == ["f1", "f2"]
    with pytest.raises(ValueError, match="no column"):
        sinks.read_list(spark, path("l"), "other")
    for _ in range(2):
        assert sinks.ingest(spark, path("p"), path("t"), ["file", "rms"], {"file": "file_name"}) == ["file_name", "axis", "rms", "a"]
    assert spark.read.parquet(path("t")).count() == 4
    with pytest.raises(ValueError, match="required"):
        sinks.append_checked(df, path("t"), ["kurtosis"])
    assert list(sinks.json_lines(df.drop("a"), ["file"])) == ['{"axis":null,"file":1,"rms":null}\n', '{"axis":"b","file":2,"rms":1.5}\n']
    once = sinks.with_split_column(df)
    assert once.columns[-1] == "split" and sinks.with_split_column(once).columns == once.columns
    r = sinks.split_record(spark.createDataFrame([("train", 1), ("train", 2), ("test", 3)], "split string, ts int"), "by time").first()
    assert tuple(r) == ("by time", 3, 2, 1, 2, 3)


def test_windows_of_a_stream_are_judged_once(spark, tmp_path):
    at = lambda minute: F.lit(f"2024-01-01 {minute // 60:02}:{minute % 60:02}:00").cast("timestamp")
    batches = [[("a", 1, 1.0), ("a", 1, 1.0), ("b", 5, 9.0), ("a", 50, 3.0)], [("a", 70, 8.0), ("a", 40, None), ("b", 90, 1.0)], [("a", 3, 100.0), ("a", 300, 0.0)], [("a", 301, 0.0)]]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "stream string, minute int, score double")
        df.select("stream", F.timestamp_add("MINUTE", "minute", at(0)).alias("ts"), "score").coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    source = spark.readStream.schema("stream string, ts timestamp, score double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    limits = spark.createDataFrame([("a", 2.5)], "stream string, threshold double")
    query = stream_monitor.window_alerts(source, limits).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["stream"], r["begin"].hour, r["n"], r["mean"], r["above"], r["alert"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # the row of minute 3 came after its window was judged
    assert got == [("a", 0, 3, 2.0, 1, False), ("a", 1, 1, 8.0, 1, True), ("b", 0, 1, 9.0, 0, None), ("b", 1, 1, 1.0, 0, None)]


def test_search_ranks_its_trials(spark):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(*map(float, x), float(30 + 20 * (x[0] > 0) + rng.normal())) for x in rng.normal(size=(200, 2))], "a double, b double, y double")
    got = models.search(df, df, ["a", "b"], "y", [{"trees": 3, "depth": 1}, {"trees": 5, "depth": 6}]).orderBy("rank").collect()
    assert [r["trial"] for r in got] == [1, 0] and got[0]["weighted_mae"] < got[1]["weighted_mae"] and got[0]["settings"] == '{"depth": 6, "trees": 5}'


def test_retrospective_of_times(spark):
    states = spark.createDataFrame([("a", 10, monitor.SEVERE), ("a", 5, monitor.INSUFFICIENT), ("b", 7, monitor.DEVIATION)], "asset string, s int, state string").select("asset", F.timestamp_seconds("s").alias("ts"), "state")
    outcomes = spark.createDataFrame([("a", 70, True), ("b", 70, True), ("c", 70, False)], "asset string, s int, damaged boolean").select("asset", F.timestamp_seconds("s").alias("end"), "damaged")
    got = {r["asset"]: (r["lead"], r["missed"], r["abstained"]) for r in monitor.retrospective(states, outcomes).collect()}
    assert got == {"a": (60.0, False, 0.5), "b": (None, True, 0.0), "c": (None, False, None)}


def test_keys_are_found_at_any_depth(spark):
    text = r'{"a": "x\": ", "b\u005fc" : [1, {"Rul_x": {"deep_LABEL": null}}], "rul": "label_"}'
    df = spark.createDataFrame([(1, text), (2, None), (3, "{}")], "k int, j string")
    assert sorted(r["found"] for r in gates.forbidden_keys(df, ["k"], "j", ["rul", "label", "c"]).collect()) == ["Rul_x", "b_c", "deep_LABEL", "rul"]


def test_tables_of_folds_make_their_folds_once(spark):
    """The blocks of folds (ntile) are in no plan that reads the folds again."""
    rows = spark.range(200).selectExpr("id AS event_id", "id % 4 AS user_id", "'a' AS event_type", "timestamp_ntz '2024-01-01' + make_dt_interval(0, id) AS ts", "id * 0.5D AS value")
    made = labels.purged_folds(rows, "user_id", "ts", 5, 3)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "ntile" in plan(made) and "ntile" not in plan(folds.fold_features(made, "value", "user_id", "event_type", ["ts", "event_id"], (3,), (0.3,)))
    overlap = labels.fold_overlap(made, ["user_id", "ts"])
    assert "count(distinct" not in plan(overlap) and {r["fold"]: r["overlap"] for r in overlap.collect()} == dict.fromkeys(range(1, 6), 0)
    both = spark.createDataFrame([(1, "x", "train"), (1, "x", "test"), (1, "y", "train"), (1, "y", "purged"), (2, None, "test"), (2, None, "train")], "fold int, k string, role string")
    assert {r["fold"]: r["overlap"] for r in labels.fold_overlap(both, ["k"]).collect()} == {1: 1, 2: 1}


def test_leave_one_out_rows_are_many_tasks(spark):
    rows = spark.range(40, numPartitions=1).selectExpr("id", "id % 4 AS asset")
    got = labels.leave_one_out_rows(rows, "asset").withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 160 and sum(r["role"] == "test" for r in got) == 40 and len({r["task"] for r in got}) > 8


def test_leave_one_out_rows_take_a_tile_a_task(spark):
    """A task has a share of the rows and of the folds, at most so many; a missing asset is a fold of its own."""
    rows = spark.range(600, numPartitions=1).selectExpr("id", "nullif(id % 120, 7) AS asset")
    out = labels.leave_one_out_rows(rows, "asset", folds=20, rows=100)
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert len({(r["id"], r["fold"]) for r in got}) == len(got) == 600 * 120
    assert all(r["role"] == ("test" if r["fold"] is not None and r["fold"] == r["asset"] else "train") for r in got)
    held, ids = {}, {}
    for r in got:
        held.setdefault(r["task"], set()).add(r["fold"])
        ids.setdefault(r["task"], set()).add(r["id"])
    assert max(map(len, held.values())) <= 40 and max(map(len, ids.values())) <= 200
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    few = labels.leave_one_out_rows(rows, "asset", F.col("fold") < 3, folds=20, rows=100)
    assert sorted(r["fold"] for r in few.groupBy("fold").count().where("count = 600").collect()) == [0, 1, 2] and few.count() == 1800
    assert labels.leave_one_out_rows(rows.limit(0), "asset").count() == 0
