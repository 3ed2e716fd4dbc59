"""Streams in parts give what whole streams give, for any size of parts, with one stream in a third of the rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import blocks, gates, monitor, temporal


def table(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(600):
        asset = [7, 1, 2, None][0 if k % 3 == 0 else int(rng.integers(1, 4))]
        x = None if rng.random() < 0.15 else float(rng.normal())
        rows.append((k, asset, ["a", "b"][int(rng.random() < 0.2)], int(rng.integers(0, 200)), x, float(rng.normal()), "x"))
    rows += [(1000 + k, 9, "a", k, None, 1.0, "x") for k in range(40)]  # nothing known in its first parts
    rows += [(1100 + k, 9, "a", 40 + k, float(k), 1.0, "x") for k in range(40)]
    return spark.createDataFrame(rows, "id long, asset int, view string, ts long, x double, z double, part string").repartition(5)


def by_id(df):
    return {r["id"]: r.asDict() for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k, row in a.items():
        for c, v in row.items():
            w = b[k][c]
            assert (v is None) == (w is None) and (v == w or not isinstance(v, float) or math.isclose(v, w, rel_tol=1e-9, abs_tol=1e-12)), (k, c, v, w)


@pytest.mark.parametrize("rows", [1, 7, 50])
def test_features_of_parts(spark, rows):
    df = table(spark)
    of = lambda n: by_id(temporal.all_features(df, ["x", "z"], "asset", "view", ["ts", "id"], rows=n))
    whole, parts = of(10_000), of(rows)
    assert len(whole) == 680
    close(whole, parts)


@pytest.mark.parametrize("rows", [1, 30])
def test_single_features(spark, rows):
    df, keys, order = table(spark), ["asset", "view"], ["ts", "id"]
    for f in (temporal.rolled, temporal.changed, temporal.rolling_slopes):
        close(by_id(f(df, "x", keys, order, rows=10_000)), by_id(f(df, "x", keys, order, rows=rows)))


def test_average_of_parts_is_the_serial_one(spark):
    rng = np.random.default_rng(1)
    x = [None if rng.random() < 0.1 else float(v) for v in rng.normal(size=3000)]
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate(x)], "s int, t long, x double").repartition(6)
    got = {r["t"]: r["x_ema_30"] for r in temporal.ema(df, "x", ["s"], ["t"], [0.3], rows=100).collect()}
    y = None
    for k, v in enumerate(x):
        y = y if v is None else v if y is None else 0.3 * v + 0.7 * y
        assert (got[k] is None) == (y is None) and (y is None or abs(got[k] - y) < 1e-12)


def test_parts_are_bounded(spark):
    df = spark.range(10_000).selectExpr("0 as s", "id as t")
    sizes = [r["count"] for r in blocks.dealt(df, ["s"], ["t"], 500).groupBy("_part").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 1500


def serial_states(rows, persistence, release):
    """score, threshold, reset, early of a stream, row by row."""
    severe, above, below, out = False, 0, 0, []
    for score, high, low, early in rows:
        if early or score is None or high is None:
            severe, above, below, state = False, 0, 0, monitor.INSUFFICIENT
        elif severe:
            below, state = (below + 1 if low is not None and score <= low else 0), monitor.SEVERE
            if below >= release:
                severe, above, below, state = False, 0, 0, monitor.CONSISTENT
        elif score > high:
            above += 1
            severe = above >= persistence
            below, state = 0, monitor.SEVERE if severe else monitor.DEVIATION
        else:
            above, state = 0, monitor.CONSISTENT
        out.append((state, above, below))
    return out


@pytest.mark.parametrize(("persistence", "release"), [(1, 1), (3, 2), (2, 5), (6, 6)])
def test_maps_give_the_serial_states(persistence, release):
    rng = np.random.default_rng(persistence * 10 + release)
    machine = monitor.Hysteresis(persistence, release)
    for n in (1, 5, 63, 64, 65, 700):
        level = np.repeat(rng.random(n // 5 + 1), 5)[:n]
        score = np.where(rng.random(n) < 0.03, np.nan, level + rng.normal(0, 0.1, n))
        high, low, early = np.full(n, 0.6), np.where(rng.random(n) < 0.3, 0.7, 0.4), np.arange(n) < 3
        symbols = machine.symbols(score, high, low, early)
        states = machine.states(symbols, 0)
        got = list(zip(*(x.tolist() for x in machine.named(symbols, states)), strict=True))
        rows = [(None if np.isnan(s) else s, h, w, e) for s, h, w, e in zip(score, high, low, early, strict=True)]
        assert got == serial_states(rows, persistence, release)
        cut = n // 3
        assert machine.composed(symbols[cut:])[machine.composed(symbols[:cut])[0]] == states[-1]


@pytest.mark.parametrize("rows", [11, 10_000])
def test_states_of_parts(spark, rows):
    rng = np.random.default_rng(6)
    streams = {"hot": 400, "b": 90, None: 60}
    given = {s: [(None if rng.random() < 0.04 else float(v), None if s == "b" and k > 70 else 0.6, 0.4, k < 5) for k, v in enumerate(np.repeat(rng.random(n), 4)[:n])] for s, n in streams.items()}
    df = spark.createDataFrame([(s, k, *r) for s, x in given.items() for k, r in enumerate(x)], "stream string, place int, score double, threshold double, reset double, in_baseline boolean").repartition(6)
    got = {(r["stream"], r["place"]): (r["state"], r["consecutive"], r["released"]) for r in monitor.monitor_states(df, "stream", ["place"], 3, 2, rows).collect()}
    assert got == {(s, k): v for s, x in given.items() for k, v in enumerate(serial_states(x, 3, 2))}


def test_reached_of_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][int(rng.integers(0, 3))], k, int(rng.integers(0, 10**6)) if rng.random() < 0.9 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "s string, first long, last long").repartition(4)
    got = {r["first"]: r["m"] for r in blocks.reached(df, ["s"], ["first"], "last", "m", 20).collect()}
    for s, k, _ in rows:
        before = [v for t, j, v in rows if t == s and j < k and v is not None]
        assert got[k] == (max(before) if before else None)


def test_overlapping_packages_are_found(spark):
    """Indices 0 to 129 and 100 to 139 in two packages, receipts made from the same rows."""
    rows = spark.createDataFrame([("d", "p", k) for k in range(130)] + [("d", "q", k) for k in range(100, 140)], "dataset string, package string, i long")
    receipts = gates.chunk_receipts(rows, "i", ["i"])
    assert [(r["chunk"], r["problem"]) for r in gates.receipt_violations(rows, receipts, "i", ["i"]).collect()] == [(0, "repeated index"), (1, "repeated index")]
    digest = gates.rows_digest(F.collect_list(F.struct(F.col("i").alias("_i"), F.sha2(F.to_json(F.struct("i")), 256).alias("_h"))))
    packages = rows.groupBy("dataset", "package").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n"), digest.alias("digest"))
    plan = packages.select("dataset", "package", "first", "last")
    assert [tuple(r) for r in gates.assembly_violations(rows, packages, plan, "i", ["i"]).collect()] == [("d", "q", "overlap")]
    with pytest.raises(ValueError, match="d/q: overlap"):
        gates.assembled(rows, packages, plan, "i", ["i"])
    fine = rows.where("package = 'p'")
    _, ledger = gates.assembled(fine, packages.where("package = 'p'"), plan.where("package = 'p'"), "i", ["i"])
    assert [r["package"] for r in ledger.collect()] == ["p"]


def test_order_of_parts(spark):
    rng = np.random.default_rng(5)
    rows = [("a" if k % 4 else "b", k, None if rng.random() < 0.05 else int(rng.integers(0, 40)) + k // 4) for k in range(400)]
    df = spark.createDataFrame(rows, "s string, i long, v long").repartition(4)
    whole, parts = (sorted(map(tuple, gates.order_violations(df, "s", "i", "v", n).collect())) for n in (10_000, 25))
    assert whole == parts and {p for _, _, p in whole} == {"repeated", "unordered"}


def test_thresholds_have_the_last_bit_of_duckdbs_quantiles(spark):
    import duckdb
    import pyarrow as pa

    rng = np.random.default_rng(5)
    scores = np.round(rng.gamma(1.5, 40, (2000, 10)), 2)
    scores[1000:, 5] = scores[1000:, 4]
    rows = pa.table({"user": np.repeat(np.arange(2000), 10), "place": np.tile(np.arange(1, 11), 2000), "score": scores.ravel()})
    con = duckdb.connect()
    con.register("e", rows)
    want = con.sql("SELECT user, quantile_cont(score, 0.6), quantile_cont(score, 0.5) FROM e GROUP BY 1").fetchall()
    df = spark.createDataFrame(rows.to_pandas())
    assert sorted(map(tuple, monitor.thresholds(df, "user", 10, 0.6, 0.5).collect())) == sorted(want)
    # parts of such values aren't finite
    large = spark.createDataFrame([(1, k, v) for k, v in enumerate([1e305, 1e306, float("inf")], 1)], "user int, place int, score double")
    assert monitor.thresholds(large, "user", 3, 0.9, 0.25).first()[1:] == (float("inf"), pytest.approx(5.5e305))
