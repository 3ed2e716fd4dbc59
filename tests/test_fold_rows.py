"""Queries over folds write a row an event, not one for each fold, and quantiles of few groups deal no rows by group."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import folds, labels, quantiles
from cadenza.plans import folds as plans

EVENTS = "/root/testdata/sf0.001"


@pytest.mark.parametrize("gap", [0, 3, 40])
def test_blocks_are_the_folds(spark, gap):
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(0, 6)), int(rng.integers(0, 40))) for k in range(400)] + [(900 + k, 10 + n, k) for n in range(8) for k in range(n)] + [(990, None, 3), (991, 10, None)]
    df = spark.createDataFrame(rows, "id int, asset int, s int").select("id", "asset", F.timestamp_seconds("s").alias("ts"))
    made = labels.purged_folds(df, "asset", "ts", 5, gap).collect()
    got = labels.purged_blocks(df, "asset", "ts", 5, gap).collect()
    assert Counter((r["id"], r["fold"]) for r in made if r["role"] == "test") == Counter((r["id"], r["fold"]) for r in got)
    assert Counter((r["id"], r["fold"]) for r in made if r["role"] == "train") == Counter((r["id"], f) for r in got for f in r["trains"])


def test_fits_of_blocks_are_those_of_folds(spark):
    df = spark.range(300).selectExpr("id", "id % 7 AS asset", "timestamp_seconds(id * id % 997) AS ts", "id * 37 % 101 / 4D AS x", "id * 53 % 211 / 8D AS y")
    long, wide = labels.purged_folds(df, "asset", "ts", 5, 3), labels.purged_blocks(df, "asset", "ts", 5, 3)
    for fit in (lambda t: folds.median_baseline(t, "y"), lambda t: folds.fold_ridge(t, ["x"], "y")):
        a, b = ({(r["id"], r["fold"]): r["yhat"] for r in fit(t).collect()} for t in (long, wide))
        assert a.keys() == b.keys() and len(a) == 300 and all(math.isclose(a[k], b[k], rel_tol=1e-12) for k in a)


@pytest.mark.parametrize("query", ["fold_summary", "fold_asset_metrics", "fold_thresholds", "median_baseline"])
def test_a_row_an_event_is_written(spark, monkeypatch, query):
    counts, write = [], plans.written
    monkeypatch.setattr(plans, "written", lambda df, name="table": counts.append((t := write(df, name)).count()) or t)
    plans.Q[query](spark, EVENTS).collect()
    assert counts == [spark.read.parquet(f"{EVENTS}/events.parquet").count()]


def test_places_are_found_by_halving(spark):
    odd = [float("-inf"), -1.5, 0.0, 2.0, 2.0, 7.25, float("inf"), float("nan")]
    for n in (0, 1, 2, 5, 8, 31, 300):
        edges = sorted({round(float(x), 2) for x in np.random.default_rng(n).normal(size=n) * 5})
        df = spark.createDataFrame([(v, edges) for v in odd + edges[:40]], "_v double, _edges array<double>")
        got = [(r["_v"], r["_at"]) for r in quantiles._placed(df, max(1, n)).collect()]
        assert all(at == (len(edges) if math.isnan(v) else int(np.searchsorted(edges, v))) for v, at in got)


def test_rows_of_few_groups_are_not_dealt_by_group(spark, monkeypatch):
    plan, write = {}, quantiles.written

    def noted(df, name="table"):
        plan.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(quantiles, "written", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # no table is small
    try:
        df = spark.range(20_000).selectExpr("id % 2 AS g", "cast(id * 7919 % 20011 AS double) AS v")
        got = quantiles.exact_quantiles(df, "v", [0.5], ["g"], direct=1000)
        want = df.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("q"))
        assert {r["g"]: r["quantiles"][0] for r in got.collect()} == {r["g"]: r["q"] for r in want.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "filter(_edges" not in plan["cells"] and "BroadcastHashJoin" in plan["cells"]


def test_many_shares_are_one_expression(spark):
    """254 shares, as bins of boosting ask for, and no expression for each of them."""
    shares = [k / 255 for k in range(1, 255)]
    df = spark.range(6000).selectExpr("id % 3 AS g", "cast(id * 7919 % 1511 AS double) / 8 AS v")
    got = quantiles.exact_quantiles(df, "v", shares, ["g"], direct=500)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("element_at") < 8
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert {r["g"]: r["quantiles"] for r in got.collect()} == want


def test_rows_of_several_folds_are_placed_once(spark, monkeypatch):
    plan, write = {}, quantiles.written

    def noted(df, name="table"):
        plan[name] = plan.get(name, "") + df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(quantiles, "written", noted)
    df = spark.range(quantiles.DIRECT * 2).selectExpr("cast(id % 5 + 1 AS int) AS fold", "filter(sequence(1, 5), k -> k != id % 5 + 1) AS trains", "id * 7919 % 20011 / 8D AS y")
    t = write(df, "blocks")
    got = {r["fold"]: r["yhat"] for r in folds.fold_medians(t, "y").collect()}
    assert got == {r["fold"]: r["q"] for r in folds.train_rows(t).groupBy("fold").agg(F.percentile("y", F.lit(0.5)).alias("q")).collect()}
    over_all = [p for name, p in plan.items() if "Relation [fold#" in p and name != "cells"]
    assert over_all and not any("explode(trains" in p for p in over_all)
    assert "_at" in plan["cells"].split("Generate explode")[1]  # rows of wanted cells alone go on by fold


@pytest.mark.parametrize("direct", [1 << 16, 300, 20])
def test_quantiles_of_groups_that_share_rows(spark, direct):
    rng = np.random.default_rng(8)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.5]
    sets = [None, [], [1], [2, 3], [1, 2, 3, 4], [4], [5]]
    rows = [(sets[k % 7], odd[k // 7 % 7] if k % 3 == 0 else 2.0 if k % 7 == 6 else float(rng.normal(k % 7))) for k in range(4000)]
    df, shares = spark.createDataFrame(rows, "s array<int>, v double"), [0.0, 0.3, 0.5, 1.0]
    got = {r["g"]: (r["n"], r["quantiles"]) for r in quantiles.member_quantiles(df, "v", shares, "s", "g", direct=direct, cells=16).collect()}
    want = quantiles.exact_quantiles(df.select(F.explode("s").alias("g"), "v"), "v", shares, ["g"])
    assert str(sorted(got.items())) == str(sorted((r["g"], (r["n"], r["quantiles"])) for r in want.collect())) and len(got) == 5
    assert quantiles.member_quantiles(df.limit(0), "v", shares, "s", "g", direct=direct).collect() == []


def test_folds_of_rows_are_compiled(spark):
    df = spark.range(10).selectExpr("id % 2 AS asset", "timestamp_seconds(id) AS ts")
    plan = labels.purged_blocks(df, "asset", "ts", 5, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "lambda" not in plan
