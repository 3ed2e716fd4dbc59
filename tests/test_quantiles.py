"""Exact quantiles against percentile(), whatever the size of cells and sketches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def same(a, b):
    return all(x == y or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b, strict=True))


def values():
    rng = np.random.default_rng(4)
    rows = [("wide", float(x)) for x in rng.normal(size=3000) * 10.0 ** rng.integers(-8, 9, 3000)] + [("ties", float(x)) for x in rng.integers(0, 4, 2500)]
    rows += [("one", 7.5), ("equal", 2.0), ("equal", 2.0), ("equal", None), ("none", None), (None, 1.0), (None, 4.0), ("zeros", -0.0), ("zeros", 0.0)]
    return rows + [("odd", x) for x in [float("nan")] * 40 + [float("inf")] * 7 + [float("-inf")] * 3 + [float(k) for k in range(60)]]


@pytest.mark.parametrize("direct", [1 << 16, 500, 3, 0])
def test_groups(spark, direct):
    df = spark.createDataFrame(values(), "g string, x double").repartition(7)
    got = {r["g"]: (r["n"], r["quantiles"]) for r in quantiles.exact_quantiles(df, "x", SHARES, ["g"], direct=direct, sketch=20, margin=0.02).collect()}
    want = {r["g"]: (r["n"], r["q"]) for r in df.groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", F.array(*map(F.lit, SHARES))).alias("q")).where("n > 0").collect()}
    assert got.keys() == want.keys()
    for g, (n, q) in want.items():
        assert got[g][0] == n and same(got[g][1], q), g


def test_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 5.0)], "a double, b double")
    row = quantiles.quantile_row(df, {"a": F.col("a"), "b": F.abs("b"), "c": F.lit(None)}, [0.5, 1.0], {("a", 0): "mid", ("b", 1): "top", ("c", 0): "none"}).first()
    assert tuple(row) == (2.0, 5.0, None)
    assert quantiles.exact_quantiles(df.limit(0), "a", [0.5]).collect() == []
    assert tuple(quantiles.quantile_row(df.limit(0), {"a": F.col("a")}, [0.5], {("a", 0): "m"}).first()) == (None,)


def test_many_distinct_values(spark):
    n = 12_000_000
    df = spark.range(n, numPartitions=8).select((F.pmod(F.col("id") * 7_368_787, F.lit(n)) / 4).alias("x"))
    row = quantiles.exact_quantiles(df, "x", [0.5, 0.95]).first()
    assert row["n"] == n and row["quantiles"] == [(n - 1) / 8, ((n - 1) * 0.95 // 1 * (1 - (n - 1) * 0.95 % 1) + ((n - 1) * 0.95 // 1 + 1) * ((n - 1) * 0.95 % 1)) / 4]


def test_no_task_holds_the_values(spark):
    df = spark.range(200_000).select(F.rand(1).alias("x"))
    plan = quantiles.exact_quantiles(df, "x", [0.5], direct=1000)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan


def test_what_values_are_made_from_is_worked_out_once(spark):
    for direct in (1 << 16, 64):
        made = spark.sparkContext.accumulator(0)

        def counted(batches, made=made):
            for b in batches:
                made.add(len(b))
                yield b

        rows = spark.range(1000, numPartitions=2).selectExpr("id % 2 as g", "cast(id * 7919 % 1000 as double) as v").mapInPandas(counted, "g long, v double")
        assert {r["g"]: (r["n"], r["quantiles"][0]) for r in quantiles.exact_quantiles(rows, "v", [0.5], ["g"], direct=direct).collect()} == {0: (500, 499.0), 1: (500, 500.0)}
        assert made.value == 1000
