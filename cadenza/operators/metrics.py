"""Evaluation of predictions: regression, threshold, bin and calibration tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.labels import RUL_BINS, left_closed_bin, right_closed_bin
from cadenza.operators.quantiles import exact_quantiles


def Y() -> Column:  # noqa: N802
    return F.col("y")


def P() -> Column:  # noqa: N802
    return F.col("yhat")


def E() -> Column:  # noqa: N802
    return P() - Y()


def regression_metrics(df: DataFrame, by: Sequence[str] = (), critical: float = 50, kept: bool = False) -> DataFrame:
    """y, yhat: n, mae, rmse, r2 (null without variance), n and mae of critical rows, median error. kept: as in
    exact_quantiles."""
    n, mean_sq = F.count(F.lit(1)), F.avg(E() * E())
    means = df.groupBy(*by).agg(
        n.alias("n"), F.avg(F.abs(E())).alias("mae"), F.sqrt(mean_sq).alias("rmse"), F.when((n >= 2) & (F.var_pop(Y()) > 0), 1 - mean_sq / F.var_pop(Y())).alias("r2"),
        F.avg(E()).alias("bias"), F.count_if(critical >= Y()).alias("critical_n"), F.avg(F.when(critical >= Y(), F.abs(E()))).alias("critical_mae"),
    )
    return with_median(df, means, F.abs(E()), by, kept).select(*by, "n", "mae", "rmse", "r2", "median_ae", "bias", "critical_n", "critical_mae")


def with_median(df: DataFrame, table: DataFrame, value: Column, by: Sequence[str] = (), kept: bool = False) -> DataFrame:
    """table, a row for each group of df, and median_ae: the exact median of a value, null without one."""
    mids = exact_quantiles(df, value, [0.5], by, kept=kept).select(F.struct(F.lit(0), *by).alias("_of"), F.col("quantiles")[0].alias("median_ae"))
    return table.withColumn("_of", F.struct(F.lit(0), *by)).join(mids, "_of", "left").drop("_of")


def threshold_metrics(df: DataFrame, thresholds: Sequence[float] = (50, 100), by: Sequence[str] = ()) -> DataFrame:
    """Alert when y or yhat is at most the threshold: counts and rates, null where undefined."""
    each = df.select("*", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    t = F.col("threshold")
    c = {"tp": (t >= Y()) & (t >= P()), "fp": (t < Y()) & (t >= P()), "fn": (t >= Y()) & (t < P()), "tn": (t < Y()) & (t < P())}
    out = each.groupBy(*by, "threshold").agg(*(F.count_if(v).alias(k) for k, v in c.items()))
    rate = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return out.select("*", rate("tp", "fp").alias("precision"), rate("tp", "fn").alias("recall"), rate("fp", "tn").alias("fpr"), rate("fn", "tp").alias("miss_rate"))


def _all_bins(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f"{a}-{b}",) for a, b in zip(RUL_BINS, RUL_BINS[1:], strict=False)], "bin string")


def bin_counts(df: DataFrame) -> DataFrame:
    """Rows by right-closed bin of y, empty bins with 0."""
    return _all_bins(df).join(df.select(right_closed_bin(Y()).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def range_errors(df: DataFrame) -> DataFrame:
    return df.withColumn("bin", left_closed_bin(Y())).where("bin IS NOT NULL").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(E())).alias("mae"), F.sqrt(F.avg(E() * E())).alias("rmse"), (100 * F.avg(F.abs(E()) / (Y() + 1e-10))).alias("mape"), F.avg(100 * F.abs(E()) / F.nullif(Y(), F.lit(0.0))).alias("mape_defined"))


def residual_bins(df: DataFrame) -> DataFrame:
    """Errors by right-closed bin of y; empty bins have 0 rows and null errors."""
    rows = df.withColumn("bin", right_closed_bin(Y())).where("bin IS NOT NULL")
    by = rows.groupBy("bin").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(F.abs(E())).alias("mae"), F.avg(E()).alias("bias"), F.min(E()).alias("least"), F.max(E()).alias("most"))
    by = with_median(rows, by, F.abs(E()), ["bin"])
    return _all_bins(df).join(by, "bin", "left").select("bin", F.coalesce("_n", F.lit(0)).alias("n"), "mae", "median_ae", "bias", "least", "most")


def calibration(df: DataFrame, parts: int = 10) -> DataFrame:
    """By quantile bin of the prediction (right-closed, equal edges merged): means, mae, bias. The
    edges are one row."""
    edges = exact_quantiles(df, P(), [k / parts for k in range(parts + 1)]).select(F.array_distinct("quantiles").alias("_edges"))
    binned = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("_edges", lambda e: e < P()))))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(P()).alias("mean_pred"), F.avg(Y()).alias("mean_true"), F.avg(F.abs(E())).alias("mae"), F.avg(E()).alias("bias"))


def strategy_summary(folds: DataFrame) -> DataFrame:
    """fold rows (strategy, n, mae, rmse, r2, critical_n, critical_mae): plain and weighted means."""
    weighted = lambda x, w: F.try_divide(F.sum(F.when(F.col(x).isNotNull() & (F.col(w) > 0), F.col(x) * F.col(w))), F.sum(F.when(F.col(x).isNotNull() & (F.col(w) > 0), F.col(w))))
    return folds.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("folds"), F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse"), F.avg("r2").alias("mean_r2"),
        weighted("mae", "n").alias("weighted_mae"), weighted("rmse", "n").alias("weighted_rmse"), weighted("critical_mae", "critical_n").alias("weighted_critical_mae"),
    )


def weighted_mae(df: DataFrame) -> DataFrame:
    """Errors weigh more near the end: 1 + 1 / (y + 10)."""
    return df.agg(F.avg(F.abs(E()) * (1 + 1 / (Y() + 10))).alias("weighted_mae"))


def risk_score(miss50: Column, far100: Column, critical_mae: Column, mae: Column) -> Column:
    return 5 * miss50 + 2 * far100 + F.least(critical_mae / 50, F.lit(5.0)) + 0.5 * F.least(mae / 250, F.lit(5.0))


def compared(before: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of two metric tables."""
    a, b = before.select(F.col(key).alias("_a"), F.col(value).alias("before")), now.select(F.col(key).alias("_b"), F.col(value).alias("now"))
    return a.join(b, F.col("_a").eqNullSafe(F.col("_b")), "full").select(F.coalesce("_a", "_b").alias(key), "before", "now", (F.col("now") - F.col("before")).alias("delta"))


def risk_level(hours: Column, policy: str = "serving") -> Column:
    """serving: below 50 critical, below 150 warning; offline: up to 50, up to 100."""
    if policy == "serving":
        return F.when(hours < 50, "critical").when(hours < 150, "warning").otherwise("normal")
    return F.when(hours <= 50, "critical").when(hours <= 100, "warning").otherwise("normal")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """Maximal runs of rows of a state: first, last and number of rows of each."""
    w, ws = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys, state).orderBy(*order)
    runs = df.withColumn("_run", F.row_number().over(w) - F.row_number().over(ws))
    return runs.groupBy(*keys, state, "_run").agg(F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("first_ts"), F.max(order[0]).alias("last_ts")).drop("_run")
