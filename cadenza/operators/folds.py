"""Evaluation over folds in one plan: features that know only their own fold and role, models fitted for
each fold, and the tables of their errors. A fold is a column; nothing loops over folds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import labels, metrics, temporal
from cadenza.operators.quantiles import exact_quantiles, member_quantiles
from cadenza.sources.shared import written


def fold_features(folds: DataFrame, feature: str, asset: str, view: str, order: Sequence[str], widths: Sequence[int] = (3, 5, 10), alphas: Sequence[float] = (0.1, 0.3, 0.5)) -> DataFrame:
    """folds: rows with fold and role. Rolling, exponential and cross-view features from the rows of the
    same fold and role alone, z-scores fitted on the fold's train rows; purged rows have none and go."""
    used = written(folds.where("role != 'purged'"), "folds")
    keys = ["fold", "role", asset, view]
    averaged = temporal.ema(used, feature, keys, order, alphas)
    columns = temporal.rolling(feature, keys, order, widths) | temporal.cross_views(feature, ["fold", "role", asset, order[0]])
    local = averaged.select("*", *(c.alias(n) for n, c in columns.items()))
    return labels.fitted_zscore(local, feature, [asset, view], used)


def train_rows(folds: DataFrame) -> DataFrame:
    """A row for each fold that trains on a row; folds as of purged_folds (role) or purged_blocks (trains)."""
    return folds.withColumn("fold", F.explode("trains")).drop("trains") if "trains" in folds.columns else folds.where("role = 'train'")


def test_rows(folds: DataFrame) -> DataFrame:
    return folds.drop("trains") if "trains" in folds.columns else folds.where("role = 'test'")


def fold_medians(folds: DataFrame, target: str) -> DataFrame:
    """fold, yhat: the median of the target over the fold's train rows. Rows of purged_blocks are read in
    several passes, so they should be written."""
    mids = member_quantiles(folds, target, [0.5], "trains", "fold", kept=True) if "trains" in folds.columns else exact_quantiles(train_rows(folds), target, [0.5], ["fold"])
    return written(mids.select("fold", F.col("quantiles")[0].alias("yhat")), "medians")


def median_baseline(folds: DataFrame, target: str) -> DataFrame:
    """Test rows with yhat: the median of the target over the fold's train rows."""
    return test_rows(folds).join(F.broadcast(fold_medians(folds, target)), "fold", "left")  # a row a fold


def fold_ridge(folds: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> DataFrame:
    """Test rows with yhat of a ridge regression fitted on the fold's train rows: features centred and
    scaled by train mean and population deviation (1 where there is none), nulls at the mean, an
    intercept without penalty, predictions not below 0.

    Fitting takes one grouping for means and one for the sums of products; (features + 1) ** 2 numbers a
    fold are all that a solver sees."""
    train = train_rows(folds).where(F.col(target).isNotNull())
    scale = written(train.groupBy("fold").agg(*(F.avg(f).alias(f"_m{i}") for i, f in enumerate(features)), *(F.stddev_pop(f).alias(f"_s{i}") for i, f in enumerate(features)), F.avg(target).alias("_my")), "scale")
    z = [F.coalesce((F.col(f) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0), F.lit(0.0)) for i, f in enumerate(features)]
    p = len(features)
    scaled = train.join(F.broadcast(scale), "fold").select("fold", *(c.alias(f"_z{i}") for i, c in enumerate(z)), (F.col(target) - F.col("_my")).alias("_y"))
    sums = scaled.groupBy("fold").agg(*(F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"_{i}_{j}") for i in range(p) for j in range(i, p)), *(F.sum(F.col(f"_z{i}") * F.col("_y")).alias(f"_{i}_y") for i in range(p)))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                a = np.array([[r[f"_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
                out.append(np.linalg.solve(a + alpha * np.eye(p), np.array([r[f"_{i}_y"] for i in range(p)], float)).tolist())
            yield pd.DataFrame({"fold": b["fold"], "_b": out})

    fold_type = folds.schema["fold"].dataType.simpleString()
    fitted = written(sums.mapInPandas(solve, f"fold {fold_type}, _b array<double>").join(F.broadcast(scale), "fold"), "ridge")
    rows = test_rows(folds)
    test = rows.join(F.broadcast(fitted), "fold", "left")  # a row a fold
    yhat = F.col("_my")
    for i, c in enumerate(z):
        yhat = yhat + F.get("_b", F.lit(i)) * c
    return test.select(*rows.columns, F.greatest(F.lit(0.0), yhat).alias("yhat"))


def fold_table(folds: DataFrame, asset: str, ts: str, target: str) -> DataFrame:
    """By fold: rows, assets and range of the target in train and test, the least distance between
    them in positions of one asset, and the keys that both have."""
    role = lambda r, x: F.when(F.col("role") == r, x)
    y = F.col(target)
    by = folds.groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("train_rows"), F.count_if(F.col("role") == "test").alias("test_rows"),
        F.count_distinct(role("train", F.col(asset))).alias("train_assets"), F.count_distinct(role("test", F.col(asset))).alias("test_assets"),
        F.min(role("train", y)).alias("train_min"), F.max(role("train", y)).alias("train_max"), F.min(role("test", y)).alias("test_min"), F.max(role("test", y)).alias("test_max"),
    )
    gap = labels.nearest_train_gap(folds, asset, ts).groupBy("fold").agg(F.min("min_gap").alias("nearest_gap"))
    return by.join(gap, "fold", "left").join(labels.fold_overlap(folds, [asset, ts]), "fold", "left")


def fold_metrics(predictions: DataFrame, by: Sequence[str] = ("strategy", "fold"), kept: bool = False) -> DataFrame:
    """predictions: y, yhat and the columns of by. Regression metrics for each. kept: as in exact_quantiles."""
    return metrics.regression_metrics(predictions, list(by), kept=kept)


def fold_thresholds(predictions: DataFrame, by: Sequence[str] = ("strategy", "fold"), thresholds: Sequence[float] = (50, 100)) -> DataFrame:
    return metrics.threshold_metrics(predictions, thresholds, list(by))


def target_distribution(folds: DataFrame, target: str) -> DataFrame:
    """By fold, role and right-closed bin of the target: rows and their share of the fold's role."""
    binned = folds.where("role != 'purged'").select("fold", "role", labels.right_closed_bin(F.col(target)).alias("bin")).where("bin IS NOT NULL")
    counts = binned.groupBy("fold", "role", "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("*", (F.col("n") / F.sum("n").over(Window.partitionBy("fold", "role"))).alias("share"))


def fold_stability(values: DataFrame, key: str = "feature", fold: str = "fold", value: str = "importance") -> DataFrame:
    """For each two folds: the Pearson correlation of their importances over the features that both
    have, and how many those are."""
    a = values.select(F.col(key).alias("_k"), F.col(fold).alias("fold_i"), F.col(value).alias("_a"))
    b = values.select(F.col(key).alias("_l"), F.col(fold).alias("fold_j"), F.col(value).alias("_b"))
    pairs = a.join(b, (F.col("_k") == F.col("_l")) & (F.col("fold_i") < F.col("fold_j")))
    return pairs.groupBy("fold_i", "fold_j").agg(F.count(F.lit(1)).alias("n"), F.corr("_a", "_b").alias("corr"))
