"""Models for time to the end: exact ridge, forests, boosting, baselines and their diagnostics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.metrics import risk_level
from cadenza.operators.quantiles import quantile_row
from cadenza.sources.shared import written


def train_medians(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row of exact medians; infinities count as missing."""
    return written(quantile_row(train, {f: F.when(F.abs(F.col(f)) != float("inf"), F.col(f)) for f in features}, [0.5], {(f, 0): f"_m_{f}" for f in features}), "medians")


def filled(df: DataFrame, medians: DataFrame, features: Sequence[str]) -> DataFrame:
    keep = [c for c in df.columns if c not in features]
    return df.crossJoin(F.broadcast(medians)).select(*keep, *(F.coalesce(F.when(F.abs(F.col(f)) != float("inf"), F.col(f)), f"_m_{f}", F.lit(0.0)).alias(f) for f in features))  # one row


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)


def balanced_weights(df: DataFrame, group: str) -> DataFrame:
    """Weights that sum to 1 in all and alike for each group."""
    n, groups = F.count(F.lit(1)).over(Window.partitionBy(group)), df.select(group).distinct().count()
    return df.withColumn("_w", 1.0 / (groups * n))


def ridge(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, group: str, alpha: float = 1.0) -> DataFrame:
    """Median fill and robust scaling fitted on train, weights alike by group, prediction not below 0.
    The solver's penalty is alpha times the weighted population deviation of the target over the sum of
    weights, which makes the result equal the closed form."""
    medians = train_medians(train, features)
    a, b = filled(train, medians, features), filled(test, medians, features)
    quartiles = quantile_row(a, {f: F.col(f) for f in features}, [0.25, 0.5, 0.75], {(f, k): f"_q{k}_{f}" for f in features for k in range(3)})
    spread = written(quartiles.select(*(F.col(f"_q1_{f}").alias(f"_c_{f}") for f in features), *(F.nullif(F.col(f"_q2_{f}") - F.col(f"_q0_{f}"), F.lit(0.0)).alias(f"_s_{f}") for f in features)), "spread")
    scale = lambda d: assembled(d.crossJoin(F.broadcast(spread)).select(*(c for c in d.columns if c not in features), *(((F.col(f) - F.col(f"_c_{f}")) / F.coalesce(f"_s_{f}", F.lit(1.0))).alias(f) for f in features)), features)
    weighted = balanced_weights(scale(a), group)
    s = weighted.agg(F.sum("_w").alias("w"), (F.sum(F.col("_w") * F.col(target)) / F.sum("_w")).alias("m"), (F.sum(F.col("_w") * F.col(target) * F.col(target)) / F.sum("_w")).alias("q")).first()
    sigma = max(0.0, s["q"] - s["m"] ** 2) ** 0.5
    model = LinearRegression(featuresCol="_x", labelCol=target, weightCol="_w", solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha * sigma / s["w"], predictionCol="yhat").fit(weighted)
    return model.transform(scale(b)).withColumn("yhat", F.greatest(F.lit(0.0), "yhat")).drop("_x")


def forest(train: DataFrame, features: Sequence[str], target: str, trees: int = 200, depth: int = 20, seed: int = 42):
    return RandomForestRegressor(featuresCol="_x", labelCol=target, predictionCol="yhat", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed).fit(assembled(train, features))


def boosted(train: DataFrame, features: Sequence[str], target: str, trees: int = 50, depth: int = 5, rate: float = 0.1, seed: int = 42):
    return GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="yhat", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.85, seed=seed).fit(assembled(train, features))


def predicted(model, test: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(assembled(test, features)).drop("_x")


def importances(model, features: Sequence[str], like: DataFrame) -> DataFrame:
    values = model.featureImportances.toArray().tolist()
    return like.sparkSession.createDataFrame(list(zip(features, values, strict=True)), "feature string, importance double")


def learning_curve(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, key: str, fractions: Sequence[float] = (0.25, 0.5, 0.75, 1.0), trees: int = 10, depth: int = 5) -> DataFrame:
    """MAE on test by share of train rows, drawn in hash order of the key."""
    share = F.pmod(F.xxhash64(F.lit(42), F.col(key)), F.lit(10_000)) / 10_000
    out = []
    for f in fractions:
        model = forest(train.where(share < f), features, target, trees, depth)
        mae = predicted(model, test, features).agg(F.avg(F.abs(F.col("yhat") - F.col(target)))).first()[0]
        out.append((f, mae))
    return train.sparkSession.createDataFrame(out, "fraction double, mae double")


def search(train: DataFrame, valid: DataFrame, features: Sequence[str], target: str, grid: Sequence[dict], kind=forest) -> DataFrame:
    """trial, settings (JSON), weighted_mae on valid, and rank, for every setting of a grid: keyword
    arguments of `kind`. Trials follow each other, each is a distributed fit."""
    import json

    from cadenza.operators.metrics import weighted_mae

    out = []
    for k, settings in enumerate(grid):
        found = predicted(kind(train, features, target, **settings), valid, features).select(F.col(target).alias("y"), "yhat")
        out.append((k, json.dumps(settings, sort_keys=True), weighted_mae(found).first()[0]))
    table = train.sparkSession.createDataFrame(out, "trial int, settings string, weighted_mae double")
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.col("weighted_mae").asc_nulls_last(), "trial")))


#: What is recommended at each level of risk: fixed values.
ACTIONS = {"critical": "Schedule emergency maintenance within 24 hours", "warning": "Schedule maintenance within 3-5 days", "normal": "Continue normal monitoring"}


def answered(requests: DataFrame, features: Sequence[str], predict: Callable[[DataFrame], DataFrame], body: str = "body") -> DataFrame:
    """requests with predicted_rul_hours (two digits), risk_level, recommended_action and problem, a batch of
    what a point service answers. A body is a JSON object whose `features` give every feature a number; one that
    doesn't has the problem `body` or `features` and no prediction. predict takes the features in order as columns
    and adds yhat."""
    parsed = requests.withColumn("_f", F.from_json(F.get_json_object(body, "$.features"), "map<string,double>"))
    given = F.map_keys("_f")
    missing = F.size(F.array_except(F.array(*map(F.lit, features)), given)) > 0
    null = F.exists(F.array(*(F.try_element_at("_f", F.lit(f)) for f in features)), lambda v: v.isNull() | F.isnan(v))
    problem = F.when(F.col("_f").isNull(), "body").when(missing | null, "features")
    rows = parsed.withColumn("problem", problem).select(*requests.columns, "problem", *(F.try_element_at("_f", F.lit(f)).alias(f) for f in features))
    good = predict(rows.where("problem IS NULL")).withColumn("predicted_rul_hours", F.round("yhat", 2)).withColumn("risk_level", risk_level(F.col("yhat")))
    action = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))[F.col("risk_level")]
    bad = rows.where("problem IS NOT NULL").withColumns({"predicted_rul_hours": F.lit(None).cast("double"), "risk_level": F.lit(None).cast("string"), "recommended_action": F.lit(None).cast("string")})
    out = [*requests.columns, "predicted_rul_hours", "risk_level", "recommended_action", "problem"]
    return good.withColumn("recommended_action", action).select(*out).unionByName(bad.select(*out))
