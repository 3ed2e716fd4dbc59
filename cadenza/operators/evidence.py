"""Evidence tables: fills fitted on train rows, bins, profiles, alert tables, clock predictors,
comparisons of metric tables, and names of derived features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import selection
from cadenza.operators.labels import seconds
from cadenza.operators.quantiles import quantile_row


def median_filled(df: DataFrame, train: Column, columns: Sequence[str]) -> DataFrame:
    """Null, NaN and infinite values take the median of the finite values of the train rows. The
    medians are one row."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    one = quantile_row(df.where(train), {c: finite(c) for c in columns}, [0.5], {(c, 0): f"_m_{c}" for c in columns})
    return df.crossJoin(F.broadcast(one)).select(*(F.coalesce(finite(c), f"_m_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))


def equal_width_bins(df: DataFrame, x: str, value: str, bins: int = 20) -> DataFrame:
    """Right-closed bins of equal width between the least and the greatest x, which the first bin
    includes: rows, middle, mean value."""
    ends = df.agg(F.min(x).alias("_lo"), ((F.max(x) - F.min(x)) / bins).alias("_w"))  # one row
    place = F.greatest(F.lit(1), F.least(F.lit(bins), F.coalesce(F.ceil(F.try_divide(F.col(x) - F.col("_lo"), F.col("_w"))), F.lit(1)))).cast("int")
    rows = df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bin", place)
    return rows.groupBy("bin", "_lo", "_w").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select("bin", "n", (F.col("_lo") + (F.col("bin") - 0.5) * F.col("_w")).alias("middle"), "mean")


def profile(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(ts).alias("times"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count_if(F.col(value).isNull()).alias("missing"))


def temporal_consistency(df: DataFrame, value: str, mean: str, slope: str, steep: float = 0.01, flag_pct: float = 5.0) -> DataFrame:
    """Distance of a value from its rolling mean, and the share of steep slopes."""
    away, share = F.abs(F.col(value) - F.col(mean)), 100.0 * F.count_if(F.abs(slope) > steep) / F.count(slope)
    return df.agg(F.avg(away).alias("mean_away"), F.max(away).alias("most_away"), share.alias("steep_pct"), (share > flag_pct).alias("flagged"))


def fold_pivot(df: DataFrame, feature: str, fold: str, folds: Sequence, value: str) -> DataFrame:
    """A row for each feature, a column for each fold, 0 where a fold has none."""
    return df.groupBy(feature).pivot(fold, list(folds)).agg(F.avg(value)).na.fill(0.0)


def alert_table(df: DataFrame, stream: str, order: Sequence[str], alert: str, baseline: int) -> DataFrame:
    """By stream: changes of the alert, its first time, whether it never came, its share of all rows
    and of the rows after the baseline, and the seconds from the first alert to the end."""
    w, ts = Window.partitionBy(stream).orderBy(*order), order[0]
    rows = df.withColumns({"_was": F.lag(alert).over(w), "_late": F.row_number().over(w) > baseline})
    first = F.min(F.when(F.col(alert), F.col(ts)))
    out = rows.groupBy(stream).agg(
        F.count_if(F.col("_was") != F.col(alert)).alias("transitions"), first.alias("first_alert"), (~F.bool_or(alert)).alias("missed"), F.avg(F.col(alert).cast("double")).alias("burden"),
        F.avg(F.when(F.col("_late"), F.col(alert).cast("double"))).alias("late_burden"), F.max(ts).alias("_end"),
    )
    return out.select("*", seconds(F.col("_end"), F.col("first_alert")).alias("lead_seconds")).drop("_end")


def clock_errors(df: DataFrame, stream: str, ts: str, target: str) -> DataFrame:
    """A predictor that only knows a stream's first target and the time since: largest and mean error."""
    w = Window.partitionBy(stream)
    guess = F.min_by(target, ts).over(w) - seconds(F.col(ts), F.min(ts).over(w))
    return df.withColumn("_e", F.abs(guess - F.col(target))).groupBy(stream).agg(F.max("_e").alias("worst"), F.avg("_e").alias("mean"))


def metric_deltas(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two metric tables by key: both values, absolute and relative difference, its sign; complete is
    false where one lacks the key."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full")
    d = F.col("b") - F.col("a")
    return both.select(key, "a", "b", d.alias("delta"), F.try_divide(d, F.abs("a")).alias("relative"), F.signum(d).cast("int").alias("sign"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("complete"))


def magnitude_percentiles(df: DataFrame, value: str, shares: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    return quantile_row(df, {value: F.abs(value)}, [*shares, 1.0], {(value, k): f"p{round(100 * s)}" for k, s in enumerate(shares)} | {(value, len(shares)): "most"})


def predictiveness(train: DataFrame, test: DataFrame) -> DataFrame:
    """Long-form values: Spearman of each feature in train and test, the change, and whether it flips."""
    one = lambda d, name: selection.relevance(d).select("feature", F.col("spearman").alias(name))
    both = one(train, "train").join(one(test, "test"), "feature", "full")
    return both.select("feature", "train", "test", (F.col("test") - F.col("train")).alias("delta"), (F.signum("train") * F.signum("test") < 0).alias("flips"))


#: The name of a derived feature: base, transform, parameter.
DERIVED = r"^(.+?)(?:_(mean|std|slope|ema)_([0-9]+)|_(diff|pct|z|max|min|avg|range))?$"


#: What a transform risks across folds, and what is safe: fixed values.
RISKS = {
    "base": ("none from fold preprocessing", "use base feature as stored"),
    "time": ("precomputed train rows can carry held-out raw history across folds", "recompute separately inside train/test split in timestamp order"),
    "asset": ("precomputed same-timestamp cross-axis aggregate can cross split membership", "recompute separately inside train/test split"),
    "whole": ("full bearing-axis mean/std uses validation/test distribution", "fit mean/std on training rows only; fallback to global train stats for unseen groups"),
}
#: Which of them a transform of parsed_names is.
KINDS = {"raw": "base", "mean": "time", "std": "time", "slope": "time", "ema": "time", "diff": "time", "pct": "time", "max": "asset", "min": "asset", "avg": "asset", "range": "asset", "z": "whole"}


def feature_audit(df: DataFrame, name: str) -> DataFrame:
    """parsed_names with leakage_risk and leakage_safe_method."""
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.col("transform")]
    text = lambda k: F.create_map(*(F.lit(x) for n, texts in RISKS.items() for x in (n, texts[k])))[kind]
    return parsed_names(df, name).select("*", text(0).alias("leakage_risk"), text(1).alias("leakage_safe_method"))


def audit_histogram(audit: DataFrame) -> DataFrame:
    """Features and distinct bases by transform and risk."""
    return audit.groupBy("transform", "leakage_risk").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("base").alias("bases"))


def parsed_names(df: DataFrame, name: str) -> DataFrame:
    """Adds base, transform, parameter and whether the transform looks at rows of other times, so that
    it must be fitted on train rows alone."""
    part = lambda k: F.regexp_extract(name, DERIVED, k)
    kind = F.coalesce(F.nullif(part(2), F.lit("")), F.nullif(part(4), F.lit("")), F.lit("raw"))
    return df.select("*", part(1).alias("base"), kind.alias("transform"), part(3).try_cast("int").alias("parameter"), (kind == "z").alias("needs_fit"))
