"""Data-quality profiles: each is one or two aggregations, unpivoted into long tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import blocks
from cadenza.operators.quantiles import quantile_row


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """A row for each value: keep, feature, value."""
    return df.select(*keep, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(list(keep), list(columns), "feature", "value")


def null_profile(df: DataFrame, columns: Sequence[str], flag_pct: float = 5.0) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    share = 100.0 * F.col("nulls") / F.col("_n")
    return one.unpivot(["_n"], list(columns), "column_name", "nulls").select("column_name", "nulls", share.alias("pct"), (share > flag_pct).alias("flagged"))


def outlier_profile(df: DataFrame, columns: Sequence[str], limit: float = 3.0, flag_pct: float = 1.0) -> DataFrame:
    """|z| above the limit with the population deviation, nulls left out. Two passes; the first gives
    a row a column."""
    values = long_form(df, columns).where("value IS NOT NULL")
    stats = values.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    far = F.coalesce(F.abs(F.try_divide(F.col("value") - F.col("_m"), F.col("_s"))) > limit, F.lit(False))
    out = values.join(stats, "feature").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_if(far).alias("outliers"))
    return out.select("*", (100.0 * F.col("outliers") / F.col("n") > flag_pct).alias("flagged"))


def early_late_drift(df: DataFrame, feature: str, keys: Sequence[str], order: Sequence[str], share: float = 0.2, flag_pct: float = 20.0) -> DataFrame:
    """Means of the first int(share n) and the last rows from int((1 - share) n), and the change."""
    at, n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1, F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = df.withColumns({"_early": at < F.floor(share * n), "_late": at >= F.floor((1 - share) * n)})
    out = rows.groupBy(*keys).agg(F.avg(F.when(F.col("_early"), F.col(feature))).alias("early"), F.avg(F.when(F.col("_late"), F.col(feature))).alias("late"))
    change = 100.0 * (F.col("late") - F.col("early")) / (F.col("early") + 1e-10)
    return out.select("*", change.alias("change_pct"), (F.abs(change) > flag_pct).alias("flagged"))


def range_violations(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    dim = df.sparkSession.createDataFrame([(f, float(a), float(b)) for f, (a, b) in bounds.items()], "feature string, low double, high double")
    values = long_form(df, list(bounds)).join(F.broadcast(dim), "feature")  # a row a feature
    return values.groupBy("feature", "low", "high").agg(F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("violations"))


def duplicate_rows(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - F.count_distinct(ts)).alias("duplicates")).where("duplicates > 0")


def cadence(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Steps between rows by stream: least, most, distinct, and whether time strictly rises."""
    step = F.timestamp_diff("MICROSECOND", F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts)), F.col(ts)) / F.lit(1e6)
    return df.withColumn("_step", step).groupBy(*keys).agg(F.min("_step").alias("least"), F.max("_step").alias("most"), F.count_distinct("_step").alias("distinct_steps"), F.coalesce(F.bool_and(F.col("_step") > 0), F.lit(True)).alias("strict"))


def artifact_checks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    by = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(value).isNull()).alias("_null"), F.count_if(F.abs(F.col(value)) == float("inf")).alias("_inf"))
    return by.agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("dup_rows"), F.sum("_null").alias("missing"), F.sum("_inf").alias("infinite"))


def basic_stats(df: DataFrame, ts: str, target: str, known: str) -> DataFrame:
    """One row: rows, columns, first and last time with whole days between, rows by side of a flag with their
    shares, and least, greatest, mean and exact median of the target where it is there."""
    days = F.floor(F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)) / 86_400_000_000)
    share = lambda c: 100.0 * F.try_divide(F.count_if(c), F.count(F.lit(1)))
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), days.alias("days"),
        F.count_if(known).alias("known"), share(F.col(known)).alias("known_pct"), F.count_if(~F.col(known)).alias("censored"), share(~F.col(known)).alias("censored_pct"),
        F.min(target).alias("least"), F.max(target).alias("most"), F.avg(target).alias("mean"),
    )
    return one.crossJoin(F.broadcast(quantile_row(df, {target: F.col(target)}, [0.5], {(target, 0): "median"})))  # one row each


def diagnostics(df: DataFrame, order: Sequence[str], size: str, digest: str) -> DataFrame:
    """One row about a table of recordings in order of time (order begins with it): least, most and distinct
    seconds between neighbours, least, most and distinct sizes, groups of repeated content and their rows.
    Neighbours meet by their place, which ranges number, so no task orders all rows."""
    ts = order[0]
    placed = blocks.numbered(df.select(*order, F.col(size).alias("_size"), F.col(digest).alias("_digest")), order, "_at")
    before = placed.select((F.col("_at") + 1).alias("_at"), F.col(ts).alias("_was"))
    step = F.timestamp_diff("MICROSECOND", F.col("_was"), F.col(ts)) / F.lit(1e6)
    steps = placed.join(before, "_at").agg(F.min(step).alias("least_step"), F.max(step).alias("most_step"), F.count_distinct(step).alias("distinct_steps"))
    sizes = placed.agg(F.min("_size").alias("least_size"), F.max("_size").alias("most_size"), F.count_distinct("_size").alias("distinct_sizes"))
    groups = placed.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.count(F.lit(1)).alias("repeated_groups"), F.coalesce(F.sum("_n"), F.lit(0)).alias("repeated_rows"))
    return steps.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(groups))  # one row each


def channel_diagnostics(df: DataFrame, channel: str, signal: str) -> DataFrame:
    """By channel: least and greatest sample of all recordings, and in how many it is constant."""
    low, high = F.array_min(signal), F.array_max(signal)
    return df.groupBy(channel).agg(F.min(low).alias("least"), F.max(high).alias("most"), F.count_if(low == high).alias("constant"))


def group_summary(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    first, last = F.min_by(value, ts), F.max_by(value, ts)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.floor(F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)) / 86_400_000_000).alias("days"), first.alias("first"), last.alias("last"),
        (100.0 * F.try_divide(last - first, first)).alias("change_pct"), F.max(value).alias("most"), F.avg(value).alias("mean"),
    )
