"""Queries of evaluation over folds, and their SQL. Five purged folds of three positions' gap."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import registry, signal
from cadenza.operators import folds, labels, metrics
from cadenza.plans import assets, evidence, streams
from cadenza.plans.streams import ORDER, events, rounded
from cadenza.sources.shared import written

Q, S = {}, {}


def _add(name: str, sql: str, exact: bool = False):
    def keep(f):
        Q[name] = f if exact else lambda spark, d: rounded(f(spark, d))
        S[name] = sql
        return f

    return keep


def _folds(s, d):
    return labels.purged_folds(events(s, d), "user_id", "ts", 5, 3)


def _targets(s, d):
    """Folds with hours to the user's last event as target, written once for all that reads them."""
    end = events(s, d).groupBy(F.col("user_id").alias("_u")).agg(F.max("ts").alias("_end"))
    return written(_folds(s, d).join(end, F.col("user_id") == F.col("_u")).withColumn("y", labels.seconds(F.col("_end"), F.col("ts")) / 3600).drop("_u", "_end"), "targets")


def _blocks(s, d):
    """The same with a row an event: its target, the fold that tests it and those that train on it."""
    made = labels.purged_blocks(events(s, d), "user_id", "ts", 5, 3)
    y = labels.seconds(F.max("ts").over(Window.partitionBy("user_id")), F.col("ts")) / 3600
    return written(made.select("event_id", "user_id", "value", "fold", "trains", y.alias("y")), "blocks")


_LOCAL = "PARTITION BY fold, role, user_id, event_type ORDER BY ts, event_id"
_USED = "u AS (SELECT * FROM fol WHERE role <> 'purged')"
_FITTED = "tr AS (SELECT * FROM u WHERE role = 'train'), g AS (SELECT fold, user_id, event_type, avg(value) AS m, stddev_samp(value) AS sd FROM tr GROUP BY ALL), w AS (SELECT fold, avg(value) AS gm, stddev_samp(value) AS gs FROM tr GROUP BY ALL)"


@_add("fold_features", f"""WITH {streams._FOLD}, {_USED}, {_FITTED}
SELECT event_id, fold, role, list_reduce(list(value) OVER ({_LOCAL}), lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a) AS value_ema_30, round(avg(value) OVER ({_LOCAL} ROWS 4 PRECEDING), 6) AS value_mean_5, round(stddev_samp(value) OVER ({_LOCAL} ROWS 4 PRECEDING), 6) AS value_std_5,
 round(max(value) OVER x, 6) AS value_max, round(min(value) OVER x, 6) AS value_min, round(avg(value) OVER x, 6) AS value_avg, round(max(value) OVER x - min(value) OVER x, 6) AS value_range, round((value - coalesce(m, gm)) / (coalesce(nullif(sd, 0), nullif(gs, 0), 1e-8) + 1e-8), 6) AS value_z
FROM u LEFT JOIN g USING (fold, user_id, event_type) LEFT JOIN w USING (fold) WINDOW x AS (PARTITION BY fold, role, user_id, ts)""", exact=True)
def _(s, d):
    # the average of values with two decimals ends in a 5 too often to be rounded alike; it is compared as it is
    out = folds.fold_features(_folds(s, d), "value", "user_id", "event_type", ORDER, (5,), (0.3,)).drop("ts", "user_id", "event_type", "value")
    return out.select("event_id", "fold", "role", "value_ema_30", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("event_id", "fold", "role", "value_ema_30")))


_Y = f"{streams._FOLD}, en AS (SELECT user_id, max(ts) AS e FROM events GROUP BY 1), fy AS (SELECT fol.*, {streams._epoch('ts', 'e')} / 3600 AS y FROM fol JOIN en USING (user_id))"
#: Predictions of the median of train targets, and of a ridge on the value.
_MEDIAN = "md AS (SELECT * FROM fy JOIN (SELECT fold, median(y) AS yhat FROM fy WHERE role = 'train' GROUP BY 1) USING (fold) WHERE role = 'test')"
_RIDGE = "st AS (SELECT fold, avg(value) AS m, stddev_pop(value) AS sd, avg(y) AS my, count(*) AS n, covar_pop(value, y) AS c FROM fy WHERE role = 'train' GROUP BY 1), rg AS (SELECT fy.*, greatest(0, my + (n * c / sd) / (n + 1) * (value - m) / sd) AS yhat FROM fy JOIN st USING (fold) WHERE role = 'test')"


@_add("median_baseline", f"WITH {_Y}, {_MEDIAN} SELECT event_id, fold, round(y, 6) AS y, round(yhat, 6) AS yhat FROM md")
def _(s, d):
    return folds.median_baseline(_blocks(s, d), "y").select("event_id", "fold", "y", "yhat")


@_add("fold_ridge", f"WITH {_Y}, {_RIDGE} SELECT event_id, fold, round(y, 6) AS y, round(yhat, 6) AS yhat FROM rg")
def _(s, d):
    return folds.fold_ridge(_blocks(s, d), ["value"], "y").select("event_id", "fold", "y", "yhat")


def _predicted(s, d):
    """A row a strategy and event, made from the blocks and a row a fold."""
    t = _blocks(s, d)
    both = folds.fold_ridge(t, ["value"], "y").withColumnRenamed("yhat", "ridge").join(F.broadcast(folds.fold_medians(t, "y")).withColumnRenamed("yhat", "median"), "fold", "left")  # a row a fold
    return both.select("fold", "user_id", "y", F.inline(F.array(*(F.struct(F.lit(name).alias("strategy"), F.col(name).alias("yhat")) for name in ("median", "ridge")))))


_BOTH = f"{_Y}, {_MEDIAN}, {_RIDGE}, p AS (SELECT 'median' AS strategy, fold, user_id, y, yhat FROM md UNION ALL SELECT 'ridge', fold, user_id, y, yhat FROM rg)"


@_add("fold_table", f"""WITH {_Y}, pl AS (SELECT *, row_number() OVER (PARTITION BY fold, user_id ORDER BY ts) AS at FROM (SELECT DISTINCT fold, user_id, ts, role FROM fol)),
gap AS (SELECT a.fold, min(abs(a.at - b.at)) AS nearest_gap FROM pl a JOIN pl b ON a.fold = b.fold AND a.user_id = b.user_id AND b.role = 'train' WHERE a.role = 'test' GROUP BY 1),
ov AS (SELECT fold, count_if(r > 1) AS overlap FROM (SELECT fold, user_id, ts, count(DISTINCT role) AS r FROM fol WHERE role <> 'purged' GROUP BY ALL) GROUP BY 1)
SELECT fold, count_if(role = 'train') AS train_rows, count_if(role = 'test') AS test_rows, count(DISTINCT CASE WHEN role = 'train' THEN user_id END) AS train_assets, count(DISTINCT CASE WHEN role = 'test' THEN user_id END) AS test_assets,
 round(min(CASE WHEN role = 'train' THEN y END), 6) AS train_min, round(max(CASE WHEN role = 'train' THEN y END), 6) AS train_max, round(min(CASE WHEN role = 'test' THEN y END), 6) AS test_min, round(max(CASE WHEN role = 'test' THEN y END), 6) AS test_max, any_value(nearest_gap) AS nearest_gap, any_value(overlap) AS overlap
FROM fy LEFT JOIN gap USING (fold) LEFT JOIN ov USING (fold) GROUP BY fold""")
def _(s, d):
    return folds.fold_table(_targets(s, d), "user_id", "ts", "y")


@_add("fold_metrics", f"WITH {_BOTH} SELECT strategy, fold, {streams._REG} FROM p GROUP BY strategy, fold")
def _(s, d):
    return folds.fold_metrics(_predicted(s, d), kept=True)


@_add("fold_asset_metrics", f"WITH {_BOTH} SELECT strategy, fold, user_id, {streams._REG} FROM p GROUP BY ALL")
def _(s, d):
    return folds.fold_metrics(_predicted(s, d), ["strategy", "fold", "user_id"], kept=True)


@_add("fold_thresholds", f"WITH {_BOTH} SELECT strategy, fold, threshold, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(fn + tp, 0), 6) AS miss_rate FROM (SELECT strategy, fold, t AS threshold, count_if(y <= t AND yhat <= t) AS tp, count_if(y > t AND yhat <= t) AS fp, count_if(y <= t AND yhat > t) AS fn, count_if(y > t AND yhat > t) AS tn FROM p, (VALUES (50.0::DOUBLE), (100.0)) v(t) GROUP BY ALL)")
def _(s, d):
    return folds.fold_thresholds(_predicted(s, d))


@_add("fold_distribution", f"WITH {_Y}, b AS (SELECT fold, role, {streams._BIN} AS bin FROM fy WHERE role <> 'purged'), c AS (SELECT fold, role, bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY fold, role), 6) AS share FROM c")
def _(s, d):
    return folds.target_distribution(_targets(s, d), "y")


@_add("fold_summary", f"WITH {_BOTH}, f AS (SELECT strategy, fold, count(*) AS n, avg(abs(yhat - y)) AS mae, sqrt(avg((yhat - y) * (yhat - y))) AS rmse, CASE WHEN count(*) >= 2 AND var_pop(y) > 0 THEN 1 - avg((yhat - y) * (yhat - y)) / var_pop(y) END AS r2, count_if(y <= 50) AS cn, avg(CASE WHEN y <= 50 THEN abs(yhat - y) END) AS cm FROM p GROUP BY ALL) SELECT strategy, count(*) AS folds, round(avg(mae), 6) AS mean_mae, round(avg(rmse), 6) AS mean_rmse, round(avg(r2), 6) AS mean_r2, round(sum(mae * n) / sum(n), 6) AS weighted_mae, round(sum(rmse * n) / sum(n), 6) AS weighted_rmse, round(sum(cm * cn) / sum(CASE WHEN cm IS NOT NULL THEN cn END), 6) AS weighted_critical_mae FROM f GROUP BY strategy")
def _(s, d):
    return metrics.strategy_summary(folds.fold_metrics(_predicted(s, d), kept=True))


@_add("fold_stability", "WITH v AS (SELECT user_id % 4 AS fold, event_type AS feature, avg(value) AS importance FROM events GROUP BY ALL) SELECT a.fold AS fold_i, b.fold AS fold_j, count(*) AS n, round(corr(a.importance, b.importance), 6) AS corr FROM v a JOIN v b ON a.feature = b.feature AND a.fold < b.fold GROUP BY ALL")
def _(s, d):
    values = events(s, d).groupBy((F.col("user_id") % 4).alias("fold"), F.col("event_type").alias("feature")).agg(F.avg("value").alias("importance"))
    return folds.fold_stability(values)


# ---- recordings: a vector stands for a channel of 64 samples, 7 windows of 16 ----

_PAIRS = ", ".join(f"round(avg({n}), 6), round(stddev_pop({n}), 6)" for n in registry.NAMES)


@_add("feature_rows", f"{evidence._REGISTRY} SELECT vec_id, label, [{_PAIRS}] AS feature_values, [{', '.join(f'count({n})::INT' for n in registry.NAMES)}] AS valid_window_counts, count(*)::INT AS window_count FROM r GROUP BY vec_id, label")
def _(s, d):
    # the id covers no measured value; it is tested by itself. Values are rounded once, as in the SQL
    rows = registry.feature_rows(assets._signals(s, d), "vec_id", "label", "x", width=16, step=8, windows=7, fs=64.0, edges=(8.0, 20.0), quantise=False)
    return rows.drop("feature_row_id").withColumn("feature_values", F.transform("feature_values", lambda v: streams.rounded_as_sql(v)))


@_add("resampled", """
WITH d AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * j / 64)) AS re, -sum(x * sin(2 * pi() * k * j / 64)) AS im FROM (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings), (SELECT unnest(range(25)) AS k) GROUP BY ALL)
SELECT vec_id, m::INT AS place, round(sum(CASE WHEN k IN (0, 24) THEN 1 ELSE 2 END * CASE WHEN k = 24 THEN 2 * re * cos(pi() * m) ELSE re * cos(2 * pi() * k * m / 48) - im * sin(2 * pi() * k * m / 48) END) / 64, 6) AS x FROM d, (SELECT unnest(range(48)) AS m) GROUP BY ALL""")
def _(s, d):
    return signal.resampled(assets._signals(s, d).select("vec_id", "x"), "x", 64.0, 48.0).select("vec_id", F.posexplode("x").alias("place", "x"))
