"""Queries over event streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import labels, metrics, quality, temporal

KEYS, ORDER = ["user_id", "event_type"], ["ts", "event_id"]


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def rounded_as_sql(x: Column, digits: int = 6) -> Column:
    """x rounded as DuckDB rounds it, where the sign of a zero or a tie counts: the product's half goes away from
    zero, and a small negative value is -0.0."""
    return F.signum(x) * (F.round(F.abs(x) * 10.0**digits) / 10.0**digits)


def rul(spark: SparkSession, d: str) -> DataFrame:
    return labels.rul_labels(events(spark, d), "user_id", "ts", F.col("user_id") % 2 == 0)


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """y: hours to the stream's end; yhat: a fixed function of it and the value."""
    df = labels.rul_labels(events(spark, d), "user_id", "ts", F.lit(True))
    return df.select("event_id", "user_id", "event_type", "ts", F.col("rul_hours").alias("y"), (0.8 * F.col("rul_hours") + F.col("value") / 10).alias("yhat"))


_W = "PARTITION BY user_id, event_type ORDER BY ts, event_id"
_E = "event_id, ts, user_id, event_type, value"


def _epoch(a: str, b: str) -> str:
    return f"(epoch_us({b}) - epoch_us({a})) / 1e6"


_P = f"SELECT event_id, user_id, event_type, ts, y, 0.8 * y + value / 10 AS yhat FROM (SELECT *, {_epoch('ts', 'max(ts) OVER (PARTITION BY user_id)')} / 3600 AS y FROM events)"


def _roll(w: int) -> str:
    f = f"OVER ({_W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"round(avg(value) {f}, 6) AS value_mean_{w}, round(stddev_samp(value) {f}, 6) AS value_std_{w}"


def _slope(w: int) -> str:
    f = f"OVER ({_W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) {f} >= 2 THEN round(regr_slope(value, p) {f}, 6) END AS value_slope_{w}"


_ROLL = ", ".join(map(_roll, (3, 5, 10)))
_SLOPE = ", ".join(map(_slope, (5, 10)))
_DELTA = f"round(coalesce(value - lag(value) OVER ({_W}), 0), 6) AS value_diff, round(CASE WHEN lag(value) OVER ({_W}) IS NULL THEN 0 ELSE (value - lag(value) OVER ({_W})) / nullif(lag(value) OVER ({_W}), 0) END, 6) AS value_pct"
_Z = "round((value - avg(value) OVER g) / (stddev_samp(value) OVER g + 1e-8), 6) AS value_z"
_CROSS = "round(max(value) OVER x, 6) AS value_max, round(min(value) OVER x, 6) AS value_min, round(avg(value) OVER x, 6) AS value_avg, round(max(value) OVER x - min(value) OVER x, 6) AS value_range"
_PLACED = f"(SELECT *, (row_number() OVER ({_W}))::DOUBLE AS p FROM events)"
_G, _X = "g AS (PARTITION BY user_id, event_type)", "x AS (PARTITION BY user_id, ts)"
_EV = "event_id, ts, user_id, event_type, round(value, 6) AS value"
_BIN = "CASE WHEN y >= 0 AND y <= 50 THEN '0-50' " + " ".join(f"WHEN y > {a} AND y <= {b} THEN '{a}-{b}'" for a, b in zip(labels.RUL_BINS[1:], labels.RUL_BINS[2:], strict=False)) + " END"
_LBIN = "CASE " + " ".join(f"WHEN y >= {a} AND y < {b} THEN '{a}-{b}'" for a, b in zip(labels.RANGE_BINS, labels.RANGE_BINS[1:], strict=False)) + " END"
_RUL = f"SELECT {_E}, user_id % 2 = 0 AS failed, user_id % 2 <> 0 AS censored, CASE WHEN user_id % 2 = 0 THEN {_epoch('ts', 'max(ts) OVER (PARTITION BY user_id)')} END AS rul_seconds FROM events"
_FOLD = """
pos AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS pl, ntile(5) OVER (PARTITION BY user_id ORDER BY ts) AS fold FROM (SELECT DISTINCT user_id, ts FROM events)),
blk AS (SELECT user_id, fold, min(pl) AS a, max(pl) AS b FROM pos GROUP BY ALL),
fol AS (SELECT event_id, ts, user_id, event_type, value, blk.fold, CASE WHEN pl BETWEEN a AND b THEN 'test' WHEN pl BETWEEN a - 3 AND b + 3 THEN 'purged' ELSE 'train' END AS role FROM events JOIN pos USING (user_id, ts) JOIN blk USING (user_id))"""

Q, S = {}, {}


def _add(name: str, sql: str | None, exact: bool = False):
    def keep(f):
        Q[name] = f if exact else lambda spark, d: rounded(f(spark, d))
        if sql:
            S[name] = sql
        return f

    return keep


@_add("rolling_stats", f"SELECT {_EV}, {_ROLL} FROM events")
def _(s, d):
    return events(s, d).select("*", *(c.alias(n) for n, c in temporal.rolling("value", KEYS, ORDER).items()))


@_add("delta_features", f"SELECT {_EV}, {_DELTA} FROM events")
def _(s, d):
    return events(s, d).select("*", *(c.alias(n) for n, c in temporal.deltas("value", KEYS, ORDER).items()))


@_add("ema_features", "SELECT event_id, ts, user_id, event_type, value, " + ", ".join(f"list_reduce(list(value) OVER ({_W}), lambda a, x: {1 - a} * a + {a} * x) AS value_ema_{round(a * 100)}" for a in (0.1, 0.3, 0.5)) + " FROM events", exact=True)
def _(s, d):
    return temporal.ema(events(s, d), "value", KEYS, ORDER)


@_add("rolling_slope", f"SELECT {_EV}, {_SLOPE} FROM {_PLACED}")
def _(s, d):
    return temporal.rolling_slopes(events(s, d), "value", KEYS, ORDER)


@_add("group_zscore", f"SELECT {_EV}, {_Z} FROM events WINDOW {_G}")
def _(s, d):
    return temporal.zscored(events(s, d), "value", KEYS)


@_add("cross_view_aggregates", f"SELECT {_EV}, {_CROSS} FROM events WINDOW {_X}")
def _(s, d):
    return events(s, d).select("*", *(c.alias(n) for n, c in temporal.cross_views("value", ["user_id", "ts"]).items()))


@_add("temporal_features", f"SELECT {_EV}, {_ROLL}, {_DELTA}, {_SLOPE}, {_Z}, {_CROSS} FROM {_PLACED} WINDOW {_G}, {_X}")
def _(s, d):
    return temporal.temporal_features(events(s, d), ["value"], "user_id", "event_type", ORDER)


_EMA = ", ".join(f"list_reduce(list(value) OVER ({_W}), lambda a, x: {1 - a} * a + {a} * x) AS value_ema_{round(a * 100)}" for a in (0.1, 0.3, 0.5))


@_add("all_temporal_features", f"SELECT {_EV}, {_ROLL}, {_DELTA}, {_SLOPE}, {_Z}, {_CROSS}, {_EMA} FROM {_PLACED} WINDOW {_G}, {_X}", exact=True)
def _(s, d):
    # averages are compared as they are, see ema_features
    out = temporal.all_features(events(s, d), ["value"], "user_id", "event_type", ORDER)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" and "_ema_" not in c else F.col(c) for c, t in out.dtypes))


@_add("rul_labels", f"SELECT event_id, ts, user_id, event_type, round(value, 6) AS value, failed, censored, round(rul_seconds, 6) AS rul_seconds, round(rul_seconds / 3600, 6) AS rul_hours FROM ({_RUL})")
def _(s, d):
    return rul(s, d)


@_add("label_summary", f"SELECT user_id, count(*) AS n, count_if(failed) AS failed, count_if(censored) AS censored, round(min(rul_seconds), 6) AS least, round(max(rul_seconds), 6) AS most, round(avg(rul_seconds), 6) AS mean FROM ({_RUL}) GROUP BY user_id")
def _(s, d):
    return rul(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failed"), F.count_if("censored").alias("censored"), F.min("rul_seconds").alias("least"), F.max("rul_seconds").alias("most"), F.avg("rul_seconds").alias("mean"))


@_add("label_quality", f"SELECT user_id, event_type, count(*) AS n, count_if(rul_seconds IS NULL) AS missing, count(*) - count(DISTINCT ts) AS duplicate_ts, count_if(coalesce(rise, false)) AS increases, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, rul_seconds - lag(rul_seconds) OVER ({_W}) > 1e-9 AS rise FROM ({_RUL})) GROUP BY ALL")
def _(s, d):
    return labels.label_quality(rul(s, d), KEYS, ORDER, "rul_seconds")


@_add("split_by_date", f"SELECT {_EV}, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'train' ELSE 'test' END AS split FROM events")
def _(s, d):
    return labels.split_at(events(s, d), "ts", "2024-01-15")


@_add("split_global_pct", f"SELECT {_EV}, CASE WHEN ts < (SELECT ts FROM events ORDER BY ts OFFSET (SELECT floor(0.8 * count(*))::BIGINT FROM events) LIMIT 1) THEN 'train' ELSE 'test' END AS split FROM events")
def _(s, d):
    return labels.split_global(events(s, d), ORDER, 0.8)


@_add("split_group_pct", f"SELECT {_EV}, CASE WHEN row_number() OVER ({_W}) <= floor(0.8 * count(*) OVER (PARTITION BY user_id, event_type)) THEN 'train' ELSE 'test' END AS split FROM events")
def _(s, d):
    return labels.split_by_stream(events(s, d), KEYS, ORDER, 0.8)


@_add("split_stratified_hash", f"SELECT event_id, CASE WHEN b IS NULL OR row_number() OVER (PARTITION BY b ORDER BY sha256('42-' || event_id), event_id) <= floor(0.8 * count(*) OVER (PARTITION BY b)) THEN 'train' ELSE 'test' END AS split FROM (SELECT event_id, {_BIN} AS b FROM ({_P}))")
def _(s, d):
    return labels.split_stratified(predictions(s, d), labels.right_closed_bin(F.col("y")), "event_id", 0.8).select("event_id", "split")


@_add("split_report", "WITH s AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1) SELECT *, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS pct, max(CASE WHEN split = 'train' THEN last_ts END) OVER () < min(CASE WHEN split = 'test' THEN first_ts END) OVER () AS no_leak FROM s")
def _(s, d):
    return labels.split_report(labels.split_at(events(s, d), "ts", "2024-01-15"))


@_add("lobo_folds", "SELECT user_id AS fold, count(*) AS n_test, ((SELECT count(*) FROM events) - count(*))::BIGINT AS n_train, (SELECT count(DISTINCT user_id) FROM events) - 1 AS train_assets FROM events GROUP BY 1")
def _(s, d):
    return labels.leave_one_out_folds(events(s, d), "user_id")


def _folds(s, d):
    return labels.purged_folds(events(s, d), "user_id", "ts", 5, 3)


@_add("lobo_rows", "SELECT e.event_id, e.user_id, f.user_id AS fold, CASE WHEN e.user_id = f.user_id THEN 'test' ELSE 'train' END AS role FROM events e, (SELECT DISTINCT user_id FROM events) f")
def _(s, d):
    return labels.leave_one_out_rows(events(s, d), "user_id").select("event_id", "user_id", "fold", "role")


def _labelled(s, d):
    """Features and labels with repeated and missing keys."""
    e = events(s, d)
    known = e.where("event_id % 13 <> 0").select("event_id", (F.col("value") > 20).alias("failed"))
    return labels.validated_labels(e.select("event_id", "value").unionByName(e.where("event_id % 101 = 0").select("event_id", "value")), known.unionByName(known.where("event_id % 97 = 0")), ["event_id"], ["failed"], "failed")


_LABELLED = "f AS (SELECT event_id, value FROM events UNION ALL SELECT event_id, value FROM events WHERE event_id % 101 = 0), k AS (SELECT event_id, value > 20 AS failed FROM events WHERE event_id % 13 <> 0), l AS (SELECT * FROM k UNION ALL SELECT * FROM k WHERE event_id % 97 = 0)"


@_add("validated_labels", f"WITH {_LABELLED} SELECT event_id, round(value, 6) AS value, failed FROM f LEFT JOIN l USING (event_id)")
def _(s, d):
    return _labelled(s, d)[0]


@_add("label_violations", f"WITH {_LABELLED} SELECT event_id, 'repeated features' AS problem, count(*) AS n FROM f GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT event_id, 'repeated labels', count(*) FROM l GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT event_id, 'missing label', count(*) FROM f LEFT JOIN l USING (event_id) WHERE failed IS NULL GROUP BY 1")
def _(s, d):
    return _labelled(s, d)[1]


@_add("purged_folds", f"WITH {_FOLD} SELECT {_EV}, fold, role FROM fol")
def _(s, d):
    return _folds(s, d)


@_add("fold_overlap", f"WITH {_FOLD} SELECT fold, count_if(r > 1) AS overlap FROM (SELECT fold, user_id, ts, count(DISTINCT role) AS r FROM fol WHERE role <> 'purged' GROUP BY ALL) GROUP BY fold")
def _(s, d):
    return labels.fold_overlap(_folds(s, d), ["user_id", "ts"])


@_add("nearest_train_gap", f"WITH {_FOLD}, p AS (SELECT *, row_number() OVER (PARTITION BY fold, user_id ORDER BY ts) AS pl FROM (SELECT DISTINCT fold, user_id, ts, role FROM fol)) SELECT a.fold, a.user_id, min(abs(a.pl - b.pl)) AS min_gap FROM p a LEFT JOIN p b ON a.fold = b.fold AND a.user_id = b.user_id AND b.role = 'train' WHERE a.role = 'test' GROUP BY ALL")
def _(s, d):
    return labels.nearest_train_gap(_folds(s, d), "user_id", "ts")


#: Train values of every third user are all alike, so that their groups have no spread.
_FLAT = "fol2 AS (SELECT * REPLACE (CASE WHEN user_id % 3 = 0 AND role = 'train' THEN 10.0 ELSE value END AS value) FROM fol WHERE role <> 'purged')"


@_add("fold_zscore", f"WITH {_FOLD}, {_FLAT}, tr AS (SELECT * FROM fol2 WHERE role = 'train'), g AS (SELECT fold, user_id, event_type, avg(value) AS m, stddev_samp(value) AS sd FROM tr GROUP BY ALL), w AS (SELECT fold, avg(value) AS gm, stddev_samp(value) AS gs FROM tr GROUP BY ALL) SELECT event_id, ts, user_id, event_type, round(value, 6) AS value, fold, role, round((value - coalesce(m, gm)) / (coalesce(nullif(sd, 0), nullif(gs, 0), 1e-8) + 1e-8), 6) AS value_z FROM fol2 LEFT JOIN g USING (fold, user_id, event_type) LEFT JOIN w USING (fold)")
def _(s, d):
    folds = _folds(s, d).withColumn("value", F.when((F.col("user_id") % 3 == 0) & (F.col("role") == "train"), 10.0).otherwise(F.col("value")))
    return labels.fitted_zscore(folds, "value", KEYS)


_REG = "count(*) AS n, round(avg(abs(yhat - y)), 6) AS mae, round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse, round(CASE WHEN count(*) >= 2 AND var_pop(y) > 0 THEN 1 - avg((yhat - y) * (yhat - y)) / var_pop(y) END, 6) AS r2, round(median(abs(yhat - y)), 6) AS median_ae, round(avg(yhat - y), 6) AS bias, count_if(y <= 50) AS critical_n, round(avg(CASE WHEN y <= 50 THEN abs(yhat - y) END), 6) AS critical_mae"


@_add("regression_metrics", f"SELECT event_type, {_REG} FROM ({_P}) GROUP BY event_type")
def _(s, d):
    return metrics.regression_metrics(predictions(s, d), ["event_type"])


@_add("threshold_metrics", f"SELECT event_type, threshold, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(fn + tp, 0), 6) AS miss_rate FROM (SELECT event_type, t AS threshold, count_if(y <= t AND yhat <= t) AS tp, count_if(y > t AND yhat <= t) AS fp, count_if(y <= t AND yhat > t) AS fn, count_if(y > t AND yhat > t) AS tn FROM ({_P}), (VALUES (50.0::DOUBLE), (100.0)) v(t) GROUP BY ALL)")
def _(s, d):
    return metrics.threshold_metrics(predictions(s, d), by=["event_type"])


@_add("rul_bins", "SELECT b AS bin, count(y) AS n FROM (VALUES " + ", ".join(f"('{a}-{b}')" for a, b in zip(labels.RUL_BINS, labels.RUL_BINS[1:], strict=False)) + f") v(b) LEFT JOIN (SELECT y, {_BIN} AS bin FROM ({_P})) q ON b = bin GROUP BY b")
def _(s, d):
    return metrics.bin_counts(predictions(s, d))


@_add("rul_range_errors", f"SELECT bin, count(*) AS n, round(avg(abs(yhat - y)), 6) AS mae, round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse, round(100 * avg(abs(yhat - y) / (y + 1e-10)), 6) AS mape, round(avg(100 * abs(yhat - y) / nullif(y, 0)), 6) AS mape_defined FROM (SELECT *, {_LBIN} AS bin FROM (SELECT y + 0.5 AS y, yhat FROM ({_P}))) WHERE bin IS NOT NULL GROUP BY bin")
def _(s, d):
    # half an hour to the end at least, for the plain mape has no meaning at 0
    return metrics.range_errors(predictions(s, d).withColumn("y", F.col("y") + 0.5))


@_add("residual_bins", "SELECT b AS bin, count(y) AS n, round(avg(abs(yhat - y)), 6) AS mae, round(median(abs(yhat - y)), 6) AS median_ae, round(avg(yhat - y), 6) AS bias, round(min(yhat - y), 6) AS least, round(max(yhat - y), 6) AS most FROM (VALUES " + ", ".join(f"('{a}-{b}')" for a, b in zip(labels.RUL_BINS, labels.RUL_BINS[1:], strict=False)) + f") v(b) LEFT JOIN (SELECT *, {_BIN} AS bin FROM ({_P})) q ON b = bin GROUP BY b")
def _(s, d):
    return metrics.residual_bins(predictions(s, d))


@_add("calibration_deciles", f"WITH p AS ({_P}), e AS (SELECT list_distinct(quantile_cont(yhat, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM p) SELECT greatest(1, len(list_filter(edges, lambda q: q < yhat)))::INT AS bin, count(*) AS n, round(avg(yhat), 6) AS mean_pred, round(avg(y), 6) AS mean_true, round(avg(abs(yhat - y)), 6) AS mae, round(avg(yhat - y), 6) AS bias FROM p, e GROUP BY 1")
def _(s, d):
    return metrics.calibration(predictions(s, d))


@_add("strategy_summary", f"WITH f AS (SELECT event_type AS strategy, user_id, count(*) AS n, avg(abs(yhat - y)) AS mae, sqrt(avg((yhat - y) * (yhat - y))) AS rmse, CASE WHEN count(*) >= 2 AND var_pop(y) > 0 THEN 1 - avg((yhat - y) * (yhat - y)) / var_pop(y) END AS r2, count_if(y <= 50) AS cn, avg(CASE WHEN y <= 50 THEN abs(yhat - y) END) AS cm FROM ({_P}) GROUP BY ALL) SELECT strategy, count(*) AS folds, round(avg(mae), 6) AS mean_mae, round(avg(rmse), 6) AS mean_rmse, round(avg(r2), 6) AS mean_r2, round(sum(mae * n) / sum(n), 6) AS weighted_mae, round(sum(rmse * n) / sum(n), 6) AS weighted_rmse, round(sum(cm * cn) / sum(CASE WHEN cm IS NOT NULL THEN cn END), 6) AS weighted_critical_mae FROM f GROUP BY strategy")
def _(s, d):
    return metrics.strategy_summary(metrics.regression_metrics(predictions(s, d).withColumn("strategy", F.col("event_type")), ["strategy", "user_id"]))


@_add("weighted_mae", f"SELECT round(avg(abs(yhat - y) * (1 + 1 / (y + 10))), 6) AS weighted_mae FROM ({_P})")
def _(s, d):
    return metrics.weighted_mae(predictions(s, d))


@_add("risk_levels", f"SELECT event_id, CASE WHEN y < 50 THEN 'critical' WHEN y < 150 THEN 'warning' ELSE 'normal' END AS serving, CASE WHEN y <= 50 THEN 'critical' WHEN y <= 100 THEN 'warning' ELSE 'normal' END AS offline FROM ({_P})")
def _(s, d):
    return predictions(s, d).select("event_id", metrics.risk_level(F.col("y")).alias("serving"), metrics.risk_level(F.col("y"), "offline").alias("offline"))


@_add("risk_score", f"SELECT event_type, round(5 * sum((y <= 50 AND yhat > 50)::INT) / nullif(sum((y <= 50)::INT), 0) + 2 * sum((y > 100 AND yhat <= 100)::INT) / nullif(sum((y > 100)::INT), 0) + least(avg(CASE WHEN y <= 50 THEN abs(yhat - y) END) / 50, 5) + 0.5 * least(avg(abs(yhat - y)) / 250, 5), 6) AS score FROM ({_P}) GROUP BY event_type")
def _(s, d):
    p = predictions(s, d)
    t = metrics.threshold_metrics(p, by=["event_type"]).groupBy("event_type").agg(F.max(F.when(F.col("threshold") == 50, F.col("miss_rate"))).alias("m"), F.max(F.when(F.col("threshold") == 100, F.col("fpr"))).alias("f"))
    r = metrics.regression_metrics(p, ["event_type"]).join(t, "event_type")
    return r.select("event_type", metrics.risk_score(F.col("m"), F.col("f"), F.col("critical_mae"), F.col("mae")).alias("score"))


@_add("metric_comparison", f"WITH p AS ({_P}), a AS (SELECT event_type AS k, avg(abs(yhat - y)) AS v FROM p WHERE event_type <> 'view' GROUP BY 1), b AS (SELECT event_type AS k, sqrt(avg((yhat - y) * (yhat - y))) AS v FROM p WHERE event_type <> 'click' GROUP BY 1) SELECT coalesce(a.k, b.k) AS event_type, round(a.v, 6) AS before, round(b.v, 6) AS now, round(b.v - a.v, 6) AS delta FROM a FULL JOIN b ON a.k = b.k")
def _(s, d):
    m = metrics.regression_metrics(predictions(s, d), ["event_type"])
    return metrics.compared(m.where("event_type <> 'view'").select("event_type", F.col("mae").alias("v")), m.where("event_type <> 'click'").select("event_type", F.col("rmse").alias("v")), "event_type", "v")


@_add("null_profile", "SELECT c AS column_name, n AS nulls, round(100.0::DOUBLE * n / t, 6) AS pct, 100.0 * n / t > 5 AS flagged FROM (SELECT count(*) AS t, count_if(v IS NULL) AS a, count_if(event_type IS NULL) AS b FROM (SELECT *, nullif(value % 7 < 1, true) AS v FROM events)), LATERAL (VALUES ('v', a), ('event_type', b)) x(c, n)")
def _(s, d):
    return quality.null_profile(events(s, d).withColumn("v", F.nullif(F.col("value") % 7 < 1, F.lit(True))), ["v", "event_type"])


@_add("outlier_profile", "WITH v AS (UNPIVOT (SELECT value, value * value AS square FROM events) ON value, square INTO NAME feature VALUE x), z AS (SELECT feature, x, avg(x) OVER (PARTITION BY feature) AS m, stddev_pop(x) OVER (PARTITION BY feature) AS sd FROM v) SELECT feature, count(*) AS n, count_if(abs((x - m) / sd) > 3) AS outliers, 100.0 * count_if(abs((x - m) / sd) > 3) / count(*) > 1 AS flagged FROM z GROUP BY feature")
def _(s, d):
    return quality.outlier_profile(events(s, d).withColumn("square", F.col("value") * F.col("value")), ["value", "square"])


@_add("drift_early_late", f"WITH p AS (SELECT *, row_number() OVER ({_W}) - 1 AS pl, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events), a AS (SELECT user_id, event_type, avg(CASE WHEN pl < floor(0.2 * n) THEN value END) AS early, avg(CASE WHEN pl >= floor(0.8 * n) THEN value END) AS late FROM p GROUP BY ALL) SELECT user_id, event_type, round(early, 6) AS early, round(late, 6) AS late, round(100.0 * (late - early) / (early + 1e-10), 6) AS change_pct, abs(100.0 * (late - early) / (early + 1e-10)) > 20 AS flagged FROM a")
def _(s, d):
    return quality.early_late_drift(events(s, d), "value", KEYS, ORDER)


@_add("range_violations", "SELECT feature, low, high, count_if(x < low OR x > high) AS violations FROM (UNPIVOT (SELECT value, value * value AS square FROM events) ON value, square INTO NAME feature VALUE x) JOIN (VALUES ('value', 1.0::DOUBLE, 50.0::DOUBLE), ('square', 4.0, 400.0)) b(feature, low, high) USING (feature) GROUP BY ALL")
def _(s, d):
    return quality.range_violations(events(s, d).withColumn("square", F.col("value") * F.col("value")), {"value": (1, 50), "square": (4, 400)})


@_add("duplicate_keys", "SELECT event_type, count(*) - count(DISTINCT date_trunc('hour', ts)) AS duplicates FROM events GROUP BY 1 HAVING count(*) > count(DISTINCT date_trunc('hour', ts))")
def _(s, d):
    return quality.duplicate_rows(events(s, d).withColumn("h", F.date_trunc("hour", "ts")), ["event_type"], "h")


@_add("cadence_diagnostics", f"SELECT user_id, round(min(x), 6) AS least, round(max(x), 6) AS most, count(DISTINCT x) AS distinct_steps, coalesce(bool_and(x > 0), true) AS strict FROM (SELECT user_id, {_epoch('lag(ts) OVER (PARTITION BY user_id ORDER BY ts)', 'ts')} AS x FROM events) GROUP BY user_id")
def _(s, d):
    return quality.cadence(events(s, d), ["user_id"], "ts")


@_add("artifact_checks", "WITH k AS (SELECT user_id, event_type, count(*) AS n, count_if(event_id % 7 = 0) AS missing, count_if(event_id % 11 = 0 AND event_id % 7 <> 0) AS infinite FROM events GROUP BY ALL) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, coalesce(sum(CASE WHEN n > 1 THEN n END), 0)::BIGINT AS dup_rows, sum(missing)::BIGINT AS missing, sum(infinite)::BIGINT AS infinite FROM k")
def _(s, d):
    holes = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, F.when(F.col("event_id") % 2 == 0, float("inf")).otherwise(float("-inf"))).otherwise(F.col("value"))
    return quality.artifact_checks(events(s, d).withColumn("value", holes), KEYS, "value")


@_add("group_summary", f"SELECT user_id, event_type, count(*) AS n, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)::BIGINT AS days, round(arg_min(value, ts), 6) AS first, round(arg_max(value, ts), 6) AS last, round(100.0 * (arg_max(value, ts) - arg_min(value, ts)) / nullif(arg_min(value, ts), 0), 6) AS change_pct, round(max(value), 6) AS most, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def _(s, d):
    return quality.group_summary(events(s, d), KEYS, "ts", "value")


@_add("latest_status", f"SELECT {_EV} FROM events JOIN (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL) USING (user_id, event_type, ts)")
def _(s, d):
    e = events(s, d)
    return e.join(e.groupBy(*KEYS).agg(F.max("ts").alias("ts")), [*KEYS, "ts"]).select(*e.columns)


@_add("last_n", f"SELECT {_EV} FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def _(s, d):
    return events(s, d).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(200)


@_add("endpoint_proxy", f"SELECT event_id, user_id, round({_epoch('ts', 'max(ts) OVER (PARTITION BY user_id)')}, 6) AS seconds_left FROM events")
def _(s, d):
    from pyspark.sql import Window

    return events(s, d).select("event_id", "user_id", labels.seconds(F.max("ts").over(Window.partitionBy("user_id")), F.col("ts")).alias("seconds_left"))


@_add("episodes", f"WITH s AS (SELECT *, value > 30 AS high FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, high ORDER BY ts, event_id) AS run FROM s) SELECT user_id, high, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY user_id, high, run")
def _(s, d):
    return metrics.islands(events(s, d).withColumn("high", F.col("value") > 30), ["user_id"], ORDER, "high")
