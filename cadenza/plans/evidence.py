"""Queries of the registry features and evidence tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import registry, signal
from cadenza.operators import evidence, identity, labels, metrics, quality, temporal
from cadenza.plans import assets, streams
from cadenza.plans.streams import KEYS, ORDER, events, predictions, rounded, table

Q, S = {}, {}


def _add(name: str, sql: str):
    def keep(f):
        Q[name] = lambda spark, d: rounded(f(spark, d))
        S[name] = sql
        return f

    return keep


# ---- 16 samples of the vector at 64 Hz are a window; bands begin at 0, 8 and 20 Hz ----

_N = registry.NAMES
_REGISTRY = f"""
WITH f AS ({assets._FRAMED}),
c AS (SELECT vec_id, "window", j, (samples[j + 1] - list_avg(samples)) * (0.5 - 0.5 * cos(2 * pi() * j / 16)) AS v FROM f, (SELECT unnest(range(16)) AS j)),
d AS (SELECT vec_id, "window", k, sum(v * cos(2 * pi() * k * j / 16)) AS re, sum(v * sin(2 * pi() * k * j / 16)) AS im FROM c, (SELECT unnest(range(9)) AS k) GROUP BY ALL),
q AS (SELECT vec_id, "window", k * 4.0::DOUBLE AS hz, (re * re + im * im) / (6.0 * 16) * CASE WHEN k BETWEEN 1 AND 7 THEN 2 ELSE 1 END AS q FROM d),
sp AS (SELECT vec_id, "window", sum(q) AS t, sum(CASE WHEN hz < 8 THEN q END) AS b1, sum(CASE WHEN hz >= 8 AND hz < 20 THEN q END) AS b2, sum(CASE WHEN hz >= 20 THEN q END) AS b3, sum(hz * q) AS hq, sum(CASE WHEN q > 0 THEN q * ln(q) END) AS ql FROM q GROUP BY ALL),
m AS (SELECT *, sqrt(list_avg(list_transform(samples, lambda x: x * x))) AS rms, list_max(list_transform(samples, lambda x: abs(x))) AS peak FROM {assets._V}),
r AS (SELECT m.vec_id, m.label, m."window", m.m AS {_N[0]}, rms AS {_N[1]}, sqrt(v2) AS {_N[2]}, peak AS {_N[3]}, list_max(samples) - list_min(samples) AS {_N[4]}, t AS {_N[5]}, b1 AS {_N[6]}, b2 AS {_N[7]}, b3 AS {_N[8]},
 v3 / v2 ** 1.5 AS {_N[9]}, v4 / (v2 * v2) - 3 AS {_N[10]}, peak / rms AS {_N[11]}, b1 / t AS {_N[12]}, b2 / t AS {_N[13]}, b3 / t AS {_N[14]}, hq / t / 32 AS {_N[15]}, (ln(t) - ql / t) / ln(9) AS {_N[16]} FROM m JOIN sp ON m.vec_id = sp.vec_id AND m."window" = sp."window")"""


def _registry(s, d):
    return registry.registry_features(signal.framed(assets._signals(s, d), "x", 16), "samples", 64.0, (8.0, 20.0)).drop("samples")


@_add("spectral_registry", f'{_REGISTRY} SELECT vec_id, label, "window", {", ".join(f"round({n}, 6) AS {n}" for n in _N)} FROM r')
def _(s, d):
    return _registry(s, d)


@_add("registry_aggregate", f"{_REGISTRY} SELECT vec_id, count(*) AS n_windows, {', '.join(f'round(avg({n}), 6) AS {n}_mean, round(stddev_pop({n}), 6) AS {n}_std, count({n}) AS {n}_valid' for n in _N)} FROM r GROUP BY vec_id")
def _(s, d):
    return signal.aggregated_windows(_registry(s, d), ["vec_id"], list(_N))


# ---- ids, statistics, diagnostics, audits ----


@_add("tagged_ids", """SELECT p_partkey, 'sha256:' || sha256('{"id_schema_version":"canonical_sha256_id_v1","payload":{"brand":"' || p_brand || '","key":' || p_partkey || ',"none":null,"size":' || p_size || '},"tag":"part"}' || chr(10)) AS id FROM part""")
def _(s, d):
    return table(s, d, "part").select("p_partkey", identity.tagged_id("part", F.col("p_size").alias("size"), F.col("p_partkey").alias("key"), F.lit(None).cast("string").alias("none"), F.col("p_brand").alias("brand")).alias("id"))


@_add("basic_stats", "SELECT count(*) AS n_rows, 7 AS n_columns, min(ts) AS first_ts, max(ts) AS last_ts, floor(epoch(max(ts) - min(ts)) / 86400)::BIGINT AS days, count_if(value > 50) AS known, round(100.0 * count_if(value > 50) / count(*), 6) AS known_pct, count_if(value <= 50) AS censored, round(100.0 * count_if(value <= 50) / count(*), 6) AS censored_pct, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM events")
def _(s, d):
    rows = events(s, d).select("event_id", "ts", "user_id", "event_type", "value")
    return quality.basic_stats(rows.withColumns({"known": F.col("value") > 50, "one": F.lit(1)}), "ts", "value", "known")


@_add("diagnostics", "WITH o AS (SELECT ts, event_id, event_type, user_id, epoch(ts - lag(ts) OVER (ORDER BY ts, event_id)) AS step FROM events), g AS (SELECT count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 1) SELECT round(min(step), 6) AS least_step, round(max(step), 6) AS most_step, count(DISTINCT step) AS distinct_steps, min(user_id) AS least_size, max(user_id) AS most_size, count(DISTINCT user_id) AS distinct_sizes, (SELECT count(*) FROM g) AS repeated_groups, (SELECT coalesce(sum(n), 0)::BIGINT FROM g) AS repeated_rows FROM o")
def _(s, d):
    return quality.diagnostics(events(s, d).withColumn("content", F.concat_ws("/", "user_id", "event_type")), ["ts", "event_id"], "user_id", "content")


@_add("channel_diagnostics", "SELECT label, round(min(list_min(e)), 6) AS least, round(max(list_max(e)), 6) AS most, count_if(list_min(e) = list_max(e)) AS constant FROM (SELECT label, CASE WHEN vec_id % 5 = 0 THEN [embedding[1]::DOUBLE] ELSE embedding::DOUBLE[] END AS e FROM embeddings) GROUP BY label")
def _(s, d):
    return quality.channel_diagnostics(assets._signals(s, d).withColumn("x", F.when(F.col("vec_id") % 5 == 0, F.slice("x", 1, 1)).otherwise(F.col("x"))), "label", "x")


_NAMED = "SELECT p_partkey, 'f' || p_size || CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '_mean_5' WHEN 2 THEN '_ema_30' WHEN 3 THEN '_range' WHEN 4 THEN '_z' WHEN 5 THEN '_diff' ELSE '_max' END AS name, ['raw', 'mean', 'ema', 'range', 'z', 'diff', 'max'][p_partkey % 7 + 1] AS transform FROM part"


@_add("audit_histogram", f"SELECT transform, CASE transform WHEN 'raw' THEN 'none from fold preprocessing' WHEN 'range' THEN 'precomputed same-timestamp cross-axis aggregate can cross split membership' WHEN 'max' THEN 'precomputed same-timestamp cross-axis aggregate can cross split membership' WHEN 'z' THEN 'full bearing-axis mean/std uses validation/test distribution' ELSE 'precomputed train rows can carry held-out raw history across folds' END AS leakage_risk, count(*) AS n, count(DISTINCT regexp_extract(name, '^f[0-9]+')) AS bases FROM ({_NAMED}) GROUP BY ALL")
def _(s, d):
    ending = F.element_at(F.array(*map(F.lit, ("", "_mean_5", "_ema_30", "_range", "_z", "_diff", "_max"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    names = table(s, d, "part").select(F.concat(F.lit("f"), "p_size", ending).alias("name"))
    return evidence.audit_histogram(evidence.feature_audit(names, "name"))


# ---- folds and fills ----

_FW = "OVER (PARTITION BY fold, role, user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@_add("fold_local_features", f"WITH {streams._FOLD} SELECT event_id, fold, role, round(avg(value) {_FW}, 6) AS value_mean_3, round(stddev_samp(value) {_FW}, 6) AS value_std_3 FROM fol WHERE role <> 'purged'")
def _(s, d):
    folds = labels.purged_folds(events(s, d), "user_id", "ts", 5, 3).where("role <> 'purged'")
    return folds.select("event_id", "fold", "role", *(c.alias(n) for n, c in temporal.rolling("value", ["fold", "role", *KEYS], ORDER, (3,)).items()))


@_add("median_fill", "WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events) SELECT event_id, round(coalesce(v, (SELECT median(v) FROM e WHERE ts < TIMESTAMP '2024-01-15')), 6) AS value FROM e")
def _(s, d):
    holes = events(s, d).withColumn("value", F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, float("inf"))).otherwise(F.col("value")))
    return evidence.median_filled(holes, F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), ["value"]).select("event_id", "value")


@_add("labelled_failures", f"SELECT event_id, user_id, ts, round(rul_seconds / 3600, 6) AS rul_hours FROM ({streams._RUL}) WHERE failed AND rul_seconds IS NOT NULL")
def _(s, d):
    return streams.rul(s, d).where("failed AND rul_hours IS NOT NULL").select("event_id", "user_id", "ts", "rul_hours")


# ---- profiles ----


@_add("equal_width_bins", f"WITH p AS ({streams._P}), e AS (SELECT min(y) AS lo, (max(y) - min(y)) / 20 AS w FROM p), b AS (SELECT greatest(1, least(20, ceil((y - lo) / w)))::INT AS bin, lo, w, yhat FROM p, e) SELECT bin, count(*) AS n, round(any_value(lo) + (bin - 0.5::DOUBLE) * any_value(w), 6) AS middle, round(avg(yhat), 6) AS mean FROM b GROUP BY bin")
def _(s, d):
    return evidence.equal_width_bins(predictions(s, d), "y", "yhat")


@_add("data_profile", "SELECT user_id, event_type, count(*) AS n, count(DISTINCT ts) AS times, min(ts) AS first_ts, max(ts) AS last_ts, count_if(value IS NULL) AS missing FROM events GROUP BY ALL")
def _(s, d):
    return evidence.profile(events(s, d), KEYS, "ts", "value")


_W5 = f"OVER ({streams._W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@_add("temporal_consistency", f"WITH t AS (SELECT abs(value - avg(value) {_W5}) AS away, CASE WHEN count(*) {_W5} >= 2 THEN regr_slope(value, p) {_W5} END AS slope FROM {streams._PLACED}) SELECT round(avg(away), 6) AS mean_away, round(max(away), 6) AS most_away, round(100.0::DOUBLE * count_if(abs(slope) > 0.01) / count(slope), 6) AS steep_pct, 100.0 * count_if(abs(slope) > 0.01) / count(slope) > 5 AS flagged FROM t")
def _(s, d):
    rows = temporal.temporal_features(events(s, d), ["value"], "user_id", "event_type", ORDER, (5,), (5,))
    return evidence.temporal_consistency(rows, "value", "value_mean_5", "value_slope_5")


@_add("fold_pivot", "SELECT event_type, " + ", ".join(f"round(coalesce(avg(CASE WHEN user_id % 3 = {k} THEN value END), 0), 6) AS fold_{k}" for k in range(3)) + " FROM events GROUP BY event_type")
def _(s, d):
    return evidence.fold_pivot(events(s, d).withColumn("fold", F.concat(F.lit("fold_"), F.col("user_id") % 3)), "event_type", "fold", ["fold_0", "fold_1", "fold_2"], "value")


# ---- alerts and clocks ----


@_add("alert_table", f"WITH a AS (SELECT user_id, ts, alert, lag(alert) OVER w AS was, row_number() OVER w > 10 AS late FROM {assets._ALERT} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count_if(was <> alert) AS transitions, min(CASE WHEN alert THEN ts END) AS first_alert, NOT bool_or(alert) AS missed, round(avg(alert::INT), 6) AS burden, round(avg(CASE WHEN late THEN alert::INT END), 6) AS late_burden, round({streams._epoch('min(CASE WHEN alert THEN ts END)', 'max(ts)')}, 6) AS lead_seconds FROM a GROUP BY user_id")
def _(s, d):
    return evidence.alert_table(assets._alerts(s, d), "user_id", ORDER, "alert", 10)


@_add("clock_errors", f"WITH r AS (SELECT user_id, ts, {streams._epoch('ts', 'max(ts) OVER (PARTITION BY user_id)')} AS y FROM events), g AS (SELECT user_id, abs(first_value(y) OVER (PARTITION BY user_id ORDER BY ts) - {streams._epoch('min(ts) OVER (PARTITION BY user_id)', 'ts')} - y) AS e FROM r) SELECT user_id, round(max(e), 6) AS worst, round(avg(e), 6) AS mean FROM g GROUP BY user_id")
def _(s, d):
    rows = labels.rul_labels(events(s, d), "user_id", "ts", F.lit(True))
    return evidence.clock_errors(rows, "user_id", "ts", "rul_seconds")


# ---- comparisons ----


@_add("metric_deltas", f"WITH p AS ({streams._P}), m AS (SELECT event_type, avg(CASE WHEN user_id % 2 = 0 THEN abs(yhat - y) END) AS a, avg(CASE WHEN user_id % 2 = 1 THEN abs(yhat - y) END) AS b FROM p GROUP BY 1) SELECT event_type, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta, round((b - a) / abs(a), 6) AS relative, sign(b - a)::INT AS sign, a IS NOT NULL AND b IS NOT NULL AS complete FROM m")
def _(s, d):
    p = predictions(s, d)
    return evidence.metric_deltas(metrics.regression_metrics(p.where("user_id % 2 = 0"), ["event_type"]), metrics.regression_metrics(p.where("user_id % 2 = 1"), ["event_type"]), "event_type", "mae")


@_add("magnitude_percentiles", f"SELECT round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99, round(max(x), 6) AS most FROM (SELECT abs(yhat - y) AS x FROM ({streams._P}))")
def _(s, d):
    return evidence.magnitude_percentiles(predictions(s, d).withColumn("e", F.col("yhat") - F.col("y")), "e")


_HALF = "(WITH r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rv, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS ry FROM ({0}) WHERE vec_id % 2 = {1}) SELECT feature, corr(rv, ry) AS c FROM r GROUP BY feature)"


@_add("predictiveness", f"SELECT feature, round(a.c, 6) AS train, round(b.c, 6) AS test, round(b.c - a.c, 6) AS delta, a.c * b.c < 0 AS flips FROM {_HALF.format(assets._LONG, 0)} a JOIN {_HALF.format(assets._LONG, 1)} b USING (feature)")
def _(s, d):
    values = assets._long(s, d)
    return evidence.predictiveness(values.where("vec_id % 2 = 0"), values.where("vec_id % 2 = 1"))


@_add("derived_names", f"WITH n AS (SELECT 'p' || p_size || x AS name FROM part, (VALUES (''), ('_mean_3'), ('_std_10'), ('_slope_5'), ('_ema_30'), ('_diff'), ('_z'), ('_range')) v(x)), k AS (SELECT name, regexp_extract(name, '{evidence.DERIVED}', 1) AS base, coalesce(nullif(regexp_extract(name, '{evidence.DERIVED}', 2), ''), nullif(regexp_extract(name, '{evidence.DERIVED}', 4), ''), 'raw') AS transform, try_cast(nullif(regexp_extract(name, '{evidence.DERIVED}', 3), '') AS INT) AS parameter FROM n) SELECT *, transform = 'z' AS needs_fit FROM k")
def _(s, d):
    ends = F.explode(F.array(*map(F.lit, ("", "_mean_3", "_std_10", "_slope_5", "_ema_30", "_diff", "_z", "_range"))))
    return evidence.parsed_names(table(s, d, "part").select("p_size", ends.alias("_x")).select(F.concat(F.lit("p"), "p_size", "_x").alias("name")), "name")


@_add("entity_star", "SELECT l_orderkey, l_linenumber, o_custkey, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    t = lambda name: table(s, d, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("l_orderkey", "l_linenumber", "o_custkey", "n_name", "r_name")
