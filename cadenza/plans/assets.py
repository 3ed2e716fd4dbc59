"""Queries over keyed tables, signals, monitors and models, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import signal
from cadenza.operators import boosting, identity, models, monitor, selection
from cadenza.plans.streams import events, rounded, table
from cadenza.sources import recordings

Q, S = {}, {}


def _add(name: str, sql: str | None = None, exact: bool = False):
    def keep(f):
        Q[name] = f if exact else lambda spark, d: rounded(f(spark, d))
        if sql:
            S[name] = sql
        return f

    return keep


# ---- identity and integrity ----


@_add("fk_violations", "SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey")
def _(s, d):
    return identity.orphans(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "customer").where("c_custkey % 10 <> 0"), "o_custkey", "c_custkey")


@_add("repeated_keys", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return identity.repeated_keys(table(s, d, "lineitem"), ["l_orderkey", "l_partkey"])


@_add("cardinality_gates", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) NOT BETWEEN 2 AND 6")
def _(s, d):
    return identity.cardinality_violations(table(s, d, "lineitem"), "l_orderkey", 2, 6)


@_add("dependency_gates", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def _(s, d):
    return identity.dependency_violations(table(s, d, "lineitem"), "l_partkey", "l_suppkey")


@_add("content_ids", """SELECT n_nationkey, 'sha256:' || sha256('{"name":"' || n_name || '","region":' || n_regionkey || ',"tag":"nation"}') AS content_id FROM nation""")
def _(s, d):
    return table(s, d, "nation").select("n_nationkey", identity.content_id("nation", F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("content_id"))


@_add("identity_expand", "SELECT o_orderkey, channel, 1 + channel // 2 AS asset FROM orders, (SELECT unnest(range(8))::INT AS channel)")
def _(s, d):
    return identity.expanded(table(s, d, "orders").select("o_orderkey"), list(range(8)), "channel").select("*", (1 + F.floor(F.col("channel") / 2)).cast("int").alias("asset"))


@_add("hash_ranked_sample", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 2) UNION ALL (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (1, 2) ORDER BY sha256('s' || o_orderkey), o_orderkey LIMIT 32)")
def _(s, d):
    return identity.hash_ranked_sample(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 32, (1, 2), "s")


@_add("members_digest", "WITH h AS (SELECT sha256(p_name || p_partkey) AS h FROM part), p AS (SELECT substr(h, 1, 3) AS k, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM h GROUP BY 1) SELECT sum(n)::BIGINT AS n, sha256(string_agg(d, chr(10) ORDER BY k)) AS digest FROM p")
def _(s, d):
    return identity.members_digest(table(s, d, "part").select(F.concat("p_name", "p_partkey").alias("name")), "name")


@_add("positional_alignment", "WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE event_type = 'click'), b AS (SELECT user_id, event_id AS other, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE event_type = 'view') SELECT user_id, place, event_id, other FROM a FULL JOIN b USING (user_id, place)")
def _(s, d):
    e = events(s, d)
    a, b = e.where("event_type = 'click'").select("user_id", "event_id", "ts"), e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("other"), F.col("ts").alias("ts2"))
    return identity.aligned(a, b, ["ts", "event_id"], ["ts2", "other"], ["user_id"]).drop("ts", "ts2")


@_add("update_from_staging", "SELECT event_id, user_id, round(CASE WHEN event_id % 3 = 0 AND value <= 40 THEN value * 2 ELSE value END, 6) AS value FROM events")
def _(s, d):
    e = events(s, d).select("event_id", "user_id", "value")
    new = e.where("event_id % 3 = 0").select("event_id", F.when(F.col("value") <= 40, F.col("value") * 2).alias("value"))
    return identity.updated(e, new, ["event_id"], ["value"])


@_add("schema_evolution", "SELECT event_id, round(value, 6) AS value, NULL::VARCHAR AS event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, event_type FROM events WHERE event_id % 2 = 1")
def _(s, d):
    e = events(s, d)
    return identity.evolved(e.where("event_id % 2 = 0").select("event_id", "value"), e.where("event_id % 2 = 1").select("event_id", "event_type"))


@_add("chunk_coverage", "SELECT event_id // 128 AS chunk, count(*) AS n, min(event_id) AS first, max(event_id) AS last, max(event_id) - min(event_id) + 1 = count(*) AND count(DISTINCT event_id) = count(*) AS complete FROM events WHERE event_id % 1000 <> 5 GROUP BY 1")
def _(s, d):
    return identity.chunk_coverage(events(s, d).where("event_id % 1000 <> 5"), "event_id")


@_add("table_difference", "SELECT event_type, user_id, CASE WHEN event_type = 'click' THEN count(*) ELSE -count(*) END AS surplus FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type, user_id")
def _(s, d):
    e = events(s, d).select("event_type", "user_id")
    return identity.tables_differ(e.where("event_type <> 'view'"), e.where("event_type <> 'click'"))


@_add("json_key_gate", "SELECT event_id, list_sort(list_filter(['k', 'no_such'], lambda k: NOT list_contains(json_keys(props), k))) AS missing, list_sort(list_filter(json_keys(props), lambda k: NOT list_contains(['k', 'no_such'], k))) AS unknown FROM events")
def _(s, d):
    missing, unknown = recordings.closed_keys(F.col("props"), ["k", "no_such"])
    return table(s, d, "events").select("event_id", F.sort_array(missing).alias("missing"), F.sort_array(unknown).alias("unknown"))


# ---- signals: embeddings stand for sampled channels ----


def _signals(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


_FRAMED = "SELECT vec_id, label, k AS \"window\", embedding[1 + 8 * k:16 + 8 * k]::DOUBLE[] AS samples FROM embeddings, (SELECT unnest(range(7))::INT AS k)"
_M = "(SELECT *, list_avg(samples) AS m FROM f)"
_TIME = "round(sqrt(list_avg(list_transform(samples, lambda x: x * x))), 6) AS rms, round(sqrt(v2), 6) AS std, round(v3 / v2 ** 1.5, 6) AS skew, round(v4 / (v2 * v2) - 3, 6) AS kurtosis, round(list_max(samples) - list_min(samples), 6) AS peak_to_peak, round(list_max(list_transform(samples, lambda x: abs(x))) / (sqrt(list_avg(list_transform(samples, lambda x: x * x))) + 1e-12), 6) AS crest_factor"
_V = f"(SELECT *, list_avg(list_transform(samples, lambda x: (x - m) ** 2)) AS v2, list_avg(list_transform(samples, lambda x: (x - m) ** 3)) AS v3, list_avg(list_transform(samples, lambda x: (x - m) ** 4)) AS v4 FROM {_M})"


@_add("frame_signal", f"SELECT vec_id, label, \"window\", samples FROM ({_FRAMED})", exact=True)
def _(s, d):
    return signal.framed(_signals(s, d), "x", 16)


def _timed(s, d):
    f = signal.framed(_signals(s, d), "x", 16)
    return f.select("vec_id", "label", "window", *(c.alias(n) for n, c in signal.time_features(F.col("samples")).items()))


@_add("time_domain_features", f"WITH f AS ({_FRAMED}) SELECT vec_id, label, \"window\", {_TIME} FROM {_V}")
def _(s, d):
    return _timed(s, d)


@_add("window_aggregate", f"WITH f AS ({_FRAMED}), t AS (SELECT vec_id, {_TIME.replace('round(', '(').replace(', 6)', ')')} FROM {_V}) SELECT vec_id, count(*) AS n_windows, round(avg(rms), 6) AS rms_mean, round(stddev_pop(rms), 6) AS rms_std, count(rms) AS rms_valid, round(avg(kurtosis), 6) AS kurtosis_mean, round(stddev_pop(kurtosis), 6) AS kurtosis_std, count(kurtosis) AS kurtosis_valid FROM t GROUP BY vec_id")
def _(s, d):
    return signal.aggregated_windows(_timed(s, d), ["vec_id"], ["rms", "kurtosis"])


_HANN = "(0.5 - 0.5 * cos(2 * pi() * j / 32))"
_BAND = lambda low, high: f"round(coalesce(sum(CASE WHEN f >= {low} AND nf < {high} THEN (p + np) / 2 * (nf - f) END), 0), 6)"


@_add("spectral_features", f"""
WITH seg AS (SELECT vec_id, q, embedding[1 + 16 * q:32 + 16 * q]::DOUBLE[] AS y FROM embeddings, (SELECT unnest(range(3)) AS q)),
w AS (SELECT vec_id, q, j, (y[j + 1] - list_avg(y)) * {_HANN} AS v FROM seg, (SELECT unnest(range(32)) AS j)),
psd AS (SELECT vec_id, k, avg((re * re + im * im) / (64.0 * 12.0) * CASE WHEN k BETWEEN 1 AND 15 THEN 2 ELSE 1 END) AS p FROM (SELECT vec_id, q, k, sum(v * cos(2 * pi() * k * j / 32)) AS re, sum(v * sin(2 * pi() * k * j / 32)) AS im FROM w, (SELECT unnest(range(17)) AS k) GROUP BY ALL) GROUP BY ALL),
l AS (SELECT vec_id, k * 2.0 AS f, p, lead(k * 2.0) OVER o AS nf, lead(p) OVER o AS np FROM psd WINDOW o AS (PARTITION BY vec_id ORDER BY k))
SELECT vec_id, round(sum(f * p) / (sum(p) + 1e-12), 6) AS spec_centroid, {_BAND(0, 8)} AS low, {_BAND(8, 24)} AS high FROM l GROUP BY vec_id""")
def _(s, d):
    return signal.spectral_features(_signals(s, d).select("vec_id", "x"), "x", 64.0, 32, {"low": (0, 8), "high": (8, 24)}).drop("x")


@_add("quantised_values", "SELECT event_id, printf('%.11e', value / 7)::DOUBLE AS q, printf('%.11e', value * -1e-9 / 3)::DOUBLE AS small FROM events", exact=True)
def _(s, d):
    return events(s, d).select("event_id", signal.quantised(F.col("value") / 7).alias("q"), signal.quantised(F.col("value") * -1e-9 / 3).alias("small"))


# ---- selection: components 0-4 of the vector are features, component 20 the target ----


def _long(s, d) -> DataFrame:
    e = _signals(s, d).select("vec_id", F.col("x")[20].alias("y"), F.posexplode(F.slice("x", 1, 5)).alias("k", "value"))
    return e.select("vec_id", F.concat(F.lit("f"), "k").alias("feature"), "value", "y")


_LONG = "SELECT vec_id, 'f' || k AS feature, embedding[k + 1]::DOUBLE AS value, embedding[21]::DOUBLE AS y FROM embeddings, (SELECT unnest(range(5)) AS k)"
_REL = f"(WITH r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rv, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS ry FROM ({_LONG})) SELECT feature, count(*) AS n, corr(value, y) AS pearson, corr(rv, ry) AS spearman, greatest(abs(corr(value, y)), abs(corr(rv, ry))) AS score FROM r GROUP BY feature)"


@_add("pearson_spearman", f"SELECT feature, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(score, 6) AS score FROM {_REL}")
def _(s, d):
    return selection.relevance(_long(s, d))


@_add("pairwise_correlation", f"WITH l AS ({_LONG}) SELECT a.feature AS feature_i, b.feature AS feature_j, round(corr(a.value, b.value), 6) AS corr FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY ALL")
def _(s, d):
    return selection.pairwise_correlation(_long(s, d), "vec_id")


_RED = f"(WITH l AS ({_LONG}), p AS (SELECT a.feature AS i, b.feature AS j, corr(a.value, b.value) AS c FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY ALL) SELECT DISTINCT CASE WHEN x.score < y.score THEN i ELSE j END AS feature FROM p JOIN {_REL} x ON i = x.feature JOIN {_REL} y ON j = y.feature WHERE abs(c) > 0.02)"


@_add("redundant_features", f"SELECT feature FROM {_RED}")
def _(s, d):
    return selection.redundant(_long(s, d), selection.relevance(_long(s, d)), "vec_id", 0.02)


@_add("select_top", f"SELECT row_number() OVER (ORDER BY score DESC, feature)::INT AS rank, feature, round(score, 6) AS score FROM {_REL} ANTI JOIN {_RED} USING (feature) ORDER BY score DESC, feature LIMIT 3")
def _(s, d):
    scores = selection.relevance(_long(s, d)).select("feature", "score")
    return selection.select_top(scores, selection.redundant(_long(s, d), scores, "vec_id", 0.02), 3)


#: A second score for each feature: the magnitude of its mean; f4 has none.
_SECOND = f"(SELECT feature, abs(avg(value)) AS score FROM ({_LONG}) WHERE feature <> 'f4' GROUP BY feature)"


def _second(s, d):
    return _long(s, d).where("feature <> 'f4'").groupBy("feature").agg(F.abs(F.avg("value")).alias("score"))


@_add("combined_scores", f"SELECT feature, round((coalesce(a.score, 0) + coalesce(b.score, 0)) / 2, 6) AS score FROM {_REL} a FULL JOIN {_SECOND} b USING (feature)")
def _(s, d):
    return selection.combined_scores(selection.relevance(_long(s, d)), _second(s, d))


@_add("select_filled", f"""
WITH c AS (SELECT feature, (coalesce(a.score, 0) + coalesce(b.score, 0)) / 2 AS score FROM {_REL} a FULL JOIN {_SECOND} b USING (feature)), g AS (SELECT * FROM {_RED}),
k AS (SELECT * FROM (SELECT * FROM c ORDER BY score DESC, feature LIMIT 3) ANTI JOIN g USING (feature)),
m AS (SELECT feature, score FROM {_REL} ANTI JOIN g USING (feature) WHERE feature NOT IN (SELECT feature FROM k)),
u AS (SELECT *, 0 AS later FROM k UNION ALL SELECT *, 1 FROM m)
SELECT (row_number() OVER (ORDER BY later, score DESC, feature))::INT AS rank, feature, round(score, 6) AS score FROM u QUALIFY row_number() OVER (ORDER BY later, score DESC, feature) <= 3""")
def _(s, d):
    relevance = selection.relevance(_long(s, d))
    return selection.select_filled(selection.combined_scores(relevance, _second(s, d)), selection.redundant(_long(s, d), relevance, "vec_id", 0.02), relevance, 3)


@_add("ks_wasserstein", f"WITH v AS (SELECT feature, value, count_if(vec_id % 2 = 0) AS a, count_if(vec_id % 2 = 1) AS b FROM ({_LONG}) GROUP BY ALL), c AS (SELECT *, abs(sum(a) OVER r / sum(a) OVER f - sum(b) OVER r / sum(b) OVER f) AS gap, lead(value) OVER (PARTITION BY feature ORDER BY value) - value AS width FROM v WINDOW r AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY feature)), m AS (SELECT feature, avg(CASE WHEN vec_id % 2 = 0 THEN value END) AS mean_a, avg(CASE WHEN vec_id % 2 = 1 THEN value END) AS mean_b, count_if(vec_id % 2 = 0)::DOUBLE AS na, count_if(vec_id % 2 = 1)::DOUBLE AS nb, stddev_samp(value) AS sd FROM ({_LONG}) GROUP BY 1) SELECT feature, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round((mean_b - mean_a) / sd, 6) AS smd, round(max(gap), 6) AS ks, round(list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2.0::DOUBLE * k * k * max(gap) ** 2 * (max(na) * max(nb) / (max(na) + max(nb)))))), 6) AS ks_p, round(sum(gap * width), 6) AS wasserstein FROM c JOIN m USING (feature) GROUP BY feature, mean_a, mean_b, sd")
def _(s, d):
    return selection.two_sample_drift(_long(s, d), F.col("vec_id") % 2 == 0)


@_add("mutual_information")
def _(s, d):
    return selection.mutual_information(_long(s, d))


# ---- monitor: label is the stream, vec_id the order, components 1-14 the features ----

_B, _K = 20, 5


def _vectors(s, d) -> DataFrame:
    return _signals(s, d).select("vec_id", "label", F.slice("x", 1, 14).alias("v"))


_BASE = f"SELECT vec_id, label, k AS feature, embedding[k + 1]::DOUBLE AS x FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pl FROM embeddings), (SELECT unnest(range(14))::INT AS k) WHERE pl <= {_B}"
_SC = f"(WITH b AS ({_BASE}), q AS (SELECT label, feature, median(x) AS med, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM b GROUP BY ALL), m AS (SELECT label, feature, median(abs(x - med)) AS mad FROM b JOIN q USING (label, feature) GROUP BY ALL) SELECT label, feature, med AS median, CASE WHEN iqr > 0 THEN iqr ELSE 1.4826 * mad END AS scale FROM q JOIN m USING (label, feature))"
_KNN = f"(WITH z AS (SELECT e.vec_id, e.label, list((e.embedding[feature + 1]::DOUBLE - median) / scale ORDER BY feature) AS v FROM embeddings e JOIN {_SC} s ON e.label = s.label GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM z), t AS (SELECT a.vec_id, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM n a JOIN n b ON a.label = b.label AND b.place <= {_B} AND a.vec_id <> b.vec_id) SELECT n.vec_id, n.label, n.place, median(dist) AS score FROM n JOIN t ON n.vec_id = t.vec_id AND r <= {_K} GROUP BY ALL)"


@_add("robust_scaler", f"SELECT label, feature, round(median, 6) AS median, round(scale, 6) AS scale, scale > 0 AS usable FROM {_SC}")
def _(s, d):
    return monitor.robust_scaler(_vectors(s, d), "label", ["vec_id"], "v", _B)


def _scored(s, d) -> DataFrame:
    v = _vectors(s, d)
    scaled = monitor.scaled_vectors(v, "label", monitor.robust_scaler(v, "label", ["vec_id"], "v", _B), "v")
    return monitor.knn_scores(scaled, "label", ["vec_id"], "vec_id", _B, _K).select("vec_id", "label", "place", "score")


@_add("knn_scores", f"SELECT vec_id, label, place::INT AS place, round(score, 6) AS score FROM {_KNN}")
def _(s, d):
    return _scored(s, d)


@_add("monitor_thresholds", f"SELECT label, CASE WHEN count(score) = {_B} THEN round(quantile_cont(score, 0.99), 6) END AS threshold, CASE WHEN count(score) = {_B} THEN round(quantile_cont(score, 0.95), 6) END AS reset FROM {_KNN} WHERE place <= {_B} GROUP BY label")
def _(s, d):
    return monitor.thresholds(_scored(s, d), "label", _B)


@_add("view_aggregate", "SELECT user_id, ts_h, CASE WHEN count(score) = 2 AND count(*) = 2 AND count(DISTINCT event_type) = 2 THEN round(sum(score / 2), 6) END AS score FROM (SELECT user_id, date_trunc('day', ts) AS ts_h, event_type, CASE WHEN event_id % 9 <> 0 THEN value END AS score FROM events WHERE event_type IN ('click', 'view')) GROUP BY ALL")
def _(s, d):
    # a day may have one view twice, or a view without a score
    rows = events(s, d).where("event_type IN ('click', 'view')").select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts_h"), "event_type", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("score"))
    return monitor.two_view_score(rows, ["user_id", "ts_h"], "event_type")


@_add("view_violations", "SELECT user_id, ts_h, list_sort(list(c)) AS channels FROM (SELECT user_id, date_trunc('day', ts) AS ts_h, (event_id % 5)::INT AS c FROM events) GROUP BY ALL HAVING count(*) <> count(DISTINCT c) OR min(c) > 3 OR max(c // 2) <> min(c // 2)")
def _(s, d):
    rows = events(s, d).select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts_h"), (F.col("event_id") % 5).cast("int").alias("c"))
    return monitor.view_violations(rows, ["user_id", "ts_h"], "c", [(0, 1), (2, 3)])


def _states(s, d, persistence: int = 3, release: int = 3) -> DataFrame:
    """Values of a user's events as scores, the first 10 as baseline."""
    e = events(s, d).select("event_id", "user_id", "ts", F.col("value").alias("score")).withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    t = monitor.thresholds(e, "user_id", 10, 0.6, 0.5)
    return monitor.monitor_states(e.join(t, "user_id").withColumn("in_baseline", F.col("place") <= 10), "user_id", ["place"], persistence, release)


_STATE = """
WITH RECURSIVE e AS (SELECT event_id, user_id, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
t AS (SELECT user_id, CASE WHEN count(score) = 10 THEN quantile_cont(score, 0.6) END AS hi, CASE WHEN count(score) = 10 THEN quantile_cont(score, 0.5) END AS lo FROM e WHERE place <= 10 GROUP BY 1),
r AS (SELECT e.event_id, e.user_id, place, score, false AS severe, 0 AS up, 0 AS down, 'insufficient-evidence' AS state FROM e WHERE place = 1
 UNION ALL
 SELECT event_id, user_id, place, score, CASE WHEN place <= 10 THEN false WHEN severe THEN NOT (score <= lo AND down + 1 >= 3) ELSE score > hi AND up + 1 >= 3 END,
  CASE WHEN place <= 10 THEN 0 WHEN severe THEN CASE WHEN score <= lo AND down + 1 >= 3 THEN 0 ELSE up END WHEN score > hi THEN up + 1 ELSE 0 END,
  CASE WHEN place <= 10 THEN 0 WHEN severe THEN CASE WHEN score <= lo AND down + 1 < 3 THEN down + 1 ELSE 0 END WHEN score > hi THEN 0 ELSE down END,
  CASE WHEN place <= 10 THEN 'insufficient-evidence' WHEN severe THEN CASE WHEN score <= lo AND down + 1 >= 3 THEN 'baseline-consistent' ELSE 'persistent-severe-deviation' END WHEN score > hi THEN CASE WHEN up + 1 >= 3 THEN 'persistent-severe-deviation' ELSE 'deviation-observed' END ELSE 'baseline-consistent' END
 FROM (SELECT e.event_id, e.user_id, e.place, e.score, r.severe, r.up, r.down, t.hi, t.lo FROM r JOIN e ON e.user_id = r.user_id AND e.place = r.place + 1 JOIN t ON t.user_id = e.user_id))"""


@_add("monitor_states", _STATE + " SELECT event_id, user_id, place::INT AS place, state, up::BIGINT AS consecutive, down::BIGINT AS released FROM r")
def _(s, d):
    return _states(s, d).select("event_id", "user_id", "place", "state", "consecutive", "released")


@_add("state_counts", _STATE + " SELECT user_id, count_if(state = 'baseline-consistent') AS consistent, count_if(state = 'deviation-observed') AS deviation, count_if(state = 'persistent-severe-deviation') AS severe, count_if(state = 'insufficient-evidence') AS insufficient FROM r GROUP BY 1")
def _(s, d):
    return monitor.state_counts(_states(s, d), "user_id")


# ---- the whole monitor: an asset has two channels, components 1-4 and 5-8 of its vectors ----

_P = monitor.Params(baseline=12, neighbours=3, entry=0.9, reset=0.6, persistence=2, release=2)
_STEPS = {"baseline": (10, 14), "neighbours": (2, 4), "entry": (0.8, 0.95), "persistence": (1, 3)}


def _two_channels(s, d) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.slice("x", 1 + 4 * c, 4).alias("v")) for c in (0, 1))))
    return _signals(s, d).select("vec_id", "label", each.alias("_c")).select("vec_id", "label", "_c.channel", "_c.v")


def _monitor_sql(p: monitor.Params) -> str:
    """The monitor's states, from the scaler to the last row of every asset."""
    b = p.baseline
    return f"""
c AS (SELECT vec_id, label, ch, embedding[1 + 4 * ch:4 + 4 * ch]::DOUBLE[] AS v, row_number() OVER (PARTITION BY label, ch ORDER BY vec_id) AS pl FROM embeddings, (SELECT unnest(range(2)) AS ch)),
f AS (SELECT label, ch, k, v[k] AS x FROM c, (SELECT unnest(range(1, 5)) AS k) WHERE pl <= {b}),
q AS (SELECT label, ch, k, median(x) AS med, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM f GROUP BY ALL),
z AS (SELECT vec_id, label, ch, pl, list((v[k] - med) / iqr ORDER BY k) AS v FROM c JOIN q USING (label, ch) GROUP BY vec_id, label, ch, pl),
t AS (SELECT a.vec_id, a.label, a.ch, list_distance(a.v, o.v) AS dist, row_number() OVER (PARTITION BY a.vec_id, a.ch ORDER BY list_distance(a.v, o.v), o.vec_id) AS r FROM z a JOIN z o ON a.label = o.label AND a.ch = o.ch AND o.pl <= {b} AND a.vec_id <> o.vec_id),
sc AS (SELECT vec_id, label, ch, median(dist) AS score FROM t WHERE r <= {p.neighbours} GROUP BY ALL),
e AS (SELECT vec_id, label, sum(score / 2) AS score, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM sc GROUP BY vec_id, label),
h AS (SELECT label, quantile_cont(score, {p.entry}) AS hi, quantile_cont(score, {p.reset}) AS lo FROM e WHERE place <= {b} GROUP BY 1),
r AS (SELECT label, place, vec_id, false AS severe, 0 AS up, 0 AS down, 'insufficient-evidence' AS state FROM e WHERE place = 1
 UNION ALL
 SELECT label, place, vec_id, CASE WHEN place <= {b} THEN false WHEN severe THEN NOT (score <= lo AND down + 1 >= {p.release}) ELSE score > hi AND up + 1 >= {p.persistence} END,
  CASE WHEN place <= {b} THEN 0 WHEN severe THEN CASE WHEN score <= lo AND down + 1 >= {p.release} THEN 0 ELSE up END WHEN score > hi THEN up + 1 ELSE 0 END,
  CASE WHEN place <= {b} THEN 0 WHEN severe THEN CASE WHEN score <= lo AND down + 1 < {p.release} THEN down + 1 ELSE 0 END WHEN score > hi THEN 0 ELSE down END,
  CASE WHEN place <= {b} THEN 'insufficient-evidence' WHEN severe THEN CASE WHEN score <= lo AND down + 1 >= {p.release} THEN 'baseline-consistent' ELSE 'persistent-severe-deviation' END WHEN score > hi THEN CASE WHEN up + 1 >= {p.persistence} THEN 'persistent-severe-deviation' ELSE 'deviation-observed' END ELSE 'baseline-consistent' END
 FROM (SELECT e.label, e.place, e.vec_id, e.score, severe, up, down, hi, lo FROM r JOIN e ON e.label = r.label AND e.place = r.place + 1 JOIN h ON h.label = e.label))"""


@_add("whole_monitor", f"WITH RECURSIVE {_monitor_sql(_P)} SELECT label AS asset, vec_id AS ts, place::INT AS place, state, up::BIGINT AS consecutive, down::BIGINT AS released FROM r")
def _(s, d):
    return monitor.monitored(_two_channels(s, d), "label", "channel", "vec_id", "vec_id", "v", _P).select("asset", "ts", "place", "state", "consecutive", "released")


@_add("retrospective", f"WITH RECURSIVE {_monitor_sql(_P)}, said AS (SELECT label, min(CASE WHEN state = 'persistent-severe-deviation' THEN vec_id END) AS first_severe, avg((state = 'insufficient-evidence')::INT) AS abstained FROM r GROUP BY 1), o AS (SELECT label, max(vec_id) + 10 AS e, label % 2 = 0 AS damaged FROM embeddings GROUP BY 1) SELECT label AS asset, damaged, first_severe, e - first_severe AS lead, damaged AND first_severe IS NULL AS missed, round(abstained, 6) AS abstained FROM o LEFT JOIN said USING (label)")
def _(s, d):
    states = monitor.monitored(_two_channels(s, d), "label", "channel", "vec_id", "vec_id", "v", _P)
    outcomes = _signals(s, d).groupBy(F.col("label").alias("asset")).agg((F.max("vec_id") + 10).alias("end")).withColumn("damaged", F.col("asset") % 2 == 0)
    return monitor.retrospective(states, outcomes)


def _variant_sql(name: str, p: monitor.Params) -> str:
    return f"SELECT '{name}' AS variant, * FROM (WITH RECURSIVE {_monitor_sql(p)} SELECT label AS asset, count_if(state = 'baseline-consistent') AS consistent, count_if(state = 'deviation-observed') AS deviation, count_if(state = 'persistent-severe-deviation') AS severe, count_if(state = 'insufficient-evidence') AS insufficient FROM r GROUP BY 1)"


@_add("sensitivity", " UNION ALL ".join(_variant_sql(n, p) for n, p in [("primary", _P), *monitor.sensitivity_variants(_P, _STEPS)]))
def _(s, d):
    return monitor.sensitivity(_two_channels(s, d), "label", "channel", "vec_id", "vec_id", "v", _P, _STEPS)


_SENSITIVITY = " UNION ALL ".join(_variant_sql(n, p) for n, p in [("primary", _P), *monitor.sensitivity_variants(_P, _STEPS)])


@_add("order_stability", f"WITH o AS (SELECT variant, list(asset ORDER BY severe / (consistent + deviation + severe + insufficient) DESC, asset) AS ord FROM ({_SENSITIVITY}) GROUP BY variant) SELECT variant, ord AS \"order\", ord = (SELECT ord FROM o WHERE variant = 'primary') AS as_primary FROM o")
def _(s, d):
    return monitor.order_stability(monitor.sensitivity(_two_channels(s, d), "label", "channel", "vec_id", "vec_id", "v", _P, _STEPS))


_ALERT = "(SELECT *, value > 60 AS alert FROM events)"


def _alerts(s, d):
    return events(s, d).withColumn("alert", F.col("value") > 60)


@_add("clock_disagreement", f"SELECT user_id, count_if((us >= 604800) <> alert) AS disagreements, count_if(alert) AS alerts, count_if(pl >= 10 AND (pl - 10) % 7 = 0) AS inspections FROM (SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e6 AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pl FROM {_ALERT}) GROUP BY user_id")
def _(s, d):
    return monitor.clock_disagreement(_alerts(s, d), "user_id", "ts", "alert", every=7, baseline=10)


@_add("burden_order", f"SELECT user_id, round(avg(alert::INT), 6) AS burden, row_number() OVER (ORDER BY avg(alert::INT) DESC, user_id)::INT AS rank FROM {_ALERT} GROUP BY user_id")
def _(s, d):
    return monitor.burden_order(_alerts(s, d), "user_id", "alert")


# ---- models: rows only ----


def _parts(s, d) -> tuple[DataFrame, DataFrame, list[str]]:
    names = [f"f{k}" for k in range(8)]
    df = _signals(s, d).select("vec_id", "label", F.col("x")[20].alias("y"), *(F.col("x")[k].alias(n) for k, n in enumerate(names)))
    df = df.withColumn("y", 10 + 5 * F.col("y") + 3 * F.col("f0"))
    return df.where("label < 7"), df.where("label >= 7"), names


@_add("ks_exact", f"""
WITH RECURSIVE v AS (SELECT feature, value, count_if(vec_id % 2 = 0) AS a, count_if(vec_id % 2 = 1) AS b FROM ({_LONG}) WHERE value IS NOT NULL GROUP BY ALL),
c AS (SELECT feature, abs(sum(a) OVER r / sum(a) OVER f - sum(b) OVER r / sum(b) OVER f) AS gap, sum(a) OVER f AS n, sum(b) OVER f AS m FROM v WINDOW r AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY feature)),
d AS (SELECT feature, max(gap) AS ks, max(n)::BIGINT AS n, max(m)::BIGINT AS m, round(max(gap) * max(n) * max(m))::BIGINT AS least FROM c GROUP BY 1),
p AS (SELECT feature, n, m, least, 0 AS k, list_transform(range(0, n + 1), lambda i: (least <= 0)::INT::DOUBLE) AS a FROM d
  UNION ALL SELECT feature, n, m, least, k + 1, list_transform(range(0, n + 1), lambda i: CASE WHEN k + 1 - i < 0 OR k + 1 - i > m THEN 0 WHEN abs(i * m - (k + 1 - i) * n) >= least THEN 1 ELSE (i * coalesce(a[i], 0) + (k + 1 - i) * a[i + 1]) / (k + 1) END::DOUBLE) FROM p WHERE k < n + m)
SELECT feature, round(ks, 6) AS ks, round(a[p.n + 1], 6) AS ks_p, d.n, d.m FROM p JOIN d USING (feature) WHERE k = p.n + p.m""")
def _(s, d):
    return selection.with_exact_p(selection.two_sample_drift(_long(s, d), F.col("vec_id") % 2 == 0, sizes=True)).select("feature", "ks", "ks_p", "n", "m")


@_add("answered", """
WITH b AS (SELECT vec_id, embedding[1]::DOUBLE * 100 + 60 AS a, embedding[2]::DOUBLE AS b FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 5 < 3 THEN round(2 * a + 3 * b, 2) END AS predicted_rul_hours, CASE WHEN vec_id % 5 < 3 THEN CASE WHEN 2 * a + 3 * b < 50 THEN 'critical' WHEN 2 * a + 3 * b < 150 THEN 'warning' ELSE 'normal' END END AS risk_level,
  CASE WHEN vec_id % 5 < 3 THEN CASE WHEN 2 * a + 3 * b < 50 THEN 'Schedule emergency maintenance within 24 hours' WHEN 2 * a + 3 * b < 150 THEN 'Schedule maintenance within 3-5 days' ELSE 'Continue normal monitoring' END END AS recommended_action,
  CASE vec_id % 5 WHEN 3 THEN 'features' WHEN 4 THEN 'body' END AS problem FROM b""")
def _(s, d):
    a, b = (F.col("x")[0] * 100 + 60).alias("a"), F.col("x")[1].alias("b")
    body = F.when(F.col("vec_id") % 5 == 4, "not json").when(F.col("vec_id") % 5 == 3, F.to_json(F.struct(F.struct(a).alias("features")))).otherwise(F.to_json(F.struct(F.struct(b, a, F.lit(1).alias("more")).alias("features"))))
    requests = _signals(s, d).select("vec_id", body.alias("body"))
    return models.answered(requests, ["a", "b"], lambda rows: rows.withColumn("yhat", 2 * F.col("a") + 3 * F.col("b"))).drop("body")


@_add("leafwise_boosting")
def _(s, d):
    train, test, names = _parts(s, d)
    model = boosting.leafwise(train, names, "y", boosting.Params(trees=8, leaves=31, depth=6, rate=0.3))
    return boosting.predicted(model, test).select("vec_id", "label", "y", "yhat")


@_add("ridge")
def _(s, d):
    train, test, names = _parts(s, d)
    return models.ridge(train, test, names, "y", "label").select("vec_id", "label", "y", "yhat")


@_add("random_forest")
def _(s, d):
    train, test, names = _parts(s, d)
    return models.predicted(models.forest(train, names, "y", 10, 5), test, names).select("vec_id", "label", "y", "yhat")


@_add("boosted_trees")
def _(s, d):
    train, test, names = _parts(s, d)
    return models.predicted(models.boosted(train, names, "y", 5, 3), test, names).select("vec_id", "label", "y", "yhat")


@_add("feature_importance")
def _(s, d):
    train, _, names = _parts(s, d)
    return models.importances(models.forest(train, names, "y", 10, 5), names, train)


@_add("learning_curve")
def _(s, d):
    train, test, names = _parts(s, d)
    return models.learning_curve(train, test, names, "y", "vec_id", trees=3, depth=3)


@_add("principal_components")
def _(s, d):
    train, _, names = _parts(s, d)
    return selection.principal_components(train.select("vec_id", *names), names)[0]
