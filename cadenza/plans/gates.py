"""Queries of the gates, each over tables with faults put in, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import gates, labels, selection
from cadenza.plans import assets, streams
from cadenza.plans.streams import events, rounded, table

Q, S = {}, {}


def _add(name: str, sql: str):
    def keep(f):
        Q[name] = lambda spark, d: rounded(f(spark, d))
        S[name] = sql
        return f

    return keep


@_add("pin_violations", """
WITH p AS (SELECT p_name || p_partkey AS name, sha256(p_type) AS want FROM part WHERE p_partkey % 7 <> 0), h AS (SELECT p_name || p_partkey AS name, CASE WHEN p_partkey % 13 <> 0 THEN sha256(CASE WHEN p_partkey % 11 = 0 THEN p_brand ELSE p_type END) END AS have FROM part WHERE p_partkey % 5 <> 0)
SELECT name, 'missing' AS problem FROM p ANTI JOIN h USING (name) UNION ALL SELECT name, 'not pinned' FROM h ANTI JOIN p USING (name) UNION ALL SELECT name, 'digest' FROM p JOIN h USING (name) WHERE want IS DISTINCT FROM have""")
def _(s, d):
    name = F.concat("p_name", "p_partkey").alias("name")
    part = table(s, d, "part")
    pins = part.where("p_partkey % 7 <> 0").select(name, F.sha2("p_type", 256).alias("sha256"))
    found = part.where("p_partkey % 5 <> 0").select(name, F.when(F.col("p_partkey") % 13 != 0, F.sha2(F.when(F.col("p_partkey") % 11 == 0, F.col("p_brand")).otherwise(F.col("p_type")), 256)).alias("sha256"))
    return gates.pin_violations(pins, found)


#: Order dates as recording names: many share a day, some are no names, some paths are unsafe.
_LISTED = "(SELECT CASE WHEN o_orderkey % 97 = 0 THEN '../' ELSE 'raw/' END || o_custkey || '/' || n AS path, n AS name FROM (SELECT *, CASE WHEN o_orderkey % 89 = 0 THEN 'x' || o_orderkey WHEN o_orderkey % 83 = 0 THEN strftime(o_orderdate, '%Y.13.%d.%H.%M.%S') ELSE strftime(o_orderdate, '%Y.%m.%d.%H.%M.%S') END AS n FROM orders))"
_NAME = r"^\d{4}(\.\d{2}){5}$"


@_add("discovery_violations", rf"""
WITH l AS (SELECT *, regexp_matches(name, '{_NAME}') AS ok, try_strptime(name, '%Y.%m.%d.%H.%M.%S') AS t FROM {_LISTED}),
h AS (SELECT sha256(name) AS h FROM l), pt AS (SELECT substr(h, 1, 3) AS k, sha256(string_agg(h, chr(10) ORDER BY h)) AS dg FROM h GROUP BY 1)
SELECT path AS subject, CASE WHEN NOT ok THEN 'name' WHEN t IS NULL THEN 'time' ELSE 'unsafe path' END AS problem FROM l WHERE NOT ok OR t IS NULL OR starts_with(path, '../')
UNION ALL SELECT path, 'repeated path' FROM l GROUP BY path HAVING count(*) > 1
UNION ALL SELECT strftime(t, '%Y-%m-%d %H:%M:%S'), 'repeated time' FROM l WHERE ok AND t IS NOT NULL GROUP BY t HAVING count(*) > 1
UNION ALL SELECT count(*)::VARCHAR, 'count' FROM l HAVING count(*) <> 7
UNION ALL SELECT sha256(string_agg(dg, chr(10) ORDER BY k)), 'digest' FROM pt""")
def _(s, d):
    from cadenza.sources.recordings import file_time

    stamp = lambda month: F.date_format("o_orderdate", f"yyyy.{month}.dd.HH.mm.ss")
    name = F.when(F.col("o_orderkey") % 89 == 0, F.concat(F.lit("x"), "o_orderkey")).when(F.col("o_orderkey") % 83 == 0, stamp("'13'")).otherwise(stamp("MM"))
    rows = table(s, d, "orders").withColumn("name", name)
    rows = rows.select(F.concat(F.when(F.col("o_orderkey") % 97 == 0, "../").otherwise("raw/"), "o_custkey", F.lit("/"), "name").alias("path"), "name")
    return gates.discovery_violations(rows, "path", "name", file_time(F.col("name")), _NAME, count=7, digest="none")


@_add("row_violations", "WITH r AS (SELECT l_orderkey, l_linenumber, unnest([CASE WHEN l_quantity BETWEEN 2 AND 49 THEN NULL ELSE 'quantity' END, CASE WHEN l_returnflag IN ('A', 'N') THEN NULL ELSE 'flag' END, CASE WHEN coalesce(nullif(l_linestatus, 'F') = 'O', false) THEN NULL ELSE 'status' END]) AS rule FROM lineitem) SELECT * FROM r WHERE rule IS NOT NULL")
def _(s, d):
    rules = {"quantity": F.col("l_quantity").between(2, 49), "flag": F.col("l_returnflag").isin("A", "N"), "status": F.nullif(F.col("l_linestatus"), F.lit("F")) == "O"}
    return gates.row_violations(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], rules)


@_add("vector_violations", "SELECT vec_id, 'v length' AS rule FROM embeddings WHERE vec_id % 7 = 0 UNION ALL SELECT vec_id, 'v finite' FROM embeddings WHERE vec_id % 11 = 0 OR vec_id % 13 = 0 UNION ALL SELECT vec_id, unnest(['v length', 'v finite']) FROM embeddings WHERE vec_id % 17 = 0 AND vec_id % 7 <> 0 AND vec_id % 11 <> 0 AND vec_id % 13 <> 0")
def _(s, d):
    # a value too few, a value that isn't finite, a null among the values, or no vector at all
    odd = F.when(F.col("vec_id") % 11 == 0, float("nan")).when(F.col("vec_id") % 13 == 0, float("-inf")).when(F.col("vec_id") % 3 != 0, 1.0)
    vector = F.array_append(F.slice("x", 1, F.when(F.col("vec_id") % 7 == 0, 62).otherwise(63)), odd)
    none = (F.col("vec_id") % 17 == 0) & (F.col("vec_id") % 7 != 0) & (F.col("vec_id") % 11 != 0) & (F.col("vec_id") % 13 != 0)
    return gates.row_violations(assets._signals(s, d).withColumn("v", F.when(~none, vector)), ["vec_id"], gates.vector_rules("v", 64))


@_add("stream_violations", """
WITH l AS (SELECT l_orderkey, CASE WHEN l_orderkey % 31 = 0 THEN l_linenumber ELSE l_linenumber - 1 END AS i FROM lineitem), b AS (SELECT l_orderkey, count(*) AS n, min(i) AS lo, max(i) AS hi, count(DISTINCT i) AS d FROM l GROUP BY 1)
SELECT l_orderkey::VARCHAR AS stream, 'order' AS problem FROM b WHERE lo <> 0 OR hi <> n - 1 OR d <> n UNION ALL SELECT l_orderkey::VARCHAR, 'rows' FROM b WHERE n <> 4 UNION ALL SELECT NULL, 'streams' FROM b HAVING count(*) <> 5""")
def _(s, d):
    rows = table(s, d, "lineitem").withColumn("i", F.col("l_linenumber") - F.when(F.col("l_orderkey") % 31 == 0, 0).otherwise(1))
    return gates.stream_violations(rows, "l_orderkey", "i", rows=4, streams=5)


#: The value of a key is a text that looks like another key.
_JSON = """'{"k": 1, "note": "a \\"rul_hours\\": b", "in": [{"Rul_Hours": ' || event_id || ', "x": {"' || event_type || '_label": null}}]}'"""


@_add("forbidden_keys", f"SELECT event_id, unnest(['Rul_Hours'] || CASE WHEN event_type = 'view' THEN ['view_label'] ELSE [] END) AS found FROM (SELECT event_id, event_type, {_JSON} AS j FROM events) WHERE json_valid(j)")
def _(s, d):
    text = F.format_string('{"k": 1, "note": "a \\"rul_hours\\": b", "in": [{"Rul_Hours": %d, "x": {"%s_label": null}}]}', "event_id", "event_type")
    return gates.forbidden_keys(events(s, d).select("event_id", text.alias("j")), ["event_id"], "j", ["rul", "view"])


@_add("affirmative_claims", "SELECT event_id, 'Untouched' AS found FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'qualified_holdout' FROM events WHERE event_type = 'view'")
def _(s, d):
    # a value that says so, and a key that isn't true, are no claims
    text = F.format_string('{"note": "\\"untouched\\": true", "outcome_blind": "true", "in": [{"Untouched" : %s, "x": {"qualified_holdout":%s, "other": true}}]}', (F.col("event_id") % 3 == 0).cast("string"), (F.col("event_type") == "view").cast("string"))
    return gates.affirmative_claims(events(s, d).select("event_id", text.alias("j")), ["event_id"], "j", ["outcome_blind", "untouched", "qualified_holdout", "external_holdout"])


_ROW = "sha256('{{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}}')"
_CHUNKS = f"SELECT event_id // 128 AS chunk, min(event_id) AS first, max(event_id) AS last, count(*) AS n, sha256(string_agg({_ROW}, chr(10) ORDER BY event_id)) AS digest FROM {{0}} GROUP BY 1"
_KEPT = "(SELECT * FROM events WHERE event_id NOT BETWEEN 200 AND 210)"


def _receipts(s, d):
    """Stated for all events; some changed, lost, or given twice."""
    e = gates.chunk_receipts(events(s, d), "event_id", ["event_id", "event_type"])
    e = e.withColumn("digest", F.when(F.col("chunk") == 3, "other").otherwise(F.col("digest"))).where("chunk <> 5")
    return e.unionByName(e.where("chunk = 4")).unionByName(e.where("chunk = 0").withColumn("chunk", F.lit(100_000).cast("long")))


@_add("chunk_receipts", _CHUNKS.format("events").replace("{{", "{").replace("}}", "}"))
def _(s, d):
    return gates.chunk_receipts(events(s, d), "event_id", ["event_id", "event_type"])


@_add("receipt_violations", f"""
WITH h AS ({_CHUNKS.format(_KEPT)}), e AS ({_CHUNKS.format("events")}), r AS (SELECT * REPLACE (CASE WHEN chunk = 3 THEN 'other' ELSE digest END AS digest) FROM e WHERE chunk <> 5),
t AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE chunk = 4 UNION ALL SELECT * REPLACE (100000 AS chunk) FROM r WHERE chunk = 0), c AS (SELECT chunk, count(*) AS times FROM t GROUP BY 1)
SELECT chunk, 'no receipt' AS problem FROM h ANTI JOIN t USING (chunk) UNION ALL SELECT chunk, 'no rows' FROM c ANTI JOIN h USING (chunk) UNION ALL SELECT chunk, 'repeated receipt' FROM c WHERE times > 1
UNION ALL SELECT DISTINCT chunk, 'range' FROM h JOIN t USING (chunk) WHERE h.first <> t.first OR h.last <> t.last UNION ALL SELECT DISTINCT chunk, 'count' FROM h JOIN t USING (chunk) WHERE h.n <> t.n UNION ALL SELECT DISTINCT chunk, 'digest' FROM h JOIN t USING (chunk) WHERE h.digest <> t.digest
UNION ALL SELECT chunk, 'gap' FROM (SELECT chunk, first > lag(last) OVER (ORDER BY chunk) + 1 AS bad FROM h) WHERE bad UNION ALL SELECT chunk, 'short' FROM h WHERE n < 128 AND chunk < (SELECT max(chunk) FROM h)""".replace("{{", "{").replace("}}", "}"))
def _(s, d):
    return gates.receipt_violations(events(s, d).where("event_id NOT BETWEEN 200 AND 210"), _receipts(s, d), "event_id", ["event_id", "event_type"])


def _packages(s, d):
    """Packages of 64 orders by row number as index, each with what it states, and a plan; with faults: a package
    that takes rows of the next, one with a repeated index, with a hole, with rows of another data set, one that
    isn't stated, one that is stated twice, one that no plan has, one that is planned but not there."""
    ordered = table(s, d, "customer").select((F.col("c_custkey") - F.lit(1)).alias("i"), "c_name")
    ordered = ordered.where("i < 960").withColumns({"k": F.floor(F.col("i") / 64), "dataset": F.when(F.col("i") < 640, "a").otherwise("b")})
    rows = ordered.withColumn("package", F.concat(F.lit("p"), "k"))
    rows = rows.where("k <> 9 AND i <> 300")
    taken = ordered.where("i BETWEEN 128 AND 140").withColumn("package", F.lit("p1"))
    twice = ordered.where("i = 200").withColumn("package", F.lit("p3"))
    other = rows.withColumn("dataset", F.when(F.col("i") == 700, "a").otherwise(F.col("dataset")))
    rows = other.unionByName(taken).unionByName(twice).select("dataset", "package", "i", "c_name")
    line = F.to_json(F.struct("i", "c_name"))
    stated = rows.groupBy("package").agg(F.max("dataset").alias("dataset"), F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("n"), gates.rows_digest(F.collect_list(F.struct(F.col("i").alias("_i"), F.sha2(line, 256).alias("_h")))).alias("digest"))
    stated = stated.where("package <> 'p6'").withColumns({"n": F.when(F.col("package") == "p7", 63).otherwise(F.col("n")), "digest": F.when(F.col("package") == "p8", "other").otherwise(F.col("digest"))})
    stated = stated.unionByName(stated.where("package = 'p5'")).unionByName(stated.where("package = 'p12'").withColumns({"package": F.lit("x"), "first": F.lit(5000).cast("long"), "last": F.lit(5063).cast("long")}))
    plan = ordered.groupBy("k", "dataset").agg(F.min("i").alias("first"), F.max("i").alias("last")).select("dataset", F.concat(F.lit("p"), "k").alias("package"), "first", "last")
    return rows, stated, plan


@_add("assembly_violations", """
WITH o AS (SELECT c_custkey - 1 AS i, c_name, (c_custkey - 1) // 64 AS k, CASE WHEN c_custkey - 1 < 640 THEN 'a' ELSE 'b' END AS dataset FROM customer WHERE c_custkey - 1 < 960),
r AS (SELECT CASE WHEN i = 700 THEN 'a' ELSE dataset END AS dataset, 'p' || k AS package, i, c_name FROM o WHERE k <> 9 AND i <> 300 UNION ALL SELECT dataset, 'p1', i, c_name FROM o WHERE i BETWEEN 128 AND 140 UNION ALL SELECT dataset, 'p3', i, c_name FROM o WHERE i = 200),
h AS (SELECT package, count(*) AS n, min(i) AS lo, max(i) AS hi, count(DISTINCT i) AS dn, min(dataset) AS d0, max(dataset) AS d1 FROM r GROUP BY 1),
t AS (SELECT package, d1 AS dataset, lo AS first, hi AS last, CASE package WHEN 'p7' THEN 63 ELSE n END AS n, package <> 'p8' AS digest_ok FROM h WHERE package <> 'p6'),
st AS (SELECT * FROM t UNION ALL SELECT * FROM t WHERE package = 'p5' UNION ALL SELECT 'x', dataset, 5000, 5063, n, digest_ok FROM t WHERE package = 'p12'),
pl AS (SELECT dataset, 'p' || k AS package, min(i) AS first, max(i) AS last FROM o GROUP BY dataset, k),
one AS (SELECT DISTINCT * FROM st), e AS (SELECT dataset, min(first) AS b, max(last) AS z FROM pl GROUP BY 1),
sw AS (SELECT dataset, package, first, last, max(last) OVER (PARTITION BY dataset ORDER BY first, last, package ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM st)
SELECT dataset, package, 'missing' AS problem FROM pl ANTI JOIN st USING (package) UNION ALL SELECT dataset, package, 'foreign' FROM one ANTI JOIN pl USING (package) UNION ALL SELECT pl.dataset, package, 'not stated' FROM h JOIN pl USING (package) ANTI JOIN st USING (package)
UNION ALL SELECT any_value(dataset), package, 'repeated' FROM st GROUP BY package HAVING count(*) > 1 UNION ALL SELECT one.dataset, package, 'plan' FROM one JOIN pl USING (package) WHERE one.dataset <> pl.dataset OR one.first <> pl.first OR one.last <> pl.last
UNION ALL SELECT dataset, package, 'no rows' FROM one ANTI JOIN h USING (package) UNION ALL SELECT dataset, package, 'dataset' FROM one JOIN h USING (package) WHERE d0 <> dataset OR d1 <> dataset
UNION ALL SELECT coalesce(one.dataset, pl.dataset), package, 'repeated index' FROM h LEFT JOIN one USING (package) LEFT JOIN pl USING (package) WHERE dn <> h.n UNION ALL SELECT coalesce(one.dataset, pl.dataset), package, 'holes' FROM h LEFT JOIN one USING (package) LEFT JOIN pl USING (package) WHERE hi - lo + 1 <> dn
UNION ALL SELECT dataset, package, 'range' FROM one JOIN h USING (package) WHERE lo <> first OR hi <> last UNION ALL SELECT dataset, package, 'count' FROM one JOIN h USING (package) WHERE h.n <> one.n UNION ALL SELECT dataset, package, 'digest' FROM one JOIN h USING (package) WHERE NOT digest_ok
UNION ALL SELECT dataset, package, 'overlap' FROM sw WHERE first <= reach UNION ALL SELECT dataset, package, 'gap' FROM sw JOIN e USING (dataset) WHERE first > coalesce(reach, b - 1) + 1
UNION ALL SELECT dataset, NULL, 'gap' FROM e LEFT JOIN (SELECT dataset, max(last) AS m FROM st GROUP BY 1) USING (dataset) WHERE coalesce(m < z, true)""")
def _(s, d):
    return gates.assembly_violations(*_packages(s, d), "i", ["i", "c_name"])


_KS = f"(SELECT feature, max(gap) AS ks FROM (SELECT feature, abs(sum(a) OVER r / sum(a) OVER f - sum(b) OVER r / sum(b) OVER f) AS gap FROM (SELECT feature, value, count_if(vec_id % 2 = 0) AS a, count_if(vec_id % 2 = 1) AS b FROM ({assets._LONG}) GROUP BY ALL) WINDOW r AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY feature)) GROUP BY feature)"
_HYPOTHESES = f"""(SELECT 'shift' AS hypothesis, avg((ks >= 0.1)::INT) AS measure, 0.5::DOUBLE AS threshold FROM {_KS} UNION ALL SELECT 'weak relation', avg((score < 0.5)::INT), 0.9 FROM {assets._REL}
UNION ALL SELECT 'late failures', avg((rul_seconds > 864000)::INT), 0.01 FROM ({streams._RUL}) UNION ALL SELECT 'no rows', NULL, 1 )"""


def _evidence(s, d):
    drift = selection.two_sample_drift(assets._long(s, d), F.col("vec_id") % 2 == 0)
    share = lambda c: F.avg(c.cast("int"))
    return gates.hypotheses({
        "shift": (drift, share(F.col("ks") >= 0.1), 0.5), "weak relation": (selection.relevance(assets._long(s, d)), share(F.col("score") < 0.5), 0.9),
        "late failures": (streams.rul(s, d), share(F.col("rul_seconds") > 864_000), 0.01), "no rows": (drift.where("false"), F.avg("ks"), 1),
    })


@_add("hypotheses", f"SELECT hypothesis, round(measure, 6) AS measure, threshold, measure >= threshold AS supported FROM {_HYPOTHESES}")
def _(s, d):
    return _evidence(s, d)


@_add("decision", f"SELECT count(*) AS n, count_if(coalesce(measure >= threshold, false)) AS passed, count_if(NOT coalesce(measure >= threshold, false)) AS failed, bool_and(coalesce(measure >= threshold, false)) AS verdict FROM {_HYPOTHESES}")
def _(s, d):
    return gates.decision(_evidence(s, d))


@_add("order_violations", "WITH o AS (SELECT user_id, event_id, floor(value)::BIGINT AS v, lag(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, event_id, CASE WHEN v = b THEN 'repeated' ELSE 'unordered' END AS problem FROM o WHERE v <= b OR v IS NULL")
def _(s, d):
    return gates.order_violations(events(s, d).withColumn("v", F.floor("value")), "user_id", "event_id", "v")


def _gates(s, d) -> dict:
    return {
        "pins": Q["pin_violations"](s, d), "rows": Q["row_violations"](s, d), "streams": Q["stream_violations"](s, d), "keys": Q["forbidden_keys"](s, d), "claims": Q["affirmative_claims"](s, d),
        "assembly": Q["assembly_violations"](s, d), "order": Q["order_violations"](s, d), "vectors": Q["vector_violations"](s, d).where("vec_id < 0"),
    }


_OF = {"pins": "pin_violations", "rows": "row_violations", "streams": "stream_violations", "keys": "forbidden_keys", "claims": "affirmative_claims", "assembly": "assembly_violations", "order": "order_violations"}
_COUNTS = " UNION ALL ".join([*(f"SELECT '{g}' AS gate, (SELECT count(*) FROM ({S[q]})) AS n" for g, q in _OF.items()), "SELECT 'vectors', 0"])


@_add("package_acceptance", f"WITH g AS ({_COUNTS}) SELECT gate, n, n = 0 AS accepted FROM g UNION ALL SELECT NULL, sum(n)::BIGINT, sum(n) = 0 FROM g")
def _(s, d):
    return gates.acceptance(_gates(s, d))


@_add("registration", """
WITH p AS (SELECT n_name AS dataset, n_nationkey * 10 AS bytes, sha256(n_name) AS h, CASE n_nationkey WHEN 3 THEN 31 ELSE n_nationkey * 10 END AS eb, CASE n_nationkey WHEN 4 THEN 'x' ELSE sha256(n_name) END AS eh, n_nationkey AS k FROM nation),
m AS (SELECT s_nationkey AS k, s_suppkey AS i, CASE WHEN s_suppkey % 50 = 0 THEN 'a' ELSE s_name END AS path, s_suppkey AS b FROM supplier WHERE s_nationkey <> 5),
o AS (SELECT k, path <= lag(path) OVER (PARTITION BY k ORDER BY i) AS bad FROM m), x AS (SELECT k, bool_or(coalesce(bad, false)) AS bad FROM o GROUP BY 1),
c AS (SELECT k, count(*) AS members, sum(b)::BIGINT AS member_bytes, min(path) AS first_path, max(path) AS last_path FROM m GROUP BY 1)
SELECT CASE WHEN p.k = 7 THEN 'NATION 7' ELSE dataset END AS dataset, coalesce(members, 0) AS members, member_bytes, first_path, last_path,
  list_filter([CASE WHEN p.k <> 7 AND (bytes <> eb OR h <> eh) THEN 'drift' END, CASE WHEN members IS NULL THEN 'no members' END, CASE WHEN p.k = 7 THEN 'not registered' END, CASE WHEN bad THEN 'order' END], lambda t: t IS NOT NULL) AS problems
FROM p LEFT JOIN c USING (k) LEFT JOIN x USING (k) WHERE p.k <> 7 OR members IS NOT NULL""")
def _(s, d):
    nation, key = table(s, d, "nation"), F.col("n_nationkey")
    wanted = nation.where("n_nationkey <> 7").select(
        F.col("n_name").alias("dataset"), (key * 10).cast("long").alias("bytes"), F.sha2("n_name", 256).alias("sha256"), F.when(key == 3, 31).otherwise(key * 10).cast("long").alias("expected_bytes"),
        F.when(key == 4, "x").otherwise(F.sha2("n_name", 256)).alias("expected_sha256"),
    )
    named = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.when(key == 7, "NATION 7").otherwise(F.col("n_name")).alias("dataset"))
    members = table(s, d, "supplier").where("s_nationkey <> 5").join(named, "s_nationkey")
    members = members.select("dataset", F.col("s_suppkey").alias("member_index"), F.when(F.col("s_suppkey") % 50 == 0, "a").otherwise(F.col("s_name")).alias("path"), F.col("s_suppkey").alias("bytes"))
    return gates.registration(wanted, members)
