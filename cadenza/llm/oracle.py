"""DuckDB SQL with the same results as the queries, where SQL can express them."""

#: The words of a text.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

def _centroids(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """The rounds of exact k-means, one after the other."""
    sql = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = {width} AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
x AS MATERIALIZED (SELECT r, vec_id, unnest(range({width})) AS j, floor(256 * unnest(e))::BIGINT AS v FROM v),
c0 AS MATERIALIZED (SELECT c, j, v FROM x JOIN (SELECT r, row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, 'null')), e) - 1 AS c FROM v) USING (r) WHERE c < {k}),"""
    for i in range(rounds + 1):
        sql += f"""
a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, sum((x.v - k.v) * (x.v - k.v))::BIGINT AS d FROM x JOIN c{i} k USING (j) GROUP BY r, c) GROUP BY r),"""
        if i < rounds:
            sql += f"""
m{i} AS (SELECT c, j, sum(v) AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY c, j),
c{i + 1} AS MATERIALIZED (SELECT c, j, coalesce((s - ((s % n) + n) % n) // n, v)::BIGINT AS v FROM c{i} LEFT JOIN m{i} USING (c, j)),"""
    return sql + f"""
h AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN h USING (c)"""


ORACLE = {
    "op10_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op6_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i FROM win JOIN firsts USING (s) WHERE f < doc_id), (SELECT unnest(range(13)) AS k)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op3_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
tri AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(3)) AS k) GROUP BY doc_id),
line AS (SELECT doc_id, source, t, regexp_replace(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM (SELECT doc_id, source, t, unnest(l) AS x FROM d)),
host AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
often AS (SELECT q.source, x FROM (SELECT source, x, count(DISTINCT t) AS c FROM line GROUP BY ALL) q JOIN host ON q.source IS NOT DISTINCT FROM host.source WHERE c > 32 AND c > 0.05 * n),
rem AS (SELECT doc_id, sum(len(string_split(x, ' ')))::BIGINT AS removed_words FROM line SEMI JOIN often ON line.source IS NOT DISTINCT FROM often.source AND line.x = often.x GROUP BY doc_id),
base AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN rem USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < 50 OR n_words - removed_words < 0.5 * n_words)) AS kept FROM f""",
    # addresses that stand in one another's canonical or refresh tags reach each other; targets are
    # absolute, without scheme, or from the root
    "op8_url_filter": r"""
WITH RECURSIVE r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
tag AS (SELECT url AS base, unnest(regexp_extract_all(coalesce(html, ''), '<(?:link|meta)\b[^>]*>', 0, 'is')) AS t FROM pages WHERE contains(url, '://')),
att AS (SELECT base, lower(t[2:5]) AS kind, list_transform(['rel', 'href', 'http-equiv', 'content'], lambda a: trim(regexp_extract(t, '[\s"'']' || a || '\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1, 'is'), '"''')) AS a FROM tag),
lnk AS (SELECT base, trim(replace(CASE WHEN kind = 'link' AND regexp_matches(lower(a[1]), '(^|\s)canonical(\s|$)') THEN a[2] WHEN kind = 'meta' AND lower(a[3]) = 'refresh' THEN regexp_extract(a[4], 'url\s*=\s*[''"]?([^''"]+)', 1, 'is') ELSE '' END, '&amp;', '&')) AS x FROM att),
adr AS (SELECT base, CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN x WHEN starts_with(x, '//') THEN regexp_extract(base, '^(.*?)://', 1, 's') || ':' || x WHEN starts_with(x, '/') THEN regexp_extract(base, '^(.*?://[^/?#]*)', 1, 's') || x END AS x FROM lnk),
pair AS (SELECT base AS a, x AS b FROM adr WHERE x IS NOT NULL),
ends AS (SELECT url AS x FROM pages WHERE contains(url, '://') UNION SELECT b FROM pair),
node AS (SELECT x, translate(regexp_extract(x, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(x, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, lower(regexp_extract(x, '^(.*?)://', 1, 's')) || '://' || regexp_extract(x, '^.*?://[^/?#]*([^#]*)', 1, 's') AS n FROM ends),
named AS (SELECT x, host, path, host || ' ' || n AS n FROM node),
best AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM named JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n),
link AS (SELECT u.n AS a, v.n AS b FROM pair JOIN named u ON u.x = pair.a JOIN named v ON v.x = pair.b),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
alias AS (SELECT a AS n, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS v FROM reach JOIN best ON reach.b = best.n GROUP BY a)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(best.verdict, alias.v, 'allow') AS verdict FROM pages LEFT JOIN named ON url = x LEFT JOIN best USING (n) LEFT JOIN alias USING (n)""",
    # on pages whose article is marked up so and holds no other part, its text
    "op11_main_text": r"""
SELECT page_id, url, x AS text, length(x)::BIGINT AS n_chars FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'),
  '&quot;', '"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS x FROM pages)""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM v GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN v USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.n + l.v) AS p, 1 + (1000000000::HUGEINT * (v.n + 1)) // (l.n + l.v) AS q
  FROM gn JOIN l USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair z ON z.lang = x.lang AND z.source = x.source AND z.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200""",
    "op13_centroids": _centroids(),
}
