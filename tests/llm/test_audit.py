"""Main text, source divergence and centroids: odd tables against brute force, SQL, and empty tables."""

import collections
import hashlib
import math
import re

import duckdb
import numpy as np
import pytest

from cadenza.llm import centroids, divergence, main_text, oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_main_text", "op12_source_divergence", "op13_centroids"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(oracle.ORACLE[name])
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


# ---- main text ----

LONG = "The committee met on Tuesday, and after a long debate it agreed on most of the points. Others were put off; nobody minded."
PAGES = {
    "article": (f"<body><nav>Home</nav><header><p>{LONG}</p></header><article class='post tag-ads has-sidebar'><header><h1>Title</h1></header><p>{LONG}<p>b<b>ol</b>d<ul><li>one<li><a href=x>two</a></ul></article><footer>{LONG}</footer>", f"Title {LONG} bold one two"),
    "comments": (f"<main><p>{LONG}</p><section id='comments'><article><p>{LONG}</p></article></section><aside>{LONG}</aside></main>", LONG),
    "plain": (f"<div id=top><a href=/>Home</a> <a href=/x>News</a></div><div class=content><h2>On</h2><p>{LONG}</p><p>{LONG}</p><p>Short.</p></div><div>All rights</div>", f"On {LONG} {LONG} Short."),
    "parts": (f"<div class='cookie-notice'>{LONG}</div><form>{LONG}</form><div style='display: none'>{LONG}</div><div class='site-ad'><div>{LONG}</div></div><p>{LONG} <span class=ad>Buy!</span></p><div role=contentinfo>{LONG}</div>", LONG),
    "references": ("<article>a&amp;lt;b &#x41;&eacute;&nbsp;&bogus; &am x</article>", "a&lt;b Aé &bogus; &am x"),
    "raw": ("<article><p>one</p><script>if (a</p>) '<p>x</p>'</script><style>p{}</style><!-- <p>no</p> --><p title='a>b' data-x=\"<p>\">two</article>", "one two"),
    "unclosed": (f"<article><p>{LONG}</p><div>more<p>end</p><script>var x = '</p>'", f"{LONG} more end"),
    "cut": (f"<article><p>{LONG}</p><p>tail <a hre", f"{LONG} tail"),
    "links": ("<article><ul><li><a href=1>one</a><li><a href=2>two</a></ul></article>", "one two"),
    "spaces": ("<article><h1> A \n\t B </h1><pre>c\n  d</pre>e<br>f</article>", "A B c d e f"),
    "text": ("just text, no tags at all.", "just text, no tags at all."),
    "open comment": (f"<article><p>{LONG}</p><!-- <p>no</p> and no end", LONG),
    "no end": ("<article>" + "<a x " * 40_000, ""),
    "slashes": (f"<article><p>{LONG}</p>" + "<svg/>" * 40_000 + "<p>end</p><iframe src=x />tail</article>", f"{LONG} end tail"),
    "angle": ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    found = main_text.nodes(page, {})
    take = main_text.chosen(np.zeros(len(found), int), found)
    assert " ".join(x[7] for x, t in zip(found, take, strict=True) if t) == want


def test_main_text_of_tables(spark):
    rows = [(None, None, None, 1), (1, "u", "", 1), (1, "u", "", 1), (2, "u", " \n", 1), *((10 + k, "u", p, 1) for k, (p, _) in enumerate(PAGES.values()))]
    rows += [(50, "u", "<div>" * 30_000 + LONG, 1), (51, "u", "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in main_text.main_text(df).collect()), key=repr)
    texts = [*((r[0], "") for r in rows[:4]), *((10 + k, w) for k, (_, w) in enumerate(PAGES.values())), (50, LONG), (51, " ".join([LONG] * 5000))]
    assert got == sorted(((i, t, len(t)) for i, t in texts), key=repr)  # pages don't touch each other's choice
    assert main_text.main_text(df.limit(0)).collect() == []


# ---- source divergence ----


def divergence_by_hand(rows, k=200, least=3):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))) for text, lang, source in rows]
    seen, n = collections.Counter(), collections.Counter()
    for lang, source, words in terms:
        seen.update((lang, w) for w in set(words))
        n.update((lang, source, w) for w in words)
    groups = {(lang, source) for lang, source, _ in terms}
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), c in seen.items() if x == lang and c >= least]
        sources = [s for x, s in groups if x == lang]
        count = {s: {w: n[lang, s, w] for w in kept} for s in sources}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        p, q = {s: share(count[s]) for s in sources}, share({w: sum(count[s][w] for s in sources) for w in kept})
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            term = [(f(p[s][w], q[w]), w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pair, None), ("term", term, k)):
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


def divergence_rows():
    rng = np.random.default_rng(3)
    vocabulary = ["été", "Ärger", "z", "😀x", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(26)), "y" * 3000, "y" * 3000 + "a", "y" * 2999]
    rows = [(None, None, None), ("", "en", "a"), ("1 2 3", "xx", "a"), ("once only", "xx", None), ("a\x00b A_b É", "en", "")]
    for k in range(300):
        words = rng.choice(vocabulary, rng.integers(0, 40))
        rows.append((" ".join(words), ["en", "de"][k % 2], None if k % 7 == 0 else f"s{min(k % 5, 3)}"))
    rows += [(" ".join(f"tie{'x' * (k % 9)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(520)), "en", "t")] * 3
    return rows


@pytest.mark.parametrize(("k", "direct"), [(200, 64), (200, 0), (7, 4096)])
def test_divergence(spark, k, direct):
    rows = divergence_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, part string").repartition(5)
    got = divergence.source_divergence(df, k=k, direct=direct)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence_by_hand(rows, k)
    assert direct or divergence.source_divergence(df.limit(0)).collect() == []


def test_terms_are_the_pattern_s():
    import pyarrow as pa

    texts = [None, "", "a", "A1b", "é ß\x7f_x", "😀- z", " end"]
    terms, row = divergence.terms_of(pa.array(texts))
    want = [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))]
    assert list(zip(row.tolist(), terms.to_pylist(), strict=True)) == want


# ---- centroids ----


def clusters_by_hand(rows, k, rounds, width):
    rows = [(i, v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * x) if abs(x) < 2**500 else 0 for x in v]) for i, v in rows]
    order = sorted(range(len(rows)), key=lambda r: (hashlib.sha256(f"2:{'null' if rows[r][0] is None else rows[r][0]}".encode()).hexdigest(), rows[r][1]))
    centres = [whole[r][1] for r in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in whole]
        own = [[x for (_, x), a in zip(whole, at, strict=True) if a == j] for j in range(len(centres))]
        centres = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else centres[j] for j, m in enumerate(own)]
    found = [(i, *near(x)) for i, x in whole]
    most = 2**63 - 1
    inertia = collections.Counter()
    for _, d, j in found:
        inertia[j] += min(d, most)
    total = min(most, sum(inertia.values()))
    return sorted(((i, j, min(d, most), min(most, inertia[j]), total, hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


def vectors(large):
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.normal(0, 1 + i % 3, 12).tolist()) for i in range(200)]
    rows += [(None, [0.5] * 12), (None, [0.25] * 12), (3, [1.0] * 12), (3, [1.0] * 12), (300, None), (301, []), (302, [1.0] * 11), (303, [float("nan")] + [0.0] * 11), (304, [None] + [0.0] * 11), (305, [float("-inf")] + [0.0] * 11), (306, [1.0] * 13)]
    return rows + [(400, [3e7, -2e9, *[0.1] * 10]), (401, [1e20, *[0.0] * 11])] * large


@pytest.mark.parametrize("large", [0, 1])
@pytest.mark.parametrize(("k", "rounds"), [(7, 5), (1, 1), (500, 2)])
def test_clusters(spark, k, rounds, large):
    rows = vectors(large)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, x string").repartition(4)
    got = centroids.cluster(df, k, rounds, 12, block=5)
    assert sorted(map(tuple, got.collect()), key=repr) == clusters_by_hand(rows, k, rounds, 12)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert centroids.cluster(df, 3, 2, 4).collect() == []
    assert centroids.cluster(df.limit(0), 3, 2, 1).collect() == []


def test_screening_saves_distances():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-40, 40, (500, 64)) + np.roll(np.repeat([900, 0], [8, 56]), 8 * k) for k in range(8)])
    c = x[::100]
    found, far, needed = centroids.nearest(x, centroids.block_norms(x, 8), c, 8)
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (found == every.argmin(1)).all() and (far == every.min(1)).all() and needed < 0.3 * every.size


# ---- words that are built to collide ----


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [8, 32, 64, 512, 1024, 2048, 4096])
def test_words_built_to_collide(spark, n):
    import pyarrow as pa

    from cadenza.llm import common, near_dedup, substring_dedup

    a, b = thue_morse(n)
    assert common.hashed_words(pa.array([a, b]))[0].tolist()[0] != common.hashed_words(pa.array([a, b]))[0].tolist()[1]
    rest = [f"w{k}" for k in range(24)]
    docs = spark.createDataFrame([(1, " ".join([*rest[:12], a, *rest[12:]])), (2, " ".join([*rest[:12], b, *rest[12:]]))], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.without_repeats(docs).collect()] == [0, 0]
    if n in (64, 1024):
        assert [r["n_links"] for r in near_dedup.near_duplicates(docs).collect()] == [0, 0]


def test_runs_of_words_built_to_collide():
    from cadenza.llm import common

    x = np.array([[3, 5][c == "b"] for c in thue_morse(64)[0]], np.uint64)
    values = np.concatenate([x, 8 - x, x])
    for key in common.run_hashes(values, np.array([0, 64, 128]), np.array([64, 128, 192])):
        assert key[0] == key[2] != key[1]


def test_components_and_buckets_give_the_same_links(spark):
    from cadenza.llm import near_dedup

    rng = np.random.default_rng(2)
    base = [rng.integers(0, 10**6, 60).tolist() for _ in range(6)]
    rows = []
    for k in range(240):
        words = list(base[k % 6])
        for at in rng.integers(0, 60, k % 4):
            words[at] = int(rng.integers(0, 10**6))
        rows.append((k, " ".join(map(str, words))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for recall in (0.5, 0.999):
        found = [sorted(map(tuple, near_dedup.near_duplicates(docs, recall=recall, chunk=16, whole=whole).select("doc_id", "class_id", "n_links").collect())) for whole in (10_000, 1)]
        assert found[0] == found[1]


def test_references_are_decoded_once(spark):
    from cadenza.llm import url_filter
    from pyspark.sql import functions as F

    texts = {"a&#38;lt;b": "a&lt;b", "&amp;quot;": "&quot;", "&amp;#38;": "&#38;", "x&#x41;&lt;&gt;&bad;&#xD800;": "xA<>&bad;�", "plain": "plain", "&#38;&#38;amp;": "&&amp;"}
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    assert dict(map(tuple, df.select("t", url_filter._decoded(F.col("t"))).collect())) == texts


def test_whole_search_is_reachable(spark):
    from cadenza.llm import packing

    pieces = spark.createDataFrame([(k, n) for k, n in enumerate([6, 5, 5, 4, 3, 3, 2, 2])], "row long, length long")
    packed = packing.pack(pieces, 10, nodes_per_piece=None).groupBy("sequence_id").sum("length").collect()
    assert sorted(r[1] for r in packed) == [10, 10, 10]


def test_rows_without_an_id_meet_different_shards(spark):
    from cadenza.llm import mixing

    rows = [(None, f"text {k} " * 20, "s") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted(tuple(r) for r in mixing.mix(df.repartition(n), shard_size=256).select("size", "taken").collect()) for n in (2, 5))
    assert first == again and abs(sum(r[1] for r in first) - 8000) <= 256
