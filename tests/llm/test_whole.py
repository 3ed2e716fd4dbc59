"""Cases in which an operator once did less than its whole job."""

import collections
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import line_rules, mixing, near_dedup, oracle, packing, repair, sharding, substring_dedup, url_filter


def test_copies_count_as_documents_if_asked(spark):
    page = "Read the terms\n" + " ".join(f"c{i}" for i in range(60))
    data = [(k, page, "h") for k in range(30)] + [(100 + k, " ".join(f"v{k}x{i}" for i in range(60)), "h") for k in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    removed = lambda **how: {r["doc_id"]: (r["removed_words"], r["kept"]) for r in line_rules.line_frequency_rules(df, limit_docs=10, limit_share=0.1, **how).collect()}
    got = removed(count_copies=True)
    assert all(got[k] == (63, False) for k in range(30)) and all(got[100 + k] == (0, True) for k in range(20))
    assert set(removed().values()) == {(0, True)}
    assert {r["n_docs"] for r in line_rules.frequent_lines(df, 10, 0.1, count_copies=True).collect()} == {30}


def test_texts_without_frequent_lines(spark):
    data = [(k, f"first w{k}\n\nBuy  NOW\nlast w{k}", "h", k) for k in range(12)] + [(20, "buy now", "h", 1), (21, "Buy now\nhere", None, 2), (22, None, "h", 3), (22, "a\n\nb ", "h", 4)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, line int").repartition(3)
    out = line_rules.without_frequent_lines(df, limit_docs=10, limit_share=0.1)
    want = [(k, f"first w{k}\n\nlast w{k}", "h", k) for k in range(12)] + [(20, "", "h", 1), (21, "Buy now\nhere", None, 2), (22, None, "h", 3), (22, "a\n\nb ", "h", 4)]
    assert out.columns == df.columns and sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert line_rules.without_frequent_lines(df.limit(0)).count() == 0


def test_no_shard_holds_a_hot_minimizer(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefg"), 5))
    line = [word() for _ in range(14)]
    texts = [[*(word() for _ in range(9)), *line, *(word() for _ in range(9))] for _ in range(60)]
    texts += [[*t[:20], word(), *t[20:]] for t in texts[:10]]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    seen: dict = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - 12):
            seen.setdefault(tuple(t[i : i + 13]), d)
    index = substring_dedup.first_documents

    def bounded(values, lengths, documents, width):
        if len(lengths) > 20:
            raise ValueError(f"{len(lengths)} segments in a shard")
        return index(values, lengths, documents, width)

    monkeypatch.setattr(substring_dedup, "first_documents", bounded)
    got = {r["doc_id"]: r["kept_text"] for r in substring_dedup.without_repeats(df, shard_segments=20).collect()}
    for d, t in enumerate(texts):
        gone = {i + k for i in range(len(t) - 12) if seen[tuple(t[i : i + 13])] < d for k in range(13)}
        assert got[d] == " ".join(x for i, x in enumerate(t) if i not in gone)


def test_added_tokens_are_encoded_as_loaded(spark):
    texts = ["a <|endoftext|> b", "<|startoftext|>a b<|endoftext|>", "x<|ENDOFTEXT|> y  <|endoftext|>\n\nz", "<|endoftext|", "plain a b", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    ids_of = lambda name: [np.array([*Tokenizer.from_file(public_tokenizers.path(name)).encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    want = ids_of("word_bpe_49k.json")
    starts = np.cumsum([0, *map(len, want)])[:-1].tolist()
    got = repair.read_shards(repair.write_shards(df, public_tokenizers.path("word_bpe_49k.json"))).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == [(k, a, len(x), zlib.crc32(x.tobytes())) for k, (a, x) in enumerate(zip(starts, want, strict=True))]
    got = packing.packed_documents(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in got) == [(k, len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(ids_of("byte_bpe_50k.json"))]


def _pages_with_aliases(spark):
    """The test pages, every third with a canonical or refresh tag to another page or to an address that
    no page has."""
    rows = sorted(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect())
    urls = [r["url"] for r in rows]
    out = []
    for k, r in enumerate(rows):
        to = urls[(7 * k + 3) % len(urls)] if k % 2 else "http://www.Example.org/es/1"
        tag = [f'<link rel="canonical" href="{to}">', f"<META content='0; url={to}' http-equiv=refresh>", f"<link rel=alternate href={to}>", '<link href="/en/7?a=1&amp;b=2" rel="x canonical">'][k // 3 % 4]
        out.append((r["page_id"], r["url"], (r["html"] or "") + (tag if k % 3 == 0 else "")))
    return [*out, (10_000, None, out[0][2]), (10_001, "no address", out[3][2]), (10_002, urls[0], None)]


def test_url_aliases_match_sql(spark):
    rows = _pages_with_aliases(spark)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": [r[2] for r in rows]}))
    want = con.sql(oracle.ORACLE["op8_url_filter"]).fetchall()
    got = url_filter.url_verdicts(df)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    plain = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(df.withColumn("html", F.lit(""))).collect()}
    assert sum(plain[r[0]] != r[4] for r in want) > 5  # aliases decide some


def test_url_rules_give_the_contracts_verdicts(spark):
    want = {
        "http://a.com/en/x": ("com/en/", "block"), "http://a.example.com/en/71": ("example.com/en/7", "allow"), "http://a.net/de/1": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://b.example.net/de/81": ("example.net/de/8", "block"), "http://a.org/es/": ("org/es/", "block"),
    }
    df = spark.createDataFrame([(k, u, "") for k, u in enumerate(want)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_verdicts(df).collect()}
    assert got == dict(enumerate(want.values()))


def test_link_targets_are_resolved(spark):
    base = "http://a.org/x/y/z.html?q=1"
    want = {"../b": "http://a.org/x/b", "./b#f": "http://a.org/x/y/b", "../../../b/": "http://a.org/b/", "/p/./q/../r": "http://a.org/p/r", "..": "http://a.org/x/", "?s=&#38;&#x41;": "http://a.org/x/y/z.html?s=&A", "/c?a=1&amp;b=2": "http://a.org/c?a=1&b=2", "HTTP://B.org/./d": "http://b.org/d", "mailto:x@y": None, "#top": None, "b...c/..d": "http://a.org/x/y/b...c/..d", "&#0;": "http://a.org/x/y/\ufffd"}
    df = spark.createDataFrame([(base, f'<link rel=canonical href="{t}">') for t in want], "url string, html string")
    assert sorted(r["dst"] for r in url_filter.markup_edges(df).collect()) == sorted(x for x in want.values() if x)


def test_very_long_addresses(spark):
    rows = [(0, "http://" + "a." * 200_000 + "com/en/1", ""), (1, "http://example.com/en/" + "../" * 3000 + "7", '<link rel=canonical href="' + "x/../" * 3000 + '">'), (2, "http://b.net/" + "d" * 1_000_000, None)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "block", 1: "block", 2: "allow"}


def _links(texts):
    """Linked others and group by brute force, on the n-gram sets themselves."""
    sets = []
    for t in texts:
        w = (t or "").translate({k: k + 32 for k in range(65, 91)}).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    of = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            of[g].append(k)
    links = []
    for k, s in enumerate(sets):
        common = collections.Counter(j for g in s for j in of[g] if j != k)
        links.append({j for j, n in common.items() if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9})
    return links


@pytest.mark.parametrize("whole", [8192, 3])
def test_near_duplicates_of_a_whole_table(spark, whole):
    """All links of the table, whether components are compared whole or by the bands' buckets."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    data = df.select("doc_id", "text").collect()
    links = _links([r["text"] for r in data])
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(df, chunk=4, whole=whole).collect()}
    found = sum(got[r["doc_id"]]["n_links"] for r in data)
    assert all(got[r["doc_id"]]["n_links"] <= len(x) for r, x in zip(data, links, strict=True)) and found >= 0.99 * sum(map(len, links)) > 100
    if found == sum(map(len, links)):
        group = {}
        for k in range(len(data)):
            stack = [k]
            while stack:
                j = stack.pop()
                if j not in group:
                    group[j] = k
                    stack += links[j]
        least = {}
        for k, r in enumerate(data):
            least[group[k]] = min(least.get(group[k], r["doc_id"]), r["doc_id"])
        assert all(got[r["doc_id"]]["class_id"] == least[group[k]] for k, r in enumerate(data))


def test_mixed_rows_follow_the_plan(spark):
    """Rows that repeat id and text, of one source and of two, each take a plan of their own."""
    text = " ".join(f"w{k}" for k in range(7))
    data = [(k // 3, text, ["s0", "s1", None][k % 2 if k < 20 else 2], k % 4, True) for k in range(30)] + [(50, " ".join(f"v{k}" for k in range(90)), "s1", 0, None), (51, "", "s0", 1, True), (52, None, "s1", 1, True)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long, _words boolean").repartition(3)
    plan = mixing.mix(df, block=2, least_blocks=50).collect()
    out = mixing.mixed_documents(df, block=2, least_blocks=50)
    assert out.columns == df.columns
    want, got = collections.Counter(), collections.Counter()
    for r in plan:
        want[r["doc_id"], r["source"]] += r["taken"]
    for r in out.collect():
        got[r["doc_id"], r["source"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert +want == +got


def test_sharding_of_equal_rows(spark):
    """Rows that no bit tells apart are numbered into parts below depth 64."""
    data = [(1, "x" * 700)] * 9 + [(2, "y" * 3000), (3, None), (4, "z" * 100)]
    got = sharding.extendible_shards(spark.createDataFrame(data, "doc_id long, text string"), 2000).collect()
    deep = collections.Counter(r["shard"] for r in got if r["doc_id"] == 1)
    assert sorted(deep.values()) == [1, 2, 2, 2, 2] and {r["part"] for r in got if r["doc_id"] == 1} == set(range(5)) and all(r["depth"] == 64 and r["shard_bytes"] <= 2000 for r in got if r["doc_id"] == 1)
    assert [r["oversized"] for r in got if r["doc_id"] == 2] == [True] and len(got) == len(data)


def test_frequent_lines_match_sql(spark):
    """The SQL of the query over hosts with repeated lines, so that its line part decides something."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()
    lines = [f"  All RIGHTS {i} reserved{i} by{i} \t the{i} owner{i} of{i} this{i} page{i}" for i in range(9)]
    data = [(r["doc_id"], (r["text"] or "") + "\n" + lines[0] if k % 3 else "\n".join(lines) + "\n" + " ".join((r["text"] or "").split()[:60]), "h" if k % 2 else None) for k, r in enumerate(rows)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in data], "text": [r[1] for r in data], "source": [r[2] for r in data]}))
    want = con.sql(oracle.ORACLE["op3_quality_rules"])
    got = line_rules.line_frequency_rules(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4))
    a, b = sorted(tuple(r[c] for c in sorted(got.columns)) for r in got.collect()), sorted(tuple(r[want.columns.index(c)] for c in sorted(want.columns)) for r in want.fetchall())
    assert a == b
    removed, kept = sorted(got.columns).index("removed_words"), sorted(got.columns).index("kept")
    failed = sorted(got.columns).index("base_failed")
    assert sum(r[removed] > 0 for r in a) > 300 and sum(not r[kept] and not r[failed] for r in a) > 20
