"""How the sources of a language differ in their words: pairs of sources, and the terms that stand out.

Tasks count the terms of their documents (occurrences and documents by language, source and term), so the
shuffles carry counts, not words. A language keeps the terms of at least `least` of its documents; each of
its sources, and the language as a whole, gives every kept term a smoothed integer share p or q of
10^9, and f = floor((p - q)^2 / q).

Pairs sum f over all kept terms, but only terms that occur cost anything. Where neither source has the
term, f is one number of the pair, the baseline; where one has it, f follows from its count and the other's
baseline, so a histogram of counts is enough; terms that both have are corrected once. Terms with the same
counts in the same sources are one profile with a multiplicity before pairs of sources are made; a
profile has at most as many entries as its language has sources, and the result has a row for each pair of
those anyway.

The first `k` terms of a source come from a radix selection: a distributed histogram over 15 bits of the
values at a time finds the value of the k-th, so a source's threshold takes four passes and histograms of at
most 32,768 bins. Terms tied at it are refined by the UTF-8 bytes after their common prefix, two at a
time, until the bucket that holds the k-th has at most `direct` terms. So no task sorts the terms of a source.

Edge cases: null texts, languages and sources count as ''; texts without terms count for nothing but their
group, which gets its rows with shares of the smoothing alone; a language without kept terms gives its pairs
the value 0 and no term rows; repeated rows are documents of their own; an empty table gives an empty
table; other columns are ignored. Sums stay below 10^18 (shares add up to 10^9), counts are multiplied as
decimals.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import slices_of, stage, text_bytes

#: Bytes of terms: ASCII letters and everything beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
BITS, PASSES = 15, 4
UNIT = 1_000_000_000


def terms_of(column: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All terms of a text column in order, and the row of each."""
    data, at = text_bytes(column)
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.append(0, np.cumsum(end - begin)).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(_LOWERED[data[inside]]))
    return terms, np.searchsorted(at, begin, side="right") - 1


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to occurrences and documents of every (lang, source, term) of a slice."""
    for batch in slices_of(2, batches, 2 << 20):
        groups: dict[tuple[str, str], int] = {}
        of_row = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
        terms, row = terms_of(batch.column(2))
        coded = terms.dictionary_encode()
        code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
        found, n = np.unique(row * size + code, return_counts=True)
        key, place = np.unique(of_row[found // size] * size + found % size, return_inverse=True)
        names = [pa.array([g[k] for g in groups], pa.string()).take(pa.array(key // size)) for k in (0, 1)]
        docs = np.bincount(place, minlength=len(key))
        yield pa.RecordBatch.from_arrays([*names, coded.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(np.bincount(place, n, len(key)).astype(np.int64)), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms))."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.call_function("div", top, F.greatest(total + terms, F.lit(1)).cast("decimal(20,0)")) + 1


def far(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) for q >= 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def _words(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source) groups, and counts by group and term."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = named.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return named.select("lang", "source").distinct(), counts


def top_terms(scored: DataFrame, k: int = 200, direct: int = 64) -> DataFrame:
    """The k first rows of every (lang, source) by value, descending, then term in the order of UTF-8
    bytes, with their rank. scored: (lang, source, term, value), a row for each term, 0 <= value < 2^60."""
    group = ["lang", "source"]
    bound = None
    for step in reversed(range(PASSES)):
        digit = F.shiftright("value", step * BITS)
        rows = scored.withColumn("need", F.lit(k).cast("long")) if bound is None else scored.join(bound, group).where(F.shiftright("value", (step + 1) * BITS) == F.col("prefix"))
        bound = stage(_kth(rows.select(*group, "need", digit.alias("prefix")), F.col("prefix").desc()))
    held = scored.join(bound.withColumnRenamed("prefix", "least"), group, "left")
    done = [held.where(F.col("least").isNull() | (F.col("value") > F.col("least"))).select(*group, "term", "value")]
    ties = stage(held.where(F.col("value") == F.col("least")).select(*group, "term", "value", "need"))
    while True:
        about = ties.groupBy(group).agg(F.min("term").alias("a"), F.max("term").alias("b"), F.count(F.lit(1)).alias("n"), F.max("need").alias("m"))
        same = F.array_position(F.zip_with(F.split("a", ""), F.split("b", ""), lambda x, y: x.eqNullSafe(y)), False)
        common = F.octet_length(F.substring(F.col("a"), F.lit(1), F.when(same > 0, same - 1).otherwise(F.least(F.char_length("a"), F.char_length("b"))).cast("int")))
        large = stage(about.where((F.col("n") > F.col("m")) & (F.col("n") > direct) & (F.col("a") != F.col("b"))).select(*group, common.alias("skip")))
        done.append(ties.join(large, group, "left_anti").select(*group, "term", "value"))
        if large.isEmpty():
            break
        digit = F.hex(F.substring(F.encode("term", "UTF-8"), F.col("skip") + 1, F.lit(2)))
        rows = stage(ties.join(large, group).withColumn("digit", digit))
        cut = _kth(rows.select(*group, "need", F.col("digit").alias("prefix")), F.col("prefix").asc()).withColumnRenamed("need", "left")
        rows = rows.join(cut, group)
        done.append(rows.where(F.col("digit") < F.col("prefix")).select(*group, "term", "value"))
        ties = stage(rows.where(F.col("digit") == F.col("prefix")).select(*group, "term", "value", F.col("left").alias("need")))
    order = Window.partitionBy(group).orderBy(F.col("value").desc(), "term")
    return reduce(DataFrame.unionByName, done).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _kth(rows: DataFrame, order: Column) -> DataFrame:
    """(lang, source, prefix, need): the bin in which the need-th row of each group lies, bins in `order`,
    and how many of its rows are wanted. Groups with fewer rows give none."""
    group = ["lang", "source"]
    bins = rows.groupBy(*group, "prefix").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return bins.withColumn("need", F.col("need") - before).where((F.col("need") > 0) & (F.col("need") <= F.col("n"))).select(*group, "prefix", "need")


def _pairs(groups: DataFrame, words: DataFrame, held: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources of a language. groups: lang, source, total, terms,
    base; words: lang, held as an array of (source, n); held: the same by row."""
    one = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("ta"), F.col("base").alias("ba"), F.col("held").alias("ha"), "terms")
    two = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("tb"), F.col("base").alias("bb"), F.col("held").alias("hb"))
    pairs = one.join(two, "lang").where(F.col("a") != F.col("b"))
    blank = pairs.select("lang", "a", "b", ((F.col("terms") - F.col("ha") - F.col("hb")) * far(F.col("ba"), F.col("bb"))).alias("v"))
    # terms that one source has, by its counts
    single = held.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    p = share(F.col("n"), F.col("t"), F.col("terms"))
    mine = groups.select("lang", "source", F.col("total").alias("t"), "terms")
    single = single.join(mine, ["lang", "source"]).select("lang", "source", p.alias("p"), "m").groupBy("lang", "source", "p").agg(F.sum("m").alias("m"))
    other = groups.select("lang", F.col("source").alias("o"), F.col("base").alias("bo"))
    single = single.join(other, "lang").where(F.col("source") != F.col("o"))
    left = single.select("lang", F.col("source").alias("a"), F.col("o").alias("b"), (F.col("m") * far(F.col("p"), F.col("bo"))).alias("v"))
    right = single.select("lang", F.col("o").alias("a"), F.col("source").alias("b"), (F.col("m") * far(F.col("bo"), F.col("p"))).alias("v"))
    # terms that both have
    profile = words.groupBy("lang", "sources").agg(F.count(F.lit(1)).alias("m"))
    both = profile.select("lang", "m", "sources", F.explode("sources").alias("x")).select("lang", "m", "x", F.explode(F.filter("sources", lambda y: y["source"] > F.col("x")["source"])).alias("y"))
    both = both.groupBy("lang", F.col("x")["source"].alias("a"), F.col("x")["n"].alias("na"), F.col("y")["source"].alias("b"), F.col("y")["n"].alias("nb")).agg(F.sum("m").alias("m"))
    both = both.join(one, ["lang", "a"]).join(two, ["lang", "b"]).select("lang", "a", "b", "m", "ba", "bb", share(F.col("na"), F.col("ta"), F.col("terms")).alias("pa"), share(F.col("nb"), F.col("tb"), F.col("terms")).alias("pb"))

    def mended(pa: str, pb: str, ba: str, bb: str) -> Column:
        pa, pb, ba, bb = map(F.col, (pa, pb, ba, bb))
        return F.col("m") * (far(pa, pb) - far(pa, bb) - far(ba, pb) + far(ba, bb))

    both = both.select("lang", F.inline(F.array(F.struct("a", "b", mended("pa", "pb", "ba", "bb").alias("v")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), mended("pb", "pa", "bb", "ba").alias("v")))))
    return reduce(DataFrame.unionByName, (blank, left, right, both)).groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("v").alias("value"))


def source_divergence(docs: DataFrame, least: int = 3, k: int = 200, direct: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank."""
    group = ["lang", "source"]
    named, counts = _words(docs)
    words = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources")).where(F.col("docs") >= least)
    words = stage(words.drop("docs"))
    held = words.select("lang", "term", "all", F.inline("sources"))
    whole = words.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("whole"))
    own = held.groupBy(group).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    groups = named.join(own, group, "left").join(whole, "lang", "left").na.fill(0)
    groups = stage(groups.withColumn("base", share(F.lit(0), F.col("total"), F.col("terms"))))
    pairs = _pairs(groups, words, held)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col("value").desc(), "item")))
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("all"), F.col("whole"), F.col("terms"))
    scored = held.join(groups, group).select(*group, "term", p.alias("p"), q.alias("q")).where(F.col("p") > F.col("q"))
    scored = stage(scored.select(*group, "term", far(F.col("p"), F.col("q")).alias("value")))
    terms = top_terms(scored, k, direct).withColumnRenamed("term", "item")
    parts = [rows.select(*group, F.lit(part).alias("part"), "item", "value", "rank") for part, rows in (("pair", pairs), ("term", terms))]
    return parts[0].unionByName(parts[1])
