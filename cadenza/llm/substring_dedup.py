"""Removal of repeated passages with a compressed FM-index per shard.

Every window of `width` words is routed by its minimizer, the least hash of the word m-grams in it:
equal windows have equal minimizers, and neighbouring windows mostly share one and travel together as a
segment. A first grouping, over narrow rows, finds the minimizers that two documents have. Where all
segments under such a minimizer are the same words, the least document decides all their windows at
once; that is the inside of copies and passages. Only the other segments, those at the edges, have to be
compared: their words are fetched, equal ones are merged with the least document of each, and they are
dealt to shards by their minimizers.

A shard is indexed by an FM-index: the Burrows-Wheeler transform over word numbers in a wavelet matrix
of packed bits with block counts, and document numbers at sampled places alone. The shard's segments are
streamed through it: backward search from every word gives its matching statistic, the length of the
longest stretch up to that word, at most `width`, that stands in the shard elsewhere too, with the
interval of its suffixes. Where that reaches `width`, the interval is reported, and the least document
in it is the first that has the window. An occurrence in any later document is removed.

Shards are dealt by hash, and a shard with more than `shard_segments` distinct segments is not indexed:
its windows are compared one by one, by 128-bit keys, in groupings with partial minima. So no task holds
more than that many segments, however many documents share a line.

In the index words are compared as such, equal segments by 128-bit digests of their words. That all
segments under one minimizer are the same is read from two 64-bit hashes of their words and places (words of
more than 32 bytes by BLAKE2).

Edge cases: null texts have no words; rows with a null id are neither judged nor count as earlier
documents; rows that repeat an id are one document to each other, so they never remove each other's
words, and each is judged by its own text; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import batches_of, hashed_words, mixed, run_hashes, slices_of, stage, stretches, text_bytes, windows, word_edges


class WaveletMatrix:
    """A sequence of numbers below 2 ** levels; counts of a number in a prefix, and the number at a
    place, for arrays at once."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.n = levels, len(values)
        self.words, self.counts, self.zeros = [], [], []
        v = values
        for k in range(levels - 1, -1, -1):
            one = ((v >> k) & 1).astype(bool)
            word, count = packed_bits(one)
            self.words.append(word)
            self.counts.append(count)
            self.zeros.append(int(self.n - one.sum()))
            v = np.concatenate([v[~one], v[one]])

    def reach(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a prefix end comes to on the value's way down; differences of it are counts."""
        for level in range(self.levels):
            ones = ones_before(self.words[level], self.counts[level], at)
            at = np.where((value >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, at - ones)
        return at

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at places, and where the places come to on the numbers' way down."""
        value = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            bit = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = ones_before(self.words[level], self.counts[level], at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            value = value << 1 | bit
        return value, at


def packed_bits(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags as 64-bit words, and the number of set ones before each word."""
    packed = np.zeros(((len(flags) >> 6) + 1) * 8, np.uint8)
    raw = np.packbits(flags, bitorder="little")
    packed[: len(raw)] = raw
    word = packed.view(np.uint64)
    return word, np.concatenate([[0], np.cumsum(np.bitwise_count(word), dtype=np.int64)[:-1]]).astype(np.int32)


def ones_before(word: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    block, low = at >> 6, (at & 63).astype(np.uint64)
    return count[block].astype(np.int64) + np.bitwise_count(word[block] & ((np.uint64(1) << low) - np.uint64(1)))


class FMIndex:
    """Over sequences of numbers from 1 to `top`, given one after the other with their lengths.

    A suffix ends with its sequence; equal suffixes stand in the order of their sequences. What is
    kept: the wavelet matrix of the transform, the counts of numbers, and for one place in `sample` of
    each sequence the number of the sequence."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray, top: int, sample: int = 8):
        begin = np.cumsum(lengths + 1) - (lengths + 1)
        text = np.zeros(int((lengths + 1).sum()), np.int64)
        text[stretches(begin, lengths)] = values
        left = np.repeat(begin + lengths, lengths + 1) - np.arange(len(text))  # numbers up to the end
        rank, span = text, 1
        while span < int(lengths.max(initial=0)) + 1:
            further = np.zeros_like(rank)
            further[:-span] = np.where(left[:-span] >= span, rank[span:] + 1, 0)
            rank, span = np.unique(rank * (int(rank.max()) + 2) + further, return_inverse=True)[1], span * 2
        suffixes = np.argsort(rank, kind="stable")
        levels = max(1, int(top).bit_length())
        self.tree = WaveletMatrix(text[suffixes - 1], levels)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))]).astype(np.int64)
        self.base = self.tree.reach(np.arange(top + 1), np.zeros(top + 1, np.int64))
        place = np.arange(len(text)) - np.repeat(begin, lengths + 1)
        chosen = (place % sample == 0)[suffixes]
        self.sampled = packed_bits(chosen)
        self.sequence = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)[suffixes[chosen]]

    def sequences_at(self, rows: np.ndarray) -> np.ndarray:
        """The sequences that suffixes belong to: one step to the left at a time, up to a sampled place."""
        out, open_, at = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows
        word, count = self.sampled
        while len(open_):
            found = (word[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            out[open_[found]] = self.sequence[ones_before(word, count, at[found])]
            open_, at = open_[~found], at[~found]
            value, down = self.tree.read(at)
            at = self.first[value] + down - self.base[value]
        return out

    def matching_statistics(self, values: np.ndarray, place: np.ndarray, cap: int, times: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every number of streamed sequences (place: how many of its sequence stand before it), the
        length up to `cap` of the longest stretch that ends with it and stands in the index at least
        `times` times, and the interval of that stretch's suffixes."""
        length = np.zeros(len(values), np.int64)
        low, high = np.zeros(len(values), np.int64), np.full(len(values), self.tree.n, np.int64)
        alive = np.arange(len(values))
        for k in range(cap):
            alive = alive[place[alive] >= k]
            c = values[alive - k]
            a = self.first[c] + self.tree.reach(c, low[alive]) - self.base[c]
            b = self.first[c] + self.tree.reach(c, high[alive]) - self.base[c]
            enough = b - a >= times
            alive = alive[enough]
            low[alive], high[alive], length[alive] = a[enough], b[enough], k + 1
        return length, low, high


def first_documents(values: np.ndarray, lengths: np.ndarray, documents: np.ndarray, width: int, step: int = 1 << 18) -> np.ndarray:
    """For every window of the sequences in order, the least document that has it. values: numbers from
    1, of all sequences one after the other."""
    index = FMIndex(values, lengths, int(values.max(initial=0)))
    n = np.maximum(lengths - width + 1, 0)
    begin = np.cumsum(lengths) - lengths
    ends = stretches(begin + width - 1, n)
    least = np.repeat(documents, n)
    for a in range(0, len(lengths), 4096):
        b = min(a + 4096, len(lengths))
        streamed = values[begin[a] : begin[b - 1] + lengths[b - 1]]
        length, low, high = index.matching_statistics(streamed, stretches(np.zeros(b - a, np.int64), lengths[a:b]), width)
        at = np.cumsum(n)[a] - n[a] + np.arange(int(n[a:b].sum()))
        here = ends[at] - begin[a]
        hit = length[here] == width
        if not hit.any():
            continue
        lows, back = np.unique(low[here[hit]], return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[back] = high[here[hit]]
        found = np.full(len(lows), np.iinfo(np.int64).max)
        # intervals of any size, so many suffixes at a time
        total = np.append(0, np.cumsum(highs - lows))
        for k in range(0, int(total[-1]), step):
            some = np.arange(k, min(k + step, int(total[-1])))
            owner = np.searchsorted(total, some, side="right") - 1
            np.minimum.at(found, owner, documents[index.sequences_at(lows[owner] + some - total[owner])])
        least[at[hit]] = found[back]
    return least


def _segments(words: np.ndarray, at: np.ndarray, width: int, gram: int, longest: int = 64) -> tuple[np.ndarray, ...]:
    """Of all texts of a batch: minimizer, text, first word in the text, windows of each segment."""
    n = len(words) - width + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty
    g = mixed(windows(words, gram))
    least, have, want = g, 1, width - gram + 1
    while have < want:
        step = min(have, want - have)
        least, have = np.minimum(least[: len(least) - step], least[step:]), have + step
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = text[:n] == text[width - 1 :]
    place = np.flatnonzero(inside)
    if not len(place):
        return empty, empty, empty, empty
    m, t, offset = least[place], text[place], place - at[text[place]]
    new = np.ones(len(place), bool)
    new[1:] = (m[1:] != m[:-1]) | (t[1:] != t[:-1])
    begin = np.flatnonzero(new)
    run = np.arange(len(place)) - np.repeat(begin, np.diff(np.append(begin, len(place))))
    begin = np.flatnonzero(run % longest == 0)
    return m[begin].view(np.int64), t[begin], offset[begin], np.diff(np.append(begin, len(place)))


def _numbered(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of segments as numbers from 1, one after the other, and each segment's count."""
    whole = b" ".join(segments)
    data = np.frombuffer(whole, np.uint8)
    begin, end = word_edges(data, np.array([0, len(data)]))
    kept = data != 0x20
    offsets = np.append(0, np.cumsum(end - begin))
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])
    lengths = np.fromiter((s.count(b" ") + 1 for s in segments), np.int64, len(segments))
    return words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1, lengths


def _first_documents_by_window(segments: DataFrame, width: int) -> DataFrame:
    """What first_documents finds, for segments of which any number share a minimizer: k1, k2, least."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(2048, batches):
            texts = [w.split(b" ") for w in batch.column(3).to_pylist()]
            n = np.array([len(w) - width + 1 for w in texts])
            keys = [hashlib.blake2b(b" ".join(w[i : i + width]), digest_size=16).digest() for w, k in zip(texts, n.tolist(), strict=True) for i in range(k)]
            w = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            row = pa.array(np.repeat(np.arange(len(n)), n))
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), *(batch.column(k).take(row) for k in range(3)), pa.array(place.astype(np.int32))], ["w1", "w2", "k1", "k2", "doc_id", "place"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.array(x, np.int64).tobytes() for x in batch.column(2).to_pylist()], pa.binary())], ["k1", "k2", "least"])

    # written once, for it is read twice
    each = stage(segments.select("k1", "k2", "doc_id", "words").mapInArrow(cut, "w1 long, w2 long, k1 long, k2 long, doc_id long, place int"))
    firsts = each.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"))
    lists = each.drop("doc_id").join(firsts, ["w1", "w2"]).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("place", "least"))).alias("_l"))
    return lists.select("k1", "k2", F.col("_l.least").alias("least")).mapInArrow(joined, "k1 long, k2 long, least binary")


def _shared_segments(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """doc_id, text_key, start, n, alike, of the segments whose minimizer two documents have: those to
    compare, and of those that are all alike the ones in a later document than the first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(1, batches, 2 << 20):
            words, at = hashed_words(batch.column(1))
            m, t, start, n = _segments(words, at, width, gram)
            begin = at[t] + start
            keys = run_hashes(words, begin, begin + n + width - 1)
            row = pa.array(t)
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), batch.column(0).take(row), batch.column(2).take(row), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), *(pa.array(key.view(np.int64)) for key in keys)], ["minimizer", "doc_id", "text_key", "start", "n", "a", "b"])

    segments = rows.mapInArrow(cut, "minimizer long, doc_id long, text_key long, start int, n int, a long, b long")
    per_minimizer = segments.groupBy("minimizer").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last"), *(f(c).alias(f"_{c}{f.__name__}") for c in ("a", "b") for f in (F.min, F.max)))
    shared = per_minimizer.where("first < _last").select("minimizer", "first", F.expr("_amin = _amax AND _bmin = _bmax").alias("alike"))
    return segments.drop("a", "b").join(shared, "minimizer").where("NOT alike OR doc_id > first").select("doc_id", "text_key", "start", "n", "alike")


def removed_words(docs: DataFrame, width: int = 13, gram: int = 4, shard_segments: int = 80_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), spans: the windows to remove, as (first word, windows in
    a row), of the documents that have any."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_key")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    shared = stage(_shared_segments(rows, width, gram))
    compared = shared.where("NOT alike").groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(F.collect_set("start").alias("starts"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(1, batches, 2 << 20):
            words, at = hashed_words(batch.column(1))
            m, t, start, n = _segments(words, at, width, gram)
            lists = batch.column(3)
            wanted = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()) << 40 | lists.flatten().to_numpy().astype(np.int64)
            keep = np.isin(t << 40 | start, wanted)
            m, t, start, n = m[keep], t[keep], start[keep], n[keep]
            data, text_at = text_bytes(batch.column(1))
            begin, end = word_edges(data, text_at)
            a = at[t] + start
            raw = data.tobytes()
            pieces = [b" ".join(raw[x:y].split()) for x, y in zip(begin[a].tolist(), end[a + n + width - 2].tolist(), strict=True)]
            keys = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in pieces), np.int64).reshape(-1, 2)
            row = pa.array(t)
            # what decides the shard: equal windows have equal minimizers, and so equal leading bits of them
            slot = (m.view(np.uint64) >> np.uint64(33)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(keys[:, 0]), pa.array(keys[:, 1]), batch.column(0).take(row), batch.column(2).take(row), pa.array(start.astype(np.int32)), pa.array(pieces, pa.binary())], ["slot", "k1", "k2", "doc_id", "text_key", "start", "words"])

    given = rows.join(compared, (F.col("doc_id") == F.col("_doc")) & (F.col("text_key") == F.col("_key"))).select("doc_id", "text", "text_key", "starts")
    filled = stage(given.mapInArrow(fill, "slot int, k1 long, k2 long, doc_id long, text_key long, start int, words binary"))
    distinct = stage(filled.groupBy("slot", "k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("words").alias("words")))
    # half full on average
    n_shards = 1 + 2 * distinct.count() // shard_segments
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("slot"), F.lit(n_shards)))
    crowded = stage(dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > shard_segments).select("shard"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        values, lengths = _numbered(group["words"].tolist())
        least = first_documents(values, lengths, group["doc_id"].to_numpy(np.int64), width)
        n = lengths - width + 1
        return pd.DataFrame({"k1": group["k1"], "k2": group["k2"], "least": [x.tobytes() for x in np.split(least, np.cumsum(n)[:-1])]})

    found = dealt.join(crowded, "shard", "left_anti").groupBy("shard").applyInPandas(search, "k1 long, k2 long, least binary")
    if not crowded.isEmpty():
        found = found.unionByName(_first_documents_by_window(dealt.join(crowded, "shard", "left_semi"), width))
    found = stage(found)
    hits = filled.drop("words", "slot").join(found, ["k1", "k2"])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(4096, batches):
            doc, start = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            least = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            n = np.array([len(x) for x in least], np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            at = np.flatnonzero(np.concatenate([np.zeros(0, np.int64), *least]) < np.repeat(doc, n))
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (np.diff(owner[at]) != 0)
            cut = np.flatnonzero(new)
            first, row = at[cut], pa.array(owner[at[cut]])
            offset = first - (np.cumsum(n) - n)[owner[first]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array((start[owner[first]] + offset).astype(np.int32)), pa.array(np.diff(np.append(cut, len(at))).astype(np.int32))], ["doc_id", "text_key", "first", "n"])

    at_edges = hits.select("doc_id", "text_key", "start", "least").mapInArrow(report, "doc_id long, text_key long, first int, n int")
    spans = shared.where("alike").select("doc_id", "text_key", F.col("start").alias("first"), "n").unionByName(at_edges)
    return spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "n")).alias("spans"))


def without_repeats(docs: DataFrame, width: int = 13, gram: int = 4, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text", shard_segments: int = 80_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by
    single spaces, and that text as kept_text if asked for."""
    spans = removed_words(docs, width, gram, shard_segments, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = spans.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    joined = rows.join(spans, (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_key")), "left").select("doc_id", "text", F.col("spans.first").alias("_first"), F.col("spans.n").alias("_n"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(1, batches):
            out: list[tuple] = []
            for text, first, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words = (text or "").encode().split()
                kept = words
                if first:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, np.array(first), 1)
                    np.add.at(gone, np.array(first) + np.array(n) + width - 1, -1)
                    kept = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
                whole = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), *([whole.decode()] if with_text else [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=False))], ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return joined.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
