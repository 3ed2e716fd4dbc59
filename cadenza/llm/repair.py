"""Token ids in files compressed by Re-Pair grammars.

Documents stand in ascending order of their ids; each range partition writes shards of about
`shard_tokens` ids. A shard's frequent pairs of neighbouring symbols are replaced by nonterminals,
the most frequent first: a round counts all pairs and replaces those above a bar from left to right
without overlap, the bar falls by halves, until no pair is left that stands there often enough to pay
for its rule. The file holds the rules, the length of each rule's expansion
and the final string, so that any range of ids is decoded without the rest.

File of a shard, little-endian: the magic bytes RPR1; nine unsigned 64-bit numbers: first
nonterminal, rules, symbols, documents, ids, bytes a symbol, and three of 0; the rules' left and right
symbols; the expansion lengths (32 bits); the symbols; the documents' ids (64 bits), null flags
(a byte each) and first ids (64 bits). Shards are rows of a Parquet table in the shared folder, which
any store that Spark reads can hold.

Edge cases: null texts are empty and have the end id alone; null ids come first, repeated ids are
ordered by a hash of the text; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import batches_of, slices_of, stage, stretches
from cadenza.llm.tokens import encoder

MAGIC = b"RPR1"
#: Bits of the bins that pairs are counted in.
_BITS = 19


def grammar(ids: np.ndarray, first_rule: int, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The final string, and rules as rows (left, right); nonterminal first_rule + k is rule k.

    A round replaces every pair that stands there as often as the bar asks, at first half as often as
    the most frequent pair. What is left of such a pair is nothing, so only pairs with a new nonterminal
    can reach the bar in the next round; when none does, the bar falls by half, and all pairs are counted
    again. The end is reached when no pair stands there `least` times."""
    s, rules, top = ids.astype(np.uint32), [np.zeros((0, 2), np.int64)], first_rule
    bar, fresh = len(s), None
    while len(s) > 1:
        if fresh is None:
            code = s[:-1].astype(np.uint64) << np.uint64(32) | s[1:]
            place = (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int32)
            count = np.bincount(place, minlength=1 << _BITS)
            bar = max(least, min(bar, int(count.max()) // 2))
            # a bin below the bar holds no pair above it
            near = np.flatnonzero((count >= bar)[place])
            code = code[near]
        else:
            new = s >= fresh
            near = np.flatnonzero(new[:-1] | new[1:])
            code = s[near].astype(np.uint64) << np.uint64(32) | s[near + 1]
        ordered = np.sort(code)
        edges = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
        pair = ordered[edges[np.diff(np.append(edges, len(ordered))) >= bar]]
        if not len(pair):
            if bar == least:
                break
            bar, fresh = max(least, bar // 2), None
            continue
        which = np.minimum(np.searchsorted(pair, code), len(pair) - 1)
        hit = pair[which] == code
        hits, which = near[hit], which[hit]
        # of hits side by side, every second from the left
        begins = np.flatnonzero(np.diff(hits, prepend=-9) != 1)
        run = np.repeat(begins, np.diff(np.append(begins, len(hits))))
        hits, which = (x[(np.arange(len(x)) - run) % 2 == 0] for x in (hits, which))
        used = np.bincount(which, minlength=len(pair)) > 0
        s[hits] = top + (np.cumsum(used) - 1)[which]
        stays = np.ones(len(s), bool)
        stays[hits + 1] = False
        s, fresh, pair = s[stays], top, pair[used]
        rules.append(np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], 1).astype(np.int64))
        top += len(pair)
    return s.astype(np.int64), np.concatenate(rules)


def _by_depth(rules: np.ndarray, first_rule: int) -> list[np.ndarray]:
    """The rules' numbers, those first whose two sides are ids, then those that need only them, and so on."""
    depth = [0] * len(rules)
    for k, (a, b) in enumerate(rules.tolist()):
        depth[k] = 1 + max(depth[a - first_rule] if a >= first_rule else 0, depth[b - first_rule] if b >= first_rule else 0)
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(np.array(depth)[order])) + 1) if len(rules) else []


def lengths_of(rules: np.ndarray, first_rule: int) -> np.ndarray:
    out = np.ones(first_rule + len(rules), np.int64)
    for some in _by_depth(rules, first_rule):
        out[first_rule + some] = out[rules[some]].sum(1)
    return out[first_rule:]


def shard_bytes(doc_ids: list, counts: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    s, rules = grammar(ids, vocabulary)
    width = 2 if vocabulary + len(rules) < 1 << 16 else 4
    kind = f"<u{width}"
    starts = np.cumsum([0, *counts[:-1]], dtype=np.uint64)
    head = np.array([vocabulary, len(rules), len(s), len(doc_ids), len(ids), width, 0, 0, 0], "<u8")
    return b"".join([
        MAGIC, head.tobytes(), rules.astype(kind).tobytes(), lengths_of(rules, vocabulary).astype("<u4").tobytes(), s.astype(kind).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), starts.astype("<u8").tobytes(),
    ])


class Shard:
    """A shard read back."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.vocabulary, n_rules, n, n_docs, self.n_ids, width, *_ = np.frombuffer(data, "<u8", 9, 4).astype(np.int64).tolist()
        at = 4 + 72

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.rules = take(f"<u{width}", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.rule_lengths = take("<u4", n_rules).astype(np.int64)
        self.symbols = take(f"<u{width}", n).astype(np.int64)
        ids, null, starts = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.edges = np.append(starts.astype(np.int64), self.n_ids)
        # every rule written out once: two stretches of what is already there
        self.flat_at = np.concatenate([np.arange(self.vocabulary), self.vocabulary + np.cumsum(self.rule_lengths) - self.rule_lengths]).astype(np.int64)
        self.length = np.concatenate([np.ones(self.vocabulary, np.int64), self.rule_lengths])
        self.flat = np.arange(self.vocabulary + int(self.rule_lengths.sum()), dtype=np.int64)
        for some in _by_depth(self.rules, self.vocabulary):
            sides, to = self.rules[some].ravel(), np.repeat(self.flat_at[self.vocabulary + some], 2)
            to[1::2] += self.length[sides[::2]]
            self.flat[stretches(to, self.length[sides])] = self.flat[stretches(self.flat_at[sides], self.length[sides])]
        self.ends = np.cumsum(self.length[self.symbols])

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from start to stop, from the symbols that cover them alone."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(self.ends, [start, stop - 1], side="right")
        some = self.symbols[a : b + 1]
        n = self.length[some]
        out = self.flat[stretches(self.flat_at[some], n)]
        skip = start - (int(self.ends[a]) - int(n[0]))
        return out[skip : skip + stop - start].astype("<u4")


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_tokens: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, shard, n_docs, n_tokens, data: the shards in order of (part, shard), written to the
    shared folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        coder = encoder(tokenizer_path)
        vocabulary = coder.tokenizer.get_vocab_size()
        names: list = []
        counts: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def full(names: list, counts: list[int], ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()), "data": pa.array([shard_bytes(names, counts, ids, vocabulary)], pa.binary())})

        for batch in slices_of(1, batches, min(4 << 20, 2 * shard_tokens)):
            found, at = coder.encode(batch.column(1))
            size = np.diff(at) + 1
            ids = np.full(int(size.sum()), end_id, found.dtype)
            inside = np.ones(len(ids), bool)
            inside[np.cumsum(size) - 1] = False
            ids[inside] = found
            names += batch.column(0).to_pylist()
            counts += size.tolist()
            parts.append(ids)
            held += len(ids)
            # whole documents, up to shard_tokens and one document
            while held >= shard_tokens:
                n = int(np.searchsorted(np.cumsum(counts), shard_tokens)) + 1
                ids, size = np.concatenate(parts), sum(counts[:n])
                yield full(names[:n], counts[:n], ids[:size])
                shard, names, counts, parts, held = shard + 1, names[n:], counts[n:], [ids[size:]], held - size
        if names:
            yield full(names, counts, np.concatenate(parts))

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_tie"))
    ordered = rows.repartitionByRange("_id", "_tie").sortWithinPartitions("_id", "_tie").select("_id", "_text")
    return stage(ordered.mapInArrow(write, "part int, shard int, n_docs long, n_tokens long, data binary"))


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards' bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(1, batches):
            shard = Shard(batch.column(2)[0].as_py())
            ids = shard.ids()
            e = shard.edges.tolist()
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(e, e[1:], strict=False)]
            n = len(crc)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[0].as_py()] * n, pa.int32()), pa.array([batch.column(1)[0].as_py()] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(e[:-1], pa.int64()), pa.array(np.diff(shard.edges)), pa.array(crc, pa.int64())], ["part", "shard", "doc_id", "_start", "n_tokens", "ids_crc32"])

    counts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_part_start"))
    within = shards.select("part", "shard", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("_shard_start"))
    base = within.join(counts, "part").select("part", "shard", (F.col("_part_start") + F.col("_shard_start")).alias("_base"))
    found = shards.select("part", "shard", "data").mapInArrow(read, "part int, shard int, doc_id long, _start long, n_tokens long, ids_crc32 long")
    return found.join(base, ["part", "shard"]).select("doc_id", (F.col("_base") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")
