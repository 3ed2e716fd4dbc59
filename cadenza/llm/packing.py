"""Best-fit packing of documents into sequences by bin completion.

A document is its token ids and an end id. One longer than the capacity is cut into full pieces, the
first of which may be shorter. Full pieces are sequences; the others are dealt into groups of about
`group_size` pieces by a hash, and each group is packed by branch and bound: around the largest piece
left, the undominated fillings are enumerated, likely ones of little waste first, a branch ends when its
waste shows that it can't beat the incumbent, which is best-fit decreasing at first. Groups only hold lengths, are
of bounded size however the documents are distributed, and lose at most a part of one sequence each.

Edge cases: null texts are empty documents of the end id alone; null and repeated ids are carried
along, for a row's key is its own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import slices_of, stage
from cadenza.llm.tokens import encoder


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row (a number of its own for each piece), and ids if
    asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = TaskContext.get().partitionId() << 40, 0
        coder = encoder(tokenizer_path)
        for batch in slices_of(1, batches):
            found, at = coder.encode(batch.column(1))
            size = np.diff(at) + 1
            ends = np.cumsum(size)
            ids = np.full(int(ends[-1]), end_id, "<u4")
            inside = np.ones(len(ids), bool)
            inside[ends - 1] = False
            ids[inside] = found
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = size - (n - 1) * capacity
            start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[doc])
            begin = (ends - size)[doc] + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(own + row + np.arange(len(doc)), pa.int64())]
            row += len(doc)
            yield pa.RecordBatch.from_arrays([*columns, *([pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))] if with_ids else [])], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row", *(["ids"] if with_ids else [])]
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + ", ids array<int>" * with_ids)


def best_fit(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """counts[s] pieces of each size s, largest first, each into the fullest bin that takes it."""
    open_bins: dict[int, list[list[int]]] = {}
    room, bins = 0, []
    for s in range(capacity, 0, -1):
        for _ in range(int(counts[s])):
            fits = room >> s
            if fits:
                r = s + (fits & -fits).bit_length() - 1
                b = open_bins[r].pop()
                if not open_bins[r]:
                    room &= ~(1 << r)
            else:
                r, b = capacity, []
                bins.append(b)
            b.append(s)
            open_bins.setdefault(r - s, []).append(b)
            room |= 1 << (r - s)
    return bins


def likely_fillings(counts: np.ndarray, left: int, most: int = 4) -> list[tuple[int, ...]]:
    """Good sets of up to three pieces for the room `left`, least waste first: what to try before all
    others. One piece that fills the room is as good as any; of pairs with the same larger piece only the
    one with the largest partner is here, and likewise for triples around the largest pieces."""
    if left <= 0:
        return [()]
    if counts[left]:
        return [(left,)]
    sizes = np.flatnonzero(counts[: left + 1])
    if not len(sizes):
        return [()]
    found = {(int(sizes[-1]),)}

    def partners(larger: np.ndarray, room: np.ndarray, less: np.ndarray) -> np.ndarray:
        """The largest size up to the larger piece that fits the room and is there once more; 0: none."""
        at = np.searchsorted(sizes, np.minimum(room, larger), side="right") - 1
        b = np.where(at >= 0, sizes[np.maximum(at, 0)], 0)
        short = (b > 0) & (counts[b] < less + (b == larger))
        return np.where(short, np.where(at >= 1, sizes[np.maximum(at - 1, 0)], 0), b)

    b = partners(sizes, left - sizes, np.ones(len(sizes), int))
    total = np.where(b > 0, sizes + b, 0)
    for k in np.argsort(-total, kind="stable")[:most]:
        if b[k]:
            found.add((int(sizes[k]), int(b[k])))
    if total.max(initial=0) < left:
        for k in np.flatnonzero(b)[-24:]:
            a = int(sizes[k])
            small = sizes[(sizes <= left - a) & (sizes <= a)]
            small = small[counts[small] > (small == a)]
            c = partners(small, left - a - small, np.ones(len(small), int))
            c = np.where((c == a) & (counts[a] < 2 + (small == a)), 0, c)
            sums = np.where(c > 0, small + c, 0)
            if len(sums) and (m := int(sums.argmax()), sums[int(sums.argmax())])[1]:
                found.add((a, int(small[m]), int(c[m])))
    return sorted(found, key=lambda f: (-sum(f), len(f)))[:most]


def every_filling(counts: np.ndarray, left: int, least: int = 0, budget: list[float] | None = None) -> Iterator[tuple[int, ...]]:
    """All undominated sets of pieces for the room `left`, of any number of pieces and at least `least` in
    sum, larger pieces first. A set is dominated where another piece still fits, or fits in the place of a
    smaller one. Each step is taken from the budget, which ends the enumeration when it is used up."""
    sizes = [int(s) for s in np.flatnonzero(counts[: left + 1])[::-1] if s]
    budget = [float("inf")] if budget is None else budget

    def free(chosen: tuple[int, ...], low: int, high: int) -> bool:
        return any(low < s <= high and counts[s] > chosen.count(s) for s in sizes)

    def extended(k: int, room: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        for j in range(bisect_left(sizes, -room, k, key=lambda s: -s), len(sizes)):
            s = sizes[j]
            if counts[s] > chosen.count(s):
                budget[0] -= 1
                if budget[0] <= 0:
                    return
                yield from extended(j, room - s, (*chosen, s))
        if left - room >= least and not free(chosen, 0, room) and not any(free(chosen, p, p + room) for p in set(chosen)):
            yield chosen

    if least <= left:
        yield from extended(0, left, ())


def _options(counts: np.ndarray, left: int, least: int, budget: list[float]) -> Iterator[tuple[int, ...]]:
    """Likely fillings, then all other undominated ones."""
    likely = likely_fillings(counts, left)
    yield from likely
    if left > 0 and not counts[left]:
        yield from (f for f in every_filling(counts, left, least, budget) if f not in likely)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: for every k, pieces above half the capacity have a bin each, those of
    more than capacity - k alone; what is k to half long goes into the room that the others leave."""
    s = np.arange(len(counts))
    n, total = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * s))  # of pieces below a size
    half = capacity // 2
    k = np.arange(half + 1)
    large = n[-1] - n[half + 1]
    open_n, open_total = n[capacity - k + 1] - n[half + 1], total[capacity - k + 1] - total[half + 1]
    more = total[half + 1] - total[k] - (open_n * capacity - open_total)
    return int(max(-(-total[-1] // capacity), (large + np.maximum(0, -(-more // capacity))).max()))


def bin_completion(lengths: np.ndarray, capacity: int, nodes_per_piece: int | None = 1) -> list[list[int]]:
    """Bins of sizes, by branch and bound: around the largest piece left, the fillings of its bin are
    tried, unless their waste shows that the branch can't beat the incumbent: likely fillings first, then
    all undominated ones, to the lower bound or the end. With None the search is whole; its time can grow
    exponentially. With a budget it ends with the best bins found after so many bins tried and fillings
    begun for each piece."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    best = best_fit(counts, capacity)
    total = int(lengths.sum())
    budget = [float("inf") if nodes_per_piece is None else float(nodes_per_piece * len(lengths))]
    least = lower_bound(counts, capacity)
    left, waste, largest = len(lengths), 0, capacity
    path: list[tuple[int, Iterator[tuple[int, ...]]]] = []
    bins: list[list[int]] = []
    down = True
    while len(best) > least and budget[0] > 0:
        if down:
            if not left:
                if len(bins) < len(best):
                    best = [list(b) for b in bins]
                down = False
                continue
            while not counts[largest]:
                largest -= 1
            top = largest
            without = counts.copy()
            without[top] -= 1
            # what a filling must hold if fewer bins than the incumbent's are to do
            enough = capacity - top - ((len(best) - 1) * capacity - total - waste)
            path.append((top, _options(without, capacity - top, enough, budget)))
        elif path:
            # the last bin of the path takes its next filling
            if len(bins) == len(path):
                b = bins.pop()
                for s in b:
                    counts[s] += 1
                left, waste, largest = left + len(b), waste - capacity + sum(b), capacity
        else:
            break
        top, options = path[-1]
        # what may still be lost if fewer bins than the incumbent's are to do
        slack = (len(best) - 1) * capacity - total - waste
        chosen = next((f for f in options if capacity - top - sum(f) <= slack), None)
        budget[0] -= 1
        if chosen is None:
            path.pop()
            down = False
            continue
        b = [top, *chosen]
        for s in b:
            counts[s] -= 1
        bins.append(b)
        left, waste, down = left - len(b), waste + capacity - sum(b), True
    return best


def pack(pieces: DataFrame, capacity: int = 1024, group_size: int = 8192, nodes_per_piece: int | None = 1, most_partitions: int = 4096) -> DataFrame:
    """pieces with length and row (unique): adds sequence_id and offset. nodes_per_piece: the search's budget,
    None for the whole search. Groups share tasks beyond most_partitions."""
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < capacity)
    n_groups = max(1, -(-rest.count() // group_size))

    def packed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        by_size: dict[int, list[int]] = {}
        for k, s in enumerate(lengths.tolist()):
            by_size.setdefault(s, []).append(k)
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for n, b in enumerate(bin_completion(lengths, capacity, nodes_per_piece)):
            at = 0
            for s in b:
                k = by_size[s].pop()
                sequence[k], offset[k] = (int(key[0]) << 24) + n, at
                at += s
        return pd.DataFrame({"row": group["row"], "sequence_id": sequence, "offset": offset})

    placed = (
        rest.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(n_groups)).alias("_group")).repartition(min(n_groups, most_partitions), "_group").groupBy("_group").applyInPandas(packed, "row long, sequence_id long, offset long")
    )
    return rest.join(placed, "row").select(*full.columns).unionByName(full)


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, group_size: int = 8192, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", nodes_per_piece: int | None = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if
    asked for."""
    return pack(stage(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids, id_col, text_col)), capacity, group_size, nodes_per_piece).drop("row")
