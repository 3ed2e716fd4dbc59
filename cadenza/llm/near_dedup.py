"""N-gram Jaccard join by MinHash banding, verified on whole n-gram sets.

Texts with the same n-gram set are one class; only classes are compared. A class's signature is cut
into bands, whose number and rows are chosen for the target recall at the threshold; classes that
share a band hash are candidates. Instead of listing all pairs of a band, each member is tied to the
band's least member; connected components of these ties hold every candidate pair. Pairs that share a band
are compared, and no others: a component of up to `whole` classes as it is, so that each set moves once, a
larger one, which chance may chain together, by the buckets of its bands, each pair in the first band
that it shares. Either way gives the same links. A component or bucket is dealt into chunks of `chunk` classes by a hash, and each pair of
chunks is a block of its own, compared by products of 0-1 matrices over the shared n-grams: a large
group of near copies is many blocks, never one task. A block reports, for each class, the documents
linked to it and one tie to its linked neighbours, so a group of m near copies yields in the order of m
rows a block, not m * m.

The n-grams are of `width` words, A-Z lower-cased; a text of fewer words has one n-gram of all of them.

Edge cases: texts without words (null, empty) link to nothing, not even each other; null ids are
compared like others, their class has the least non-null id, or null; repeated rows are copies of each
other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import batches_of, free_name, hashed_words, mixed, stage, windows
from cadenza.llm.components import connected_components

#: Stand-ins for null ids are above all ids.
NO_ID = 1 << 62


def choose_bands(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands, enough of them to find a pair at the threshold with
    the recall, stay within most_hashes."""
    found = (1, 1)
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            found = (bands, rows)
    return found


def ngram_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text, ascending."""
    words, at = hashed_words(column, lower=True)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(mixed(windows(words[a:b], min(width, b - a)))) if b > a else np.zeros(0, np.uint64))
    return out


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    x = np.array([s.sum(dtype=np.uint64), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
    return int(x[0]), int(x[1])


def signature(s: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 2048):
        np.minimum(out, (factors[:, None] * s[k : k + 2048] + offsets[:, None]).min(1), out=out)
    return out


def class_features(docs: DataFrame, width: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """row_id (never null), doc_id, k1, k2 (of the n-gram set), n_grams, bands (hashes)."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.PCG64(99))
        factors, offsets = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        for batch in batches_of(512, batches):
            sets = ngram_sets(batch.column(2), width)
            keys = [set_keys(s) for s in sets]
            hashes = []
            for s in sets:
                # multiplication leaves low bits weak; the high half decides
                sig = signature(s, factors, offsets) >> np.uint64(20)
                h = np.arange(1, bands + 1, dtype=np.uint64)
                for column in sig.reshape(bands, rows).T:
                    h = mixed(h + column)
                hashes.append(h.view(np.int64).tolist() if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(hashes, pa.list_(pa.int64()))],
                ["row_id", "doc_id", "k1", "k2", "n_grams", "bands"],
            )

    return with_row_id(docs, id_col, text_col).mapInArrow(featured, "row_id long, doc_id long, k1 long, k2 long, n_grams int, bands array<long>")


def with_row_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id = F.col(id_col).cast("long")
    stand_in = F.lit(NO_ID) + F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(NO_ID - 1))
    return docs.select(F.coalesce(doc_id, stand_in).alias("row_id"), doc_id.alias("doc_id"), F.col(text_col).alias("text"))


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """The matrix of pairs at or above the Jaccard threshold, exactly."""
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    step = max(256, (1 << 21) // len(sets))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    edges = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + step, step)) if len(column) else [0]
    for k in range(len(edges) - 1):
        a, b = edges[k], edges[k + 1]
        part = np.zeros((len(sets), min(step, int(column[-1]) + 1 - k * step)), np.float32)
        part[row[a:b], column[a:b] - k * step] = 1
        common += part @ part.T
    union = n[:, None] + n - common.astype(np.float64)
    out = common >= threshold * union - 1e-9
    np.fill_diagonal(out, False)
    return out


def compared_blocks(blocks: DataFrame, threshold: float) -> DataFrame:
    """blocks: component, band, i, j, side, c, size, grams, bands, in any order. With a band, which is the
    place of a hash in bands, only pairs whose bands first agree there count, without one all pairs that agree
    in any. Returns c, peer (a class it is
    linked to directly or through others of the block, or itself), links (documents linked)."""

    def compare(group: list[tuple]) -> Iterator[tuple[int, int, int]]:
        m = linked([np.frombuffer(g[7], np.uint64) for g in group], threshold)
        side, size, c = np.array([g[4] for g in group]), np.array([g[6] for g in group]), np.array([g[5] for g in group])
        if group[0][2] != group[0][3]:
            m &= side[:, None] != side
        hashes = np.array([g[8] for g in group])
        if group[0][1] is None:
            m &= np.any([h[:, None] == h for h in hashes.T], axis=0)
        for h in hashes.T[: group[0][1] or 0]:
            m &= h[:, None] != h
        label = np.arange(len(group))
        while True:
            low = np.minimum(label, np.where(m, label, len(group)).min(1))
            if (low == label).all():
                break
            label = low
        return zip(c.tolist(), c[label].tolist(), (m @ size).tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple] = []
        for batch in batches_of(256, batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:4] != group[0][:4]:
                    out += compare(group)
                    group = []
                group.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["c", "peer", "links"])
                out = []
        if group:
            out = list(compare(group))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["c", "peer", "links"])

    key = ["component", "band", "i", "j"]
    return blocks.select(*key, "side", "c", "size", "grams", "bands").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "c long, peer long, links long")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999, chunk: int = 256, whole: int = 8192, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its group of linked documents),
    n_links (other documents at or above the threshold), kept (one document of each group is)."""
    bands, rows = choose_bands(threshold, recall)
    features = stage(class_features(docs, width, bands, rows, id_col, text_col))
    grouped = features.where("n_grams > 0").groupBy("k1", "k2").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("size"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    classes = stage(grouped.withColumn("c", F.monotonically_increasing_id()))

    banded = classes.select("c", F.posexplode("bands").alias("band", "hash"))
    shared = banded.groupBy("band", "hash").agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ties = banded.join(shared, ["band", "hash"]).where("c != least").select(F.col("c").alias("src"), F.col("least").alias("dst"))
    candidates = stage(connected_components(ties))

    sizes = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    of = classes.select(F.col("c").alias("node"), "row_id", "k1", "k2", "size", "bands")
    members = stage(candidates.join(sizes, "component").join(of, "node").select(F.col("node").alias("c"), "component", "n", "row_id", "k1", "k2", "size", "bands"))
    # by a shuffle at every size: the members have no bound
    found = with_row_id(docs, id_col, text_col).select(F.col("row_id"), "text").join(members.select("row_id", "k1", "k2", "c").hint("merge"), "row_id")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(256, batches):
            sets = ngram_sets(batch.column(0), width)
            same = [set_keys(s) == (a, b) for s, a, b in zip(sets, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(3).filter(pa.array(same, pa.bool_())), pa.array([s.tobytes() for s, y in zip(sets, same, strict=True) if y], pa.binary())], ["c", "grams"])

    sets = found.select("text", "k1", "k2", "c").mapInArrow(to_sets, "c long, grams binary")
    # a repeated row gives its class's set again
    sets = sets.groupBy("c").agg(F.first("grams").alias("grams"))
    # what is compared with each other: a component, or in a large one the classes of a band's hash
    small = members.where(F.col("n") <= whole).select("c", "size", "bands", "component", F.lit(None).cast("int").alias("band"), "n")
    large = members.where(F.col("n") > whole).select("c", "size", "bands", F.posexplode("bands").alias("band", "component"))
    buckets = large.groupBy(F.col("band").alias("_b"), F.col("component").alias("_h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    large = large.join(buckets, (F.col("band") == F.col("_b")) & (F.col("component") == F.col("_h"))).select(*small.columns)
    k = F.ceil(F.col("n") / chunk).cast("int")
    sided = small.unionByName(large).withColumn("k", k).withColumn("side", F.pmod(F.xxhash64("c"), F.col("k")).cast("int"))
    blocks = sided.join(sets, "c").select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("_o")).withColumns({"i": F.least("side", "_o"), "j": F.greatest("side", "_o")})
    verified = stage(compared_blocks(blocks, threshold))

    links = verified.groupBy("c").agg(F.sum("links").alias("links"))
    groups = connected_components(verified.select(F.col("c").alias("src"), F.col("peer").alias("dst")))
    labelled = classes.join(groups.withColumnRenamed("node", "c"), "c", "left").join(links, "c", "left").select("c", "k1", "k2", "row_id", "size", F.coalesce("component", "c").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    labelled = stage(labelled)
    firsts = labelled.groupBy("component").agg(F.min("row_id").alias("first_row"))
    of_class = labelled.join(firsts, "component").select("k1", "k2", "first_row", (F.col("links") + F.col("size") - 1).alias("_links"))
    out = features.drop("bands").join(of_class, ["k1", "k2"], "left")
    first = F.coalesce("first_row", "row_id")
    nth = F.row_number().over(Window.partitionBy("row_id").orderBy("k1", "k2"))
    return out.withColumns({"_first": first, "_nth": nth}).select(
        "doc_id", F.when(F.col("_first") < NO_ID, F.col("_first")).alias("class_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        ((F.col("n_grams") == 0) | ((F.col("row_id") == F.col("_first")) & (F.col("_nth") == 1))).alias("kept"), "k1", "k2",
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which near_duplicates() keeps one for each group; texts
    without words all stay."""
    judged = stage(near_duplicates(docs, threshold, width, recall, id_col=id_col, text_col=text_col))
    place = docs.columns.index(text_col)
    gone = judged.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    stays = judged.where("kept").select(F.col("doc_id").alias("_stays")).distinct()
    # an id that both goes and stays is repeated: decide those rows by their text
    unsure = gone.join(stays, gone["_gone"].eqNullSafe(stays["_stays"]), "left_semi")
    plain = docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
    # repeated ids are rare: their rows are looked at again only if there are any
    if unsure.isEmpty():
        return plain
    mixed_rows = docs.join(unsure, docs[id_col].eqNullSafe(unsure["_gone"]), "left_semi")
    keep = judged.where("kept").join(unsure, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_semi").select(F.col("doc_id").alias("_keep"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))

    key1, key2, place_name = (free_name(docs, n) for n in ("key1", "key2", "nth"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(256, batches):
            keys = [set_keys(s) for s in ngram_sets(batch.column(place), width)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], [*batch.schema.names, key1, key2])

    from pyspark.sql.types import LongType, StructField, StructType

    keyed_rows = mixed_rows.mapInArrow(keyed, StructType([*docs.schema.fields, StructField(key1, LongType()), StructField(key2, LongType())]))
    met = keyed_rows.join(keep, keyed_rows[id_col].eqNullSafe(keep["_keep"]) & (keyed_rows[key1] == keep["_k1"]) & (keyed_rows[key2] == keep["_k2"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy(key1, key2, id_col).orderBy(text_col))
    return plain.unionByName(met.withColumn(place_name, nth).where(F.col(place_name) == 1).select(*docs.columns))
