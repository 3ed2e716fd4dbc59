"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a 64-bit hash of each row. It starts with one bucket;
a bucket above the byte limit splits on its next bit, and no other bucket changes, until every bucket
fits. Splits are planned `step` bits at a time on byte sums by hash prefix, so a round is one grouping
over the rows of the buckets that are still too large, and the directory holds a row per bucket.

Edge cases: null ids and texts hash as such, a null text has 0 bytes; rows that repeat id and text
hash alike and can't be told apart by bits: they are numbered into buckets of their own below depth
64 until those fit; a single row above the limit is a bucket by itself, marked oversized; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import stage


def _prefix(bits: int) -> Column:
    """The leading `bits` bits of the hash, as a number below 2 ** bits."""
    return F.shiftrightunsigned("_hash", 64 - bits) if bits else F.lit(0).cast("long")


def extendible_shards(docs: DataFrame, limit_bytes: int = 4 << 20, step: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, depth, prefix, part, shard (text: prefix bits, and part
    where repeated rows had to be numbered), shard_bytes, oversized."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_hash")))
    done, open_rows, depth = [], rows, 0
    while True:
        last = min(64, depth + step)
        sums = open_rows.groupBy(_prefix(last).alias("_leaf")).agg(F.sum("n_bytes").alias("_leaf_bytes"), F.count(F.lit(1)).alias("_leaf_rows"))
        tree = sums
        for d in range(last, depth - 1, -1):
            # the buckets that contain a leaf, from its own depth up to the round's first
            tree = tree.withColumn(f"_at{d}", F.sum("_leaf_bytes").over(Window.partitionBy(F.shiftrightunsigned("_leaf", last - d))))
        first_fit = F.coalesce(*(F.when(F.col(f"_at{d}") <= limit_bytes, F.lit(d)) for d in range(depth, last + 1)))
        planned = stage(tree.select("_leaf", first_fit.alias("_depth"), F.col("_leaf_rows")))
        joined = open_rows.withColumn("_leaf", _prefix(last)).join(planned, "_leaf")
        done.append(joined.where("_depth IS NOT NULL").select("doc_id", "n_bytes", "_hash", F.col("_depth").alias("depth")))
        if last == 64 or planned.where("_depth IS NULL").isEmpty():
            if last == 64:
                done.append(joined.where("_depth IS NULL").select("doc_id", "n_bytes", "_hash", F.lit(64).alias("depth")))
            break
        open_rows, depth = stage(joined.where("_depth IS NULL").select("doc_id", "n_bytes", "_hash")), last
    placed = done[0]
    for x in done[1:]:
        placed = placed.unionByName(x)
    prefix = F.expr("CASE WHEN depth = 0 THEN 0L ELSE shiftrightunsigned(_hash, 64 - depth) END")
    placed = placed.withColumn("prefix", prefix)
    twins = Window.partitionBy("_hash").orderBy("n_bytes", "doc_id")
    each = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest(F.lit(1), F.max("n_bytes").over(Window.partitionBy("_hash")))))
    deep = placed.where("depth = 64").withColumn("part", F.floor((F.row_number().over(twins) - 1) / each).cast("long"))
    whole = placed.where("depth < 64").withColumn("part", F.lit(0).cast("long")).unionByName(deep)
    totals = whole.groupBy("depth", "prefix", "part").agg(F.sum("n_bytes").alias("shard_bytes"))
    name = F.concat_ws("-", F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")), F.when(F.col("depth") == 64, F.col("part").cast("string")))
    return whole.join(totals, ["depth", "prefix", "part"]).select("doc_id", "n_bytes", "depth", "prefix", "part", name.alias("shard"), "shard_bytes", (F.col("shard_bytes") > limit_bytes).alias("oversized"))
