"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition is sorted by digest into a run, and the rows of equal texts in it become one entry
(digest, kept id and row, count). In each round, `fan_in` neighbouring runs are brought together, slice
by slice of the digest space, in digest order, and one pass over them merges them into their parent;
after log(partitions) rounds one run is left. The order is what the merge reads, so each round is a
sort and a pass, of which the planner can't leave out the sort. An entry is verified at every level: two
are one only if SHA-256, length in bytes and a 64-bit hash of another family all agree, and of their
identifiers the one that stays comes first in the order.

The verdicts go back the same way: to the runs that hold an entry, and there to its rows. A text that
fills a third of all rows is one entry per run, and its rows are spread over their runs; no task ever
holds more than its stretch of the digest order, and a merge holds one batch.

Nulls and edge cases: a null text counts as empty; a null id counts as lower than any other when the
largest stays and is passed over when the smallest stays; of rows that repeat id and text, exactly
one is kept; other columns of the input are ignored, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import free_name, lower_ascii, stage

#: Bytes of a key: SHA-256, length, other hash.
KEY_BYTES = 48
_ENTRY = "run long, key binary, keep_id long, keep_row long, n long"


def _key(text_col: str) -> Column:
    normal = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    number = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    return F.concat(F.unhex(F.sha2(F.encode(normal, "UTF-8"), 256)), number(F.octet_length(normal).cast("long")), number(F.xxhash64(normal)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (the three facts that identify a text), run (input partition) and row (unique)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(text_col).alias("key"), F.spark_partition_id().cast("long").alias("run"), F.monotonically_increasing_id().alias("row"))


def _first_of_equals(batch: pa.RecordBatch) -> np.ndarray:
    """Where a run or key begins that the row before, in the same batch, doesn't have."""
    run, keys = batch.column(0).to_numpy(), b"".join(batch.column(1).to_pylist())
    key = np.frombuffer(keys, np.uint64).reshape(-1, KEY_BYTES // 8)
    return np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (key[1:] != key[:-1]).any(1)))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in order of (run, key, preference): equal ones next to each other become their first,
    with the sum of their counts. The last entry of a batch waits for the next one."""
    waiting, names = None, ["run", "key", "keep_id", "keep_row", "n"]
    for batch in batches:
        if not batch.num_rows:
            continue
        # whether a column can hold nulls differs between what Spark sends and what is made here
        batch = pa.RecordBatch.from_arrays(batch.columns, names)
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        begin = _first_of_equals(batch)
        first = batch.take(pa.array(begin))
        merged = pa.RecordBatch.from_arrays([*first.columns[:4], pa.array(np.add.reduceat(batch.column(4).to_numpy(), begin))], names)
        waiting = merged.slice(len(begin) - 1)
        if len(begin) > 1:
            yield merged.slice(0, len(begin) - 1)
    if waiting is not None:
        yield waiting


def merged_runs(rows: DataFrame, keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """key, keep_id, keep_row, group_size: one row for each distinct text of digests()."""
    prefer = {"largest": F.col("keep_id").desc_nulls_last(), "smallest": F.col("keep_id").asc_nulls_last()}[keep]
    order = ["run", "key", prefer, "keep_row"]
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    entries = rows.select("run", "key", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("n"))
    # a run lies in one or a few files of its own, where it was sorted as it was written
    runs = entries.sortWithinPartitions(*order).mapInArrow(_merge, _ENTRY)
    while True:
        n_runs = -(-n_runs // fan_in)
        parent = runs.withColumn("run", F.floor(F.col("run") / fan_in))
        runs = parent.repartition(F.col("run"), F.substring("key", 1, 2)).sortWithinPartitions(*order).mapInArrow(_merge, _ENTRY)
        if n_runs == 1:
            return runs.select("key", "keep_id", "keep_row", F.col("n").alias("group_size"))


def _judged(docs: DataFrame, id_col: str, text_col: str, keep: str, fan_in: int) -> DataFrame:
    """doc_id, key, row, keep_id, keep_row, group_size of every row."""
    rows = stage(digests(docs, id_col, text_col).sortWithinPartitions("key"))
    merged = merged_runs(rows, keep, fan_in).withColumnRenamed("key", "_key")
    # down to the runs that hold a text, one row for each, and from there to their rows
    held = rows.select(F.col("run").alias("_run"), F.col("key").alias("_held")).distinct().join(merged, F.col("_held") == F.col("_key"))
    return rows.join(held, (F.col("run") == F.col("_run")) & (F.col("key") == F.col("_held"))).select("doc_id", "key", "row", "keep_id", "keep_row", "group_size")


def _sha(key: Column) -> Column:
    return F.lower(F.hex(F.substring(key, 1, 32)))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _judged(docs, id_col, text_col, keep, fan_in).select("doc_id", "keep_id", F.col("group_size").cast("long"), (F.col("row") == F.col("keep_row")).alias("kept"), _sha(F.col("key")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """The rows of docs, all columns, of which exact_duplicates() keeps one for each text."""
    judged = stage(_judged(docs, id_col, text_col, keep, fan_in).where("doc_id IS NOT DISTINCT FROM keep_id").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")))
    own_key, own_n = free_name(docs, "key"), free_name(docs, "n")
    kept = judged.select(F.col("doc_id").alias(free_name(docs, "id")), F.col("key").alias(free_name(docs, "kept_key")), F.col("n").alias(own_n))
    # by a shuffle at every size: the kept rows have no bound
    kept = kept.hint("merge")
    marked = docs.select("*", _key(text_col).alias(own_key))
    met = marked.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(free_name(docs, "id"))) & (F.col(own_key) == F.col(free_name(docs, "kept_key"))))
    if judged.where("n > 1").isEmpty():
        return met.select(*docs.columns)
    # rows that repeat both id and text: the first by text
    nth = free_name(docs, "nth")
    again = met.where(F.col(own_n) > 1).withColumn(nth, F.row_number().over(Window.partitionBy(own_key, id_col).orderBy(text_col)))
    return met.where(F.col(own_n) == 1).select(*docs.columns).unionByName(again.where(F.col(nth) == 1).select(*docs.columns))
