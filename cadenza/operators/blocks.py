"""Ordered streams too long for one task.

A stream of more than `rows` rows is dealt into parts, ranges of its order, which are written so that they
stay as they are. What a row needs from the parts before comes in one of two ways. A frame of the last w
rows takes a halo, copies of the last w - 1 rows in front of the part. A recurrence takes a carry: each
part is summed up as a map from the state before it to the state behind it, the maps of a stream, a row a
part, are put one behind the other, and a second pass goes through the parts with their first state known."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, LongType, StructField, StructType

from cadenza.sources.shared import written

#: Rows of a stream that one task goes through.
ROWS = 1 << 18


def split(df: DataFrame, keys: Sequence[str], rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of streams up to so many rows, and those of longer ones (None: there are no longer ones)."""
    key = F.struct(F.lit(0), *keys)
    long = df.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select("_k")
    if long.isEmpty():
        return df, None
    marked = df.withColumn("_k", key)
    return marked.join(long, "_k", "left_anti").drop("_k"), marked.join(long, "_k", "left_semi").drop("_k")


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    """df with _part: ascending ranges of (keys, order) with about so many rows each."""
    n = -(-df.count() // rows)
    return written(df.repartitionByRange(max(1, n), *keys, *order).withColumn("_part", F.spark_partition_id()), "parts")


def with_halo(parts: DataFrame, keys: Sequence[str], order: Sequence[str], width: int) -> DataFrame:
    """The rows of the parts with _halo false, and true for copies of the width - 1 rows of the stream before
    each part. Parts of a stream may be shorter than that."""
    key = F.struct(F.lit(0), *keys)
    sizes = parts.groupBy(key.alias("_k"), "_part").agg(F.count(F.lit(1)).alias("_n"))
    stream = Window.partitionBy("_k").orderBy("_part")
    sizes = sizes.withColumn("_begin", F.sum("_n").over(stream) - F.col("_n"))
    after = F.collect_list(F.struct(F.col("_part").alias("p"), F.col("_begin").alias("b"))).over(stream.rowsBetween(1, max(1, width - 1)))
    sizes = sizes.withColumn("_after", after)
    back = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*(F.col(c).desc() for c in order)))
    tails = parts.withColumns({"_k": key, "_back": back}).where(F.col("_back") < width).join(sizes, ["_k", "_part"])
    place = F.col("_begin") + F.col("_n") - F.col("_back")
    copies = tails.withColumn("_to", F.explode(F.filter("_after", lambda a: a["b"] - (width - 1) <= place)))
    copies = copies.select(*(F.col("_to.p").alias(c) if c == "_part" else F.col(c) for c in parts.columns), F.lit(True).alias("_halo"))
    return parts.withColumn("_halo", F.lit(False)).unionByName(copies)


def runs(batch: pa.RecordBatch, places: Sequence[int]) -> list[tuple[int, int, tuple]]:
    """begin, end and key of the runs of equal values in all of the columns."""
    if not batch.num_rows:
        return []
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for p in places:
        code = batch.column(p).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    begin = np.flatnonzero(new).tolist()
    return [(a, b, tuple(batch.column(p)[a].as_py() for p in places)) for a, b in zip(begin, [*begin[1:], batch.num_rows], strict=True)]


def carries(parts: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], Any], summed: Callable[[Any, pa.RecordBatch], Any], behind: Callable[[Any, Any], Any], first: Any, kind: DataType) -> DataFrame:
    """_s (the stream's keys), _part, _carry: the state before each part of a stream. start() begins a
    part's summary, summed(summary, rows) goes on with it, behind(state, summary) is the state behind the part,
    `first` the state before a stream. States are values of type `kind`; summaries are pickled."""
    at = [parts.columns.index(c) for c in (*keys, "_part")]
    names = [*keys, "_part", "_summary"]

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, summary, types = None, None, []

        def row() -> pa.RecordBatch:
            values = [*(pa.array([v], t) for v, t in zip(now, types, strict=True)), pa.array([pickle.dumps(summary)], pa.binary())]
            return pa.RecordBatch.from_arrays(values, names)

        for batch in batches:
            types = [batch.schema.types[p] for p in at]
            for a, b, key in runs(batch, at):
                if key != now:
                    if now is not None:
                        yield row()
                    now, summary = key, start()
                summary = summed(summary, batch.slice(a, b - a))
        if now is not None:
            yield row()

    def composed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_part")
        state, before = first, []
        for summary in group["_summary"]:
            before.append(state)
            state = behind(state, pickle.loads(summary))
        return pd.DataFrame({"_to": group["_id"], "_carry": before})

    ordered = parts.repartition("_part").sortWithinPartitions("_part", *keys, *order)
    schema = StructType([*(parts.schema[c] for c in (*keys, "_part")), StructField("_summary", BinaryType())])
    # numbered and written, for keys of any type come back by number
    each = written(ordered.mapInArrow(summaries, schema).select(F.struct(F.lit(0), *keys).alias("_s"), "_part", "_summary", F.monotonically_increasing_id().alias("_id")), "summaries")
    found = each.groupBy("_s").applyInPandas(composed, StructType([StructField("_to", LongType()), StructField("_carry", kind)]))
    return each.join(found, F.col("_id") == F.col("_to")).select("_s", "_part", "_carry")


def with_carry(parts: DataFrame, keys: Sequence[str], carried: DataFrame) -> DataFrame:
    """parts with the _carry of their part."""
    return parts.withColumn("_s", F.struct(F.lit(0), *keys)).join(carried, ["_s", "_part"]).select(*parts.columns, "_carry")


def numbered(df: DataFrame, order: Sequence[str], name: str, rows: int = ROWS) -> DataFrame:
    """df with the place of each row in the order of the whole table, from 0: ranges number their own rows, and
    what stands before a range is a sum over a row a range."""
    parts = dealt(df, [], order, rows)
    sizes = parts.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_begin"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    met = parts.withColumn("_in", inside).join(sizes, F.col("_part") == F.col("_p"))
    return met.select(*df.columns, (F.col("_begin") + F.col("_in")).alias(name))


def reached(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, rows: int = ROWS) -> DataFrame:
    """df with the greatest value of all rows of its stream before each row, null before the first: what a
    sweep over ranges compares a range's begin with. Streams of more than `rows` rows are swept in parts."""
    before = lambda by: F.max(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    calm, long = split(df, keys, rows)
    out = calm.withColumn(name, before(keys))
    if long is None:
        return out
    parts = dealt(long, keys, order, rows)
    at = parts.columns.index(value)
    greatest = lambda a, b: b if a is None else a if b is None else max(a, b)
    carried = carries(parts, keys, order, lambda: None, lambda m, batch: greatest(m, pc.max(batch.column(at)).as_py()), greatest, None, parts.schema[value].dataType)
    met = with_carry(parts, keys, carried).withColumn(name, F.greatest(before([*keys, "_part"]), "_carry"))
    return out.unionByName(met.drop("_part", "_carry"))
