"""Exact quantiles of columns too large for one task.

A KLL sketch of each group, a few kilobytes whatever the group's size, gives edges close around every
wanted place. One more pass counts the rows between the edges, which says exactly which cells hold the wanted
order statistics; only the rows of those cells go on, each cell with a sketch and finer edges of its own.
When a cell has at most `direct` rows, or one value, its order statistics are read off. Edges need not be
exact, counts are. So a hot group is many tasks in every pass, and none holds its distinct values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.sources.shared import written

#: Rows of a group or cell that are ordered in one task.
DIRECT = 1 << 16
_PART = ["_g", "_cell"]


def _sketched(rows: DataFrame, ranks: Sequence[float], size: int) -> DataFrame:
    """By part: rows, least and greatest value, and edges: the least value and the sketch's quantiles."""
    by = rows.groupBy(*_PART).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count_if(~F.isnan("_v")).alias("_numbers"), F.kll_sketch_agg_double("_v", F.lit(size)).alias("_s"))
    edges = F.when(F.col("_numbers") > 0, F.kll_sketch_get_quantile_double("_s", F.array(*map(F.lit, ranks))))
    return written(by.select(*_PART, "_n", "_lo", "_hi", F.array_sort(F.array_distinct(F.array_append(F.coalesce(edges, F.array().cast("array<double>")), F.col("_lo")))).alias("_edges")), "parts")


def _placed(rows: DataFrame, most: int) -> DataFrame:
    """rows with _at: how many of _edges, at most so many in order, lie below _v. Found by halving, each step a
    column of its own that the next one reads twice."""
    rows = rows.withColumn("_at", F.lit(0))
    for k in reversed(range(most.bit_length())):
        below = F.get("_edges", F.col("_at") + ((1 << k) - 1)) < F.col("_v")
        rows = rows.withColumn("_at", F.col("_at") + F.when(below, 1 << k).otherwise(0))
    return rows


def _order_statistics(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """_g, _r, _x of the wanted places, in parts that one task can order."""
    counted = rows.groupBy(*_PART, "_v").agg(F.count(F.lit(1)).alias("_c"))
    end = F.sum("_c").over(Window.partitionBy(*_PART).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    places = counted.select(*_PART, "_v", end.alias("_end"), (end - F.col("_c")).alias("_begin"))
    met = wanted.join(places, _PART).where((F.col("_in") >= F.col("_begin")) & (F.col("_in") < F.col("_end")))
    return met.select("_g", "_r", F.col("_v").alias("_x"))


def _hit(targets: DataFrame, counts: DataFrame) -> DataFrame:
    """The cells that hold wanted places, and the places inside them; counts: _c rows by part and _at."""
    end = F.sum("_c").over(Window.partitionBy(*_PART).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    cells = counts.select(*_PART, "_at", end.alias("_end"), (end - F.col("_c")).alias("_begin"))
    met = targets.join(cells, _PART).where((F.col("_in") >= F.col("_begin")) & (F.col("_in") < F.col("_end")))
    return written(met.select(*_PART, "_at", "_r", (F.col("_in") - F.col("_begin")).alias("_in")), "targets")


def _inner(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of cells as rows of parts of their own."""
    return rows.select("_g", F.concat_ws(".", F.nullif(F.col("_cell"), F.lit("")), "_at").alias("_cell"), *columns)


#: Shares of a cell's edges.
_FINER = [k / 32 for k in range(33)]


def _found(data: DataFrame, targets: DataFrame, parts: DataFrame, most: int, direct: int, sketch: int) -> list[DataFrame]:
    """_g, _r, _x of the targets, in pieces. most: edges of one of the parts at most."""
    found = []
    while True:
        met = targets.join(parts, _PART)
        found.append(met.where("_lo = _hi").select("_g", "_r", F.col("_lo").alias("_x")))
        small = met.where((F.col("_lo") != F.col("_hi")) & (F.col("_n") <= direct)).select(*_PART, "_r", "_in")
        if not small.isEmpty():  # or else the join would deal all rows to find none
            found.append(_order_statistics(data.join(small.select(*_PART).distinct(), _PART, "left_semi"), small))
        large = met.where((F.col("_lo") != F.col("_hi")) & (F.col("_n") > direct))
        if large.isEmpty():
            return found
        edges = large.select(*_PART, "_edges").dropDuplicates(_PART)
        # parts are at most rows / direct, and cells that are hit two a share and part: no shuffle deals the rows
        # by a few groups
        dealt = _placed(data.join(F.broadcast(edges), _PART), most)
        hit = _hit(large, dealt.groupBy(*_PART, "_at").agg(F.count(F.lit(1)).alias("_c")))
        data = written(_inner(dealt.join(F.broadcast(hit.select(*_PART, "_at").distinct()), [*_PART, "_at"], "left_semi"), "_v"), "cells")
        targets, parts, most = _inner(hit, "_r", "_in"), _sketched(data, _FINER, sketch), len(_FINER) + 1


def _places(shares: Sequence[float]) -> tuple[Column, Callable[[Column], Column]]:
    """All shares, and the place of one among n rows. They are the elements of one array: an expression for each
    takes longer to compile than the passes."""
    return F.array(*(F.lit(float(s)) for s in shares)), lambda s: s * (F.col("n") - 1)


def _targets(whole: DataFrame, shares: Sequence[float]) -> DataFrame:
    all_shares, place = _places(shares)
    places = F.array_distinct(F.flatten(F.transform(all_shares, lambda s: F.array(F.floor(place(s)), F.ceil(place(s))))))
    return whole.select("_g", F.lit("").alias("_cell"), F.explode(places).alias("_r")).withColumn("_in", F.col("_r"))


def _interpolated(whole: DataFrame, found: Sequence[DataFrame], shares: Sequence[float], by: Sequence[str]) -> DataFrame:
    all_shares, place = _places(shares)
    values = reduce(DataFrame.unionByName, found).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_x"))).alias("_m"))

    def quantile(s: Column) -> Column:
        at = place(s)
        low, high = F.floor(at), F.ceil(at)
        a, b = F.element_at("_m", low), F.element_at("_m", high)
        return F.when((low == high) | (a == b), a).otherwise((high - at) * a + (at - low) * b)

    return whole.join(values, "_g").select(*(F.col("_g")[c].alias(c) for c in by), "n", F.transform(all_shares, quantile).alias("quantiles"))


def exact_quantiles(rows: DataFrame, value: str | Column, shares: Sequence[float], by: Sequence[str] = (), direct: int = DIRECT, sketch: int = 800, margin: float = 0.01, kept: bool = False) -> DataFrame:
    """by..., n, quantiles: for every group with a value, the exact linear quantiles in the order of shares,
    as percentile() gives them: nulls don't count, NaN is above all numbers. kept: rows are a written table, or
    follow from one row by row, so that their values needn't be written for the passes."""
    value = F.col(value) if isinstance(value, str) else value
    group = F.struct(F.lit(0).alias("_0"), *by)
    # several passes read the values, but what they are made from is worked out once
    values = rows.select(group.alias("_g"), (value.cast("double") + 0.0).alias("_v")).where("_v IS NOT NULL")
    data = (values if kept else written(values, "values")).select("_g", F.lit("").alias("_cell"), "_v")
    near = sorted({min(1.0, max(0.0, s + m)) for s in shares for m in (-margin, 0.0, margin)} | {0.0, 1.0})
    whole = written(data.groupBy("_g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    largest = whole.agg(F.max("n")).first()[0] or 0
    if largest <= direct:  # what percentile() holds of a group is bounded then
        few = data.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.percentile("_v", F.array(*map(F.lit, shares))).alias("quantiles"))
        return few.select(*(F.col("_g")[c].alias(c) for c in by), "n", "quantiles")
    found = _found(data, _targets(whole, shares), _sketched(data, near, sketch), len(near) + 1, direct, sketch)
    return _interpolated(whole, found, shares, by)


def member_quantiles(rows: DataFrame, value: str | Column, shares: Sequence[float], sets: str, name: str, direct: int = DIRECT, sketch: int = 800, cells: int = 128, kept: bool = False) -> DataFrame:
    """name, n, quantiles: exact_quantiles of groups that share rows; sets is an array of the groups that a row
    is in. The first passes, over all rows, take a row once and not once for each of its groups: edges are those
    of all rows, rows are counted by array and cell, and a group's counts are sums of those. Only the rows of
    cells with a wanted place go on by group. Different arrays should be few, as those of folds are."""
    value = F.col(value) if isinstance(value, str) else value
    values = rows.select(F.col(sets).alias("_sets"), (value.cast("double") + 0.0).alias("_v")).where("_v IS NOT NULL")
    values = values if kept else written(values, "values")
    each = lambda df, *columns: df.select(F.explode("_sets").alias("_of"), *columns).select(F.struct(F.lit(0).alias("_0"), F.col("_of").alias(name)).alias("_g"), F.lit("").alias("_cell"), *columns)
    table = _sketched(values.select(F.lit(0).alias("_g"), F.lit("").alias("_cell"), "_v"), [k / cells for k in range(cells + 1)], sketch)
    if (table.agg(F.max("_n")).first()[0] or 0) <= direct:
        return exact_quantiles(values.select(F.explode("_sets").alias(name), "_v"), "_v", shares, [name], direct, sketch, kept=True)
    dealt = _placed(values.crossJoin(F.broadcast(table.select("_edges"))), cells + 2)  # a row
    counted = written(dealt.groupBy("_sets", "_at").agg(F.count(F.lit(1)).alias("_c")), "counts")
    counts = each(counted, "_at", "_c").groupBy(*_PART, "_at").agg(F.sum("_c").alias("_c"))
    whole = written(counts.groupBy("_g").agg(F.sum("_c").alias("n")), "sizes")
    hit = _hit(_targets(whole, shares), counts)
    there = dealt.join(F.broadcast(hit.select("_at").distinct()), "_at", "left_semi")
    data = written(_inner(each(there, "_at", "_v").join(F.broadcast(hit.select(*_PART, "_at").distinct()), [*_PART, "_at"], "left_semi"), "_v"), "cells")
    found = _found(data, _inner(hit, "_r", "_in"), _sketched(data, _FINER, sketch), len(_FINER) + 1, direct, sketch)
    return _interpolated(whole, found, shares, [name])


def column_quantiles(df: DataFrame, columns: dict[str, Column], shares: Sequence[float], **options) -> DataFrame:
    """column, n, quantiles of several columns in the same passes; a column without a value has no row."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(n).alias("column"), c.cast("double").alias("value")) for n, c in columns.items()))))
    return exact_quantiles(long, "value", shares, ["column"], **options)


def quantile_row(df: DataFrame, columns: dict[str, Column], shares: Sequence[float], names: dict[tuple[str, int], str], **options) -> DataFrame:
    """The same as one row: names gives the column name of (column, place in shares); null without a value."""
    long = column_quantiles(df, columns, shares, **options)
    return long.agg(*(F.max(F.when(F.col("column") == c, F.col("quantiles")[k])).alias(name) for (c, k), name in names.items()))
