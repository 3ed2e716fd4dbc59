"""Temporal features of ordered streams: all row-frame features of a stream share one window, so a
plan has one exchange and one sort for them. A stream too long for a task is dealt into parts (blocks)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from cadenza.operators import blocks


def _stream(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def rolling(feature: str, keys: Sequence[str], order: Sequence[str], widths: Sequence[int] = (3, 5, 10)) -> dict[str, Column]:
    """Mean and sample deviation of the last w rows; the deviation of one row is null."""
    out = {}
    for w in widths:
        frame = _stream(keys, order).rowsBetween(1 - w, 0)
        out |= {f"{feature}_mean_{w}": F.avg(feature).over(frame), f"{feature}_std_{w}": F.stddev_samp(feature).over(frame)}
    return out


def deltas(feature: str, keys: Sequence[str], order: Sequence[str]) -> dict[str, Column]:
    """Difference to the row before (first: 0) and relative change (first: 0; previous 0: null)."""
    before = F.lag(feature).over(_stream(keys, order))
    return {
        f"{feature}_diff": F.coalesce(F.col(feature) - before, F.lit(0.0)),
        f"{feature}_pct": F.when(before.isNull(), 0.0).otherwise(F.try_divide(F.col(feature) - before, before)),
    }


def slopes(feature: str, keys: Sequence[str], order: Sequence[str], widths: Sequence[int] = (5, 10)) -> dict[str, Column]:
    """Least-squares slope over the last w rows, null for one row. A row's place is counted from any
    origin, for a slope doesn't depend on it."""
    place = F.col("_place").cast("double")
    return {f"{feature}_slope_{w}": F.regr_slope(feature, place).over(_stream(keys, order).rowsBetween(1 - w, 0)) for w in widths}


def zscore(feature: str, keys: Sequence[str]) -> dict[str, Column]:
    whole = Window.partitionBy(*keys)
    return {f"{feature}_z": (F.col(feature) - F.avg(feature).over(whole)) / (F.stddev_samp(feature).over(whole) + 1e-8)}


def zscored(df: DataFrame, feature: str, keys: Sequence[str]) -> DataFrame:
    """The same by a grouping with partial sums and a join, which holds no group."""
    stats = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.avg(feature).alias("_m"), F.stddev_samp(feature).alias("_s"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(stats, same).select(*df.columns, ((F.col(feature) - F.col("_m")) / (F.col("_s") + 1e-8)).alias(f"{feature}_z"))


def cross_views(feature: str, keys: Sequence[str]) -> dict[str, Column]:
    """Over all rows of the same keys (an asset and a time): max, min, mean, range."""
    same = Window.partitionBy(*keys)
    high, low = F.max(feature).over(same), F.min(feature).over(same)
    return {f"{feature}_max": high, f"{feature}_min": low, f"{feature}_avg": F.avg(feature).over(same), f"{feature}_range": high - low}


def _framed(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int, columns: Callable[[Sequence[str]], dict[str, Column]], rows: int, split: tuple | None = None) -> DataFrame:
    """df with columns over frames of the last `width` rows of a stream; a stream of more than `rows` rows is
    several parts, each with the rows before it as a halo."""

    def over(d: DataFrame, by: Sequence[str]) -> DataFrame:
        placed = d.withColumn("_place", F.row_number().over(_stream(by, order)))
        return placed.select(*d.columns, *(c.alias(n) for n, c in columns(by).items()))

    calm, long = split or blocks.split(df, keys, rows)
    if long is None:
        return over(calm, keys)
    parts = blocks.with_halo(blocks.dealt(long, keys, order, rows), keys, order, width)
    return over(calm, keys).unionByName(over(parts, [*keys, "_part"]).where("NOT _halo").drop("_part", "_halo"))


def rolled(df: DataFrame, feature: str, keys: Sequence[str], order: Sequence[str], widths: Sequence[int] = (3, 5, 10), rows: int = blocks.ROWS) -> DataFrame:
    """df with rolling() of a feature."""
    return _framed(df, keys, order, max(widths), lambda by: rolling(feature, by, order, widths), rows)


def changed(df: DataFrame, feature: str, keys: Sequence[str], order: Sequence[str], rows: int = blocks.ROWS) -> DataFrame:
    """df with deltas() of a feature."""
    return _framed(df, keys, order, 2, lambda by: deltas(feature, by, order), rows)


def rolling_slopes(df: DataFrame, feature: str, keys: Sequence[str], order: Sequence[str], widths=(5, 10), rows: int = blocks.ROWS) -> DataFrame:
    """df with slopes() of a feature."""
    return _framed(df, keys, order, max(widths), lambda by: slopes(feature, by, order, widths), rows)


def temporal_features(df: DataFrame, features: Sequence[str], asset: str, view: str, order: Sequence[str], widths=(3, 5, 10), slope_widths=(5, 10), rows: int = blocks.ROWS) -> DataFrame:
    """Rolling, delta, slope, z-score and cross-view features of every base feature. Dealing the rows
    out by asset first serves the windows by (asset, view) and by (asset, time): one exchange. Where a stream
    has more than `rows` rows, cross-view features are dealt by (asset, time), z-scores come from sums by
    stream, and the frames of the long streams from parts."""
    keys = [asset, view]
    calm, long = blocks.split(df, keys, rows)
    framed = lambda f, by: rolling(f, by, order, widths) | deltas(f, by, order) | slopes(f, by, order, slope_widths)
    if long is None:
        placed = df.repartition(asset).withColumn("_place", F.row_number().over(_stream(keys, order)))
        columns: dict[str, Column] = {}
        for f in features:
            columns |= framed(f, keys) | zscore(f, keys) | cross_views(f, [asset, order[0]])
        return placed.select(*df.columns, *(c.alias(n) for n, c in columns.items()))
    names, crossed = list(df.columns), {}
    for f in features:
        cross = cross_views(f, [asset, order[0]])
        crossed |= cross
        names += [*framed(f, keys), *zscore(f, keys), *cross]
    out = df.select("*", *(c.alias(n) for n, c in crossed.items()))
    for f in features:
        out = zscored(out, f, keys)
    return _framed(out, keys, order, max(*widths, *slope_widths, 2), lambda by: {n: c for f in features for n, c in framed(f, by).items()}, rows).select(*names)


def all_features(df: DataFrame, features: Sequence[str], asset: str, view: str, order: Sequence[str], widths=(3, 5, 10), slope_widths=(5, 10), alphas: Sequence[float] = (0.1, 0.3, 0.5), rows: int = blocks.ROWS) -> DataFrame:
    """temporal_features and the exponential averages of every base feature, which take one scan."""
    out = temporal_features(df, features, asset, view, order, widths, slope_widths, rows)
    return ema(out, features, [asset, view], order, alphas, rows)


class _Average:
    """What a run of known values does to an exponential average s: nothing without a value; without an
    average before it the run's own; else (1 - a)^n s + c."""

    def __init__(self, alphas: Sequence[float]):
        self.alphas, self.n = alphas, 0
        self.own: list[float | None] = [None] * len(alphas)
        self.c = [0.0] * len(alphas)

    def add(self, values: list[float]) -> _Average:
        self.n += len(values)
        for k, a in enumerate(self.alphas):
            b = 1 - a
            step = lambda s, v, a=a, b=b: a * v + b * s
            self.c[k] = reduce(step, values, self.c[k])
            if values:
                self.own[k] = reduce(step, values) if self.own[k] is None else reduce(step, values, self.own[k])
        return self

    def behind(self, state: list[float | None]) -> list[float | None]:
        if not self.n:
            return state
        return [own if s is None else (1 - a) ** self.n * s + c for a, own, c, s in zip(self.alphas, self.own, self.c, state, strict=True)]


def ema(df: DataFrame, feature: str | Sequence[str], keys: Sequence[str], order: Sequence[str], alphas: Sequence[float] = (0.1, 0.3, 0.5), rows: int = blocks.ROWS) -> DataFrame:
    """y0 = x0, yt = a xt + (1 - a) yt-1 for each stream and feature: a recurrence, which no window frame
    gives. Streams arrive in order and run through one scan that carries the last values; a stream is never
    held whole. A stream of more than `rows` rows is several scans of its parts, each with the averages that
    the parts before it leave. A null value leaves the average as it was."""
    features = [feature] if isinstance(feature, str) else list(feature)
    calm, long = blocks.split(df, keys, rows)
    out = _scanned(calm, features, keys, order, alphas)
    if long is None:
        return out
    parts = blocks.dealt(long, keys, order, rows)
    values, by = [f"_x{i}" for i in range(len(features))], [f"_o{i}" for i in range(len(order))]
    narrow = parts.select(*keys, "_part", *(F.col(c).alias(n) for c, n in zip([*features, *order], [*values, *by], strict=True)))
    at = [narrow.columns.index(v) for v in values]

    def summed(averages: list[_Average], batch: pa.RecordBatch) -> list[_Average]:
        return [m.add(batch.column(k).cast(pa.float64()).drop_null().to_pylist()) for m, k in zip(averages, at, strict=True)]

    def behind(state: list[list], averages: list[_Average]) -> list[list]:
        return [m.behind(s) for s, m in zip(state, averages, strict=True)]

    none = [[None] * len(alphas) for _ in features]
    carried = blocks.carries(narrow, keys, by, lambda: [_Average(alphas) for _ in features], summed, behind, none, ArrayType(ArrayType(DoubleType())))
    return out.unionByName(_scanned(blocks.with_carry(parts, keys, carried), features, [*keys, "_part"], order, alphas, "_carry").drop("_part", "_carry"))


def _scanned(df: DataFrame, features: Sequence[str], keys: Sequence[str], order: Sequence[str], alphas: Sequence[float], carry: str | None = None) -> DataFrame:
    """Exponential averages by one ordered scan of each key; carry: a column with the averages before it."""
    names = [f"{f}_ema_{round(a * 100)}" for f in features for a in alphas]
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    places, at = [df.columns.index(k) for k in keys], [df.columns.index(f) for f in features]
    carried = df.columns.index(carry) if carry else None

    def averaged(values: pa.Array, runs: list[tuple[int, int]], states: list[list]) -> tuple[list[np.ndarray], list]:
        """By alpha the averages of all rows; states: the averages before each run, None to go on."""
        values = values.cast(pa.float64())
        known, x = values.is_valid().to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False)
        out, state = [np.full(len(values), np.nan) for _ in alphas], [None] * len(alphas)
        for (begin, end), given in zip(runs, states, strict=True):
            state = list(given)
            here = (begin + np.flatnonzero(known[begin:end])).tolist()
            # a null leaves the average as it was
            nth = np.cumsum(known[begin:end])
            new = x[here].tolist()
            for k, a in enumerate(alphas):
                b, s = 1 - a, state[k]
                seen = list(accumulate(new if s is None else [s, *new], lambda s, v, a=a, b=b: a * v + b * s))[s is not None :]
                out[k][begin:end] = np.array([np.nan if s is None else s, *seen], float)[nth]
                state[k] = seen[-1] if seen else s
        return out, state

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [[None] * len(alphas) for _ in features]
        last_key, last = object(), none
        for batch in batches:
            if not batch.num_rows:
                continue
            found = blocks.runs(batch, places)
            before = [last if key == last_key else none if carried is None else batch.column(carried)[begin].as_py() for begin, _, key in found]
            out, last_key, last = [], found[-1][2], list(none)
            for i, p in enumerate(at):
                averages, last[i] = averaged(batch.column(p), [r[:2] for r in found], [b[i] for b in before])
                out += averages
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(o, pa.float64(), mask=np.isnan(o)) for o in out)], [*batch.schema.names, *names])

    return rows.mapInArrow(scan, StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in names)]))
