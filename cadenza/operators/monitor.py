"""Causal condition monitor: deviation from an early baseline by nearest neighbours, two-view
aggregation, thresholds, and a hysteresis state machine."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from cadenza.operators import blocks
from cadenza.sources.shared import written

#: The four states: fixed values.
CONSISTENT, DEVIATION, SEVERE, INSUFFICIENT = "baseline-consistent", "deviation-observed", "persistent-severe-deviation", "insufficient-evidence"


@dataclass(frozen=True)
class Params:
    baseline: int = 288
    neighbours: int = 10
    entry: float = 0.99
    reset: float = 0.95
    persistence: int = 6
    release: int = 6


#: Values of the sensitivity variants, one parameter at a time: fixed values.
STEPS = {"baseline": (144, 576), "neighbours": (5, 20), "entry": (0.975, 0.995), "persistence": (3, 12)}


def sensitivity_variants(p: Params, steps: dict[str, tuple] = STEPS) -> list[tuple[str, Params]]:
    return [(f"{k}={v}", replace(p, **{k: v})) for k, values in steps.items() for v in values]


def robust_scaler(df: DataFrame, stream: str, order: Sequence[str], feature_array: str, baseline: int) -> DataFrame:
    """stream, feature, median, scale over the baseline rows: interquartile range, or 1.4826 MAD where
    that is 0; not usable where both are."""
    at = F.row_number().over(Window.partitionBy(stream).orderBy(*order))
    values = df.withColumn("_at", at).where(F.col("_at") <= baseline).select(stream, F.posexplode(feature_array).alias("feature", "_x")).where("_x IS NOT NULL")
    mids = values.groupBy(stream, "feature").agg(F.median("_x").alias("median"), (F.percentile("_x", F.lit(0.75)) - F.percentile("_x", F.lit(0.25))).alias("iqr"))
    mads = values.join(mids, [stream, "feature"]).groupBy(stream, "feature", "median", "iqr").agg(F.median(F.abs(F.col("_x") - F.col("median"))).alias("_mad"))
    scale = F.when(F.col("iqr") > 0, F.col("iqr")).otherwise(1.4826 * F.col("_mad"))
    return mads.select(stream, "feature", "median", scale.alias("scale"), (scale > 0).alias("usable"))


def scaled_vectors(df: DataFrame, stream: str, scaler: DataFrame, feature_array: str) -> DataFrame:
    """Adds scaled: null if a component is null or a feature of the stream is not usable. The scaler
    has one row a stream after gathering."""
    per = scaler.groupBy(stream).agg(F.sort_array(F.collect_list(F.struct("feature", "median", "scale", "usable"))).alias("_sc"))
    v = F.zip_with(feature_array, "_sc", lambda x, s: F.try_divide(x - s["median"], s["scale"]))
    good = F.forall("_sc", lambda s: s["usable"]) & F.forall(feature_array, lambda x: x.isNotNull()) & (F.size(feature_array) == F.size("_sc"))
    return df.join(per, stream).withColumn("scaled", F.when(good, v)).drop("_sc")


def knn_scores(df: DataFrame, stream: str, order: Sequence[str], key: str, baseline: int, k: int, block: int = 65_536) -> DataFrame:
    """score: median distance of each row's scaled vector to its k nearest among the stream's first
    `baseline` rows, itself left out. A stream whose baseline isn't complete, with a vector for each of
    its rows, has no scores.

    A stream is dealt into blocks of rows, and each block gets a copy of the baseline, which stands
    before its rows; so a long stream is many tasks, and a scan holds a baseline and a batch."""
    place = F.row_number().over(Window.partitionBy(stream).orderBy(*order))
    numbered = df.withColumn("place", place).withColumns({"_block": F.floor((F.col("place") - 1) / block), "_base": F.lit(False)})
    last = numbered.groupBy(F.col(stream).alias("_stream")).agg(F.max("_block").alias("_last"))
    base = numbered.where(F.col("place") <= baseline).join(last, F.col(stream).eqNullSafe(F.col("_stream"))).withColumns({"_block": F.explode(F.sequence(F.lit(0).cast("long"), "_last")), "_base": F.lit(True)})
    both = numbered.unionByName(base.select(*numbered.columns))
    rows = both.repartition(stream, "_block").sortWithinPartitions(stream, "_block", F.col("_base").desc(), "place")
    names = rows.columns
    at = {c: names.index(c) for c in (stream, "_block", "_base", key, "scaled")}
    keep = [c for c in names if not c.startswith("_")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, whole = object(), [], [], None
        for batch in batches:
            of = list(zip(batch.column(at[stream]).to_pylist(), batch.column(at["_block"]).to_pylist(), batch.column(at["_base"]).to_pylist(), strict=True))
            score = np.full(len(of), np.nan)
            begin = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1]), len(of)]
            for a, b in zip(begin, begin[1:], strict=False):
                if b == a:
                    continue
                if of[a][:2] != now:
                    now, ids, vectors, whole = of[a][:2], [], [], None
                some, own = _matrix(batch.column(at["scaled"]).slice(a, b - a)), batch.column(at[key]).slice(a, b - a).to_pylist()
                if of[a][2]:
                    ids += own
                    vectors.append(some)
                    continue
                if whole is None:
                    whole = np.concatenate(vectors) if len({v.shape[1] for v in vectors}) == 1 else np.zeros((0, 0))
                    whole = whole if len(whole) == baseline and not np.isnan(whole).any() else np.zeros((0, 0))
                    number = {x: i for i, x in enumerate(ids)}
                if len(whole):
                    score[a:b] = _nearest(whole, some, np.array([number.get(x, -1) for x in own]), k)
            rows_kept = np.array([not o[2] for o in of])
            out = batch.select(keep).append_column("score", pa.array(score, pa.float64(), mask=np.isnan(score)))
            yield out.filter(pa.array(rows_kept))

    fields = [f for f in rows.schema.fields if f.name in keep]
    return rows.mapInArrow(scan, StructType([*fields, StructField("score", DoubleType())]))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows, from Arrow's flat values; a null vector is a row of NaN."""
    valid = np.asarray(vectors.is_valid())
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.full((len(valid), len(flat) // max(1, int(valid.sum()))), np.nan)
    out[valid] = flat.reshape(int(valid.sum()), -1)
    return out


def _nearest(base: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int, step: int = 64) -> np.ndarray:
    """The median of the k least distances from each vector to the base, without the base row `own` (-1: none)."""
    out = np.full(len(vectors), np.nan)
    known = np.flatnonzero(~np.isnan(vectors).any(1)) if vectors.shape[1] == base.shape[1] else np.zeros(0, int)
    for a in range(0, len(known), step):
        some = known[a : a + step]
        d = np.sqrt(((vectors[some][:, None] - base[None]) ** 2).sum(2))
        mine = np.flatnonzero(own[some] >= 0)
        d[mine, own[some][mine]] = np.inf
        if k <= d.shape[1]:
            near = np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1)
            good = np.isfinite(near[:, -1])
            out[some[good]] = np.median(near[good], axis=1)
    return out


def fused(a: Column, b: Column | float, c: Column) -> Column:
    """a * b + c rounded once, from the exact parts of the product and the sum."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    high = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    p = a * b
    low = (a - high(a)) * (b - high(b)) - (((p - high(a) * high(b)) - (a - high(a)) * high(b)) - high(a) * (b - high(b)))
    total = p + c
    part = total - p
    out = total + (((p - (total - part)) + (c - part)) + low)
    # the parts of very large values aren't finite
    return F.when(F.abs(out) < float("inf"), out).otherwise(total)


def thresholds(df: DataFrame, stream: str, baseline: int, entry: float = 0.99, reset: float = 0.95) -> DataFrame:
    """Linear quantiles of the baseline's scores; null unless all `baseline` of them are there. They are
    rounded as DuckDB's quantile_cont rounds them, for scores that equal a threshold decide by its last bit."""
    if reset > entry:
        raise ValueError("the reset level would lie above the threshold")

    def quantile(q: float) -> Column:
        at = (baseline - 1) * q
        low, high = math.floor(at), math.ceil(at)
        value = lambda k: F.get("_sorted", F.lit(k))
        return F.when(F.size("_sorted") == baseline, value(low) if low == high else fused(value(low), 1 - (at - low), value(high) * (at - low)))

    early = df.where(F.col("place") <= baseline).groupBy(stream).agg(F.sort_array(F.collect_list(F.col("score").cast("double"))).alias("_sorted"))
    return early.select(stream, quantile(entry).alias("threshold"), quantile(reset).alias("reset"))


def two_view_score(df: DataFrame, keys: Sequence[str], channel: str, views: int = 2) -> DataFrame:
    """Fixed equal weights over the views of a key; null unless each of so many different channels
    gives one score, and nothing else is there."""
    complete = (F.count("score") == views) & (F.count(F.lit(1)) == views) & (F.count_distinct(channel) == views)
    return df.groupBy(*keys).agg(F.when(complete, F.sum(F.col("score") / views)).alias("score"))


def view_violations(df: DataFrame, keys: Sequence[str], channel: str, expected: Sequence) -> DataFrame:
    """Keys whose channels repeat, or are others than the expected pair that holds the least of them:
    keys, channels. expected: pairs of channels."""
    pair = F.lit(None).cast("array<int>")
    for p in expected:
        pair = F.when(F.array_contains(F.array(*map(F.lit, p)), F.array_min("channels")), F.array(*map(F.lit, p))).otherwise(pair)
    by = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(channel).cast("int"))).alias("channels"))
    bad = (F.size(F.array_distinct("channels")) != F.size("channels")) | pair.isNull() | (F.size(F.array_except("channels", pair)) > 0)
    return by.where(F.coalesce(bad, F.lit(True))).select(*keys, "channels")


class Hysteresis:
    """The state machine as maps on its states, 0 to persistence - 1: so many scores in a row above the
    threshold, not severe; then release more: severe, with so many scores in a row at or below the reset level.
    A row is one of five symbols, a stretch of rows the map that its symbols' maps make one after the other."""

    def __init__(self, persistence: int, release: int):
        self.persistence, self.release = persistence, release
        n = persistence + release
        calm, severe = np.arange(n) < persistence, np.arange(n) >= persistence
        at = np.arange(n)
        low = np.where(severe, np.where(at + 1 < n, at + 1, 0), 0)
        neither = np.where(severe, persistence, 0)
        above = np.where(calm, at + 1, persistence)
        above_low = np.where(calm, at + 1, low)
        #: symbols: no evidence; at or below the reset level; above the threshold; neither; both
        self.maps = np.array([np.zeros(n, int), low, above, neither, above_low])

    def symbols(self, score: np.ndarray, threshold: np.ndarray, reset: np.ndarray, early: np.ndarray) -> np.ndarray:
        """Nulls are NaN."""
        with np.errstate(invalid="ignore"):
            low, high = score <= reset, score > threshold
        return np.where(early | np.isnan(score) | np.isnan(threshold), 0, np.select([low & high, high, low], [4, 2, 1], 3))

    def composed(self, symbols: np.ndarray) -> np.ndarray:
        """The map of a stretch, by a tree of pairs."""
        maps = self.maps[symbols]
        while len(maps) > 1:
            even = len(maps) // 2 * 2
            pairs = np.take_along_axis(maps[1:even:2], maps[0:even:2], axis=1)
            maps = np.concatenate([pairs, maps[even:]])
        return maps[0] if len(maps) else np.arange(self.maps.shape[1])

    def states(self, symbols: np.ndarray, start: int, step: int = 64) -> np.ndarray:
        """The state behind every row: stretches of `step` rows side by side, then one behind the other."""
        n = len(symbols)
        rows = -(-n // step)
        padded = np.concatenate([symbols, np.full(rows * step - n, 3)]).reshape(rows, step)
        reached = np.empty((step, rows, self.maps.shape[1]), np.int64)
        now = np.broadcast_to(np.arange(self.maps.shape[1]), (rows, self.maps.shape[1]))
        for k in range(step):
            now = reached[k] = np.take_along_axis(self.maps[padded[:, k]], now, axis=1)
        starts = np.empty(rows, np.int64)
        for r in range(rows):
            starts[r] = start
            start = now[r, start]
        return reached[:, np.arange(rows), starts].T.ravel()[:n]

    def named(self, symbols: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Name, consecutive and released of every row."""
        severe = states >= self.persistence
        over = np.isin(symbols, (2, 4)) & (states > 0)
        name = np.select([symbols == 0, severe, over], [INSUFFICIENT, SEVERE, DEVIATION], CONSISTENT)
        return name, np.where(severe, self.persistence, states), np.where(severe, states - self.persistence, 0)


def monitor_states(df: DataFrame, stream: str, order: Sequence[str], persistence: int = 6, release: int = 6, rows: int = blocks.ROWS) -> DataFrame:
    """df: score, threshold, reset, place, baseline rows marked by in_baseline. Adds state, consecutive
    and released, from two counters and a flag that go from row to row:
    no evidence resets all; while severe, `release` scores in a row at or below the reset level end it;
    otherwise `persistence` scores in a row above the threshold begin it. Both are 1 at least. A stream of
    more than `rows` rows is several parts, each summed up as a map of states."""
    if min(persistence, release) < 1:
        raise ValueError("persistence and release are 1 at least")
    machine = Hysteresis(persistence, release)
    calm, long = blocks.split(df, [stream], rows)
    out = _stated(calm, machine, [stream], order)
    if long is None:
        return out
    parts = blocks.dealt(long, [stream], order, rows)
    by = [f"_o{i}" for i in range(len(order))]
    narrow = parts.select(stream, "_part", *(F.col(c).alias(f"_{c}") for c in EVIDENCE), *(F.col(c).alias(o) for c, o in zip(order, by, strict=True)))
    at = [narrow.columns.index(f"_{c}") for c in EVIDENCE]
    carried = blocks.carries(narrow, [stream], by, lambda: None, lambda m, batch: _followed(m, machine.composed(_symbols(machine, batch, at))), lambda s, m: int(m[s]), 0, LongType())
    return out.unionByName(_stated(blocks.with_carry(parts, [stream], carried), machine, [stream, "_part"], order, "_carry").drop("_part", "_carry"))


EVIDENCE = ("score", "threshold", "reset", "in_baseline")


def _followed(first: np.ndarray | None, then: np.ndarray) -> np.ndarray:
    return then if first is None else then[first]


def _symbols(machine: Hysteresis, batch: pa.RecordBatch, at: Sequence[int]) -> np.ndarray:
    number = lambda k: batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False)
    early = batch.column(at[3]).fill_null(False).to_numpy(zero_copy_only=False)
    return machine.symbols(number(at[0]), number(at[1]), number(at[2]), early)


def _stated(df: DataFrame, machine: Hysteresis, keys: Sequence[str], order: Sequence[str], carry: str | None = None) -> DataFrame:
    """The states of each key's rows by one ordered scan; carry: a column with the state before them."""
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = rows.columns
    at, places, first = [names.index(c) for c in EVIDENCE], [names.index(k) for k in keys], names.index(carry) if carry else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), 0
        for batch in batches:
            symbols = _symbols(machine, batch, at)
            states = np.zeros(batch.num_rows, np.int64)
            for a, b, key in blocks.runs(batch, places):
                if key != now:
                    now, last = key, batch.column(first)[a].as_py() if first is not None else 0
                states[a:b] = machine.states(symbols[a:b], last)
                last = int(states[b - 1])
            name, up, down = machine.named(symbols, states)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name.tolist(), pa.string()), pa.array(up), pa.array(down)], [*names, "state", "consecutive", "released"])

    return rows.mapInArrow(scan, StructType([*rows.schema.fields, StructField("state", StringType()), StructField("consecutive", LongType()), StructField("released", LongType())]))


def state_counts(df: DataFrame, stream: str) -> DataFrame:
    names = {"consistent": CONSISTENT, "deviation": DEVIATION, "severe": SEVERE, "insufficient": INSUFFICIENT}
    return df.groupBy(stream).agg(*(F.count_if(F.col("state") == v).alias(k) for k, v in names.items()))


def clock_disagreement(df: DataFrame, stream: str, ts: str, alert: str, after_s: float = 604_800, every: int = 144, baseline: int = 288) -> DataFrame:
    """By stream: rows where an elapsed-time schedule and the alert differ, alert rows, rows due for
    inspection."""
    elapsed = F.timestamp_diff("MICROSECOND", F.min(ts).over(Window.partitionBy(stream)), F.col(ts)) / F.lit(1e6)
    place = F.row_number().over(Window.partitionBy(stream).orderBy(ts)) - 1
    rows = df.withColumns({"_clock": elapsed >= after_s, "_due": (place >= baseline) & ((place - baseline) % every == 0)})
    return rows.groupBy(stream).agg(F.count_if(F.col("_clock") != F.col(alert)).alias("disagreements"), F.count_if(F.col(alert)).alias("alerts"), F.count_if("_due").alias("inspections"))


def burden_order(df: DataFrame, stream: str, alert: str) -> DataFrame:
    """Share of alert rows by stream, and the rank by falling share."""
    by = df.groupBy(stream).agg(F.avg(F.col(alert).cast("double")).alias("burden"))
    return by.select("*", F.row_number().over(Window.orderBy(F.col("burden").desc(), stream)).alias("rank"))


def aggregate_scores(df: DataFrame, asset: str, channel: str, ts: str, key: str, features: str, baseline: int, neighbours: int) -> DataFrame:
    """asset, ts, score, place: each (asset, channel) is a stream of feature arrays with its own scaler
    and baseline; the scores of an asset's two channels at a time are averaged."""
    rows = df.select(F.struct(F.col(asset).alias("a"), F.col(channel).alias("c")).alias("stream"), F.col(asset).alias("asset"), F.col(channel).alias("channel"), F.col(ts).alias("ts"), F.col(key).alias("key"), F.col(features).alias("v"))
    scaled = scaled_vectors(rows, "stream", robust_scaler(rows, "stream", ["ts", "key"], "v", baseline), "v")
    scores = knn_scores(scaled.select("stream", "asset", "channel", "ts", "key", "scaled"), "stream", ["ts", "key"], "key", baseline, neighbours)
    return two_view_score(scores, ["asset", "ts"], "channel").withColumn("place", F.row_number().over(Window.partitionBy("asset").orderBy("ts")))


def judged_scores(scores: DataFrame, p: Params) -> DataFrame:
    """aggregate_scores with threshold, reset, state, consecutive, released: thresholds on an asset's first
    `p.baseline` times, then the state machine."""
    rows = scores.join(thresholds(scores, "asset", p.baseline, p.entry, p.reset), "asset").withColumn("in_baseline", F.col("place") <= p.baseline)
    return monitor_states(rows, "asset", ["place"], p.persistence, p.release).drop("in_baseline")


def monitored(df: DataFrame, asset: str, channel: str, ts: str, key: str, features: str, p: Params = Params()) -> DataFrame:  # noqa: B008
    """The whole monitor: scores and what they are judged."""
    return judged_scores(aggregate_scores(df, asset, channel, ts, key, features, p.baseline, p.neighbours), p)


def sensitivity(df: DataFrame, asset: str, channel: str, ts: str, key: str, features: str, p: Params = Params(), steps: dict[str, tuple] = STEPS) -> DataFrame:  # noqa: B008
    """State counts by variant and asset: the parameters themselves and each one-at-a-time variant. Scores
    are computed once for each baseline and number of neighbours, and written, for variants share them."""
    variants = [("primary", p), *sensitivity_variants(p, steps)]
    scores: dict[tuple, DataFrame] = {}
    out = None
    for name, v in variants:
        of = (v.baseline, v.neighbours)
        if of not in scores:
            scores[of] = written(aggregate_scores(df, asset, channel, ts, key, features, *of), "scores")
        one = state_counts(judged_scores(scores[of], v), "asset").select(F.lit(name).alias("variant"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def order_stability(counts: DataFrame) -> DataFrame:
    """counts: variant, asset and the state counts of sensitivity(). Assets in order of their share of
    severe rows, falling, for each variant, and whether that is the primary's order. A variant has a row
    an asset."""
    share = F.col("severe") / (F.col("consistent") + F.col("deviation") + F.col("severe") + F.col("insufficient"))
    order = F.transform(F.sort_array(F.collect_list(F.struct((-share).alias("s"), "asset"))), lambda x: x["asset"])
    orders = counts.groupBy("variant").agg(order.alias("order"))
    primary = F.max(F.when(F.col("variant") == "primary", F.col("order"))).over(Window.partitionBy())  # a row a variant
    return orders.select("variant", "order", (F.col("order") == primary).alias("as_primary"))


#: Where the 14 values that the monitor compares begin among a channel's 34: fixed values.
FIRST_VALUE, N_VALUES = 21, 14


def compared_values(feature_values: Column) -> Column:
    """Mean and deviation of the registry's 11th to 17th feature."""
    return F.slice(feature_values, FIRST_VALUE, N_VALUES)


def retrospective(states: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What the monitor had said of assets whose end is known. states: asset, ts, state; outcomes: asset,
    end (a time or a number like ts), damaged. By asset of outcomes: first_severe, the distance from it to
    the end, whether a damaged asset was missed, and the share of its rows without enough evidence. An
    asset without rows has nulls and, if damaged, was missed."""
    severe, unknown = F.col("state") == SEVERE, F.col("state") == INSUFFICIENT
    by = states.groupBy(F.col("asset").alias("_asset")).agg(F.min(F.when(severe, F.col("ts"))).alias("first_severe"), F.avg(unknown.cast("double")).alias("abstained"))
    met = outcomes.select("asset", "end", "damaged").join(by, F.col("asset") == F.col("_asset"), "left")
    lead = F.timestamp_diff("MICROSECOND", F.col("first_severe"), F.col("end")) / 1e6 if dict(outcomes.dtypes)["end"].startswith("timestamp") else F.col("end") - F.col("first_severe")
    return met.select("asset", "damaged", "first_severe", lead.alias("lead"), (F.col("damaged") & F.col("first_severe").isNull()).alias("missed"), "abstained")
