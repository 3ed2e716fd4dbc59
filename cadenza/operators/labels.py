"""Labels, splits and leakage-safe folds over streams, as window and join plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(later: Column, earlier: Column) -> Column:
    """Exact elapsed seconds of two timestamps without zone."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)


def rul_labels(df: DataFrame, asset: str, ts: str, failed: Column) -> DataFrame:
    """rul_seconds and rul_hours to the asset's last row, null for assets that didn't fail; failed and
    censored come from one expression, so they always complement each other."""
    end = F.max(ts).over(Window.partitionBy(asset))
    left = F.when(failed, seconds(end, F.col(ts)))
    return df.select("*", failed.alias("failed"), (~failed).alias("censored"), left.alias("rul_seconds"), (left / 3600).alias("rul_hours"))


def label_quality(df: DataFrame, keys: Sequence[str], order: Sequence[str], target: str) -> DataFrame:
    """By stream: rows, missing targets, repeated times, times the target rises, first and last time."""
    rise = F.col(target) - F.lag(target).over(Window.partitionBy(*keys).orderBy(*order)) > 1e-9
    ts = order[0]
    return df.withColumn("_rise", rise).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(target).isNull()).alias("missing"), (F.count(F.lit(1)) - F.count_distinct(ts)).alias("duplicate_ts"),
        F.count_if("_rise").alias("increases"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
    )


def split_at(df: DataFrame, ts: str, cut: str) -> DataFrame:
    return df.withColumn("split", F.when(F.col(ts) < F.lit(cut).cast("timestamp_ntz"), "train").otherwise("test"))


def split_global(df: DataFrame, order: Sequence[str], share: float, parts: int = 4096, direct: int = 100_000) -> DataFrame:
    """Train are the rows before the time of row int(share * n) in time order.

    Rows are counted by `parts` stretches of equal time; only the stretch with the deciding row is
    looked at again, in the same way, until it has `direct` rows at most or one time. So no task orders
    more than those."""
    ts = order[0]
    micros = df.where(F.col(ts).isNotNull()).select(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts)).alias("_t"))
    low, high, n = micros.agg(F.min("_t"), F.max("_t"), F.count(F.lit(1))).first()
    left = int(share * (n or 0))
    while n and n > direct and low < high:
        width = (high - low) // parts + 1
        inside = micros.where(F.col("_t").between(low, high))
        counts = inside.groupBy(F.expr(f"(_t - {low}L) div {width}L").alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        placed = counts.select("_part", "_n", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # parts rows at most
        part, n, before = placed.where((F.col("_before") <= left) & (F.col("_before") + F.col("_n") > left)).first()
        left, low, high = left - before, low + part * width, min(high, low + part * width + width - 1)
    deciding = micros.where(F.col("_t").between(low, high)).orderBy("_t").offset(left).limit(1).first() if n else None
    if deciding is None:
        return df.withColumn("split", F.lit("test"))
    cut = F.timestamp_add("MICROSECOND", F.lit(deciding[0]), F.lit("1970-01-01").cast("timestamp_ntz"))
    return df.withColumn("split", F.when(F.col(ts) < cut, "train").otherwise("test"))


def split_by_stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], share: float) -> DataFrame:
    place, n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("split", F.when(place <= F.floor(n * share), "train").otherwise("test"))


#: Right-closed bins of hours to the end: fixed values.
RUL_BINS = (0, 50, 100, 150, 200, 300, 400, 600, 850)
#: Left-closed bins of the tuned evaluation: fixed values.
RANGE_BINS = (0, 50, 100, 150, 200, 300, 500, 850)


def right_closed_bin(x: Column, edges: Sequence[float] = RUL_BINS) -> Column:
    """'lo-hi' of the bin (lo, hi] (the first includes lo), null outside."""
    out = F.when((x >= edges[0]) & (x <= edges[1]), f"{edges[0]}-{edges[1]}")
    for a, b in zip(edges[1:], edges[2:], strict=False):
        out = out.when((x > a) & (x <= b), f"{a}-{b}")
    return out


def left_closed_bin(x: Column, edges: Sequence[float] = RANGE_BINS) -> Column:
    """'lo-hi' of the bin [lo, hi), null outside."""
    out = F.when(F.lit(False), "")
    for a, b in zip(edges, edges[1:], strict=False):
        out = out.when((x >= a) & (x < b), f"{a}-{b}")
    return out


def split_stratified(df: DataFrame, stratum: Column, key: str, share: float, seed: int = 42, digits: int = 3) -> DataFrame:
    """Of each stratum the first int(share * n) rows in order of a seeded hash train; rows without
    stratum train too.

    Rows are counted by stratum and leading hex digits of the hash; all of a stratum's prefixes but one
    lie on one side of the cut, and only the rows of that one are ranked."""
    hashed = df.withColumns({"_stratum": stratum, "_hash": F.sha2(F.concat_ws("-", F.lit(seed), F.col(key)), 256)}).withColumn("_prefix", F.substring("_hash", 1, digits))
    counts = hashed.where("_stratum IS NOT NULL").groupBy("_stratum", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    of_stratum = Window.partitionBy("_stratum")
    # 16 ** digits rows a stratum at most
    before = counts.select(F.col("_stratum").alias("_s"), F.col("_prefix").alias("_p"), "_n", (F.sum("_n").over(of_stratum.orderBy("_prefix")) - F.col("_n")).alias("_before"), F.floor(F.sum("_n").over(of_stratum) * share).alias("_take"))
    met = hashed.join(before, (F.col("_stratum") == F.col("_s")) & (F.col("_prefix") == F.col("_p")), "left")
    sure = F.when(F.col("_stratum").isNull() | (F.col("_before") + F.col("_n") <= F.col("_take")), "train").when(F.col("_before") >= F.col("_take"), "test")
    marked = met.withColumn("split", sure)
    rank = F.row_number().over(Window.partitionBy("_stratum", "_prefix").orderBy("_hash", key))
    ranked = marked.where("split IS NULL").withColumn("split", F.when(F.col("_before") + rank <= F.col("_take"), "train").otherwise("test"))
    return marked.where("split IS NOT NULL").select(*df.columns, "split").unionByName(ranked.select(*df.columns, "split"))


def split_report(df: DataFrame, ts: str = "ts") -> DataFrame:
    """By split: rows, their share of all, time range; and whether train ends before test begins."""
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    everything = Window.partitionBy()
    train_end, test_begin = F.max(F.when(F.col("split") == "train", F.col("last_ts"))).over(everything), F.min(F.when(F.col("split") == "test", F.col("first_ts"))).over(everything)
    return counts.select("*", (100.0 * F.col("n") / F.sum("n").over(everything)).alias("pct"), (train_end < test_begin).alias("no_leak"))


def leave_one_out_folds(df: DataFrame, asset: str) -> DataFrame:
    """(fold, train rows, test rows, assets in train): fold k tests asset k. Sizes come from counts by
    asset; rows meet a fold only when a model is fitted."""
    by = df.groupBy(asset).agg(F.count(F.lit(1)).alias("n_test"))
    everything = Window.partitionBy()
    return by.select(F.col(asset).alias("fold"), "n_test", (F.sum("n_test").over(everything) - F.col("n_test")).alias("n_train"), (F.count(F.lit(1)).over(everything) - 1).alias("train_assets"))


def purged_folds(df: DataFrame, asset: str, ts: str, folds: int = 5, gap: int = 30) -> DataFrame:
    """A row for each row and fold: role test, train, or purged (within gap positions of the asset's
    test block). Positions count distinct times; blocks are contiguous and of even size."""
    times = df.select(asset, ts).distinct()
    order = Window.partitionBy(asset).orderBy(ts)
    placed = times.select(asset, ts, F.row_number().over(order).alias("_at"), F.ntile(folds).over(order).alias("_block"))
    blocks = placed.groupBy(asset, F.col("_block").alias("fold")).agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    at = F.col("_at")
    role = F.when(at.between(F.col("_from"), F.col("_to")), "test").when(at.between(F.col("_from") - gap, F.col("_to") + gap), "purged").otherwise("train")
    return df.join(placed.drop("_block"), [asset, ts]).join(blocks, asset).select(*df.columns, "fold", role.alias("role"))


def purged_blocks(df: DataFrame, asset: str, ts: str, folds: int = 5, gap: int = 30) -> DataFrame:
    """The folds of purged_folds with a row for each row instead of one for each row and fold: fold, the one
    that tests the row, and trains, the folds that train on it. Rows go once by asset, and not by fold."""
    times, whole = Window.partitionBy(asset).orderBy(ts), Window.partitionBy(asset)
    placed = df.withColumn("_at", F.dense_rank().over(times)).withColumn("_times", F.max("_at").over(whole)).where(F.col(asset).isNotNull() & F.col(ts).isNotNull())
    at, n = F.col("_at"), F.col("_times")
    least, more = F.floor(n / folds), n % folds  # the first `more` blocks have a place more, as in ntile

    def inside(k: int, wider: int) -> Column:
        begin, end = (k - 1) * least + F.least(F.lit(k - 1), more) + 1, k * least + F.least(F.lit(k), more)
        return at.between(begin - wider, end + wider)

    fold = F.coalesce(*(F.when(inside(k, 0), k) for k in range(1, folds + 1)))
    # joined arrays, for a filter of one is interpreted row by row, with all that is in it
    trains = F.concat(*(F.when((n >= k) & ~inside(k, gap), F.array(F.lit(k))).otherwise(F.array().cast("array<int>")) for k in range(1, folds + 1)))
    return placed.select(*df.columns, fold.alias("fold"), trains.alias("trains"))


def nearest_train_gap(folds: DataFrame, asset: str, ts: str) -> DataFrame:
    """By fold and asset: the least distance in positions from a test time to a train time."""
    order = Window.partitionBy("fold", asset).orderBy(ts)
    placed = folds.select("fold", asset, ts, "role").distinct().withColumn("_at", F.row_number().over(order))
    train = F.when(F.col("role") == "train", F.col("_at"))
    back = F.last(train, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(train, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return placed.withColumns({"_b": F.col("_at") - back, "_a": ahead - F.col("_at")}).where("role = 'test'").groupBy("fold", asset).agg(F.min(F.least("_b", "_a")).alias("min_gap"))


def fold_overlap(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By fold: distinct keys that are both in train and in test."""
    has = lambda role: F.bool_or(F.col("role") == role)
    return folds.where("role != 'purged'").groupBy("fold", *keys).agg((has("train") & has("test")).alias("_both")).groupBy("fold").agg(F.count_if("_both").alias("overlap"))


def fitted_zscore(folds: DataFrame, feature: str, keys: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """z-scores of the train and test rows of a fold, fitted on its train rows. The mean is that of the
    row's group, of the whole fold for a group without train values; the deviation likewise, and also
    the fold's for a group of one value or without spread; 1e-8 is added to it, and stands in for a
    fold without spread. fitted_on: the same rows with fewer columns, where folds are costly to make."""
    train = (folds if fitted_on is None else fitted_on).where("role = 'train'")
    stats = lambda *by: train.groupBy(*by).agg(F.avg(feature).alias("_m"), F.stddev_samp(feature).alias("_s"))
    whole = stats("fold").withColumnsRenamed({"_m": "_gm", "_s": "_gs"})
    rows = folds.where("role != 'purged'").join(stats("fold", *keys), ["fold", *keys], "left").join(whole, "fold", "left")
    dev = F.when(F.col("_s") > 0, F.col("_s")).when(F.col("_gs") > 0, F.col("_gs")).otherwise(1e-8)
    return rows.select(*folds.columns, ((F.col(feature) - F.coalesce("_m", "_gm")) / (dev + 1e-8)).alias(f"{feature}_z"))


def leave_one_out_rows(df: DataFrame, asset: str, wanted: Column | None = None, folds: int = 200, rows: int = 65_536) -> DataFrame:
    """A row for each row and fold, with its role; fold k tests asset k, all others train. The folds are
    as many as the assets, so the rows multiply by them; wanted, a condition on fold, takes a few at a time.

    A task crosses about `rows` rows with about `folds` folds and holds the folds alone, so tasks are many
    and none grows with the table. Few different values, each row's folds in the same order, also pack well:
    at most 256 folds fill a byte of a column's dictionary, and they come around often within its pages."""
    by = df.groupBy(F.col(asset).alias("fold")).agg(F.count(F.lit(1)).alias("_n"))
    keep = F.lit(True) if wanted is None else wanted
    n, n_folds = by.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count_if(keep)).first()
    parts = max(1, -(-n_folds // folds))
    dealt = df.repartition(max(-(-n // rows), -(-8 * df.sparkSession.sparkContext.defaultParallelism // parts)))
    crossed = dealt.join(by.where(keep).select("fold").repartition(parts).hint("shuffle_replicate_nl"), F.lit(True))
    return crossed.withColumn("role", F.when(F.col("fold") == F.col(asset), "test").otherwise("train"))


def validated_labels(features: DataFrame, labels: DataFrame, keys: Sequence[str], columns: Sequence[str], required: str) -> tuple[DataFrame, DataFrame]:
    """Label columns joined to feature rows one to one, and the violations that forbid it: keys that a
    side repeats (repeated features, repeated labels) and feature keys that get no value of `required`
    (missing label), each with its rows."""
    label = labels.select(*keys, *columns)
    joined = features.join(label, list(keys), "left")
    repeated = lambda d, problem: d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.lit(problem).alias("problem"), "n")
    missing = joined.where(F.col(required).isNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.lit("missing label").alias("problem"), "n")
    return joined, repeated(features, "repeated features").unionByName(repeated(labels, "repeated labels")).unionByName(missing)
