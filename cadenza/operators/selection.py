"""Feature relevance, redundancy and drift on long-form values (feature, id, value)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.quantiles import quantile_row
from cadenza.sources.shared import written


def safe_corr(a: str, b: str) -> Column:
    """Pearson; null for fewer than two pairs or no variance."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y))


def average_rank(value: str, *by: str) -> Column:
    """Rank with ties at their mean place."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def ranked(values: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the average rank of a column within each feature. The distinct values are dealt into ranges
    by (feature, value); a range counts its own, and what stands before it is a sum over ranges. So a
    feature is as many tasks as it has ranges, and no task orders a whole feature."""
    distinct = values.groupBy("feature", column).agg(F.count(F.lit(1)).alias("_n"))
    # written, for ranges must stay as they are while they are read twice
    dealt = written(distinct.repartitionByRange("feature", column).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(F.col("feature").alias("_f"), F.col("_part").alias("_p")).agg(F.sum("_n").alias("_in"))
    parts = parts.withColumn("_before", F.sum("_in").over(Window.partitionBy("_f").orderBy("_p")) - F.col("_in"))
    inside = F.sum("_n").over(Window.partitionBy("feature", "_part").orderBy(column)) - F.col("_n")
    met = dealt.join(parts, (F.col("feature") == F.col("_f")) & (F.col("_part") == F.col("_p")))
    ranks = met.select(F.col("feature").alias("_f"), F.col(column).alias("_v"), (F.col("_before") + inside + (F.col("_n") + 1) / 2).alias(name))
    return values.join(ranks, (F.col("feature") == F.col("_f")) & (F.col(column) == F.col("_v"))).drop("_f", "_v")


def relevance(values: DataFrame, least: int = 10) -> DataFrame:
    """values: feature, value, y. Pearson, Spearman, and the larger magnitude as score, from the rows in
    which both are finite; null where one has no variance, no row for fewer than `least` rows."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.lit(False))
    rows = ranked(ranked(values.where(finite("value") & finite("y")), "value", "_rv"), "y", "_ry")
    out = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), safe_corr("value", "y").alias("pearson"), safe_corr("_rv", "_ry").alias("spearman")).where(F.col("n") >= least)
    return out.select("*", F.greatest(F.abs("pearson"), F.abs("spearman")).alias("score"))


def pairwise_correlation(values: DataFrame, key: str) -> DataFrame:
    """feature_i < feature_j: their correlation over the keys that have both. A key's values are one row;
    a task adds up products of whole batches and gives one row a pair. So what moves is the rows once,
    and pairs by tasks, never pairs by rows. The number of features is a driver's list. Of values that repeat a
    key and a feature the largest counts."""
    centre = values.where("value IS NOT NULL").groupBy("feature").agg(F.avg("value").alias("m"))
    names = sorted((r["feature"], r["m"]) for r in centre.collect())
    number, mean = {n: k for k, (n, _) in enumerate(names)}, np.array([m for _, m in names], float)
    f = len(names)
    rows = values.where("value IS NOT NULL").groupBy(key).agg(F.collect_list("feature").alias("_f"), F.collect_list("value").alias("_v")).select("_f", "_v")
    if not f:
        return values.sparkSession.createDataFrame([], "feature_i string, feature_j string, corr double")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, f, f))
        for batch in batches:
            lists = batch.column(0)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            column = np.fromiter(map(number.__getitem__, lists.flatten().to_pylist()), np.int64, len(row))
            x, m = np.zeros((batch.num_rows, f)), np.zeros((batch.num_rows, f))
            value = batch.column(1).flatten().to_numpy()
            order = np.argsort(value, kind="stable")
            row, column = row[order], column[order]
            x[row, column], m[row, column] = value[order] - mean[column], 1
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        i, j = np.triu_indices(f, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(v) for v in (total[0][i, j], total[1][i, j], total[1][j, i], total[2][i, j], total[2][j, i], total[3][i, j]))], ["i", "j", "n", "a", "b", "aa", "bb", "ab"])

    sums = rows.mapInArrow(add, "i int, j int, n double, a double, b double, aa double, bb double, ab double").groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab"))).where("n > 0")
    va, vb = F.col("aa") - F.col("a") * F.col("a") / F.col("n"), F.col("bb") - F.col("b") * F.col("b") / F.col("n")
    tiny = 1e-13
    corr = F.when((F.col("n") > 1) & (va > tiny * F.col("aa")) & (vb > tiny * F.col("bb")), (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.sqrt(va * vb))
    label = F.array(*(F.lit(n) for n, _ in names))
    return sums.select(F.get(label, F.col("i")).alias("feature_i"), F.get(label, F.col("j")).alias("feature_j"), corr.alias("corr"))


def redundant(values: DataFrame, scores: DataFrame, key: str, limit: float = 0.95) -> DataFrame:
    """Of each pair above the limit, the feature with the lower score goes; of equals, the second."""
    s = scores.select("feature", "score")
    pairs = pairwise_correlation(values, key).where(F.abs("corr") > limit)
    pairs = pairs.join(s.withColumnsRenamed({"feature": "feature_i", "score": "_si"}), "feature_i").join(s.withColumnsRenamed({"feature": "feature_j", "score": "_sj"}), "feature_j")
    return pairs.select(F.when(F.col("_si") < F.col("_sj"), F.col("feature_i")).otherwise(F.col("feature_j")).alias("feature")).distinct()


def select_top(scores: DataFrame, gone: DataFrame, n: int) -> DataFrame:
    """The n best features by score that aren't redundant, ranked."""
    left = scores.join(gone, "feature", "left_anti")
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "feature"))
    return left.orderBy(F.col("score").desc(), "feature").limit(n).select(rank.alias("rank"), "feature", "score")


def combined_scores(correlation: DataFrame, information: DataFrame) -> DataFrame:
    """feature, score: the mean of a feature's two scores (feature, score), 0 for one that it lacks."""
    a, b = correlation.select("feature", F.col("score").alias("_a")), information.select("feature", F.col("score").alias("_b"))
    return a.join(b, "feature", "full").select("feature", ((F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))) / 2).alias("score"))


def select_filled(scores: DataFrame, gone: DataFrame, spare: DataFrame, n: int) -> DataFrame:
    """rank, feature, score: of the n best by score those that aren't redundant (gone), then, up to n,
    others by the spare scores that aren't either. One row a feature, so ranks are one task's."""
    best = scores.orderBy(F.col("score").desc(), "feature").limit(n)
    kept = best.join(gone, "feature", "left_anti").select("feature", "score", F.lit(0).alias("_later"))
    more = spare.select("feature", "score").join(gone, "feature", "left_anti").join(kept.select("feature"), "feature", "left_anti").select("feature", "score", F.lit(1).alias("_later"))
    rank = F.row_number().over(Window.orderBy("_later", F.col("score").desc(), "feature"))
    return kept.unionByName(more).select(rank.alias("rank"), "feature", "score").where(F.col("rank") <= n)


def ks_p_value(ks: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """The chance of a distance as large in equal distributions, by the limit law of Kolmogorov, which is
    near from some dozens of values a sample on."""
    root = ks * F.sqrt(n * m / (n + m))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * root * root))
    return F.when(root < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def exact_ks_p(ks: float, n: int, m: int, negligible: float = 1e-18) -> float:
    """The chance of a distance of at least ks between two samples of n and m from one distribution: the share
    of all lattice paths from (0, 0) to (n, m) that come so far from the diagonal. a[i] is that share among the
    paths to (i, k - i), for one k after the other; a step to a place comes from either side in proportion.

    Only places nearer to the diagonal are held, for all others have share 1: n + m steps over at most
    2 * ks * n * m / (n + m) + 1 numbers. A chance that is below `negligible` by Massart's inequality for both
    samples is 0, so a step has no more than some 10 * sqrt(min(n, m)) numbers, and memory stays as small."""
    least, total = round(ks * n * m), n + m
    if least <= 0:
        return 1.0
    # the distance is at most the sum of both samples' distances from their distribution
    share = math.sqrt(m) / (math.sqrt(n) + math.sqrt(m))
    if 2 * math.exp(-2 * n * (ks * share) ** 2) + 2 * math.exp(-2 * m * (ks * (1 - share)) ** 2) < negligible:
        return 0.0
    width = 2 * least // total + 3
    size = 2 * width + 4096
    base, before = -1, 0  # a[x] is the place i[x] = base + x
    a, i, step = np.ones(size), np.arange(base, base + size, dtype=float), np.empty(size)
    a[-base] = 0.0
    for k in range(1, total + 1):
        # |i * m - (k - i) * n| < least, and on the lattice
        low, high = max((k * n - least) // total + 1, 0, k - m), min(-((-k * n - least) // total) - 1, n, k)
        if high - base >= size:
            held = a[before - base - 1 : before - base + width + 1].copy()
            i += before - 1 - base
            base = before - 1
            a.fill(1.0)
            a[: len(held)] = held
        x, y = low - base, high - base + 1
        d = step[: y - x]
        np.subtract(a[x - 1 : y - 1], a[x:y], out=d)
        d *= i[x:y] * (1.0 / k)
        a[x:y] += d
        if low > before:  # the places that were left
            a[before - base : low - base] = 1.0
            before = low
    return float(a[n - base])


def _exact_p(ks: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(d) or pd.isna(a) or pd.isna(b) or not a or not b else exact_ks_p(d, int(a), int(b)) for d, a, b in zip(ks, n, m, strict=True)], dtype="float64")


def with_exact_p(drift: DataFrame) -> DataFrame:
    """two_sample_drift's rows with n, m and ks_p exact, at any n and m. A row a feature; its task takes n + m
    steps and holds the places near the diagonal alone. Features are dealt to tasks of their own."""
    exact = F.pandas_udf(_exact_p, "double")
    dealt = drift.repartition(drift.sparkSession.sparkContext.defaultParallelism, "feature")
    return dealt.select(*(exact("ks", "n", "m").alias("ks_p") if c == "ks_p" else F.col(c) for c in drift.columns))


def two_sample_drift(values: DataFrame, side: Column, sizes: bool = False) -> DataFrame:
    """values: feature, value; side true for the first sample. Means, the difference of the second's to
    the first's in standard deviations of both together, largest distance of the distributions (KS) with
    its p-value by the limit law (with_exact_p has the exact one; it needs sizes), and area between them (Wasserstein-1), from distinct values with running counts."""
    by = Window.partitionBy("feature")
    each = values.where("value IS NOT NULL").withColumn("_a", side).groupBy("feature", "value").agg(F.count_if("_a").alias("a"), F.count_if(~F.col("_a")).alias("b"))
    run = by.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.try_divide(F.sum("a").over(run), F.sum("a").over(by)) - F.try_divide(F.sum("b").over(run), F.sum("b").over(by)))
    cdf = each.select("*", gap.alias("_gap"), (F.lead("value").over(by.orderBy("value")) - F.col("value")).alias("_width"))
    n, total, square = F.sum(F.col("a") + F.col("b")), F.sum((F.col("a") + F.col("b")) * F.col("value")), F.sum((F.col("a") + F.col("b")) * F.col("value") * F.col("value"))
    mean_a, mean_b = F.try_divide(F.sum(F.col("a") * F.col("value")), F.sum("a")), F.try_divide(F.sum(F.col("b") * F.col("value")), F.sum("b"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(square - total * total / n, n - 1)))
    out = cdf.groupBy("feature").agg(
        mean_a.alias("mean_a"), mean_b.alias("mean_b"), F.try_divide(mean_b - mean_a, spread).alias("smd"), F.max("_gap").alias("ks"), F.sum("a").alias("_n"), F.sum("b").alias("_m"),
        F.sum(F.col("_gap") * F.col("_width")).alias("wasserstein"),
    )
    return out.select("feature", "mean_a", "mean_b", "smd", "ks", ks_p_value(F.col("ks"), F.col("_n"), F.col("_m")).alias("ks_p"), "wasserstein", *([F.col("_n").alias("n"), F.col("_m").alias("m")] if sizes else []))


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    while (x < 6).any():
        low = x < 6
        out[low] -= 1 / x[low]
        x = np.where(low, x + 1, x)
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def _nearest(x: np.ndarray, y: np.ndarray, w: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place, the distances (largest coordinate) of the k + 1 nearest points and their weights;
    the point that is the place itself counts one less."""
    n, step = min(k + 1, len(x)), max(1, (1 << 20) // len(x))
    dist, count = np.zeros((len(at_x), n)), np.zeros((len(at_x), n), np.int64)
    for a in range(0, len(at_x), step):
        d = np.maximum(np.abs(at_x[a : a + step, None] - x), np.abs(at_y[a : a + step, None] - y))
        near = np.argpartition(d, n - 1, 1)[:, :n]
        d = np.take_along_axis(d, near, 1)
        order = np.argsort(d, 1)
        dist[a : a + step], count[a : a + step] = np.take_along_axis(d, order, 1), w[np.take_along_axis(near, order, 1)]
    return dist, count - (dist == 0)


def _last(good, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The last double from low on that is good: all are up to a place, low is and high isn't."""
    flip = lambda b: np.where(b < 0, np.int64(-(2**63)) - b, b)
    low, high = flip((low + 0.0).view(np.int64)), flip((high + 0.0).view(np.int64))
    for _ in range(64):
        middle = (low >> 1) + (high >> 1) + (low & high & 1)
        ok = good(flip(middle).view(np.float64))
        low, high = np.where(ok, middle, low), np.where(ok, high, middle)
    return flip(low).view(np.float64)


def _tiles(points: DataFrame, strips: int, tile: int) -> DataFrame:
    """points with strip and tile. A strip is a range of (f, x, y), so that one value with many partners is as
    many strips as it needs; its points, ordered by y, are cut into tiles of half to one and a half of `tile`."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, number = None, 0
        for g in batches:
            for f, part in g.groupby("f"):
                if held is not None and f != held["f"].iloc[0]:
                    yield held.assign(tile=np.int32(number))
                    held, number = None, 0
                held = part if held is None else pd.concat([held, part])
                while len(held) >= 3 * tile // 2:
                    yield held[:tile].assign(tile=np.int32(number))
                    held, number = held[tile:], number + 1
        if held is not None:
            yield held.assign(tile=np.int32(number))

    dealt = points.repartitionByRange(strips, "f", "x", "y").sortWithinPartitions("f", "y", "x")
    return dealt.select("f", F.spark_partition_id().alias("strip"), "x", "y", "w").mapInPandas(cut, "f int, strip int, x double, y double, w long, tile int")


def _values_up_to(weights: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (f, axis, v, ...) with n: the sum of the weights (f, axis, v, w) at values of at most v. Both are dealt
    into ranges of values, and equal ones by what else a row has, so that no value is one task's."""
    extra = [c for c in asked.columns if c not in ("f", "axis", "v")]
    both = weights.select("f", "axis", "v", F.lit(0).alias("_asked"), *(F.lit(None).cast(t).alias(c) for c, t in asked.dtypes if c in extra), F.col("w").alias("_w")).unionByName(asked.withColumns({"_asked": F.lit(1), "_w": F.lit(0).cast("long")}))
    # written, for ranges must stay as they are while they are read twice
    dealt = written(both.repartitionByRange("f", "axis", "v", "_asked", *extra).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("f", "axis", "_part").agg(F.sum("_w").alias("_in"))
    parts = parts.select("f", "axis", "_part", (F.sum("_in").over(Window.partitionBy("f", "axis").orderBy("_part")) - F.col("_in")).alias("_before"))
    inside = F.sum("_w").over(Window.partitionBy("f", "axis", "_part").orderBy("v", "_asked").rowsBetween(Window.unboundedPreceding, 0))
    met = dealt.withColumn("_inside", inside).where("_asked = 1").join(parts, ["f", "axis", "_part"])
    return met.select(*asked.columns, (F.col("_before") + F.col("_inside")).alias("n"))


def mutual_information(values: DataFrame, k: int = 5, tile: int = 512) -> DataFrame:
    """Nearest-neighbour estimate of the information between value and y, by feature, over all rows.

    Each feature's plane is cut into strips by value and those into tiles of about `tile` points by y.
    A point's k-th distance in its own tile bounds the search; it visits the other tiles that its square
    meets, and the least of all their distances are its neighbours. How many values are closer than
    that on each axis is a difference of two running counts over ranges of values.
    Equal pairs are one point with a weight. Nulls and NaN are left out; a feature of at most k rows
    has 0. The driver holds a box for each strip, as many as the root of rows / tile; the boxes of tiles
    stay a table, and a strip's, as many again, are what one task holds."""
    spark = values.sparkSession
    rows = values.where("value IS NOT NULL AND y IS NOT NULL AND NOT isnan(value) AND NOT isnan(y)").select("feature", F.col("value").cast("double").alias("value"), F.col("y").cast("double").alias("y"))
    stats = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("value").alias("sx"), F.stddev_pop("y").alias("sy")).collect()  # a row a feature
    table = spark.createDataFrame([(f, r["feature"], r["n"], r["sx"] or 1.0, r["sy"] or 1.0) for f, r in enumerate(stats)], f"f int, feature {dict(rows.dtypes)['feature']}, n long, sx double, sy double")
    t = table.withColumnRenamed("feature", "_feature")
    scaled = rows.join(F.broadcast(t.where(F.col("n") > k)), F.col("feature").eqNullSafe(F.col("_feature"))).select("f", (F.col("value") / F.col("sx")).alias("x"), (F.col("y") / F.col("sy")).alias("y"))
    points = written(scaled.groupBy("f", "x", "y").agg(F.count(F.lit(1)).alias("w")))
    tiles = written(_tiles(points, max(1, sum(max(1, round((r["n"] / tile) ** 0.5)) for r in stats)), tile))
    box = [("min", "x"), ("max", "x"), ("min", "y"), ("max", "y")]
    boxes = written(tiles.groupBy("f", "strip", "tile").agg(*(getattr(F, a)(c).alias(a + c) for a, c in box)))
    strips = boxes.groupBy("f", "strip").agg(*(getattr(F, a)(a + c).alias(a + c) for a, c in box)).toPandas()
    strips = {int(f): g.drop(columns="f").to_numpy(float).T for f, g in strips.groupby("f")}
    found = "f int, strip int, tile int, x double, y double, w long, d array<double>, c array<long>"
    # the square is widened by what rounding may lose
    reach = lambda x, y, r: r * (1 + 1e-9) + 1e-12 * (np.abs(x) + np.abs(y))

    def own(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        """A row a point with its neighbours here (own), and one for each strip that its square meets."""
        f = key[0]
        x, y, w = (g[c].to_numpy() for c in ("x", "y", "w"))
        d, c = _nearest(x, y, w, x, y, k)
        enough = np.cumsum(c, 1) >= k
        r = reach(x, y, np.where(enough.any(1), d[np.arange(len(d)), enough.argmax(1)], np.inf))
        number, x0, x1, y0, y1 = strips[int(f)]
        near = np.flatnonzero((x0 <= (x + r).max()) & (x1 >= (x - r).min()) & (y0 <= (y + r).max()) & (y1 >= (y - r).min()))
        p, s = np.nonzero((x0[near] <= (x + r)[:, None]) & (x1[near] >= (x - r)[:, None]) & (y0[near] <= (y + r)[:, None]) & (y1[near] >= (y - r)[:, None]))
        here = pd.DataFrame({"f": f, "strip": key[1], "tile": key[2], "home": key[1], "x": x, "y": y, "w": w, "r": r, "own": True, "d": list(d), "c": list(c)})
        met = pd.DataFrame({"f": f, "strip": number[near][s].astype(np.int32), "tile": key[2], "home": key[1], "x": x[p], "y": y[p], "w": w[p], "r": r[p], "own": False, "d": [[]] * len(p), "c": [[]] * len(p)})
        return pd.concat([here, met])

    first = written(tiles.groupBy("f", "strip", "tile").applyInPandas(own, "f int, strip int, tile int, home int, x double, y double, w long, r double, own boolean, d array<double>, c array<long>"))

    def route(here: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        """A row for each tile of the strip that a guest's square meets, but its own."""
        here = here.sort_values("tile")
        x0, x1, y0, y1 = (here[a + c].to_numpy() for a, c in box)
        x, y, r = (guests[c].to_numpy() for c in ("x", "y", "r"))
        a, n = np.searchsorted(y1, y - r, side="left"), np.searchsorted(y0, y + r, side="right")
        n = np.maximum(n - a, 0)
        p = np.repeat(np.arange(len(n)), n)
        to = np.repeat(a, n) + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        number, came, home, strip = here["tile"].to_numpy()[to], guests["tile"].to_numpy()[p], guests["home"].to_numpy()[p], guests["strip"].to_numpy()[p]
        good = (x0[to] <= x[p] + r[p]) & (x1[to] >= x[p] - r[p]) & ((strip != home) | (number != came))
        out = guests[["f", "strip", "x", "y", "w"]].iloc[p[good]]
        return out.assign(tile=number[good])

    # guests of a strip are dealt by their place, for many squares can meet one strip
    shares = 16
    guests = first.where("NOT own").withColumn("_share", F.pmod(F.xxhash64("x", "y"), F.lit(shares)))
    dealt = boxes.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    routed = dealt.groupBy("f", "strip", "_share").cogroup(guests.groupBy("f", "strip", "_share")).applyInPandas(route, "f int, strip int, tile int, x double, y double, w long")

    def visit(here: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(guests):
            return guests[:0].assign(d=pd.Series(dtype=object), c=pd.Series(dtype=object))
        d, c = _nearest(*(here[c].to_numpy() for c in ("x", "y", "w")), guests["x"].to_numpy(), guests["y"].to_numpy(), k)
        return guests.assign(d=list(d), c=list(c))

    keys = ["f", "strip", "tile"]
    visited = tiles.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInPandas(visit, found)
    near = first.where("own").select(*visited.columns).unionByName(visited).groupBy("f", "x", "y").agg(F.max("w").alias("w"), F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "c")))).alias("near"))
    # the first distance at which the weights reach k
    radius = F.aggregate("near", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("r")), lambda a, e: F.when(a["n"] >= k, a).otherwise(F.struct((a["n"] + e["c"]).alias("n"), e["d"].alias("r"))), lambda a: a["r"])

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            r = g["r"].to_numpy()
            for axis, z in enumerate((g["x"].to_numpy(), g["y"].to_numpy())):
                up = _last(lambda c: c - z < r, z, np.nextafter(z + 2 * r, np.inf))  # noqa: B023
                down = _last(lambda c: z - c >= r, np.nextafter(z - 2 * r, -np.inf), z)  # noqa: B023
                for sign, v in ((1, up), (-1, down)):
                    # nothing is closer than 0
                    yield g[["f", "x", "y", "w"]].assign(axis=axis, v=v, sign=np.where(r > 0, sign, 0))

    line = points.select("f", F.lit(0).alias("axis"), F.col("x").alias("v"), "w").unionByName(points.select("f", F.lit(1).alias("axis"), F.col("y").alias("v"), "w")).groupBy("f", "axis", "v").agg(F.sum("w").alias("w"))
    ends = near.select("f", "x", "y", "w", radius.alias("r")).mapInPandas(asked, "f int, axis int, v double, sign int, x double, y double, w long")
    on = lambda axis: F.sum(F.when(F.col("axis") == axis, F.col("sign") * F.col("n")).otherwise(0))
    digamma = F.pandas_udf(lambda v: pd.Series(_digamma(np.maximum(v.to_numpy(), 1))), "double")
    each = _values_up_to(line, ends).groupBy("f", "x", "y").agg(F.max("w").alias("w"), on(0).alias("nx"), on(1).alias("ny")).select("f", "w", digamma("nx").alias("dx"), digamma("ny").alias("dy"))
    sums = each.groupBy("f").agg(F.sum(F.col("w") * (F.col("dx") + F.col("dy"))).alias("s"), F.sum("w").alias("m"))
    mi = digamma("n") + float(_digamma(np.array([k]))[0]) - F.col("s") / F.col("m")
    return table.join(sums, "f", "left").select("feature", F.when(F.col("n") > k, F.greatest(F.lit(0.0), mi)).otherwise(0.0).alias("mi"))


def standard_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median-filled and scaled by the population deviation."""
    one = quantile_row(df, {c: F.col(c) for c in columns}, [0.5], {(c, 0): f"_m_{c}" for c in columns})
    filled = df.crossJoin(F.broadcast(one)).select(*(c for c in df.columns if c not in columns), *(F.coalesce(c, f"_m_{c}").alias(c) for c in columns))  # one row
    stats = filled.agg(*(F.avg(c).alias(f"_a_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    return filled.crossJoin(F.broadcast(stats)).select(*(c for c in df.columns if c not in columns), *(F.coalesce(F.try_divide(F.col(c) - F.col(f"_a_{c}"), F.col(f"_s_{c}")), F.lit(0.0)).alias(c) for c in columns))


def principal_components(df: DataFrame, columns: list[str], n: int = 2) -> tuple[DataFrame, list[float]]:
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=columns, outputCol="_v").transform(standard_scaled(df, columns))
    model = PCA(k=n, inputCol="_v", outputCol="_p").fit(v)
    sign = [1.0 if np.abs(c).argmax() >= 0 and c[np.abs(c).argmax()] >= 0 else -1.0 for c in model.pc.toArray().T]
    scores = model.transform(v).withColumn("_a", vector_to_array("_p"))
    return scores.select(*(c for c in df.columns if c not in columns), *((F.col("_a")[k] * sign[k]).alias(f"pc{k + 1}") for k in range(n))), model.explainedVariance.toArray().tolist()


