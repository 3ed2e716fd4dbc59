"""Gradient boosting whose trees grow the best leaf first, over quantile bins.

Features are cut at quantiles of the train rows into at most 255 bins and written as small integers once. A
tree takes one pass a level: each task applies the tree so far, and adds up gradients and rows by leaf,
feature and bin, so what is shuffled is bounded by leaves x features x bins however many rows there are.
Spark finds each leaf's best split from running sums over bins; the driver sees one row a leaf. Splits of a
leaf don't depend on the other leaves, so when all levels are there, the splits with the largest gain are taken
one after the other until the tree has its leaves: the same tree as growing it leaf by leaf, in max_depth
passes instead of one a split. Predictions so far are written with the rows every few trees, and brought up
to date in the tasks in between."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.quantiles import column_quantiles
from cadenza.sources.shared import written


@dataclass(frozen=True)
class Params:
    """Defaults are the tuned values of the offline evaluation: fixed values."""

    trees: int = 350
    leaves: int = 122
    depth: int = 9
    rate: float = 0.030167988704668327
    least_rows: int = 10
    features: float = 0.85495534487619
    l1: float = 0.0789408295003718
    l2: float = 0.1675734802944115
    bins: int = 255
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number, the root is 0: feature (-1: a leaf), bin (up to it goes left), left child (the right one
    follows), value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin: int, gain: float, values: tuple[float, float]) -> int:
        self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, bin, len(self.feature), gain
        for v in values:
            for column, x in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.value, v), (self.gain, 0.0)):
                column.append(x)
        return self.left[node]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The node in which each row of bins ends."""
        feature, cut, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := feature[at] >= 0).any():
            at = np.where(inner, left[at] + (x[rows, feature[at]] > cut[at]), at)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf(x)]


@dataclass
class Model:
    names: list[str]
    edges: list[list[float]]
    start: float
    trees: list[Tree]

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bins of the values: how many edges lie below; nulls and NaN are in the first."""
        return np.stack([np.searchsorted(e, np.where(np.isnan(c), -np.inf, c), side="left") for e, c in zip(self.edges, columns, strict=True)], 1).astype(np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def gain_of(g: np.ndarray, n: np.ndarray, p: Params) -> np.ndarray:
    """What a leaf with gradients g of n rows is worth."""
    return np.maximum(np.abs(g) - p.l1, 0) ** 2 / (n + p.l2)


def leaf_value(g: float, n: float, p: Params) -> float:
    return -math.copysign(max(abs(g) - p.l1, 0.0), g) / (n + p.l2) * p.rate


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for n in names]


def _bins(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(batch.num_rows, n)


def _best_splits(rows: DataFrame, model: Model, recent: list[Tree], tree: Tree, open_nodes: list[int], chosen: list[int], p: Params) -> dict[int, tuple]:
    """By open node the feature, bin, gain, and gradients and rows on both sides of its best split."""
    n_features, wanted = len(model.names), np.array(sorted(open_nodes))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((len(wanted), len(chosen), p.bins + 1))
        n = np.zeros(g.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _bins(batch, n_features)
            now = batch.column("f").to_numpy() + sum((t.predict(x) for t in recent), np.zeros(len(x)))
            gradient = now - batch.column("y").to_numpy()
            leaf = tree.leaf(x)
            slot = np.searchsorted(wanted, leaf)
            known = (slot < len(wanted)) & (wanted[np.minimum(slot, len(wanted) - 1)] == leaf)
            for k, f in enumerate(chosen):
                cell = slot[known] * (p.bins + 1) + x[known, f]
                size = len(wanted) * (p.bins + 1)
                g[:, k] += np.bincount(cell, gradient[known], size).reshape(len(wanted), -1)
                n[:, k] += np.bincount(cell, minlength=size).reshape(len(wanted), -1)
        at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[at[0]]), pa.array(np.array(chosen)[at[1]]), pa.array(at[2]), pa.array(g[at]), pa.array(n[at])], ["node", "feature", "bin", "g", "n"])

    # tasks have added up their cells already, so they go straight to where a node's feature is summed and scanned
    cells = rows.mapInArrow(sums, "node long, feature long, bin long, g double, n long").repartition("node", "feature").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    whole = Window.partitionBy("node", "feature")
    run = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sides = cells.select("node", "feature", "bin", F.sum("g").over(run).alias("gl"), F.sum("n").over(run).alias("nl"), F.sum("g").over(whole).alias("ga"), F.sum("n").over(whole).alias("na"))
    worth = lambda g, n: F.pow(F.greatest(F.abs(g) - p.l1, F.lit(0.0)), 2) / (n + p.l2)
    gr, nr = F.col("ga") - F.col("gl"), F.col("na") - F.col("nl")
    gain = worth(F.col("gl"), F.col("nl")) + worth(gr, nr) - worth(F.col("ga"), F.col("na"))
    fit = sides.where((F.col("nl") >= p.least_rows) & (nr >= p.least_rows)).withColumn("gain", gain).where("gain > 0")
    best = fit.groupBy("node").agg(F.max_by(F.struct("feature", "bin", "gain", "gl", "nl", "ga", "na"), F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("b")).collect()  # a row a leaf
    return {r["node"]: (r["b"]["feature"], r["b"]["bin"], r["b"]["gain"], r["b"]["gl"], r["b"]["nl"], r["b"]["ga"] - r["b"]["gl"], r["b"]["na"] - r["b"]["nl"]) for r in best}


def best_first(full: Tree, leaves: int) -> Tree:
    """The part of a tree that growing the best leaf first reaches with so many leaves."""
    out, heap = Tree(value=[full.value[0]]), [(-full.gain[0], 0, 0)] if full.feature[0] >= 0 else []
    n = 1
    while heap and n < leaves:
        _, node, mine = heapq.heappop(heap)
        a = full.left[node]
        at = out.split(mine, full.feature[node], full.bin[node], full.gain[node], (full.value[a], full.value[a + 1]))
        n += 1
        for side in (0, 1):
            if full.feature[a + side] >= 0:
                heapq.heappush(heap, (-full.gain[a + side], a + side, at + side))
    return out


def grown(rows: DataFrame, model: Model, recent: list[Tree], chosen: list[int], p: Params) -> Tree:
    """The next tree: all splits level by level, then the best leaves first."""
    full, open_nodes = Tree(), [0]
    for _ in range(p.depth):
        found = _best_splits(rows, model, recent, full, open_nodes, chosen, p) if open_nodes else {}
        open_nodes = []
        for node, (feature, cut, gain, gl, nl, gr, nr) in sorted(found.items()):
            left = full.split(node, feature, cut, gain, (leaf_value(gl, nl, p), leaf_value(gr, nr, p)))
            open_nodes += [left, left + 1]
    return best_first(full, p.leaves)


def leafwise(train: DataFrame, features: Sequence[str], target: str, params: Params = Params(), write_every: int = 10) -> Model:  # noqa: B008
    """Fit on rows with a target. Each tree sees a share of the features, drawn by the seed."""
    p, names = params, list(features)
    known = train.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    finite = {n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")) for n in names}
    cuts = {r["column"]: sorted(set(r["quantiles"])) for r in column_quantiles(known, finite, [k / p.bins for k in range(1, p.bins)]).collect()}
    start = known.agg(F.avg(target)).first()[0] or 0.0
    model = Model(names, [cuts.get(n, []) for n in names], start, [])

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.binned(_columns(batch, names))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("y"), pa.array(np.full(len(x), start))], ["x", "y", "f"])

    def updated(batches: Iterator[pa.RecordBatch], recent: list[Tree]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _bins(batch, len(names))
            now = batch.column("f").to_numpy() + sum((t.predict(x) for t in recent), np.zeros(len(x)))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(now)], ["x", "y", "f"])

    schema = "x binary, y double, f double"
    rows = written(known.select(*names, F.col(target).cast("double").alias("y")).mapInArrow(prepared, schema), "boosting")
    rng, recent = np.random.default_rng(p.seed), []
    for _ in range(p.trees):
        n = max(1, round(p.features * len(names)))
        chosen = sorted(rng.choice(len(names), n, replace=False).tolist())
        tree = grown(rows, model, recent, chosen, p)
        if tree.feature[0] < 0:
            break
        model.trees.append(tree)
        recent.append(tree)
        if len(recent) == write_every:
            rows = written(rows.mapInArrow(lambda batches, done=tuple(recent): updated(batches, list(done)), schema), "boosting")
            recent = []
    return model


def predicted(model: Model, test: DataFrame, name: str = "yhat") -> DataFrame:
    """test with the model's prediction."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.binned(_columns(batch, model.names))
            yield batch.append_column(name, pa.array(model.predict(x)))

    return test.mapInArrow(run, StructType([*test.schema.fields, StructField(name, DoubleType())]))


def gain_importances(model: Model, like: DataFrame) -> DataFrame:
    """feature, importance: the share of all gains."""
    total = dict.fromkeys(model.names, 0.0)
    for t in model.trees:
        for f, g in zip(t.feature, t.gain, strict=True):
            if f >= 0:
                total[model.names[f]] += g
    whole = sum(total.values()) or 1.0
    return like.sparkSession.createDataFrame([(n, g / whole) for n, g in total.items()], "feature string, importance double")
