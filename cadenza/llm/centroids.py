"""Centroid clustering of embeddings in exact integers, with block-norm screening.

Vectors with the wanted number of finite components are kept and turned into integers floor(scale * x).
They are written once, in 32 bits a component, with the norms of their blocks of eight components. For blocks b the
Cauchy-Schwarz inequality gives |x - c|^2 >= sum over b of (|x_b| - |c_b|)^2, so a centroid whose bound
lies above the distance to the centroid with the least bound can't be nearest: only the others get their
exact integer distance. Bounds are lowered by more than their rounding error; results don't depend on
them.

A round is one pass over the vectors: a task assigns its rows and adds them up by centroid, so a task
shuffles at most centroids x components narrow rows however the clusters are filled. Centroids and their
sums (k x components numbers, bounded by the parameters) go through the driver; vectors never do. Every
pass reads the written vectors, so a lost executor costs a re-read.

Edge cases: vectors that are null, have another number of components, or a null or non-finite one are
left out; fewer kept vectors than k give as many centroids; repeated ids are rows of their own, and
those that compete for a first centroid are taken by their components in ascending order; a null id is
hashed as the text 'null'; an empty table gives an empty table. Integers beyond 2^96 are held there, and
distances and sums beyond a long at its largest value; anything less is exact, in Python's integers where
64 bits don't reach. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import batches_of, stage

MOST, LONG = 1 << 96, (1 << 63) - 1
#: A vector and a centroid whose components stay below it have distances that 64 bits hold.
SAFE = 1 << 26
ROWS = 4096


def kept(vector: Column, width: int) -> Column:
    """Whether a vector has exactly `width` components, all finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[float]]:
    """The k vectors with the smallest hash of `seed:id`, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return [r["x"] for r in vectors.select(name.alias("h"), "x").orderBy("h", "x").limit(k).collect()]


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as 64-bit integers if all fit below SAFE, else as Python's."""
    with np.errstate(over="ignore"):
        scaled = values * scale
    if scale & (scale - 1) or not np.isfinite(scaled).all():  # the product isn't exact
        exact = [int(Fraction(x) * scale // 1) for x in values.ravel().tolist()]
        return np.array([min(MOST, max(-MOST, x)) for x in exact] or [0], object)[: values.size].reshape(values.shape)
    scaled = np.floor(scaled)
    if not scaled.size or np.abs(scaled).max() < SAFE:
        return scaled.astype(np.int64)
    return np.array([min(MOST, max(-MOST, int(x))) for x in scaled.ravel().tolist()], object).reshape(scaled.shape)


def block_norms(x: np.ndarray, block: int) -> np.ndarray:
    parts = [np.sqrt((x[:, k : k + block].astype(float) ** 2).sum(1)) for k in range(0, x.shape[1], block)]
    return np.stack(parts, 1) if parts else np.zeros((len(x), 0))


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of every row (ties: the smaller number), its squared distance, and how many
    exact distances were needed."""
    low = block_norms(centroids, block)
    squares, squared = (norms**2).sum(1), (low**2).sum(1)
    bound = squares[:, None] + squared - 2 * norms @ low.T
    bound -= 1e-6 * (squares[:, None] + squared)  # norms are written in 32 bits
    rows = np.arange(len(x))
    start = bound.argmin(1)
    best = ((x - centroids[start]) ** 2).sum(1)
    found, needed = start.copy(), len(x)
    reach = bound <= best.astype(float)[:, None] * (1 + 1e-12)
    reach[rows, start] = False
    for c in np.flatnonzero(reach.any(0)):
        at = np.flatnonzero(reach[:, c])
        needed += len(at)
        far = ((x[at] - centroids[c]) ** 2).sum(1)
        nearer = (far < best[at]) | ((far == best[at]) & (c < found[at]))
        best[at[nearer]], found[at[nearer]] = far[nearer], c
    return found, best, needed


def _compressed(batch: pa.RecordBatch, width: int, scale: int, block: int) -> pa.RecordBatch:
    """(vec_id, doubles) to (vec_id, 32-bit integers, or the doubles where those don't reach, norms of blocks)."""
    values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    x = integers(values, scale)
    fits = np.ones(len(x), bool) if x.dtype != object else np.array([all(abs(v) < SAFE for v in row) for row in x], bool)
    norms = block_norms(x, block).astype(np.float32)
    lists = (_lists(np.where(fits[:, None], x, 0).astype(np.int32), fits), _lists(values, ~fits), _lists(norms, np.ones(len(x), bool)))
    return pa.RecordBatch.from_arrays([batch.column(0), *lists], ["vec_id", "x", "wide", "norms"])


def _lists(rows: np.ndarray, there: np.ndarray) -> pa.ListArray:
    at = np.append(0, np.cumsum(there * rows.shape[1])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(rows[there].ravel()), mask=pa.array(~there))


def _vectors(batch: pa.RecordBatch, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The integers and block norms of written vectors."""
    n = batch.num_rows
    norms = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)
    if len(x) == n:
        return x, norms
    wide = np.array(batch.column(1).is_null())
    out = np.zeros((n, width), object)
    out[~wide] = x.astype(object)
    out[wide] = integers(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)
    return out, norms


def _fitting(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and centroids in 64 bits where both stay below SAFE, else in Python's integers."""
    small = x.dtype != object and all(abs(v) < SAFE for c in centroids for v in c)
    return (x, np.array(centroids, np.int64)) if small else (x.astype(object), np.array(centroids, object))


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2, block: int = 8) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector."""
    spark = table.sparkSession
    kind = dict(table.dtypes)["vec_id"]
    x = F.col("embedding").cast("array<double>")
    raw = table.select("vec_id", x.alias("x")).where(kept(F.col("x"), width))

    def compressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_compressed(batch, width, scale, block) for batch in batches_of(ROWS, batches))

    vectors = stage(raw.mapInArrow(compressed, f"vec_id {kind}, x array<int>, wide array<double>, norms array<float>"))
    first = first_centroids(raw, k, seed)
    centroids = [[int(v) for v in c] for c in integers(np.array(first, float).reshape(len(first), width), scale)]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [0] * len(centroids), [np.zeros(width, object) for _ in centroids]
        for batch in batches_of(ROWS, batches):
            x, norms = _vectors(batch, width, scale)
            x, c = _fitting(x, centroids)
            found, _, _ = nearest(x, norms, c, block)
            for j in np.unique(found):
                n[j] += int((found == j).sum())
                total[j] = total[j] + x[found == j].sum(0).astype(object)
        at = [j for j in range(len(centroids)) if n[j]]
        cells = [np.repeat(at, width), np.tile(np.arange(width), len(at)), np.repeat([n[j] for j in at], width)]
        yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int64)) for v in map(np.asarray, cells)), pa.array([str(v) for j in at for v in total[j]], pa.string())], ["cluster", "component", "n", "sum"])

    for _ in range(rounds if centroids else 0):
        rows = vectors.mapInArrow(sums, "cluster long, component long, n long, sum string").groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()
        centroids = [list(c) for c in centroids]
        for r in rows:
            centroids[r["cluster"]][r["component"]] = int(r["sum"]) // r["n"]

    def assigned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(ROWS, batches):
            x, norms = _vectors(batch, width, scale)
            x, c = _fitting(x, centroids)
            found, far, _ = nearest(x, norms, c, block)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(np.int32)), pa.array([min(LONG, int(v)) for v in far], pa.int64())], ["vec_id", "cluster", "distance"])

    placed = stage(vectors.mapInArrow(assigned, f"vec_id {kind}, cluster int, distance long"))
    own = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    inertia = sum(own.values())
    rows = [(j, min(LONG, own.get(j, 0)), min(LONG, inertia), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
