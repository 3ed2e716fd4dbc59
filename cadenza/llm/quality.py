"""Quality classifier: Naive Bayes support vectors.

Features are the byte n-grams (1 to 4) of the whole text and three indicators of repeated words, each
an indicator in one of 2 ** bits hash buckets. Each bucket has a class log-count ratio
r = log((p + a) / |p + a|) - log((n + a) / |n + a|) from all labelled training rows; a text's vector
is r at its buckets. A linear hinge-loss model over these vectors is fitted by dual coordinate
descent, and a logistic curve maps its margins to scores.

The log-count ratios cover every labelled row, by grouping over buckets. The linear model is fitted
on at most `sample` of them (documented bound; half of it for each class, in hash order, so that the
fit is the same at every size above it); three quarters fit the weights, one quarter the curve, which
is weighted to the class shares of all labelled rows. Model and ratios are 2 ** bits numbers each.

Edge cases: null texts are empty and have the begin-end feature alone; rows without label, with a null
label or with labels that contradict each other don't train; with one class only or no labels at all,
every score is the share of label 1 (0.5 without any); null ids are never labelled; repeated rows count
as often as they stand there, and a repeated id gives the sample its least text once; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import batches_of, hashed_words, mixed, stage, text_bytes


def features_of(column: pa.Array, bits: int) -> list[np.ndarray]:
    """The distinct buckets of each text, ascending."""
    data, at = text_bytes(column)
    words, word_at = hashed_words(column)
    shift, out = np.uint64(64 - bits), []
    room = np.zeros(1 << bits, bool)
    salts = mixed(np.arange(1, 9))
    for k in range(len(at) - 1):
        text = np.concatenate([[np.uint64(2)], data[at[k] : at[k + 1]].astype(np.uint64), [np.uint64(3)]])
        code = text.copy()
        room[(code * np.uint64(0x9E3779B97F4A7C15) + salts[0]) >> shift] = True
        for n in range(1, min(4, len(text))):
            code = (code[:-1] << np.uint64(8)) | text[n:]
            room[((code + salts[n]) * np.uint64(0x9E3779B97F4A7C15)) >> shift] = True
        w = words[word_at[k] : word_at[k + 1]]
        # how near before a word the same one stands: 1, 2, 3 places
        for gap in (1, 2, 3):
            if (w[gap:] == w[:-gap]).sum() * 4 > len(w):
                room[salts[3 + gap] >> shift] = True
        hit = np.flatnonzero(room)
        room[hit] = False
        out.append(hit.astype(np.uint32))
    return out


@dataclass
class Model:
    bits: int
    weight: np.ndarray  # by bucket, ratios multiplied in
    square: np.ndarray  # of the ratios; a text's vector is scaled to length 1
    bias: float
    slope: float
    level: float

    def scores(self, column: pa.Array) -> np.ndarray:
        margin = np.array([float(self.weight[f].sum()) / max(1e-12, float(np.sqrt(self.square[f].sum()))) for f in features_of(column, self.bits)]) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.level, -40, 40)))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = 0.1, passes: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights by bucket and bias of the L1-loss linear support vector machine on x = r at rows, each
    scaled to length 1, with a constant feature for the bias."""
    w, b, alpha = np.zeros(len(r), np.float64), 0.0, np.zeros(len(rows))
    x = [r[f].astype(np.float32) for f in rows]
    norm = [1 / max(1e-12, float(np.sqrt((v * v).sum()))) for v in x]
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i], x[i]
            g = y[i] * (float(w[f] @ v) * norm[i] + b) - 1
            new = min(max(alpha[i] - g / 2, 0.0), cost)  # a row and its constant have length 2 squared
            step = new - alpha[i]
            if step:
                w[f] += step * y[i] * norm[i] * v
                b += step * y[i]
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3 * cost:
            break
    return w, b


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and level of the weighted logistic fit, by Newton steps with a small ridge."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    t = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-4])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - np.array([1e-2, 1e-4]) * t)
        t += step
        if np.abs(step).max() < 1e-8:
            break
    return float(t[0]), float(t[1])


def fit(docs: DataFrame, labels: DataFrame, bits: int = 18, sample: int = 4000, smooth: float = 1.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """docs: the rows that may be learnt from."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_top")).where("_y = _top AND _y IN (0, 1)")

    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # by a shuffle at every size: the labels have no bound
    labelled = own.join(known.hint("merge"), "_id").select(F.col("_y").cast("int").alias("y"), "_text")
    # one narrow row for each labelled document, in the order that the sample is drawn in
    places = stage(own.select("_id").join(known, "_id").groupBy("_id").agg(F.first("_y").cast("int").alias("y"), F.count(F.lit(1)).alias("times")).withColumn("nth", F.xxhash64(F.lit(11), "_id")))
    n = {x["y"]: x["n"] for x in places.groupBy("y").agg(F.sum("times").alias("n")).collect()}
    size = 1 << bits
    if len(n) < 2:
        share = n.get(1, 0) / sum(n.values()) if n else 0.5
        return Model(bits, np.zeros(size), np.ones(size), 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, size), np.int64)
        for batch in batches_of(512, batches):
            for y, f in zip(batch.column(0).to_pylist(), features_of(batch.column(1), bits), strict=True):
                count[y, f] += 1
        at = np.flatnonzero(count.any(0))
        for k in range(0, len(at), 50_000):
            some = at[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[0, some]), pa.array(count[1, some])], ["bucket", "n0", "n1"])

    table = labelled.mapInArrow(counted, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    counts = np.full((2, size), smooth)
    counts[0, table["bucket"]] += table["n0"]
    counts[1, table["bucket"]] += table["n1"]
    r = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())

    # at most `sample` ids, which is the bound of this broadcast
    drawn = [places.where(F.col("y") == y).orderBy("nth", "_id").limit(sample // 2) for y in (0, 1)]
    drawn = F.broadcast(stage(drawn[0].unionByName(drawn[1]).select("_id", "y", "nth")))
    rows = own.join(drawn, "_id").groupBy("y", "nth", "_id").agg(F.min("_text").alias("_text"))
    ratios = docs.sparkSession.sparkContext.broadcast(r)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(256, batches):
            f = [x.tobytes() for x in features_of(batch.column(3), bits)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(f, pa.binary())], ["y", "nth", "_id", "f"])

    def learn(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["y", "nth", "_id"])
        f = [np.frombuffer(x, np.uint32) for x in g["f"]]
        w, b, slope, level = _fitted(f, np.where(g["y"] == 1, 1.0, -1.0), ratios.value, n)
        return pd.DataFrame({"w": [w.astype(np.float64).tobytes()], "b": [b], "slope": [slope], "level": [level]})

    # the sample is bounded, and a text of any length is 2 ** bits buckets at most, so one task fits it
    rows = rows.select(F.col("y").cast("int"), "nth", F.col("_id").cast("long"), "_text").mapInArrow(featured, "y int, nth long, _id long, f binary")
    fitted = rows.groupBy().applyInPandas(learn, "w binary, b double, slope double, level double").first()
    return Model(bits, np.frombuffer(fitted["w"], np.float64) * r, r * r, fitted["b"], fitted["slope"], fitted["level"])


def _fitted(f: list[np.ndarray], y: np.ndarray, r: np.ndarray, n: dict[int, int]) -> tuple[np.ndarray, float, float, float]:
    """Weights and bias from three rows of four, slope and level from the fourth."""
    held = np.arange(len(f)) % 4 == 3
    w, b = dual_coordinate_descent([v for v, h in zip(f, held, strict=True) if not h], y[~held], r)
    margin = np.array([float(w[v] @ r[v]) / max(1e-12, float(np.sqrt((r[v] ** 2).sum()))) + b for v in f])
    seen = held if len({*y[held]}) == 2 else ~held
    share = np.where(y > 0, n[1] / max(1, (y[seen] > 0).sum()), n[0] / max(1, (y[seen] < 0).sum())) / sum(n.values()) * seen.sum()
    slope, level = _logistic(margin[seen], (y[seen] > 0).astype(float), share[seen])
    return w, b, slope, level


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with all columns, and the score under `name`, which must not be the name of one of them."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(512, batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch.column(place)), pa.float64())], [*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
