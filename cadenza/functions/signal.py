"""Framing and features of sampled signals held as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frames(signal: str, width: int, overlap: float = 0.5) -> Column:
    """array(struct(window, samples)): windows of `width` samples, int(width * (1 - overlap)) apart;
    no window when the signal is shorter."""
    step = int(width * (1 - overlap))
    if step <= 0:
        raise ValueError("overlap leaves no step")
    starts = F.when(F.size(signal) >= width, F.sequence(F.lit(1), F.size(signal) - width + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s, k: F.struct(k.alias("window"), F.slice(signal, s, width).alias("samples")))


def framed(df: DataFrame, signal: str, width: int, overlap: float = 0.5) -> DataFrame:
    return df.withColumn("_f", F.explode(frames(signal, width, overlap))).select(*(c for c in df.columns if c != signal), "_f.window", "_f.samples")


def time_features(samples: Column) -> dict[str, Column]:
    """rms, population deviation, population skewness and excess kurtosis, peak to peak, crest; array
    expressions, so a frame is never exploded."""
    n = F.size(samples).cast("double")
    total = lambda f: F.aggregate(samples, F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    mean, square = total(lambda x: x) / n, total(lambda x: x * x) / n
    moment = lambda k: F.aggregate(samples, F.struct(F.lit(0.0).alias("s"), mean.alias("m")), lambda a, x: F.struct((a["s"] + F.pow(x.cast("double") - a["m"], F.lit(float(k)))).alias("s"), a["m"].alias("m")))["s"] / n
    var, rms = moment(2), F.sqrt(square)
    peak = F.aggregate(samples, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    return {
        "rms": rms, "std": F.sqrt(var), "skew": F.try_divide(moment(3), F.pow(var, F.lit(1.5))), "kurtosis": F.try_divide(moment(4), var * var) - 3,
        "peak_to_peak": (F.array_max(samples) - F.array_min(samples)).cast("double"), "crest_factor": peak / (rms + 1e-12),
    }


def welch(x: np.ndarray, fs: float, segment: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density by averaged periodograms: periodic Hann window, half overlap, mean
    removed from each segment. x: rows of samples."""
    n = min(segment, x.shape[-1])
    step = max(1, n - n // 2)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    cut = np.stack([x[..., k : k + n] for k in range(0, x.shape[-1] - n + 1, step)], -2)
    cut = (cut - cut.mean(-1, keepdims=True)) * window
    power = np.abs(np.fft.rfft(cut)) ** 2 / (fs * (window**2).sum())
    power[..., 1 : (n + 1) // 2] *= 2
    return np.fft.rfftfreq(n, 1 / fs), power.mean(-2)


#: Bands in Hz at 20 kHz: fixed values.
BANDS = {"bp_0_1k": (0, 1000), "bp_1k_5k": (1000, 5000), "bp_5k_10k": (5000, 10000)}


def spectral_features(df: DataFrame, samples: str, fs: float = 20_000.0, segment: int = 1024, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """Adds the spectral centroid and band powers (trapezoid over low <= f < high). The transform has
    no built-in; Arrow batches of rows of equal length are transformed at once."""
    names = ["spec_centroid", *bands]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.full((len(b), len(names)), np.nan)
            lengths = b[samples].map(lambda v: -1 if v is None else len(v)).to_numpy()
            for n in np.unique(lengths[lengths > 1]):
                rows = np.flatnonzero(lengths == n)
                f, p = welch(np.stack([np.asarray(b[samples].iloc[r], float) for r in rows]), fs, segment)
                out[rows, 0] = (f * p).sum(1) / (p.sum(1) + 1e-12)
                for k, (low, high) in enumerate(bands.values(), 1):
                    m = (f >= low) & (f < high)
                    out[rows, k] = np.trapezoid(p[:, m], f[m], axis=1) if m.sum() else 0.0
            for k, name in enumerate(names):
                b[name] = out[:, k]
            yield b

    from pyspark.sql.types import DoubleType, StructField, StructType

    return df.mapInPandas(run, StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in names)])).withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def aggregated_windows(df: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """Mean, population deviation and number of defined windows of each feature."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_windows"), *(a for f in features for a in (F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_std"), F.count(f).alias(f"{f}_valid"))))


def quantised(x: Column) -> Column:
    """12 significant digits, no negative zero; null stays null, NaN and infinity are errors."""
    finite = ~(F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(x.isNull(), F.lit(None)).when(finite, F.format_string("%.11e", x).try_cast("double") + 0.0).otherwise(F.raise_error(F.lit("value is not finite")).cast("double"))


def resampled(df: DataFrame, samples: str, source_fs: float, target_fs: float) -> DataFrame:
    """The samples at another rate, int(n * target / source) of them, by cutting or padding the spectrum;
    unchanged at the same rate. Null stays null; an empty signal, and one that would have no samples, is
    empty."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    if source_fs == target_fs:
        return df
    place = df.columns.index(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if x is None else _resample(np.array(x, float), int(len(x) * target_fs / source_fs)).tolist() for x in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    fields = [StructField(f.name, ArrayType(DoubleType())) if f.name == samples else f for f in df.schema.fields]
    return df.mapInArrow(run, StructType(fields))


def _resample(x: np.ndarray, n: int) -> np.ndarray:
    if not n or not len(x):
        return np.zeros(0)
    spectrum = np.fft.rfft(x)
    least = min(n, len(x))
    out = np.zeros(n // 2 + 1, complex)
    out[: least // 2 + 1] = spectrum[: least // 2 + 1]
    if least % 2 == 0 and n != len(x):
        # the bin at half the lower rate stands for two of the longer signal
        out[least // 2] *= 2 if n < len(x) else 0.5
    return np.fft.irfft(out, n) * (n / len(x))
