"""The strict 17-feature registry of a window of samples."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from cadenza.functions.signal import quantised

#: The registry in its order: fixed values.
NAMES = (
    "raw_mean", "raw_rms", "raw_std", "raw_peak_abs", "raw_peak_to_peak", "raw_total_ac_power", "raw_bandpower_0_1000", "raw_bandpower_1000_5000", "raw_bandpower_5000_10000",
    "shape_skewness", "shape_excess_kurtosis", "shape_crest_factor", "spectral_relative_power_0_1000", "spectral_relative_power_1000_5000", "spectral_relative_power_5000_10000",
    "spectral_centroid_nyquist_fraction", "spectral_entropy_normalized",
)
#: Where the second and third band begin, in Hz: fixed values.
EDGES = (1000.0, 5000.0)


def _over(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """NaN where the divisor is 0."""
    return np.divide(top, bottom, out=np.full(len(top), np.nan), where=bottom != 0)


@lru_cache(8)
def _window(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The periodic Hann window of n samples, and what each bin of a one-sided spectrum is multiplied by."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    scale = np.full(n // 2 + 1, 1 / ((hann**2).sum() * n))
    scale[1 : (n + 1) // 2] *= 2
    return hann, scale


def registry(x: np.ndarray, fs: float = 20_000.0, edges: tuple[float, float] = EDGES) -> np.ndarray:
    """The 17 features of rows of equally many samples, NaN for undefined ones. The spectrum is the
    one-sided periodogram of the centred samples under a periodic Hann window; its bins, times their
    width, are powers that three bands share out without rest."""
    n = x.shape[1]
    flat = (x == x[:, :1]).all(1)
    mean = np.where(flat, x[:, 0], x.mean(1))
    c = np.where(flat[:, None], 0.0, x - mean[:, None])
    square = c * c
    m2, m3, m4 = square.mean(1), np.einsum("ij,ij->i", square, c) / n, np.einsum("ij,ij->i", square, square) / n
    high, low = x.max(1), x.min(1)
    rms, peak = np.sqrt(np.einsum("ij,ij->i", x, x) / n), np.maximum(np.abs(high), np.abs(low))
    hann, scale = _window(n)
    spectrum = np.fft.rfft(c * hann)
    power = (spectrum.real**2 + spectrum.imag**2) * scale
    f = np.fft.rfftfreq(n, 1 / fs)
    total = power.sum(1)
    first, second = np.searchsorted(f, edges)
    bands = [power[:, a:b].sum(1) for a, b in ((0, first), (first, second), (second, len(f)))]
    p = np.divide(power, total[:, None], out=np.zeros_like(power), where=total[:, None] > 0)
    entropy = -np.einsum("ij,ij->i", p, np.log(np.maximum(p, 1e-300))) / np.log(len(f))
    crest = np.where(flat & (rms > 0), 1.0, _over(peak, rms))
    return np.stack([
        mean, rms, np.sqrt(m2), peak, high - low, total, *bands, _over(m3, m2**1.5), _over(m4, m2**2) - 3, crest,
        *(_over(b, total) for b in bands), _over(power @ f, total) / (fs / 2), np.where(total > 0, entropy, np.nan),
    ], 1)


def registry_features(df: DataFrame, samples: str, fs: float = 20_000.0, edges: tuple[float, float] = EDGES) -> DataFrame:
    """Adds the features as columns, null where undefined; a window that is null, empty or has a value
    that isn't finite has none. Arrow batches are transformed by groups of equal length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.full((len(b), len(NAMES)), np.nan)
            lengths = b[samples].map(lambda v: 0 if v is None else len(v)).to_numpy()
            for n in np.unique(lengths[lengths > 1]):
                rows = np.flatnonzero(lengths == n)
                x = np.stack([np.asarray(b[samples].iloc[r], float) for r in rows])
                good = np.isfinite(x).all(1)
                if good.any():
                    out[rows[good]] = registry(x[good], fs, edges)
            yield pd.concat([b, pd.DataFrame(out, columns=list(NAMES), index=b.index)], axis=1)

    added = df.mapInPandas(run, StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in NAMES)]))
    return added.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in NAMES})


def registry_summary(df: DataFrame, signal: str, width: int = 2048, step: int = 1024, windows: int | None = 19, fs: float = 20_000.0, edges: tuple[float, float] = EDGES, quantise: bool = True) -> DataFrame:
    """Adds what all windows of a signal give together: feature_values (mean and population deviation of
    each feature over the windows that define it, quantised unless told otherwise, null where none does),
    valid_window_counts (how many do) and window_count. A signal that is null, has a value that isn't
    finite, or doesn't give `windows` windows, has nulls. A signal's windows never leave its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts, n_windows = [], [], []
            column = batch.column(place)
            flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy())
            for end, n, null in zip(ends.tolist(), column.value_lengths().fill_null(0).to_pylist(), column.is_null().to_pylist(), strict=True):
                x = flat[end - n : end]
                cut = np.lib.stride_tricks.sliding_window_view(x, width)[::step] if n >= width else np.zeros((0, width))
                if null or not len(cut) or (windows is not None and len(cut) != windows) or not np.isfinite(x).all():
                    values.append(None)
                    counts.append(None)
                    n_windows.append(None)
                    continue
                f = registry(np.ascontiguousarray(cut), fs, edges)
                known = ~np.isnan(f)
                valid = known.sum(0)
                mean = np.divide(np.where(known, f, 0.0).sum(0), valid, out=np.full(len(NAMES), np.nan), where=valid > 0)
                deviation = np.sqrt(np.divide(np.where(known, (f - mean) ** 2, 0.0).sum(0), valid, out=np.full(len(NAMES), np.nan), where=valid > 0))
                both = np.stack([mean, deviation], 1).ravel()
                values.append([None if np.isnan(v) else v for v in both.tolist()])
                counts.append(valid.tolist())
                n_windows.append(len(cut))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float64())), pa.array(counts, pa.list_(pa.int32())), pa.array(n_windows, pa.int32())], [*batch.schema.names, "feature_values", "valid_window_counts", "window_count"])

    place = df.columns.index(signal)
    added = df.mapInArrow(run, StructType([*df.schema.fields, StructField("feature_values", ArrayType(DoubleType())), StructField("valid_window_counts", ArrayType(IntegerType())), StructField("window_count", IntegerType())]))
    return added.withColumn("feature_values", F.transform("feature_values", quantised)) if quantise else added


def feature_rows(channels: DataFrame, key: str = "name", channel: str = "channel", signal: str = "signal", contract: str = "", **options) -> DataFrame:
    """A row for each channel of a recording: feature_row_id, a hash of the contract's name, the key and
    the channel, and the summary of its signal, which goes. contract: what the features are made by, for
    example a digest of the settings."""
    from cadenza.operators.identity import sorted_id

    rows = registry_summary(channels, signal, **options).drop(signal)
    return rows.select(sorted_id("feature_row", contract=F.lit(contract), recording=F.col(key).cast("string"), channel=F.col(channel).cast("int")).alias("feature_row_id"), *rows.columns)
