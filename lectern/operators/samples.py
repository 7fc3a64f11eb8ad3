"""Audio samples as arrays: resampling, frames, quantising, bands and the inverse transform of spectra.

One row holds one clip, so arrays are bounded by what is spoken at once; clips of an entry are joined in segments, never in one row.

Edge cases (tests/test_samples.py): null clips give null, or no samples where clips are joined, and empty ones no samples; clips of an
entry that are equal in order come in any order; repeated rows are clips of their own; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.session import settle

# Fixed values
RATES = (8000, 12000, 16000, 24000, 48000)
#: Number of bands, taps, cutoff and shape of the window by the rate of the lowest band.
BANDS = {24000: (2, 62, 0.25, 10.0), 8000: (6, 62, 0.12, 9.0)}
# End of fixed values


def resample(samples: Column, rate_in: int, rate_out: int) -> Column:
    """Linear interpolation to ceil(n * out / in) samples; the last sample is held."""
    n = F.size(samples)
    count = F.ceil(n * F.lit(rate_out) / F.lit(rate_in)).cast("int")

    def at(k: Column) -> Column:
        position = k * F.lit(rate_in / rate_out)
        low = F.least(F.floor(position).cast("int"), n - 1)
        a, b = F.get(samples, low), F.get(samples, F.least(low + 1, n - 1))
        return a + (b - a) * (position - low)

    return F.when(n == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), at))


def rounded(samples: Column, digits: int) -> Column:
    """Samples to so many decimals, each with its sign: small negative ones are negative zeros, as IEEE rounding has it."""
    return F.transform(samples, lambda x: F.signum(x) * F.abs(F.round(x, digits)))


def nearest_rate(rate: Column, rates: tuple[int, ...] = RATES) -> Column:
    """The rate with the least difference, the smaller on a tie."""
    return F.array_min(F.transform(F.array(*map(F.lit, rates)), lambda r: F.struct(F.abs(r - rate).alias("apart"), r.alias("rate"))))["rate"]


def pcm16(samples: Column) -> Column:
    """Samples cut to [-1, 1] as 16-bit integers."""
    return F.transform(samples, lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("smallint"))


def frames(samples: Column, size: int) -> Column:
    """array<struct<frame, granule, samples>> of equal frames, the last one padded with zeros."""
    count = F.ceil(F.size(samples) / F.lit(size)).cast("int")

    def frame(k: Column) -> Column:
        part = F.slice(samples, k * size + 1, size)
        return F.struct(k.alias("frame"), ((k + 1) * size).alias("granule"), F.concat(part, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(part))).alias("samples"))

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), frame))


def frame_count(duration: Column) -> Column:
    return F.greatest(F.floor(duration + 0.5), F.lit(0)).cast("long")


def duration_seconds(samples: Column, rate: int) -> Column:
    return F.size(samples) / F.lit(rate)


def join_clips(clips: DataFrame, key: str, order: str, samples: str, segment: int) -> DataFrame:
    """(key, segment, start, samples): the clips of each entry one after another, in segments of equal size, the last one shorter.

    Only sizes are summed over an entry; each clip is then cut where segments end, and a segment's parts come together by themselves.
    So an entry of any length is as many tasks' work as it has segments.
    """
    rows = settle(clips.select(key, F.col(order).alias("order"), F.coalesce(samples, F.array().cast(clips.schema[samples].dataType)).alias("clip"), F.monotonically_increasing_id().alias("row")), "clips")
    before = Window.partitionBy(key).orderBy("order", "row").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.select(key, "order", "row", F.size("clip").cast("long").alias("size"))
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).where("size > 0").select("row", "offset", "size")
    placed = rows.select(key, "row", "clip").join(offsets, "row")
    cut = placed.select(key, "clip", "offset", F.explode(F.sequence(F.floor(F.col("offset") / segment), F.floor((F.col("offset") + F.col("size") - 1) / segment))).alias("segment"))
    low = F.greatest(F.col("segment") * segment, F.col("offset"))
    part = F.slice("clip", (low - F.col("offset") + 1).cast("int"), ((F.col("segment") + 1) * segment - low).cast("int"))
    parts = cut.select(key, "segment", F.struct(low.alias("start"), part.alias("clip")).alias("part"))
    joined = parts.groupBy(key, "segment").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return joined.select(key, "segment", F.get("parts", 0)["start"].alias("start"), F.flatten(F.transform("parts", lambda p: p["clip"])).alias("samples"))


def durations(clips: DataFrame, key: str, samples: str, rate: int) -> DataFrame:
    """(key, n_samples, seconds) of all clips of each entry."""
    n = F.coalesce(F.sum(F.greatest(F.size(samples), F.lit(0)).cast("long")), F.lit(0))
    return clips.groupBy(key).agg(n.alias("n_samples"), (n / F.lit(rate)).alias("seconds"))


def band_filter(bands: int, taps: int, cutoff: float, beta: float) -> np.ndarray:
    """(bands, taps + 1): a Kaiser-windowed low pass of unit sum, its cutoff in half sampling rates, moved to the middle of each band."""
    n = np.arange(taps + 1)
    low = np.sinc(cutoff * (n - taps / 2)) * np.kaiser(taps + 1, beta)
    low /= low.sum()
    k = np.arange(bands)[:, None]
    return 2 * low * np.cos((2 * k + 1) * np.pi / (2 * bands) * (n - (taps - 1) / 2) + (-1.0) ** k * np.pi / 4)


def lowest_band(clip: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """The first of the bands, one sample of each `bands`; by tanh if any band exceeds one. An empty clip gives no samples."""
    bands, length = filters.shape
    if not len(clip):
        return np.zeros(0)
    pad = (length - 1) // 2
    padded = np.concatenate((np.zeros(pad), clip, np.zeros(pad)))
    if len(padded) < length:
        return np.zeros(0)
    found = np.array([np.convolve(padded, f[::-1], "valid")[::bands] for f in filters])
    return found[0] if np.abs(found).max() <= 1 else np.tanh(found[0])


def to_lowest_band(samples: Column, rate: int) -> Column:
    """Clips of 48000 samples a second at one of the rates of BANDS."""

    @F.pandas_udf("array<double>")
    def run(clips: pd.Series) -> pd.Series:
        filters = band_filter(*BANDS[rate])
        return pd.Series([None if c is None else lowest_band(np.asarray(c, float), filters) for c in clips], dtype=object)

    return run(samples)


def inverse_transform(magnitude: np.ndarray, x: np.ndarray, y: np.ndarray, hop: int, window: np.ndarray | None = None) -> np.ndarray:
    """Samples of frames (frequency by frame): windowed inverse transforms added where they overlap, over the sum of squared windows.

    A window is four hops long, a periodic Hann window by default; the outer one and a half hops of each end are cut.
    """
    size = 4 * hop
    if window is None:
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    count = magnitude.shape[1]
    parts = np.fft.irfft(magnitude * (x + 1j * y), size, axis=0).T * window
    out, weight = np.zeros(hop * (count + 3)), np.zeros(hop * (count + 3))
    for k in range(4):  # the k-th quarters of all frames lie side by side
        cut = slice(k * hop, (k + count) * hop)
        out[cut] += parts[:, k * hop : (k + 1) * hop].ravel()
        weight[cut] += np.tile(window[k * hop : (k + 1) * hop] ** 2, count)
    pad = (size - hop) // 2
    return out[pad:-pad] / weight[pad:-pad]


def samples_of_spectra(magnitude: Column, x: Column, y: Column, hop: int) -> Column:
    """inverse_transform() of rows of array<array<double>>, frequencies outside; null or without frames: no samples."""

    @F.pandas_udf("array<double>")
    def run(magnitudes: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        whole = lambda rows: np.array([np.asarray(r, float) for r in rows])
        return pd.Series([np.zeros(0) if m is None or not len(m) or not len(m[0]) else inverse_transform(whole(m), whole(a), whole(b), hop) for m, a, b in zip(magnitudes, xs, ys)], dtype=object)

    return run(magnitude, x, y)
