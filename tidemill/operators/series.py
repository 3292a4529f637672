"""Series transforms: one output array a series, as SQL array expressions; FFT-like kernels run on Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A

# Standard normal break-points for alphabets of 2 to 10 letters, two decimals.
BREAK_POINTS = {
    2: [0.0],
    3: [-0.43, 0.43],
    4: [-0.67, 0.0, 0.67],
    5: [-0.84, -0.25, 0.25, 0.84],
    6: [-0.97, -0.43, 0.0, 0.43, 0.97],
    7: [-1.07, -0.57, -0.18, 0.18, 0.57, 1.07],
    8: [-1.15, -0.67, -0.32, 0.0, 0.32, 0.67, 1.15],
    9: [-1.22, -0.76, -0.43, -0.14, 0.14, 0.43, 0.76, 1.22],
    10: [-1.28, -0.84, -0.52, -0.25, 0.0, 0.25, 0.52, 0.84, 1.28],
}


def autocorrelation(a: Column, most: int) -> Column:
    """For lags 1 to ``most``: correlation of the head and the tail, each about its own mean, over its own deviation; a constant part gives 0."""

    def at(lag: Column) -> Column:
        n = F.size(a) - lag
        parts = F.struct(F.slice(a, F.lit(1), n).alias("x"), F.slice(a, lag + 1, n).alias("y"))
        means = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), A.mean(p["x"]).alias("mx"), A.mean(p["y"]).alias("my"), F.sqrt(A.variance(p["x"]) * A.variance(p["y"])).alias("sd"))
        cov = lambda p: A.total(F.zip_with(p["x"], p["y"], lambda u, v: (u - p["mx"]) * (v - p["my"]))) / n
        return A.let(A.let(parts, means), lambda p: F.when(p["sd"] > 0, cov(p) / p["sd"]).otherwise(0.0))

    return F.transform(F.sequence(F.lit(1), F.lit(most)), at)


def derivative(a: Column) -> Column:
    """((x_i - x_{i-1}) + (x_{i+1} - x_{i-1}) / 2) / 2; the ends repeat their neighbours'."""
    inner = F.transform(F.sequence(F.lit(2), F.size(a) - 1), lambda i: ((F.element_at(a, i) - F.element_at(a, i - 1)) + (F.element_at(a, i + 1) - F.element_at(a, i - 1)) / 2) / 2)
    return F.concat(F.slice(inner, 1, 1), inner, F.slice(inner, -1, 1))


def differences(a: Column, lag: int = 1) -> Column:
    n = F.size(a) - lag
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(lag + 1), n), lambda x, y: x - y)


def paa(a: Column, k: int, size: int) -> Column:
    """Means of k equal segments of a series of ``size`` points, boundary points shared by weight."""
    if k > size:
        raise ValueError("more segments than points")
    width = size / k
    out = []
    for i in range(k):
        lo, hi = i * width, (i + 1) * width
        terms = [(j, min(hi, j + 1) - max(lo, j)) for j in range(int(lo), min(size, math.ceil(hi - 1e-12)))]
        out.append(sum((F.element_at(a, j + 1) * w for j, w in terms[1:]), F.element_at(a, terms[0][0] + 1) * terms[0][1]) / width)
    return F.array(*out)


def sax(a: Column, k: int, size: int, alphabet: int = 4) -> Column:
    """Letters of the segment means (no normalisation inside)."""
    letter = lambda v: F.substring(F.lit("abcdefghij"), sum((F.when(v > b, 1).otherwise(0) for b in BREAK_POINTS[alphabet]), F.lit(1)), F.lit(1))
    return F.concat_ws("", F.transform(paa(a, k, size), letter))


def clip(a: Column) -> Column:
    return A.let(A.mean(a), lambda m: F.transform(a, lambda x: F.when(x.isNotNull(), F.when(x >= m, 1).otherwise(0))))


def run_lengths(a: Column, longest: int = 50) -> Column:
    """How many runs above or under the mean have each length 1 to ``longest`` (longer runs count as the longest)."""
    bits = clip(a)
    state = F.aggregate(
        bits, F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("done")),
        lambda s, b: F.when(s["last"] == b, F.struct(b.alias("last"), (s["n"] + 1).alias("n"), s["done"].alias("done"))).otherwise(F.struct(b.alias("last"), F.lit(1).alias("n"), F.when(s["n"] > 0, F.array_append(s["done"], s["n"])).otherwise(s["done"]).alias("done"))),
        lambda s: F.array_append(s["done"], s["n"]),
    )
    return F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.size(F.filter(state, lambda r: F.least(r, F.lit(longest)) == k)))


def cosine_transform(a: Column) -> Column:
    n = F.size(a)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: A.total(F.transform(a, lambda x, i: x * F.cos(k * (i + 0.5) * math.pi / n))))


def sine_transform(a: Column) -> Column:
    n = F.size(a)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: A.total(F.transform(a, lambda x, i: x * F.sin((k + 1) * (i + 0.5) * math.pi / n))))


def hilbert_transform(a: Column) -> Column:
    n = F.size(a)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: A.total(F.transform(a, lambda x, i: F.when(i != k, x / (k - i)).otherwise(0.0))))


def summary(a: Column) -> Column:
    """mean, sd (n-1), skew, kurtosis, min, max."""
    n = F.size(a)

    def all_of(p: Column) -> Column:
        m, sd = p["m"], p["sd"]
        moment = lambda k: A.total(F.transform(a, lambda x: F.pow(x - m, k)))
        return F.struct(m.alias("mean"), sd.alias("sd"), (moment(3) / (F.pow(sd, 3) * n)).alias("skew"), (moment(4) / (F.pow(sd, 4) * n)).alias("kurtosis"), F.array_min(a).alias("min"), F.array_max(a).alias("max"))

    return A.let(F.struct(A.mean(a).alias("m"), F.sqrt(A.variance(a, False)).alias("sd")), all_of)


def sliding_windows(df: DataFrame, series: str, width: int) -> DataFrame:
    return df.select(*(c for c in df.columns if c != series), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(series) - width + 1), lambda i: F.slice(F.col(series), i, F.lit(width)))).alias("start", "window"))


def disjoint_windows(a: Column, width: int) -> Column:
    """ceil(n / width) windows; the last begins at n - width and may overlap."""
    n = F.size(a)
    return F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda k: F.slice(a, F.least(k * width, n - width) + 1, F.lit(width)))


def rank_order(df: DataFrame, series_id: str, series: str) -> DataFrame:
    """(id, t, rank): at each time point the rank of a series' value among all series, by id on ties."""
    long = df.select(series_id, F.posexplode(series).alias("t", "value"))
    return long.select(series_id, "t", F.row_number().over(Window.partitionBy("t").orderBy("value", series_id)).alias("rank"))


def binary_split(df: DataFrame, series_id: str, label: str, series: str) -> DataFrame:
    """(t, threshold, gain): per time point the threshold of best information gain between neighbouring distinct values."""
    long = df.select(label, F.posexplode(series).alias("t", "value"))
    counts = long.groupBy("t", "value", label).count()
    totals = counts.groupBy("t", label).agg(F.sum("count").alias("all"))
    grid = counts.select("t", "value").distinct().join(totals, "t").join(counts, ["t", "value", label], "left").na.fill(0, ["count"])
    below = grid.withColumn("below", F.sum("count").over(Window.partitionBy("t", label).orderBy("value")))
    e = lambda c, n: F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0)
    s = below.groupBy("t", "value").agg(F.sum("below").alias("nb"), F.sum("all").alias("na"), F.collect_list(F.struct("below", "all")).alias("c"))
    h = lambda f, n: F.aggregate("c", F.lit(0.0), lambda acc, x: acc + e(f(x), n))
    gain = h(lambda x: x["all"], F.col("na")) - F.col("nb") / F.col("na") * h(lambda x: x["below"], F.col("nb")) - (1 - F.col("nb") / F.col("na")) * h(lambda x: x["all"] - x["below"], F.col("na") - F.col("nb"))
    scored = s.withColumn("gain", gain).withColumn("next", F.lead("value").over(Window.partitionBy("t").orderBy("value"))).where("next is not null")
    best = scored.groupBy("t").agg(F.max(F.struct("gain", (-F.col("value")).alias("v"), "next")).alias("b"))
    return best.select("t", ((F.col("b.next") - F.col("b.v")) / 2).alias("threshold"), F.col("b.gain").alias("gain"))


def lag_columns(df: DataFrame, series: str, order: list[str], value: str, lags: list[int]) -> DataFrame:
    w = Window.partitionBy(series).orderBy(*order)
    return df.withColumns({f"{value}_lag{k}": F.lag(value, k).over(w) if k >= 0 else F.lead(value, -k).over(w) for k in lags})


def delta(df: DataFrame, series: str, order: list[str], value: str, offset: int = -1) -> DataFrame:
    w = Window.partitionBy(series).orderBy(*order)
    other = F.lag(value, -offset).over(w) if offset < 0 else F.lead(value, offset).over(w)
    return df.withColumn(f"{value}_delta", F.col(value) - other)


def to_array(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    return df.groupBy(series).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value]).alias("series"))


def to_channels(df: DataFrame, series: str, length: int, name: str = "channels") -> DataFrame:
    """The flat series cut into channels of equal length: ``array<array<double>>``; a rest shorter than that raises on use."""
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size(series) / length).cast("int") - 1), lambda i: F.slice(F.col(series), i * length + 1, F.lit(length)))
    whole = F.when(F.size(series) % length == 0, cut).otherwise(F.raise_error(F.lit("the series is no whole number of channels")))
    return df.withColumn(name, whole)


def transpose_channels(a: Column) -> Column:
    """Channels by time points turned to time points by channels."""
    return F.transform(F.sequence(F.lit(0), F.size(a[0]) - 1), lambda t: F.transform(a, lambda c: F.get(c, t)))


def split_channels(df: DataFrame, id_col: str, channels: str) -> DataFrame:
    """(id, channel, series): one row a channel."""
    return df.select(id_col, F.posexplode(channels).alias("channel", "series"))


def merge_channels(df: DataFrame, id_col: str) -> DataFrame:
    """(id, channels) of (id, channel, series) rows, in the order of the channels."""
    return df.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "series"))), lambda x: x["series"]).alias("channels"))


def last_significant(acf: Column, size: int, z: float = 1.6448536269514722) -> Column:
    """The last lag whose correlation is beyond z / sqrt(size); 0 where none is."""
    at = F.filter(F.transform(acf, lambda x, i: F.when(F.abs(x) > z / math.sqrt(size), i + 1).otherwise(0)), lambda k: k > 0)
    return F.coalesce(F.array_max(at), F.lit(0))


def truncate_all(df: DataFrame, acf: str, own: str, out: str) -> DataFrame:
    """Every row's correlations cut after the last lag that is significant in any row."""
    return df.withColumn(out, F.slice(acf, F.lit(1), F.lit(df.agg(F.max(own)).first()[0] or 0)))


def interval(a: Column, start: int, length: int) -> Column:
    return F.slice(a, start + 1, length)


def transform_inputs(df: DataFrame, id_col: str, series: str, size: int) -> DataFrame:
    """One column a transform (raw, derivative, autocorrelation, power spectrum): the inputs of a transform ensemble."""
    a = F.col(series)
    most = max(1, min(100, (size - 1) // 4 if (size - 1) // 4 >= 10 else size - 1))
    return df.select(id_col, a.alias("raw"), derivative(a).alias("derivative"), autocorrelation(a, min(most, size - 4)).alias("acf"), power_spectrum(series).alias("power"))


def acf_pacf_ar(df: DataFrame, keep: list[str], series: str, most: int) -> DataFrame:
    """``features``: autocorrelations, partial autocorrelations and autoregressive coefficients end to end."""
    return df.select(*keep, F.concat(autocorrelation(F.col(series), most), partial_autocorrelation(series), autoregression(series)).alias("features"))


def normalise_time_points(df: DataFrame, id_col: str, series: str, size: int) -> DataFrame:
    """Each time point scaled to [0, 1] over all series (one aggregate; a constant point gives 0)."""
    at = lambda i: F.element_at(series, i + 1)
    r = df.agg(*(f(at(i)).alias(f"{n}{i}") for i in range(size) for n, f in (("a", F.min), ("b", F.max)))).first()
    low, width = (F.array(*(F.lit(float(v)) for v in x)) for x in ([r[f"a{i}"] for i in range(size)], [(r[f"b{i}"] - r[f"a{i}"]) or float("inf") for i in range(size)]))
    return df.select(id_col, F.zip_with(F.zip_with(series, low, lambda x, l: x - l), width, lambda x, w: x / w).alias("scaled"))


def unit_interval(a: Column) -> Column:
    """A series scaled to [0, 1]; a constant one gives zeros."""
    return A.let(F.struct(F.array_min(a).alias("l"), F.array_max(a).alias("h")), lambda p: F.transform(a, lambda x: F.when(p["h"] > p["l"], (x - p["l"]) / (p["h"] - p["l"])).otherwise(0.0)))


def unit_deviation(a: Column) -> Column:
    """A series over its population deviation; a constant one stays."""
    return A.let(F.sqrt(A.variance(a)), lambda sd: F.transform(a, lambda x: F.when(sd > 0, x / sd).otherwise(x)))


def to_long(df: DataFrame, series_id: str, series: str) -> DataFrame:
    return df.select(series_id, F.posexplode(series).alias("t", "value"))


def _batched(kernel, returns: str):
    """A function of a column: a pandas UDF that applies a numpy kernel to all rows of equal length of an Arrow batch at once."""

    def run(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        known = s[s.notna()]
        for _, group in known.groupby(known.map(len)):
            for i, row in zip(group.index, kernel(np.stack(group.to_list()).astype(float)), strict=True):
                out[i] = row
        return out

    return lambda column: F.pandas_udf(run, returns)(column)


def _fft(x: np.ndarray, pad: bool = False) -> np.ndarray:
    n = 1 << (x.shape[1] - 1).bit_length() if pad else x.shape[1]
    return np.fft.fft(x, n, axis=1)


fourier = _batched(lambda x: np.stack([_fft(x).real, _fft(x).imag], 2).reshape(len(x), -1), "array<double>")
power_spectrum = _batched(lambda x: (np.abs(_fft(x)) ** 2)[:, : x.shape[1] // 2], "array<double>")
power_cepstrum = _batched(lambda x: np.abs(np.fft.ifft(np.log(np.maximum(np.abs(_fft(x)) ** 2, 1e-12)), axis=1))[:, : x.shape[1] // 2] ** 2, "array<double>")


def _durbin(x: np.ndarray, most: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Partial autocorrelations and autoregressive coefficients by Durbin-Levinson on biased autocovariances."""
    c = x - x.mean(1, keepdims=True)
    n = x.shape[1]
    r = np.stack([(c[:, : n - k] * c[:, k:]).sum(1) / n for k in range(most + 1)], 1)
    r = r / np.where(r[:, :1] > 0, r[:, :1], 1)
    phi, pacf, err = np.zeros((len(x), most + 1)), np.zeros((len(x), most)), np.ones(len(x))
    for k in range(1, most + 1):
        a = (r[:, k] - (phi[:, 1:k] * r[:, k - 1 : 0 : -1]).sum(1)) / np.where(err > 1e-12, err, 1)
        new = phi.copy()
        new[:, k] = a
        new[:, 1:k] = phi[:, 1:k] - a[:, None] * phi[:, k - 1 : 0 : -1]
        phi, err = new, err * (1 - a * a)
        pacf[:, k - 1] = a
    return pacf, phi[:, 1:]


def _autoregression(x: np.ndarray, most: int = 10) -> np.ndarray:
    """Coefficients of the order at which log of the error variance plus 2(i+1)/n first rises, zero padded."""
    n, most = x.shape[1], min(most, x.shape[1] - 1)
    pacf, _ = _durbin(x, most)
    error = np.cumprod(1 - pacf**2, axis=1) * np.maximum(((x - x.mean(1, keepdims=True)) ** 2).mean(1, keepdims=True), 1e-300)
    aic = np.log(np.maximum(error, 1e-300)) + 2 * (np.arange(most) + 1) / n
    rises = np.c_[np.diff(aic, axis=1) > 0, np.ones(len(x), bool)]
    best = rises.argmax(1) + 1
    out = np.zeros((len(x), most))
    for k in np.unique(best):
        at = best == k
        out[at, :k] = _durbin(x[at], int(k))[1]
    return out


autoregression_by_aic = _batched(_autoregression, "array<double>")
partial_autocorrelation = _batched(lambda x: _durbin(x, min(10, x.shape[1] - 1))[0], "array<double>")
autoregression = _batched(lambda x: _durbin(x, min(10, x.shape[1] - 1))[1], "array<double>")


def _haar(x: np.ndarray) -> np.ndarray:
    """Haar pyramid, zero padded to a power of two: overall average first, coarse to fine details after."""
    n = 1 << (x.shape[1] - 1).bit_length()
    a = np.zeros((len(x), n))
    a[:, : x.shape[1]] = x
    details = []
    while a.shape[1] > 1:
        details.append((a[:, ::2] - a[:, 1::2]) / np.sqrt(2))
        a = (a[:, ::2] + a[:, 1::2]) / np.sqrt(2)
    return np.concatenate([a, *reversed(details)], 1)


haar = _batched(_haar, "array<double>")


def matrix_profile(width: int):
    """Least squared distance of each z-normalised window to one that starts over 1.5 widths away."""

    def kernel(x: np.ndarray) -> np.ndarray:
        if not 3 <= width <= x.shape[1] // 4:
            raise ValueError("the window is from 3 to a quarter of the series")
        w = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)
        sd = w.std(2, keepdims=True)
        z = np.where(sd > 0, (w - w.mean(2, keepdims=True)) / np.where(sd > 0, sd, 1), 0)
        i = np.arange(z.shape[1])
        near = np.abs(i[:, None] - i) <= 1.5 * width
        out = []
        for row in z:
            d = np.maximum((row * row).sum(1)[:, None] + (row * row).sum(1) - 2 * row @ row.T, 0)
            d[near] = np.inf
            out.append(d.min(1))
        return np.stack(out)

    return _batched(kernel, "array<double>")
