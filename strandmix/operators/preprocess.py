"""Signal preprocessing as DataFrame expressions.

What needs a subject's rows in order uses one window per subject, or one pass over sorted rows. What needs only a subject's figures uses
an aggregation, which combines before it shuffles, joined back by subject; adaptive execution broadcasts small figures and splits
subjects with very many rows. A pipeline of steps is one pass, unless some series is too long to be held.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmix.functions import iir
from strandmix.operators.blocks import over_neighbours
from strandmix.operators.medians import mean_of_largest, medians
from strandmix.operators.series import WHOLE, Step, filtered, in_one_pass, longest
from strandmix.sources.panel import Panel


def _with_stats(panel: Panel, stats: dict[str, Column]) -> DataFrame:
    """The panel's rows with figures of their subject."""
    return panel.df.join(panel.df.groupBy("subject_id").agg(*(x.alias(name) for name, x in stats.items())), "subject_id")


def _by_median(panel: Panel, size: bool, value: Callable[[str], Column]) -> Panel:
    """Each channel replaced by an expression over itself and its median, of absolute values with ``size``.

    Series that a task can hold are gathered by Spark's median; where some can't, medians are closed in on.
    """
    figure = lambda c: F.abs(F.col(c)) if size else F.col(c)
    if longest(panel) <= WHOLE:
        return _each(panel, lambda c: {f"{c}__m": F.median(figure(c))}, value)
    found = medians(panel.with_df(panel.df.select("subject_id", "t", *(figure(c).alias(c) for c in panel.channels))).long().drop("t"))
    wide = found.groupBy("subject_id").pivot("channel", list(panel.channels)).agg(F.first("median"))
    joined = panel.df.join(wide.select("subject_id", *(F.col(c).alias(f"{c}__m") for c in panel.channels)), "subject_id", "left")
    rest = [x for x in panel.df.columns if x not in panel.channels]
    return panel.with_df(joined.select(*rest, *(value(c).alias(c) for c in panel.channels)))


def _each(panel: Panel, stats: Callable[[str], dict[str, Column]], value: Callable[[str], Column]) -> Panel:
    """Each channel replaced by an expression over itself and its subject's figures."""
    every = {name: x for c in panel.channels for name, x in stats(c).items()}
    df = _with_stats(panel, every) if every else panel.df
    rest = [x for x in panel.df.columns if x not in panel.channels]
    return panel.with_df(df.select(*rest, *(value(c).alias(c) for c in panel.channels)))


def remove_offset(panel: Panel, method: str = "mean", degree: int = 1) -> Panel:
    """Subtract the mean, the median, a straight line or a polynomial in time, per subject and channel."""
    if method == "mean":
        return _each(panel, lambda c: {f"{c}__m": F.avg(c)}, lambda c: F.col(c) - F.col(f"{c}__m"))
    if method == "median":
        return _by_median(panel, False, lambda c: F.col(c) - F.col(f"{c}__m"))
    if method == "linear":
        stats = lambda c: {f"{c}__s": F.regr_slope(F.col(c), F.col("t").cast("double")), f"{c}__i": F.regr_intercept(F.col(c), F.col("t").cast("double"))}
        return _each(panel, stats, lambda c: F.col(c) - F.coalesce(F.col(f"{c}__i") + F.col(f"{c}__s") * F.col("t"), F.col(c)))
    if method == "polynomial":
        return _polynomial(panel, degree)
    raise ValueError(f"unknown method {method!r}")


def _polynomial(panel: Panel, degree: int) -> Panel:
    """Least squares by power sums: one aggregation, a small solve per subject, one projection. Time is scaled to -1..1 for the solve."""
    if degree < 1:
        raise ValueError("degree must be at least 1")
    span = panel.df.join(panel.df.groupBy("subject_id").agg(F.count("*").alias("n__")), "subject_id")
    u = F.when(F.col("n__") > 1, (2.0 * F.col("t") - F.col("n__") - 1) / (F.col("n__") - 1)).otherwise(F.lit(0.0))
    scaled = span.withColumn("u__", u)
    power = lambda k: F.pow(F.col("u__"), F.lit(float(k))) if k else F.lit(1.0)
    sums = []
    for c in panel.channels:
        there = F.col(c).isNotNull()
        sums.append(F.array(*(F.coalesce(F.sum(F.when(there, power(k))), F.lit(0.0)) for k in range(2 * degree + 1)), *(F.coalesce(F.sum(F.col(c) * power(k)), F.lit(0.0)) for k in range(degree + 1))).alias(f"{c}__p"))

    @F.pandas_udf("array<double>")
    def solve(rows: pd.Series) -> pd.Series:
        def one(row):
            a = np.array([[row[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
            return np.linalg.lstsq(a, np.array(row[2 * degree + 1 :]), rcond=None)[0]

        return rows.map(one)

    fits = scaled.groupBy("subject_id").agg(*sums).select("subject_id", *(solve(f"{c}__p").alias(f"{c}__p") for c in panel.channels))
    joined = scaled.join(fits, "subject_id")
    value = lambda c: F.col(c) - sum((F.col(f"{c}__p")[k] * power(k) for k in range(degree + 1)), F.lit(0.0))
    rest = [x for x in panel.df.columns if x not in panel.channels]
    return panel.with_df(joined.select(*rest, *(value(c).alias(c) for c in panel.channels)))


def rectify(panel: Panel, method: str = "full_wave") -> Panel:
    """Absolute values, or negative ones replaced by 0."""
    if method not in ("full_wave", "half_wave"):
        raise ValueError(f"unknown method {method!r}")
    return _each(panel, lambda c: {}, lambda c: F.abs(c) if method == "full_wave" else F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0))))


def window_width(window_ms: float, fs: float) -> int:
    """Rows of a window, rounded half to even."""
    return max(1, int(np.round(window_ms * fs / 1000)))


def envelope_rms(panel: Panel, window_ms: float, fs: float) -> Panel:
    """Root of the mean square over the rows up to half a window away; shorter at the ends."""
    h = window_width(window_ms, fs) // 2
    mean = lambda w: [F.sqrt(F.avg(F.col(c) * F.col(c)).over(w.rowsBetween(-h, h))).alias(c) for c in panel.channels]
    return panel.with_df(over_neighbours(panel, h, h, mean))


def envelope_moving_average(panel: Panel, window_ms: float, fs: float) -> Panel:
    """Mean over a centred window, an even one with its extra row ahead; at the ends over the rows up to half a window away."""
    w = window_width(window_ms, fs)
    h = w // 2
    behind = w - 1 - h

    def mean(time):
        whole, near = time.rowsBetween(-behind, h), time.rowsBetween(-h, h)
        return [F.when(F.count(c).over(whole) == w, F.avg(c).over(whole)).otherwise(F.avg(c).over(near)).alias(c) for c in panel.channels]

    return panel.with_df(over_neighbours(panel, h, h, mean))


def bandpass_sections(fs: float, low: float = 20, high: float = 450, order: int = 4, kind: str = "butterworth") -> np.ndarray:
    """Sections of a band pass."""
    if not 0 < low < high < fs / 2:
        raise ValueError(f"cut-offs must satisfy 0 < low < high < {fs / 2}")
    return iir.design(kind, order, "band", (low, high), fs)


def bandpass(panel: Panel, fs: float, low: float = 20, high: float = 450, order: int = 4, kind: str = "butterworth", zero_phase: bool = True) -> Panel:
    """Keep the frequencies between two cut-offs."""
    return filtered(panel, bandpass_sections(fs, low, high, order, kind), zero_phase)


def notch_sections(fs: float, freq: float = 50, q: float = 30, harmonics: bool = True) -> np.ndarray | None:
    half = fs / 2
    if not 0 < freq < half:
        raise ValueError(f"the frequency must lie between 0 and {half}")
    freqs = [freq * k for k in range(1, int(half // freq) + 1) if freq * k < 0.95 * half] if harmonics else [freq]
    bands = [(f - f / q / 2, f + f / q / 2) for f in freqs]
    sections = [iir.design("butterworth", 2, "stop", band, fs) for band in bands if band[0] > 0 and band[1] < half]
    return np.concatenate(sections) if sections else None


def notch(panel: Panel, fs: float, freq: float = 50, q: float = 30, harmonics: bool = True, zero_phase: bool = True) -> Panel:
    """Remove a frequency and, with ``harmonics``, its multiples below 0.95 of half the sampling rate; stop bands that don't fit are left out."""
    sections = notch_sections(fs, freq, q, harmonics)
    return panel if sections is None else filtered(panel, sections, zero_phase)


def lowpass_sections(fs: float, cutoff: float = 6, order: int = 4) -> np.ndarray:
    return iir.design("butterworth", order, "low", (min(cutoff, 0.95 * fs / 2) if cutoff >= fs / 2 else cutoff,), fs)


def envelope_lowpass(panel: Panel, fs: float, cutoff: float = 6, order: int = 4, zero_phase: bool = True) -> Panel:
    """Smooth by a low pass; a cut-off at half the sampling rate or above becomes 0.95 of it."""
    return filtered(panel, lowpass_sections(fs, cutoff, order), zero_phase)


def normalize(panel: Panel, method: str = "max", reference: DataFrame | None = None) -> Panel:
    """Scale each subject's channels: by the maximum, mean or median of absolute values, to z-scores, to 0..1, or to per cent of a reference.

    ``reference``, for ``mvc``, has (subject_id, channel, reference). Where it is missing or 0 the maximum takes its place. Division by
    0 gives null; a constant channel has range 0.
    """
    size = lambda c: F.abs(F.col(c))
    if method == "median":
        return _by_median(panel, True, lambda c: F.try_divide(F.col(c), F.col(f"{c}__m")))
    if method in ("max", "mean"):
        figure = {"max": F.max, "mean": F.avg}[method]
        return _each(panel, lambda c: {f"{c}__m": figure(size(c))}, lambda c: F.try_divide(F.col(c), F.col(f"{c}__m")))
    if method == "zscore":
        return _each(panel, lambda c: {f"{c}__m": F.avg(c), f"{c}__s": F.stddev_samp(c)}, lambda c: F.try_divide(F.col(c) - F.col(f"{c}__m"), F.col(f"{c}__s")))
    if method == "range":
        scaled = lambda c: F.when(F.col(f"{c}__h") == F.col(f"{c}__l"), F.lit(0.0)).otherwise(F.try_divide(F.col(c) - F.col(f"{c}__l"), F.col(f"{c}__h") - F.col(f"{c}__l")))
        return _each(panel, lambda c: {f"{c}__l": F.min(c), f"{c}__h": F.max(c)}, lambda c: F.when(F.col(c).isNotNull(), scaled(c)))
    if method == "mvc":
        if reference is None:
            raise ValueError("method mvc needs a reference")
        wide = _wide(reference, panel.channels)
        with_max = _with_stats(panel, {f"{c}__m": F.max(size(c)) for c in panel.channels}).join(wide, "subject_id", "left")
        value = lambda c: F.when(F.coalesce(F.col(f"{c}__r"), F.lit(0.0)) != 0, 100 * F.col(c) / F.col(f"{c}__r")).otherwise(F.try_divide(F.col(c), F.col(f"{c}__m")))
        rest = [x for x in panel.df.columns if x not in panel.channels]
        return panel.with_df(with_max.select(*rest, *(value(c).alias(c) for c in panel.channels)))
    raise ValueError(f"unknown method {method!r}")


def normalize_pooled(panel: Panel, method: str = "max", reference: DataFrame | None = None) -> Panel:
    """The same scales from a subject's values of all channels together.

    ``reference``, for ``mvc``, has (subject_id, reference); where it is missing or 0 the maximum of all channels takes its place.
    """
    long = panel.df.select("subject_id", F.explode(F.array(*panel.channels)).alias("v"))
    size = F.abs("v")
    figures = {"max": [F.max(size)], "mean": [F.avg(size)], "median": [F.median(size)], "zscore": [F.avg("v"), F.stddev_samp("v")], "range": [F.min("v"), F.max("v")], "mvc": [F.max(size)]}
    if method not in figures:
        raise ValueError(f"unknown method {method!r}")
    if method == "mvc" and reference is None:
        raise ValueError("method mvc needs a reference")
    stats = long.groupBy("subject_id").agg(*(x.alias(f"s{k}__") for k, x in enumerate(figures[method])))
    if method == "mvc":
        stats = stats.join(reference.select("subject_id", F.col("reference").alias("r__")), "subject_id", "left")
        stats = stats.withColumn("s0__", F.when(F.coalesce("r__", F.lit(0.0)) != 0, F.col("r__") / 100).otherwise(F.col("s0__")))
    df = panel.df.join(stats, "subject_id")
    a, b = F.col("s0__"), F.col("s1__")
    value = {
        "zscore": lambda c: F.try_divide(F.col(c) - a, b),
        "range": lambda c: F.when(a == b, F.lit(0.0)).otherwise(F.try_divide(F.col(c) - a, b - a)),
    }.get(method, lambda c: F.try_divide(F.col(c), a))
    rest = [x for x in panel.df.columns if x not in panel.channels]
    return panel.with_df(df.select(*rest, *(value(c).alias(c) for c in panel.channels)))


def mvc_reference(panel: Panel, method: str = "peak", window_ms: float = 500, fs: float = 1000, top_percent: float = 5) -> DataFrame:
    """(subject_id, channel, reference): the largest absolute value, the mean of the largest few per cent, or the largest RMS of a whole window."""
    if method == "peak":
        return panel.long().groupBy("subject_id", "channel").agg(F.max(F.abs("value")).alias("reference"))
    if method == "mean_peak":
        long = panel.long().where("value IS NOT NULL").withColumn("value", F.abs("value"))
        if longest(panel) > WHOLE:
            return mean_of_largest(long, top_percent).withColumnRenamed("mean", "reference")
        sizes = long.groupBy("subject_id", "channel").agg(F.greatest(F.lit(1), F.floor(F.count("*") * top_percent / 100)).alias("top"))
        ranked = long.withColumn("rank", F.row_number().over(W.partitionBy("subject_id", "channel").orderBy(F.desc("value"))))
        return ranked.join(sizes, ["subject_id", "channel"]).where("rank <= top").groupBy("subject_id", "channel").agg(F.avg("value").alias("reference"))
    if method == "rms_peak":
        w = window_width(window_ms, fs)
        counted = _with_stats(panel, {f"{c}__n": F.count(c) for c in panel.channels})

        def mean(time):
            last = time.rowsBetween(-(w - 1), 0)
            # A series shorter than the window is one window.
            return [F.when(F.count(c).over(last) == F.least(F.lit(w), F.col(f"{c}__n")), F.sqrt(F.avg(F.col(c) * F.col(c)).over(last))).alias(c) for c in panel.channels]

        rms = panel.with_df(over_neighbours(panel.with_df(counted, True), w - 1, 0, mean))
        return rms.long().groupBy("subject_id", "channel").agg(F.max("value").alias("reference"))
    raise ValueError(f"unknown method {method!r}")


def channel_summary(panel: Panel) -> DataFrame:
    """Per channel over all rows: mean, deviation, minimum, maximum."""
    return panel.df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in panel.channels))).alias("x")).groupBy("x.channel").agg(F.avg("x.value").alias("mean"), F.stddev_samp("x.value").alias("sd"), F.min("x.value").alias("min"), F.max("x.value").alias("max"))


# The steps' parameters of each preset.
PRESETS = {
    "default": {
        "dc_removal": {"method": "mean"},
        "bandpass": {"low": 20, "high": 450, "order": 4},
        "notch": {"freq": 50, "harmonics": True},
        "rectify": {"method": "full_wave"},
        "envelope": {"method": "lowpass", "cutoff": 6},
        "normalize": {"method": "max"},
    },
    "gait": {
        "dc_removal": {"method": "linear"},
        "bandpass": {"low": 20, "high": 450, "order": 4},
        "notch": {"freq": 50, "harmonics": True},
        "rectify": {"method": "full_wave"},
        "envelope": {"method": "lowpass", "cutoff": 4},
        "normalize": {"method": "mvc"},
    },
    "isometric": {
        "dc_removal": {"method": "mean"},
        "bandpass": {"low": 20, "high": 450, "order": 4},
        "notch": {"freq": 50, "harmonics": True},
        "rectify": {"method": "full_wave"},
        "envelope": {"method": "rms", "window_ms": 100},
        "normalize": {"method": "mvc"},
    },
    "fine_motor": {
        "dc_removal": {"method": "mean"},
        "bandpass": {"low": 10, "high": 500, "order": 4},
        "notch": {"freq": 50, "harmonics": True},
        "rectify": {"method": "full_wave"},
        "envelope": {"method": "lowpass", "cutoff": 10},
        "normalize": {"method": "max"},
    },
}


def preset(name: str) -> dict | None:
    """A preset's steps; None for a name that isn't one."""
    return PRESETS.get(name)


def envelope(panel: Panel, fs: float, method: str = "lowpass", cutoff: float = 6, window_ms: float = 50, order: int = 4) -> Panel:
    """One of the three envelopes."""
    if method == "lowpass":
        return envelope_lowpass(panel, fs, cutoff, order)
    if method not in ("rms", "moving_average"):
        raise ValueError(f"unknown method {method!r}")
    return (envelope_rms if method == "rms" else envelope_moving_average)(panel, window_ms, fs)


def _present(x: np.ndarray, figure: Callable) -> np.ndarray:
    """A figure of each channel's present values; missing where there are none."""
    out = np.full(x.shape[1], np.nan)
    for k in range(x.shape[1]):
        if len(own := x[:, k][~np.isnan(x[:, k])]):
            out[k] = figure(own)
    return out


def _over(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """A quotient that is missing where the divisor is 0."""
    return x / np.where(by == 0, np.nan, by)


def _trend(t: np.ndarray, x: np.ndarray, degree: int) -> np.ndarray:
    """What a polynomial in time, scaled to -1..1, leaves of each channel."""
    n = len(t)
    u = (2.0 * t - n - 1) / (n - 1) if n > 1 else np.zeros(n)
    powers, out = u[:, None] ** np.arange(2 * degree + 1), x.copy()
    for k in range(x.shape[1]):
        there = ~np.isnan(x[:, k])
        sums, right = powers[there].sum(axis=0), powers[there, : degree + 1].T @ x[there, k]
        a = sums[np.arange(degree + 1)[:, None] + np.arange(degree + 1)]
        out[:, k] = x[:, k] - powers[:, : degree + 1] @ np.linalg.lstsq(a, right, rcond=None)[0]
    return out


def _line(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.where(np.isnan(x), np.nan, 0.0)
    for k in range(x.shape[1]):
        there = ~np.isnan(x[:, k])
        own, times = x[there, k], t[there].astype(float)
        spread = times - times.mean() if len(own) else times
        if len(own) > 1 and (spread @ spread) > 0:
            out[:, k] = x[:, k] - own.mean() - (spread @ own) / (spread @ spread) * (t - times.mean())
    return out


def offset_step(method: str = "mean", degree: int = 1) -> Step:
    """``remove_offset`` of one series."""
    if method not in ("mean", "median", "linear", "polynomial"):
        raise ValueError(f"unknown method {method!r}")
    if method == "linear":
        return lambda t, x, first: _line(t, x)
    if method == "polynomial":
        return lambda t, x, first: _trend(t, x, degree)
    return lambda t, x, first: x - _present(x, np.mean if method == "mean" else np.median)


def _near_sums(x: np.ndarray, behind: int, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of present values between ``behind`` rows before and ``ahead`` rows after each row."""
    there, n = ~np.isnan(x), len(x)
    ends, starts = np.minimum(np.arange(n) + ahead + 1, n), np.maximum(np.arange(n) - behind, 0)
    run = lambda v: np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(v, axis=0)])
    sums, counts = run(np.where(there, x, 0.0)), run(there.astype(float))
    return sums[ends] - sums[starts], counts[ends] - counts[starts]


def envelope_step(fs: float, method: str = "lowpass", cutoff: float = 6, window_ms: float = 50, order: int = 4) -> Step:
    """``envelope`` of one series."""
    if method == "lowpass":
        return filter_step(lowpass_sections(fs, cutoff, order))
    if method not in ("rms", "moving_average"):
        raise ValueError(f"unknown method {method!r}")
    w = window_width(window_ms, fs)
    h = w // 2

    def rms(t, x, first):
        sums, counts = _near_sums(x * x, h, h)
        return np.sqrt(np.maximum(_over(sums, counts), 0))

    def moving(t, x, first):
        sums, counts = _near_sums(x, w - 1 - h, h)
        return np.where(counts == w, sums / w, _over(*_near_sums(x, h, h)))

    return rms if method == "rms" else moving


def filter_step(sections: np.ndarray, zero_phase: bool = True) -> Step:
    """A filter over one series."""
    return lambda t, x, first: (iir.filtfilt if zero_phase else iir.sosfilt)(sections, x)


def rectify_step(method: str = "full_wave") -> Step:
    """``rectify`` of one series."""
    if method not in ("full_wave", "half_wave"):
        raise ValueError(f"unknown method {method!r}")
    return lambda t, x, first: np.abs(x) if method == "full_wave" else np.maximum(x, 0.0)


def normalize_step(channels: tuple[str, ...], method: str = "max") -> Step:
    """``normalize`` of one series; ``mvc`` finds its references in the further columns of the first row."""
    if method in ("max", "mean", "median"):
        return lambda t, x, first: _over(x, _present(np.abs(x), {"max": np.max, "mean": np.mean, "median": np.median}[method]))
    if method == "zscore":
        return lambda t, x, first: _over(x - _present(x, np.mean), _present(x, lambda v: v.std(ddof=1) if len(v) > 1 else np.nan))
    if method == "range":

        def span(t, x, first):
            low, high = _present(x, np.min), _present(x, np.max)
            return np.where(high == low, x * 0.0, _over(x - low, high - low))

        return span
    if method == "mvc":

        def share(t, x, first):
            given = np.array([first[f"{c}__r"] or 0.0 for c in channels], dtype=float)
            return np.where(given != 0, 100 * _over(x, given), _over(x, _present(np.abs(x), np.max)))

        return share
    raise ValueError(f"unknown method {method!r}")


def _wide(reference: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    wide = reference.groupBy("subject_id").pivot("channel", list(channels)).agg(F.first("reference"))
    return wide.select("subject_id", *(F.col(c).alias(f"{c}__r") for c in channels))


def _in_one_pass(panel: Panel, fs: float, steps: list[tuple[str, dict]], reference: DataFrame | None) -> Panel:
    make = {
        "dc_removal": offset_step,
        "bandpass": lambda zero_phase=True, **a: filter_step(bandpass_sections(fs, **a), zero_phase),
        "notch": lambda zero_phase=True, **a: None if (x := notch_sections(fs, **a)) is None else filter_step(x, zero_phase),
        "rectify": rectify_step,
        "envelope": lambda **a: envelope_step(fs, **a),
        "normalize": lambda **a: normalize_step(panel.channels, **a),
    }
    made = [x for name, a in steps if (x := make[name](**a)) is not None]
    if reference is not None and dict(steps).get("normalize", {}).get("method") == "mvc":
        # Joined before rows are put in order; a whole panel's subjects are brought together again.
        rows = Panel(panel.df.join(_wide(reference, panel.channels), "subject_id", "left"), panel.channels)
        return in_one_pass(rows, made, tuple(f"{c}__r" for c in panel.channels))
    return in_one_pass(panel, made)


@dataclass(frozen=True)
class Processed:
    """A panel with what was done to it."""

    panel: Panel
    steps: tuple[str, ...]
    parameters: dict = field(default_factory=dict)
    fs: float = 1000.0


def preprocess(panel: Panel, fs: float, steps: dict, reference: DataFrame | None = None) -> Processed:
    """The steps that ``steps`` has, in fixed order: offset, band pass, notch, rectification, envelope, normalisation. False skips a step.

    All steps are one pass over rows in order, as long as every series can be held by a task; else each step is worked out by itself.
    """
    if (steps.get("normalize") or {}).get("method") == "mvc" and reference is None:
        raise ValueError("method mvc needs a reference")
    stages = {
        "dc_removal": lambda p, **a: remove_offset(p, **a),
        "bandpass": lambda p, **a: bandpass(p, fs, **a),
        "notch": lambda p, **a: notch(p, fs, **a),
        "rectify": lambda p, **a: rectify(p, **a),
        "envelope": lambda p, **a: envelope(p, fs, **a),
        "normalize": lambda p, **a: normalize(p, reference=reference, **a),
    }
    chosen = [(name, steps[name] if isinstance(steps[name], dict) else {}) for name in stages if name in steps and steps[name] is not False and steps[name] is not None]
    if longest(panel) <= WHOLE:
        panel = _in_one_pass(panel, fs, chosen, reference)
    else:
        for name, a in chosen:
            panel = stages[name](panel, **a)
    return Processed(panel, tuple(name for name, _ in chosen), dict(steps), fs)
