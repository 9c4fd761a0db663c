"""Spectra of frames and what is read from them.

The transform runs in numpy over Arrow batches; descriptors of a magnitude
spectrum are array expressions with tables made once on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import dot, let, squares, total


_ARRAY = T.ArrayType(T.DoubleType())
_COMPLEX = T.ArrayType(T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]))


def _stacked(frames: pd.Series, fn) -> pd.Series:
    """fn over rows of equal length, stacked; None for null or empty frames."""
    out = pd.Series([None] * len(frames), index=frames.index, dtype=object)
    sizes = frames.map(lambda v: -1 if v is None else len(v))
    for n in set(sizes) - {-1, 0}:
        at = np.flatnonzero(sizes.to_numpy() == n)
        made = fn(np.stack([np.asarray(frames.iloc[i], float) for i in at]))
        for i, row in zip(at, made):
            out.iloc[i] = row
    return out


def _pow2(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


@F.pandas_udf(_ARRAY)
def magnitude(frame: pd.Series) -> pd.Series:
    """|FFT| of a frame, padded with zeros to a power of two."""
    return _stacked(frame, lambda a: np.abs(np.fft.rfft(a, _pow2(a.shape[1]))))


@F.pandas_udf(_ARRAY)
def phase(frame: pd.Series) -> pd.Series:
    return _stacked(frame, lambda a: np.angle(np.fft.rfft(a, _pow2(a.shape[1]))))


@F.pandas_udf(_COMPLEX)
def fft(frame: pd.Series) -> pd.Series:
    return _stacked(frame, lambda a: [[{"re": float(z.real), "im": float(z.imag)} for z in r] for r in np.fft.rfft(a, _pow2(a.shape[1]))])


@F.pandas_udf(_ARRAY)
def inverse_fft(spectrum: pd.Series) -> pd.Series:
    return spectrum.map(lambda r: None if r is None else np.fft.irfft([z["re"] + 1j * z["im"] for z in r]).tolist())


@F.pandas_udf(_ARRAY)
def spectrum_acf(mag: pd.Series) -> pd.Series:
    """Autocorrelation from a magnitude spectrum: the inverse transform of its square, by its length."""
    return _stacked(mag, lambda a: np.fft.irfft(a * a)[:, : a.shape[1]] / a.shape[1])


@F.pandas_udf(_ARRAY)
def cepstrum(mag: pd.Series) -> pd.Series:
    return _stacked(mag, lambda a: np.fft.irfft(np.log(np.maximum(a, 1e-12)))[:, : a.shape[1]])


def scaled_spectrum(mag: Column, normalise: bool = False, power: bool = False, decibels: bool = False, norm: float = 90.302, floor: float = -102.0) -> Column:
    """A magnitude spectrum by the length of its transform (normalise), squared (power), or as norm + 20 log10 of the former, floor at least (decibels)."""
    def made(m: Column) -> Column:
        n = 2 * (F.size(m) - 1)
        by = F.when(n > 0, 1.0 / F.when(n > 0, n)).otherwise(1.0)
        if decibels:
            return let(by, lambda k: F.transform(m, lambda x: F.greatest(F.when(x > 0, norm + 20 * F.log10(F.when(x > 0, x * k))).otherwise(floor), F.lit(floor))))
        return let(by if normalise else F.lit(1.0), lambda k: F.transform(m, lambda x: (x * k) * (x * k) if power else x * k))

    return let(mag, made)


def joined(mag: Column, angle: Column) -> Column:
    """Magnitudes, then phases, as one array."""
    return F.concat(mag, angle)


def power_db(mag: Column, floor: float = -102.0, norm: float = 90.302) -> Column:
    return F.transform(mag, lambda x: F.greatest(10 * F.log10(F.greatest(x * x, F.lit(1e-30))) + norm, F.lit(floor)))


def _hz_to(scale: str, f):
    f = np.asarray(f, float)
    return {"mel": lambda: 1127 * np.log1p(f / 700), "bark": lambda: 26.81 / (1 + 1960 / np.maximum(f, 1e-9)) - 0.53, "semitone": lambda: 12 * np.log2(np.maximum(f, 1e-9) / 27.5), "log": lambda: np.log2(np.maximum(f, 1e-9)), "linear": lambda: f}[scale]()


def _solve(function, low: float, high: float, target):
    """Where a rising function has the target values, by bisection."""
    target = np.asarray(target, float)
    a, b = np.full(target.shape, float(low)), np.full(target.shape, float(high))
    for _ in range(80):
        mid = (a + b) / 2
        below = function(mid) < target
        a, b = np.where(below, mid, a), np.where(below, b, mid)
    return (a + b) / 2


def critical_band(f):
    """The equivalent rectangular bandwidth at f, all in Hz."""
    return 6.23e-6 * f * f + 0.09339 * f + 28.52


def critical_edges(f):
    """The ends of the triangle about f whose width is twice the critical bandwidth, with f in its middle on the mel scale."""
    wide = critical_band(f) + 700.0
    low = np.sqrt(wide * wide + f * (f + 1400.0)) - wide
    return low, low + 2 * critical_band(f)


def filterbank(bins: int, rate: float, bands: int = 26, low: float = 20.0, high: float = 8000.0, scale: str = "mel", width: str | float | None = None) -> np.ndarray:
    """bands x bins triangles, their tops evenly spaced on the scale.

    Without a width each rises from its left neighbour's top and falls to its
    right's, on the scale. width "erb": each is as wide as twice the critical
    bandwidth at its top, the first begins at low and the last ends at high. A
    number: each reaches so many Hz to either side, and tops run from low to high.
    """
    f = np.arange(bins) * rate / (2 * (bins - 1))
    if width is None:
        z = _hz_to(scale, f)
        edges = np.linspace(float(_hz_to(scale, low)), float(_hz_to(scale, high)), bands + 2)
        up = (z - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
        down = (edges[2:, None] - z) / (edges[2:] - edges[1:-1])[:, None]
        return np.maximum(np.minimum(up, down), 0)
    tops = np.array(centres(bands, low, high, scale, width))
    if width == "erb":
        a, b = critical_edges(tops)
    else:
        a, b = np.maximum(tops - float(width), low), np.minimum(tops + float(width), high)
    up = np.where((tops > a)[:, None], (f - a[:, None]) / np.where(tops > a, tops - a, 1.0)[:, None], (f >= tops[:, None]) * 1.0)
    down = np.where((b > tops)[:, None], (b[:, None] - f) / np.where(b > tops, b - tops, 1.0)[:, None], (f <= tops[:, None]) * 1.0)
    return np.maximum(np.minimum(up, down), 0)


def centres(bands: int, low: float, high: float, scale: str = "mel", width: str | float | None = None) -> list[float]:
    """The frequencies of filterbank's tops."""
    on = lambda f: _hz_to(scale, f)
    if width is None:
        marks = np.linspace(float(on(low)), float(on(high)), bands + 2)[1:-1]
    elif width == "erb":
        ends = [float(_solve(lambda f, k=k: critical_edges(f)[k], 0.0, 2 * high, v)) for k, v in ((0, low), (1, high))]
        marks = np.linspace(float(on(ends[0])), float(on(ends[1])), bands)
    else:
        marks = np.linspace(float(on(low)), float(on(high)), bands)
    return _solve(on, 0.0, 2 * high, marks).tolist()


def apply_matrix(v: Column, m: np.ndarray) -> Column:
    """m times v; a row's zeros outside its support are never multiplied."""
    rows = []
    for r in np.asarray(m, float):
        hit = np.flatnonzero(r)
        if not len(hit):
            rows.append(F.lit(0.0))
            continue
        a, b = int(hit[0]), int(hit[-1])
        rows.append(dot(F.slice(v, a + 1, b - a + 1), F.array(*map(F.lit, r[a : b + 1].tolist()))))
    return F.array(*rows)


def dct_matrix(bands: int, first: int = 1, last: int = 12, lifter: int = 22) -> np.ndarray:
    k, j = np.arange(first, last + 1)[:, None], np.arange(bands)
    lift = 1 + lifter / 2 * np.sin(np.pi * k / lifter) if lifter else 1.0
    return np.sqrt(2 / bands) * np.cos(np.pi * k * (j + 0.5) / bands) * lift


def mfcc(bands: Column, n: int, first: int = 1, last: int = 12, floor: float = 1e-8, lifter: int = 22) -> Column:
    return apply_matrix(F.transform(bands, lambda x: F.ln(F.greatest(x, F.lit(floor)))), dct_matrix(n, first, last, lifter))


def plp(bands: Column, centres: list[float], order: int = 5, compression: float = 0.33) -> Column:
    """Perceptual linear prediction: equal loudness, cubic-root compression, autocorrelation by the inverse transform, LPC to cepstrum."""
    f2 = np.asarray(centres) ** 2
    loud = (f2 + 56.8e6) * f2 * f2 / ((f2 + 6.3e6) ** 2 * (f2 + 0.38e9))
    loud = (loud / loud.max()).tolist()

    @F.pandas_udf("array<double>")
    def run(b: pd.Series) -> pd.Series:
        from ..operators.kernels import levinson, lpc_cepstrum

        out = []
        for v in b:
            if v is None:
                out.append(None)
                continue
            s = (np.maximum(np.asarray(v, float), 1e-9) * loud) ** compression
            acf = np.fft.irfft(np.concatenate([s[:1], s, s[-1:]]))[: order + 1]
            a, gain, _ = levinson(acf, order)
            out.append(lpc_cepstrum(a, gain).tolist())
        return pd.Series(out, dtype=object)

    return run(bands)


def tonespec(bins: int, rate: float, octaves: int = 6, first: float = 55.0, form: str = "gauss") -> np.ndarray:
    """Bins to semitones with filters a semitone wide on either side: gauss, triangular or tripower (its square)."""
    f = np.maximum(np.arange(bins) * rate / (2 * (bins - 1)), 1e-9)
    z = 12 * np.log2(f / first) - np.arange(12 * octaves)[:, None]
    tri = np.maximum(1 - np.abs(z), 0)
    m = {"gauss": lambda: np.exp(-0.5 * (z / 0.5) ** 2), "triangular": lambda: tri, "tripower": lambda: tri * tri}[form]()
    m[m < 1e-6] = 0
    return m / np.maximum(m.sum(1, keepdims=True), 1e-12)


def chroma(notes: Column, octaves: int, size: int = 12, silence: float = 0.001) -> Column:
    """Octaves folded and divided by the sum; zeros where a folded bin is under the silence threshold."""
    fold = F.array(*[sum((F.element_at(notes, o * size + k + 1) for o in range(octaves)), F.lit(0.0)) for k in range(size)])
    by = lambda b: F.when((F.array_min(b) < silence) | (total(b) <= 0), F.lit(None)).otherwise(total(b))
    return let(fold, lambda b: let(by(b), lambda s: F.transform(b, lambda x: F.coalesce(x / s, F.lit(0.0)))))


def descriptors(mag: Column, freqs: list[float], bands: tuple = ((0, 650), (1000, 4000)), roll: tuple = (0.25, 0.5, 0.75, 0.9), square: bool = True, slopes: tuple = ((0, 500), (500, 1500)), relative: bool = False, span: tuple | None = None, decibels: bool = False, floor: float = 1e-7) -> dict[str, Column]:
    """Of a magnitude spectrum: band energies, roll-off, centroid, entropy, moments, slopes, flatness, sharpness, harmonicity, alpha ratio, Hammarberg index.

    All come from one numpy pass over Arrow batches, linear in the bins. Spectra
    that are null or not of the frequencies' length have none. relative: band
    energies and harmonicity are shares of the whole energy. span: only bins from
    one frequency to another count. decibels: slopes, centroid, extremes,
    entropy, moments, sharpness, harmonicity and flatness are of the power in
    decibels over that of the floor, and band energies are in decibels.
    """
    f = np.array(freqs, float)
    whole = len(f)
    own = np.ones(whole, bool) if span is None else (f >= span[0]) & (f <= span[1])
    f = f[own]
    n = len(f)
    names = [f"band_{int(a)}_{int(b)}" for a, b in bands] + [f"rolloff{round(100 * r)}" for r in roll]
    names += "centroid maxpos minpos entropy variance stddev skewness kurtosis slope flatness sharpness harmonicity alpharatio hammarberg".split()
    names += [f"slope_{int(a)}_{int(b)}" for a, b in slopes]
    barks = np.where(f > 0, 26.81 / (1 + 1960 / np.maximum(f, 1e-9)) - 0.53, 0.0)
    sharp = 0.11 * np.maximum(barks, 0) * np.where(barks <= 16, 1.0, 0.066 * np.exp(0.171 * barks))

    def line(p, at):
        """Least squares slope of the columns `at` of p over their frequencies."""
        x, m = f[at], at.sum()
        below = m * (x * x).sum() - x.sum() ** 2
        return (m * (p[:, at] @ x) - x.sum() * p[:, at].sum(1)) / below if below else np.zeros(len(p))

    def made(mag: np.ndarray) -> np.ndarray:
        mag = mag[:, own]
        p = mag * mag if square else mag
        s = p.sum(1)
        by = np.where(s > 0, s, np.inf)
        inside = lambda a, b: (f >= a) & (f < b)
        most = lambda at: p[:, at].max(1) if at.any() else np.zeros(len(p))

        def decibels_of(over, under):
            good = (over > 0) & (under > 0)
            return np.where(good, 10 * np.log10(np.where(good, over, 1) / np.where(good, under, 1)), 0.0)

        energy = [p[:, inside(a, b)].sum(1) / (np.where(s > 0, s, np.inf) if relative else 1.0) for a, b in bands]
        out = [10 * np.log10(np.maximum(e, floor * floor)) for e in energy] if decibels else energy
        below = np.cumsum(p, 1)
        out += [f[np.minimum((below < (r * s)[:, None]).sum(1), n - 1)] for r in roll]
        ratios = [decibels_of(p[:, inside(1000, 5000)].sum(1), p[:, inside(50, 1000)].sum(1)), decibels_of(most(inside(0, 2000)), most(inside(2000, 5000)))]
        if decibels:
            p = mag = 10 * np.log10(np.maximum(p, floor * floor)) - 20 * np.log10(floor)
            s = p.sum(1)
            by = np.where(s > 0, s, np.inf)
        centroid = p @ f / by
        d = f - centroid[:, None]
        var, m3, m4 = ((p * d**k).sum(1) / by for k in (2, 3, 4))
        sd = np.where(var > 0, var, np.inf)
        q = np.maximum(p / by[:, None], 1e-12)
        out += [centroid, f[mag.argmax(1)], f[mag.argmin(1)], -(q * np.log2(q)).sum(1), var, np.sqrt(var), m3 / (sd * np.sqrt(sd)), m4 / (sd * sd), line(p, np.ones(n, bool))]
        flat = np.exp(np.log(np.maximum(p, 1e-12)).sum(1) / n) / (by / n)
        all_ = mag.sum(1)
        out += [flat, p @ sharp / by, np.abs(np.diff(mag, axis=1)).sum(1) / np.where(all_ > 0, all_, np.inf), *ratios]
        return np.stack(out + [line(p, inside(a, b)) for a, b in slopes], 1)

    @F.pandas_udf(", ".join(f"{c} double" for c in names))
    def run(mags: pd.Series) -> pd.DataFrame:
        out = np.full((len(mags), len(names)), np.nan)
        at = np.flatnonzero([v is not None and len(v) == whole for v in mags])
        if len(at):
            out[at] = made(np.stack([np.asarray(mags.iloc[i], float) for i in at]))
        return pd.DataFrame(out, columns=names)

    got = run(mag)
    return {c: got[c] for c in names}


def _unit(v: Column) -> Column:
    return let(F.sqrt(squares(v)), lambda d: F.transform(v, lambda x: x / F.when(d > 0, d).otherwise(1.0)))


def flux(now: Column, before: Column) -> Column:
    """Root mean square difference of the spectra, each divided by its length; 0 without a spectrum before."""
    d = F.zip_with(_unit(now), _unit(before), lambda a, b: a - b)
    return F.when(before.isNull(), 0.0).otherwise(F.sqrt(squares(d) / F.size(now)))


def differences(now: Column, before: Column, freqs: list[float]) -> dict[str, Column]:
    """Sum of the absolute and of the positive differences to the spectrum before, and the centroid of the absolute ones; 0 without one."""
    f = F.array(*map(F.lit, map(float, freqs)))
    d = F.zip_with(now, before, lambda a, b: a - b)
    size = F.transform(d, F.abs)
    zero = lambda c: F.when(before.isNull(), 0.0).otherwise(c)
    centre = let(total(size), lambda s: F.when(s > 0, dot(size, f) / F.when(s > 0, s)).otherwise(0.0))
    return {"diff": zero(total(size)), "posdiff": zero(total(F.transform(d, lambda x: F.greatest(x, F.lit(0.0))))), "fluxcentroid": zero(centre)}


def harmonic_product(mag: Column, harmonics: int = 5) -> Column:
    """Of each bin, the product of the bins at its multiples; 0 where one lies beyond the spectrum."""
    return F.transform(F.sequence(F.lit(0), F.size(mag) - 1), lambda k: F.when(k * harmonics < F.size(mag), F.aggregate(F.sequence(F.lit(1), F.lit(harmonics)), F.lit(1.0), lambda a, h: a * F.get(mag, k * h))).otherwise(0.0))


def harmonic_sum(mag: Column, harmonics: int = 5) -> Column:
    """Of each bin, the sum of the bins at its multiples inside the spectrum."""
    return F.transform(F.sequence(F.lit(0), F.size(mag) - 1), lambda k: F.aggregate(F.sequence(F.lit(1), F.lit(harmonics)), F.lit(0.0), lambda a, h: a + F.coalesce(F.get(mag, k * h), F.lit(0.0))))


def inverse_mfcc(coefficients: Column, bands: int, first: int = 1, lifter: int = 22, last: int = 12) -> Column:
    """Band energies from cepstral coefficients: the cosine transform turned back, and exp."""
    k = np.arange(first, last + 1)
    lift = 1 + lifter / 2 * np.sin(np.pi * k / lifter) if lifter else np.ones(len(k))
    back = dct_matrix(bands, first, last, 0).T / np.maximum(np.abs(lift), 1e-12) * np.sign(lift) * np.where(k == 0, 0.5, 1.0)
    return F.transform(apply_matrix(coefficients, back), F.exp)


def inverse_bands(bands: Column, m: np.ndarray) -> Column:
    """A spectrum from its filterbank energies: each bin is the mean of its bands, weighted by their filters."""
    m = np.asarray(m, float)
    return apply_matrix(bands, (m / np.maximum(m.sum(1, keepdims=True), 1e-12)).T)


def a_weighted(mag: Column, freqs: list[float], power: bool = True) -> Column:
    """A spectrum under the A curve; a power spectrum by the whole decibels, a magnitude by half."""
    s = np.maximum(np.array(freqs, float), 1e-9) ** 2
    r = 12194.0**2 * s * s / ((s + 20.6**2) * np.sqrt((s + 107.7**2) * (s + 737.9**2)) * (s + 12194.0**2))
    gain = 10 ** (((20 * np.log10(r) + 2.0) / 10) if power else ((20 * np.log10(r) + 2.0) / 20))
    return F.zip_with(mag, F.array(*map(F.lit, gain.tolist())), lambda x, g: x * g)


def spline_matrix(x, at) -> np.ndarray:
    """The matrix that takes values at the knots x (ascending) to those of their natural cubic spline at `at`; beyond the ends the last pieces go on.

    A spline is linear in its values, so one tridiagonal solve for all unit
    vectors serves every row of a table.
    """
    x, at = np.asarray(x, float), np.asarray(at, float)
    n = len(x)
    h = np.diff(x)
    rhs = np.zeros((n, n))  # of the second derivatives' equations, for each unit vector
    i = np.arange(1, n - 1)
    rhs[i, i - 1], rhs[i, i + 1] = 6 / h[:-1], 6 / h[1:]
    rhs[i, i] = -6 / h[:-1] - 6 / h[1:]
    upper, bend = np.zeros(n), np.zeros((n, n))
    for k in range(1, n - 1):
        pivot = 2 * (h[k - 1] + h[k]) - h[k - 1] * upper[k - 1]
        upper[k] = h[k] / pivot
        bend[k] = (rhs[k] - h[k - 1] * bend[k - 1]) / pivot
    for k in range(n - 2, 0, -1):
        bend[k] -= upper[k] * bend[k + 1]
    k = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
    a, w = (x[k + 1] - at) / h[k], h[k]
    b, unit = 1 - a, np.eye(n)
    return a[:, None] * unit[k] + b[:, None] * unit[k + 1] + ((a**3 - a) * w * w / 6)[:, None] * bend[k] + ((b**3 - b) * w * w / 6)[:, None] * bend[k + 1]


def peaks_kept(mag: Column) -> Column:
    """A spectrum whose bins more than two away from every local maximum are 0: between two maxima, and around a single one."""

    def keep(m: Column) -> Column:
        last = F.size(m) - 1
        top = lambda i: ((i == 0) | (F.get(m, i) > F.get(m, i - 1))) & ((i == last) | F.when(i == 0, F.get(m, i) > F.get(m, i + 1)).otherwise(F.get(m, i) >= F.get(m, i + 1)))

        def cleared(tops: Column) -> Column:
            return F.transform(m, lambda v, i: F.when(F.exists(tops, lambda t: F.abs(t - i) <= 2), v).when((F.size(tops) == 1) | ((i > F.array_min(tops)) & (i < F.array_max(tops))), 0.0).otherwise(v))

        return let(F.filter(F.sequence(F.lit(0), last), top), cleared)

    return F.when(F.size(mag) > 1, let(mag, keep)).otherwise(mag)


def scaled_matrix(bins: int, rate: float, points: int = 0, scale: str = "log", low: float = 25.0, high: float | None = None, smooth: bool = False) -> np.ndarray:
    """The matrix of a spectrum's values at points evenly spaced on a scale, by a natural spline; smooth first averages three bins (1, 2, 1)."""
    f = np.arange(bins) * rate / (2 * (bins - 1))
    z = _hz_to(scale, f)
    if scale in ("log", "semitone"):
        z[0] = 2 * z[1] - z[2]  # 0 Hz has no place there
    high = f[-1] if high is None or high <= low or high > f[-1] else high
    out = spline_matrix(z, np.linspace(float(_hz_to(scale, low)), float(_hz_to(scale, high)), points or bins))
    if not smooth:
        return out
    three = np.eye(bins) / 2 + (np.eye(bins, k=1) + np.eye(bins, k=-1)) / 4
    three[-1] = np.eye(bins)[-1]
    return out @ three


def hearing_weights(points: int, low: float, high: float) -> np.ndarray:
    """Weights of points on an octave axis that rise from a half at about 65 Hz (of an axis from 50) on."""
    octave = points / np.log2(high / low)
    return 0.5 + np.arctan(3 * (np.arange(1, points + 1) - (octave * np.log2(65 / 50) - 1)) / octave) / np.pi


def scaled_axis(mag: Column, bins: int, rate: float, points: int = 0, scale: str = "log", low: float = 25.0, high: float | None = None, smooth: bool = False, enhance: bool = False, weighting: bool = False) -> Column:
    """A spectrum of so many bins on another frequency axis. enhance clears what lies between its peaks, smooth averages, weighting (octave axes) follows the ear and gives 0 for values below 0."""
    out = apply_matrix(peaks_kept(mag) if enhance else mag, scaled_matrix(bins, rate, points, scale, low, high, smooth))
    if not weighting:
        return out
    top = rate / 2
    w = hearing_weights(points or bins, low, top if high is None or high <= low or high > top else high)
    return F.zip_with(out, F.array(*map(F.lit, w.tolist())), lambda x, g: F.when(x > 0, x * g).otherwise(0.0))


def resampled_axis(mag: Column, rate: float, points: int, scale: str = "log", low: float = 25.0) -> Column:
    """The spectrum on another frequency axis, by natural cubic splines."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        from ..operators.kernels import spline

        def go(a):
            f = np.arange(1, a.shape[1]) * rate / (2 * (a.shape[1] - 1))
            z = _hz_to(scale, f)
            to = np.linspace(max(float(_hz_to(scale, low)), z[0]), z[-1], points)
            return np.stack([spline(z, r[1:], to) for r in a])

        return _stacked(v, go)

    return run(mag)


def resampled(frame: Column, ratio: float) -> Column:
    """A frame at another rate: its spectrum cut or padded, and transformed back."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        def go(a):
            n = max(1, round(a.shape[1] * ratio))
            return np.fft.irfft(np.fft.rfft(a)[:, : n // 2 + 1], n) * (n / a.shape[1])

        return _stacked(v, go)

    return run(frame)
