"""Sequential kernels in numpy, and their use on grouped or array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def levinson(acf, order: int):
    """Prediction-error filter's coefficients (without the leading 1), residual energy, reflection coefficients."""
    a, e, refl = np.zeros(order), float(acf[0]), np.zeros(order)
    if e <= 0:
        return a, 0.0, refl
    for m in range(order):
        k = -(acf[m + 1] + a[:m] @ acf[m:0:-1][:m]) / e
        a[:m] = a[:m] + k * a[:m][::-1]
        a[m] = refl[m] = k
        e *= 1 - k * k
        if e <= 0:
            break
    return a, max(e, 0.0), refl


def acf(x, lags: int) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([x[: len(x) - k] @ x[k:] if k < len(x) else 0.0 for k in range(lags)])


def lpc(x, order: int):
    return levinson(acf(x, order + 1), order)


def lpc_burg(x, order: int):
    """Burg's method: coefficients and residual power."""
    f = np.asarray(x, float)
    b, a, e = f.copy(), np.zeros(0), float(f @ f) / max(len(f), 1)
    for _ in range(order):
        f, b = f[1:], b[:-1]
        d = f @ f + b @ b
        k = -2 * (f @ b) / d if d > 0 else 0.0
        a = np.append(a + k * a[::-1], k)
        f, b = f + k * b, b + k * f
        e *= 1 - k * k
    return a, e


def lpc_cepstrum(a, gain: float) -> np.ndarray:
    """c0 = ln gain, then the recursion up to the order."""
    c = np.zeros(len(a) + 1)
    c[0] = np.log(max(gain, 1e-12))
    for n in range(1, len(a) + 1):
        c[n] = -a[n - 1] - sum(k / n * c[k] * a[n - k - 1] for k in range(1, n))
    return c


def lsp(a) -> np.ndarray:
    """Line spectral frequencies (ascending, in (0, pi)): angles of the roots of the sum and difference polynomials."""
    p = np.concatenate([[1.0], a, [0.0]])
    both = [np.angle(np.roots(q)) for q in (p + p[::-1], p - p[::-1])]
    w = np.sort(np.concatenate(both))
    return w[(w > 1e-8) & (w < np.pi - 1e-8)]


def formants(a, rate: float, low: float = 50.0, high: float = 5500.0):
    """Frequencies (ascending) and bandwidths of the poles in range."""
    r = np.roots(np.concatenate([[1.0], a])) if np.any(a) else np.empty(0, complex)
    r = np.where(np.abs(r) > 1, 1 / np.conj(np.where(r == 0, 1, r)), r)
    r = r[(r.imag >= 0) & (np.abs(r) > 0)]
    f, bw = np.abs(np.angle(r)) * rate / (2 * np.pi), -np.log(np.abs(r)) * rate / np.pi
    keep = (f >= low) & (f <= high)
    order = np.argsort(f[keep], kind="stable")
    return f[keep][order], bw[keep][order]


def spline(x, y, at) -> np.ndarray:
    """Natural cubic spline through (x, y), x ascending, evaluated at `at`."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    n = len(x)
    if n < 3:
        return np.interp(at, x, y)
    h = np.diff(x)
    m, rhs = np.zeros((n, n)), np.zeros(n)
    m[0, 0] = m[-1, -1] = 1
    i = np.arange(1, n - 1)
    m[i, i - 1], m[i, i], m[i, i + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    rhs[1:-1] = 6 * np.diff(np.diff(y) / h)
    s = np.linalg.solve(m, rhs)
    k = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
    u, v = at - x[k], x[k + 1] - at
    return (s[k] * v**3 + s[k + 1] * u**3) / (6 * h[k]) + (y[k] / h[k] - s[k] * h[k] / 6) * v + (y[k + 1] / h[k] - s[k + 1] * h[k] / 6) * u


def extrema(x, relative: float = 0.1, absolute: float | None = None):
    """Alternating places of maxima and minima that differ by the threshold (a share of the range, or absolute)."""
    x = np.asarray(x, float)
    need = absolute if absolute is not None else relative * (x.max() - x.min() if len(x) else 0)
    tops, bottoms = [], []
    if len(x) < 3 or need < 0 or x.max() == x.min():
        return tops, bottoms
    hi = lo = 0
    going = 0
    for i in range(1, len(x)):
        if x[i] > x[hi]:
            hi = i
        if x[i] < x[lo]:
            lo = i
        if going >= 0 and x[hi] - x[i] > need:
            if 0 < hi:
                tops.append(hi)
            going, lo, hi = -1, i, i
        elif going <= 0 and x[i] - x[lo] > need:
            if 0 < lo:
                bottoms.append(lo)
            going, lo, hi = 1, i, i
    return tops, bottoms


def peaks2(x, relative: float = 0.1) -> dict[str, float]:
    """Statistics of pruned, alternating maxima and minima: distances, heights, slopes."""
    x = np.asarray(x, float)
    tops, bottoms = extrema(x, relative)
    mean, span = float(x.mean()) if len(x) else 0.0, float(np.ptp(x)) if len(x) else 0.0
    rel = lambda v: v / span if span else 0.0
    of = lambda v, f: float(f(v)) if len(v) else 0.0
    t, b = x[tops], x[bottoms]
    dist, up, down = np.diff(tops), np.abs(np.diff(t)), np.abs(np.diff(b))
    both = sorted([(i, 1) for i in tops] + [(i, -1) for i in bottoms])
    slope = [((x[j] - x[i]) / (j - i), k) for (i, _), (j, k) in zip(both, both[1:]) if j > i]
    rise, fall = np.array([s for s, k in slope if k > 0]), np.array([s for s, k in slope if k < 0])
    out = {
        "numpeaks": float(len(tops)), "meanpeakdist": of(dist, np.mean), "meanpeakdistdelta": of(np.abs(np.diff(dist)), np.mean), "peakdiststddev": of(dist, np.std),
        "peakrangeabs": of(t, np.ptp), "peakrangerel": rel(of(t, np.ptp)), "peakmeanabs": of(t, np.mean), "peakmeanmeandist": of(t, np.mean) - mean if len(t) else 0.0,
        "peakmeanrel": of(t, np.mean) / mean if mean else 0.0, "ptpampmeanabs": of(up, np.mean), "ptpampmeanrel": rel(of(up, np.mean)), "ptpampstddevabs": of(up, np.std), "ptpampstddevrel": rel(of(up, np.std)),
        "minrangeabs": of(b, np.ptp), "minrangerel": rel(of(b, np.ptp)), "minmeanabs": of(b, np.mean), "minmeanmeandist": mean - of(b, np.mean) if len(b) else 0.0, "minmeanrel": of(b, np.mean) / mean if mean else 0.0,
        "mtmampmeanabs": of(down, np.mean), "mtmampmeanrel": rel(of(down, np.mean)), "mtmampstddevabs": of(down, np.std), "mtmampstddevrel": rel(of(down, np.std)),
    }
    for name, v in (("rising", rise), ("falling", fall)):
        m, s = of(v, np.mean), of(v, np.std)
        out |= {f"mean{name}slope": m, f"max{name}slope": of(v, np.max), f"min{name}slope": of(v, np.min), f"stddev{name}slope": s, f"cov{name}slope": s / m if m else 0.0}
    return out


def onsets(x, on: float = 0.0, off: float = 0.0) -> dict[str, float]:
    """Two-threshold onsets and offsets."""
    x = np.abs(np.asarray(x, float))
    state, ups, downs = False, [], []
    for i, v in enumerate(x):
        if not state and v > on:
            state = True
            ups.append(i)
        elif state and v <= off:
            state = False
            downs.append(i)
    return {"onsetpos": float(ups[0]) if ups else 0.0, "offsetpos": float(downs[-1]) if downs else 0.0, "numonsets": float(len(ups)), "numoffsets": float(len(downs)), "onsetrate": len(ups) / max(len(x), 1)}


def modulation(x, period: float = 0.01, size: float = 4.0, step: float = 2.0, resolution: float = 0.5, low: float = 0.5, high: float = 20.0) -> np.ndarray:
    """Mean magnitude spectrum of the contour's windows at low..high Hz; a window of under two thirds counts only if it is the first."""
    x = np.asarray(x, float)
    n, hop = max(2, round(size / period)), max(1, round(step / period))
    nfft = max(1 << (n - 1).bit_length(), round(1 / (period * resolution)))
    want, sums, count = np.arange(low, high + resolution / 2, resolution), 0.0, 0
    for at in range(0, max(len(x), 1), hop):
        w = x[at : at + n]
        if count and len(w) <= 2 * n / 3:
            break
        w = (w - w.mean() if len(w) else w) * np.hamming(len(w))
        sums = sums + np.interp(want, np.fft.rfftfreq(nfft, period), np.abs(np.fft.rfft(w, nfft)))
        count += 1
    return sums / max(count, 1)


def pitch_acf(frame, rate: float, high: float = 500.0, cutoff: float = 0.55) -> tuple[float, float, float]:
    """F0 (0 if unvoiced), voicing, and the harmonics-to-noise ratio in dB.

    Voicing is the largest peak of the autocorrelation beyond the shortest
    period, by its value at 0. The period is the first peak of the cepstrum
    there above 0.6 times its largest peak and its mean together, moved to the
    highest autocorrelation close to it.
    """
    x = np.asarray(frame, float)
    nfft = 2 << (max(len(x), 2) - 1).bit_length()
    mag = np.abs(np.fft.rfft(x * np.hanning(len(x) + 2)[1:-1], nfft))
    a = np.fft.irfft(np.abs(np.fft.rfft(x, nfft)) ** 2)[: len(x)]
    lag = max(1, int(rate / high))
    if len(x) <= lag + 2 or a[0] <= 0:
        return 0.0, 0.0, -100.0
    c = np.fft.irfft(np.log(np.maximum(mag, 1e-4 * mag.max())))[: len(x)]

    def tops(v):
        return np.flatnonzero((v[1:-1] >= v[:-2]) & (v[1:-1] > v[2:])) + 1

    part, cep = a[lag:], c[lag:]
    up = tops(part)
    if not len(up):
        return 0.0, 0.0, -100.0
    best = int(up[np.argmax(part[up])])
    v = float(part[best] / a[0])
    first = [i for i in tops(cep) if cep[i] > 0.6 * (cep[tops(cep)].max() + cep.mean())]
    at = (int(first[0]) if first else best) + lag
    # The autocorrelation is the finer of the two near that lag.
    reach = max(1, at // 30)
    low = max(at - reach, lag)
    at = low + int(np.argmax(a[low : at + reach + 1]))
    ratio = a[at] / (a[0] - a[at]) if a[0] > a[at] else 1e10
    return (rate / at if v > cutoff else 0.0), v, float(np.clip(10 * np.log10(max(ratio, 1e-10)), -100, 100))


def pitch_shs(mag, rate: float, harmonics: int = 15, weight: float = 0.85, low: float = 52.0, high: float = 620.0, candidates: int = 3):
    """Sub-harmonic summation on an octave axis: candidate F0s, scores and voicing, best first."""
    mag = np.asarray(mag, float)
    f = np.arange(len(mag)) * rate / (2 * (len(mag) - 1))
    axis = np.arange(np.log2(low), np.log2(high * harmonics), 1 / 48)
    on = np.interp(2**axis, f[1:], mag[1:], right=0.0)
    s = np.zeros(len(axis))
    for h in range(1, harmonics + 1):
        k = round(48 * np.log2(h))
        if k < len(on):
            s[: len(on) - k] += weight ** (h - 1) * on[k:]
    s = s[axis <= np.log2(high)]
    top = [i for i in range(1, len(s) - 1) if s[i] > s[i - 1] and s[i] >= s[i + 1]]
    top = sorted(top, key=lambda i: -s[i])[:candidates]
    out = []
    for i in top:
        d = s[i - 1] - 2 * s[i] + s[i + 1]
        at = axis[i] + (0.5 * (s[i - 1] - s[i + 1]) / d if d else 0.0) / 48
        out.append((float(2**at), float(s[i]), float(1 - s.mean() / s[i]) if s[i] > 0 else 0.0))
    return out


def viterbi_pitch(rows, w_local: float = 2.0, w_vv: float = 10.0, w_vvd: float = 5.0, w_vuv: float = 10.0, w_range: float = 1.0, w_uu: float = 0.0, cutoff: float = 0.7) -> np.ndarray:
    """The cheapest path through each row's candidates (f0, voicing) and the unvoiced state; 0 is unvoiced."""
    cost, back, freqs, change = None, [], [], None
    for cands in rows:
        f = np.array([c[0] for c in cands] + [0.0])
        p = np.array([min(max(c[1], 1e-6), 1.0) for c in cands] + [min(max(1 - max([c[1] for c in cands], default=0.0), 1e-6), 1.0)])
        local = -w_local * np.log(p) + np.where(p < cutoff, 1.0, 0.0) * (f > 0) + w_range * ((f > 0) & ((f < 100) | (f > 350)))
        if cost is None:
            cost, change = local, np.zeros(len(f))
            back.append(np.zeros(len(f), int))
        else:
            was = freqs[-1]
            step, ratio = np.zeros((len(was), len(f))), np.zeros((len(was), len(f)))
            for i, a in enumerate(was):
                for j, b in enumerate(f):
                    if a > 0 and b > 0:
                        ratio[i, j] = np.log(b / a)
                        step[i, j] = w_vv * abs(ratio[i, j]) + w_vvd * abs(ratio[i, j] - change[i])
                    else:
                        step[i, j] = w_uu if a == b == 0 else w_vuv
            all_ = cost[:, None] + step
            best = all_.argmin(0)
            cost, change = all_[best, np.arange(len(f))] + local, ratio[best, np.arange(len(f))]
            back.append(best)
        freqs.append(f)
    if cost is None:
        return np.empty(0)
    at, out = int(cost.argmin()), []
    for f, b in zip(freqs[::-1], back[::-1]):
        out.append(f[at])
        at = int(b[at])
    return np.array(out[::-1])


def smooth_pitch(f0, width: int = 3) -> np.ndarray:
    """Running median of voiced rows, and single voiced or unvoiced rows between two others removed."""
    f = np.asarray(f0, float).copy()
    for i in range(1, len(f) - 1):
        if f[i] > 0 and f[i - 1] == f[i + 1] == 0:
            f[i] = 0
        elif f[i] == 0 and f[i - 1] > 0 and f[i + 1] > 0:
            f[i] = (f[i - 1] + f[i + 1]) / 2
    h = width // 2
    return np.array([np.median(w[w > 0]) if v > 0 else 0.0 for i, v in enumerate(f) for w in [f[max(0, i - h) : i + h + 1]]])


def jitter(x, period: float) -> dict[str, float]:
    """Jitter (local, DDP), shimmer (local, dB) and waveform HNR of a signal with about `period` rows a cycle."""
    x = np.asarray(x, float)
    starts, at, r = [0], 0, max(1, round(period * 0.1))
    n = max(2, round(period))
    while at + 2 * n + r < len(x):
        ref = x[at : at + n]
        score = [np.dot(ref, x[at + d : at + d + n]) / max(np.linalg.norm(ref) * np.linalg.norm(x[at + d : at + d + n]), 1e-12) for d in range(n - r, n + r + 1)]
        k = int(np.argmax(score))
        fine = 0.0
        if 0 < k < len(score) - 1:
            d = score[k - 1] - 2 * score[k] + score[k + 1]
            fine = 0.5 * (score[k - 1] - score[k + 1]) / d if d else 0.0
        if score[k] < 0.5:
            break
        starts.append(starts[-1] + n - r + k + fine)
        at += n - r + k
    t = np.diff(starts)
    if len(t) < 2:
        return {"jitterlocal": 0.0, "jitterddp": 0.0, "shimmerlocal": 0.0, "shimmerdb": 0.0, "loghnr": 0.0}
    amp = np.array([np.ptp(x[int(s) : int(s) + n]) for s in starts[:-1]])
    cycles = np.stack([x[int(s) : int(s) + n] for s in starts[:-1]])
    mean = cycles.mean(0)
    noise = ((cycles - mean) ** 2).sum()
    shim = min(1.0, float(np.abs(np.diff(amp)).mean() / max(amp.mean(), 1e-12)))
    return {
        "jitterlocal": min(1.0, float(np.abs(np.diff(t)).mean() / t.mean())), "jitterddp": min(1.0, float(np.abs(np.diff(t, 2)).mean() / t.mean())) if len(t) > 2 else 0.0,
        "shimmerlocal": shim, "shimmerdb": float(20 * np.log10(1 + shim)), "loghnr": float(10 * np.log10(max(len(cycles) * (mean**2).sum(), 1e-12) / max(noise, 1e-12))),
    }


def harmonics(mag, rate: float, f0: float, count: int = 10) -> np.ndarray:
    """Levels of the harmonics in dB against the first: the nearest local maximum around h * f0; -201 where there is none."""
    mag = np.asarray(mag, float)
    hz = rate / (2 * (len(mag) - 1))
    out = np.full(count, -201.0)
    if f0 <= 0:
        return out
    level = []
    for h in range(1, count + 1):
        a, b = int((h - 0.5) * f0 / hz) + 1, min(int((h + 0.5) * f0 / hz) + 1, len(mag) - 1)
        top = [i for i in range(max(a, 1), b) if mag[i] >= mag[i - 1] and mag[i] >= mag[i + 1]]
        level.append(mag[min(top, key=lambda i: abs(i - h * f0 / hz))] if top else None)
    if level[0]:
        out[:] = [-201.0 if v is None else max(20 * np.log10(max(v, 1e-12) / level[0]), -200.0) for v in level]
    return out


def rasta(x) -> np.ndarray:
    """The RASTA band-pass over rows (columns apart): numerator 0.1 (2, 1, 0, -1, -2), pole 0.94."""
    x = np.asarray(x, float)
    pad = np.concatenate([np.repeat(x[:1], 4, 0), x])
    num = sum(c * pad[4 - k : len(pad) - k] for k, c in enumerate((0.2, 0.1, 0.0, -0.1, -0.2)))
    out, state = np.empty_like(num), np.zeros(num.shape[1:])
    for i, v in enumerate(num):
        state = 0.94 * state + v
        out[i] = state
    return out


def tone_filter(x, rate: float, notes: int = 48, first: float = 55.0, decay: float = 0.998, every: int = 100) -> np.ndarray:
    """Each note's exponential correlation with a sine and a cosine, read every so many rows."""
    x = np.asarray(x, float)
    f = first * 2 ** (np.arange(notes) / 12)
    turn, state, out = np.exp(-2j * np.pi * f / rate), np.zeros(notes, complex), []
    now = np.ones(notes, complex)
    for i, v in enumerate(x):
        state = decay * state + (1 - decay) * v * now
        now = now * turn
        if (i + 1) % every == 0:
            out.append(10 * np.abs(state))
    return np.array(out).reshape(-1, notes)


def turns(x, on: float, off: float | None = None, pre: int = 10, post: int = 20, longest: int = 0) -> list[tuple[int, int]]:
    """Turns (start, end; inclusive): entered after more than pre rows above `on`, left after more than post rows at or below `off`."""
    off = on if off is None else off
    out, start, above, below = [], None, 0, 0
    for i, v in enumerate(x):
        if start is None:
            above = above + 1 if v > on else 0
            if above > pre:
                start, below = i - above + 1, 0
        else:
            below = below + 1 if v <= off else 0
            if below > post:
                out.append((start, i - below))
                start, above = None, 0
            elif longest and i - start + 1 >= longest:
                out.append((start, i))
                start, above = None, 0
    if start is not None:
        out.append((start, len(x) - 1 - below))
    return out


def vad(energy, entropy=None, divergence=None, k: float = 1.0, forget: float = 0.98) -> np.ndarray:
    """Voice activity 0..1: each cue against its adaptive noise mean and deviation, weighed 0.25, 0.45, 0.30."""
    cues = [(0.25, energy), (0.45, entropy), (0.30, divergence)]
    cues = [(w, np.asarray(c, float)) for w, c in cues if c is not None]
    out = np.zeros(len(cues[0][1]))
    for w, c in cues:
        mean, var = (c[0], 1e-6) if len(c) else (0.0, 1e-6)
        for i, v in enumerate(c):
            z = (v - mean) / np.sqrt(var)
            out[i] += w * np.clip(np.ceil(z / k) * 0.2, 0, 1)
            if z < k:
                mean, var = forget * mean + (1 - forget) * v, forget * var + (1 - forget) * (v - mean) ** 2 + 1e-9
    return out / sum(w for w, _ in cues)


def lstm(x, w) -> np.ndarray:
    """A layer with peepholes: w has wx (4h, d), wh (4h, h), b (4h), p (3, h); gates in the order input, forget, cell, output."""
    h, c, out = np.zeros(w["wh"].shape[1]), np.zeros(w["wh"].shape[1]), []
    sig = lambda v: 1 / (1 + np.exp(-v))
    for v in np.asarray(x, float):
        i, f, g, o = np.split(w["wx"] @ v + w["wh"] @ h + w["b"], 4)
        i, f = sig(i + w["p"][0] * c), sig(f + w["p"][1] * c)
        c = f * c + i * np.tanh(g)
        h = sig(o + w["p"][2] * c) * np.tanh(c)
        out.append(h)
    return np.array(out)


def softmax(x) -> np.ndarray:
    """Along the last axis."""
    e = np.exp(x - np.max(x, -1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def bidirectional(x, forward, backward) -> np.ndarray:
    """A forward layer's activations beside those of a layer that reads from the end."""
    x = list(x)
    return np.concatenate([lstm(x, forward), lstm(x[::-1], backward)[::-1]], 1)


def net_vad(voice, energy, threshold: float = 0.5, margin: float = 0.3, hold: int = 10, decay: float = 0.98) -> np.ndarray:
    """Voice activity 0 or 1 from a net's output and the energy: both the output and the energy (against envelopes that hold, then decay towards it) must be high."""
    voice, energy = np.asarray(voice, float), np.asarray(energy, float)
    out = np.zeros(len(voice))
    if not len(out):
        return out
    top = bottom = energy[0]
    since_top = since_bottom = 0
    for i, (v, e) in enumerate(zip(voice, energy)):
        since_top, since_bottom = since_top + 1, since_bottom + 1
        if e >= top:
            top, since_top = e, 0
        elif since_top > hold:
            top = decay * top + (1 - decay) * e
        if e <= bottom:
            bottom, since_bottom = e, 0
        elif since_bottom > hold:
            bottom = decay * bottom + (1 - decay) * e
        out[i] = float(v > threshold and e >= bottom + margin * (top - bottom))
    return out


def lattice(x, reflection) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward prediction errors of the lattice filter with these reflection coefficients."""
    f = np.asarray(x, float)
    b = f.copy()
    for k in reflection:
        late = np.concatenate([[0.0], b[:-1]])
        f, b = f + k * late, late + k * f
    return f, b


def residual(x, a) -> np.ndarray:
    """The prediction error: x through the filter 1, a[0], a[1], ..."""
    return np.convolve(np.asarray(x, float), np.concatenate([[1.0], a]))[: len(x)]


def lp_spectrum(a, gain: float, bins: int) -> np.ndarray:
    """Magnitudes of the all-pole filter at bins frequencies from 0 to half the rate."""
    w = np.pi * np.arange(bins) / max(bins - 1, 1)
    z = np.exp(-1j * np.outer(w, np.arange(1, len(a) + 1)))
    return np.sqrt(max(gain, 0.0)) / np.maximum(np.abs(1 + z @ np.asarray(a, float)), 1e-12)


def spectrum_formants(a, rate: float, bins: int = 256, low: float = 50.0, high: float = 5500.0) -> np.ndarray:
    """Frequencies of the prediction spectrum's peaks, refined by the parabola through three bins."""
    s = np.log(lp_spectrum(a, 1.0, bins))
    top = np.flatnonzero((s[1:-1] > s[:-2]) & (s[1:-1] >= s[2:])) + 1
    d = s[top - 1] - 2 * s[top] + s[top + 1]
    f = (top + np.where(d != 0, 0.5 * (s[top - 1] - s[top + 1]) / np.where(d != 0, d, 1), 0)) * rate / (2 * (bins - 1))
    return f[(f >= low) & (f <= high)]


def harmonic_differences(mag, rate: float, f0: float, formant_hz=(), pairs=((1, 2),), count: int = 10) -> dict[str, float]:
    """H<i>-H<j> in dB for the pairs, and H1-A<k> with the strongest bin near each formant; 0 where a part is missing."""
    h = harmonics(mag, rate, f0, count)
    mag = np.asarray(mag, float)
    level = lambda i: h[i - 1] if 0 < i <= count and h[i - 1] > -201 else None
    out = {}
    for i, j in pairs:
        out[f"h{i}_h{j}"] = level(i) - level(j) if level(i) is not None and level(j) is not None else 0.0
    hz = rate / (2 * (len(mag) - 1))
    first = int(round(f0 / hz)) if f0 > 0 else 0
    for k, f in enumerate(formant_hz, 1):
        a, b = int(max(f - f0 / 2, 0) / hz), int(min((f + f0 / 2) / hz + 1, len(mag)))
        near = mag[a:b].max() if f0 > 0 and a < b else 0.0
        base = mag[max(first - 1, 0) : first + 2].max() if first else 0.0
        out[f"h1_a{k}"] = float(20 * np.log10(base / near)) if near > 0 and base > 0 else 0.0
    return out


def acf_hnr(frame, period: float, floor: float = -100.0) -> tuple[float, float]:
    """Harmonics-to-noise from the autocorrelation at a period in rows: in dB, inside +-100, and linear, inside 0.01 to 10000."""
    x = np.asarray(frame, float)
    lag = int(round(period))
    if not 0 < lag < len(x):
        return floor, 0.01
    a, b = float(x @ x), float(x[:-lag] @ x[lag:])
    ratio = b / (a - b) if a > b else (1e10 if a > 0 else 0.0)
    return float(np.clip(10 * np.log10(max(ratio, 1e-10)), floor, -floor)), float(np.clip(ratio, 0.01, 1e4))


def jitter_of(signal: DataFrame, pitch: DataFrame, keys: list[str], x: str, rate: float, f0: str = "f0", step: float = 0.01, size: float = 0.06) -> DataFrame:
    """keys, vidx and the jitter set of each row of a pitch level (keys, vidx, f0): its samples are the signal's in a window about the row's time.

    The two levels meet by time: a sample goes to each pitch row whose window it
    lies in, so series split over tasks by (keys, row). Rows of no voice, and
    those without samples, hold the last values before; 0 at first.
    """
    from pyspark.sql import Window

    at = F.col("vidx") / rate
    rows = signal.select(*keys, "vidx", x).withColumn("_r", F.explode(F.sequence(F.greatest(F.ceil((at - size / 2) / step), F.lit(0)), F.greatest(F.floor((at + size / 2) / step), F.lit(0)))))
    f = pitch.select(*keys, F.col("vidx").alias("_r"), F.col(f0).alias("_f0"))
    voiced = rows.join(f.where("_f0 > 0"), [*keys, "_r"])
    names = ["jitterlocal", "jitterddp", "shimmerlocal", "shimmerdb", "loghnr"]
    kind = signal.select(*keys).schema.simpleString()[7:-1].replace(":", " ") + ", _r long, " + ", ".join(f"{n} double" for n in names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vidx", kind="stable")
        got = jitter(pdf[x].to_numpy(float), rate / float(pdf["_f0"].iloc[0]))
        return pd.DataFrame([[*pdf[keys].iloc[0], int(pdf["_r"].iloc[0]), *(got[n] for n in names)]], columns=[*keys, "_r", *names])

    made = voiced.groupBy(*keys, "_r").applyInPandas(run, kind)
    w = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    held = f.join(made, [*keys, "_r"], "left")
    return held.select(*keys, F.col("_r").alias("vidx"), *[F.coalesce(F.last(n, ignorenulls=True).over(w), F.lit(0.0)).alias(n) for n in names])


def window_udf(fn, kind: str = "double"):
    """A function over the values of a row frame as an aggregate: use it with .over(window)."""

    @F.pandas_udf(kind)
    def run(v: pd.Series) -> float:
        return float(fn(v.to_numpy(float)))

    return run


def per_series(df: DataFrame, keys: list[str], order: list[str], x: str, fn, names: list[str]) -> DataFrame:
    """keys and fn's named numbers of each series; its rows come to one task in order."""
    kind = df.select(*keys).schema.simpleString()[7:-1] + "".join(f",{x}_{n}:double" for n in names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = fn(pdf.sort_values(order, kind="stable")[x].to_numpy(float))
        return pd.DataFrame([[*pdf[keys].iloc[0], *(float(got[n]) for n in names)]], columns=[*keys, *(f"{x}_{n}" for n in names)])

    return df.select(*dict.fromkeys([*keys, *order, x])).groupBy(*keys).applyInPandas(run, kind.replace(":", " "))


def turns_of(df: DataFrame, keys: list[str], order: list[str], x: str, **how) -> DataFrame:
    """keys, segment, start, stop of every turn."""
    kind = df.select(*keys).schema.simpleString()[7:-1].replace(":", " ") + ", segment long, start long, stop long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = turns(pdf.sort_values(order, kind="stable")[x].to_numpy(float), **how)
        return pd.DataFrame([[*pdf[keys].iloc[0], i, a, b] for i, (a, b) in enumerate(got)], columns=[*keys, "segment", "start", "stop"])

    return df.select(*dict.fromkeys([*keys, *order, x])).groupBy(*keys).applyInPandas(run, kind)


def on_frames(fn, kind: str = "array<double>"):
    """A column function from a kernel over one array; null frames give null."""

    @F.pandas_udf(kind)
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda a: None if a is None else fn(np.asarray(a, float)))

    def of(c: Column) -> Column:
        return run(c)

    return of
