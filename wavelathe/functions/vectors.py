"""Array expressions: vector arithmetic, distances and frame descriptors, inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def rms(v: Column) -> Column:
    return F.sqrt(squares(v) / F.size(v))


def let(value: Column, body) -> Column:
    """body(x) with x bound to value. Inside a lambda an aggregate over an array is evaluated anew for each element; bound, it is once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _by(v: Column, d: Column) -> Column:
    return let(F.when(d > 0, d).otherwise(1.0), lambda k: F.transform(v, lambda x: x / k))


def _scale(v: Column, low: float, high: float) -> Column:
    ends = F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi"))
    return let(ends, lambda e: F.transform(v, lambda x: low + (high - low) * (x - e["lo"]) / F.when(e["hi"] > e["lo"], e["hi"] - e["lo"]).otherwise(1.0)))


def flattened(v: Column, ends: int = 5) -> Column:
    """v less the line through the means of its first and last `ends` values."""
    line = F.struct(mean(F.slice(v, 1, ends)).alias("a"), mean(F.slice(v, -ends, ends)).alias("b"), F.greatest(F.size(v) - 1, F.lit(1)).alias("n"))
    return let(line, lambda r: F.transform(v, lambda x, i: x - (r["a"] + (r["b"] - r["a"]) * i / r["n"])))


#: op(v, p1, p2): vectors out, except where the name says sum, energy or length.
OPERATIONS = {
    "norm_rms": lambda v, p=1, q=1: _by(v, rms(v)),
    "norm_l2": lambda v, p=1, q=1: _by(v, F.sqrt(squares(v))),
    "nl1": lambda v, p=1, q=1: _by(v, total(v)),
    "nr0": lambda v, p=1, q=1: _scale(v, 0.0, 1.0),
    "nr1": lambda v, p=1, q=1: _scale(v, -1.0, 1.0),
    "nma": lambda v, p=1, q=1: _by(v, F.array_max(F.transform(v, F.abs))),
    "add": lambda v, p=1, q=1: F.transform(v, lambda x: x + p),
    "mul": lambda v, p=1, q=1: F.transform(v, lambda x: x * p),
    "log": lambda v, p=1e-12, q=1: F.transform(v, lambda x: F.ln(F.greatest(x, F.lit(p)))),
    "lga": lambda v, p=2, q=1e-12: F.transform(v, lambda x: F.ln(F.greatest(x, F.lit(q))) / math.log(p)),
    "sqrt": lambda v, p=1, q=1: F.transform(v, lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))),
    "pow": lambda v, p=2, q=1: F.transform(v, lambda x: F.pow(x, F.lit(float(p)))),
    "exp": lambda v, p=2, q=1: F.transform(v, lambda x: F.pow(F.lit(float(p)), x)),
    "ee": lambda v, p=1, q=1: F.transform(v, F.exp),
    "abs": lambda v, p=1, q=1: F.transform(v, F.abs),
    "agn": lambda v, p=0, q=1, seed=0: F.zip_with(v, F.transform(v, lambda x, i: p + q * F.randn(seed)), lambda a, b: a + b),
    "min": lambda v, p=1, q=1: F.transform(v, lambda x: F.least(x, F.lit(float(p)))),
    "max": lambda v, p=1, q=1: F.transform(v, lambda x: F.greatest(x, F.lit(float(p)))),
    "sum": lambda v, p=1, q=1: total(v),
    "ssm": lambda v, p=1, q=1: squares(v),
    "ll1": lambda v, p=1, q=1: total(v) / F.size(v),
    "ll2": lambda v, p=1, q=1: F.sqrt(squares(v)) / F.size(v),
    "fla": lambda v, p=1, q=1: flattened(v),
    "dbp": lambda v, p=1e-12, q=1: F.transform(v, lambda x: 10 * F.log10(F.greatest(x, F.lit(p)))),
    "dbv": lambda v, p=1e-12, q=1: F.transform(v, lambda x: 20 * F.log10(F.greatest(x, F.lit(p)))),
}

BINARY = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "min": lambda a, b: F.least(a, b), "max": lambda a, b: F.greatest(a, b),
    "div": lambda a, b: F.when(b == 0, a).otherwise(a / F.when(b != 0, b)), "pow": lambda a, b: F.pow(a, b),
}


def operation(name: str, v: Column, *args) -> Column:
    return OPERATIONS[name](v, *args)


def binary(name: str, *vs: Column) -> Column:
    out = vs[0]
    for v in vs[1:]:
        out = F.zip_with(out, v, BINARY[name])
    return out


def cosine_distance(a: Column, b: Column) -> Column:
    d = F.sqrt(squares(a)) * F.sqrt(squares(b))
    return 1 - F.when(d > 0, dot(a, b) / F.when(d > 0, d)).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squares(F.zip_with(a, b, lambda x, y: x - y)))


def top_indices(v: Column, k: int = 1) -> Column:
    """1-based places of the k largest |x|, ties to the lower place."""
    spots = F.array_sort(F.transform(v, lambda x, i: F.struct((-F.abs(x)).alias("m"), i.alias("i"))))
    return F.transform(F.slice(spots, 1, k), lambda r: r["i"] + 1)


def preemphasised(v: Column, k: float = 0.97, de: bool = False) -> Column:
    """x[n] - k x[n-1] inside a row (+ with de), the first value (1 - k) x[0]."""
    before = F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0)))
    rest = F.zip_with(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), before, lambda x, y: x + k * y if de else x - k * y)
    return F.concat(F.transform(F.slice(v, 1, 1), lambda x: (1 - k) * x), rest)


def window_values(name: str, n: int, sigma: float = 0.4, alpha: float = 0.16) -> list[float]:
    """Window functions by name."""
    t = [k / (n - 1) if n > 1 else 0.5 for k in range(n)]
    cos = lambda *c: [sum(a * math.cos(2 * math.pi * j * x) for j, a in enumerate(c)) for x in t]
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    tri = [1 - abs(2 * (k + 0.5) / n - 1) for k in range(n)]
    return {
        "rectangular": lambda: [1.0] * n, "hann": lambda: cos(0.5, -0.5), "hamming": lambda: cos(0.54, -0.46),
        "triangular": lambda: tri, "tripower": lambda: [x * x for x in tri], "bartlett": lambda: [1 - abs(2 * x - 1) for x in t],
        "sine": lambda: [math.sin(math.pi * x) for x in t], "lanczos": lambda: [sinc(2 * x - 1) for x in t],
        "gauss": lambda: [math.exp(-0.5 * ((2 * x - 1) / sigma) ** 2) for x in t],
        "blackman": lambda: cos((1 - alpha) / 2, -0.5, alpha / 2),
        "bartlett-hann": lambda: [0.62 - 0.48 * abs(x - 0.5) - 0.38 * math.cos(2 * math.pi * x) for x in t],
        "blackman-harris": lambda: cos(0.35875, -0.48829, 0.14128, -0.01168),
    }[name]()


def windowed(v: Column, name: str, n: int, gain: float = 1.0, offset: float = 0.0, square_root: bool = False, fade: int = 0, shift: int = 0) -> Column:
    """v times the window of n values; its square root; or with fade, ones but for the window's halves over the first and last `fade` values. shift turns the window to the right."""
    w = window_values(name, n)
    if fade:
        edge = window_values(name, 2 * fade)
        w = edge[:fade] + [1.0] * (n - 2 * fade) + edge[fade:]
    if shift:
        w = w[-shift:] + w[:-shift]
    if square_root:
        w = [math.sqrt(max(x, 0.0)) for x in w]
    return F.zip_with(v, F.array(*[F.lit(gain * x) for x in w]), lambda x, y: x * y + offset)


def energy(v: Column, floor: float = 8.67e-19, scale: float = 1.0, bias: float = 0.0, sums: bool = False) -> dict[str, Column]:
    """Root mean square, mean square and log energy, each scaled and shifted; with sums, of the sum of samples as 16-bit numbers (the scale of HTK's log energy)."""
    power = squares(v) / F.size(v)
    whole = squares(v) * 32767.0**2 if sums else power
    out = {"rms": F.sqrt(power), "energy2": power, "log": F.ln(F.greatest(whole, F.lit(1.0 if sums else floor)))}
    return {k: c * scale + bias for k, c in out.items()}


def intensity(v: Column, n: int) -> dict[str, Column]:
    w = window_values("hamming", n)
    i = dot(F.transform(v, lambda x: x * x), F.array(*map(F.lit, w))) / sum(w)
    return {"intensity": i, "loudness": F.pow(i / 1e-6, F.lit(0.3))}


def crossing_rates(v: Column) -> dict[str, Column]:
    """Zero and mean crossing rates, largest size, extremes and mean of a frame."""
    m = mean(v)
    rate = lambda u: F.size(F.filter(F.zip_with(F.slice(u, 1, F.size(u) - 1), F.slice(u, 2, F.size(u) - 1), lambda a, b: a * b), lambda p: p < 0)) / F.size(u)
    return {"zcr": rate(v), "mcr": let(m, lambda c: rate(F.transform(v, lambda x: x - c))), "amax": F.array_max(F.transform(v, F.abs)), "max": F.array_max(v), "min": F.array_min(v), "dc": m}


def autocorrelation(v: Column, lags: int) -> Column:
    """Sums of x[i] x[i + lag] for lags 0 to lags - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(lags - 1)), lambda k: dot(F.slice(v, 1, F.size(v) - k), F.slice(v, k + 1, F.size(v) - k)))


def amdf(v: Column, lags: int, method: str = "limit", invert: bool = False) -> Column:
    """Mean size of x[i] - x[i + lag]: over the pairs there are, cyclic (warp), or against zeros (zeropad)."""
    n = F.size(v)

    def at(k):
        if method == "limit":
            d = F.zip_with(F.slice(v, 1, n - k), F.slice(v, k + 1, n - k), lambda a, b: F.abs(a - b))
            return total(d) / (n - k)
        tail = F.slice(v, 1, k) if method == "warp" else F.transform(F.slice(v, 1, k), lambda x: x * 0.0)
        return total(F.zip_with(v, F.concat(F.slice(v, k + 1, n), tail), lambda a, b: F.abs(a - b))) / n

    out = F.transform(F.sequence(F.lit(0), F.lit(lags - 1)), at)
    return let(out, lambda o: let(F.array_max(o), lambda m: F.transform(o, lambda x: m - x))) if invert else out


def _shares(v: Column, floor: float) -> Column:
    """v shifted to be positive, as shares of its sum."""
    up = let(F.least(F.array_min(v), F.lit(0.0)), lambda low: F.transform(v, lambda x: F.greatest(x - low, F.lit(floor))))
    return let(up, lambda u: let(total(u), lambda s: F.transform(u, lambda x: x / s)))


def entropy(v: Column, floor: float = 1e-7) -> Column:
    """Of the values shifted to be positive and made to sum to 1, in bits."""
    return -F.aggregate(_shares(v, floor), F.lit(0.0), lambda a, x: a + x * F.log2(x))


def relative_entropy(a: Column, b: Column, floor: float = 1e-7) -> Column:
    """Kullback-Leibler divergence of a from b in bits, both shifted and made to sum to 1."""
    return total(F.zip_with(_shares(a, floor), _shares(b, floor), lambda x, y: x * F.log2(x / y)))


def histogram(v: Column, bins: int) -> Column:
    """Shares of the values in equal bins between the least and the largest; all in the first where they are equal."""
    ends = F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi"))
    places = let(ends, lambda e: F.transform(v, lambda x: F.when(e["hi"] > e["lo"], F.least(F.floor((x - e["lo"]) / (e["hi"] - e["lo"]) * bins), F.lit(bins - 1))).otherwise(0)))
    return let(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(p, lambda x: x == k)) / F.size(p)))


def _centred(v: Column) -> Column:
    return let(mean(v), lambda m: F.transform(v, lambda x: x - m))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two rows of equal length; 0 where one does not vary."""
    return let(F.struct(_centred(a).alias("a"), _centred(b).alias("b")), lambda c: _cosine(c["a"], c["b"]))


def _cosine(a: Column, b: Column) -> Column:
    return let(F.sqrt(squares(a)) * F.sqrt(squares(b)), lambda d: F.when(d > 0, dot(a, b) / F.when(d > 0, d)).otherwise(0.0))


def angle(a: Column, b: Column) -> Column:
    """Between two rows, in radians."""
    return F.acos(F.greatest(F.least(_cosine(a, b), F.lit(1.0)), F.lit(-1.0)))


def second_max(v: Column) -> Column:
    """The second largest value; null for fewer than two."""
    return F.get(F.sort_array(v, asc=False), F.lit(1))


def running_product(v: Column) -> Column:
    return F.aggregate(v, F.lit(1.0), lambda a, x: a * x)


def durbin(acf: Column, order: int) -> Column:
    """Levinson-Durbin in one fold: array of order coefficients and the residual energy."""
    start = F.struct(F.transform(F.sequence(F.lit(1), F.lit(order)), lambda i: F.lit(0.0)).alias("a"), F.element_at(acf, 1).alias("e"))

    def step(s, m):
        a, e = s["a"], s["e"]
        acc = F.element_at(acf, m + 1) + total(F.transform(F.slice(F.sequence(F.lit(1), F.lit(order)), 1, m - 1), lambda j: F.element_at(a, j) * F.element_at(acf, m - j + 1)))
        k = F.when(e > 0, -acc / F.when(e > 0, e)).otherwise(0.0)
        new = F.transform(a, lambda x, i: F.when(i + 1 == m, k).when(i + 1 < m, x + k * F.element_at(a, F.greatest(m - i - 1, F.lit(1)))).otherwise(x))
        return F.struct(new.alias("a"), (e * (1 - k * k)).alias("e"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(order)), start, step)
