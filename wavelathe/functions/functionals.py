"""Statistical aggregates of a value column in segments, all in one shuffle.

`prepared` adds what the aggregates share (place, count, extremes, mean, power
sums) by window functions over the segment; `functionals` then groups once.
Both are dealt by the same keys, so Spark exchanges the rows once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import blocks as blk


def ratio_limit(x: Column, limit: float = 10.0, top: float = 20.0) -> Column:
    """x inside the limit; beyond it, compressed to at most `top` in size."""
    over = (top - limit) * F.tanh(F.sqrt(F.greatest(F.abs(x) - limit, F.lit(0.0))) / (top - limit)) + limit
    return F.when(F.abs(x) <= limit, x).otherwise(F.signum(x) * over)


def _div(a: Column, b: Column, other: float = 0.0) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(other)


def prepared(df: DataFrame, keys: list[str], order: list[str], x: str, nonzero: int = 0) -> DataFrame:
    """keys, x and the shared columns; nonzero 1 keeps x <> 0, 2 keeps x > 0."""
    df = df.select(*keys, *[c for c in order if c not in keys], F.col(x).cast("double").alias("x"))
    if nonzero:
        df = df.where("x <> 0" if nonzero == 1 else "x > 0")
    w = Window.partitionBy(*keys)
    o = w.orderBy(*order)
    out = df.select(
        "*",
        (F.row_number().over(o) - 1).cast("double").alias("i"),
        F.count("x").over(w).cast("double").alias("n"),
        F.min("x").over(w).alias("lo"),
        F.max("x").over(w).alias("hi"),
        F.avg("x").over(w).alias("mu"),
        F.lag("x").over(o).alias("was"),
        F.lead("x").over(o).alias("will"),
    )
    return out.select("*", F.avg(F.col("i") * F.col("x")).over(w).alias("mix"), F.avg(F.col("i") * F.col("i") * F.col("x")).over(w).alias("miix"))


def prepared_in_blocks(df: DataFrame, b: blk.Blocks, x: str, nonzero: int = 0) -> DataFrame:
    """`prepared` for long series: rows see their neighbours by block, and aggregates of the whole are merged and joined back."""
    df = df.select(*b.keys, "vidx", F.col(x).cast("double").alias("x"))
    if nonzero:
        df = df.where("x <> 0" if nonzero == 1 else "x > 0")
    rows = b.windowed(b.renumbered(df), {"was": lambda s: F.lag("x").over(s.ordered()), "will": lambda s: F.lead("x").over(s.ordered())}, 1, 1)
    rows = rows.withColumn("i", F.col("vidx").cast("double"))
    i, v = F.col("i"), F.col("x")
    return b.shared(rows, n=F.count("x").cast("double"), lo=F.min("x"), hi=F.max("x"), mu=F.avg("x"), mix=F.avg(i * v), miix=F.avg(i * i * v))


def _c(name: str) -> Column:
    return F.col(name)


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1.0).otherwise(0.0))


def _n() -> Column:
    return F.max("n")


def extremes() -> dict[str, Column]:
    first = lambda v: F.min(F.when(_c("x") == _c(v), _c("i"))) / _n()
    return {
        "max": F.max("x"), "min": F.min("x"), "range": F.max("x") - F.min("x"), "maxpos": first("hi"), "minpos": first("lo"),
        "amean": F.avg("x"), "maxameandist": F.max("x") - F.avg("x"), "minameandist": F.avg("x") - F.min("x"),
    }


def means() -> dict[str, Column]:
    x, zero = _c("x"), F.lit(0.0)
    of = lambda cond, v: F.coalesce(F.avg(F.when(cond, v)), zero)
    nz, pos, neg = x != 0, x > 0, x < 0
    gmean = F.coalesce(F.exp(F.avg(F.when(nz, F.ln(F.abs(F.when(nz, x)))))), zero)
    absmean, q = F.avg(F.abs(x)), x * x
    return {
        "absmean": absmean, "qmean": F.avg(q), "nzamean": of(nz, x), "nzabsmean": of(nz, F.abs(x)), "nzqmean": of(nz, q),
        "nzgmean": gmean, "nnz": _count(nz), "flatness": F.when(absmean == 0, 1.0).otherwise(_div(gmean, absmean)),
        "posamean": of(pos, x), "negamean": of(neg, x), "posqmean": of(pos, q), "posrqmean": F.sqrt(of(pos, q)),
        "negqmean": of(neg, q), "negrqmean": F.sqrt(of(neg, q)), "rqmean": F.sqrt(F.avg(q)), "nzrqmean": F.sqrt(of(nz, q)),
    }


def moments(ratio_limited: bool = False) -> dict[str, Column]:
    """Population moments, in built-in aggregates that combine before the exchange; kurtosis is not in excess of 3."""
    m2 = F.var_pop("x")
    wide = m2 > 1e-12
    norm = _div(F.sqrt(m2), F.avg("x"))
    return {
        "variance": m2, "stddev": F.sqrt(m2), "skewness": F.when(wide, F.skewness("x")).otherwise(0.0),
        "kurtosis": F.when(wide, F.kurtosis("x") + 3).otherwise(0.0), "stddevnorm": ratio_limit(norm) if ratio_limited else norm,
    }


def _nearest(q: float) -> Column:
    """The value at the nearest rank."""
    return F.get(F.sort_array(F.collect_list("x")), F.round(F.lit(q) * (F.count("x") - 1)).cast("int"))


def _shares(at: tuple) -> list[float]:
    return sorted({0.25, 0.5, 0.75, *at})


def percentiles(at: tuple = (0.05, 0.95), ranges: tuple = ((0, 1),), interpolated: bool = True, values: Column | None = None) -> dict[str, Column]:
    """Quartiles, their ranges and quotients, percentiles and theirs; between two ranks interpolated, or the nearer.

    A segment's values are sorted in one task, unless `values` has them (of the quartiles and `at`, ascending).
    """
    all_ = _shares(at)
    together = F.percentile("x", F.array(*map(F.lit, all_))) if values is None else values
    p = (lambda q: F.element_at(together, all_.index(q) + 1)) if interpolated or values is not None else _nearest
    out = {"quartile1": p(0.25), "quartile2": p(0.5), "quartile3": p(0.75)}
    pairs = {"12": (0.25, 0.5), "23": (0.5, 0.75), "13": (0.25, 0.75)}
    out |= {f"iqr{k}": F.abs(p(b) - p(a)) for k, (a, b) in pairs.items()}
    out |= {f"iqq{k}": _div(p(a), p(b)) for k, (a, b) in pairs.items()}
    out |= {f"percentile{q * 100:g}".replace(".", "_"): p(q) for q in at}
    for a, b in ranges:
        out[f"pctlrange{a}_{b}"] = F.abs(p(at[b]) - p(at[a]))
        out[f"pctlquotient{a}_{b}"] = _div(p(at[a]), p(at[b]))
    return out


def regression(coefficients: str | None = None, period: float = 1.0, inputs: bool = False) -> dict[str, Column]:
    """Least squares of x on its place: a line (c1 slope, c2 offset) and a parabola (c1 square, c2 slope, c3 offset).

    x0, y0: the parabola's vertex, x0 within the segment's length on either side;
    without a bend x0 is that length and y0 is 0. yr: the parabola at the last
    row; ls, rs: its slopes from the first row to the vertex and from there to
    the last row, 0 where the vertex lies outside. coefficients: places are
    shares of the segment, or seconds of `period` a row (second). inputs: values
    are from 0 to 1 of the range; y0nn, c3nn and yrnn are as they are.
    """
    n, i, x = _c("n"), _c("i"), _c("x")
    si, sii = (n - 1) / 2, (n - 1) * (2 * n - 1) / 6  # means of i and i**2
    var = sii - si * si
    slope = F.when(n > 1, (_c("mix") - si * _c("mu")) / F.when(n > 1, var)).otherwise(0.0)
    off = _c("mu") - slope * si
    line = slope * i + off
    # The parabola in the centred place t: x = a (t**2 - E t**2) + slope t + mean.
    t = i - si
    et4 = (n * n - 1) * (3 * n * n - 7) / 240
    ett = (n * n - 1) / 12
    ettx = _c("miix") - 2 * si * _c("mix") + si * si * _c("mu")
    a = F.when(n > 2, (ettx - ett * _c("mu")) / F.when(n > 2, et4 - ett * ett)).otherwise(0.0)
    curve = a * (t * t - ett) + slope * t + _c("mu")
    b, c = slope - 2 * a * si, _c("mu") - a * ett - slope * si + a * si * si
    bent = F.abs(a) > 1e-12
    x0 = F.when(bent, F.greatest(F.least(-b / (2 * F.when(bent, a)), n), -n)).otherwise(n)
    y0 = F.when(bent, c - b * b / (4 * F.when(bent, a))).otherwise(0.0)
    yr = a * (n - 1) * (n - 1) + b * (n - 1) + c
    by = {None: F.lit(1.0), "segment": n - 1, "second": F.lit(1.0 / period)}[coefficients]
    place, end = F.when(by != 0, x0 / F.when(by != 0, by)).otherwise(0.0), F.lit(1.0) if coefficients == "segment" else (n - 1) / by
    unit = _div(F.lit(1.0), _c("hi") - _c("lo")) if inputs else F.lit(1.0)
    value = lambda v: (v - _c("lo")) * unit if inputs else v
    left = F.when(place > 0, (value(y0) - value(c)) / F.when(place > 0, place)).otherwise(0.0)
    right = F.when(place < end, (value(yr) - value(y0)) / F.when(place < end, end - place)).otherwise(0.0)
    error = lambda fit: (F.avg(F.abs(x - fit) * unit), F.avg((x - fit) * (x - fit) * unit * unit))
    return {
        "linregc1": F.max(slope * by * unit), "linregc2": F.max(value(off)), "linregerra": error(line)[0], "linregerrq": error(line)[1],
        "qregc1": F.max(a * by * by * unit), "qregc2": F.max(b * by * unit), "qregc3": F.max(value(c)), "qregerra": error(curve)[0], "qregerrq": error(curve)[1],
        "centroid": _div(F.sum(F.abs(x) * i), F.sum(F.abs(x))) / _n(), "qregls": F.max(left), "qregrs": F.max(right), "qregx0": F.max(place), "qregy0": F.max(value(y0)), "qregyr": F.max(value(yr)),
        "qregy0nn": F.max(y0), "qregc3nn": F.max(c), "qregyrnn": F.max(yr),
    }


def crossings() -> dict[str, Column]:
    """Sign changes at places 1 to n-2, by n: through zero and through the mean."""
    inner = (_c("i") >= 1) & (_c("i") <= _c("n") - 2)
    cross = lambda a, b: inner & (a * b < 0) | inner & (b == 0) & (a != 0)
    return {"zcr": _count(cross(_c("was"), _c("x"))) / _n(), "mcr": _count(cross(_c("was") - _c("mu"), _c("x") - _c("mu"))) / _n()}


def samples(at: tuple = (0.0, 0.25, 0.5, 0.75, 1.0)) -> dict[str, Column]:
    return {f"samplepos{k}": F.max(F.when(_c("i") == F.floor((_c("n") - 1) * p), _c("x"))) for k, p in enumerate(at)}


def times(levels: tuple = (25, 50, 75, 90)) -> dict[str, Column]:
    x, n = _c("x"), _n()
    out = {}
    for p in levels:
        t = _c("lo") + p / 100 * (_c("hi") - _c("lo"))
        out[f"upleveltime{p}"], out[f"downleveltime{p}"] = _count(x > t) / n, _count(x <= t) / n
    steps, bends = F.greatest(n - 1, F.lit(1.0)), F.greatest(n - 2, F.lit(1.0))
    curve = _c("will") - 2 * x + _c("was")
    return out | {"risetime": _count(_c("was") < x) / steps, "falltime": _count(_c("was") > x) / steps, "leftctime": _count(curve < 0) / bends, "rightctime": _count(curve > 0) / bends, "duration": n}


def dct(first: int = 1, last: int = 6) -> dict[str, Column]:
    return {f"dct{k}": F.sum(F.sqrt(2.0 / _c("n")) * _c("x") * F.cos(math.pi * k * (_c("i") + 0.5) / _c("n"))) for k in range(first, last + 1)}


def onset(threshold: float = 0.0) -> dict[str, Column]:
    """Places where |x| first goes above and last falls to the threshold, and how often."""
    up, down = F.abs("x") > threshold, F.abs("x") <= threshold
    before = F.coalesce(F.abs("was") > threshold, F.lit(False))
    on, off = up & ~before, down & before
    return {
        "onsetpos": F.coalesce(F.min(F.when(on, _c("i"))), F.lit(0.0)) / _n(), "offsetpos": F.coalesce(F.max(F.when(off, _c("i"))), F.lit(0.0)) / _n(),
        "numonsets": _count(on), "numoffsets": _count(off), "onsetrate": _count(on) / _n(),
    }


def runs(kind: str = "change", value: float = 0.0) -> dict[str, Column]:
    """Run-length segments: of equal values (change), or rows with x (eq, non, lt, gt, leq, geq) the value."""
    x = _c("x")
    if kind == "change":
        new = _c("was").isNull() | (_c("was") != x)
        number = _count(new)
        return {"numsegments": number, "meanseglen": _n() / number / _n()}
    test = {"eq": lambda v: v == value, "non": lambda v: v != value, "lt": lambda v: v < value, "gt": lambda v: v > value, "leq": lambda v: v <= value, "geq": lambda v: v >= value}[kind]
    inside = test(x)
    number = _count(inside & ~F.coalesce(test(_c("was")), F.lit(False)))
    return {"numsegments": number, "meanseglen": _div(_count(inside), number) / _n()}


REGISTRY: dict[str, Callable[..., dict[str, Column]]] = {
    "extremes": extremes, "means": means, "moments": moments, "percentiles": percentiles, "regression": regression,
    "crossings": crossings, "samples": samples, "times": times, "dct": dct, "onset": onset, "segments": runs,
}


def register(name: str, make: Callable[..., dict[str, Column]]) -> None:
    """Add a functional of one's own: a function that gives named aggregates over the prepared columns."""
    REGISTRY[name] = make


#: Outputs that are places or lengths (shares of the segment's rows as computed), and numbers a row.
_PLACES = {"maxpos", "minpos", "centroid", "onsetpos", "offsetpos", "meanseglen", "maxseglen", "minseglen", "seglenstddev"}
_RATES = {"zcr", "mcr", "onsetrate"}


def _normed(name: str, c: Column, norm: str, period: float) -> Column:
    n = F.count("x")
    if name in _PLACES and norm != "segment":
        return c * n * (period if norm == "second" else 1.0)
    if norm == "second":
        return c / period if name in _RATES else c * period if name in ("nnz", "duration") else c
    return c


def functionals(df: DataFrame, keys: list[str], order: list[str], x: str, which: dict[str, dict] | list[str], nonzero: int = 0, field: str | None = None, norm: str = "segment", period: float = 1.0, blocks: blk.Blocks | None = None) -> DataFrame:
    """keys and `<field>_<functional>` of every named set, in one groupBy.

    norm gives places and lengths as shares of the segment, in rows (frame), or
    in seconds of `period` a row; with it rates are a second too. With blocks
    (over the same keys, order vidx) each segment may be longer than a task
    can hold: partial aggregates are merged, and percentiles are ranked by counts.
    """
    which = dict(which) if isinstance(which, dict) else {w: {} for w in which}
    field = field or x
    if blocks is None:
        cols = {k: c for name, args in which.items() for k, c in REGISTRY[name](**args).items()}
        rows = prepared(df, keys, order, x, nonzero)
        return rows.groupBy(*keys).agg(*[_normed(k, c, norm, period).cast("double").alias(f"{field}_{k}") for k, c in cols.items()])
    if list(blocks.keys) != list(keys) or list(order) != ["vidx"]:
        raise ValueError("blocks are of a level's series, in the order of vidx")
    ranks = which.pop("percentiles", None)
    cols = {k: c for name, args in which.items() for k, c in REGISTRY[name](**args).items()}
    rows = prepared_in_blocks(df, blocks, x, nonzero)
    out = rows.groupBy(*keys).agg(*[_normed(k, c, norm, period).cast("double").alias(f"{field}_{k}") for k, c in cols.items()]) if cols else None
    if ranks is None:
        return out
    plain = df.where(F.col(x) != 0 if nonzero == 1 else F.col(x) > 0) if nonzero else df
    sorted_ = blk.percentiles(plain, keys, x, _shares(ranks.get("at", (0.05, 0.95))), ranks.get("interpolated", True))
    sorted_ = sorted_.select(*keys, *[c.alias(f"{field}_{k}") for k, c in percentiles(**ranks, values=F.col("values")).items()])
    return sorted_ if out is None else out.join(sorted_, keys)


def functionals_of(df: DataFrame, keys: list[str], order: list[str], fields: list[str], which, nonzero: int = 0, norm: str = "segment", period: float = 1.0) -> DataFrame:
    """Every functional of every field: fields become rows, so that all share one exchange of the values, and the few results are turned back."""
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("x")) for f in fields])
    long = df.select(*keys, *[c for c in order if c not in keys], F.explode(pairs).alias("_p")).select("*", F.col("_p.f").alias("_f"), F.col("_p.x").alias("_x")).drop("_p")
    out = functionals(long, [*keys, "_f"], order, "_x", which, nonzero, "_", norm, period)
    names = [c for c in out.columns if c not in (*keys, "_f")]
    return out.groupBy(*keys).agg(*[F.max(F.when(F.col("_f") == f, F.col(c))).alias(f"{f}{c[1:]}") for f in fields for c in names])
