"""The library's operators as pipeline nodes.

A node reads levels (DataFrames with keys, vidx, perhaps time, and fields) and
writes one. Its option `keys` names the columns of the series, and what it does
not change it passes on. Importing this module registers all nodes.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import functionals as fn
from ..functions import spectral, vectors
from ..operators import kernels, models, segments, windows
from ..metadata import axis_of, described
from ..series import join_periodic, of_level
from ..sources import files
from .graph import operator


def _lead(df: DataFrame, keys, *but: str) -> list[str]:
    return [c for c in (*keys, "vidx", "segment", "time") if c in df.columns and c not in but]


def _fields(df: DataFrame, keys, fields=None) -> list[str]:
    return list(fields) if fields else [c for c in df.columns if c not in (*keys, "vidx", "segment", "time")]


def _mapped(df: DataFrame, keys, fields, make, suffix: str, copy: bool = False) -> DataFrame:
    """df's lead columns and `<field>_<suffix>` of each field, with the fields too if copy."""
    own = _fields(df, keys, fields)
    return df.select(*_lead(df, keys), *(own if copy else []), *[make(f).alias(f"{f}_{suffix}") for f in own])


# Projections and filters.
@operator("select")
def select(df: DataFrame, keys, fields=None, ranges=None, new_names=None, into: str | None = None) -> DataFrame:
    """Fields by name, `f[a-b]` for places a..b (from 1) of an array, or by ranges of field numbers (`2-4`, `3-$`); renamed, or packed into one array."""
    every = _fields(df, keys)
    chosen: list[tuple[str, Column]] = []
    for r in ranges or ():
        a, _, b = str(r).partition("-")
        number = lambda t: len(every) if t == "$" else int(t)
        chosen += [(c, F.col(c)) for c in every[number(a) - 1 : number(b or a)]]
    for f in fields or ():
        if m := re.fullmatch(r"(.+)\[(\d+|\$)(?:-(\d+|\$))?\]", f):
            name, low, high = m.groups()
            size = F.size(name)
            a, b = (size if t == "$" else F.lit(int(t)) for t in (low, high or low))
            chosen.append((name, F.slice(name, a, F.greatest(b - a + 1, F.lit(0)))))
        else:
            chosen.append((f, F.col(f)))
    if not chosen:
        chosen = [(c, F.col(c)) for c in every]
    names = list(new_names) if new_names else [n for n, _ in chosen]
    if len(names) != len(chosen):
        raise ValueError("as many new names as fields are needed")
    if into:
        arrays = {n for n, t in df.dtypes if t.startswith("array")}
        parts = [c if n in arrays else F.array(c) for n, c in chosen]
        return df.select(*_lead(df, keys), F.concat(*parts).alias(into))
    return df.select(*_lead(df, keys), *[c.alias(n) for n, (_, c) in zip(names, chosen)])


@operator("filter")
def keep_rows(df: DataFrame, keys, field: str, threshold: float = 1.0, adaptive: int = 0, invert: bool = False, allow_equal: bool = False, remove: bool = False, instead: float | None = None) -> DataFrame:
    """Rows whose field passes the threshold; with `instead`, the others stay with that value in all fields."""
    good = windows.above(of_level(*keys), field, threshold, adaptive, invert, allow_equal)
    rows = df.withColumn("_good", good)
    if instead is None:
        rows = rows.where("_good")
    else:
        rows = rows.select(*_lead(df, keys), "_good", *[F.when(F.col("_good"), F.col(f)).otherwise(F.lit(instead)).alias(f) for f in _fields(df, keys)])
    return rows.drop("_good", *([field] if remove else []))


@operator("mixdown")
def mixdown(df: DataFrame, keys, fields=None, normalise: bool = True) -> DataFrame:
    return _mapped(df, keys, fields, lambda f: vectors.mean(F.col(f)) if normalise else vectors.total(F.col(f)), "mix")


@operator("top")
def top(df: DataFrame, keys, field: str, count: int = 1, first: int = 1, last: int = 0) -> DataFrame:
    """Places of the largest sizes among places first..last (0: the end) of an array."""
    v = F.col(field)
    part = F.slice(v, first, (F.lit(last) if last else F.size(v)) - first + 1) if first > 1 or last else v
    return df.select(*_lead(df, keys), F.transform(vectors.top_indices(part, count), lambda i: i + (first - 1)).alias(f"{field}_top"))


# Joins and segments.
@operator("join")
def join(*levels: DataFrame, keys, force: bool = False) -> DataFrame:
    return join_periodic(tuple(keys), *levels, force=force)


@operator("frame")
def frame(df: DataFrame, keys, field: str, size: int, step: int | None = None) -> DataFrame:
    cut = segments.frames(df, of_level(*keys), field, size, step)
    return cut.withColumnRenamed("segment", "vidx").withColumnRenamed("frame", field)


@operator("overlap_add")
def overlap_add(df: DataFrame, keys, field: str, step: int, normalise: bool = False, window: str | None = None, size: int = 0, gain: float = 1.0) -> DataFrame:
    """The series of overlapping frames, each under a window and a gain first."""
    v = vectors.windowed(F.col(field), window, size, gain) if window else F.transform(field, lambda x: x * gain)
    rows = df.select(*keys, F.col("vidx").alias("segment"), v.alias("_f"))
    return segments.overlap_add(rows, of_level(*keys), "_f", step, normalise).withColumnRenamed("x", field)


@operator("segment")
def segment(df: DataFrame, keys, mode: str = "full", size: int = 0, step: int = 0, by: str = "", intervals: str = "", period: float = 1.0, gap: float = 0.0, incomplete: bool = False) -> DataFrame:
    """A segment number for each row: fixed, full, list, meta (runs of equal values) or session (a gap in time)."""
    s = of_level(*keys)
    how = {
        "fixed": lambda: segments.fixed(df, s, size, step or None, incomplete), "full": lambda: segments.full(df), "meta": lambda: segments.runs(df, s, by),
        "list": lambda: segments.listed(df, segments.parse_list(intervals, period)), "session": lambda: segments.sessions(df, s, "time", gap),
    }
    return how[mode]()


@operator("turns")
def turns(df: DataFrame, keys, field: str, on: float, off: float | None = None, pre: int = 10, post: int = 20) -> DataFrame:
    return windows.turns_between(df, of_level(*keys), field, on, off, pre, post)


@operator("in_turns")
def in_turns(df: DataFrame, found: DataFrame, keys) -> DataFrame:
    """Rows with the segment of the turn that they lie in."""
    return segments.interval_join(df, found, of_level(*keys)).drop("start", "stop")


@operator("functionals")
def functionals(df: DataFrame, keys, which, fields=None, nonzero: int = 0, norm: str = "segment", period: float = 1.0) -> DataFrame:
    """A row for each series (and segment) with every named functional of every field."""
    by = [*keys, *(["segment"] if "segment" in df.columns else [])]
    own = _fields(df, keys, fields)
    return fn.functionals_of(df, by, ["vidx"], own, which, nonzero, norm, period)


# Rows of a series.
def _row_node(name: str, suffix: str, make):
    def node(df: DataFrame, keys, fields=None, copy: bool = False, **how) -> DataFrame:
        s = of_level(*keys)
        return _mapped(df, keys, fields, lambda f: make(s, f, **how), suffix, copy)

    operator(name)(node)


_row_node("smooth", "sma", windows.sma)
_row_node("delta", "de", windows.delta)
_row_node("preemphasis", "pe", windows.preemphasis)
_row_node("median", "med", windows.running_median)
_row_node("mean_norm", "mn", windows.mean_norm)
_row_node("mvn", "mvn", windows.mvn)
_row_node("range_norm", "range", windows.range_norm)
_row_node("log_energy_norm", "enorm", windows.log_energy_norm)
_row_node("direction", "dir", windows.pitch_direction)
_row_node("octaves", "oct", windows.octave_corrected)
_row_node("spikes", "clean", windows.without_spikes)
_row_node("hold", "env", windows.held)
_row_node("formant_smooth", "sma", windows.smoothed_formant)


# Values of a row.
def _value_node(name: str, suffix: str, make):
    def node(df: DataFrame, keys, fields=None, copy: bool = False, **how) -> DataFrame:
        return _mapped(df, keys, fields, lambda f: make(F.col(f), **how), suffix, copy)

    operator(name)(node)


def _set_node(name: str, make):
    """A node of several named results of each field."""

    def node(df: DataFrame, keys, fields=None, only=None, **how) -> DataFrame:
        out = [(f"{f}_{k}", c) for f in _fields(df, keys, fields) for k, c in make(F.col(f), **how).items() if not only or k in only]
        return df.select(*_lead(df, keys), *[c.alias(n) for n, c in out])

    operator(name)(node)


def _element(v: Column, op: str, **how) -> Column:
    """An operation on an array, or on a scalar field as an array of one (dtype is not known here, so scalars come as arrays)."""
    return vectors.OPERATIONS[op](v, **how)


def _whole_row(df: DataFrame, keys, operation: str, fields=None, into: str = "row", **how) -> DataFrame:
    """All fields of a row as one vector, in and out (the operation sees the row, not each field)."""
    own = _fields(df, keys, fields)
    arrays = {n for n, t in df.dtypes if t.startswith("array")}
    v = F.concat(*[F.col(f) if f in arrays else F.array(F.col(f).cast("double")) for f in own])
    return df.select(*_lead(df, keys), vectors.OPERATIONS[operation](v, **how).alias(into))


operator("row_vector")(_whole_row)
_value_node("vector", "op", lambda v, operation="norm_rms", **how: _element(v, operation, **how))
_value_node("vector_preemphasis", "pe", vectors.preemphasised)
_value_node("window", "win", lambda v, name="hann", size=0, **how: vectors.windowed(v, name, size, **how))
_value_node("entropy", "entropy", vectors.entropy)
_value_node("histogram", "hist", vectors.histogram)
_value_node("acf", "acf", vectors.autocorrelation)
_value_node("amdf", "amdf", vectors.amdf)
_set_node("energy", vectors.energy)
_set_node("intensity", lambda v, size: vectors.intensity(v, size))
_set_node("crossings", vectors.crossing_rates)
_value_node("fft", "fft", spectral.fft)
_value_node("phase", "phase", spectral.phase)
_value_node("power_db", "db", spectral.power_db)
_value_node("scaled_spectrum", "scaled", spectral.scaled_spectrum)
_value_node("spectrum_acf", "acf", spectral.spectrum_acf)
_value_node("cepstrum", "cep", spectral.cepstrum)
_value_node("mfcc", "mfcc", spectral.mfcc)
_value_node("plp", "plp", spectral.plp)
_value_node("notes", "notes", lambda v, bins, rate, octaves=6, first=55.0, form="gauss": spectral.apply_matrix(v, spectral.tonespec(bins, rate, octaves, first, form)))
_value_node("chroma", "chroma", spectral.chroma)
_value_node("a_weight", "dba", spectral.a_weighted)
_value_node("harmonic_product", "hps", spectral.harmonic_product)
_value_node("axis", "axis", spectral.resampled_axis)
_value_node("resample", "rs", spectral.resampled)


@operator("magnitude")
def magnitude(df: DataFrame, keys, fields=None, rate: float | None = None, size: int | None = None) -> DataFrame:
    """Magnitudes of the fields; with the frames' rate and size, on an axis of frequencies."""
    out = _mapped(df, keys, fields, lambda f: spectral.magnitude(f), "mag")
    if rate and size:
        points = 1 << (size - 1).bit_length()
        for f in _fields(df, keys, fields):
            out = described(out, f"{f}_mag", axis=[rate * k / points for k in range(points // 2 + 1)])
    return out


@operator("bands")
def bands(df: DataFrame, keys, fields=None, bins: int | None = None, rate: float | None = None, count: int = 26, low: float = 20.0, high: float = 8000.0, scale: str = "mel", width: str | float | None = None) -> DataFrame:
    """Triangular bands of spectra; bins and rate are taken from the field's axis where they are not given. The bands' axis is their centres."""
    out = df.select(*_lead(df, keys))
    cols = []
    for f in _fields(df, keys, fields):
        axis = axis_of(df, f)
        if (bins is None or rate is None) and not axis:
            raise ValueError(f"{f} has no axis, so bins and rate are needed")
        n, r = bins or len(axis), rate or 2 * axis[-1]
        cols.append(spectral.apply_matrix(F.col(f), spectral.filterbank(n, r, count, low, high, scale, width)).alias(f"{f}_bands", metadata={"axis": spectral.centres(count, low, high, scale, width)}))
    return df.select(*out.columns, *cols)


@operator("scaled_axis")
def scaled_axis(df: DataFrame, keys, fields=None, **how) -> DataFrame:
    """Spectra on another axis; bins and rate are those of the field's axis."""
    cols = []
    for f in _fields(df, keys, fields):
        axis = axis_of(df, f)
        if not axis:
            raise ValueError(f"{f} has no axis")
        cols.append(spectral.scaled_axis(F.col(f), len(axis), 2 * axis[-1], **how).alias(f"{f}_axis"))
    return df.select(*_lead(df, keys), *cols)


@operator("spectral")
def spectral_node(df: DataFrame, keys, fields=None, only=None, freqs=None, **how) -> DataFrame:
    """Descriptors of spectra; freqs is the field's axis where it is not given."""
    out = []
    for f in _fields(df, keys, fields):
        at = freqs or axis_of(df, f)
        if not at:
            raise ValueError(f"{f} has no axis, so freqs are needed")
        out += [c.alias(f"{f}_{k}") for k, c in spectral.descriptors(F.col(f), list(at), **how).items() if not only or k in only]
    return df.select(*_lead(df, keys), *out)


@operator("svm_file")
def svm_file(df: DataFrame, keys, text: str, probabilities: bool = False) -> DataFrame:
    """The class of a text model of pairs, whose features are found by name among fields and elements."""
    out = models.pairs_class(df, models.parse_pairs(text), probabilities)
    return out.select(*_lead(df, keys), *[c for c in out.columns if c not in df.columns])


@operator("binary")
def binary(df: DataFrame, keys, operation: str, fields, into: str) -> DataFrame:
    return df.select(*_lead(df, keys), vectors.binary(operation, *map(F.col, fields)).alias(into))


@operator("flux")
def flux(df: DataFrame, keys, field: str) -> DataFrame:
    was = F.lag(field).over(of_level(*keys).ordered())
    return df.withColumn("_was", was).select(*_lead(df, keys), spectral.flux(F.col(field), F.col("_was")).alias(f"{field}_flux"))


@operator("cens")
def cens(df: DataFrame, keys, field: str, width: int = 41, every: int = 10) -> DataFrame:
    return windows.cens(of_level(*keys), df, field, width, every)


def _frame_node(name: str, suffix: str, make, kind: str = "array<double>"):
    def node(df: DataFrame, keys, fields=None, **how) -> DataFrame:
        return _mapped(df, keys, fields, lambda f: kernels.on_frames(lambda v: make(v, **how), kind)(F.col(f)), suffix)

    operator(name)(node)


_frame_node("lpc", "lpc", lambda v, order=8, method="acf": np.asarray((kernels.lpc if method == "acf" else kernels.lpc_burg)(v, order)[0]).tolist())
_frame_node("lsp", "lsp", lambda v, order=8: kernels.lsp(kernels.lpc(v, order)[0]).tolist())
_frame_node("formants", "formants", lambda v, rate, order=8: kernels.formants(kernels.lpc(v, order)[0], rate)[0].tolist())
_frame_node("pitch", "pitch", lambda v, rate, **how: list(kernels.pitch_acf(v, rate, **how)))
_frame_node("pitch_shs", "shs", lambda m, rate, **how: [x for c in kernels.pitch_shs(m, rate, **how) for x in c])


# Models.
@operator("svm")
def svm(df: DataFrame, keys, field: str, pairs) -> DataFrame:
    return df.select(*_lead(df, keys), models.svm_vote(F.col(field), [tuple(p) for p in pairs]).alias("class"))


# Ends of a pipeline.
@operator("read_csv")
def read_csv(spark_of: DataFrame, path: str, **how) -> DataFrame:
    return files.read_csv(spark_of.sparkSession, path, **how)


@operator("write_csv")
def write_csv(df: DataFrame, path: str, instance: str | None = None, **how) -> DataFrame:
    files.write_csv(df, path, instance, **how)
    return df


@operator("write_arff")
def write_arff(df: DataFrame, path: str, **how) -> DataFrame:
    files.write_arff(df, path, **how)
    return df


