"""Scalar functions: frequency scales, psychoacoustic weights, small helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name: (forward, inverse); f in Hz.
SCALES = {
    "linear": (lambda f: f, lambda z: z),
    "log": (lambda f: F.log2(f), lambda z: F.pow(F.lit(2.0), z)),
    "semitone": (lambda f: 12 * F.log2(f / 27.5), lambda z: 27.5 * F.pow(F.lit(2.0), z / 12)),
    "mel": (lambda f: 1127 * F.ln(1 + f / 700), lambda z: 700 * (F.exp(z / 1127) - 1)),
    "bark": (lambda f: 26.81 / (1 + 1960 / f) - 0.53, lambda z: 1960 / (26.81 / (z + 0.53) - 1)),
    "bark_speex": (lambda f: 13.1 * F.atan(0.00074 * f) + 2.24 * F.atan(f * f * 1.85e-8) + 1e-4 * f, None),
    "bark_schroed": (lambda f: 6 * F.ln(f / 600 + F.sqrt(f * f / 360000 + 1)), lambda z: 600 * F.sinh(z / 6)),
}


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def erb(f: Column) -> Column:
    return 24.7 * (1 + 4.37 * f / 1000)


def equal_loudness(f: Column) -> Column:
    s = f * f
    return (s + 56.8e6) * s * s / ((s + 6.3e6) * (s + 6.3e6) * (s + 0.38e9))


def a_weight_db(f: Column) -> Column:
    s = f * f
    r = 12194.0**2 * s * s / ((s + 20.6**2) * F.sqrt((s + 107.7**2) * (s + 737.9**2)) * (s + 12194.0**2))
    return 20 * F.log10(r) + 2.0


def amplitude_db(x: Column) -> Column:
    return 20 * F.log10(x)


def round_pow2(n: int, how: str = "nearest") -> int:
    e = math.log2(n)
    return 2 ** {"up": math.ceil, "down": math.floor, "nearest": round}[how](e)


def parabola_vertex(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Place (from the middle point) and height of the top of the parabola through three neighbours."""
    d = a - 2 * b + c
    at = F.when(d != 0, 0.5 * (a - c) / F.when(d != 0, d)).otherwise(0.0)
    return at, b - 0.25 * (a - c) * at
