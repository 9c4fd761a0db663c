"""What a field's elements are called, and where they lie on a frequency axis, kept in the schema with the field."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

KEPT = ("names", "axis")


def described(df: DataFrame, field: str, names: Sequence[str] | None = None, axis: Sequence[float] | None = None) -> DataFrame:
    """df with names of the field's elements, or their frequencies, beside what is known of it."""
    more = ({"names": list(names)} if names is not None else {}) | ({"axis": [float(f) for f in axis]} if axis is not None else {})
    return df.withColumn(field, F.col(field).alias(field, metadata={**df.schema[field].metadata, **more}))


def names_of(df: DataFrame, field: str) -> list[str] | None:
    return df.schema[field].metadata.get("names")


def axis_of(df: DataFrame, field: str) -> list[float] | None:
    return df.schema[field].metadata.get("axis")


def carried(df: DataFrame, *levels: DataFrame) -> DataFrame:
    """df whose array fields have what is known of the fields of the levels that they came from: those of the same name, or of the longest name that theirs goes on from by `_`."""
    known = {f.name: {k: v for k, v in f.metadata.items() if k in KEPT} for level in levels for f in level.schema if isinstance(f.dataType, ArrayType)}
    for f in df.schema:
        if isinstance(f.dataType, ArrayType) and not any(k in f.metadata for k in KEPT):
            from_ = max((n for n in known if f.name == n or f.name.startswith(n + "_")), key=len, default=None)
            if from_ and known[from_]:
                df = described(df, f.name, **known[from_])
    return df


def element(df: DataFrame, name: str) -> Column:
    """The value of that name: a field of one number, an element that an array field's names tell, or `field[i]` (from 0)."""
    if name in df.columns and not isinstance(df.schema[name].dataType, ArrayType):
        return F.col(name).cast("double")
    for f in df.schema:
        names = f.metadata.get("names") or []
        if name in names:
            return F.get(F.col(f.name), F.lit(names.index(name))).cast("double")
    m = re.fullmatch(r"(.+)\[(\d+)\]", name)
    if m and m[1] in df.columns:
        return F.get(F.col(m[1]), F.lit(int(m[2]))).cast("double")
    raise ValueError(f"no field or element {name}")


def vector_of(df: DataFrame, names: Sequence[str]) -> Column:
    """An array of the named values, in that order."""
    return F.array(*[element(df, n) for n in names])
