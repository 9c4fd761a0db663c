"""Sources and sinks: PCM waves, CSV, ARFF, HTK, libsvm, float dumps, generated signals.

Binary formats are read by Spark's binaryFile reader and parsed in Arrow
batches. Binary writers return (name, data) rows, so that a table, or a
foreach of the caller's, can hold them wherever Spark writes.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.segments import interval_join
from ..series import of_level


def decode_wave(raw: bytes, mono: bool = True) -> tuple[int, np.ndarray]:
    """(sample rate, samples in [-1, 1]; rows are channels unless mono) of RIFF PCM (8, 16, 24, 32 bits) or 32-bit float."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a RIFF wave")
    at, fmt, data = 12, None, b""
    while at + 8 <= len(raw):
        name, size = struct.unpack_from("<4sI", raw, at)
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif name == b"data":
            data = raw[at + 8 : at + 8 + size]
            break
        at += 8 + size + size % 2
    if fmt is None:
        raise ValueError("no format chunk")
    code, channels, rate, _, _, bits = fmt
    wide = bits // 8
    data = data[: len(data) // (wide * channels) * wide * channels]
    x = _samples(data, bits, code == 3).reshape(-1, channels).T
    return rate, x.mean(0) if mono else x


def _samples(data: bytes, bits: int, real: bool = False, wide: int | None = None) -> np.ndarray:
    """Little-endian samples in [-1, 1]: unsigned of 8 bits, signed of more, in `wide` bytes each (the upper ones unused), or floats of 32 or 64 bits."""
    wide = wide or bits // 8
    if real:
        return np.frombuffer(data, f"<f{wide}").astype(float)
    if bits == 8:
        return (np.frombuffer(data, np.uint8).astype(float) - 128) / 127
    b = np.frombuffer(data, np.uint8).reshape(-1, wide)[:, : bits // 8].astype(np.int64)
    v = (b << (8 * np.arange(bits // 8))).sum(1)
    return np.where(v >= 1 << (bits - 1), v - (1 << bits), v) / (2.0 ** (bits - 1) - 1)


def decode_raw(data: bytes, channels: int = 1, size: int = 2, mono: bool = True, real: bool = False, bits: int | None = None) -> np.ndarray:
    """Samples in [-1, 1] without a header, of `size` bytes each: little-endian integers (of `bits` bits, if fewer), or floats if real; rows are channels unless mono. What is left of a row at the end is dropped."""
    data = data[: len(data) // (size * channels) * size * channels]
    x = _samples(data, bits or 8 * size, real, size).reshape(-1, channels).T
    return x.mean(0) if mono else x


def encode_wave(x: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """PCM of 8, 16, 24 or 32 bits, or float of 32 (bits -32); rows of a matrix are channels."""
    x = np.ascontiguousarray(np.atleast_2d(np.asarray(x, float)).T)
    channels, wide = x.shape[1], abs(bits) // 8
    top = 127.0 if bits == 8 else 2.0 ** (abs(bits) - 1) - 1
    if bits < 0:
        pcm = x.astype("<f4").tobytes()
    else:
        v = np.clip(np.rint(x * top), -top - 1, top).astype(np.int64)
        pcm = (v + 128).astype(np.uint8).tobytes() if bits == 8 else v.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 3 if bits < 0 else 1, channels, rate, rate * wide * channels, wide * channels, abs(bits), b"data", len(pcm))
    return head + pcm


def _slice(n: int, start: int, stop: int | None, end_relative: bool) -> tuple[int, int]:
    return start, n - (stop or 0) if end_relative else n if stop is None else stop


def read_waves(
    spark: SparkSession, path: str, mono: bool = True, start: float = 0.0, stop: float = -1.0, end_relative: bool = False, start_samples: int | None = None,
    stop_samples: int | None = None, raw: dict | None = None,
) -> DataFrame:
    """file, rate, period, pcm (an array, or unless mono an array of one array a channel): the seconds, or samples, start..stop of each file.

    A negative start pads zeros on the left; a negative stop is the end; with
    end_relative stop counts back from the end. raw (rate, channels, size in
    bytes) reads files without a header.
    """

    def parse(batches):
        for pdf in batches:
            out = []
            for name, data in zip(pdf["path"], pdf["content"]):
                if raw:
                    rate, x = raw.get("rate", 16000), decode_raw(bytes(data), raw.get("channels", 1), raw.get("size", 2), mono)
                else:
                    rate, x = decode_wave(bytes(data), mono)
                x = np.atleast_2d(x)
                begin = round(start * rate) if start_samples is None else start_samples
                end = stop_samples if stop_samples is not None else None if stop < 0 else round(stop * rate)
                a, b = _slice(x.shape[1], begin, end, end_relative)
                x = np.concatenate([np.zeros((len(x), max(0, -a))), x[:, max(a, 0) : max(b, 0)]], 1)
                out.append((name, rate, 1 / rate, x[0].tolist() if mono else x.tolist()))
            yield pd.DataFrame(out, columns=["file", "rate", "period", "pcm"])

    kind = "array<double>" if mono else "array<array<double>>"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, f"file string, rate int, period double, pcm {kind}")


def decoded_audio(df: DataFrame, data: str, channels: int = 1, size: int = 2) -> DataFrame:
    """df with the bytes column as pcm, an array of mixed-down samples; streams too, so pushed audio is decoded as it comes."""

    @F.pandas_udf("array<double>")
    def run(raws: pd.Series) -> pd.Series:
        return raws.map(lambda r: None if r is None else decode_raw(bytes(r), channels, size).tolist())

    return df.withColumn("pcm", run(data))


def cut_waves(df: DataFrame, turns: DataFrame, keys: list[str], x: str, rate: int, pre: float = 0.0, post: float = 0.3, first: int = 1) -> DataFrame:
    """keys, segment, start_sec, stop_sec, data: a wave of each turn (segment, start, stop in rows) with what stands before and behind it."""
    n = [round(pre * rate), round(post * rate)]
    wide = turns.select(*keys, (F.col("segment") + first).alias("segment"), F.greatest(F.col("start") - n[0], F.lit(0)).alias("start"), (F.col("stop") + n[1]).alias("stop"))
    rows = interval_join(df.select(*keys, "vidx", x), wide, of_level(*keys), 1024)
    # A turn is one file, so its samples come together.
    cut = rows.groupBy(*keys, "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("vidx", x))), lambda r: r[x]).alias("v"), F.min("vidx").alias("a"), F.max("vidx").alias("b"))

    @F.pandas_udf("binary")
    def coded(v: pd.Series) -> pd.Series:
        return v.map(lambda a: encode_wave(np.asarray(a, float), rate))

    return cut.select(*keys, "segment", (F.col("a") / rate).alias("start_sec"), ((F.col("b") + 1) / rate).alias("stop_sec"), coded("v").alias("data"))


def decode_htk(raw: bytes) -> tuple[float, int, np.ndarray]:
    """(period in seconds, kind, frames) of an HTK parameter file (big-endian)."""
    n, period, size, kind = struct.unpack_from(">iihH", raw)
    return period * 1e-7, kind, np.frombuffer(raw, ">f4", n * (size // 4), 12).reshape(n, size // 4).astype(float)


def encode_htk(frames, period: float = 0.01, kind: int = 9) -> bytes:
    a = np.asarray(frames, ">f4")
    return struct.pack(">iihH", len(a), round(period * 1e7), a.shape[1] * 4, kind) + a.tobytes()


def read_htk(spark: SparkSession, path: str) -> DataFrame:
    """file, vidx, time, frame of each HTK file."""

    def parse(batches):
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                period, _, a = decode_htk(bytes(raw))
                yield pd.DataFrame({"file": name, "vidx": np.arange(len(a)), "time": np.arange(len(a)) * period, "frame": list(a)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, vidx long, time double, frame array<double>")


def encode_dump(frames) -> bytes:
    """Float32: the vector size, the number of vectors, the rows."""
    a = np.asarray(frames, "<f4")
    return np.array([a.shape[1], a.shape[0]], "<f4").tobytes() + a.tobytes()


def decode_dump(raw: bytes) -> np.ndarray:
    size, n = np.frombuffer(raw, "<f4", 2).astype(int)
    return np.frombuffer(raw, "<f4", size * n, 8).reshape(n, size)


def packed_files(df: DataFrame, name: str, order: str, frame: str, how: str = "htk", **options) -> DataFrame:
    """(name, data): each series' frames as one HTK, dump or wave (frames joined; rate, bits) file."""
    rate, bits = options.get("rate", 16000), options.get("bits", 16)
    make = {"htk": lambda a: encode_htk(a, options.get("period", 0.01)), "dump": encode_dump, "wave": lambda a: encode_wave(np.concatenate(a), rate, bits)}[how]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pd.DataFrame([(str(pdf[name].iloc[0]), make(np.stack(pdf[frame].to_list())))], columns=["name", "data"])

    return df.select(name, order, frame).groupBy(name).applyInPandas(run, "name string, data binary")


def read_csv(spark: SparkSession, path: str, sep: str = ";", header: bool | str = True, start: int = 0, stop: int = -1, frame_time: bool = False) -> DataFrame:
    """Numeric columns of one CSV file; header `auto` takes a first cell that is no whole number as one. Rows start..stop (inclusive, from 0; -1 the end).

    Row numbers are kept as vidx where a range or frame_time is asked for; a
    frameTime column then becomes time.
    """
    if header == "auto":
        line = spark.read.text(path).limit(1).collect()
        first = line[0]["value"].split(sep)[0].strip() if line else ""
        header = not re.fullmatch(r"[+-]?\d+", first)
    df = spark.read.csv(path, sep=sep, header=header, inferSchema=True)
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float")]
    df = df.select(*[F.col(f"`{c}`") for c in numeric])
    if frame_time or start or stop >= 0:
        # A file's rows keep their order in ids that ascend by partition; parts before a row are counted.
        rows = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
        sizes = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        base = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(sizes), F.lit(0)).alias("_base"))
        rows = rows.join(base, "_part").withColumn("vidx", F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_id", "_base")
        rows = rows.where((F.col("vidx") >= start) & (F.lit(True) if stop < 0 else F.col("vidx") <= stop))
        df = rows.withColumnRenamed("frameTime", "time") if frame_time else rows
    return df


def csv_ready(df: DataFrame, instance: str | None = None, number: bool = True, timestamp: bool = True, frame_length: float | None = None, exact: bool = False) -> DataFrame:
    """Columns in the sink's order: name, frameIndex, frameTime, frameLength, then the values; exact prints whole values without decimals and others with %e."""
    lead = [F.col(instance).alias("name")] if instance else []
    lead += [F.col("vidx").alias("frameIndex")] if number else []
    lead += [F.col("time").alias("frameTime")] if timestamp and "time" in df.columns else []
    lead += [F.lit(frame_length).alias("frameLength")] if frame_length is not None else []
    kinds = dict(df.dtypes)
    spelt = lambda c: F.when(F.col(c) == F.floor(c), F.col(c).cast("decimal(38,0)").cast("string")).otherwise(F.format_string("%e", c))
    return df.select(*lead, *[(spelt(c).alias(c) if exact and kinds[c] in ("double", "float") else F.col(c)) for c in df.columns if c not in {instance, "vidx", "time"}])


def write_csv(df: DataFrame, path: str, instance: str | None = None, sep: str = ";", append: bool = False, header: bool = True, **how) -> None:
    csv_ready(df, instance, **how).write.mode("append" if append else "errorifexists").csv(path, sep=sep, header=header)


def write_nonempty(df: DataFrame, write) -> None:
    """write(df), but an error where df has no rows."""
    if df.isEmpty():
        raise ValueError("nothing to write")
    write(df)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def arff_lines(df: DataFrame, relation: str = "features", classes: dict[str, list[str] | str] | None = None) -> tuple[list[str], DataFrame]:
    """The header's lines, and the rows as text; strings are quoted, quotes escaped, nulls are question marks.

    classes: attributes to come last, a list of nominal values or `numeric`; columns of these names hold them, and what has none is a question mark.
    """
    classes = classes or {}
    head = [f"@relation {relation}", ""]
    cols = []
    for c, t in df.dtypes:
        if c in classes:
            continue
        head.append(f"@attribute {c.replace('[', '_').replace(']', '_')} {'string' if t == 'string' else 'numeric'}")
        cols.append(F.coalesce(_quoted(F.col(f"`{c}`")) if t == "string" else F.col(f"`{c}`").cast("string"), F.lit("?")))
    for c, values in classes.items():
        head.append(f"@attribute {c} {values if isinstance(values, str) else '{' + ','.join(values) + '}'}")
        cols.append(F.coalesce(F.col(c).cast("string"), F.lit("?")) if c in df.columns else F.lit("?"))
    return [*head, "", "@data", ""], df.select(F.concat_ws(",", *cols).alias("value"))


def write_arff(df: DataFrame, path: str, relation: str = "features", classes: dict | None = None, append: bool = False) -> None:
    """A folder of text: header/ and data/; append adds to data/ alone."""
    head, rows = arff_lines(df, relation, classes)
    if not append:
        df.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{path}/header")
    rows.write.mode("append" if append else "errorifexists").text(f"{path}/data")


def read_arff(spark: SparkSession, path: str, instance: str | None = None, targets: tuple[str, ...] = (), skip_first: int = 0) -> DataFrame:
    """Numeric attributes of an ARFF file or of a written folder, after the first skip_first; instance and targets are kept as text in front.

    The header, and so the number of attributes, is taken to fit the driver. Brackets in names become underscores.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    found = lines.where("lower(ltrim(value)) like '@attribute%'").select(F.monotonically_increasing_id().alias("i"), "value").orderBy("i")
    attrs = [re.match(r"\s*@attribute\s+('(?:[^'\\]|\\.)*'|\S+)\s+(.*)", r["value"], re.IGNORECASE).groups() for r in found.collect()]
    names = [n.strip("'").replace("[", "_").replace("]", "_") for n, _ in attrs]
    kept_as_text = {*targets, *([instance] if instance else [])}
    numeric = [n for n, (_, k) in list(zip(names, attrs))[skip_first:] if k.split()[0].lower() in ("numeric", "real", "integer") and n not in kept_as_text]
    schema = ", ".join(f"`{n}` {'double' if n in numeric else 'string'}" for n in names)
    body = lines.where("value <> '' and not startswith(ltrim(value), '@') and not startswith(value, '%')")
    parsed = body.select(F.from_csv("value", schema, {"nullValue": "?", "quote": "'"}).alias("r")).select("r.*")
    return parsed.select(*[F.col(f"`{n}`") for n in [*([instance] if instance else []), *targets, *numeric]])


def libsvm_lines(df: DataFrame, label: str, features: str, time: str | None = None, targets: dict[str, int] | None = None) -> DataFrame:
    """`label 1:v 2:v ...` rows; with time, it is feature 1; targets gives class names their numbers."""
    v = F.concat(F.array(F.col(time).cast("double")), features) if time else F.col(features)
    spots = F.transform(v, lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x.cast("string")))
    name = F.col(label)
    if targets:
        name = F.element_at(F.create_map(*[F.lit(c) for pair in targets.items() for c in pair]), name)
    return df.select(F.concat_ws(" ", name.cast("string"), F.array_join(spots, " ")).alias("value"))


def text_dump(df: DataFrame, keys: list[str]) -> DataFrame:
    """A line for each row: keys, vidx and the values, by name."""
    own = [c for c in df.columns if c not in (*keys, "vidx")]
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("?"))) for c in [*keys, "vidx", *own] if c in df.columns]
    return df.select(F.concat_ws(" ", *parts).alias("value"))


def printed(df: DataFrame, keys: list[str], lines: str | None = None) -> DataFrame:
    """Long rows: keys, field, value; or, with a program's name, lines `name::field::VALUE=value`."""
    long = df.unpivot(keys, [c for c in df.columns if c not in keys], "field", "value")
    if lines is None:
        return long
    return long.select(F.concat(F.lit(f"{lines}::"), F.concat_ws("::", *[F.col(k).cast("string") for k in keys], F.col("field")), F.lit("::VALUE="), F.col("value").cast("string")).alias("value"))


def signal(spark: SparkSession, rows: int, kind: str = "sine", period: float = 0.01, frequency: float = 1.0, scale: float = 1.0, phase: float = 0.0, const: float = 0.0, seed: int = 1) -> DataFrame:
    """vidx, time, x of a generated signal: sine, rect, const or white noise."""
    t = F.col("id") * period
    turn = F.sin(2 * np.pi * (frequency * t + phase))
    x = {"sine": scale * turn, "rect": scale * F.signum(turn), "const": F.lit(const).cast("double"), "white": scale * F.randn(seed)}[kind]
    return spark.range(rows).select(F.col("id").alias("vidx"), t.alias("time"), x.alias("x"))
