"""Transforms that are learned, saved, and learned further: moments that merge, as versioned tables.

A table has keys (`by`), n, mean, m2 (sum of squared deviations), least and
largest of a value. Two tables of different rows merge into that of all rows, so
a transform can be learned in parts, in any order, and gone on with later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .blocks import Blocks, decay, scanned

MOMENTS = ["n", "mean", "m2", "least", "largest"]


def moments(df: DataFrame, by: list[str], x: str) -> DataFrame:
    v = F.col(x).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("least"), F.max(v).alias("largest"))


def merged(by: list[str], *tables: DataFrame) -> DataFrame:
    """The moments of the rows of all tables."""
    all_ = tables[0]
    for t in tables[1:]:
        all_ = all_.unionByName(t)
    w = Window.partitionBy(*by)
    middle = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    rows = all_.where(F.col("n") > 0).withColumn("_mean", middle)
    d = F.col("mean") - F.col("_mean")
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * d * d).alias("m2"), F.min("least").alias("least"), F.max("largest").alias("largest"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that were saved whole, ascending."""
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = home.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(home):
        return []
    names = [s.getPath() for s in files.listStatus(home)]
    done = [p.getName() for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in done if n.startswith("version="))


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The named or the last version; None if nothing is saved."""
    have = versions(spark, path)
    if not have:
        return None
    return spark.read.parquet(f"{path}/version={have[-1] if version is None else version}")


def save(table: DataFrame, path: str) -> int:
    """Save as the next version, and say its number."""
    have = versions(table.sparkSession, path)
    number = have[-1] + 1 if have else 0
    table.write.parquet(f"{path}/version={number}")
    return number


def learn(df: DataFrame, by: list[str], x: str, path: str) -> DataFrame:
    """Learn the rows of df on top of what is saved at path, save, and give the new version. Rows must be learned once."""
    new, old = moments(df, by, x), load(df.sparkSession, path)
    number = save(new if old is None else merged(by, old, new), path)
    return load(df.sparkSession, path, number)


def learn_stream(stream: DataFrame, by: list[str], x: str, path: str, checkpoint: str):
    """A query that learns each micro-batch; a batch that is given again after a failure is learned once, as its number is kept with the table."""

    def take(batch: DataFrame, number: int) -> None:
        old = load(batch.sparkSession, path)
        if old is not None and (old.agg(F.max("_batch")).first()[0] or 0) >= number + 1:
            return
        new = moments(batch, by, x)
        save((new if old is None else merged(by, old.drop("_batch"), new)).withColumn("_batch", F.lit(number + 1)), path)

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(take).trigger(availableNow=True).start()


def applied(df: DataFrame, table: DataFrame, by: list[str], x: str, mode: str = "mvn", floor: float = 1e-7) -> DataFrame:
    """df with x transformed by a table of moments: mvn, mean or range; rows whose keys it lacks stay as they are."""
    v, span = F.col(x), F.col("_largest") - F.col("_least")
    sd = F.sqrt(F.col("_m2") / F.when(F.col("_n") > 0, F.col("_n")))
    new = {"mvn": (v - F.col("_mean")) / F.greatest(sd, F.lit(floor)), "mean": v - F.col("_mean"), "range": F.when(span > 0, (v - F.col("_least")) / F.when(span > 0, span)).otherwise(0.0)}[mode]
    t = table.select(*by, *[F.col(c).alias(f"_{c}") for c in MOMENTS])
    return df.join(t, by, "left").withColumn(x, F.coalesce(new, v)).select(*df.columns)


def continued_mvn(df: DataFrame, b: Blocks, x: str, table: DataFrame | None, floor: float = 1e-7) -> DataFrame:
    """df with <x>_mvn: x less the mean, by the deviation, of the rows so far, those that the table has learned among them."""
    rows = b.running(df, x)
    if table is None:
        return b.running_mvn(df, x, floor)
    t = table.select(*b.keys, F.col("n").alias("_tn"), F.col("mean").alias("_tm"), F.col("m2").alias("_tq"))
    rows = rows.join(t, list(b.keys), "left").na.fill(0, ["_tn"]).na.fill(0.0, ["_tm", "_tq"])
    n, apart = F.col("_n") + F.col("_tn"), F.col("_mean") - F.col("_tm")
    mean = F.col("_tm") + apart * F.col("_n") / n
    m2 = F.col("_m2") + F.col("_tq") + apart * apart * F.col("_n") * F.col("_tn") / n
    out = (F.col(x) - mean) / F.greatest(F.sqrt(F.greatest(m2 / n, F.lit(0.0))), F.lit(floor))
    return rows.withColumn(f"{x}_mvn", out).select(*df.columns, f"{x}_mvn")


def continued_exponential_mvn(df: DataFrame, b: Blocks, x: str, table: DataFrame | None = None, alpha: float = 0.995, floor: float = 1e-7) -> tuple[DataFrame, DataFrame]:
    """df with <x>_mvn by exponential weights that go on from a table (keys, mean, square), and that table behind the last row.

    A series that the table lacks begins with its first row.
    """
    rows = df.withColumns({"_x": F.col(x).cast("double"), "_q": F.col(x).cast("double") * F.col(x)})
    if table is not None:
        rows = rows.join(table.select(*b.keys, F.col("mean").alias("_tm"), F.col("square").alias("_tq")), list(b.keys), "left")
    else:
        rows = rows.withColumns({"_tm": F.lit(None).cast("double"), "_tq": F.lit(None).cast("double")})
    rows = rows.withColumns({"_tm": F.coalesce("_tm", "_x"), "_tq": F.coalesce("_tq", "_q")})

    def fold(part):
        v = (1 - alpha) * part[["_x", "_q"]].to_numpy(float)
        return [alpha ** len(v), *decay(v, alpha, 0 * v[0])[-1]]

    def replay(part, state):
        return part.assign(_y=decay((1 - alpha) * part[["_x", "_q"]].to_numpy(float), alpha, state).tolist())

    y = scanned(rows, b, fold, lambda s, m: m[0] * s + m[1:], lambda part: part[["_tm", "_tq"]].iloc[0].to_numpy(float), replay, [*df.columns, "_x"], _y=ArrayType(DoubleType()))
    mean = F.col("_y")[0]
    sd = F.sqrt(F.greatest(F.col("_y")[1] - mean * mean, F.lit(0.0)))
    out = y.withColumn(f"{x}_mvn", (F.col("_x") - mean) / F.greatest(sd, F.lit(floor))).select(*df.columns, f"{x}_mvn")
    last = y.groupBy(*b.keys).agg(F.max_by("_y", "vidx").alias("_y")).select(*b.keys, F.col("_y")[0].alias("mean"), F.col("_y")[1].alias("square"))
    return out, last
