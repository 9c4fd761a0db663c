"""What the corpus operators share: the shared folder, written tables, batches."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Texts average kilobytes, so the engine's 10,000 rows
#: would be tens of megabytes, and far more where long texts stand together.
BATCH_ROWS = 400
#: What tasks keep in their Python worker for later tasks of the same operator.
KEPT: dict = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def give_back() -> None:
    """Return this worker's free memory to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def let_go() -> None:
    """Drop what other operators' tasks keep in this worker, which outlives stages."""
    if KEPT:
        KEPT.clear()
        gc.collect()
        give_back()


def frugal(run):
    """run(batches) as the function of a task that begins without others' leavings and leaves no free memory held."""

    def task(batches):
        let_go()
        yield from run(batches)
        give_back()

    return task


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of its own only where unset, on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="wavelathe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/wavelathe/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later steps start from files."""
    spark = df.sparkSession
    path = table_path(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.wavelathe_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.wavelathe_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of jobs that are done: it does so for what the driver's collector finds unused."""
    spark._jvm.java.lang.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(docs: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Blocks for work over the texts of docs: one for each shuffle partition, or more where the texts are larger than that.

    The planner's estimate is taken where docs come from files; where it has none, or multiplies tables, the texts are measured.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:
        size = docs.agg(F.sum(F.octet_length(text_of(docs)))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), min(size // bytes_each, 1 << 17))


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df marked for broadcast if it has few rows, else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextmanager
def no_collector():
    """No cycle collector while very many small objects are made that form no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(df[column], F.lit(""))


def columns_of(df: DataFrame) -> list[Column]:
    """df's columns, whatever characters are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (the splitmix64 one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def groups_of_bytes(texts, most: int = 1 << 20):
    """Yield (first index, encoded texts) so that a group holds about `most` bytes, or one text."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def even_labels(spark: SparkSession, n: int) -> list[int]:
    """n longs, one for each of n hash partitions: a table keyed by them is dealt evenly."""
    rows = (
        spark.range(24 * n + 64)
        .groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p"))
        .agg(F.min("id").alias("label"))
        .collect()
    )
    found = {r["p"]: r["label"] for r in rows}
    spare = iter(range(24 * n + 64, 26 * n + 64))
    return [found[p] if p in found else next(spare) for p in range(n)]


def spread_join(rows: DataFrame, facts: DataFrame, on: str, by: str, parts: int = 32, *also: str, how: str = "inner") -> DataFrame:
    """rows with the facts (one row a key) of their key `on`, inner or left, where a key may be that of very many rows.

    A key's rows are dealt into parts by their columns `by` and `also`, and the
    key's facts go to each part that there is: as many copies as parts at most.
    """
    part = F.pmod(F.xxhash64(by, *also), F.lit(parts)).alias("__wl_part")
    dealt = rows.select("*", part)
    there = dealt.select(on, "__wl_part").distinct().join(facts, on)
    return dealt.join(there, [on, "__wl_part"], how).drop("__wl_part")


def numbered(df: DataFrame, order: list[Column], name: str, label: str = "order") -> DataFrame:
    """df (a written table, as it is read twice) with each row's place, from 1, in the order.

    Rows are sorted in ranges, and the counts of the ranges before a row's own
    are added to its place there: no task sorts more than a range. Rows that the
    order leaves equal stand as they are stored, so they too part into ranges.
    """
    spark = df.sparkSession
    keys = [*order, F.asc("__wl_at")]
    ranges = df.withColumn("__wl_at", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    # Its upper 31 bits are the range's number, its lower 33 the place in it.
    rows = written(ranges.withColumn("__wl_at", F.monotonically_increasing_id()), label)
    number = F.shiftright("__wl_at", 33)
    sizes = rows.groupBy(number.alias("__wl_range")).agg(F.count(F.lit(1)).alias("__wl_n"))
    before = F.coalesce(F.sum("__wl_n").over(Window.orderBy("__wl_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__wl_range", before.alias("__wl_before")))  # one row a range
    placed = rows.withColumn("__wl_range", number).join(starts, "__wl_range")
    place = F.col("__wl_before") + F.col("__wl_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn(name, place).drop("__wl_range", "__wl_before", "__wl_at")


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node.

    Alternates the large-star and small-star steps until nothing changes, each
    step from a written table, so the lineage stays short and a lost executor
    costs one step. Nodes without an edge to another node are not listed.
    """
    spark = edges.sparkSession

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    now = written(edges.select("a", "b").where("a <> b").distinct(), label)
    seen = mark(now)
    while seen[0]:
        two = both(now)
        least = two.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = spread_join(two.where("b > a"), least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(down, least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        new = written(small, label)
        drop(now)
        now, was, seen = new, seen, mark(new)
        if was == seen:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b").distinct().toDF("node", "root"))
