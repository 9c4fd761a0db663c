"""Sharding by balanced label propagation, in DataFrame functions alone.

Documents are linked through hubs, here equal texts. Each starts in a shard
given by its id's hash. A round moves every hub's documents towards the shard
where most of them are, as far as that shard's quota allows: room is shared
among those who want to come, whole hubs where they are small, and parts of a
hub where it is larger than the room. State is one row per hub and shard, so a
hub of a third of all rows costs no more than another. Then rows without links,
and any above a shard's quota, fill all shards to the row, so that counts are
at most one apart (the law `rows`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop, even_labels, shuffle_partitions, written


def _before(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of value over the rows before it, by `by` in the order of `order`."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def _ranked(rows: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """rows (with a column salt) numbered from 0 within `by`, without a task holding all of a group.

    Rows are numbered within (by, salt); the salts of a group, as many as there
    are partitions, are counted and summed up first.
    """
    counts = rows.groupBy(*by, "salt").agg(F.count(F.lit(1)).alias("_n"))
    starts = _before(counts, by, ["salt"], "_n", "_start").drop("_n")
    inner = F.row_number().over(Window.partitionBy(*by, "salt").orderBy(*order)) - 1
    return rows.withColumn("_inner", inner).join(starts, [*by, "salt"]).withColumn(out, F.col("_start") + F.col("_inner")).drop("_start", "_inner")


def _pick(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def propagate(cells: DataFrame, room: list[int], rounds: int) -> DataFrame:
    """Rounds of moves over cells (hub, shard, n); room: the rows that each shard may hold.

    Only the 8 by 8 table of wishes comes to the driver.
    """
    shards = len(room)
    for r in range(rounds):
        w = Window.partitionBy("hub")
        best = F.max_by("shard", F.struct("n", F.pmod(F.xxhash64("hub", "shard"), F.lit(1 << 30)))).over(w)
        wish = cells.withColumn("to", best)
        flows = wish.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()
        load = [sum(f["n"] for f in flows if f["shard"] == s) for s in range(shards)]
        come = [sum(f["n"] for f in flows if f["to"] == s and f["shard"] != s) for s in range(shards)]
        if not sum(come):
            break
        part = [min(1.0, max(0, room[s] - load[s]) / come[s]) if come[s] else 0.0 for s in range(shards)]
        share = _pick(F.col("to"), part)
        space = _pick(F.col("to"), [max(0, room[s] - load[s]) for s in range(shards)])
        # A hub that is small beside the space (an eighth of it) moves whole or not, by its hash; of a larger one the share moves.
        lucky = F.pmod(F.xxhash64("hub", F.lit(r)), F.lit(1_000_000)) < share * 1_000_000
        moved = F.when(F.col("shard") == F.col("to"), 0).when(8 * F.sum("n").over(w) > space, F.floor(F.col("n") * share)).otherwise(F.when(lucky, F.col("n")).otherwise(0))
        wish = wish.withColumn("go", moved.cast("long"))
        new = wish.select("hub", "shard", (F.col("n") - F.col("go")).alias("n")).union(wish.select("hub", F.col("to").alias("shard"), F.col("go").alias("n")))
        new = written(new.groupBy("hub", "shard").agg(F.sum("n").alias("n")).where("n > 0"), f"shard-cells-{r}")
        drop(cells)
        cells = new
    return cells


def shards(nodes: DataFrame, count: int = 8, rounds: int = 4) -> DataFrame:
    """nodes (node, hub, and other columns) with shard and slot.

    Nodes of one hub are linked. node may repeat; a null hub links with
    nothing. Shards hold floor or ceiling of rows / count, the larger ones
    first; slot numbers a shard's rows from 0 without gaps. All other columns
    stay, whatever their names, but ones named shard or slot are replaced. Rows
    alike in node and hub are ordered by the hash of their other columns.
    """
    others = [c for c in nodes.columns if c not in ("node", "hub", "shard", "slot")]
    kept = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(others)]
    inside = F.struct(*kept, F.lit(0).alias("none"))
    rows = nodes.select("node", "hub", F.xxhash64(F.lit(0), *kept).alias("tie"), inside.alias("__wl_rest"))
    out = _placed(rows, count, rounds)
    return out.select("node", "hub", *[F.col(f"__wl_rest.c{i}").alias(c) for i, c in enumerate(others)], "shard", "slot")


def cut_links(placed: DataFrame, shard: str = "shard") -> tuple[int, int]:
    """Of rows (hub, shard): the links between neighbours in a hub that lie in two shards, at the least, and all links.

    A hub of n rows has n - 1 links, and one that lies in k shards has k - 1 of them cut.
    """
    hubs = placed.where("hub is not null").groupBy("hub", shard).agg(F.count(F.lit(1)).alias("n")).groupBy("hub").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    r = hubs.agg(F.sum(F.col("k") - 1).alias("cut"), F.sum(F.col("n") - 1).alias("all")).first()
    return r["cut"] or 0, r["all"] or 0


def _placed(nodes: DataFrame, count: int, rounds: int) -> DataFrame:
    """nodes (node, hub, tie, __wl_rest) with shard and slot."""
    spark = nodes.sparkSession
    salts = even_labels(spark, shuffle_partitions(spark))
    salt = _pick(F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(len(salts))).cast("int"), salts)
    hub = F.coalesce("hub", F.xxhash64("node", F.lit("alone")))
    rows = written(nodes.withColumn("hub", hub).withColumn("salt", salt), "shard-rows")
    total = rows.count()
    room = [total // count + (s < total % count) for s in range(count)]
    start = F.pmod(F.xxhash64("node"), F.lit(count)).cast("int")
    parts = rows.groupBy("hub", "salt", start.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    first = parts.groupBy("hub", "shard").agg(F.sum("n").alias("n"))
    linked = F.sum("n").over(Window.partitionBy("hub")) > 1
    cells = written(first.withColumn("linked", linked).where("linked").drop("linked"), "shard-cells")
    cells = propagate(cells, room, rounds)
    # Which rows of a hub lie in which shard: ranks in the hub, cut at the cells' ends.
    per_salt = rows.groupBy("hub", "salt").agg(F.count(F.lit(1)).alias("_n"))
    per_salt = _before(per_salt, ["hub"], ["salt"], "_n", "_start").drop("_n")
    ends = _before(cells, ["hub"], ["shard"], "n", "low").groupBy("hub").agg(F.sort_array(F.collect_list(F.struct("low", "shard"))).alias("cells"))
    per_salt = per_salt.join(ends, "hub", "left").drop("hub_")
    inner = F.row_number().over(Window.partitionBy("hub", "salt").orderBy("node", "tie")) - 1
    placed = rows.withColumn("_inner", inner).join(per_salt, ["hub", "salt"])
    rank = F.col("_start") + F.col("_inner")
    own = F.filter("cells", lambda c: c["low"] <= rank)
    placed = placed.withColumn("shard", F.when(F.col("cells").isNotNull(), F.element_at(own, -1)["shard"]))
    placed = written(placed.drop("_inner", "_start", "cells"), "shard-placed")
    # Rows above a quota join those without links; together they fill the shards.
    fixed = _ranked(placed.where("shard is not null"), ["shard"], ["hub", "node", "tie"], "slot")
    fixed = written(fixed, "shard-fixed")
    over = F.col("slot") >= _pick(F.col("shard"), room)
    held = {r["shard"]: r["n"] for r in fixed.where(~over).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    free = placed.where("shard is null").drop("shard").unionByName(fixed.where(over).drop("shard", "slot"))
    free = _ranked(free.withColumn("_all", F.lit(0)), ["_all"], ["node", "hub", "tie"], "rank")
    lows, low = [], 0
    for s in range(count):
        lows.append(low)
        low += room[s] - held.get(s, 0)
    shard = reduce(lambda c, s: F.when(F.col("rank") >= lows[s], s).otherwise(c), range(1, count), F.lit(0)).cast("int")
    free = free.withColumn("shard", shard)
    slot = F.col("rank") - _pick(F.col("shard"), lows) + _pick(F.col("shard"), [held.get(s, 0) for s in range(count)])
    free = free.withColumn("slot", slot).drop("rank", "_all")
    return fixed.where(~over).unionByName(free).drop("salt")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    raw = text.cast("binary")
    nodes = docs.select(
        F.col("doc_id").alias("node"),
        F.xxhash64(F.sha2(text, 256)).alias("hub"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
    )
    out = shards(nodes)
    return out.select(F.col("node").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
