"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Shards have virtual nodes on a ring of RING points. A document's point is a hash of its text, so equal texts lie at one
point, and its arc is the one that ends with the next virtual node clockwise. Each shard has a capacity. In the first
round a shard takes documents of its own arcs; what finds it full continues clockwise to the next virtual node, round
by round, until it finds room. Capacities add up to at least the number of documents, so all are placed and none is
exceeded.

On one arc documents are ordered by point and a hash of the whole row, and a shard takes the first of those that
arrive. So what goes where is told by ranks alone: the course of the rounds needs no more than a count of each arc
(`shards * vnodes` numbers, whatever the size of the data), and its outcome is a list of at most
`shards * vnodes + shards` intervals of ranks. Ranks are sums of counts over points, parts of points and distinct rows;
no task orders a whole point, so a text that a third of all documents share costs no more than others do.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenewright.llm.common import documents, stored

#: Points of the ring; virtual nodes of a shard; shards.
RING, VNODES, SHARDS = 1 << 20, 64, 24
#: Bits of a row's hash by which the rows of a point are dealt out.
PART_BITS = 10


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(point, shard) of every virtual node, clockwise. A further shard adds nodes and moves none."""
    at = lambda s, v: int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:5], 16)
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def point_of(text: Column) -> Column:
    """A text's point on the ring: 20 bits of its MD5."""
    return F.conv(F.substring(F.md5(text), 1, 5), 16, 10).cast("int")


def arc_of(point: Column, nodes: list[tuple[int, int]]) -> Column:
    """The number of the first virtual node at or after a point, found by halving; behind the last comes the first."""
    points = [p for p, _ in nodes]
    bounds = F.split(F.lit(",".join(map(str, points))), ",").cast("array<int>")  # a constant when the plan is made
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(points).bit_length()))])
    before = F.aggregate(steps, F.lit(0), lambda low, s: F.when(F.get(bounds, low + s - 1) < point, low + s).otherwise(low))
    return F.when(before == len(points), 0).otherwise(before)


def arc_at(point: int, nodes: list[tuple[int, int]]) -> int:
    return bisect.bisect_left([p for p, _ in nodes], point) % len(nodes)


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may hold: without slack counts at most one apart, otherwise 1 + slack times the mean, rounded up."""
    if slack:
        return [-int(-rows * (1 + slack) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def overflow(loads: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank after the last, shard, first slot) of what each shard takes of each arc.

    In round k the rest of every arc, in the order of the ring, asks the shard of the k-th node clockwise. Each
    interval uses up an arc or a shard's room, so there are no more than arcs and shards together.
    """
    room, found = list(room), []
    held, rest = [0] * len(room), {a: (0, n) for a, n in sorted(loads.items()) if n}
    for k in range(len(nodes)):
        for a, (start, end) in list(rest.items()):
            s = nodes[(a + k) % len(nodes)][1]
            if take := min(end - start, room[s]):
                found.append((a, start, start + take, s, held[s]))
                room[s] -= take
                held[s] += take
                rest[a] = (start + take, end)
                if start + take == end:
                    del rest[a]
        if not rest:
            break
    return found


def shard_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    vnodes: int = VNODES,
    slack: float = 0.0,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32, shard, slot and the columns keep of every row.

    slot counts a shard's rows from 0 without gaps. Without slack the shards' counts are at most one apart; with it
    none exceeds 1 + slack times the mean, and fewer rows move when a shard is added. Rows of equal texts share a
    shard unless one fills up within them. A null text counts as an empty one; null and repeated ids are rows as
    any other. The result depends on the rows alone: only rows equal in doc_id, text and keep, which nothing tells
    apart, are numbered as they happen to lie. Texts are read once and go no further, unless keep names them.
    keep columns are hashed, so none may be a map; a name in keep that clashes with a column above is an error of
    Spark's. More shards than documents: some are empty. No documents: no rows.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    of_id = F.col(f"`{doc_id}`").cast("long")
    kept = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(
        of_id.alias("doc_id"),
        (F.octet_length(whole) + 8).cast("long").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        point_of(whole).alias("_sh_point"),
        F.xxhash64(of_id.isNull(), of_id, whole, *[x for c in kept for x in (c.isNull(), c)]).alias("_sh_row"),
        F.spark_partition_id().alias("_sh_task"),
        *kept,
    )
    rows = stored(rows, "shard-rows")
    nodes = ring(shards, vnodes)
    part = F.shiftrightunsigned("_sh_row", 64 - PART_BITS).alias("_sh_part")
    same = ["_sh_point", "_sh_row", "_sh_task"]
    groups = stored(rows.groupBy(*same).agg(F.count("*").alias("n")).withColumn("_sh_part", part), "shard-groups")  # equal rows of a task
    before = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = groups.groupBy("_sh_point", "_sh_part").agg(F.sum("n").alias("n"))
    points = parts.groupBy("_sh_point").agg(F.sum("n").alias("n")).withColumn("_sh_arc", arc_of(F.col("_sh_point"), nodes))
    points = stored(points.withColumn("point_start", before(Window.partitionBy("_sh_arc").orderBy("_sh_point"))), "shard-points")
    loads = {r["_sh_arc"]: r["n"] for r in points.groupBy("_sh_arc").agg(F.sum("n").alias("n")).collect()}  # a row for each arc
    placed = overflow(loads, nodes, capacities(sum(loads.values()), shards, slack))
    spark = docs.sparkSession
    intervals = spark.createDataFrame(placed, "_sh_of int, _sh_from long, _sh_to long, shard int, _sh_slot long")
    parts = parts.withColumn("part_start", before(Window.partitionBy("_sh_point").orderBy("_sh_part"))).drop("n")
    starts = parts.join(points.drop("n"), "_sh_point").select("_sh_point", "_sh_part", "_sh_arc", (F.col("point_start") + F.col("part_start")).alias("_sh_start"))
    groups = groups.withColumn("in_part", before(Window.partitionBy("_sh_point", "_sh_part").orderBy("_sh_row", "_sh_task")))
    groups = groups.join(starts, ["_sh_point", "_sh_part"]).select(*same, "_sh_arc", (F.col("_sh_start") + F.col("in_part")).alias("_sh_start"))
    own = F.row_number().over(Window.partitionBy(*same).orderBy("_sh_row")) - 1  # equal rows of one task
    ranked = rows.withColumn("_sh_own", own).join(groups, same).withColumn("_sh_rank", F.col("_sh_start") + F.col("_sh_own"))
    at = (F.col("_sh_arc") == F.col("_sh_of")) & (F.col("_sh_rank") >= F.col("_sh_from")) & (F.col("_sh_rank") < F.col("_sh_to"))
    met = ranked.join(F.broadcast(intervals), at)  # shards * vnodes + shards rows at most
    slot = F.col("_sh_slot") + F.col("_sh_rank") - F.col("_sh_from")
    return met.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"), *kept)


def write_shards(placed: DataFrame, path: str, shards: int = SHARDS, rows: int = 1 << 20) -> None:
    """Write what shard_documents() gave, a folder for each shard, its rows in the order of their slots, so many to a file."""
    of = placed.agg(F.max("slot")).first()[0]
    files = 1 if of is None else of // rows + 1
    at = (F.col("shard") * files + F.floor(F.col("slot") / rows)).cast("int")
    placed.repartitionById(shards * files, at).sortWithinPartitions("slot").write.partitionBy("shard").parquet(path)


def op12_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
