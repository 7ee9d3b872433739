"""Sharding by longest-processing-time scheduling (operator 4).

Groups of equal texts stay together. Groups, sorted by size, go to the least
loaded shard through a heap. The rule needs the sizes alone, so the driver
gets a histogram (size, number of groups), not the groups: sizes are at most
as many as there are different ones, and all groups of one size are scheduled
in one step, which gives each shard as many of them as one by one would. A
group finds its shard by its rank among those of its size.

Ranks and slots are counted in parts of about ``PART_ROWS`` rows, and the
parts' offsets are added, so neither a common size nor a large shard is
ranked in one task.

Defined results: a null text has no bytes and belongs to no group: such rows
are placed one by one, those without an id or with the same id together;
repeated rows are equal texts and stay together; groups of one size are ranked
by their hash, and ties of load go to the shard with the lower number; a very
long text is a group like any other; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riftscan.llm.base import cut, table

SHARDS = 16
#: Rows that are numbered in one part, about.
PART_ROWS = 500_000


def deal(loads: list[int], size: int, n: int) -> list[int]:
    """How many of ``n`` groups of one size each shard gets, if each goes to the least loaded shard."""
    load = np.array(loads, dtype=object)  # whole numbers of any size

    def under(level: int) -> list[int]:
        """Groups that go to each shard while its load is below ``level``."""
        return [max(0, -(-(level - v) // size)) for v in load]

    low, high = min(loads), min(loads) + size * n + 1
    while high - low > 1:  # the highest level below which no more than n are dealt
        mid = (low + high) // 2
        low, high = (mid, high) if sum(under(mid)) <= n else (low, mid)
    counts = under(low)
    heap = [(v + size * c, k) for k, (v, c) in enumerate(zip(loads, counts))]
    heapq.heapify(heap)
    for _ in range(n - sum(counts)):  # fewer than there are shards
        v, k = heap[0]
        heapq.heapreplace(heap, (v + size, k))
        counts[k] += 1
    return counts


def schedule(histogram: list[tuple[int, int]], shards: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """(size, first rank, last rank, shard) of the stretches of groups that go together, and the shards' loads."""
    loads, out = [0] * shards, []
    for size, n in sorted(histogram, reverse=True):
        first = 0
        for k, c in enumerate(deal(loads, size, n)):
            if c:
                out.append((size, first, first + c - 1, k))
                first += c
                loads[k] += size * c
    return out, loads


def numbered(df: DataFrame, within: str, order: list[str], name: str, few: bool = False, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with ``name``: numbers from 0 without gaps in each value of ``within``.

    Rows fall into parts of about ``part_rows``, and a part's numbers start
    where those before it end. ``few``: there are few values of ``within``, and
    rows may be equal (these are spread by the task that holds them). Parts are
    kept, so that all numbers come from one division.
    """
    n_parts = df.groupBy(within).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / part_rows)).alias("n_parts"))
    if few:
        n_parts = F.broadcast(n_parts)
    else:  # a constant second key leaves this side partitioned by both, so that the join can split a hot value of the other
        n_parts = n_parts.groupBy(within, F.pmod("n_parts", F.lit(1)).alias("z")).agg(F.max("n_parts").alias("n_parts")).drop("z")
    salt = [F.spark_partition_id()] if few else []
    parted = cut(df.join(n_parts, within).withColumn("part", F.pmod(F.xxhash64(F.lit(4), *order, *salt), F.col("n_parts"))).drop("n_parts"))
    counts = parted.groupBy(within, "part").agg(F.count("*").alias("n"))
    starts = counts.select(within, "part", (F.sum("n").over(Window.partitionBy(within).orderBy("part")) - F.col("n")).alias("start"))
    if few:
        starts = F.broadcast(starts)  # one row for each ``part_rows`` rows and value
    nth = F.row_number().over(Window.partitionBy(within, "part").orderBy(*order))
    return parted.withColumn("nth", nth).join(starts, [within, "part"]).withColumn(name, (F.col("start") + F.col("nth") - 1).cast("long")).drop("part", "nth", "start")


def shard_documents(docs: DataFrame, shards: int = SHARDS, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) of every row."""
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.unhex(F.coalesce(F.md5(text), F.md5(F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))).alias("group_key"),
    )
    groups = cut(rows.groupBy("group_key").agg(F.sum("size").alias("group_size")))
    histogram = [(r["group_size"], r["n"]) for r in groups.groupBy("group_size").agg(F.count("*").alias("n")).collect()]
    dealt, _ = schedule(histogram, shards)
    plan = docs.sparkSession.createDataFrame(dealt, "group_size bigint, first bigint, last bigint, shard int")  # at most ``shards`` rows for each size
    ranked = numbered(groups, "group_size", ["group_key"], "rank", part_rows=part_rows)
    placed = ranked.join(plan, "group_size").where("rank between first and last").select("group_key", "shard")
    # The pmod keeps the groups' partitioning from being known, so that the join shuffles them anew and can split a hot group's rows.
    placed_rows = rows.join(placed.groupBy("group_key", F.pmod("shard", F.lit(1)).alias("z")).agg(F.max("shard").alias("shard")).drop("z"), "group_key").select("doc_id", "size", "text_crc32", "shard")
    return numbered(placed_rows, "shard", ["doc_id", "text_crc32"], "slot", True, part_rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
