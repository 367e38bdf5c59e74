"""Sharding by longest-processing-time scheduling: the largest group goes to the least-loaded shard.

Rows with equal texts form a group and stay together. Groups of one size are
interchangeable, so the schedule runs over (size, number of groups of that size) on
the driver: every group is scheduled as if taken from the heap one by one. Sizes that
differ add up to no more than all bytes, so there are at most sqrt(2 * bytes) of
them, and in practice no more than a text can be long.

Rows find their shard without a shuffle of texts. Groups are numbered within their
size, rows within their shard: counted per hash part, and numbered within the part.
"""

from __future__ import annotations

import heapq
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, written

SHARDS = 24
ROW_BYTES = 8
#: Rows of one shard, or groups of one size, that one task numbers, about.
PART_ROWS = 50_000


def equal_items(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of one size each shard gets from the heap, found without taking them one by one.

    The k-th item of a shard starts at the shard's load + k * size. The heap takes the
    items in the order of these starts, then of shards, so it takes the ``count``
    smallest: all below a level found by bisection, and those at it in order of shards.
    """

    def below(level: int) -> list[int]:
        return [max(0, -(-(level - load) // size)) for load in loads]

    low, high = min(loads), max(loads) + size * (count + 1)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(below(mid)) <= count else (low, mid)
    given = below(low)
    left = count - sum(given)
    for shard, load in enumerate(loads):
        if left and load + given[shard] * size == low:
            given[shard] += 1
            left -= 1
    return given


def scheduled(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """Per run (size, number of groups of that size), from large to small: the size and how many of its groups each shard gets."""
    loads, out = [0] * shards, []
    for size, count in runs:
        if count < shards:
            given = [0] * shards
            heap = [(load, s) for s, load in enumerate(loads)]
            heapq.heapify(heap)
            for _ in range(count):
                load, shard = heap[0]
                given[shard] += 1
                heapq.heapreplace(heap, (load + size, shard))
        else:
            given = equal_items(loads, size, count)
        loads = [load + n * size for load, n in zip(loads, given, strict=True)]
        out.append((size, given))
    return out


def _plan(runs: DataFrame, shards: int) -> DataFrame:
    """runs (``_bytes``, ``_count``) to (``_bytes``, ``_ends``): shard s gets the groups of that size numbered from _ends[s - 1] up to _ends[s]."""
    local = runs.orderBy(F.desc("_bytes")).toPandas()
    plan = scheduled(list(zip(local["_bytes"].tolist(), local["_count"].tolist(), strict=True)), shards)
    table = pa.table({"_bytes": pa.array([b for b, _ in plan], pa.int64()), "_ends": pa.array([list(itertools.accumulate(g)) for _, g in plan], pa.list_(pa.int64()))})
    return runs.sparkSession.createDataFrame(table)


def _numbered(rows: DataFrame, keys: list[str], part: Column, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: gapless numbers from 0 within ``keys``. Rows are numbered within parts, after the counts of the parts before."""
    rows = rows.withColumn("_part", part)
    before = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_in"))
    before = before.withColumn("_before", F.sum("_in").over(W.partitionBy(*keys).orderBy("_part")) - F.col("_in")).drop("_in")
    own = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order)) - 1
    return rows.withColumn("_own", own).join(before, [*keys, "_part"]).withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_before")


def shard_by_bytes(df: DataFrame, row_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per row of ``df``: the id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (null: the law isn't ``key``).

    Size is the text's UTF-8 bytes plus ``ROW_BYTES``. A null text has no bytes and
    is in one group with empty texts. Rows repeated whole get a slot each. An empty
    table gives no rows. Within a shard, slots follow hash part, id, size and CRC.
    Null ids are ids like others. Other columns, whatever their names, are not read.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(
        F.col(f"`{row_id}`").alias("_id"),
        (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("_group"),
    )
    rows = written(rows)
    groups = written(rows.groupBy("_group").agg(F.sum("size").alias("_bytes")))
    runs = written(groups.groupBy("_bytes").agg(F.count(F.lit(1)).alias("_count")))
    plan = _plan(runs, shards)
    drop(runs)
    spread = max(1, -(-groups.count() // PART_ROWS))
    placed = _numbered(groups, ["_bytes"], F.pmod(F.xxhash64("_group"), F.lit(spread)), ["_group"], "_at").join(plan, "_bytes")
    placed = written(placed.select(F.col("_group").alias("_of"), F.size(F.filter("_ends", lambda e: e <= F.col("_at"))).alias("shard")))
    drop(groups)
    found = rows.join(placed, F.col("_group") == F.col("_of")).select("_id", "size", "text_crc32", "shard")

    count = rows.count()
    parts = max(1, -(-count // (shards * PART_ROWS)), 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    out = _numbered(found, ["shard"], F.pmod(F.xxhash64("_id", "text_crc32", "size"), F.lit(parts)), ["_id", "size", "text_crc32"], "slot")
    return out.select(F.col("_id").alias(row_id), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
