"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Built-in functions only. A first scan writes the two cheap keys of every row
(length and prefix hash of the normalised text). Lengths that occur once settle
their rows; of the others, prefixes that occur once within their length do. A
second scan computes the full SHA-256 only for rows that neither level settled.

What a level leaves open is carried to the scan as a bit table of bounded size
(see ``slots``), so texts are never shuffled. Two keys in one slot only send more
rows on to the next level; the full hash decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, normalised, whole_row, written
from .slots import marked, open_slots, slot, slot_bits

PREFIX_CHARS = 64


def _keyed(df: DataFrame, text: str) -> DataFrame:
    norm = df.withColumn("_norm", normalised(text))
    return norm.withColumn("_len", F.length("_norm").cast("long")).withColumn("_prefix", F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS)))


def refined(df: DataFrame, row_id: str, text: str) -> tuple[DataFrame, list[DataFrame]]:
    """Per row of ``df``, and the tables that this reads: ``_id``, ``_row`` (all its columns), ``_norm``, ``_len``, ``_prefix`` and ``_full``.

    ``_full`` is the SHA-256 of the normalised text where length and prefix left the
    row open, null where they already show that no other row has its text.
    """
    keys = written(_keyed(df.select(F.col(f"`{text}`").alias("_text")), "_text").select("_len", "_prefix"))
    bits = slot_bits(keys.count())
    length_slots, prefix_slots = slot(bits, F.col("_len")), slot(bits, F.col("_len"), F.col("_prefix"))
    by_length = written(open_slots(keys, length_slots, "lengths"))
    left = marked(keys, length_slots, by_length, "lengths").where("lengths")
    by_prefix = written(open_slots(left, prefix_slots, "prefixes"))
    drop(keys)
    rows = df.select(F.col(f"`{row_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"), whole_row(df))
    rows = marked(_keyed(rows, "_text"), length_slots, by_length, "lengths")
    rows = marked(rows, prefix_slots, by_prefix, "prefixes")
    rows = rows.withColumn("_full", F.when(F.col("lengths") & F.col("prefixes"), F.sha2(F.col("_norm"), 256))).drop("lengths", "prefixes", "_text")
    return rows, [by_length, by_prefix]


def _first(*more: str) -> Column:
    """The group's smallest id; a null id comes after all others."""
    return F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), *more)).alias("_first")


def exact_duplicates(df: DataFrame, row_id: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``df``: the id, ``keep_id``, ``group_size``, ``kept`` and the ``carry`` columns.

    ``carry`` names expressions over ``_norm``, the normalised text. Of equal texts
    the row with the smallest id stays. Null texts are empty texts and equal to each
    other; a null id sorts after all others; of rows with one id and one text exactly
    one stays. An empty table gives no rows. Only the id and the text are read, so
    further columns of any name do no harm.

    Groups are keyed by all three levels and joined on the full hash alone: both
    sides get an exchange of their own, which lets Spark split a hot group.
    """
    carry = carry or {}
    rows, tables = refined(df.select(F.col(f"`{row_id}`"), F.col(f"`{text}`")), row_id, text)
    rows = rows.select("_id", "_len", "_prefix", "_full", *[e.alias(n) for n, e in carry.items()])
    rows = written(rows.withColumn("_uid", F.monotonically_increasing_id()))
    drop(*tables)
    several = rows.where("_full is not null")
    groups = several.groupBy("_len", "_prefix", "_full").agg(_first("_uid"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(F.col("_full").alias("_group"), F.col("_first.id").alias("keep_id"), F.col("_first._uid").alias("_keep_uid"), "group_size")
    own = F.col("_id").alias(row_id)
    several = several.join(groups, F.col("_full") == F.col("_group")).select(own, "keep_id", "group_size", (F.col("_uid") == F.col("_keep_uid")).alias("kept"), *carry)
    single = rows.where("_full is null").select(own, F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *carry)
    return single.unionByName(several)


def drop_exact_duplicates(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, less those whose text an earlier id already has.

    Rows that length and prefix settle pass straight through. Open rows meet their
    group joined on the hash and the id that stays, which spreads a hot group.
    """
    source, _ = refined(df, row_id, text)
    several = source.where("_full is not null")
    groups = written(several.groupBy("_len", "_prefix", "_full").agg(_first()).select(F.col("_full").alias("_group"), F.col("_first.id").alias("_keep")))
    stay = several.join(groups, (F.col("_full") == F.col("_group")) & F.col("_id").eqNullSafe(F.col("_keep"))).dropDuplicates(["_full", "_id"])
    return source.where("_full is null").select("_row.*").unionAll(stay.select("_row.*"))
