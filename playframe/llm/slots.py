"""Which keys occur more than once, as a bit table sized by the number of keys.

Keys are hashed to ``2 ** bits`` slots, at least eight for each key up to
``MOST_BITS``; a slot that at least two rows share is open. The table has one long
mask for 64 slots, so its size is bounded: 2 ** 28 slots are at most 4 million rows of
16 bytes to broadcast, enough for 33 million keys. Beyond that more slots are open by
chance. A row whose slot isn't open has a key of its own; an open slot proves nothing,
it only sends the row on to the exact comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 12, 28


def slot_bits(keys: int) -> int:
    return max(LEAST_BITS, min(MOST_BITS, (8 * max(1, keys) - 1).bit_length()))


def slot(bits: int, *key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << bits))


def open_slots(rows: DataFrame, at: Column, name: str) -> DataFrame:
    """(word, mask) of the slots that at least two rows share."""
    shared = rows.groupBy(at.alias("slot")).count().where("count > 1")
    word, bit = F.shiftright("slot", 6), F.expr("shiftleft(1L, int(slot & 63L))")
    return shared.groupBy(word.alias(f"{name}_word")).agg(F.bit_or(bit).alias(f"{name}_mask"))


def marked(rows: DataFrame, at: Column, masks: DataFrame, name: str) -> DataFrame:
    """Adds a boolean column ``name``: whether the row's slot is open."""
    placed = rows.withColumn("_at", at).withColumn("_word", F.shiftright("_at", 6))
    joined = placed.join(F.broadcast(masks), F.col("_word") == F.col(f"{name}_word"), "left")
    is_open = F.expr(f"coalesce((shiftright({name}_mask, int(_at & 63L)) & 1L) = 1L, false)")
    return joined.withColumn(name, is_open).drop("_at", "_word", f"{name}_word", f"{name}_mask")
