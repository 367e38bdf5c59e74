"""Mixing sources to target weights by capped water-filling.

Each source's target share follows its weight. A source is clamped at
``max_epochs`` times its size and the excess is reshared by weight. With sources
in the order of cap over weight, the fixed point of that resharing is one water
level: the greatest of (total - caps before) / (weights from here on). Targets
are ``min(cap, level * weight)``.

A target is met by whole repetitions of every document and one fractional
repetition: documents in the order of a seeded hash until the source's remaining
words are used up. The document at the cut gives a part of its words, so a
source's taken words equal its rounded target.

Row work stays on two small tables: sizes per document, and sums per source and
hash bucket. Only the one bucket per source that holds the cut is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, drop, text_or_empty, whole_row, word_count, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the order hash that make a bucket: 16 ** 3 buckets a source.
BUCKET_DIGITS = 3


def _source_key(source: str) -> Column:
    """A key that is never null: null sources form one source of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), F.lit("-"))


def _order_hash(row_id: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{row_id}`").cast("string"), F.lit(""))))


def sized(df: DataFrame, row_id: str, text: str, source: str, seed: str) -> DataFrame:
    return df.select(F.col(f"`{row_id}`").alias("_id"), _source_key(source).alias("_source"), word_count(text).alias("_size"), _order_hash(row_id, seed).alias("_hash"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: ``source_size`` and ``target``. One row per source passes the windows, never rows of documents."""
    by_source = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    #: "-" (null) sorts before "=..." and must come last.
    rank = F.row_number().over(W.orderBy((F.col("_source") == "-").asc(), F.col("_source").asc())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    capped = by_source.withColumn("_weight", weight.cast("double")).withColumn("_cap", F.col("source_size").cast("double") * max_epochs)
    fill = W.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("_source").asc())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    capped = capped.withColumn("_left", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    capped = capped.withColumn("_weights", F.sum("_weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
    capped = capped.withColumn("_level", F.max(F.col("_left") / F.col("_weights")).over(everything))
    return capped.select("_source", "source_size", F.least(F.col("_cap"), F.col("_level") * F.col("_weight")).alias("target"))


def mixing_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: size, target, whole repetitions, and the place in hash order where the fractional repetition ends.

    Rows before (``_cut_hash``, ``_cut_id``, ``_cut_size``) are in the fractional
    repetition, rows equal to it give ``_cut_words`` words each, rows after it none.
    """
    targets = source_targets(sizes, weights, max_epochs)
    words = F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs)
    plan = targets.withColumn("_words", words).withColumn("_whole", F.when(F.col("source_size") > 0, F.expr("_words div source_size")).otherwise(0))
    plan = written(plan.withColumn("_rest", F.col("_words") - F.col("_whole") * F.col("source_size")).drop("_words"))

    bucket = F.substring("_hash", 1, BUCKET_DIGITS)
    sums = sizes.groupBy("_source", bucket.alias("_bucket")).agg(F.sum("_size").alias("_sum"))
    sums = sums.withColumn("_start", F.sum("_sum").over(W.partitionBy("_source").orderBy("_bucket")) - F.col("_sum"))
    #: One row per source at most; written, its size is known, and Spark broadcasts it where it is small enough.
    cut = written(sums.join(plan.select("_source", "_rest"), "_source").where("_start <= _rest and _rest < _start + _sum"))
    there = sizes.withColumn("_bucket", bucket).join(cut.select("_source", "_bucket", "_start", "_rest"), ["_source", "_bucket"])
    same = there.groupBy("_source", "_start", "_rest", "_hash", "_id", "_size").count()
    upto = F.sum(F.col("_size") * F.col("count")).over(W.partitionBy("_source").orderBy("_hash", "_id", "_size"))
    same = same.withColumn("_before", F.col("_start") + upto - F.col("_size") * F.col("count"))
    ends = same.where("_before <= _rest and _rest < _before + _size * count").select(
        "_source", F.col("_hash").alias("_cut_hash"), F.col("_id").alias("_cut_id"), F.col("_size").alias("_cut_size"), F.expr("(_rest - _before) div count").alias("_cut_words"), F.col("count").alias("_cut_rows"), ((F.col("_rest") - F.col("_before")) / (F.col("count") * F.col("_size"))).alias("_cut_share")
    )
    found = written(plan.join(ends, "_source", "left").drop("_rest"))
    drop(plan, cut)
    return found


def _fraction(before: Column | int, at: Column | int) -> Column:
    """``before`` for rows that come before the cut, ``at`` for those at it, else 0."""
    row, cut = F.struct(F.col("_hash").alias("h"), F.col("_id").alias("i"), F.col("_size").alias("s")), F.struct(F.col("_cut_hash").alias("h"), F.col("_cut_id").alias("i"), F.col("_cut_size").alias("s"))
    return F.when(F.col("_cut_hash").isNull(), 0).when(row < cut, before).when(row.eqNullSafe(cut), at).otherwise(0)


def _taken() -> Column:
    """Words the mix takes of a row, from its size and its source's plan."""
    return (F.col("_whole") * F.col("_size") + _fraction(F.col("_size"), F.col("_cut_words"))).cast("long")


def mix(df: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Per row: the id, ``size``, ``source_size``, ``target`` and ``taken``, all in words.

    Null texts have no words. Null sources are one source, last in order. Sources or
    tables without words take nothing. Rows repeated with one id and one size share
    what the cut leaves them evenly. Reruns agree: the order hash has a fixed seed.
    Other columns are not read.
    """
    sizes = written(sized(df, row_id, text, source, seed))
    plan = mixing_plan(sizes, weights, max_epochs)
    return sizes.join(plan, "_source").select(F.col("_id").alias(row_id), F.col("_size").alias("size"), "source_size", "target", _taken().alias("taken"))


def materialise_mix(df: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, whole: bool = False) -> DataFrame:
    """The mix itself: the columns of ``df``, a row for each repetition.

    The row at a source's cut comes once more with its first words only, joined by
    single spaces, so the words are those of ``mix``. With ``whole`` no text is cut:
    that row comes whole if at least half of it is due, else not; of several with one
    id and size, a share by a hash of the text. Rows without words are repeated as
    the others of their source.
    """
    sizes = written(sized(df, row_id, text, source, seed))
    plan = mixing_plan(sizes, weights, max_epochs)
    row = whole_row(df)
    rows = df.select(row, F.col(f"`{row_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"), _source_key(source).alias("_source"), word_count(text).alias("_size"), _order_hash(row_id, seed).alias("_hash"))
    due = F.when(F.col("_cut_rows") == 1, F.col("_cut_share") >= 0.5).otherwise(F.pmod(F.xxhash64("_text"), F.lit(1 << 30)) < F.col("_cut_share") * (1 << 30))
    times = (F.col("_whole") + _fraction(F.lit(1), due.cast("int"))).cast("int")
    rows = rows.join(plan, "_source").withColumn("_taken", _taken()).withColumn("_times", times)
    copies = F.array_repeat("_size", F.col("_times"))
    if not whole:
        cut = F.expr("transform(sequence(1L, _taken div _size + int(_taken % _size > 0)), i -> least(_size, _taken - (i - 1) * _size))")
        copies = F.when(F.col("_size") == 0, copies).when(F.col("_taken") > 0, cut)
    rows = rows.withColumn("_words", F.explode(copies))
    first = F.array_join(F.slice(F.filter(F.split(text_or_empty("_text"), rf"{SPACE}+"), lambda w: w != ""), 1, F.col("_words").cast("int")), " ")
    part = F.col("_words") < F.col("_size")
    out = {text: F.when(part, first).otherwise(F.col("_text"))}
    if "n_chars" in df.columns:
        out["n_chars"] = F.when(part, F.length(first).cast("long")).otherwise(F.col("_row.n_chars"))
    return rows.select(*[out.get(c, F.col(f"_row.`{c}`")).alias(c) for c in df.columns])
