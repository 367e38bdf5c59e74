"""Importance resampling towards a target distribution over hashed features.

A document's features are its runs of 1 to ``WIDEST`` consecutive words, repeats
counted; each falls into one of ``BUCKETS`` buckets. What a bucket gains is the log of
its share in the target over its share in the corpus. A document weighs the mean gain
of its features; seeded Gumbel noise is added and the highest scores are drawn, which
is sampling without replacement in proportion to exp(weight).

Each document's buckets are an array made and scored by higher-order functions, so
scoring moves no row. Counting sends one total for each bucket and task. The arrays are
written once, for counting and scoring both read them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop, whole_row, written

BUCKETS = 10_000
WIDEST = 2
SEED = 7
#: Per cent of the documents with at least ``LEAST_WORDS`` words that are drawn.
PERCENT, LEAST_WORDS = 25, 20
#: A word after A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def with_words(text: Column, use) -> Column:
    """``use`` of the array of a text's words; bound once, so that what ``use`` makes of it doesn't split the text again for each word."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.get(F.transform(F.array(words), use), F.lit(0))


def buckets_of(words: Column, widest: int = WIDEST, buckets: int = BUCKETS) -> Column:
    """The buckets of all runs of 1 to ``widest`` words, as an array of integers."""

    def runs(width: int) -> Column:
        starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))
        run = lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, width)]) if width > 1 else w
        return F.transform(starts, lambda w, i: (F.crc32(run(w, i)) % buckets).cast("int"))

    return F.concat(*[runs(k) for k in range(1, widest + 1)])


def bucketed(rows: DataFrame, text: str = "text", widest: int = WIDEST, buckets: int = BUCKETS, carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns to carry, ``n_words`` and ``buckets``: the bucket of every feature of the whole text."""
    facts = with_words(F.col(f"`{text}`"), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), buckets_of(ws, widest, buckets).alias("buckets")))
    return rows.select(*carry, facts.alias("f")).select(*carry, "f.n_words", "f.buckets")


def bucket_totals(rows: DataFrame) -> dict[int, int]:
    """How many features of all texts fall into each bucket; one number a bucket comes to the driver."""
    return {r.bucket: r.n for r in rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Per bucket the floor of 1000 times the log of its smoothed share in the target over that in the corpus."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def weighed(rows: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """``n_features``, ``weight`` and ``score`` in place of the ``buckets`` of rows (doc, n_words, buckets, ...)."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")  # constant: folded into one literal
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))
    rows = rows.withColumns({"n_features": F.size("buckets").cast("long"), "total": total}).drop("buckets")
    weight = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(total - pmod(total, n_features)) div n_features")).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("weight", weight).withColumn("score", (F.col("weight") + noise).cast("long")).drop("total")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """A written table of ``rows`` with ``rank`` from 1 in the given order, which must be total.

    Spark sorts by ranges; a row's rank is its place in its range plus the sizes of the
    ranges before, of which there are as many as shuffle partitions.
    """
    at = F.col("_at")
    placed = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright(at, 33), at.bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r.part, before))
        before += r.n
    offsets = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    out = written(placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn("rank", F.col("_before") + within + 1).drop("_at", "_part", "_before"))
    drop(placed)
    return out


def resample(docs: DataFrame, target: DataFrame, row_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, widest: int = WIDEST, buckets: int = BUCKETS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_features``, ``weight``, ``score`` and ``rank`` (1, 2, ... of those drawn, null for others).

    Of the N rows with at least ``least_words`` words the floor(percent * N / 100)
    highest scores are drawn, ties to the smaller id, null ids last. Null and empty
    texts have no features and weigh 0; rows repeated whole are drawn one by one; the
    noise of a null id is that of an empty one. Empty tables on either side are
    distributions of no features. Other columns are not read.
    """
    # Texts are split and hashed once: two passes over the buckets cost a fraction of that.
    placed = written(bucketed(docs.select(F.col(f"`{row_id}`").cast("long").alias("doc"), *carry, F.col(f"`{text}`").alias("text")), "text", widest, buckets, ("doc", *carry)))
    gain = gains(bucket_totals(placed), bucket_totals(bucketed(target, target_text, widest, buckets)), buckets)
    rows = written(weighed(placed, gain, seed).withColumn("uid", F.monotonically_increasing_id()))
    drop(placed)
    able = rows.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last(), F.col("uid")]
    found = ranked(able.drop("n_words"), *order)
    facts = [F.col("doc").alias(row_id), *carry, "n_features", "weight", "score"]
    first = found.select(*facts, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return first.unionByName(rows.where(F.col("n_words") < least_words).select(*facts, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, row_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, whatever their names; ``settings`` as for ``resample``."""
    keyed = written(docs.select(whole_row(docs)).withColumn("_uid", F.monotonically_increasing_id()))
    own = keyed.select(F.col(f"_row.`{row_id}`").alias("_id"), F.col(f"_row.`{text}`").alias("_text"), "_uid")
    drawn = resample(own, target, "_id", "_text", carry=("_uid",), **settings).where("rank is not null").select(F.col("_uid").alias("_at"))
    return keyed.join(drawn, F.col("_uid") == F.col("_at"), "left_semi").select("_row.*")
