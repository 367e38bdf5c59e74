"""Joins on time and space: as-of with a hold, interval overlap, uniqueness, rosters and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = list[str]


def asof(left: DataFrame, right: DataFrame, keys: Keys, time: str, value: str, hold: float, out: str) -> DataFrame:
    """Every left row with ``out``: the right value at the latest time not after its own, if no older than ``hold``.

    Both sides lie in buckets of ``hold``, and each bucket also gets the last right row
    of the one before, so the latest value is always in the row's own bucket: windows
    run over (key, bucket), and a key with many rows is spread. Of right rows at one
    time the largest value counts. Left rows without a time have no value.
    """
    bucket = F.floor(F.col(time) / hold)
    l = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"), *[F.col(k) for k in keys], bucket.alias("_bucket"), F.col(time).alias("_t"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_side"))
    r = right.where(F.col(value).isNotNull() & F.col(time).isNotNull()).select(*[F.col(k) for k in keys], bucket.alias("_bucket"), F.col(time).alias("_t"), F.col(value).alias("_v"))
    carried = r.groupBy(*keys, "_bucket").agg(F.max(F.struct("_t", "_v")).alias("_last")).select(*keys, (F.col("_bucket") + 1).alias("_bucket"), "_last.*")
    none = F.lit(None).cast(l.schema["_left"].dataType).alias("_left")
    both = l.unionByName(r.unionByName(carried).select(none, *keys, "_bucket", "_t", "_v", F.lit(0).alias("_side")))
    w = W.partitionBy(*keys, "_bucket").orderBy("_t", "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_side") == 0, F.struct("_t", "_v")), ignorenulls=True).over(w)
    rows = both.withColumn("_seen", seen).where("_side = 1")
    return rows.select("_left.*", F.when(F.col("_t") - F.col("_seen._t") <= hold, F.col("_seen._v")).alias(out))


def overlaps(left: DataFrame, right: DataFrame, keys: Keys, left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of half-open spans that overlap, with equal keys.

    Spans are put into every bucket of ``width`` that they touch; a pair is taken in
    the first bucket that both touch, so none comes twice. ``width`` should be near
    the usual length of a span. Column names of the two sides must differ but for the
    keys.
    """

    def bucketed(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        first, last = (F.floor(F.col(span[0]) / width).cast("long"), (F.ceil(F.col(span[1]) / width) - 1).cast("long"))
        return df.where(F.col(span[1]) > F.col(span[0])).withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last))))

    l, r = bucketed(left, left_span), bucketed(right, right_span)
    meet = F.greatest(left_span[0], right_span[0])
    joined = l.join(r, [*keys, "_bucket"]).where((F.col(left_span[0]) < F.col(right_span[1])) & (F.col(right_span[0]) < F.col(left_span[1])))
    return joined.where(F.floor(meet / width).cast("long") == F.col("_bucket")).drop("_bucket")


def unique_pairs(df: DataFrame, source: Keys, target: Keys) -> DataFrame:
    """Candidate pairs whose source has no other target and whose target no other source."""
    n = F.count(F.lit(1))
    counted = df.withColumn("_s", n.over(W.partitionBy(*source))).withColumn("_t", n.over(W.partitionBy(*target)))
    return counted.where("_s = 1 and _t = 1").drop("_s", "_t")


def collisions(df: DataFrame, keys: Keys) -> DataFrame:
    """Rows that share their keys with another row; rows with a null key collide with none. Keys are counted first, so a hot key is summed before it moves."""
    several = df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_holders")).where("n_holders > 1")
    return df.join(several, keys)


def lookup(df: DataFrame, roster: DataFrame, key: str, candidate: str) -> DataFrame:
    """Adds ``candidate`` and ``lookup_status``: unique, ambiguous (more than one candidate, none given) or unresolved."""
    known = roster.groupBy(F.col(key).alias("_key")).agg(F.countDistinct(candidate).alias("_n"), F.min(candidate).alias("_c"))
    joined = df.join(known, F.col(key) == F.col("_key"), "left")
    status = F.when(F.col("_n") == 1, "unique").when(F.col("_n") > 1, "ambiguous").otherwise("unresolved")
    return joined.withColumn(candidate, F.when(F.col("_n") == 1, F.col("_c"))).withColumn("lookup_status", status).drop("_key", "_n", "_c")


def merge_best(first: DataFrame, second: DataFrame, keys: Keys, score: str, value: str) -> DataFrame:
    """One row per key of either side with the value of the higher score; the first side wins ties, a null score loses."""
    tagged = first.select(*keys, score, value, F.lit(1).alias("_side")).unionByName(second.select(*keys, score, value, F.lit(0).alias("_side")))
    best = tagged.groupBy(*keys).agg(F.max(F.struct(F.col(score), "_side", F.col(value))).alias("_b"))
    return best.select(*keys, F.col(f"_b.{score}").alias(score), F.col(f"_b.{value}").alias(value))


def leaks(df: DataFrame, content: Column, split: str) -> DataFrame:
    """Contents that more than one split has: their hash, number of splits and rows."""
    keyed = df.select(F.md5(content.cast("binary")).alias("content_md5"), F.col(split).alias("_split"))
    by = keyed.groupBy("content_md5", "_split").agg(F.count(F.lit(1)).alias("_n"))
    return by.groupBy("content_md5").agg(F.count(F.lit(1)).alias("n_splits"), F.sum("_n").alias("n_rows")).where("n_splits > 1")


def by_detection(tracked: DataFrame, poses: DataFrame, frame: str, index: str) -> DataFrame:
    """Tracked rows with the pose of the same detection; a pose that no row has, or that two have, is an error when the result is computed."""
    p = poses.groupBy(frame, index).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[c for c in poses.columns if c not in (frame, index)])).alias("_pose"))
    both = tracked.withColumn("_there", F.lit(True)).join(p, [frame, index], "full")
    wrong = F.when(F.col("_there").isNull(), F.raise_error(F.lit("a pose belongs to no tracked detection"))).when(F.col("_n") > 1, F.raise_error(F.lit("a detection has two poses")))
    return both.withColumn("_n", F.coalesce(wrong.cast("long"), F.col("_n"))).select(*tracked.columns, "_pose.*", (F.col("_n") > 0).alias("has_pose"))


def reviewed(labels: DataFrame, objects: DataFrame, keys: Keys, digest: str) -> DataFrame:
    """Objects with their review by key; a review of another image, told by its hash, doesn't count and is ``stale``."""
    l = labels.withColumnsRenamed({c: f"_l_{c}" for c in labels.columns})
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_l_{k}"))
    rows = objects.join(l, on, "left")
    same = F.col(digest) == F.col(f"_l_{digest}")
    rest = [c for c in labels.columns if c not in (*keys, digest)]
    return rows.select(*objects.columns, *[F.when(same, F.col(f"_l_{c}")).alias(c) for c in rest], F.coalesce(~same, F.lit(False)).alias("stale"))
