"""Second readings of tracks without a name: which frames are read again, and how the new readings join the old ones without adding votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playframe.operators.identity import tracks_of

#: Frames sampled of a track, the fewest it must have, frames around a sure reading, and what is sure.
SAMPLES, LEAST_FRAMES, AROUND, SURE = 12, 15, (2, 4, 8, 16), 0.8


def wanted_frames(bodies: DataFrame, named: DataFrame, reads: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Frames of tracks to read again: ``segment_id, track_id, frame_index, anchored``.

    Of a track (rows of ``bodies``, one a frame) that isn't ``named`` and has 15 frames,
    ``samples`` frames are taken evenly from the first to the last, and those of its
    frames that lie 2, 4, 8 or 16 from a sure reading of it (``anchored``), or are one.
    """
    track = tracks_of(bodies)
    w = W.partitionBy(*track)
    rows = bodies.where(F.col("track_id").isNotNull()).select(*track, "frame_index").distinct().join(named.select(*track).distinct(), track, "left_anti")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy("frame_index")) - 1).where(F.col("_n") >= LEAST_FRAMES)
    even = F.exists(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / (samples - 1)) == F.col("_i"))
    steps = F.array(*[F.lit(s * d).cast("long") for d in (0, *AROUND) for s in ((1, -1) if d else (1,))])
    near = reads.where(F.col("number").isNotNull() & (F.col("confidence") >= SURE)).select(*track, F.explode(F.transform(steps, lambda d: F.col("frame_index") + d)).alias("frame_index")).distinct().withColumn("_near", F.lit(True))
    found = rows.withColumn("_even", (F.col("_n") <= samples) | even).join(near, [*track, "frame_index"], "left").withColumn("anchored", F.coalesce("_near", F.lit(False)))
    return found.where("_even or anchored").select(*track, "frame_index", "anchored")


def merged_reads(previous: DataFrame, recovered: DataFrame, modern: str) -> DataFrame:
    """Readings (segment_id, track_id, frame_index, decoder, number, confidence, ...) with the recovered ones: a frame of a track has one vote of decoder ``modern``.

    Of several recovered crops of a frame the surest counts (of equals the one of the
    smaller number). It takes the place of the modern reading there only if it is surer;
    older decoders' readings stay as they are.
    """
    key = [*tracks_of(previous), "frame_index"]
    best = recovered.groupBy(*key).agg(F.max_by(F.struct(*previous.columns), F.struct("confidence", (-F.col("number").cast("double")).alias("_n"))).alias("_new"))
    old = previous.where(F.col("decoder") == modern).groupBy(*key).agg(F.max_by(F.struct(*previous.columns), "confidence").alias("_old"))
    both = old.join(best, key, "full")
    chosen = F.when(F.col("_old").isNull() | (F.col("_new.confidence") > F.col("_old.confidence")), F.col("_new")).otherwise(F.col("_old"))
    return previous.where(~F.col("decoder").eqNullSafe(modern)).unionByName(both.select(chosen.alias("_r")).select("_r.*"))
