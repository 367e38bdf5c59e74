"""Small operators on frames and tracks: cuts, visibility, smoothing, lookups by time and frame, samples, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = list[str]


def segments(frames: DataFrame, keys: Keys, cut: Column) -> DataFrame:
    """Adds ``segment``: how many cuts there have been; the first frame is none.

    Each block of frames is a window of its own and goes on from the cuts of the blocks
    before it, so one sequence may be a whole table.
    """
    from playframe.operators.sequence import BLOCK, beside

    rows = frames.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("long")).withColumn("_block", F.floor(F.col("frame_index") / BLOCK))
    blocks = rows.groupBy(*keys, "_block").agg(F.sum("_cut").alias("_n"), F.min_by("_cut", "frame_index").alias("_head"))
    w = W.partitionBy(*keys).orderBy("_block")
    blocks = blocks.select(*keys, "_block", (F.sum("_n").over(w) - F.col("_n") - F.first("_head").over(w)).alias("_before"))
    own = F.sum("_cut").over(W.partitionBy(*keys, "_block").orderBy("frame_index"))
    return beside(rows.withColumn("_own", own), blocks, [*keys, "_block"]).withColumn("segment", F.col("_before") + F.col("_own")).drop("_cut", "_block", "_own", "_before")


def forced_cuts(frames: DataFrame, keys: Keys, boundaries: Column, reset: Column) -> DataFrame:
    """Adds ``forced_cut``: a boundary lies between the frame before and this one, or the frame is a reset."""
    from playframe.functions.tracking import crosses

    before = F.lag("timestamp_s").over(W.partitionBy(*keys).orderBy("frame_index"))
    return frames.withColumn("forced_cut", crosses(before, F.col("timestamp_s"), boundaries) | F.coalesce(reset, F.lit(False)))


def visible(rows: DataFrame, keys: Keys, named: Column, least: int = 5) -> DataFrame:
    """Rows to show: those with a name, and those in an unbroken run of at least ``least`` frames of their keys."""
    from playframe.operators.sequence import islands

    runs = islands(rows, keys, "frame_index", 1)
    return runs.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys, "island"))).where(named | (F.col("_n") >= least)).drop("_n", "island")


def smoothed_boxes(rows: DataFrame, keys: Keys, cut: str = "scene_cut") -> DataFrame:
    """Adds ``smooth_box``: the box weighted 3, its neighbours 2, the ones beyond them 1, where these are there and fit.

    Neighbours come in pairs, so steady movement is not delayed. A pair needs both
    frames, no cut between, feet within 0.65 heights and a ratio of heights from 0.65
    to 1.55; the outer pair needs the inner one too.
    """
    w = W.partitionBy(*keys).orderBy("frame_index")

    def other(n: int) -> Column:
        beside = F.lag if n < 0 else F.lead
        r = beside(F.struct("frame_index", "box", F.coalesce(F.col(cut), F.lit(False)).alias("cut")), abs(n)).over(w)
        return F.when(r["frame_index"] == F.col("frame_index") + n, r)

    for n in (-2, -1, 1, 2):
        rows = rows.withColumn(f"_o{n + 2}", other(n))
    own = F.col("box")

    def fits(n: int) -> Column:
        b = F.col(f"_o{n + 2}.box")
        h, g = own[3] - own[1], b[3] - b[1]
        dx, dy = (own[0] + own[2] - b[0] - b[2]) / 2, (own[1] + own[3] - b[1] - b[3]) / 2
        return F.coalesce((F.sqrt(dx * dx + dy * dy) <= 0.65 * F.greatest(h, g)) & (g / h >= 0.65) & (g / h <= 1.55), F.lit(False))

    no_cut = lambda n: ~F.coalesce(F.col(f"_o{n + 2}.cut"), F.lit(False))
    inner = fits(-1) & fits(1) & ~F.coalesce(F.col(cut), F.lit(False)) & no_cut(1)
    outer = inner & fits(-2) & fits(2) & no_cut(-1) & no_cut(2)
    at = lambda n, i: F.col(f"_o{n + 2}.box")[i]
    mean = lambda i: F.when(outer, (3 * own[i] + 2 * (at(-1, i) + at(1, i)) + at(-2, i) + at(2, i)) / 9).when(inner, (3 * own[i] + 2 * (at(-1, i) + at(1, i))) / 7).otherwise(own[i])
    return rows.withColumn("smooth_box", F.array(*map(mean, range(4)))).drop("_o0", "_o1", "_o3", "_o4")


def at_frame(frames: DataFrame, n: int) -> DataFrame:
    """One frame by its index: a filter that reaches the scan, where a table sorted by frame skips the rest."""
    return frames.where(F.col("frame_index") == n)


def page(frames: DataFrame, start: int, count: int, most: int = 60) -> DataFrame:
    """Frames ``start`` to ``start + count``, in order; a page has at most ``most``."""
    if start < 0 or not 1 <= count <= most:
        raise ValueError(f"a page starts at 0 or later and has 1 to {most} frames")
    return frames.where(F.col("frame_index").between(start, start + count - 1)).orderBy("frame_index")


def nearest_frames(times: DataFrame, frames: DataFrame, keys: Keys, time: str) -> DataFrame:
    """Adds ``nearest``, the frame closest in time, the earlier of two as close, and ``holding``, the last one that began by the time (within 1e-6); before the first both are the first."""
    f = frames.select(*keys, F.col("timestamp_s").alias("_t"), F.lit(0).alias("_k"), F.struct(F.col("timestamp_s").alias("t"), F.col("frame_index").alias("f")).alias("_r"), F.lit(None).cast(dict(times.dtypes)[time]).alias("_x"))
    q = times.select(*keys, (F.col(time) + 1e-6).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(f.schema["_r"].dataType).alias("_r"), F.col(time).alias("_x"))
    w = W.partitionBy(*keys).orderBy("_t", "_k")
    both = f.unionByName(q).withColumn("_b", F.last("_r", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_a", F.first("_r", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))).where("_k = 1")
    near = F.when(F.col("_b").isNull(), F.col("_a.f")).when(F.col("_a").isNull() | (F.col("_x") - F.col("_b.t") <= F.col("_a.t") - F.col("_x")), F.col("_b.f")).otherwise(F.col("_a.f"))
    return both.select(*keys, F.col("_x").alias(time), near.alias("nearest"), F.coalesce("_b.f", "_a.f").alias("holding"))


def in_episode(rows: DataFrame, episodes: DataFrame, keys: Keys, frame: str) -> DataFrame:
    """Adds ``episode``, whose first to last frame contains the row's. Episodes of a key don't overlap: the last one that has begun is looked at."""
    e = episodes.select(*keys, F.col("first").alias("_f"), F.lit(0).alias("_k"), F.struct("last", "episode").alias("_e"), *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in keys])
    r = rows.select(*rows.columns, F.col(frame).alias("_f"), F.lit(1).alias("_k"), F.lit(None).cast(e.schema["_e"].dataType).alias("_e"))
    w = W.partitionBy(*keys).orderBy("_f", "_k").rowsBetween(W.unboundedPreceding, 0)
    both = r.unionByName(e).withColumn("_now", F.last("_e", ignorenulls=True).over(w)).where("_k = 1")
    return both.withColumn("episode", F.when(F.col("_now.last") >= F.col("_f"), F.col("_now.episode"))).select(*rows.columns, "episode")


def every_nth(rows: DataFrame, keys: Keys, frame: str, n: int) -> DataFrame:
    """Rows whose distance from the first frame of their keys is a multiple of ``n``."""
    return rows.withColumn("_first", F.min(frame).over(W.partitionBy(*keys))).where((F.col(frame) - F.col("_first")) % n == 0).drop("_first")


def truncated_sample(rows: DataFrame, keys: Keys, order: list[Column], k: int) -> DataFrame:
    """``k`` evenly spaced rows per key by truncation: positions floor(i (n - 1) / (k - 1)); all where there are no more."""
    w = W.partitionBy(*keys)
    rows = rows.withColumn("position", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    i = F.ceil(F.col("position") * (k - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = (F.floor(i * (F.col("_n") - 1) / (k - 1)) == F.col("position")) & (i <= k - 1)
    return rows.where((F.col("_n") <= k) | hit).drop("_n")


def best_of(rows: DataFrame, keys: Keys, score: str, order: str) -> DataFrame:
    """The row of the highest score per key, the first in ``order`` of equals; rows without a score lose."""
    w = W.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def worst_frames(errors: DataFrame, frame: str, n: int) -> DataFrame:
    """The ``n`` frames with most errors (rows of ``errors``), the earlier of equals: counted first, so only a row a frame is ordered."""
    return errors.groupBy(frame).agg(F.count(F.lit(1)).alias("errors")).orderBy(F.desc("errors"), frame).limit(n)


def first_and_last(rows: DataFrame, keys: Keys, frame: str) -> DataFrame:
    """First and last frame of a group and its number of rows."""
    return rows.groupBy(*keys).agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count(F.lit(1)).alias("n"))


def appended(previous: DataFrame, rebuilt: DataFrame, dropped: Column) -> DataFrame:
    """What stays of an earlier result (all but ``dropped``) and what was built anew."""
    return previous.where(~F.coalesce(dropped, F.lit(False))).unionByName(rebuilt, allowMissingColumns=True)


def set_difference(first: DataFrame, second: DataFrame, keys: Keys) -> DataFrame:
    """Keys that only one side has, with ``side`` first or second; none where both are equal as sets. One shuffle for both directions."""
    tag = lambda df, s: df.select(*keys, F.lit(s).alias("_s")).distinct()
    both = tag(first, 1).unionByName(tag(second, 2)).groupBy(*keys).agg(F.sum("_s").alias("_s")).where("_s < 3")
    return both.select(*keys, F.when(F.col("_s") == 1, "first").otherwise("second").alias("side"))


def common_targets(windows: DataFrame, keys: Keys, model: str) -> DataFrame:
    """Targets that every model has a window for; how many models there are is one row beside them."""
    models = windows.agg(F.count_distinct(model).alias("_models"))
    own = windows.groupBy(*keys).agg(F.count_distinct(model).alias("_n"))
    return own.crossJoin(F.broadcast(models)).where("_n = _models").select(*keys)


def added_proposals(cached: DataFrame, proposals: DataFrame, frame: str) -> DataFrame:
    """Annotations with proposals for frames that have none or are marked ``unannotated``, which these replace; ``proposed`` tells them apart."""
    kept = cached.where("status <> 'unannotated'")
    new = proposals.join(kept.select(frame).distinct(), frame, "left_anti")
    rest = cached.where("status = 'unannotated'").join(new.select(frame).distinct(), frame, "left_anti")
    return kept.unionByName(rest).withColumn("proposed", F.lit(False)).unionByName(new.select(*cached.columns).withColumn("proposed", F.lit(True)))


def annotation_plan(spans: DataFrame, step: int) -> DataFrame:
    """Frames to annotate: every ``step``-th of each phase span (first, last, phase), each frame once, with the phases that ask for it."""
    rows = spans.select("phase", F.explode(F.sequence("first", "last", F.lit(step))).alias("frame_index"))
    return rows.groupBy("frame_index").agg(F.sort_array(F.collect_set("phase")).alias("phases"))


def prefix_before_cut(frames: DataFrame, keys: Keys) -> DataFrame:
    """What a run that is resumed keeps: frames before its last cut; all go where there is none."""
    last = frames.where("scene_cut and frame_index > 0").groupBy(*keys).agg(F.max("frame_index").alias("_cut"))
    return frames.join(last, keys).where("frame_index < _cut").drop("_cut") if keys else frames.crossJoin(last).where("frame_index < _cut").drop("_cut")


def dataset_statistics(images: DataFrame, boxes: DataFrame, key: str, split: str) -> DataFrame:
    """Images, boxes and images without boxes in all and per split (null: all)."""
    counts = boxes.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows = images.join(counts, key, "left")
    return rows.rollup(split).agg(F.count(F.lit(1)).alias("images"), F.coalesce(F.sum("_n"), F.lit(0)).alias("boxes"), F.count(F.when(F.col("_n").isNull(), 1)).alias("negatives"))


def ball_record(frames: DataFrame, fit: dict[str, Column]) -> DataFrame:
    """Adds the exported ball: ``status``, ``target_x``, ``target_y`` and ``box``, clipped in the source before it is placed.

    No row is ``unknown_position``, an occluded one ``occluded_with_position``, else
    ``visible``; an excluded frame has no target.
    """
    from playframe.functions.geometry import place

    status = F.when(F.col("cx").isNull(), "unknown_position").when(F.coalesce("occluded", F.lit(False)), "occluded_with_position").otherwise("visible")
    has = F.col("cx").isNotNull() & ~F.coalesce("excluded", F.lit(False))
    clip = lambda v, top: F.greatest(F.lit(0.0), F.least(v, F.col(top).cast("double")))
    r = F.col("radius")
    box = place([clip(F.col("cx") - r, "width"), clip(F.col("cy") - r, "height"), clip(F.col("cx") + r, "width"), clip(F.col("cy") + r, "height")], fit)
    return frames.withColumns({
        "status": status, "target_x": F.when(has, F.col("cx") * fit["scale_x"] + fit["left"]), "target_y": F.when(has, F.col("cy") * fit["scale_y"] + fit["top"]),
        "box": F.when(has, F.array(*box)),
    })
