"""Names handed from one piece of a track to another, forwards and backwards, across gaps of a few frames.

A joint is a pair of pieces of which the later begins where the earlier was lost. It
hands a name on forwards if the earlier piece is known at its end, backwards if the
later one is known at its start. Whatever makes another body possible, at the ends or
on the way between them, voids it.

Bodies are rows (segment_id, track_id, frame_index, timestamp_s, included, role, box,
color: the team colour seen in the frame, or null); bodies without a track still crowd.
``run_id`` keeps runs apart. Names are known directly on frames: rows (segment_id,
track_id, frame_index, team, number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playframe.functions.geometry import distance, foot_distance
from playframe.functions.tracking import run_keys
from playframe.operators.identity import BASE_DISTANCE, CROWD, HEIGHT_RATIO, LEAST_FRAMES, MAX_DISTANCE, MAX_GAP, spans, tracks_of, without_overlaps

#: Votes and share that give a piece its colour, and the confidence from which a reading contradicts.
COLOR_VOTES, COLOR_SHARE, RELIABLE = 3, 0.8, 0.8
WHO = ["team", "number"]


def pieces(bodies: DataFrame, direct: DataFrame) -> DataFrame:
    """One row per piece of a track: ``first`` and ``last`` (frame, time, box, included, name), ``frames``, ``color``, ``colors`` seen, and whether it is ``known`` anywhere."""
    track = tracks_of(bodies)
    rows = spans(bodies).join(direct, [*track, "frame_index"], "left")
    end = F.struct("frame_index", F.col("timestamp_s").alias("t"), "box", "included", "team", "number")
    counts = rows.groupBy(*track, "span", "color").agg(F.count(F.lit(1)).alias("_n"), F.min(end).alias("_first"), F.max(end).alias("_last"), F.max(F.col("team").isNotNull()).alias("_known"))
    votes = F.sum(F.when(F.col("color").isNotNull(), F.col("_n")))
    best = F.max(F.when(F.col("color").isNotNull(), F.struct("_n", "color")))
    out = counts.groupBy(*track, "span").agg(F.min("_first").alias("first"), F.max("_last").alias("last"), F.sum("_n").alias("frames"), F.collect_set("color").alias("colors"), F.max("_known").alias("known"), votes.alias("_votes"), best.alias("_best"))
    sure = (F.col("_votes") >= COLOR_VOTES) & (F.col("_best._n") / F.col("_votes") >= COLOR_SHARE)
    return out.withColumn("color", F.when(sure, F.col("_best.color"))).drop("_votes", "_best")


def joints(ends: DataFrame, cuts: DataFrame) -> DataFrame:
    """Pairs of pieces ``a`` and ``b`` of a segment where b begins within 0.2 s behind a, near its last place and of its height, without a cut between.

    Ends lie in buckets of the longest gap: an end meets the starts of its own bucket and the next.
    """
    segment = [*run_keys(ends), "segment_id"]
    piece = F.struct("track_id", "span", "first", "last", "frames", "color", "colors", "known")
    a = ends.select(*segment, piece.alias("a"), F.explode(F.array(F.floor(F.col("last.t") / MAX_GAP), F.floor(F.col("last.t") / MAX_GAP) + 1)).alias("_bucket"))
    b = ends.select(*segment, piece.alias("b"), F.floor(F.col("first.t") / MAX_GAP).alias("_bucket"))
    box = lambda c: [F.col(c)[i] for i in range(4)]
    heights = [x[3] - x[1] for x in (box("a.last.box"), box("b.first.box"))]
    rows = a.join(b, [*segment, "_bucket"]).drop("_bucket").withColumn("gap", F.col("b.first.t") - F.col("a.last.t")).where((F.col("gap") > 0) & (F.col("gap") <= MAX_GAP + 1e-9) & (F.col("a.track_id") != F.col("b.track_id")))
    rows = rows.where((F.least(*heights) > 0) & (F.least(*heights) / F.greatest(*heights) >= HEIGHT_RATIO)).withColumn("distance", foot_distance(box("a.last.box"), box("b.first.box")))
    rows = rows.where(F.col("distance") <= F.least(F.lit(MAX_DISTANCE), BASE_DISTANCE + F.col("gap"))).where("a.last.included and b.first.included")
    cut = cuts.select(*[F.col(c).alias(f"_{c}") for c in segment], F.col("frame_index").alias("_cut"))
    on = [F.col(c) == F.col(f"_{c}") for c in segment]
    return rows.join(cut, [*on, F.col("_cut") > F.col("a.last.frame_index"), F.col("_cut") <= F.col("b.first.frame_index")], "left_anti")


def _handed(met: DataFrame, direction: str) -> DataFrame:
    """Joints as (source, target, who): the source is known at the joint, the target nowhere."""
    forward = direction == "forward"
    source, target = ("a", "b") if forward else ("b", "a")
    at = f"{source}.{'last' if forward else 'first'}"
    rows = met.where(F.col(f"{at}.team").isNotNull() & ~F.col(f"{target}.known") & (F.col(f"{target}.frames") >= LEAST_FRAMES))
    rows = rows.select("*", F.col(source).alias("source"), F.col(target).alias("target"), F.col(f"{at}.team").alias("team"), F.col(f"{at}.number").alias("number"), F.col(f"{at}.frame_index").alias("known_at"), F.lit(direction).alias("direction"))
    # Neither piece may look like another team's.
    fits = lambda c: F.coalesce(F.col(f"{c}.color") == F.col("team"), F.lit(True)) & (F.size(F.filter(f"{c}.colors", lambda x: x != F.col("team"))) == 0)
    return rows.where(fits("source") & fits("target"))


def _near(spot: tuple[Column, Column], box: Column) -> Column:
    """Whether the feet of a box are within 0.65 of its heights of a spot."""
    height = box[3] - box[1]
    return (height > 0) & (distance(spot[0], spot[1], (box[0] + box[2]) / 2, box[3]) < CROWD * height)


def crossed(rows: DataFrame, bodies: DataFrame) -> DataFrame:
    """Rows less those with another body of no known other team near the feet at either end, or near the straight way between them in the frames of the gap.

    The way is one row a frame, a dozen at most, and meets the bodies of that frame.
    """
    runs = run_keys(rows)
    segment = [*runs, "segment_id"]
    keyed = rows.withColumn("_joint", F.struct("a.track_id", "a.span", F.col("b.track_id").alias("to_track"), F.col("b.span").alias("to_span"), "direction"))
    first, last = F.col("a.last.frame_index"), F.col("b.first.frame_index")
    way = keyed.withColumn("frame_index", F.explode(F.sequence(first, last)))
    share = (F.col("frame_index") - first) / (last - first)
    foot = lambda c: ((F.col(c)[0] + F.col(c)[2]) / 2, F.col(c)[3])
    spot = [p + share * (q - p) for p, q in zip(foot("a.last.box"), foot("b.first.box"), strict=True)]
    own = F.when(F.col("frame_index") == first, F.col("a.track_id")).when(F.col("frame_index") == last, F.col("b.track_id"))
    way = way.select(*segment, "_joint", "frame_index", "team", spot[0].alias("_x"), spot[1].alias("_y"), own.alias("_own"))
    other = bodies.where("role = 'player'").select(*segment, "frame_index", F.col("track_id").alias("_k"), F.col("box").alias("_box"), F.col("color").alias("_color"))
    near = _near((F.col("_x"), F.col("_y")), F.col("_box")) & ~F.coalesce(F.col("_k") == F.col("_own"), F.lit(False)) & F.coalesce(F.col("_color") == F.col("team"), F.lit(True))
    hit = way.join(other, [*segment, "frame_index"]).where(near).select(*segment, "_joint").distinct()
    return keyed.join(hit, [*segment, "_joint"], "left_anti")


def _safe(rows: DataFrame, bodies: DataFrame, direct: DataFrame) -> DataFrame:
    """Adds ``from_frame`` and ``to_frame``, the part of the target next to the joint up to the first frame in which another track is known as the player; it needs four frames."""
    runs = run_keys(rows)
    segment = [*runs, "segment_id"]
    held = direct.select(*segment, *WHO, F.col("frame_index").alias("_f"), F.col("track_id").alias("_k"))
    key = ["_joint", *segment]
    met = rows.select(*key, *WHO, "direction", "known_at", F.col("source.track_id").alias("_source"), F.col("target.track_id").alias("_target"), F.col("target.first.frame_index").alias("_a"), F.col("target.last.frame_index").alias("_b")).join(held, [*segment, *WHO])
    inside = F.col("_f").between(F.col("_a"), F.col("_b")) & (F.col("_k") != F.col("_target"))
    doubled = (F.col("_f") == F.col("known_at")) & (F.col("_k") != F.col("_source"))
    stops = met.groupBy(*key).agg(F.min(F.when(inside, F.col("_f"))).alias("_low"), F.max(F.when(inside, F.col("_f"))).alias("_high"), F.max(doubled).alias("_doubled"))
    rows = rows.join(stops, key, "left").where(~F.coalesce("_doubled", F.lit(False)))
    ahead = F.col("direction") == "forward"
    start = F.when(ahead, F.col("target.first.frame_index")).otherwise(F.coalesce(F.col("_high") + 1, F.col("target.first.frame_index")))
    stop = F.when(ahead, F.coalesce(F.col("_low") - 1, F.col("target.last.frame_index"))).otherwise(F.col("target.last.frame_index"))
    return rows.withColumn("from_frame", start).withColumn("to_frame", stop).where(F.col("to_frame") - F.col("from_frame") + 1 >= LEAST_FRAMES).drop("_low", "_high", "_doubled")


def _alone(rows: DataFrame) -> DataFrame:
    """Links whose source and whose target have no other candidate."""
    segment = [*run_keys(rows), "segment_id"]
    n = lambda c: F.count(F.lit(1)).over(W.partitionBy(*segment, f"{c}.track_id", f"{c}.span"))
    return rows.withColumn("_s", n("source")).withColumn("_t", n("target")).where("_s = 1 and _t = 1").drop("_s", "_t")


def links(bodies: DataFrame, direct: DataFrame, cuts: DataFrame, reads: DataFrame) -> DataFrame:
    """Frames that get a name from a neighbouring piece: ``segment_id, track_id, from_frame, to_frame, team, number, direction, source_track, gap, distance``.

    ``cuts`` are (segment_id, frame_index), ``reads`` (segment_id, track_id, frame_index,
    number, confidence); a reliable reading of another number inside the target voids a
    link. Backwards, the target's track must not be seen in the gap's frames or at the
    source's start, and the frames must not overlap a forward link of that track. Links
    of one player that overlap in time are both dropped. An empty table of names gives no
    rows.
    """
    runs = run_keys(bodies)
    segment = [*runs, "segment_id"]
    met = joints(pieces(bodies, direct), cuts)
    rows = _safe(crossed(_handed(met, "forward").unionByName(_handed(met, "backward")), bodies), bodies, direct)
    other = reads.where(F.col("confidence") >= RELIABLE).select(*[F.col(c).alias(f"_{c}") for c in segment], F.col("track_id").alias("_k"), F.col("frame_index").alias("_f"), F.col("number").alias("_read"))
    same = [F.col(c) == F.col(f"_{c}") for c in segment]
    rows = rows.join(other, [*same, F.col("target.track_id") == F.col("_k"), F.col("_f").between(F.col("target.first.frame_index"), F.col("target.last.frame_index")), F.col("_read") != F.col("number")], "left_anti")
    ahead = _alone(rows.where("direction = 'forward'"))
    seen = bodies.where("role = 'player' and track_id is not null").select(*[F.col(c).alias(f"_{c}") for c in segment], F.col("track_id").alias("_k"), F.col("frame_index").alias("_f"))
    back = rows.where("direction = 'backward'").join(seen, [*same, F.col("target.track_id") == F.col("_k"), F.col("_f") > F.col("target.last.frame_index"), F.col("_f") <= F.col("known_at")], "left_anti")
    taken = ahead.select(*[F.col(c).alias(f"_{c}") for c in segment], F.col("target.track_id").alias("_k"), F.col("from_frame").alias("_from"), F.col("to_frame").alias("_to"))
    back = _alone(back.join(taken, [*same, F.col("target.track_id") == F.col("_k"), F.col("_from") <= F.col("target.last.frame_index"), F.col("_to") >= F.col("target.first.frame_index")], "left_anti"))
    names = lambda df: df.select(*segment, F.col("target.track_id").alias("track_id"), "from_frame", "to_frame", *WHO, "direction", F.col("source.track_id").alias("source_track"), F.round("gap", 4).alias("gap"), F.round("distance", 4).alias("distance"))
    return without_overlaps(names(ahead).unionByName(names(back)), [*segment, *WHO], "from_frame", "to_frame")


def known_frames(bodies: DataFrame, direct: DataFrame, found: DataFrame) -> DataFrame:
    """Frames on which a track's player is known, directly or handed on: ``segment_id, track_id, frame_index, team, number, source``."""
    track = tracks_of(bodies)
    rows = bodies.where("role = 'player' and track_id is not null").select(*track, "frame_index")
    on = [F.col(f"_r.{c}") == F.col(f"_l.{c}") for c in track]
    handed = rows.alias("_r").join(found.alias("_l"), [*on, F.col("frame_index").between(F.col("from_frame"), F.col("to_frame"))]).select(*[F.col(f"_r.{c}") for c in (*track, "frame_index")], *WHO, F.col("direction").alias("source"))
    return direct.select(*track, "frame_index", *WHO, F.lit("direct").alias("source")).unionByName(handed)
