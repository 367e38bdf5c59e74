"""Observed distance from persons: identity conflicts, reasons, the smoothing filter, contributions and statistics.

Persons are rows (frame_index, timestamp_s, segment_id, included, track_id, role, x, y,
position_status, ground_point_method, named), ``named`` being the (team, number) struct
of ``functions.tracking.identity``. Where they have a ``run_id`` column, runs are kept
apart. A pair is measured only between consecutive frames
of one track; a step that isn't measured restarts filter and anchor at the raw point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playframe.functions import tracking
from playframe.functions.geometry import distance

TRACK = ["segment_id", "track_id"]


def with_subjects(persons: DataFrame) -> DataFrame:
    """Tracked players with ``conflict`` (their identity stands on several rows of the frame) and ``subject``; a conflict names nobody.

    Identities are counted over all tracked players, of excluded frames too.
    """
    rows = persons.where((F.col("role") == "player") & F.col("track_id").isNotNull())
    holders = F.count(F.lit(1)).over(W.partitionBy(*tracking.run_keys(persons), "frame_index", "named"))
    rows = rows.withColumn("conflict", F.col("named").isNotNull() & (holders > 1))
    who = F.when(~F.col("conflict"), F.col("named"))
    return rows.withColumn("named", who).withColumn("subject", tracking.subject(who, F.col("segment_id"), F.col("track_id")))


def contributions(persons: DataFrame, tau: float = 0.12, deadband: float = 0.025, max_speed: float = 12.0, max_gap: float = 0.2) -> DataFrame:
    """One row per included tracked player: ``interval_start``, ``dt``, ``tracked``, ``distance``, ``measured`` and ``reason``.

    The first reason that applies counts: a changed or conflicting subject, a long gap,
    a missing point (named by the row's own status, also where the point before is
    missing), another ground method, too fast a step. ``interval_start`` marks rows
    without a row of their track in the frame before.
    """
    track = [*tracking.run_keys(persons), *TRACK]
    w = W.partitionBy(*track).orderBy("frame_index")
    rows = with_subjects(persons).where("included")
    before = F.lag(F.struct("frame_index", "timestamp_s", "x", "y", "ground_point_method", "subject", "conflict")).over(w)
    rows = rows.withColumn("_p", before).withColumn("_p", F.when(F.col("_p.frame_index") == F.col("frame_index") - 1, F.col("_p")))
    rows = rows.withColumn("dt", F.col("timestamp_s") - F.col("_p.timestamp_s"))
    step = distance(F.col("x"), F.col("y"), F.col("_p.x"), F.col("_p.y"))
    changed = (F.col("subject") != F.col("_p.subject")) | F.col("conflict") | F.col("_p.conflict")
    reason = (
        F.when(F.col("_p").isNull(), "interval_start")
        .when(changed, "identity_transition_or_conflict")
        .when(F.col("dt") > max_gap, "timestamp_gap")
        .when(step.isNull(), F.coalesce("position_status", F.lit("position_unavailable")))
        .when(~F.col("ground_point_method").eqNullSafe(F.col("_p.ground_point_method")), "ground_point_method_change")
        .when(step > max_speed * F.col("dt"), "implausible_speed")
    )
    rows = rows.withColumn("_step", step).withColumn("reason", reason)
    rows = rows.withColumn("tracked", F.when(F.col("_p.subject") == F.col("subject"), F.col("dt")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("interval_start", F.col("_p.timestamp_s")).withColumn("measured", F.when(F.col("reason").isNull(), F.col("dt")).otherwise(F.lit(0.0))).drop("_p")
    if not tau and not deadband:
        return rows.withColumn("distance", F.when(F.col("reason").isNull(), F.col("_step"))).drop("_step")
    rows = rows.withColumn("distance", F.lit(None).cast("double"))

    def filtered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in order of tracks and frames: every track, and every stretch of measured steps, begins with a row that has a reason."""
        spot = anchor = (math.nan, math.nan)
        for part in parts:
            out = []
            for x, y, dt, why in zip(part["x"], part["y"], part["dt"], part["reason"], strict=True):
                if why is not None:
                    spot = anchor = (x, y)
                    out.append(None)
                    continue
                share = 1 - math.exp(-dt / tau) if tau else 1.0
                spot = (spot[0] + share * (x - spot[0]), spot[1] + share * (y - spot[1]))
                step = math.dist(spot, anchor)
                out.append(step if step >= deadband else 0.0)
                if out[-1]:
                    anchor = spot
            yield part.assign(distance=pd.array(out, "Float64"))

    return rows.repartition(*track).sortWithinPartitions(*track, "frame_index").mapInPandas(filtered, rows.schema).drop("_step")


def statistics(rows: DataFrame) -> DataFrame:
    """Per subject (and run) of ``contributions``: distance, durations, coverage, status, ``excluded`` (reason to count), ``warnings`` and ``tracks``.

    Null is not zero: without a measured pair there is no distance. A track of a subject
    that comes back after a missing frame is excluded once as ``tracking_gap``.
    """
    who = [*tracking.run_keys(rows), "subject"]
    again = F.lag("frame_index").over(W.partitionBy(*who, *TRACK).orderBy("frame_index"))
    rows = rows.withColumn("_gap", F.coalesce(again < F.col("frame_index") - 1, F.lit(False)))
    left_out = F.when(F.col("reason") != "interval_start", F.col("reason"))
    notes = F.array_compact(F.array(
        left_out, F.when(F.col("_gap"), F.lit("tracking_gap")), F.when(F.col("named").isNull(), F.lit("identity_not_resolved")), F.when(F.col("conflict"), F.lit("identity_conflict")),
        F.when(F.col("x").isNull() | F.col("y").isNull(), F.coalesce("position_status", F.lit("position_unavailable"))),
    ))
    counted = rows.withColumn("_why", F.array_compact(F.array(left_out, F.when(F.col("_gap"), F.lit("tracking_gap"))))).withColumn("_notes", notes)
    # Two levels: sums per track before they meet in their subject, and reasons counted before they become a map.
    by_track = counted.groupBy(*who, *TRACK).agg(
        F.sum("distance").alias("distance"), F.sum("tracked").alias("tracked"), F.sum("measured").alias("measured"),
        F.count(F.when(F.col("reason").isNull(), 1)).alias("pairs"), F.array_distinct(F.flatten(F.collect_set("_notes"))).alias("_notes"),
    )
    totals = by_track.groupBy(*who).agg(
        F.sum("distance").alias("distance"), F.sum("tracked").alias("tracked"), F.sum("measured").alias("measured"), F.sum("pairs").alias("pairs"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("_notes")))).alias("warnings"), F.sort_array(F.collect_list(F.struct(*TRACK))).alias("tracks"),
    )
    reasons = counted.select(*who, F.explode("_why").alias("_r")).groupBy(*who, "_r").agg(F.count(F.lit(1)).alias("_n"))
    reasons = reasons.groupBy(*who).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_r", "_n")))).alias("excluded"))
    out = totals.join(reasons, who, "left").withColumn("distance", F.when(F.col("pairs") > 0, F.col("distance")))
    status = F.when(F.col("pairs") == 0, "unavailable").when(F.col("measured") < F.col("tracked") - 1e-9, "partial").otherwise("ok")
    empty = F.create_map().cast("map<string,bigint>")
    return out.withColumn("coverage", F.try_divide("measured", F.nullif("tracked", F.lit(0.0)))).withColumn("status", status).withColumn("excluded", F.coalesce("excluded", empty))


def order_violations(frames: DataFrame) -> DataFrame:
    """Frames that don't follow the one before: ``index`` (not the next), ``time`` (not later) or ``segment`` (smaller); the first must have index 0.

    One window over all frames of a run; without a ``run_id`` the table is one run.
    """
    keys = tracking.run_keys(frames)
    w = W.partitionBy(*keys).orderBy("frame_index")
    back = lambda c: F.lag(c).over(w)
    index = F.coalesce(F.col("frame_index") != back("frame_index") + 1, F.col("frame_index") != 0)
    time = F.coalesce(F.col("timestamp_s") <= back("timestamp_s"), F.col("timestamp_s") < 0)
    segment = F.coalesce(F.col("segment_id") < back("segment_id"), F.lit(False))
    rule = F.when(index, "index").when(time, "time").when(segment, "segment")
    return frames.select(*keys, "frame_index", rule.alias("rule")).where("rule is not null")


def metrics_at(rows: DataFrame, frame: int | Column) -> DataFrame:
    """The leaderboard at a frame, a number or a column: per subject (and run) its running totals up to the last row not after it; measured subjects first, longest distance on top."""
    upto = rows.where(F.col("frame_index") <= frame)
    sums = upto.groupBy(*tracking.run_keys(rows), "subject").agg(F.sum("distance").alias("distance"), F.sum("measured").alias("measured"), F.max("frame_index").alias("last_frame"))
    return sums.orderBy(F.col("distance").desc_nulls_last(), "subject")


def player_card(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys`` the sum over a subject's records: distance over measured records, durations only where every record has one."""
    whole = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))
    card = stats.groupBy(*keys).agg(F.sum("distance").alias("distance"), whole("measured").alias("measured"), whole("tracked").alias("_t"))
    return card.withColumn("coverage", F.try_divide("measured", F.when(F.col("_t") > 0, F.col("_t")))).drop("_t")
