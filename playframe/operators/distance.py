"""Distance per subject on any ordered points: gap-aware pairs, exclusion reasons and the roll-up.

The plain form for named columns. A track that comes back after a missing frame starts
anew here; ``observed`` has the full rules for persons in frames: identity conflicts,
tracking gaps, smoothing, warnings.

Missing evidence is never bridged: a pair counts only if its row before is the
track's previous frame, close in time, and no faster than the limit. Null is not
zero: a subject without a valid pair has no distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = list[str]


def distance_pairs(df: DataFrame, track: Keys, time: str, point: tuple[str, str], max_gap: float, max_speed: float, frame: str | None = None, status: str | None = None, method: str | None = None, same: Keys = ()) -> DataFrame:
    """Adds ``dt``, ``distance`` and ``reason`` to every row; the first reason that applies counts.

    ``frame`` must grow by 1 from row to row where given; ``status`` names the reason
    for a missing point; ``method`` and the columns ``same`` must not change in a pair.
    """
    w = W.partitionBy(*track).orderBy(frame or time)
    back = lambda c: F.lag(c).over(w)
    x, y = point
    rows = df.withColumn("dt", F.col(time) - back(time)).withColumn("_x", back(x)).withColumn("_y", back(y))
    rows = rows.withColumn("_step", F.sqrt((F.col(x) - F.col("_x")) * (F.col(x) - F.col("_x")) + (F.col(y) - F.col("_y")) * (F.col(y) - F.col("_y"))))
    first = F.col("dt").isNull() if frame is None else F.coalesce(F.col(frame) - back(frame) != 1, F.lit(True))
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(back(c))
    missing = F.col("_step").isNull()
    reason = F.when(first, "interval_start").when(changed, "identity_transition_or_conflict").when(F.col("dt") > max_gap, "timestamp_gap")
    reason = reason.when(missing, F.col(status) if status else F.lit("missing_point"))
    if method:
        reason = reason.when(~F.col(method).eqNullSafe(back(method)), "ground_point_method_change")
    reason = reason.when(F.col("_step") > max_speed * F.col("dt"), "implausible_speed")
    rows = rows.withColumn("reason", reason).withColumn("dt", F.when(first, None).otherwise(F.col("dt")))
    return rows.withColumn("distance", F.when(F.col("reason").isNull(), F.col("_step"))).drop("_x", "_y", "_step")


def measurement_status(measured: Column, tracked: Column) -> Column:
    return F.when(measured.isNull() | (measured <= 0), "unavailable").when(measured < tracked - 1e-9, "partial").otherwise("ok")


def subject_totals(pairs: DataFrame, subject: Keys) -> DataFrame:
    """Per subject: distance, tracked and measured time, coverage, status and the number of excluded pairs. Two-level sums, no window."""
    started = F.coalesce(F.col("reason") == "interval_start", F.lit(False))
    kept = F.col("reason").isNull()
    totals = pairs.groupBy(*subject).agg(
        F.sum("distance").alias("distance"),
        F.coalesce(F.sum(F.when(~started, F.col("dt"))), F.lit(0)).cast("double").alias("tracked"),
        F.coalesce(F.sum(F.when(kept, F.col("dt"))), F.lit(0)).cast("double").alias("measured"),
        F.count(F.when(kept, 1)).alias("n_pairs"),
        F.count(F.when(~kept & ~started, 1)).alias("n_excluded"),
    )
    totals = totals.withColumn("coverage", F.try_divide("measured", F.when(F.col("tracked") > 0, F.col("tracked"))))
    return totals.withColumn("status", F.when(F.col("n_pairs") == 0, "unavailable").otherwise(measurement_status(F.col("measured"), F.col("tracked"))))


def excluded_intervals(pairs: DataFrame, subject: Keys) -> DataFrame:
    """Long rows: subject, reason and how often it excluded a pair."""
    return pairs.where("reason is not null and reason <> 'interval_start'").groupBy(*subject, "reason").agg(F.count(F.lit(1)).alias("n"))
