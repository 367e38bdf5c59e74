"""Shots: one event of overlapping proposals, the shooter's place before release, direction, attribution, counts and maps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playframe.functions.geometry import distance
from playframe.functions.tracking import run_keys, same_keys
from playframe.operators.aggregates import cell

HALF_MARGIN = 0.5
#: How reasons are shown.
SHOWN_REASONS = {"direction_unavailable": "direction", "outside_attacking_half": "half", "outside_court": "court"}


def one_event(proposals: DataFrame, segment: list[str]) -> DataFrame:
    """Of proposals for one shot the best: rows (time_s, end_s, quality, frames: the trajectory's frame indexes).

    In the order of time, then falling quality, a proposal doubles the first kept one
    that is within 0.65 s or shares more than 60 % of the shorter trajectory, and hasn't
    ended before; the one of higher quality stays. What is kept decides the next, so a
    segment's proposals are folded together; shots of one segment are some dozens.
    """

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["time_s", "quality"], ascending=[True, False], kind="stable")
        kept: list[int] = []
        times, ends, quality, frames = (rows[c].tolist() for c in ("time_s", "end_s", "quality", "frames"))
        sets = [set(f) for f in frames]
        for i in range(len(rows)):
            near = lambda j: abs(times[j] - times[i]) < 0.65 or len(sets[i] & sets[j]) / max(1, min(len(sets[i]), len(sets[j]))) > 0.6  # noqa: B023, E731
            double = next((j for j in kept if times[i] < ends[j] and near(j)), None)
            if double is None:
                kept.append(i)
            elif quality[i] > quality[double]:
                kept.remove(double)
                kept.append(i)
        return rows.iloc[sorted(kept)]

    return proposals.groupBy(*segment).applyInPandas(keep, proposals.schema)


def origins(shots: DataFrame, positions: DataFrame, segment: list[str]) -> DataFrame:
    """Adds ``origin_x``, ``origin_y``, ``support`` and ``origin_reason``: the median of the shooter's valid positions in the 0.25 s up to the release.

    Shots are rows (shot_id, time_s, track_id, team), positions (time_s, track_id, team,
    x, y, ground_point_method, unbroken_since: the time from which frames follow each
    other without a cut or gap). It takes two positions, one ground method, and none
    more than 1.25 m from the median.
    """
    shot = [*run_keys(shots), "shot_id"]
    p = positions.select(*segment, F.col("time_s").alias("_t"), F.col("track_id").alias("_k"), F.col("team").alias("_team"), "x", "y", F.col("ground_point_method").alias("_m"), F.col("unbroken_since").alias("_since"), F.floor(F.col("time_s") / 0.25).alias("_bucket"))
    s = shots.withColumn("_bucket", F.explode(F.array(F.floor(F.col("time_s") / 0.25), F.floor(F.col("time_s") / 0.25) - 1)))
    on = [F.col(f"_p.{c}") == F.col(f"_s.{c}") for c in (*segment, "_bucket")]
    met = s.alias("_s").join(p.alias("_p"), [*on, F.col("track_id") == F.col("_k"), F.col("_s.team") == F.col("_team")])
    met = met.where((F.col("_t") <= F.col("time_s")) & (F.col("time_s") - F.col("_t") <= 0.25)).select(*[F.col(f"_s.{c}") for c in shot], "time_s", "_t", "x", "y", "_m", "_since")
    last = met.withColumn("_last", F.max(F.struct("_t", "_since")).over(W.partitionBy(*shot))["_since"]).where("_t >= _last")
    mid = last.groupBy(*shot).agg(F.median("x").alias("_x"), F.median("y").alias("_y"), F.count(F.lit(1)).alias("_n"), F.count_distinct("_m").alias("_ms"), F.collect_list(F.struct("x", "y")).alias("_all"))
    far = F.array_max(F.transform("_all", lambda q: distance(q["x"], q["y"], F.col("_x"), F.col("_y"))))
    out = shots.join(mid, shot, "left").withColumn("_far", far)
    reason = F.when(F.col("track_id").isNull() | F.col("team").isNull(), "shooter_unassigned").when(F.coalesce("_n", F.lit(0)) < 2, "ground_position_unavailable").when((F.col("_ms") > 1) | (F.col("_far") > 1.25), "unstable_ground_position")
    out = out.withColumn("origin_reason", reason).withColumn("support", F.coalesce("_n", F.lit(0)))
    fine = F.col("origin_reason").isNull()
    return out.withColumn("origin_x", F.when(fine, F.col("_x"))).withColumn("origin_y", F.when(fine, F.col("_y"))).drop("_x", "_y", "_n", "_ms", "_all", "_far")


def plan_of(shots: DataFrame, plans: DataFrame) -> DataFrame:
    """Adds ``plan``: the first camera plan of the shot's segment that contains its time, ends included. Plans are (segment_id, plan, start_s, end_s)."""
    runs = run_keys(shots)
    p = plans.select(*[F.col(c).alias(f"_{c}") for c in runs], F.col("segment_id").alias("_seg"), F.col("plan").alias("_plan"), F.col("start_s").alias("_a"), F.col("end_s").alias("_b"))
    met = shots.select(*runs, "shot_id", "segment_id", "time_s").join(p, same_keys(runs) & (F.col("segment_id") == F.col("_seg")) & (F.col("time_s") >= F.col("_a")) & (F.col("time_s") <= F.col("_b")))
    first = met.groupBy(*runs, "shot_id").agg(F.min_by("_plan", "_a").alias("plan"))
    return shots.join(first, [*runs, "shot_id"], "left")


def directed(shots: DataFrame, views: DataFrame, first_team: str) -> DataFrame:
    """Adds ``court_direction``: the view's direction (plan, period) for the first team, its opposite for the other."""
    runs = run_keys(shots)
    v = views.select(*[F.col(c).alias(f"_{c}") for c in runs], F.col("plan").alias("_plan"), F.col("period").alias("_period"), F.col("direction").alias("_d"))
    rows = shots.join(v, same_keys(runs) & (F.col("plan") == F.col("_plan")) & F.col("period").eqNullSafe(F.col("_period")), "left")
    return rows.withColumn("court_direction", F.when(F.col("team") == first_team, F.col("_d")).when(F.col("team").isNotNull(), -F.col("_d"))).drop(*[f"_{c}" for c in runs], "_plan", "_period", "_d")


def attributed(shots: DataFrame, phases: DataFrame, length: float) -> DataFrame:
    """Adds ``unassigned``, the reason for which a shooter doesn't count, and voids team, track and origin there.

    ``defensive_half``: the place is more than half a metre inside the own half.
    ``opposing_settled_attack``: a settled phase of the other team, of the same plan,
    contains the time. Phases are (run and plan, start_s, end_s, method, owner) and don't overlap;
    the last one that began by the shot is looked at.
    """
    keys = [*run_keys(shots), "plan"]
    w = W.partitionBy(*keys).orderBy("time_s", "_side").rowsBetween(W.unboundedPreceding, 0)
    span = F.struct("start_s", "end_s", "method", "owner")
    empty = F.lit(None).cast("struct<start_s:double,end_s:double,method:string,owner:string>")
    p = phases.select(*keys, F.col("start_s").alias("time_s"), F.lit(0).alias("_side"), span.alias("_span"), F.lit(None).cast("long").alias("shot_id"))
    both = p.unionByName(shots.select(*keys, "time_s", F.lit(1).alias("_side"), empty.alias("_span"), "shot_id"))
    seen = both.withColumn("_now", F.last("_span", ignorenulls=True).over(w)).where("_side = 1").select(*run_keys(shots), "shot_id", "_now")
    rows = shots.join(seen, [*run_keys(shots), "shot_id"], "left")
    attack = F.when(F.col("court_direction") == -1, length - F.col("origin_x")).when(F.col("court_direction") == 1, F.col("origin_x"))
    now = lambda c: F.col(f"_now.{c}")
    other = (F.col("time_s") < now("end_s")) & (now("method") == "settled") & (now("owner") != F.col("team"))
    reason = F.when(attack < length / 2 - HALF_MARGIN, "defensive_half").when(F.coalesce(other, F.lit(False)) & F.col("plan").isNotNull(), "opposing_settled_attack")
    rows = rows.withColumn("unassigned", F.when(F.col("team").isNotNull(), reason)).drop("_now")
    kept = F.col("unassigned").isNull()
    rows = rows.withColumn("previous_team", F.when(~kept, F.col("team")))
    for c in ("team", "track_id", "subject", "origin_x", "origin_y", "court_direction"):
        if c in rows.columns:
            rows = rows.withColumn(c, F.when(kept, F.col(c)))
    return rows.withColumn("origin_reason", F.when(kept, F.col("origin_reason")).otherwise("shooter_unassigned"))


def located(shots: DataFrame, length: float, width: float) -> DataFrame:
    """Adds ``map_x``, ``map_y`` in the attacking half (the half line at 0) and ``unlocated``, the reason why there are none."""
    turned = F.col("court_direction") == -1
    x, y = F.when(turned, length - F.col("origin_x")).otherwise(F.col("origin_x")), F.when(turned, width - F.col("origin_y")).otherwise(F.col("origin_y"))
    reason = F.when(F.col("origin_x").isNull(), F.coalesce("origin_reason", F.lit("ground_position_unavailable"))).when(F.col("court_direction").isNull(), "direction_unavailable")
    reason = reason.when(~y.between(0, width), "outside_court").when(~x.between(length / 2, length), "outside_attacking_half")
    return shots.withColumn("unlocated", reason).withColumn("map_x", F.when(reason.isNull(), x - length / 2)).withColumn("map_y", F.when(reason.isNull(), y))


def shot_counts(shots: DataFrame, roster: DataFrame) -> DataFrame:
    """Probable shots of every player of the roster (team, number), zeros included; a shot counts for a subject of its own team only."""
    named = shots.where("status = 'probable' and team is not null").groupBy("team", "subject").agg(F.count(F.lit(1)).alias("shots"))
    players = roster.select(F.col("team").alias("_team"), "number", F.concat(F.lit("roster:"), "team", F.lit(":"), "number").alias("_who"))
    return players.join(named, (F.col("_who") == F.col("subject")) & (F.col("_team") == F.col("team")), "left").select(F.col("_team").alias("team"), "number", F.coalesce("shots", F.lit(0)).alias("shots"))


def team_maps(shots: DataFrame, teams: DataFrame) -> DataFrame:
    """Per team: shots detected, probable, candidate, located and not, and ``reasons`` (why not, to count); zeros for a team without shots."""
    n = lambda c: F.count(F.when(c, 1))
    rows = shots.where("status in ('probable', 'candidate')")
    sums = rows.groupBy("team").agg(F.count(F.lit(1)).alias("detected"), n(F.col("status") == "probable").alias("probable"), n(F.col("status") == "candidate").alias("candidate"), n(F.col("unlocated").isNull()).alias("located"), n(F.col("unlocated").isNotNull()).alias("unlocated"))
    why = rows.where("unlocated is not null").groupBy("team", "unlocated").agg(F.count(F.lit(1)).alias("_n")).groupBy("team").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("unlocated", "_n")))).alias("reasons"))
    return teams.select("team").join(sums, "team", "left").join(why, "team", "left").fillna(0)


def shot_grid(shots: DataFrame, length: float, width: float, nx: int, ny: int) -> DataFrame:
    """Located shots per team and cell of the attacking half."""
    rows = shots.where("map_x is not null")
    return rows.groupBy("team", cell(F.col("map_x"), length / 2, nx).alias("cell_x"), cell(F.col("map_y"), width, ny).alias("cell_y")).agg(F.count(F.lit(1)).alias("shots"))


def shown_reasons(team_rows: DataFrame) -> DataFrame:
    """Reasons why shots have no place, in the classes that are shown: direction, half, court, and position for the rest."""
    rows = team_rows.select("team", F.explode("reasons").alias("reason", "n"))
    shown = F.coalesce(F.create_map(*[F.lit(x) for kv in SHOWN_REASONS.items() for x in kv])[F.col("reason")], F.lit("position"))
    return rows.groupBy("team", shown.alias("shown")).agg(F.sum("n").alias("n"))


def listed(shots: DataFrame, subject: Column | None = None, candidates: bool = False) -> DataFrame:
    """Shots to show, in the order of time: probable ones, or candidates too; of one subject where given."""
    rows = shots.where(F.col("status").isin("probable", "candidate") if candidates else F.col("status") == "probable")
    return (rows if subject is None else rows.where(F.col("subject") == subject)).orderBy("time_s", "shot_id")
