"""Contracts of the artifacts as violations: one row per broken rule, none for sound data.

Rules of one row are an array of names built in one pass; rules between rows are
counts. ``strict`` turns any violation into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playframe.functions.geometry import mask_valid
from playframe.functions.tracking import finite, run_keys

STATUSES = ("ok", "partial", "unavailable", "disabled", "failed")
#: Paths and hashes that annotations may carry.
SAFE_PATH = r"^(?!/)(?!.*(^|/)\.\.(/|$))[A-Za-z0-9._/ -]+\z"
SHA256 = r"^[0-9a-f]{64}\z"


def _broken(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition isn't true; unknown is not true."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def point_ok(p: Column, n: int) -> Column:
    return (F.size(p) == n) & F.forall(p, finite)


def frame_violations(frames: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``rule`` of frames in the observation schema: version, indexes, time, units, size, persons, ball, court and stages."""
    p, ball = F.col("persons"), F.col("ball")
    every = lambda f: F.forall(F.coalesce(p, F.array().cast(frames.schema["persons"].dataType)), f)
    unique = lambda field: F.size(F.array_distinct(F.filter(F.transform(p, lambda x: x[field]), lambda v: v.isNotNull()))) == F.size(F.filter(F.transform(p, lambda x: x[field]), lambda v: v.isNotNull()))
    has = lambda name: name in frames.schema["persons"].dataType.elementType.names
    box = lambda b: point_ok(b, 4) & (b[0] >= 0) & (b[0] < b[2]) & (b[2] <= F.col("width")) & (b[1] >= 0) & (b[1] < b[3]) & (b[3] <= F.col("height"))
    rules = {
        "version": (F.col("schema_version") == 1) & (F.col("artifact_type") == "video_observation"),
        "frame_index": F.col("frame_index") >= 0, "segment_id": F.col("segment_id") >= 0, "timestamp": finite(F.col("timestamp_s")) & (F.col("timestamp_s") >= 0),
        "units": (F.col("coordinate_space") == "source_pixels") & (F.col("distance_unit") == "m"), "size": (F.col("width") >= 1) & (F.col("height") >= 1),
        "observation_id": unique("observation_id"), "role": every(lambda x: F.coalesce(x["role"].isin("player", "referee", "unknown"), F.lit(False))),
        "box": every(lambda x: F.coalesce(box(x["bbox"]), F.lit(False))), "track": unique("track_id") & every(lambda x: F.coalesce(x["track_id"] >= 1, F.lit(True))),
        "position": every(lambda x: x["position_m"].isNull() | point_ok(x["position_m"], 2)), "confidence": every(lambda x: F.coalesce(x["confidence"].between(0, 1), F.lit(False))),
        "ball": ball["position_px"].isNull() | (point_ok(ball["position_px"], 2) & (ball["position_px"][0] >= 0) & (ball["position_px"][0] < F.col("width")) & (ball["position_px"][1] >= 0) & (ball["position_px"][1] < F.col("height"))),
        "ball_confidence": ball["confidence"].isNull() | ball["confidence"].between(0, 1),
    }
    if has("jersey"):
        rules["jersey_number"] = every(lambda x: x["jersey"]["number"].isNull() | x["jersey"]["number"].rlike(r"^[0-9]{1,2}\z"))
    if has("pose"):
        rules["pose"] = every(lambda x: x["pose"].isNull() | ((x["pose"]["format"] == "coco17") & (F.size(x["pose"]["keypoints"]) == 17) & F.forall(x["pose"]["keypoints"], lambda k: k.isNull() | point_ok(k, 2))))
    if has("segmentation"):
        rules["mask"] = every(lambda x: x["segmentation"].isNull() | (x["segmentation"]["status"].isin("ok", "empty") & mask_valid(x["segmentation"]["mask"]["encoding"], x["segmentation"]["mask"]["roi"], x["segmentation"]["mask"]["counts"], F.col("width"), F.col("height"))))
    if "court" in frames.columns:
        m = F.col("court.image_to_court")
        rules["court"] = m.isNull() | ((F.size(m) == 3) & F.forall(m, lambda r: point_ok(r, 3)))
    if "stages" in frames.columns:
        rules["stage"] = F.forall(F.map_values(F.coalesce("stages", F.create_map().cast(frames.schema["stages"].dataType))), lambda s: F.coalesce(s["status"].isin(*STATUSES), F.lit(False)))
    return frames.select(*keys, F.explode(_broken(rules)).alias("rule"))


def statistics_violations(stats: DataFrame) -> DataFrame:
    """Subjects whose totals contradict each other, and subjects that come twice."""
    key = [*run_keys(stats), "subject"]
    d, m, t = F.col("distance"), F.col("measured"), F.col("tracked")
    rules = {
        "measured_within_tracked": (m >= 0) & (m <= t + 1e-9), "distance_needs_measured": d.isNull() | ((d >= 0) & (m > 0)),
        "unavailable_is_null": d.isNull() == (F.col("status") == "unavailable"), "unique_subject": F.count(F.lit(1)).over(W.partitionBy(*key)) == 1,
    }
    return stats.select(*key, _broken(rules).alias("_r")).select(*key, F.explode("_r").alias("rule"))


def sequence_violations(persons: DataFrame, run: str | Column) -> DataFrame:
    """Per frame: tracks or identities that stand on several rows, and identities on rows where they are suppressed; ids that aren't run:frame:n."""
    key = [*run_keys(persons), "frame_index"]
    run = F.lit(run) if isinstance(run, str) else run
    twice = lambda c, rule: persons.where(F.col(c).isNotNull()).groupBy(*key, c).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*key, F.lit(rule).alias("rule"))
    hidden = persons.where(F.col("suppressed") & F.col("named").isNotNull()).select(*key, F.lit("suppressed_identity").alias("rule"))
    ids = persons.where(~F.coalesce(F.col("observation_id") == F.concat_ws(":", run, F.col("frame_index").cast("string"), F.col("n").cast("string")), F.lit(False))).select(*key, F.lit("observation_id").alias("rule"))
    return twice("track_id", "repeated_track").union(twice("named", "repeated_identity")).union(hidden).union(ids)


def time_mismatches(frames: DataFrame, expected: DataFrame) -> DataFrame:
    """Frames whose time isn't the expected one, on either side; missing ones have a null."""
    key = [*run_keys(frames), "frame_index"]
    both = frames.select(*key, "timestamp_s").join(expected.select(*key, F.col("timestamp_s").alias("expected_s")), key, "full")
    return both.where(~F.col("timestamp_s").eqNullSafe(F.col("expected_s")))


def fingerprints(rows: DataFrame, keys: list[str], fixed: list[str]) -> DataFrame:
    """Per row of ``keys`` a SHA-256 of the columns that must not change; equal tables have equal sets of (keys, fingerprint)."""
    return rows.select(*keys, F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(fixed)]), {"ignoreNullFields": "false"}), 256).alias("fingerprint"))


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str], fixed: list[str]) -> DataFrame:
    """Keys whose fixed columns differ between two versions, or that only one has."""
    a, b = (fingerprints(df, keys, fixed).withColumnRenamed("fingerprint", n) for df, n in ((before, "_a"), (after, "_b")))
    return a.join(b, keys, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def annotation_violations(rows: DataFrame, keys: list[str], path: str, digest: str, states: list[str], state: str) -> DataFrame:
    """Annotations with an unsafe path, a malformed hash or an unknown review state."""
    rules = {"path": F.col(path).rlike(SAFE_PATH), "hash": F.col(digest).rlike(SHA256), "state": F.col(state).isin(*states)}
    return rows.select(*keys, F.explode(_broken(rules)).alias("rule"))


def all_or_nothing(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows in which some but not all of the columns are null."""
    n = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return rows.where((n > 0) & (n < len(columns))).select(*keys, F.lit("all_or_nothing").alias("rule"))


def roster_violations(roster: DataFrame) -> DataFrame:
    """``team`` and ``rule`` of a roster (team, number, eligible): exactly two teams, numbers that are one or two digits and unique in their team, somebody eligible in each."""
    teams = roster.groupBy("team").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("number").alias("_numbers"), F.sum(F.coalesce(F.col("eligible"), F.lit(True)).cast("int")).alias("_able"), F.min(F.coalesce(F.col("number").rlike(r"^[0-9]{1,2}\z"), F.lit(False)).cast("int")).alias("_digits"))
    two = F.count(F.lit(1)).over(W.partitionBy()) == 2
    rules = {"two_teams": two, "unique_numbers": F.col("_n") == F.col("_numbers"), "eligible": F.col("_able") >= 1, "numbers": F.col("_digits") == 1}
    return teams.select("team", _broken(rules).alias("_r")).select("team", F.explode("_r").alias("rule"))


def strict(violations: DataFrame) -> None:
    """Raise with the first violations, if there are any."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError("; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in found))
