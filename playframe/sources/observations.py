"""Frame observations as JSON Lines: schema, reading, flattening and staged publication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playframe.functions import tracking

POINTS = "ARRAY<ARRAY<DOUBLE>>"
PERSON = (
    "observation_id: STRING, role: STRING, bbox: ARRAY<DOUBLE>, confidence: DOUBLE, track_id: BIGINT, detection_index: INT, display_color: STRING, position_m: ARRAY<DOUBLE>, position_status: STRING, "
    "ground_point_px: ARRAY<DOUBLE>, ground_point_method: STRING, jersey_number_suppressed: BOOLEAN, majority_jersey_number: STRING, resolved_team_id: STRING, "
    "resolved_identity: STRUCT<team_id: STRING, team_name: STRING, number: STRING, player_name: STRING, resolution_method: STRING>, "
    "jersey: STRUCT<number: STRING, status: STRING, identity_status: STRING, team_id: STRING, player_name: STRING, votes: INT, agreement: DOUBLE, team_group: STRING, team_group_conflict: BOOLEAN>, "
    f"pose: STRUCT<format: STRING, coordinate_space: STRING, keypoints: {POINTS}, scores: ARRAY<DOUBLE>, valid: ARRAY<BOOLEAN>>, "
    "segmentation: STRUCT<status: STRING, quality_score: DOUBLE, mask: STRUCT<encoding: STRING, roi: ARRAY<INT>, counts: ARRAY<INT>>>"
)
OBSERVATION = (
    "schema_version INT, artifact_type STRING, run_id STRING, frame_index BIGINT, timestamp_s DOUBLE, segment_id BIGINT, scene_cut BOOLEAN, included BOOLEAN, width INT, height INT, coordinate_space STRING, distance_unit STRING, "
    f"persons ARRAY<STRUCT<{PERSON}>>, ball STRUCT<status: STRING, position_px: ARRAY<DOUBLE>, confidence: DOUBLE>, "
    f"court STRUCT<status: STRING, image_to_court: {POINTS}, support_polygon_m: {POINTS}>, stages MAP<STRING, STRUCT<status: STRING, reason: STRING>>"
)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """One row per frame. A malformed line raises; fields that a line lacks are null.

    ``person_keys`` lists the fields each person has: for two of them, a voted number and
    a group's team, null is a decision and absence is none.
    """
    lines = spark.read.text(path)
    keys = F.transform(F.from_json(F.get_json_object("value", "$.persons"), "ARRAY<MAP<STRING, STRING>>"), lambda p: F.map_keys(p))
    return lines.select(F.from_json("value", OBSERVATION, {"mode": "FAILFAST"}).alias("_f"), keys.alias("person_keys")).select("_f.*", "person_keys")


def persons(frames: DataFrame) -> DataFrame:
    """One row per person and frame: ``person_index``, court coordinates ``x``, ``y``, ``suppressed``, ``named`` (team and number, or null) and ``team``."""
    keys = F.col("person_keys") if "person_keys" in frames.columns else F.transform("persons", lambda _: F.array().cast("array<string>"))
    rows = frames.withColumn("_keys", keys).select(*[c for c in frames.columns if c not in ("persons", "person_keys")], "_keys", F.posexplode("persons").alias("person_index", "_p"))
    rows = rows.withColumn("_k", F.get("_keys", F.col("person_index"))).select(*[c for c in rows.columns if c not in ("_p", "_keys")], "_k", "_p.*")
    c, has = F.col, lambda k: F.array_contains("_k", k)
    jersey = [c(f"jersey.{n}") for n in ("status", "identity_status", "team_id", "number")]
    named = tracking.identity(c("jersey_number_suppressed"), c("resolved_identity.team_id"), c("resolved_identity.number"), has("majority_jersey_number"), *jersey)
    team = tracking.team(c("jersey.team_group_conflict"), c("resolved_identity.team_id"), has("resolved_team_id"), c("resolved_team_id"), has("majority_jersey_number"), jersey[0], jersey[2])
    rows = rows.withColumn("x", F.get("position_m", F.lit(0))).withColumn("y", F.get("position_m", F.lit(1)))
    return rows.withColumn("suppressed", F.coalesce("jersey_number_suppressed", F.lit(False))).withColumn("named", named).withColumn("team", team).drop("_k")


def violations(frames: DataFrame) -> DataFrame:
    """Broken rules per frame: ``frame_index`` and ``rule``; a sound table gives no rows."""
    ids, tracks = F.col("persons.observation_id"), F.filter(F.col("persons.track_id"), lambda t: t.isNotNull())
    rules = {
        "negative_frame_index": F.col("frame_index") < 0,
        "non_finite_time": F.isnan("timestamp_s") | (F.abs("timestamp_s") == float("inf")),
        "repeated_observation_id": F.size(ids) != F.size(F.array_distinct(ids)),
        "repeated_track_id": F.size(tracks) != F.size(F.array_distinct(tracks)),
        "confidence_range": F.exists("persons", lambda p: (p["confidence"] < 0) | (p["confidence"] > 1)),
        "box_order": F.exists("persons", lambda p: (p["bbox"][0] >= p["bbox"][2]) | (p["bbox"][1] >= p["bbox"][3])),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return frames.select("frame_index", F.explode(found).alias("rule"))


def publish(df: DataFrame, path: str) -> None:
    """Write Parquet beside ``path``, then put it in its place: never a partial table, but for a moment between two renames none.

    If the second rename fails the old table is put back. ``runs.publish`` leaves no such
    moment: it moves a pointer.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, staged, old = (hadoop(p) for p in (path, f"{path}.staged-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"))
    df.write.parquet(staged.toString())
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    replaced = store.exists(target)
    if replaced and not store.rename(target, old):
        raise OSError(f"could not move {path} aside")
    if not store.rename(staged, target):
        if replaced:
            store.rename(old, target)
        raise OSError(f"could not publish {path}")
    if replaced:
        store.delete(old, True)
