"""Small functions that no registered query runs: one known case each."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from playframe.functions import geometry, text, tracking
from playframe.operators import contracts, evaluation, evidence, frames, play, shots
from playframe.sources import exports, runs


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_frames(spark):
    own = spark.createDataFrame([(0, 0.0, False), (1, 0.1, False), (2, 0.2, False), (3, 0.3, True)], "frame_index long, timestamp_s double, r boolean")
    cut = frames.forced_cuts(own.withColumn("k", F.lit(1)), ["k"], F.array(F.lit(0.15)), F.col("r"))
    assert [r.frame_index for r in cut.where("forced_cut").orderBy("frame_index").collect()] == [2, 3]
    assert rows(frames.at_frame(own, 2).select("frame_index")) == [(2,)]
    built = spark.createDataFrame([(9, 0.9)], "frame_index long, timestamp_s double")
    assert [r.frame_index for r in frames.appended(own, built, F.col("frame_index") >= 2).orderBy("frame_index").collect()] == [0, 1, 9]


def test_proposals_fill_what_nobody_has_annotated(spark):
    cached = spark.createDataFrame([(1, "done"), (2, "unannotated"), (3, "unannotated")], "frame int, status string")
    new = spark.createDataFrame([(1, "p"), (2, "p"), (4, "p")], "frame int, status string")
    assert rows(frames.added_proposals(cached, new, "frame")) == sorted([(1, "done", False), (2, "p", True), (3, "unannotated", False), (4, "p", True)], key=str)


def test_targets_of_all_models(spark):
    windows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "b"), (3, "a")], "t int, model string")
    assert rows(frames.common_targets(windows, ["t"], "model")) == [(1,), (3,)]


def test_predictions_and_ranks(spark):
    found = spark.createDataFrame([(1, i, 0.5 - i / 100, -5.0, 0.0, 10.0 if i else 0.0, 99.0) for i in range(4)] + [(1, 9, 0.0, 0.0, 0.0, 5.0, 5.0)], "f int, id int, score double, x1 double, y1 double, x2 double, y2 double")
    kept = evaluation.usable_predictions(found, "f", 50.0, 60.0, most=2).orderBy("id").collect()
    assert [(r.id, r.x1, r.x2, r.y2) for r in kept] == [(1, 0.0, 10.0, 60.0), (2, 0.0, 10.0, 60.0)]
    ranked = evaluation.rank_runs(spark.createDataFrame([("p", 1, 0.5), ("p", 2, 0.7), ("p", 3, 0.5), ("q", 4, None)], "protocol string, id int, m double"), "protocol", ["m"])
    assert {r.id: r["rank"] for r in ranked.collect()} == {1: 2, 2: 1, 3: 2, 4: 1}


def test_annotations(spark):
    good = "a" * 64
    found = spark.createDataFrame([(1, "a/b.png", good, "new"), (2, "../b.png", good, "new"), (3, "/b.png", "A" * 64, "odd")], "id int, path string, sha string, state string")
    assert rows(contracts.annotation_violations(found, ["id"], "path", "sha", ["new"], "state")) == [(2, "path"), (3, "hash"), (3, "path"), (3, "state")]


def test_counts_and_timelines(spark):
    found = evidence.status_counts(spark.createDataFrame([(1, "ok"), (1, "ok"), (1, "off")], "k int, s string"), ["k"], "s").first()
    assert found.counts == {"ok": 2, "off": 1}
    spans = spark.createDataFrame([(0, 0.0, 0.1, "a"), (0, 0.1, 0.2, "a"), (0, 0.2, 0.3, None), (0, 0.3, 0.4, "a"), (0, 0.4, 0.5, "b")], "run int, start double, end double, owner string").withColumns({"plan": F.lit(0), "period": F.lit(1), "direction": F.lit(1), "method": F.lit("settled")})
    assert rows(play.timeline(spans, ["run"]).select("owner", "start", "end")) == [("a", 0.0, 0.2), ("a", 0.3, 0.4), ("b", 0.4, 0.5)]
    assert rows(play.uncertain(spans, ["run"]).select("start", "end")) == [(0.2, 0.3)]


SHOTS = "run_id int, shot_id long, segment_id int, time_s double, team string, subject string, status string, map_x double, map_y double, unlocated string"


def test_shots(spark):
    own = spark.createDataFrame([(0, 1, 0, 1.0, "a", "roster:a:7", "probable", 3.0, 4.0, None), (0, 2, 0, 2.0, "a", "roster:a:7", "candidate", None, None, "direction_unavailable"), (0, 3, 0, 9.0, "b", "roster:a:7", "probable", None, None, "odd"), (1, 1, 0, 1.5, "a", "roster:a:8", "probable", 3.5, 4.5, None)], SHOTS)
    plans = spark.createDataFrame([(0, 0, 5, 0.0, 1.0), (0, 0, 6, 1.0, 4.0), (1, 0, 7, 0.0, 9.0)], "run_id int, segment_id int, plan int, start_s double, end_s double")
    assert {(r.run_id, r.shot_id): r.plan for r in shots.plan_of(own, plans).collect()} == {(0, 1): 5, (0, 2): 6, (0, 3): None, (1, 1): 7}
    roster = spark.createDataFrame([("a", "7"), ("a", "8"), ("a", "9")], "team string, number string")
    assert {r.number: r.shots for r in shots.shot_counts(own, roster).collect()} == {"7": 1, "8": 1, "9": 0}
    assert rows(shots.shot_grid(own, 20.0, 10.0, 10, 10).select("team", "cell_x", "cell_y", "shots")) == [("a", 3, 4, 2)]
    maps = shots.team_maps(own, spark.createDataFrame([("a",), ("b",)], "team string"))
    assert rows(shots.shown_reasons(maps)) == [("a", "direction", 1), ("b", "position", 1)]
    assert [r.shot_id for r in shots.listed(own.where("run_id = 0")).collect()] == [1, 3] and shots.listed(own, F.lit("roster:a:7"), candidates=True).count() == 3


def test_shot_directions_and_attribution_keep_runs_apart(spark):
    own = spark.createDataFrame([(r, 1, 5, 2.0, "a", 1, 12.0, 4.0, None) for r in (0, 1)], "run_id int, shot_id long, plan int, time_s double, team string, period int, origin_x double, origin_y double, origin_reason string")
    views = spark.createDataFrame([(0, 5, 1, 1), (1, 5, 1, -1)], "run_id int, plan int, period int, direction int")
    directed = shots.directed(own, views, "a")
    assert {r.run_id: r.court_direction for r in directed.collect()} == {0: 1, 1: -1}
    phases = spark.createDataFrame([(1, 5, 1.0, 3.0, "settled", "b")], "run_id int, plan int, start_s double, end_s double, method string, owner string")
    got = {r.run_id: r.unassigned for r in shots.attributed(directed, phases, 24.0).collect()}
    assert got == {0: None, 1: "opposing_settled_attack"}


def test_files(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    runs.write_csv(table, str(tmp_path / "csv"))
    assert rows(runs.read_csv(spark, str(tmp_path / "csv"), "n int, t string")) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="(?i)malformed|fail"):
        runs.read_csv(spark, str(tmp_path / "csv"), "n int, t int").collect()
    images = spark.createDataFrame([("x", "train"), ("y", "val")], "image string, split string")
    exports.write_labels(spark.createDataFrame([("x", "0 0.5 0.5 1 1")], "image string, text string"), images, "image", "split", str(tmp_path / "labels"))
    assert rows(spark.read.parquet(str(tmp_path / "labels")).select("image", "text", "split")) == [("x", "0 0.5 0.5 1 1", "train"), ("y", "", "val")]


def test_columns(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert [value(exports.keypoint_visibility(F.lit(x))) for x in (True, False, None)] == [1, 2, 2]
    assert value(text.canonical_sha256(text.sorted_map(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(None).cast("int"))))) == hashlib.sha256(json.dumps({"a": None, "b": 1}, separators=(",", ":")).encode()).hexdigest()
    assert value(text.label(F.lit("  two   words "))) == "two words" and value(text.label(F.lit("x" * 65))) is None
    color = lambda role, team, group: value(tracking.person_color(F.lit(role), F.lit(team), F.lit(group), "#ff", "#77"))
    assert [color("referee", "#1", None), color("coach", "#1", None), color("player", "#1", "#2"), color("player", None, "#2"), color("player", None, None)] == ["#ff", "#77", "#1", "#2", "#77"]
    x, y = geometry.uncrop(F.lit(96.0), F.lit(128.0), F.array(*[F.lit(v) for v in (10.0, 20.0, 30.0, 80.0)]))
    assert (value(x), value(y)) == (20.0, 50.0)
