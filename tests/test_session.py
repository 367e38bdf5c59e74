"""The façade: what recompute gives equals its parts, is made once, and doesn't mix runs."""

import pytest
from pyspark.sql import functions as F

from playframe import session
from playframe.operators import observed

PERSONS = "run_id int, segment_id int, track_id int, frame_index long, timestamp_s double, included boolean, role string, x double, y double, position_status string, ground_point_method string, box array<double>, color string"


def tables(spark):
    """Two runs: a player read on track 2, whose track is 1 before, and one of the other team; in run 1 everything is a metre to the right."""
    rows, reads = [], []
    for run in (0, 1):
        for i in range(16):
            for track, x, color in ((1 if i < 8 else 2, 5.0 + 0.05 * i, "home"), (3, 20.0 - 0.1 * i, "away")):
                px = 100.0 + i if track != 3 else 600.0
                rows.append((run, 0, track, i, i / 10, True, "player", x + run, 4.0, "projected", "feet", [px - 10, 0.0, px + 10, 100.0], color))
        reads += [(run, 0, 2, i, "7", 0.97) for i in (8, 10, 12, 14)]
    persons = spark.createDataFrame(rows, PERSONS)
    frames = persons.select("run_id", "segment_id", "frame_index", "timestamp_s", "included").distinct().withColumn("scene_cut", F.lit(False))
    roster = spark.createDataFrame([("home", "7", "A"), ("away", "7", "B"), ("away", "9", "C")], "team string, number string, name string")
    return {"persons": persons, "frames": frames, "reads": spark.createDataFrame(reads, "run_id int, segment_id int, track_id int, frame_index long, number string, confidence double"), "roster": roster}


def test_recompute_names_both_pieces_and_measures_them_as_one(spark, tmp_path):
    own = session.Session(spark, tables(spark), str(tmp_path), tau=0.0, deadband=0.0)
    made = own.recompute()
    known = {(r.run_id, r.track_id, r.source): r.n for r in made["known"].groupBy("run_id", "track_id", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert known == {(run, k, s): 8 for run in (0, 1) for k, s in ((1, "backward"), (2, "direct"))}
    stats = {(r.run_id, r.subject): r for r in made["statistics"].collect()}
    assert {k for k in stats if k[0] == 0} == {(0, "roster:home:7"), (0, "anonymous-s0-t3")}
    assert stats[0, "roster:home:7"].distance == pytest.approx(0.05 * 14) and len(stats[1, "roster:home:7"].tracks) == 2
    again = session.Session(spark, tables(spark), str(tmp_path), tau=0.0, deadband=0.0)
    assert sorted(map(str, again.recompute()["statistics"].collect())) == sorted(map(str, made["statistics"].collect()))
    assert len(list((tmp_path / "names").glob("attempt-*"))) == 1


def test_parts_equal_the_whole_and_one_run_what_it_is_among_others(spark, tmp_path):
    own = session.Session(spark, tables(spark), str(tmp_path))
    made = own.recompute()
    parts = observed.statistics(observed.contributions(own._named(made["known"]), tau=0.12, deadband=0.025))
    pick = lambda df: sorted((r.run_id, r.subject, None if r.distance is None else round(r.distance, 9), round(r.measured, 9), r.status) for r in df.collect())
    assert pick(made["statistics"]) == pick(parts)
    assert pick(own.run(1).recompute()["statistics"]) == [r for r in pick(parts) if r[0] == 1]


def test_questions(spark, tmp_path):
    own = session.Session(spark, tables(spark), str(tmp_path), tau=0.0, deadband=0.0)
    assert [(r.run_id, r.frames, r.segments) for r in own.runs().orderBy("run_id").collect()] == [(0, 16, 1), (1, 16, 1)]
    page = own.frames(3, 2).collect()
    assert [(r.run_id, r.frame_index, len(r.persons)) for r in page] == [(0, 3, 2), (0, 4, 2), (1, 3, 2), (1, 4, 2)]
    assert own.reads(track=2).count() == 8
    grid, totals = own.heatmap(subject="roster:home:7")
    assert {r.run_id: round(r.observed, 6) for r in totals.collect()} == {0: 1.4, 1: 1.4} and grid.count() > 0
    moved, _ = own.heatmap(team="away", metric="movement", start=0.5, end=1.0)
    assert {r.run_id: round(r.m, 6) for r in moved.groupBy("run_id").agg(F.sum("mass").alias("m")).collect()} == {0: 0.5, 1: 0.5}
    assert own.leaderboard(10).where("run_id = 0").first().subject == "anonymous-s0-t3"
    for wrong in ({}, {"team": "home", "subject": "roster:home:7"}, {"team": "home", "metric": "speed"}, {"team": "home", "start": 3.0, "end": 2.0}, {"subject": "roster:home:8"}):
        with pytest.raises(ValueError):
            own.heatmap(**wrong)
    with pytest.raises(ValueError, match="lacks"):
        session.Session(spark, tables(spark) | {"roster": spark.range(1)}, str(tmp_path))
