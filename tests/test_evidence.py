"""Known cases of the evidence and motion operators."""

import numpy as np
from pyspark.sql import functions as F

from playframe.operators import evidence, motion


def test_one_detection_per_body(spark):
    rows = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (0, 3, 0.7), (1, 1, 0.5)], "frame int, id int, confidence double")
    doubles = spark.createDataFrame([(0, 1, 2), (0, 2, 3)], "frame int, a int, b int")
    assert {(r.frame, r.id) for r in evidence.one_per_body(rows, doubles, "frame").collect()} == {(0, 1), (0, 3), (1, 1)}


def test_same_bodies(spark):
    rows = spark.createDataFrame([(0.9, 0.5, 1.0, 1.0, 0), (0.6, 0.6, 0.7, 0.05, 9), (0.1, 0.35, 0.95, 0.05, 9), (0.6, 0.6, 0.7, 0.05, 3), (0.7, 0.9, 1.0, 0.2, 17)], "m double, b double, c double, p double, n int")
    got = rows.select(evidence.same_bodies(F.col("m"), F.col("b"), F.col("c"), F.col("p"), F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == [True, True, True, False, False]


def test_two_groups_first_come_and_conflicts_latch(spark):
    samples = [(0, t, k, "hue", h, 0.0) for k, h in ((1, 10.0), (2, 100.0), (3, 12.0), (4, 50.0)) for t in (0.0, 1.0, 2.0)]
    samples += [(0, t, 1, "hue", 100.0, 0.0) for t in (3.0, 4.0, 5.0)] + [(0, 6.0, 1, "hue", 10.0, 0.0), (0, 2.1, 2, "hue", 10.0, 0.0), (0, 2.6, 2, "hue", 10.0, 0.5)]
    rows = spark.createDataFrame(samples, "run int, time_s double, track_id int, kind string, hue double, overlap double")
    got = {(r.track_id, r.time_s): (r.team_group, r.conflict) for r in evidence.group_colors(rows, ["run"]).collect()}
    assert [got[k, 2.0][0] for k in (1, 2, 3, 4)] == ["team_1", "team_2", "team_1", None]
    assert got[1, 5.0] == (None, True) and (1, 6.0) not in got and (2, 2.1) not in got


def test_names_are_carried_both_ways_until_they_disagree(spark):
    bodies = [(0, i, i * 0.1, k, n, t, c) for i, k, n, t, c in (
        (0, 1, "A", "home", None), (1, 1, None, None, None), (2, 1, None, None, "away"), (3, 1, None, None, None), (0, 2, "B", "home", None), (1, 2, None, None, None), (2, 2, "C", "home", None), (0, 3, None, None, None), (1, 3, "D", "home", None),
    )]
    links = [(0, i, k, k) for k in (1, 2, 3) for i in (1, 2, 3)]
    got = evidence.carried_names(spark.createDataFrame(bodies, "segment_id int, frame_index long, time_s double, track_id int, name string, team string, color string"), spark.createDataFrame(links, "segment_id int, frame_index long, from_track int, to_track int"), ["segment_id"])
    assert {(r.frame_index, r.track_id, r.name) for r in got.collect()} == {(1, 1, "A"), (0, 3, "D")}


def test_bridged_spans(spark):
    box = lambda x: [x, 0.0, x + 20, 100.0]
    rows = [(1, i, i * 0.1, box(x), False, c) for i, x, c in ((0, 0.0, "r"), (1, 1.0, None), (3, 5.0, "r"), (4, 6.0, "b"), (6, 8.0, "r"), (12, 9.0, "r"))]
    got = evidence.bridged_spans(spark.createDataFrame(rows, "track int, frame_index long, timestamp_s double, box array<double>, scene_cut boolean, color string"), ["track"]).orderBy("frame_index")
    assert [r.span for r in got.collect()] == [0, 0, 0, 0, 1, 2]


def test_homography_is_found_under_outliers(spark):
    rng = np.random.default_rng(1)
    m = np.array([[0.05, 0.001, -1.0], [0.002, 0.06, -2.0], [0.0001, 0.0002, 1.0]])
    rows = []
    for k, bad in ((0, 0), (1, 12)):
        p = rng.uniform(0, 640, (30, 2))
        q = np.column_stack([p, np.ones(30)]) @ m.T
        q = q[:, :2] / q[:, 2:]
        q[:bad] += rng.uniform(5, 20, (bad, 2))
        rows += [(k, *map(float, a), *map(float, b)) for a, b in zip(p, q)]
    rows += [(2, float(i), 1.0, 1.0, 1.0) for i in range(3)]
    got = {r.k: r for r in motion.fitted_homographies(spark.createDataFrame(rows, "k int, x double, y double, u double, v double"), ["k"], 0.05).collect()}
    assert np.allclose(got[0].matrix, m.reshape(-1), atol=1e-9) and got[0].inliers == 30
    assert np.allclose(got[1].matrix, m.reshape(-1), atol=1e-6) and got[1].inliers == 18
    assert got[2].matrix is None and got[2].points == 3


def test_tracks_survive_a_weak_frame_and_a_miss(spark):
    rows = []
    for i in range(20):
        for body, x in ((1, 100.0 + 3 * i), (2, 400.0 - 2 * i)):
            if body == 2 and i in (8, 9):
                continue
            score = 0.15 if body == 1 and i == 5 else 0.9
            rows.append((0, i, body + 10 * i, score, x, 50.0, x + 40, 150.0, False))
    rows += [(0, i, 900 + i, 0.9, 250.0, 50.0, 290.0, 150.0, False) for i in (12,)]
    found = {r.id: r.track_id for r in motion.tracked(spark.createDataFrame(rows, "run int, frame_index long, id int, score double, x1 double, y1 double, x2 double, y2 double, reset boolean"), ["run"]).collect()}
    assert len({found[1 + 10 * i] for i in range(20)}) == 1
    assert len({found[2 + 10 * i] for i in range(20) if i not in (8, 9)}) == 1
    assert found[1] != found[2] and found[912] is None


def test_peak_of_the_largest_region(spark):
    cells = [0.0] * 24
    for i in (0, 9, 10, 16, 17):  # width 8: one cell, and two rows of two
        cells[i] = 0.9
    (a, b) = motion.peaks(spark.createDataFrame([(1, cells), (2, [0.0] * 24)], "k int, cells array<double>"), ["k"], 8).orderBy("k").collect()
    assert (a.x, a.y) == (1.5, 1.5) and b.x is None


SAMPLE = """segment_id long, frame_index long, time_s double, scene_cut boolean, x double, y double, court array<double>, rims array<array<double>>,
  track long, role string, team string, subject string, distance double, height double, raised boolean, ambiguous boolean, unique boolean"""


def thrown(segment, landing=True, held=False, pan=0.0):
    """A ball at a raised hand for five frames, then on a parabola to the rim; with ``pan`` the camera moves."""
    rows = []
    for i in range(40):
        t = max(0.0, (i - 4) / 30)
        x, y = (400 + 360 * t, 300 - 500 * t + 600 * t * t) if not held else (400.0, 300.0)
        hand = i < 5 or held
        court = [1.0, 0.0, -pan * i, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
        rim = [[400 + 360 * 0.9 + pan * i, 300 - 500 * 0.9 + 600 * 0.81]] if landing else None
        rows.append((segment, i, i / 30, False, x + pan * i, y, court, rim, 7 if hand else None, "player" if hand else None, "a" if hand else None, "roster:a:7" if hand else None, 0.1 if hand else None, 100.0 if hand else None, hand or None, False if hand else None, hand or None))
    return rows


def test_a_throw_is_one_shot_and_a_held_ball_none(spark):
    from playframe.operators import flights, shots

    rows = thrown(0) + thrown(1, held=True) + thrown(2, pan=3.0) + thrown(3, landing=False)
    found = flights.flights(spark.createDataFrame(rows, SAMPLE))
    got = {r.segment_id: r for r in shots.one_event(found.withColumn("shot_id", F.monotonically_increasing_id()), ["segment_id"]).collect()}
    assert got.keys() == {0, 2, 3}
    assert got[0].status == "probable" and abs(got[0].time_s - 4 / 30) < 0.1 and got[0].track == 7 and got[0].error < 1e-6
    assert abs(got[0].curvature - 12.0) < 1e-6 and got[0].rim and got[0].support >= 2
    assert abs(got[2].rise - got[0].rise) < 1e-6 and got[2].status == "probable"
    assert got[3].status == "candidate" and not got[3].rim


def test_keys_side_by_side_are_tracked_as_each_alone(spark):
    import numpy as np
    import pandas as pd

    rng, parts = np.random.default_rng(5), []
    for run in range(6):
        frames = np.sort(rng.integers(0, 40, 160 + 20 * run))
        x, y = rng.integers(0, 4, len(frames)) * 18.0 + rng.normal(0, 3, len(frames)), rng.normal(0, 3, len(frames))  # crowded: boxes of 40 by 100
        parts.append(pd.DataFrame({"run": run, "frame_index": frames, "id": np.arange(len(frames)), "score": rng.uniform(0.05, 1, len(frames)), "x1": x, "y1": y, "x2": x + 40, "y2": y + 100, "reset": frames == 20}))
    rows, limits = pd.concat(parts), (0.25, 0.1, 0.25, 0.8, 3)
    alone = np.concatenate([motion.followed(np.zeros(len(p), int), p, *limits) for p in parts])
    assert (motion.followed(rows["run"].to_numpy(), rows, *limits) == alone).all() and len(set(alone)) > 20
    found = motion.tracked(spark.createDataFrame(rows), ["run"], *limits).orderBy("run", "id").collect()
    assert [r.track_id or 0 for r in found] == alone.tolist()
