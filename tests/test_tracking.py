"""Known cases of the tracking operators: scripted runs, small scenes, and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from playframe.operators import contracts, evaluation, frames, heatmaps, identity, observed, play, scoreboard, shots
from playframe.sources import demo, exports, runs

PERSON = "frame_index long, timestamp_s double, segment_id int, included boolean, track_id int, role string, x double, y double, position_status string, ground_point_method string, named struct<team: string, number: string>"


def person(i, x=0.0, y=0.0, t=None, segment=0, track=1, role="player", status="projected", method="feet", named=None, included=True):
    return (i, i * 0.1 if t is None else t, segment, included, track, role, x, y, status, method, named)


def totals(spark, rows, **how):
    found = observed.statistics(observed.contributions(spark.createDataFrame(rows, PERSON), **({"tau": 0.0, "deadband": 0.0} | how)))
    return {r.subject: r for r in found.collect()}


def close(a, b):
    return a == b if a is None or b is None else math.isclose(a, b, abs_tol=1e-9)


def test_scripted_run_has_the_known_totals(spark):
    found = observed.statistics(observed.contributions(demo.demo_persons(spark), tau=0.0, deadband=0.0)).collect()
    assert len(found) == 6
    for r in found:
        assert round(r.distance, 8) == 0.93975936 and round(r.tracked, 6) == 5.933333 and round(r.measured, 6) == 5.333333 and round(r.coverage, 9) == 0.898876404
        assert r.status == "partial" and r.excluded == {"implausible_speed": 2, "calibration_unavailable": 15, "projected": 1} and len(r.tracks) == 2


A = ("a", "7")
CASES = {
    "known line": ([person(i, 0.1 * i) for i in range(11)], {}, {"anonymous-s0-t1": (1.0, 1.0, "ok", {})}),
    "deadband": ([person(i, 0.01 * (-1) ** i) for i in range(100)], {"tau": 0.12, "deadband": 0.03}, {"anonymous-s0-t1": (0.0, 1.0, "ok", {})}),
    "missing position": ([person(i, x) for i, x in enumerate((0.0, 0.1, None, 0.3, 0.4))], {}, {"anonymous-s0-t1": (0.2, 0.5, "partial", {"projected": 2})}),
    "missing detection": ([person(i, 0.1 * i) for i in (0, 1, 3, 4)], {}, {"anonymous-s0-t1": (0.2, 1.0, "ok", {"tracking_gap": 1})}),
    "cuts": ([person(i, x, segment=s, named=A) for i, (x, s) in enumerate(((0.0, 0), (0.1, 0), (10.0, 1), (10.1, 1)))], {}, {"roster:a:7": (0.2, 1.0, "ok", {})}),
    "one frame": ([person(0)], {}, {"anonymous-s0-t1": (None, None, "unavailable", {})}),
    "standing": ([person(0), person(1)], {}, {"anonymous-s0-t1": (0.0, 1.0, "ok", {})}),
    "roles": ([person(0, role="referee"), person(1, role="unknown")], {}, {}),
    "two holders": ([person(i, track=k, named=A) for i in (0, 1) for k in (1, 2)], {}, {f"anonymous-s0-t{k}": (None, 0.0, "unavailable", {"identity_transition_or_conflict": 1}) for k in (1, 2)}),
    "late name": ([person(i, 0.1 * i, named=A if i >= 2 else None) for i in range(4)], {}, {"anonymous-s0-t1": (0.1, 1.0, "ok", {}), "roster:a:7": (0.1, 1.0, "ok", {"identity_transition_or_conflict": 1})}),
    "jump": ([person(0), person(1, 10.0)], {}, {"anonymous-s0-t1": (None, 0.0, "unavailable", {"implausible_speed": 1})}),
    "method": ([person(0), person(1, 0.1, method="box")], {}, {"anonymous-s0-t1": (None, 0.0, "unavailable", {"ground_point_method_change": 1})}),
    "long gap": ([person(0), person(1, 0.1, t=1.0)], {}, {"anonymous-s0-t1": (None, 0.0, "unavailable", {"timestamp_gap": 1})}),
    "curve": ([person(i, *p) for i, p in enumerate(((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)))], {"max_speed": 20.0}, {"anonymous-s0-t1": (3.0, 1.0, "ok", {})}),
    "uneven times": ([person(0), person(1, 0.1), person(2, 0.2, t=0.15)], {"max_speed": 1.5}, {"anonymous-s0-t1": (0.1, 0.1 / 0.15, "partial", {"implausible_speed": 1})}),
}


@pytest.mark.parametrize("case", CASES)
def test_distance(spark, case):
    rows, how, want = CASES[case]
    got = totals(spark, rows, **how)
    assert got.keys() == want.keys()
    for who, (distance, coverage, status, excluded) in want.items():
        r = got[who]
        assert close(r.distance, distance) and close(r.coverage, coverage) and (r.status, r.excluded) == (status, excluded)


def test_filter_equals_a_plain_fold(spark):
    rng = random.Random(4)
    rows = [person(i, rng.uniform(0, 0.3) if rng.random() > 0.1 else None, rng.uniform(0, 0.3), t=i * 0.1 + rng.uniform(0, 0.02), track=k) for k in (1, 2) for i in range(60) if rng.random() > 0.05]
    got = {(r.track_id, r.frame_index): r.distance for r in observed.contributions(spark.createDataFrame(rows, PERSON), tau=0.12, deadband=0.05).collect()}
    for k in (1, 2):
        before = None
        for r in sorted(r for r in rows if r[4] == k):
            i, t, x, y = r[0], r[1], r[6], r[7]
            want = None
            state = (i, t, x, y, (x, y), (x, y))
            if before and before[0] == i - 1 and x is not None and before[2] is not None and t - before[1] <= 0.2 and math.dist((x, y), before[2:4]) <= 12 * (t - before[1]):
                share = 1 - math.exp(-(t - before[1]) / 0.12)
                spot = tuple(p + share * (q - p) for p, q in zip(before[4], (x, y)))
                step = math.dist(spot, before[5])
                want = step if step >= 0.05 else 0.0
                state = (i, t, x, y, spot, spot if want else before[5])
            assert close(got[k, i], want)
            before = state


def test_order_rules(spark):
    rows = spark.createDataFrame([(1, 0.0, 0), (2, 0.1, 0), (4, 0.2, 0), (5, 0.2, 0), (6, 0.4, -1)], "frame_index long, timestamp_s double, segment_id int")
    assert {(r.frame_index, r.rule) for r in observed.order_violations(rows).collect()} == {(1, "index"), (4, "index"), (5, "time"), (6, "segment")}


# --- heat maps


def heat_rows(spark, times, tracks=1, x=1.0, missing=(), step=0.0):
    data = [(i, t, 0, True, k, "player", "a", f"roster:a:{k}", None if i in missing else x + step * i, 2.0, "ankles") for i, t in enumerate(times) for k in range(1, tracks + 1)]
    return spark.createDataFrame(data, "frame_index long, timestamp_s double, plan int, included boolean, track_id int, role string, team string, subject string, x double, y double, ground_point_method string")


def heat(spark, rows, keys=("subject",), lo=0.0, hi=10.0, **how):
    grid, sums = heatmaps.heatmap(heatmaps.intervals(rows), list(keys), lo, hi, 30.0, 15.0, **how)
    return sum(r.mass for r in grid.collect()), sums.collect()


@pytest.mark.parametrize("times", [(0, 0.1, 0.2), (0, 0.05, 0.1, 0.15, 0.2), (0, 0.03, 0.2)])
def test_presence_does_not_depend_on_the_frame_rate(spark, times):
    mass, (r,) = heat(spark, heat_rows(spark, [float(t) for t in times]))
    assert close(mass, 0.2) and close(r.coverage, 1.0)


def test_gaps_clips_and_shared_time(spark):
    assert close(heat(spark, heat_rows(spark, [0.0, 0.2, 0.4, 0.6, 0.8]))[0], 0.8)
    assert close(heat(spark, heat_rows(spark, [0.0, 0.1, 0.2]), lo=0.04, hi=0.13)[0], 0.09)
    mass, (r,) = heat(spark, heat_rows(spark, [0.0, 0.1, 0.2], tracks=2), keys=("team",))
    assert close(mass, 0.4) and close(r.video, 0.2)
    mass, (r,) = heat(spark, heat_rows(spark, [0.0, 0.1, 0.2, 0.3], missing=(2,)))
    assert close(mass, 0.1) and close(r.observed, 0.3) and close(r.coverage, 1 / 3)
    assert heat(spark, heat_rows(spark, [0.0, 0.3]))[0] == 0


def test_half_court_is_turned_and_cut(spark):
    rows = heat_rows(spark, [0.0, 0.1], x=14.5, step=1.0)
    found = heatmaps.intervals(rows, max_speed=100.0)
    for direction, cell_x in ((1, 0), (-1, 0)):
        own = found.withColumns({"owner": F.lit("a"), "direction": F.lit(direction), "episode": F.lit(0)})
        grid, sums = heatmaps.heatmap(own, ["subject"], 0.0, 1.0, 30.0, 15.0, half=True)
        cells = grid.collect()
        assert close(sum(r.mass for r in cells), 0.05) and {r.cell_x for r in cells} == {cell_x} and close(sums.first().in_half, 0.05)
        assert {r.cell_y for r in cells} == ({2} if direction == 1 else {13})


# --- phases


def settled_rows(script):
    """One pair a frame at 10 fps: (team, half) per frame, the first team's view to the right."""
    out = []
    for i, (team, half) in enumerate(script):
        holder = None if team is None else 21.0 if half == 1 else 9.0
        out.append((0, i, i * 0.1, None if i == 0 else (i - 1) * 0.1, 0, 0, 1, team, "direct_contact" if team else "no_contact", holder, half, True, 1, False))
    return out


SETTLED = "run int, frame_index long, time_s double, start double, block int, plan int, period int, team string, reason string, holder_x double, half int, court_ok boolean, view int, scored boolean"


def test_possession_changes_only_when_the_other_half_is_reached(spark):
    script = [("a", 1)] * 15 + [("b", 1)] * 15 + [("b", -1)] * 20
    found = play.settled(spark.createDataFrame(settled_rows(script), SETTLED), ["run"], ("a", "b"), 30.0).orderBy("frame_index").collect()
    assert [r.owner for r in found[5:14]] == ["a"] * 9
    assert all(r.owner is None and r.method == "neutral" for r in found[18:28])
    assert [r.owner for r in found[-15:]] == ["b"] * 15 and {r.direction for r in found[-15:]} == {-1}
    assert found[6].reason == "settled_attack" and found[20].reason == "transition"


def test_one_contrary_contact_does_not_end_an_attack(spark):
    script = [("a", 1)] * 12 + [("b", 1)] + [("a", 1)] * 8
    found = play.settled(spark.createDataFrame(settled_rows(script), SETTLED), ["run"], ("a", "b"), 30.0).orderBy("frame_index").collect()
    assert [r.owner for r in found[13:]] == ["a"] * 7


def test_contacts(spark):
    frames_ = spark.createDataFrame([(i, i != 4, 100.0, 100.0, True) for i in range(6)], "frame_index long, ball_ok boolean, ball_x double, ball_y double, court_ok boolean")
    box, other = [80.0, 60.0, 120.0, 160.0], [300.0, 60.0, 340.0, 160.0]
    hand = lambda x: [[x, 100.0], [0.0, 0.0]]
    people = [
        (0, 1, "player", "a", box, hand(100.0), [1.0, 0.0], 15.0), (0, 2, "player", "b", other, None, None, 20.0), (0, 3, "player", "b", other, None, None, 22.0),
        (1, 1, "player", "a", box, hand(100.0), [1.0, 0.0], 15.0), (1, 2, "player", "b", box, hand(103.0), [1.0, 0.0], 16.0),
        (2, 1, "referee", None, box, hand(100.0), [1.0, 0.0], 15.0), (3, 1, "player", None, box, hand(100.0), [1.0, 0.0], 15.0),
        (4, 1, "player", "a", box, hand(100.0), [1.0, 0.0], 15.0), (5, 1, "player", "a", other, None, None, 15.0),
    ]
    rows = spark.createDataFrame(people, "frame_index long, track_id int, role string, team string, box array<double>, wrists array<array<double>>, wrist_scores array<double>, x double")
    got = {r.frame_index: r for r in play.contacts(frames_, rows, ["a", "b"], 30.0).collect()}
    assert [got[i].reason for i in range(6)] == ["direct_contact", "contested_contact", "referee_contact", "unassigned_contact", "ball_unavailable", "no_contact"]
    assert (got[0].team, got[0].method, got[0].holder_x, got[0].direction) == ("a", "hands", 15.0, 1)


# --- identities


def test_handoff_between_two_tracks(spark):
    vote = lambda k, i: (0, k, i, "home")
    points = [(i, i / 30, 0, 1 if i < 4 else 2, "player", [100.0 + 5 * (i >= 4), 0.0, 120.0 + 5 * (i >= 4), 100.0], "home") for i in range(8)]
    rows = identity.spans(spark.createDataFrame(points, "frame_index long, timestamp_s double, segment_id int, track_id int, role string, box array<double>, color string"))
    votes = spark.createDataFrame([vote(1 if i < 4 else 2, i) for i in range(8)], "segment_id int, track_id int, frame_index long, color string")
    ends = identity.span_ends(rows.drop("color"), votes)
    named = spark.createDataFrame([(0, 1, 0, "home", "7")], "segment_id int, track_id int, span long, team string, number string")
    nothing = spark.createDataFrame([], "segment_id int, frame_index long, track_id int")
    (link,) = identity.handoffs(ends, named, nothing.drop("track_id"), nothing).collect()
    assert (link.track_id, link.to_track, link.number, link.gap, link.distance) == (1, 2, "7", 0.0333, 0.05)
    cut = spark.createDataFrame([(0, 4)], "segment_id int, frame_index long")
    assert identity.handoffs(ends, named, cut, nothing).count() == 0
    crowd = identity.crowded(spark.createDataFrame([(0, 4, 9, [106.0, 0.0, 126.0, 100.0], None)], "segment_id int, frame_index long, track_id int, box array<double>, color string"), rows.where("frame_index = 4").selectExpr("segment_id", "frame_index", "track_id", "box", "'home' as team"))
    assert identity.handoffs(ends, named, nothing.drop("track_id"), crowd.select("segment_id", "frame_index", "track_id")).count() == 0


def test_numbers_become_names(spark):
    reads = [(0, k, i, n, 0.97) for k, n in ((1, "7"), (2, "9"), (3, "9"), (4, "5")) for i in range(0, 10, 2)] + [(0, 4, 9, "9", 0.99)]
    roster = spark.createDataFrame([("a", "7", "A"), ("a", "9", "B"), ("b", "9", "C"), ("b", "5", "D")], "team string, number string, name string")
    teams = spark.createDataFrame([(0, 1, None, False, {"a": 2}), (0, 2, "b", False, {"b": 5}), (0, 3, None, False, {"a": 2}), (0, 4, None, False, {"b": 2})], "segment_id int, track_id int, team string, mixed boolean, counts map<string, long>")
    colors = spark.createDataFrame([(0, 2, 4, "b")], "segment_id int, track_id int, frame_index long, color string")
    found = {r.track_id: r for r in identity.assignments(spark.createDataFrame(reads, "segment_id int, track_id int, frame_index long, number string, confidence double"), roster, teams, colors).collect()}
    assert {k: (r.team, r.name, r.method) for k, r in found.items()} == {1: ("a", "A", "unique_number_corroborated"), 2: ("b", "C", "number_and_team")}


def test_lineups_follow_substitutions(spark):
    starters = spark.createDataFrame([(1, "A"), (1, "B")], "game int, player string")
    plays = spark.createDataFrame([(1, 10, "C enters the game for A"), (1, 20, "shot made"), (1, 30, "A enters the game for B")], "game int, at int, text string")
    found = identity.lineups_after(starters, identity.lineup_changes(plays, ["game"], "at", "text"), ["game"], "at").collect()
    assert {(r["at"], tuple(r.players)) for r in found} == {(10, ("B", "C")), (30, ("A", "C"))}


def test_camera_shift_is_taken_out(spark):
    rows = lambda dx: spark.createDataFrame([(0, i, 30.0 * i + dx, 0.0, 100.0) for i in range(5)], "frame int, id int, x double, y double, height double")
    found = identity.camera_links(rows(0.0), rows(8.0), ["frame"]).collect()
    assert {(r.a_id, r.b_id) for r in found} == {(i, i) for i in range(5)} and all(r.cost < 1e-9 for r in found)


def test_smoothed_boxes_follow_steady_movement(spark):
    rows = spark.createDataFrame([(1, i, [float(i), 0.0, 20.0 + i, 100.0 + 2 * (i == 3)], i == 6) for i in range(9)], "track int, frame_index long, box array<double>, scene_cut boolean")
    got = {r.frame_index: r.smooth_box for r in frames.smoothed_boxes(rows, ["track"]).collect()}
    assert got[0] == [0.0, 0.0, 20.0, 100.0] and close(got[2][0], 2.0) and close(got[2][3], 100 + 4 / 9) and got[6][0] == 6.0 and close(got[5][0], 5.0)


# --- evaluation


def test_matches_outside_the_range_are_ignored(spark):
    truth = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0), (0, 2, 100.0, 0.0, 200.0, 100.0)], "frame long, id long, x1 double, y1 double, x2 double, y2 double")
    boxes = [(0, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 2, 0.8, 100.0, 0.0, 200.0, 100.0), (0, 3, 0.7, 300.0, 0.0, 310.0, 10.0), (0, 4, 0.6, 300.0, 0.0, 400.0, 100.0)]
    predicted = spark.createDataFrame(boxes, "frame long, id long, score double, x1 double, y1 double, x2 double, y2 double")
    of = lambda area: sorted((r.outcome, r.prediction_id) for r in evaluation.match_events(predicted, truth, "frame", [0.5], evaluation.AREAS[area]).collect())
    assert of("all") == [("fp", 3), ("fp", 4), ("tp", 1), ("tp", 2)]
    assert of("small") == [("fp", 3), ("tp", 1)] and of("large") == [("fp", 4), ("tp", 2)]
    events = evaluation.match_events(predicted, truth, "frame", [0.5, 0.75])
    (r,) = evaluation.ap_summary(evaluation.average_precision(events.withColumn("all", F.lit(1)), ["all"], "frame"), ["all"]).collect()
    assert (r.ap50, r.ap50_95, r.support) == (1.0, 1.0, 2)


def test_average_precision_equals_its_definition(spark):
    rng = random.Random(2)
    rows = [(i, 0.5, rng.choice(("tp", "tp", "fp")), i, None, 0.9, rng.random()) for i in range(200)] + [(i, 0.5, "fn", None, i, None, None) for i in range(40)]
    events = spark.createDataFrame([(*r, 1) for r in rows], "frame long, iou_threshold double, outcome string, prediction_id long, truth_id long, iou double, score double, g int")
    (got,) = evaluation.average_precision(events, ["g"], "frame").collect()
    support, tp, curve = sum(r[2] != "fp" for r in rows), 0, []
    for n, r in enumerate(sorted((r for r in rows if r[2] != "fn"), key=lambda r: -r[6]), 1):
        tp += r[2] == "tp"
        curve.append((tp / support, tp / n))
    want = sum(max((p for rec, p in curve if rec >= k / 100 - 1e-12), default=0.0) for k in range(101)) / 101
    assert close(got.ap, want) and got.support == support


def test_switching_tracks_halves_idf1(spark):
    truths = spark.createDataFrame([(0, i, "p") for i in range(4)], "segment_id int, frame_index long, person_id string")
    matches = spark.createDataFrame([(i, "p", "x" if i < 2 else "y") for i in range(4)], "frame_index long, person_id string, track string")
    pairs = matches.groupBy(F.col("person_id").alias("person"), "track").agg(F.count(F.lit(1)).alias("frames"))
    (r,) = evaluation.tracking_report(evaluation.track_states(truths, matches), 4, 4, evaluation.identity_overlap(pairs)).collect()
    assert (r.idtp, r.idf1, r.id_switches, r.fragmentations) == (2, 0.5, 1, 0)


# --- scoreboard


BOARD = "game int, time_s double, period int, clock_s double, scores map<string, int>"


def test_readings_need_a_neighbour_and_never_fall(spark):
    s = lambda a, b=0: {"a": a, "b": b}
    raw = [(1, 0.0, 1, 700.0, s(0)), (1, 0.5, 1, 699.5, s(2)), (1, 1.0, 1, 650.0, s(2)), (1, 1.5, 9, 1.0, s(300)), (1, 2.0, 1, 698.0, s(0)), (1, 2.5, 1, 697.5, s(0)), (1, 5.0, 1, 690.0, s(4))]
    got = {r.time_s: r for r in scoreboard.confirmed(spark.createDataFrame(raw, BOARD), ["game"], F.array(F.lit("a"), F.lit("b"))).collect()}
    assert [got[t].period for t in (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 5.0)] == [1, 1, 1, None, 1, 1, None]
    assert [got[t].scores for t in (0.0, 0.5, 1.0, 2.0, 2.5)] == [None, s(2), s(2), None, None]
    assert [got[t].clock_s for t in (0.0, 0.5, 1.0, 2.5)] == [700.0, 699.5, None, 697.5]


def test_changes_and_periods(spark):
    rows = spark.createDataFrame([(1, t, 1, None, {"a": a}) for t, a in ((0.0, 2), (0.1, 4), (2.0, 2))], BOARD)
    assert [r.time_s for r in scoreboard.changes(rows, ["game"]).orderBy("time_s").collect()] == [0.0, 0.1, 2.0]
    rows = spark.createDataFrame([(1, 0.1 * i, p, None, None) for i, p in enumerate((1, 1, 3, 3))], BOARD)
    first, second = scoreboard.period_spans(rows, ["game"], 0.1).orderBy("start_s").collect()
    assert (first.period, second.period) == (1, 3) and close(first.end_s, 0.2) and close(second.start_s, 0.2)
    faults = scoreboard.document_faults(rows, ["a", "b"], ["A", ""], ["a", "c"], 5.0, True).collect()
    assert {r.reason for r in faults} == {"team_mismatch", "invalid_teams", "invalid_sampling"}


# --- shots


def test_overlapping_proposals_are_one_shot(spark):
    rows = [(0, 1, 1.0, 2.0, 5.0, [1, 2, 3]), (0, 2, 1.3, 2.2, 9.0, [4, 5]), (0, 3, 1.9, 3.0, 1.0, [4, 5]), (0, 4, 2.5, 3.0, 1.0, [8, 9]), (1, 5, 1.0, 2.0, 1.0, [1])]
    found = shots.one_event(spark.createDataFrame(rows, "segment_id int, shot_id int, time_s double, end_s double, quality double, frames array<int>"), ["segment_id"])
    assert {r.shot_id for r in found.collect()} == {2, 4, 5}


# --- contracts, exports, runs


def test_frame_contract(spark):
    schema = """schema_version int, artifact_type string, frame_index long, segment_id long, timestamp_s double, coordinate_space string, distance_unit string, width int, height int,
      persons array<struct<observation_id: string, role: string, bbox: array<double>, track_id: int, position_m: array<double>, confidence: double>>, ball struct<position_px: array<double>, confidence: double>"""
    good = ("p", "player", [0.0, 0.0, 5.0, 5.0], 1, None, 0.5)
    row = lambda i, people=(good,), ball=(None, None), t=0.0: (1, "video_observation", i, 0, t, "source_pixels", "m", 10, 10, list(people), ball)
    rows = [row(0), row(1, [good, good]), row(2, [("q", "coach", [0.0, 0.0, 5.0, 50.0], 2, [float("nan"), 0.0], 2.0)]), row(3, ball=([10.0, 1.0], 0.5)), row(4, t=float("inf")), row(5, [])]
    found = {}
    for r in contracts.frame_violations(spark.createDataFrame(rows, schema), ["frame_index"]).collect():
        found.setdefault(r.frame_index, set()).add(r.rule)
    assert found == {1: {"observation_id", "track"}, 2: {"role", "box", "position", "confidence"}, 3: {"ball"}, 4: {"timestamp"}}
    with pytest.raises(ValueError, match="rule="):
        contracts.strict(contracts.frame_violations(spark.createDataFrame(rows, schema), ["frame_index"]))


def test_documents_and_publication(spark, tmp_path):
    with pytest.raises(ValueError, match="repeated"):
        runs.document('{"a": 1, "a": 2}')
    with pytest.raises(ValueError, match="finite"):
        runs.document('{"a": NaN}')
    folder = f"file://{tmp_path}/published"
    for n in (1, 2):
        runs.publish({"t": spark.range(n)}, folder)
        assert runs.published(spark, folder, "t").count() == n


def test_inventory_and_manifest(spark, tmp_path):
    (tmp_path / "game").mkdir()
    (tmp_path / "game" / "x.json").write_text("{}")
    (tmp_path / "game" / "run.json").write_text('{"run_id": "r", "status": "completed", "frames": 3, "artifacts": {"game/x.json": {"sha256": "0"}, "game/y.json": {"sha256": "1"}}}')
    found = runs.inventory(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {"game/x.json", "game/run.json"}
    manifest = runs.runs(spark, str(tmp_path))
    assert [r.name for r in manifest.collect()] == ["game"]
    assert {r.path for r in runs.artifact_mismatches(found, manifest).collect()} == {"game/x.json", "game/y.json"}


def test_dense_ids_without_keys(spark):
    rows = spark.range(500).withColumn("v", F.col("id") * 7 % 500)
    got = exports.dense_ids(rows, [], ["v"], "n", 8).collect()
    assert all(r.n == r.v + 1 for r in got)


def test_references_move_only_from_where_they_are_expected(spark):
    now = spark.createDataFrame([("people", "v1", None)], "name string, version string, previous string")
    assert runs.moved_reference(now, "people", "v1", "v2").collect()[0].asDict() == {"name": "people", "version": "v2", "previous": "v1"}
    with pytest.raises(ValueError, match="moved"):
        runs.moved_reference(now, "people", "v0", "v2")


def test_density_keeps_mass(spark):
    grid = spark.createDataFrame([("a", 0, 0, 2.0), ("a", 3, 2, 1.0)], "team string, cell_x int, cell_y int, mass double")
    field = heatmaps.density_field(grid, ["team"], 4.0, 3.0, (4, 3))
    rows = field.collect()
    assert len(rows) == 32 * 24 and close(sum(r.density for r in rows) / 64, 3.0)
    top = max(rows, key=lambda r: r.density)
    banded = {(r.sample_x, r.sample_y): r.band for r in heatmaps.bands(field, ["team"]).collect()}
    assert banded[top.sample_x, top.sample_y] == 6 and min(banded.values()) <= 1
    spots = spark.createDataFrame([("a", (top.sample_x + 0.5) / 8, (top.sample_y + 0.5) / 8), ("a", 0.0, 0.0)], "team string, x double, y double")
    got = sorted(r.density for r in heatmaps.sampled(field, spots, ["team"]).collect())
    assert close(got[-1], top.density) and got[0] > 0


def test_poses_and_reviews_meet_their_detection(spark):
    from playframe.operators import joins

    tracked = spark.createDataFrame([(0, 0, 7), (0, 1, None)], "frame int, detection int, track int")
    poses = spark.createDataFrame([(0, 1, "p")], "frame int, detection int, pose string")
    assert sorted((r.detection, r.pose) for r in joins.by_detection(tracked, poses, "frame", "detection").collect()) == [(0, None), (0 + 1, "p")]
    with pytest.raises(Exception, match="belongs to no"):
        joins.by_detection(tracked, spark.createDataFrame([(3, 1, "p")], "frame int, detection int, pose string"), "frame", "detection").collect()
    labels = spark.createDataFrame([(0, 1, "h", "good"), (0, 2, "old", "bad")], "frame int, object int, sha string, verdict string")
    objects = spark.createDataFrame([(0, 1, "h"), (0, 2, "h"), (0, 3, "h")], "frame int, object int, sha string")
    got = {r.object: (r.verdict, r.stale) for r in joins.reviewed(labels, objects, ["frame", "object"], "sha").collect()}
    assert got == {1: ("good", False), 2: (None, True), 3: (None, False)}
