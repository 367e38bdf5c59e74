"""Cameras, uniforms, lineups and runs kept apart: known cases, brute force, and unions of single results."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from playframe.operators import cameras, flights, heatmaps, identity, lineup, observed, play, uniforms
from playframe.sources import demo
from tests.test_evidence import SAMPLE, thrown
from tests.test_tracking import PERSON, SETTLED, person, settled_rows

LENGTH, WIDTH = 28.65, 15.24


def camera(focal, tilt, pan, eye, width=1280.0, height=720.0):
    """Projection of a camera at ``eye`` turned by ``pan`` and bent down by ``tilt``."""
    c, s, cp, sp = np.cos(tilt), np.sin(tilt), np.cos(pan), np.sin(pan)
    right, ahead = np.array([cp, sp, 0.0]), np.array([-sp, cp, 0.0])
    rot = np.stack([right, -s * ahead - np.array([0, 0, c]), c * ahead - np.array([0, 0, s])])
    k = np.array([[focal, 0, width / 2], [0, focal, height / 2], [0, 0, 1]])
    return k @ np.column_stack([rot, -rot @ eye])


@pytest.mark.parametrize("scale", [1.0, -0.3])
def test_rims_of_a_known_camera(spark, scale):
    p = camera(1100.0, 0.35, 0.1, np.array([14.0, -22.0, 9.0]))
    want = []
    for x in (1.6002, LENGTH - 1.6002):
        u, v, w = p @ np.array([x, WIDTH / 2, 3.048, 1.0])
        want.append((u / w, v / w))
    want = [(u, v) for u, v in want if -128 <= u <= 1408 and 0 <= v <= 720]
    matrix = (scale * p[:, [0, 1, 3]]).reshape(-1).tolist()
    df = spark.createDataFrame([(1, matrix)], "k int, matrix array<double>")
    got = cameras.rim_anchors(df, "matrix", F.lit(1280.0), F.lit(720.0), LENGTH, WIDTH).first()
    assert got.focal == pytest.approx(1100.0, abs=1e-6) and want and len(got.rims) == len(want)
    assert np.allclose(got.rims, want, atol=1e-6)


def test_no_rims_without_a_plausible_camera(spark):
    p = camera(1100.0, 0.35, 0.1, np.array([14.0, -22.0, 9.0]))[:, [0, 1, 3]]
    stretched = p @ np.diag([3.0, 1.0, 1.0])
    flat = np.array([[40.0, 0, 10], [0, 40.0, 20], [0, 0, 1.0]])
    df = spark.createDataFrame([(i, None if m is None else m.reshape(-1).tolist()) for i, m in enumerate((stretched, flat, None))], "k int, matrix array<double>")
    got = cameras.rim_anchors(df, "matrix", F.lit(1280.0), F.lit(720.0), LENGTH, WIDTH).collect()
    assert all(r.focal is None and r.rims == [] for r in got)


# --- uniforms


def uniform_data(rng, n=900):
    rows = []
    for i in range(n):
        label = ("a", "b", None)[i % 3]
        base = {"a": 60, "b": 150}.get(label, rng.choice([60, 150, 105]))
        rows.append((i, i // 6, label, [[float(min(255, max(0, int(rng.gauss(base + 5 * r, 12))))) for _ in range(3)] for r in range(2)]))
    return rows


def plain_prototypes(rows):
    out = {}
    for label in "ab":
        own = np.array([f for _, g, y, f in rows if y == label and g % 5])
        low = lambda x: np.sort(x, axis=0)[(len(x) - 1) // 2]
        center = low(own)
        out[label] = center, np.clip(1.4826 * low(np.abs(own - center)), 8, 55)
    return out


def plain_class(features, model, margin, limit):
    d = np.array([(((np.array(features) - c) / s) ** 2).mean(axis=1) for c, s in (model[x] for x in "ab")])
    win, near, apart = d.argmin(0), d.min(0), np.abs(d[0] - d[1])
    return "ab"[win[0]] if len(set(win)) == 1 and (near <= limit).all() and (apart >= margin).all() else None


def test_uniforms_equal_plain(spark):
    rows = uniform_data(random.Random(3))
    df = spark.createDataFrame(rows, "id long, group long, label string, features array<array<double>>").repartition(3)
    model, want = uniforms.prototypes(df), plain_prototypes(rows)
    for r in model.collect():
        assert np.allclose(r.centers, want[r.label][0]) and np.allclose(r.scales, want[r.label][1])
    got = {r.id: r.team for r in uniforms.classified(df, model, 2.0, 6.0).collect()}
    assert got == {i: plain_class(f, want, 2.0, 6.0) for i, _, _, f in rows} and {None, "a", "b"} == set(got.values())
    cells = {}
    for margin, limit in itertools.product(uniforms.MARGINS, uniforms.LIMITS):
        found = [(plain_class(f, want, margin, limit), y) for _, g, y, f in rows if y and g % 5 == 0]
        for label in "ab":
            n = sum(p == label for p, _ in found)
            if n:
                cells[margin, limit, label] = (n, sum(p == label == y for p, y in found))
    grid = uniforms.threshold_grid(df, model)
    assert {(r.margin, r.limit, r.predicted): (r.accepted, r.correct) for r in grid.collect()} == cells
    able = {}
    for margin, limit in itertools.product(uniforms.MARGINS, uniforms.LIMITS):
        own = [cells.get((margin, limit, x)) for x in "ab"]
        if all(c and c[0] >= 20 and c[1] >= 0.98 * c[0] for c in own):
            able[margin, limit] = sum(c[0] for c in own)
    best = uniforms.chosen_threshold(grid).first()
    assert able and (best.margin, best.limit) == min(able, key=lambda k: (-able[k], k)) and best.accepted == max(able.values())


def test_no_threshold_where_colours_do_not_tell(spark):
    rng = random.Random(4)
    rows = [(i, i // 6, rng.choice("ab"), [[float(rng.randint(0, 255))] * 3] * 2) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, group long, label string, features array<array<double>>")
    assert uniforms.chosen_threshold(uniforms.threshold_grid(df, uniforms.prototypes(df))).count() == 0


def test_a_replacement_changes_teams_only(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (2, None, 0.7)], "id int, team string, x double")
    got = uniforms.replaced(rows, spark.createDataFrame([(2, "b"), (1, None)], "id int, team string"), ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, "a", 0.5), (2, "b", 0.7)]
    with pytest.raises(ValueError, match="repeat or lose"):
        uniforms.replaced(rows.unionByName(rows.withColumn("x", F.lit(9.0))), spark.createDataFrame([(2, "b"), (2, "a")], "id int, team string"), ["id"]).count()


# --- lineups


def test_clear_assignments_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        cost = rng.integers(0, 8, (5, 6)).astype(float)
        every = [(sum(cost[i, j] for i, j in enumerate(p)), p) for p in itertools.permutations(range(6), 5)]
        best = min(t for t, _ in every)
        got = lineup.clear_assignment(cost)
        assert sum(cost[i, j] for i, j, _ in got) == best
        for i, j, margin in got:
            assert margin == min(t for t, p in every if p[i] != j) - best


def test_an_ambiguous_lineup_stays_open(spark):
    costs = [(0, 10, 1, -3.0), (0, 10, 2, 0.0), (0, 20, 1, 0.0), (0, 20, 2, -2.0), (1, 10, 1, 0.0), (1, 10, 2, 0.0), (1, 20, 1, 0.0), (1, 20, 2, 0.0)]
    got = lineup.seeded(spark.createDataFrame(costs, "run int, track_id long, player int, cost double"), ["run"]).collect()
    assert {(r.track_id, r.player, r.margin) for r in got if r.clear} == {(10, 1, 5.0), (20, 2, 5.0)} and {r.run for r in got if r.clear} == {0}


def test_motion_links_a_fragment_without_a_new_name(spark):
    bodies = [(0, 0, 1, 10, "a", 0.0, 0.0, 10.0, 30.0), (0, 0, 2, 20, "b", 50.0, 0.0, 60.0, 30.0), (0, 1, 3, None, None, 1.0, 0.0, 11.0, 30.0), (0, 1, 4, 20, "b", 50.0, 0.0, 60.0, 30.0), (0, 2, 5, 30, "b", 2.0, 0.0, 12.0, 30.0)]
    df = spark.createDataFrame(bodies, "run int, frame_index long, id int, track_id long, team string, x1 double, y1 double, x2 double, y2 double")
    seeds = spark.createDataFrame([(0, 10, 0, "a"), (0, 20, 1, "b")], "run int, track_id long, player int, player_team string")
    got = {r.id: r.player for r in lineup.follow(df, seeds, ["run"]).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1}


# --- runs kept apart


def runs_of(spark, rows, schema, n=2):
    one = spark.createDataFrame(rows, schema)
    both = one.withColumn("run_id", F.lit(0))
    for i in range(1, n):
        both = both.unionByName(one.withColumn("run_id", F.lit(i)))
    return one, both


def alike(one, both, n=2):
    want = sorted(map(str, (tuple(r) for r in one.collect())))
    for i in range(n):
        got = both.where(F.col("run_id") == i).drop("run_id")
        assert sorted(map(str, (tuple(r) for r in got.select(*one.columns).collect()))) == want
    assert want


def test_two_runs_are_measured_like_one(spark):
    one = demo.demo_persons(spark)
    both = one.withColumn("run_id", F.lit(0)).unionByName(one.withColumn("run_id", F.lit(1)))
    alike(observed.statistics(observed.contributions(one, tau=0.0, deadband=0.0)), observed.statistics(observed.contributions(both, tau=0.0, deadband=0.0)))
    alike(observed.contributions(one).drop("named"), observed.contributions(both).drop("named"))


def test_two_runs_have_their_own_intervals_plans_and_spans(spark):
    rows = [person(i, 0.1 * i, track=k, named=("a", str(k))) for i in range(6) for k in (1, 2)]
    one, both = runs_of(spark, rows, PERSON)
    full = lambda df: df.withColumns({"plan": F.lit(0), "team": F.lit("a"), "subject": F.concat(F.lit("roster:a:"), F.col("named.number"))})
    alike(heatmaps.intervals(full(one)), heatmaps.intervals(full(both)))
    cuts = lambda df: heatmaps.plans(df.select(*[c for c in ("run_id", "frame_index", "segment_id") if c in df.columns]).distinct().withColumn("scene_cut", F.col("frame_index") == 3))
    alike(cuts(one), cuts(both))
    alike(identity.spans(one.drop("named")), identity.spans(both.drop("named")))
    grid = lambda df, keys: heatmaps.heatmap(heatmaps.intervals(full(df)), keys, 0.0, 9.0, 30.0, 15.0)[0]
    alike(grid(one, ["subject"]), grid(both, ["run_id", "subject"]))


def test_two_runs_have_their_own_flights_and_play(spark):
    one, both = runs_of(spark, thrown(0) + thrown(2, pan=3.0), SAMPLE)
    alike(flights.flights(one), flights.flights(both))
    rows = settled_rows([("a", 1)] * 15 + [("b", -1)] * 15)
    one, both = runs_of(spark, rows, SETTLED)
    alike(play.settled(one, ["run"], ("a", "b"), 30.0), play.settled(both, ["run_id", "run"], ("a", "b"), 30.0))


# --- settled play


def owners(spark, rows):
    return play.settled(spark.createDataFrame(rows, SETTLED), ["run"], ("a", "b"), 30.0).orderBy("frame_index").collect()


def changed(rows, at, **to):
    names = [c.split()[0] for c in SETTLED.split(", ")]
    return [tuple(to.get(n, v) for n, v in zip(names, r, strict=True)) if r[1] in at else r for r in rows]


def test_a_score_ends_an_attack_and_bars_its_half(spark):
    rows = changed(settled_rows([("a", 1)] * 20 + [(None, 1)] * 20), [20], scored=True)
    got = owners(spark, rows)
    assert got[15].owner == "a" and all(r.owner is None for r in got[20:])
    assert got[20].reason == "transition"


def test_a_referee_at_the_ball_interrupts(spark):
    rows = changed(settled_rows([("a", 1)] * 30), [15], reason="referee_contact", team=None, holder_x=None)
    got = owners(spark, rows)
    assert got[13].owner == "a" and got[14].owner is None and got[14].method == "neutral" and got[-1].owner == "a"


def test_the_ball_carried_back_ends_an_attack(spark):
    rows = changed(settled_rows([("a", 1)] * 30), range(15, 20), holder_x=10.0, half=None)
    got = owners(spark, rows)
    assert got[13].owner == "a" and got[16].owner is None and got[-1].owner == "a"


def test_without_view_court_or_clear_contact_nothing_is_shown(spark):
    rows = changed(changed(changed(settled_rows([("a", 1)] * 30), [15], view=None), [17], court_ok=False), [19], reason="contested_contact", team=None)
    got = {r.frame_index: r for r in owners(spark, rows)}
    assert [got[i].reason for i in (15, 17, 19)] == ["orientation_unavailable", "calibration_unavailable", "contested_contact"] and got[25].owner == "a"


def test_a_pending_team_outlives_a_cut_within_a_period(spark):
    rows = settled_rows([("a", 1)] * 15 + [("b", 1)] * 10 + [("b", -1)] * 10)
    for period, want in ((1, "neutral"), (None, "none")):
        cut = [tuple(None if n == "start" and r[1] == 22 else period if n == "period" and r[1] >= 22 else v for n, v in zip([c.split()[0] for c in SETTLED.split(", ")], r, strict=True)) for r in rows]
        got = {r.frame_index: r for r in owners(spark, cut)}
        assert got[21].method == "neutral" and got[23].method == want


# --- reversed cameras


def test_reversed_cameras_turn_to_one_basket(spark):
    rows = [(0, 1, 1, "a", "s", 0.0, 0.1, 25.0, 3.0, 26.0, 3.0, 1), (1, 1, 1, "a", "s", 0.0, 0.1, 5.0, 12.0, 4.0, 12.0, -1), (0, 1, 2, "a", "s", 0.1, 0.2, 14.0, 3.0, 16.0, 3.0, 1), (1, 1, 2, "a", "s", 0.1, 0.2, 16.0, 12.0, 14.0, 12.0, -1), (0, 1, 3, "a", "s", 0.2, 0.3, 10.0, 3.0, 10.0, 3.0, 1)]
    df = spark.createDataFrame(rows, "run_id int, track_id int, frame_index long, team string, subject string, start double, end double, x1 double, y1 double, x2 double, y2 double, direction int")
    grid, sums = heatmaps.heatmap(df, ["run_id"], 0.0, 1.0, 30.0, 15.0, half=True)
    cells = {(r.run_id, r.cell_x, r.cell_y): round(r.mass, 9) for r in grid.collect()}
    assert {k[1:]: v for k, v in cells.items() if k[0] == 0} == {k[1:]: v for k, v in cells.items() if k[0] == 1} and cells
    assert {r.run_id: round(r.in_half, 9) for r in sums.collect()} == {0: 0.15, 1: 0.15}
    phases = df.withColumns({"owner": F.when(F.col("frame_index") == 2, "b").otherwise("a"), "episode": F.lit(0), "distance": F.abs(F.col("x2") - F.col("x1"))})
    moved, _ = heatmaps.heatmap(heatmaps.of_phase(phases, "a", "offense"), ["run_id"], 0.0, 1.0, 30.0, 15.0, metric="movement", half=True)
    assert {r.run_id: round(r.m, 9) for r in moved.groupBy("run_id").agg(F.sum("mass").alias("m")).collect()} == {0: 1.0, 1: 1.0}


# --- fits over time


def jittered(rng, n=120, cut=60):
    """Fits of a slowly panning camera with noise on the pan; at ``cut`` it looks elsewhere."""
    out = []
    for i in range(n):
        pan = 0.1 + 0.0005 * i + (0.3 if i >= cut else 0.0) + float(rng.normal(0, 0.002))
        out.append((0, i, i / 25, False, (camera(1100.0, 0.35, pan, np.array([14.0, -22.0, 9.0]))[:, [0, 1, 3]]).reshape(-1).tolist()))
    return out


def test_smoothed_fits_move_less_and_do_not_cross_a_jump(spark):
    rows = jittered(np.random.default_rng(2))
    df = spark.createDataFrame(rows, "run_id int, frame_index long, timestamp_s double, scene_cut boolean, matrix array<double>")
    found = cameras.stabilised(df, ["run_id"], "matrix", LENGTH, WIDTH)
    got = found.orderBy("frame_index").collect()
    assert len(got) == 120 and [r.stretch for r in got] == [0] * 60 + [1] * 60
    for name in ("x0", "y2"):
        want, last = [], None
        for i, r in enumerate(got):
            v = r[name]
            if last is None or i == 60:
                last = v
            else:
                last += (1 - np.exp(-(r.timestamp_s - got[i - 1].timestamp_s) / cameras.TAU)) * (v - last)
            want.append(last)
        assert np.allclose([r[f"smooth_{name}"] for r in got], want, rtol=1e-9)
    report = cameras.jitter_report(found, ["run_id"]).first()
    assert report.steps == 118 and report.ratio < 0.4 and report.smooth_p95 < report.raw_p95 and report.offset_mean < 40
    assert cameras.stabilised(df.withColumn("scene_cut", F.col("frame_index") == 30), ["run_id"], "matrix", LENGTH, WIDTH).agg(F.max("stretch")).first()[0] == 2


def test_smoothing_of_rows_equals_a_fold_over_long_pauses(spark):
    from playframe.operators.sequence import smoothed_rows

    rng = random.Random(9)
    rows, want = [], {}
    for key in range(3):
        t, v = 1000.0 * key, None
        for i in range(300):
            dt = rng.choice([0.01, 0.1, 1.0, 5.0, 80.0])
            t += dt
            x = rng.uniform(-5, 5)
            v = x if v is None else v + (1 - np.exp(-dt / 0.7)) * (x - v)
            rows.append((key, t, x))
            want[key, round(t, 6)] = v
    got = smoothed_rows(spark.createDataFrame(rows, "k int, t double, x double").repartition(5), ["k"], "t", ["x"], 0.7).collect()
    assert len(got) == 900 and all(r.smooth_x == pytest.approx(want[r.k, round(r.t, 6)], abs=1e-9) for r in got)
