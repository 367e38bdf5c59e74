import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from playframe.functions import text
from playframe.operators import aggregates as agg
from playframe.operators import distance as dist
from playframe.operators import joins, matching, sequence
from playframe.sources import observations


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def track(spark, xs, dt=0.1, **more):
    data = [(i, i * dt, None if x is None else float(x), 0.0) for i, x in enumerate(xs)]
    return spark.createDataFrame(data, "frame long, t double, x double, y double").withColumns({"track": F.lit(1), "status": F.lit("projected"), "segment": F.lit(0), **more})


def totals(df, **more):
    pairs = dist.distance_pairs(df, ["track"], "t", ("x", "y"), 0.2 + 1e-9, 12.0, frame="frame", status="status", **more)
    return dist.subject_totals(pairs, ["track"]).first(), pairs


def test_known_line(spark):
    got, _ = totals(track(spark, [0.1 * i for i in range(11)]))
    assert got.distance == pytest.approx(1.0) and got.coverage == pytest.approx(1.0) and got.status == "ok"


def test_missing_position_is_not_bridged(spark):
    got, pairs = totals(track(spark, [0, 0.1, None, 0.3, 0.4]))
    assert got.distance == pytest.approx(0.2) and got.coverage == pytest.approx(0.5) and got.status == "partial"
    assert rows(dist.excluded_intervals(pairs, ["track"]), "reason", "n") == [("projected", 2)]


def test_missing_detection_and_cut(spark):
    got, _ = totals(track(spark, [0, 0.1, 0.2, 0.3, 0.4]).where("frame <> 2"))
    assert got.distance == pytest.approx(0.2)
    cut, _ = totals(track(spark, [0, 0.1, 10, 10.1]).withColumn("segment", F.expr("int(frame >= 2)")), same=["segment"])
    assert cut.distance == pytest.approx(0.2)


def test_null_is_not_zero(spark):
    assert totals(track(spark, [1]))[0].distance is None and totals(track(spark, [1]))[0].status == "unavailable"
    assert totals(track(spark, [1, 1]))[0].distance == 0


def test_jump_and_gap(spark):
    assert totals(track(spark, [0, 10]))[0].distance is None
    assert totals(track(spark, [0, 0.1], dt=1.0))[0].distance is None


def test_islands_and_missing_ranges(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 7, 8, -5)] + [("b", 4)], "k string, v long")
    assert rows(sequence.island_ranges(df, ["k"], "v", 1), "k", "first", "last", "n") == [("a", -5, -5, 1), ("a", 1, 3, 3), ("a", 7, 8, 2), ("b", 4, 4, 1)]
    assert rows(sequence.missing_ranges(df.where("k = 'a'"), "v", bucket=4), "first", "last", "n") == [(-4, 0, 5), (4, 6, 3)]
    assert sequence.missing_ranges(df.limit(0), "v").count() == 0


def test_spans_overlaps_and_union(spark):
    rng = random.Random(2)
    spans = [(i, a, a + rng.randint(0, 30)) for i, a in ((i, rng.randint(-60, 60)) for i in range(60))]
    left = spark.createDataFrame([(1, i, a, z) for i, a, z in spans[:30]], "k int, i long, a long, z long")
    right = spark.createDataFrame([(1, i, a, z) for i, a, z in spans[30:]], "k int, j long, b long, y long")
    want = sorted((i, j) for i, a, z in spans[:30] for j, b, y in spans[30:] if max(a, b) < min(z, y))
    assert sorted(map(tuple, joins.overlaps(left, right, ["k"], ("a", "z"), ("b", "y"), 7).select("i", "j").collect())) == want
    covered = {x for _, a, z in spans[:30] for x in range(a, z)}
    assert agg.union_duration(left, ["k"], "a", "z").first().duration == len(covered)
    merged = sequence.merge_spans(spark.createDataFrame([(1, 0.0, 1.0, "x"), (1, 1.0, 2.0, "x"), (1, 2.0, 3.0, "y"), (1, 5.0, 6.0, "y")], "k int, a double, z double, s string"), ["k"], "a", "z", ["s"])
    assert rows(merged, "a", "z", "s") == [(0.0, 2.0, "x"), (2.0, 3.0, "y"), (5.0, 6.0, "y")]


def test_asof_never_looks_ahead(spark):
    left = spark.createDataFrame([(1, float(t)) for t in (0, 3, 5, 9)], "k int, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 4.0, None), (1, 5.0, "c")], "k int, t double, v string")
    assert rows(joins.asof(left, right, ["k"], "t", "v", 2.0, "held"), "t", "held") == [(0.0, None), (3.0, "a"), (5.0, "c"), (9.0, None)]


def test_votes(spark):
    df = spark.createDataFrame([("k", v, i) for i, v in enumerate("abbaac")], "k string, v string, t int")
    assert agg.majority(df, ["k"], "v", "t", 3, 0.5, strict=False).first().winner == "a"
    assert agg.majority(df, ["k"], "v", "t", 3, 0.5).first().winner is None
    assert agg.majority(df, ["k"], "v", "t", 9).first().share == 0.0
    tied = agg.majority(df.where("t < 4"), ["k"], "v", "t", 1, 0.0, strict=False).first()
    assert (tied.winner, tied.votes) == ("a", 4)


def test_sustained_switch(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(["a", None, "a", "b", "a", "a", "b", "b", None, "b", "b"])], "k string, t int, v string")
    assert [r.episode for r in sequence.switches(df, ["k"], "t", "v").orderBy("t").collect()] == [0] * 6 + [1] * 5


def test_grid_keeps_mass(spark):
    df = spark.createDataFrame([(0.0, 0.0, 28.0, 15.0, 3.0), (5.0, 5.0, 5.0, 5.0, 1.5)], "ax double, ay double, bx double, by double, w double")
    samples = agg.segment_samples(df, ("ax", "ay"), ("bx", "by"), "w", 0.2)
    grid = agg.grid_mass(samples.drop("ax").withColumn("k", F.lit(1)), ["k"], "x", "y", "w", (28.0, 15.0), (28, 16))
    assert grid.agg(F.sum("mass")).first()[0] == pytest.approx(4.5)
    assert agg.density(grid, ["k"], (28, 16), 0.85).agg(F.sum("density")).first()[0] == pytest.approx(4.5)


def test_quadratic(spark):
    df = spark.createDataFrame([(1, t, 2 * t * t - 3 * t + 5) for t in (0.0, 0.13, 0.2, 0.41, 0.7)], "k int, t double, y double")
    got = agg.quadratic_fit(df, ["k"], "t", "y").first()
    assert (got.a, got.b, got.c) == (pytest.approx(2), pytest.approx(-3), pytest.approx(5))


def test_text(spark):
    df = spark.createDataFrame([("11:24",), ("8.7",), ("11:65",), ("1124",), ("",), (None,), ("99.9",)], "s string")
    assert [r[0] for r in df.select(text.clock_seconds(F.col("s"))).collect()] == [684.0, 8.7, None, None, None, None, None]
    periods = spark.createDataFrame([(p,) for p in ("1ST", "2ND", "3RD", "4TH", "OT", "2OT", "x", None)], "s string")
    assert [r[0] for r in periods.select(text.period(F.col("s"))).collect()] == [1, 2, 3, 4, 5, 6, None, None]
    numbers = spark.createDataFrame([(n,) for n in ("0", "00", "7", "123", "7\n", "a", None)], "s string")
    assert [r[0] for r in numbers.select(text.jersey_number(F.col("s"))).collect()] == ["0", "00", "7", None, None, None, None]


def test_assignment_is_optimal():
    import itertools

    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 3), (6, 6)):
        cost = rng.normal(size=(n, m))
        got = matching.assignment(cost)
        small, large = sorted((n, m))
        best = min(sum((cost if n <= m else cost.T)[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len(got) == small and sum(cost[i, j] for i, j in got) == pytest.approx(best)


def test_greedy_match_counts(spark):
    box = "frame long, id long, x1 double, y1 double, x2 double, y2 double"
    p = spark.createDataFrame([(1, 1, 0.0, 0.0, 2.0, 2.0, 0.9), (1, 2, 0.0, 0.0, 2.0, 2.1, 0.8), (2, 3, 0.0, 0.0, 1.0, 1.0, 0.5)], box + ", score double")
    t = spark.createDataFrame([(1, 7, 0.0, 0.0, 2.0, 2.0), (3, 8, 0.0, 0.0, 1.0, 1.0)], box)
    assert rows(matching.greedy_match(p, t, "frame", 0.5), "frame", "outcome") == [(1, "fp"), (1, "tp"), (2, "fp"), (3, "fn")]


def test_observations(spark, tmp_path):
    line = '{"frame_index": 0, "timestamp_s": 0.0, "persons": [{"observation_id": "a", "track_id": 1, "position_m": [1.0, 2.0], "confidence": 2.0}, {"observation_id": "a", "track_id": 1}]}'
    (tmp_path / "o.jsonl").write_text(line + "\n")
    frames = observations.read_observations(spark, str(tmp_path / "o.jsonl"))
    assert rows(observations.persons(frames), "person_index", "track_id", "x", "y") == [(0, 1, 1.0, 2.0), (1, 1, None, None)]
    assert {r.rule for r in observations.violations(frames).collect()} == {"repeated_observation_id", "repeated_track_id", "confidence_range"}
    for n in (3, 5):
        observations.publish(spark.range(n).toDF("id"), str(tmp_path / "table"))
        assert spark.read.parquet(str(tmp_path / "table")).count() == n


def test_switches_equal_a_fold(spark):
    """Of two and of four labels, with and without gaps."""
    import random

    from playframe.operators import sequence

    rng = random.Random(2)
    tracks = {}
    for k in range(30):
        t, label, labels = 0, "a", "ab" if k % 3 == 0 else "abcd"
        rows = tracks.setdefault(k, [])
        for _ in range(rng.randint(1, 120)):
            t += rng.choice([1, 1, 1, 2, 9])
            label = rng.choice(labels) if rng.random() < 0.12 else label
            rows.append((t, None if rng.random() < 0.15 else label if rng.random() < 0.8 else rng.choice(labels)))
    df = spark.createDataFrame([(k, *r) for k, rows in tracks.items() for r in rows], "k int, t int, v string")
    for gap in (None, 5):
        want = []
        for k, rows in tracks.items():
            ahead = [next((v for _, v in rows[i:] if v), None) for i in range(len(rows))]
            now, episode = ahead[0], 0
            for i, (t, v) in enumerate(rows):
                near = [x for _, x in rows[i : i + 5]]
                if gap and i and t - rows[i - 1][0] > gap:
                    now, episode = ahead[i], episode + 1
                elif v and v != now and near.count(v) >= 3 and now not in near:
                    now, episode = v, episode + 1
                want.append((k, t, episode))
        assert sorted((r.k, r.t, r.episode) for r in sequence.switches(df, ["k"], "t", "v", gap=gap).collect()) == sorted(want)
