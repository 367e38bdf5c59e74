"""Names handed between pieces of tracks: the known cases both ways, and runs that don't touch each other."""

import pytest
from pyspark.sql import functions as F

from playframe.operators import handoffs

BODY = "run_id int, segment_id int, track_id int, frame_index long, timestamp_s double, included boolean, role string, box array<double>, color string"


def body(frame, track, x, color="home", run=0, height=100.0):
    return (run, 0, track, frame, frame / 10, True, "player", [x - 10.0, 0.0, x + 10.0, height], color)


def scene(extra=(), color=lambda frame: "home", first=lambda frame: 100.0, later=lambda frame: 105.0):
    """Track 1 for four frames, then track 2 a little further on."""
    return [body(i, 1, first(i), color(i)) if i < 4 else body(i, 2, later(i), color(i)) for i in range(8)] + list(extra)


def found(spark, rows, known, cuts=(), reads=()):
    frame = spark.createDataFrame(rows, BODY)
    direct = spark.createDataFrame([(0, 0, k, i, t, n) for k, frames, t, n in known for i in frames], "run_id int, segment_id int, track_id int, frame_index long, team string, number string")
    cut = spark.createDataFrame([(0, 0, i) for i in cuts], "run_id int, segment_id int, frame_index long")
    read = spark.createDataFrame([(0, 0, *r) for r in reads], "run_id int, segment_id int, track_id int, frame_index long, number string, confidence double")
    got = handoffs.links(frame, direct, cut, read)
    return frame, direct, got, sorted((r.track_id, r.from_frame, r.to_frame, r.team, r.number, r.direction, r.source_track) for r in got.collect())


EARLY, LATE = (1, range(4), "home", "23"), (2, range(4, 8), "home", "23")
BACK, AHEAD = [(1, 0, 3, "home", "23", "backward", 2)], [(2, 4, 7, "home", "23", "forward", 1)]
CASES = {
    "forward": (dict(), [EARLY], {}, AHEAD),
    "backward": (dict(), [LATE], {}, BACK),
    "no name": (dict(), [], {}, []),
    "a body beside the end": (dict(extra=[body(3, 3, 145.0)]), [LATE], {}, []),
    "a body of the other team": (dict(extra=[body(3, 3, 145.0, "away")]), [LATE], {}, BACK),
    "a body without a track": (dict(extra=[body(4, None, 120.0, None)]), [EARLY], {}, []),
    "a cut": (dict(), [LATE], {"cuts": [4]}, []),
    "another colour in the target": (dict(color=lambda i: "away" if i == 3 else "home"), [LATE], {}, []),
    "another number in the target": (dict(), [LATE], {"reads": [(1, 2, "11", 0.95)]}, []),
    "an unsure other number": (dict(), [LATE], {"reads": [(1, 2, "11", 0.5)]}, BACK),
    "the own number": (dict(), [LATE], {"reads": [(1, 2, "23", 0.95)]}, BACK),
    "the track is still seen": (dict(extra=[body(i, 1, 300.0) for i in (4, 5)]), [LATE], {}, []),
    "too far": (dict(later=lambda i: 160.0), [LATE], {}, []),
    "two later players": (dict(later=lambda i: 65.0, extra=[body(i, 3, 135.0) for i in range(4, 8)]), [LATE, (3, range(4, 8), "home", "11")], {}, []),
    "the player is somewhere else": (dict(extra=[body(i, 5, 500.0) for i in range(8)]), [LATE, (5, range(4, 8), "home", "23")], {}, []),
}


@pytest.mark.parametrize("case", CASES)
def test_links(spark, case):
    how, known, more, want = CASES[case]
    assert found(spark, scene(**how), known, **more)[3] == want


def test_a_body_that_crosses_in_the_gap_voids_the_link(spark):
    def rows(x):
        lost = [body(i, 1, 100.0) for i in range(10)] + [body(i, 2, 104.0) for i in range(15, 24)]
        passing = [body(i, 7, 400.0) for i in (9, 15)] + [body(12, 7, x)]
        return [(r[0], r[1], r[2], r[3], r[3] / 30, *r[5:]) for r in lost + passing]

    assert found(spark, rows(400.0), [(1, range(10), "home", "23")])[3] == [(2, 15, 23, "home", "23", "forward", 1)]
    assert found(spark, rows(130.0), [(1, range(10), "home", "23")])[3] == []


def test_the_safe_part_ends_before_the_player_is_elsewhere(spark):
    rows = [body(i, 1, 100.0) for i in range(10)] + [body(i, 2, 105.0) for i in range(10, 14)] + [body(i, 5, 500.0) for i in range(10)]
    frame, direct, links, got = found(spark, rows, [(2, range(10, 14), "home", "23"), (5, range(5), "home", "23")])
    assert got == [(1, 5, 9, "home", "23", "backward", 2)]
    known = handoffs.known_frames(frame, direct, links)
    assert {(r.track_id, r.frame_index) for r in known.where("source = 'backward'").collect()} == {(1, i) for i in range(5, 10)}
    assert known.groupBy("frame_index", "team", "number").count().where(F.col("count") > 1).count() == 0
    assert found(spark, rows, [(2, range(10, 14), "home", "23"), (5, range(8), "home", "23")])[3] == []


def test_two_runs_give_what_each_gives(spark):
    one, two = scene(), [(1, *r[1:]) for r in scene(later=lambda i: 95.0)]
    direct = spark.createDataFrame([(run, 0, 2, i, "home", "23") for run in (0, 1) for i in range(4, 8)], "run_id int, segment_id int, track_id int, frame_index long, team string, number string")
    cut = spark.createDataFrame([(1, 0, 4)], "run_id int, segment_id int, frame_index long")
    read = spark.createDataFrame([], "run_id int, segment_id int, track_id int, frame_index long, number string, confidence double")
    got = handoffs.links(spark.createDataFrame(one + two, BODY), direct, cut, read).collect()
    assert [(r.run_id, r.track_id, r.direction) for r in got] == [(0, 1, "backward")]
