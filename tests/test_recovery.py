"""Frames read again, and readings joined so that crops of one frame add no votes."""

from playframe.operators import recovery

READ = "segment_id int, track_id int, frame_index long, decoder string, number string, confidence double"


def frames_of(spark, frames, samples, reads=(), named=()):
    bodies = spark.createDataFrame([(0, 1, i) for i in frames], "segment_id int, track_id int, frame_index long")
    names = spark.createDataFrame([(0, k) for k in named], "segment_id int, track_id int")
    got = recovery.wanted_frames(bodies, names, spark.createDataFrame(list(reads), READ), samples).collect()
    return {r.frame_index for r in got if not r.anchored}, {r.frame_index for r in got if r.anchored}


def test_samples_span_the_track(spark):
    assert frames_of(spark, range(10, 110), 3) == ({10, 60, 109}, set())
    assert frames_of(spark, range(0, 30, 2), 15) == (set(range(0, 30, 2)), set())
    assert frames_of(spark, range(14), 3) == (set(), set())
    assert frames_of(spark, range(100), 3, named=[1]) == (set(), set())


def test_frames_around_a_sure_reading_are_read_too(spark):
    reads = [(0, 1, 50, "new", "7", 0.9), (0, 1, 20, "new", "7", 0.5), (0, 1, 21, "new", None, 0.9)]
    even, near = frames_of(spark, range(0, 60), 3, reads)
    assert near == {34, 42, 46, 48, 50, 52, 54, 58} and even == {0, 30, 59}


def test_crops_of_one_frame_add_no_votes(spark):
    def merged(previous, recovered):
        rows = recovery.merged_reads(spark.createDataFrame(previous, READ), spark.createDataFrame(recovered, READ), "new").collect()
        return sorted(map(tuple, rows))

    old, better = (1, 2, 50, "new", "27", 0.92), (1, 2, 50, "new", "27", 0.99)
    legacy, worse, extra = (1, 2, 50, "old", "27", 0.92), (1, 2, 50, "new", "27", 0.8), (1, 2, 52, "new", "27", 0.99)
    assert merged([legacy, old], [better]) == sorted([legacy, better])
    assert merged([old], [worse]) == [old]
    assert merged([old], [better, extra]) == [better, extra]
    assert merged([], [better, old, extra]) == [better, extra]
