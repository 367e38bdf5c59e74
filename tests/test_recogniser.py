"""The reading schedule: known cases, and the stream against one pass over each run, in any order and after a restart."""

import datetime
import random

from pyspark.sql import functions as F

from playframe.streaming import recogniser

SCHEMA = "run int, segment_id long, frame_index long, ts timestamp, track_id long, confidence double, quality double, number string, read_confidence double"
START = datetime.datetime(2024, 1, 1)


def seen(frame, track=1, number="23", confidence=0.9, quality=0.5, read=0.95, run=0, segment=0, fps=10):
    return (run, segment, frame, START + datetime.timedelta(seconds=frame / fps), track, confidence, quality, number, read)


def rows(spark, data, **settings):
    return recogniser.recognised(spark.createDataFrame(data, SCHEMA), "run", recogniser.Schedule(**settings)).orderBy("frame_index", "track_id").collect()


def test_two_agreeing_readings_confirm_and_slow_the_next_down(spark):
    got = rows(spark, [seen(i) for i in range(60)])
    read = [r.frame_index for r in got if r.read_frame is not None]
    assert read[:2] == [3, 14] and min(b - a for a, b in zip(read[1:], read[2:])) >= 30
    assert [r.kind for r in got[:3]] == ["unknown"] * 3 and got[3].kind == "uncertain" and got[14].number == "23" and got[14].votes == 2


def test_a_contradiction_takes_the_number_down(spark):
    got = rows(spark, [seen(i, number="23" if i < 20 else "32") for i in range(80)])
    shown = [r.number for r in got]
    first = next(i for i, r in enumerate(got) if i > 20 and r.read_frame is not None)
    assert shown[first - 1] == "23" and shown[first] is None and got[first].kind == "uncertain"


def test_unsure_readings_are_no_evidence(spark):
    got = rows(spark, [seen(i, read=0.89) for i in range(30)])
    assert {r.number for r in got} == {None} and {r.votes for r in got} == {0} and any(r.read_frame is not None for r in got)


def test_places_go_to_visible_tracks_and_not_to_weak_ones(spark):
    got = rows(spark, [seen(0), seen(1, 2), seen(2, 3, confidence=0.2), seen(2, 2)], tracks=1)
    assert [(r.frame_index, r.track_id, r.kind) for r in got] == [(0, 1, "unknown"), (1, 1, "capacity_eviction"), (1, 2, "unknown"), (2, 2, "unknown"), (2, 3, "below_detection_confidence")]
    assert [r.kind for r in rows(spark, [seen(0), seen(0, 2)], tracks=1)] == ["unknown", "capacity_limit"]


def test_the_budget_is_shared_by_all_tracks(spark):
    got = rows(spark, [seen(i, k) for i in range(100) for k in range(30)])
    reads = [r for r in got if r.read_frame is not None]
    per_frame = {}
    for r in reads:
        per_frame[r.frame_index] = per_frame.get(r.frame_index, 0) + 1
    assert max(per_frame.values()) <= 4 and len(reads) <= 4 + 8 * 10 and len({r.track_id for r in reads}) == 30


def test_a_cut_ends_all_tracks_and_silence_one(spark):
    got = rows(spark, [seen(0), seen(0, 2), seen(1, 1, segment=1), seen(120, 3, segment=1)])
    assert [(r.frame_index, r.track_id, r.kind) for r in got] == [(0, 1, "unknown"), (0, 2, "unknown"), (1, 1, "scene_reset"), (1, 1, "unknown"), (1, 2, "scene_reset"), (120, 1, "expired"), (120, 3, "unknown")]


def corpus(rng):
    data = []
    for run in (0, 1):
        for frame in range(150):
            for k in range(1, 8):
                if rng.random() < 0.8 and not (k == 3 and 30 < frame < 140):
                    data.append(seen(frame, None if k == 7 else k, str(k if rng.random() < 0.8 else 9), rng.choice([0.3, 0.9, 0.9]), rng.choice([None, 0.2, 0.5, 0.8]), rng.choice([0.5, 0.95]), run, frame // 80))
    return data


def test_the_stream_equals_one_pass_in_any_order_and_after_a_restart(spark, tmp_path):
    rng = random.Random(1)
    data = corpus(rng)
    settings = recogniser.Schedule(tracks=4, forget_s=5.0)
    # Shuffled within five seconds, in six files; the last file only moves the watermark.
    data.sort(key=lambda r: (r[3].timestamp() + rng.uniform(0, 5)))
    parts = [data[i * len(data) // 5 : (i + 1) * len(data) // 5] for i in range(5)] + [[seen(10_000, run=9)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, part in enumerate(parts):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if i in (2, 5):  # a first life with half of the files, a second one from its checkpoint
                stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
                out = recogniser.recognise(stream, "run", "6 seconds", settings).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
                out.awaitTermination(240)
                assert out.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = recogniser.recognised(spark.createDataFrame(data, SCHEMA), "run", settings)
    pick = lambda df: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.where("run < 9").collect()), key=str)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert pick(got.select(want.columns)) == pick(want) and want.where(F.col("kind") == "capacity_eviction").count() > 0


def test_a_run_is_folded_as_plain_sightings_and_a_decision_is_kept_while_its_votes_are_fresh():
    import pandas as pd

    rows = pd.DataFrame({"segment_id": 0, "frame_index": [1, 0, 0, 0], "time_s": [0.1, 0.0, 0.0, 0.0], "track_id": [2.0, None, 2.0, 2.0], "confidence": [0.9, 0.8, 0.5, 0.7], "quality": [None, 0.5, 0.5, 0.6], "number": [None, "4", "4", "5"], "read_confidence": 0.9})
    frames = list(recogniser._in_order(rows))
    assert frames == [[(0, 0, 0.0, 2, 0.7, 0.6, "5", 0.9), (0, 0, 0.0, None, 0.8, 0.5, "4", 0.9)], [(0, 1, 0.1, 2, 0.9, None, None, 0.9)]]
    s = recogniser.Schedule()
    track = recogniser.Track(0, 0, 0.0, votes=[(0.0, "4", 1.0), (5.0, "4", 1.0)])
    sure = track.decision(6.0, s)
    assert sure == ("4", "confirmed", 2, 1.0) and track.decision(7.0, s) is sure
    assert track.decision(13.0, s) == (None, "uncertain", 1, 1.0) and track.decision(18.0, s).status == "unknown"
    track.votes = [*track.votes, (6.0, "5", 1.0)]
    assert track.decision(7.0, s) == (None, "uncertain", 2, 2 / 3)
