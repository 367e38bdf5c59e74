"""Which sightings of a track are read, and what the readings say so far: a budgeted, causal recogniser over a stream.

Sightings are rows (run, segment_id, frame_index, ts, track_id, confidence, quality,
number, read_confidence): ``quality`` of the crop, null where there is none to read, and
what a reader gives for it. Reading is what costs, so a schedule in source time decides
which crops are read: a track's best crop of a short window, not again for a while
(longer where its number is confirmed), a few a frame and a bounded number a second over
all tracks of a run. Readings vote; a number shows while recent votes agree.

All tracks of a run share its budget and its places, so a run is the unit of state: a
token bucket, at most ``tracks`` tracks, at most ``evidence_rows`` votes each. The stream
(``recognise``) holds sightings back until the watermark has passed them, so it gives
what one pass over the run in order of frames (``recognised``) gives, in whatever order
they come. Timers and expiry go by event time: a rerun forgets the same things.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: Times come in microseconds.
EPS = 1e-6


@dataclass(frozen=True)
class Schedule:
    """Seconds, counts and thresholds of the schedule; fixed values of the rules are the defaults."""

    batch: int = 4
    per_second: float = 8.0
    sample_every: float = 0.1
    window: float = 0.3
    read_every: float = 0.75
    confirmed_every: float = 3.0
    evidence_s: float = 12.0
    forget_s: float = 10.0
    tracks: int = 64
    evidence_rows: int = 8
    least_votes: int = 2
    agreement: float = 0.75
    least_read: float = 0.9
    least_seen: float = 0.4


class Sighting(NamedTuple):
    segment_id: int
    frame_index: int
    time_s: float
    track_id: int | None
    confidence: float
    quality: float | None
    number: str | None
    read_confidence: float


class Crop(NamedTuple):
    time: float
    frame: int
    quality: float
    number: str | None
    confidence: float
    since: float


class Decision(NamedTuple):
    number: str | None
    status: str
    votes: int
    agreement: float


@dataclass
class Track:
    first: int
    last: int
    seen: float
    read: float = -1e9
    sampled: float = -1e9
    crop: Crop | None = None
    votes: list[tuple[float, str, float]] = field(default_factory=list)  # time, number, weight
    known: tuple[list, Decision] | None = None  # the fresh votes of the last decision, and what they said

    def decision(self, now: float, s: Schedule) -> Decision:
        """By weight over the votes that are fresh; confirmed only if the last ones all agree, so one contradiction takes a number down."""
        votes = [v for v in self.votes if now - v[0] <= s.evidence_s + EPS]
        if not votes:
            return Decision(None, "unknown", 0, 0.0)
        if self.known is None or self.known[0] != votes:
            self.known = votes, self._of(votes, s)
        return self.known[1]

    @staticmethod
    def _of(votes: list[tuple[float, str, float]], s: Schedule) -> Decision:
        totals = {n: sum(w for _, m, w in votes if m == n) for n in {m for _, m, _ in votes}}
        weight, number = max((w, n) for n, w in totals.items())
        count, share = sum(m == number for _, m, _ in votes), weight / sum(totals.values())
        agreed = [n for _, n, _ in votes[-s.least_votes :]] == [number] * s.least_votes
        confirmed = agreed and count >= s.least_votes and share >= s.agreement
        return Decision(number if confirmed else None, "confirmed" if confirmed else "uncertain", count, share)


@dataclass
class Run:
    tokens: float
    now: float = 0.0
    segment: int | None = None
    tracks: dict[int, Track] = field(default_factory=dict)


ROW = "segment_id long, frame_index long, time_s double, track_id long, kind string, number string, votes int, agreement double, read_frame long"
FIELDS = [c.split()[0] for c in ROW.split(", ")]


def _ended(run: Run, tracks: Iterable[int], frame: int, now: float, why: str, s: Schedule) -> list[tuple]:
    out = []
    for k in list(tracks):
        track = run.tracks.pop(k)
        d = track.decision(now, s)
        out.append((run.segment, frame, now, k, why, d.number, d.votes, d.agreement, track.last))
    return out


def _place(run: Run, k: int, visible: set[int], frame: int, now: float, s: Schedule) -> list[tuple]:
    """Make room for track ``k``: where all places are taken, the track unseen for longest goes, if one is out of sight."""
    hidden = [(t.seen, i) for i, t in run.tracks.items() if i not in visible]
    gone = [min(hidden)[1]] if len(run.tracks) >= s.tracks and hidden else []
    out = _ended(run, gone, frame, now, "capacity_eviction", s)
    if len(run.tracks) < s.tracks:
        run.tracks[k] = Track(frame, frame, now)
    return out


def step(run: Run, sightings: list[Sighting], s: Schedule) -> list[tuple]:
    """One frame: what ends, what is read, and a row per sighting with the decision known now (``kind`` is its status)."""
    segment, frame, now = sightings[0][:3]
    out = _ended(run, run.tracks, frame, run.now, "scene_reset", s) if run.segment not in (None, segment) else []
    run.tokens = min(float(s.batch), run.tokens + max(0.0, now - run.now) * s.per_second)
    run.now, run.segment = now, segment
    out += _ended(run, [k for k, t in run.tracks.items() if now - t.seen > s.forget_s + EPS], frame, now, "expired", s)
    rows = [(r.track_id, r) for r in sightings]
    visible = {k for k, _ in rows if k is not None}
    for k, r in rows:
        sure = r.confidence >= s.least_seen
        if k is not None and k not in run.tracks and sure:
            out += _place(run, k, visible, frame, now, s)
        track = run.tracks.get(k)
        if track is None:
            continue
        track.seen, track.last = now, frame
        pause = s.confirmed_every if track.decision(now, s).number is not None else s.read_every
        if sure and r.quality is not None and now - track.read >= pause - EPS and now - track.sampled >= s.sample_every - EPS:
            track.sampled = now
            if track.crop is None or r.quality > track.crop.quality:
                track.crop = Crop(now, frame, r.quality, r.number, r.read_confidence, track.crop.since if track.crop else now)
    for track in run.tracks.values():
        if track.crop and now - track.crop.time > s.read_every + EPS:
            track.crop = None
    ready = sorted((run.tracks[k].read, run.tracks[k].crop.since, k) for k in visible & run.tracks.keys() if run.tracks[k].crop and now - run.tracks[k].crop.since >= s.window - EPS)
    read = {}
    for *_, k in ready[: min(s.batch, int(run.tokens + 1e-9))]:
        track, crop = run.tracks[k], run.tracks[k].crop
        run.tokens = max(0.0, run.tokens - 1)
        if crop.number is not None and crop.confidence >= s.least_read:
            track.votes = [*track.votes, (crop.time, crop.number, crop.confidence * crop.quality)][-s.evidence_rows :]
        track.read, track.crop, read[k] = now, None, crop.frame
    for k, r in rows:
        if k in run.tracks:
            d = run.tracks[k].decision(now, s)
        else:
            d = Decision(None, "untracked" if k is None else "capacity_limit" if r.confidence >= s.least_seen else "below_detection_confidence", 0, 0.0)
        out.append((segment, frame, now, k, d.status, d.number, d.votes, d.agreement, read.get(k)))
    return out


def _table(key: dict, found: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=FIELDS)
    for c in ("track_id", "read_frame"):
        out[c] = pd.array(out[c], "Int64")
    for i, (c, v) in enumerate(key.items()):
        out.insert(i, c, v)
    return out


def _in_order(rows: pd.DataFrame) -> Iterator[list[Sighting]]:
    """Frames in order; in a frame, sightings by track, of repeated ones the first."""
    rows = rows.sort_values(["frame_index", "track_id", "confidence", "quality"], ascending=[True, True, False, False], kind="stable", na_position="last")
    rows = rows[rows["track_id"].isna() | ~rows.duplicated(["frame_index", "track_id"])]
    columns = [rows[c].astype(object).where(rows[c].notna(), None) for c in ("track_id", "quality", "number")]
    track, quality, number = ([None if v is None else kind(v) for v in c] for kind, c in zip((int, float, str), columns, strict=True))
    plain = lambda c, kind: rows[c].astype(kind).tolist()
    sightings = map(Sighting, plain("segment_id", int), plain("frame_index", int), plain("time_s", float), track, plain("confidence", float), quality, number, plain("read_confidence", float))
    for _, frame in itertools.groupby(sightings, key=lambda r: r.frame_index):
        yield list(frame)


def prepared(sightings: DataFrame, run: str) -> DataFrame:
    """The columns that are used, with ``time_s`` from ``ts``; rows without a time, a frame or a segment can't be placed and are left out."""
    rows = sightings.where(F.col("ts").isNotNull() & F.col("frame_index").isNotNull() & F.col("segment_id").isNotNull())
    return rows.select(
        run, "ts", F.col("segment_id").cast("long"), F.col("frame_index").cast("long"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time_s"), F.col("track_id").cast("long"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.col("quality").cast("double"), F.col("number").cast("string"), F.coalesce(F.col("read_confidence").cast("double"), F.lit(0.0)).alias("read_confidence"),
    )


def recognised(sightings: DataFrame, run: str, schedule: Schedule | None = None) -> DataFrame:
    """A row per sighting, and one per track that ends before the run does (``kind`` says why): run, segment, frame, time, track, status, number, votes, agreement, and the frame whose crop was read now.

    A run is one pass, as its tracks share a budget. Of sightings of one track in a
    frame the surest counts. An empty table gives no rows.
    """
    s = schedule or Schedule()
    kind = dict(sightings.dtypes)[run]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        state = Run(float(s.batch))
        return _table({run: rows[run].iloc[0]}, [r for frame in _in_order(rows) for r in step(state, frame, s)])

    return prepared(sightings, run).drop("ts").groupBy(run).applyInPandas(fold, f"{run} {kind}, {ROW}")


HELD = {"segment_id": int, "time_s": float, "track_id": int, "confidence": float, "quality": float, "number": str, "read_confidence": float}


def _typed(rows: pd.DataFrame) -> list[tuple]:
    """Sightings as tuples for the state; a column with nulls comes as doubles, which a long field of the state would lose."""
    columns = [[None if pd.isna(v) else kind(v) for v in rows[c]] for c, kind in HELD.items()]
    return list(zip(*columns, strict=True))


class _Recogniser(StatefulProcessor):
    """Sightings wait in a map by frame until the watermark has passed them; a timer at each frame's time then runs all frames that are due."""

    def __init__(self, run: str, schedule: Schedule):
        self.run, self.schedule = run, schedule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "frame_index long", "rows array<struct<segment_id: long, time_s: double, track_id: long, confidence: double, quality: double, number: string, read_confidence: double>>")
        self.budget = handle.getValueState("budget", "tokens double, now double, segment long")
        track = "first long, last long, seen double, read double, sampled double, crop struct<time: double, frame: long, quality: double, number: string, confidence: double, since: double>, votes array<struct<time: double, number: string, weight: double>>"
        self.tracks = handle.getMapState("tracks", "track_id long", track)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timers = set(self.handle.listTimers())
        for part in rows:
            for frame, own in part.groupby("frame_index"):
                at = (int(frame),)
                before = list(self.waiting.getValue(at)[0]) if self.waiting.containsKey(at) else []
                self.waiting.updateValue(at, ([tuple(r) for r in before] + _typed(own),))
                due = int(own["time_s"].iloc[0] * 1000) + 1
                if due not in timers:
                    timers.add(due)
                    self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        state = self._restored()
        due = sorted((int(k[0]), list(v[0])) for k, v in self.waiting.iterator())
        due = [(frame, rows) for frame, rows in due if int(rows[0][1] * 1000) + 1 <= upto]
        if not due:
            return
        known, out = set(state.tracks), []
        for frame, rows in due:
            part = pd.DataFrame([tuple(r) for r in rows], columns=list(HELD))
            for own in _in_order(part.assign(frame_index=frame)):
                out += step(state, own, self.schedule)
            self.waiting.removeKey((frame,))
        self._kept(state, known)
        yield _table({self.run: key[0]}, out)

    def _restored(self) -> Run:
        state = Run(float(self.schedule.batch))
        if self.budget.exists():
            state.tokens, state.now, state.segment = self.budget.get()
        for (k,), v in self.tracks.iterator():
            first, last, seen, read, sampled, crop, votes = v
            state.tracks[k] = Track(first, last, seen, read, sampled, Crop(*crop) if crop else None, [tuple(x) for x in votes])
        return state

    def _kept(self, state: Run, known: set[int]) -> None:
        self.budget.update((state.tokens, state.now, state.segment))
        for k in known - state.tracks.keys():
            self.tracks.removeKey((k,))
        for k, t in state.tracks.items():
            self.tracks.updateValue((k,), (t.first, t.last, t.seen, t.read, t.sampled, tuple(t.crop) if t.crop else None, t.votes))

    def close(self) -> None:
        pass


def recognise(stream: DataFrame, run: str, delay: str, schedule: Schedule | None = None) -> DataFrame:
    """``recognised`` over a stream: each frame's rows once the watermark, ``delay`` behind the latest time of all runs, has passed it.

    What comes later than that is dropped by the watermark; send it aside with
    ``sessions.split_late`` before. Needs the RocksDB state store. State of a run is
    bounded by the schedule and by the sightings of ``delay``.
    """
    kind = dict(stream.dtypes)[run]
    rows = prepared(stream, run).withWatermark("ts", delay)
    return rows.groupBy(run).transformWithStateInPandas(_Recogniser(run, schedule or Schedule()), f"{run} {kind}, {ROW}", "append", "EventTime")
