"""Fits and filters of motion: homographies from point pairs, and tracks from boxes by a constant-velocity filter with two-stage association."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from playframe.operators.matching import assignment, iou_matrix

Keys = list[str]


def _normalised(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centre = points.mean(0)
    scale = np.sqrt(2) / max(np.linalg.norm(points - centre, axis=1).mean(), 1e-12)
    return (points - centre) * scale, np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1]])


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 matrix of least algebraic error between normalised points; null for fewer than four or a degenerate set."""
    if len(source) < 4:
        return None
    (a, ta), (b, tb) = _normalised(source), _normalised(target)
    rows = []
    for (x, y), (u, v) in zip(a, b, strict=True):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    m = np.linalg.inv(tb) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ ta
    if abs(m[2, 2]) <= 1e-12 or not np.isfinite(m).all() or abs(np.linalg.det(m / m[2, 2])) <= 1e-12:
        return None
    return m / m[2, 2]


def _errors(m: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    p = np.column_stack([source, np.ones(len(source))]) @ m.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.linalg.norm(p[:, :2] / p[:, 2:] - target, axis=1), nan=np.inf)


def fitted_homographies(pairs: DataFrame, keys: Keys, threshold: float, samples: int = 512, seed: int = 7) -> DataFrame:
    """Per key a homography from point pairs (x, y, u, v) that outliers don't sway: ``matrix`` (nine numbers, null if none), ``inliers``, ``points``.

    Seeded samples of four points compete by their inliers, then by least error; the
    inliers of the best are fitted, their set renewed and fitted again.
    """
    kinds = dict(pairs.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], "matrix array<double>, inliers int, points int"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["x", "y", "u", "v"]).sort_values(["x", "y", "u", "v"], kind="stable") if len(rows) else rows
        head = [rows[c].iloc[0] for c in keys] if len(rows) else []
        a, b = rows[["x", "y"]].to_numpy(float), rows[["u", "v"]].to_numpy(float)
        rng, best, kept = np.random.default_rng(seed), (-1, 0.0), None
        for _ in range(samples if len(a) > 4 else 1 if len(a) == 4 else 0):
            pick = rng.choice(len(a), 4, replace=False)
            m = homography(a[pick], b[pick])
            if m is None:
                continue
            e = _errors(m, a, b)
            near = e <= threshold
            score = (int(near.sum()), -float(e[near].sum()))
            if score > best:
                best, kept = score, near
        m = homography(a[kept], b[kept]) if kept is not None and kept.sum() >= 4 else None
        if m is not None:
            kept = _errors(m, a, b) <= threshold
            m = homography(a[kept], b[kept]) if kept.sum() >= 4 else m
        return pd.DataFrame([(*head, None if m is None else m.reshape(-1).tolist(), 0 if m is None else int(kept.sum()), len(a))] if head or not keys else [], columns=[*keys, "matrix", "inliers", "points"])

    return pairs.groupBy(*keys).applyInPandas(fit, schema)


#: Fixed values of the box filter: deviations of centre x, centre y, aspect and height and of their speeds. Those marked 0 are
#: absolute, as aspect has no unit; the others are shares of the box height. At the start, of each step, of a measurement.
SHARES = {"start": (0.1, 0.1, 0, 0.1, 0.0625, 0.0625, 0, 0.0625), "step": (0.05, 0.05, 0, 0.05, 0.00625, 0.00625, 0, 0.00625), "seen": (0.05, 0.05, 0, 0.05)}
ABSOLUTE = {"start": (0, 0, 1e-2, 0, 0, 0, 1e-5, 0), "step": (0, 0, 1e-2, 0, 0, 0, 1e-5, 0), "seen": (0, 0, 1e-1, 0)}
#: A step moves each quantity by its speed; a measurement shows the quantities.
STEP = np.eye(8) + np.eye(8, k=4)
SHOWN = np.eye(4, 8)
TENTATIVE, FOLLOWED, LOST = range(3)
#: Limits of the second and third association, and the overlap of tracks on one body.
WEAK_LIMIT, TENTATIVE_LIMIT, ONE_BODY = 0.5, 0.7, 0.85


def predicted(mean: np.ndarray, spread: np.ndarray, step: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States (n, d) and covariances (n, d, d) of linear systems after one step."""
    return mean @ step.T, step @ spread @ step.T + noise


def corrected(mean: np.ndarray, spread: np.ndarray, seen: np.ndarray, shown: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States and covariances given measurements ``seen`` (n, m) of ``shown`` (m, d) times the state, of covariance ``noise``."""
    cross = spread @ shown.T
    gain = cross @ np.linalg.inv(shown @ cross + noise)
    return mean + np.einsum("nij,nj->ni", gain, seen - mean @ shown.T), spread - gain @ np.swapaxes(cross, 1, 2)


def _noise(kind: str, heights: np.ndarray) -> np.ndarray:
    deviation = np.outer(heights, SHARES[kind]) + np.array(ABSOLUTE[kind])
    return (deviation**2)[:, :, None] * np.eye(deviation.shape[1])


def _measured(boxes: np.ndarray) -> np.ndarray:
    w, h = (boxes[:, 2:] - boxes[:, :2]).T
    return np.column_stack([(boxes[:, :2] + boxes[:, 2:]) / 2, w / h, h])


def _boxes(mean: np.ndarray) -> np.ndarray:
    half = np.column_stack([mean[:, 2] * mean[:, 3], mean[:, 3]]) / 2
    return np.column_stack([mean[:, :2] - half, mean[:, :2] + half])


class Tracks:
    """The tracks of many keys as columns: filter state, key, number, first and last frame, status; those of one key in the order they began."""

    def __init__(self, keys: int):
        self.mean, self.spread = np.zeros((0, 8)), np.zeros((0, 8, 8))
        self.info = np.zeros((0, 5), np.int64)  # number, first frame, last frame, status, key
        self.count = np.zeros(keys, np.int64)

    def of(self, status: int) -> np.ndarray:
        return np.flatnonzero(self.info[:, 3] == status)

    def keep(self, rows: np.ndarray) -> None:
        self.mean, self.spread, self.info = self.mean[rows], self.spread[rows], self.info[rows]

    def move(self) -> None:
        """A step for tracks that have been confirmed; a lost one doesn't grow."""
        rows = np.flatnonzero(self.info[:, 3] != TENTATIVE)
        self.mean[self.of(LOST), 7] = 0
        self.mean[rows], self.spread[rows] = predicted(self.mean[rows], self.spread[rows], STEP, _noise("step", self.mean[rows, 3]))

    def see(self, rows: np.ndarray, boxes: np.ndarray, frames: np.ndarray) -> None:
        self.mean[rows], self.spread[rows] = corrected(self.mean[rows], self.spread[rows], _measured(boxes), SHOWN, _noise("seen", self.mean[rows, 3]))
        self.info[rows, 2], self.info[rows, 3] = frames, FOLLOWED

    def begin(self, keys: np.ndarray, boxes: np.ndarray, frames: np.ndarray, statuses: np.ndarray) -> np.ndarray:
        """``keys`` ascend; the numbers of a key go on from its last."""
        fresh = np.column_stack([_measured(boxes), np.zeros((len(boxes), 4))])
        numbers = self.count[keys] + 1 + np.arange(len(keys)) - np.searchsorted(keys, keys)
        np.add.at(self.count, keys, 1)
        self.mean, self.spread = np.concatenate([self.mean, fresh]), np.concatenate([self.spread, _noise("start", fresh[:, 3])])
        self.info = np.concatenate([self.info, np.column_stack([numbers, frames, frames, statuses, keys])])
        return numbers

    def apart(self) -> None:
        """Of a followed and a lost track on one body the one that was seen over more frames stays, the lost one if equal."""
        a, b = self.of(FOLLOWED), self.of(LOST)
        i, j = _same_key(self.info[a, 4], self.info[b, 4])
        over = _overlap(_boxes(self.mean[a])[i], _boxes(self.mean[b])[j]) > ONE_BODY
        a, b = a[i[over]], b[j[over]]
        age = self.info[:, 2] - self.info[:, 1]
        self.keep(np.setdiff1d(np.arange(len(self.info)), np.where(age[a] > age[b], b, a)))


def _same_key(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of places in ``a`` and ``b`` with equal keys."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = high - low
    return np.repeat(np.arange(len(a)), n), order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of boxes row by row."""
    size = np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2])
    both = np.clip(size[:, 0], 0, None) * np.clip(size[:, 1], 0, None)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a) + area(b) - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def _matched(tracks: np.ndarray, track_keys: np.ndarray, boxes: np.ndarray, box_keys: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of least total cost 1 - IoU among those up to ``limit``, within each key.

    Where no track and no box of a key has two partners, its pairs are the answer; other keys are searched.
    """
    i, j = _same_key(track_keys, box_keys)
    cost = 1 - _overlap(tracks[i], boxes[j])
    able = cost <= limit
    i, j = i[able], j[able]
    several = (np.bincount(i, minlength=len(tracks))[i] > 1) | (np.bincount(j, minlength=len(boxes))[j] > 1)
    crowded = np.unique(track_keys[i[several]])
    alone = ~np.isin(track_keys[i], crowded)
    found = [np.column_stack([i[alone], j[alone]])]
    for key in crowded:
        own, seen = np.flatnonzero(track_keys == key), np.flatnonzero(box_keys == key)
        cost = 1 - iou_matrix(tracks[own], boxes[seen])
        found.append(np.array([(own[r], seen[c]) for r, c in assignment(np.where(cost <= limit, cost - limit - 1, 0.0)) if cost[r, c] <= limit], int).reshape(-1, 2))
    return tuple(np.concatenate(found).T)


def followed(keys: np.ndarray, rows: pd.DataFrame, high: float, low: float, new: float, match: float, buffer: int) -> np.ndarray:
    """The track number of each box, 0 for none; ``keys`` (0, 1, ...) ascend, and frames within them.

    Keys don't touch each other, so the first frames of all go through at once, then the second ones.
    """
    at = rows["frame_index"].to_numpy(np.int64)
    all_boxes, all_scores, resets = rows[["x1", "y1", "x2", "y2"]].to_numpy(float), rows["score"].to_numpy(float), rows["reset"].fillna(True).to_numpy(bool)
    starts = np.concatenate([[True], (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])])[: len(keys)]
    which = np.cumsum(starts) - 1
    first = np.flatnonzero(starts)
    turn = which - which[np.searchsorted(keys, keys)]  # the how many-th frame of its key
    order = np.argsort(turn, kind="stable")
    tracks, out = Tracks(int(keys[-1]) + 1 if len(keys) else 0), np.zeros(len(keys), np.int64)
    # What is tried in turn: which tracks, which of the boxes that are left, up to which cost, and what becomes of tracks without a box.
    stages = (((FOLLOWED, LOST), lambda s: s >= high, match, None), ((FOLLOWED,), lambda s: (s > low) & (s < high), WEAK_LIMIT, LOST), ((TENTATIVE,), lambda s: s >= high, TENTATIVE_LIMIT, "gone"))
    fresh_frame = np.logical_or.reduceat(resets, first) | (turn[first] == 0) if len(first) else np.zeros(0, bool)
    for now in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1):
        own, boxes, scores, frames, fresh = keys[now], all_boxes[now], all_scores[now], at[now], fresh_frame[which[now]]
        frame = np.full(len(tracks.count), -1, np.int64)  # of each key, -1 once it has ended
        going = np.zeros(len(tracks.count), bool)
        frame[own], going[own] = frames, ~fresh
        of = tracks.info[:, 4]
        tracks.keep(np.flatnonzero((frame[of] - tracks.info[:, 2] <= buffer) & going[of]))
        tracks.move()
        of = tracks.info[:, 4]
        waiting = np.ones(len(tracks.info), bool)
        given, number = np.zeros(len(now), bool), np.zeros(len(now), np.int64)
        before = tracks.info[:, 3].copy()
        for statuses, able, limit, missed in stages:
            pool = np.flatnonzero(waiting & np.isin(before, statuses))
            left = np.flatnonzero(able(scores) & ~given)
            i, j = _matched(_boxes(tracks.mean[pool]), of[pool], boxes[left], own[left], limit)
            tracks.see(pool[i], boxes[left[j]], frames[left[j]])
            waiting[pool[i]], given[left[j]], number[left[j]] = False, True, tracks.info[pool[i], 0]
            if missed == LOST:
                tracks.info[pool[waiting[pool]], 3] = LOST
        tracks.keep(np.flatnonzero(~(waiting & (before == TENTATIVE))))
        left = np.flatnonzero(~given & (scores >= max(new, high)))
        born = tracks.begin(own[left], boxes[left], frames[left], np.where(fresh[left], FOLLOWED, TENTATIVE))
        number[left] = np.where(fresh[left], born, 0)
        tracks.apart()
        out[now] = number
    return out


#: Boxes of whole keys that go through the filter at once.
ROWS_AT_ONCE = 100_000


def tracked(detections: DataFrame, keys: Keys, high: float = 0.25, low: float = 0.1, new: float = 0.25, match: float = 0.8, buffer: int = 30) -> DataFrame:
    """Detections (frame_index, id, score, x1, y1, x2, y2, reset) with ``track_id``, per key (a run and role) in the order of frames.

    Three stages: confirmed tracks with scores from ``high`` on (cost up to ``match``),
    those followed so far with scores above ``low`` (0.5), tentative ones with what is
    left of the high (0.7). A box from ``new`` on that is left begins a track, tentative
    unless the frame is the key's first or a reset. A lost track waits ``buffer`` frames.
    Of a followed and a lost track on one place (IoU over 0.85) the longer-lived stays.
    Detections without a confirmed track have none. State passes from frame to frame, so
    a key, one camera run, is one fold over its boxes; the keys of a task go through
    the filter side by side.
    """
    kinds = dict(detections.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], f"frame_index long, id {kinds['id']}, track_id long"])

    def numbered(rows: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(rows), bool)
        for c in keys:
            own, last = rows[c], rows[c].shift()
            new |= ~((own == last) | (own.isna() & last.isna())).fillna(False).to_numpy(bool)
        return np.concatenate([[0], np.cumsum(new[1:])]) if len(rows) else np.zeros(0, np.int64)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_key=numbered(rows)).sort_values(["_key", "frame_index", "id"], kind="stable")
        number = pd.Series(followed(rows["_key"].to_numpy(), rows, high, low, new, match, buffer), rows.index, dtype="Int64")
        return rows[[*keys, "frame_index", "id"]].assign(track_id=number.where(number > 0))

    def task(parts):
        held, n = [], 0
        for part in parts:
            held.append(part)
            n += len(part)
            if n >= ROWS_AT_ONCE:
                rows = pd.concat(held, ignore_index=True)
                own = numbered(rows)
                whole = int(np.searchsorted(own, own[-1]))  # the last key may go on
                if whole:
                    yield fold(rows.iloc[:whole])
                held = [rows.iloc[whole:]]
                n = min(len(held[0]), ROWS_AT_ONCE - 1) if whole else 0
        if held and sum(map(len, held)):
            yield fold(pd.concat(held, ignore_index=True))

    return detections.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "frame_index", "id", "score", "x1", "y1", "x2", "y2", "reset").mapInPandas(task, schema)


def peaks(maps: DataFrame, keys: Keys, width: int, least: float = 0.5) -> DataFrame:
    """Per map (``cells``, row by row) the middle of the largest bounding box of connected cells from ``least`` on: ``x``, ``y``, null if there is none.

    Cells touch at edges and corners; of equal boxes the first from the top left counts.
    """
    kinds = dict(maps.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], "x double, y double"])

    def task(parts):
        for part in parts:
            spots = [largest_region(np.array([np.nan if v is None else v for v in c], float), width, least) for c in part["cells"]]
            out = part[keys].copy()
            out["x"], out["y"] = (pd.array([s[i] for s in spots], "Float64") for i in (0, 1))
            yield out

    return maps.select(*keys, "cells").mapInPandas(task, schema)


def largest_region(cells: np.ndarray, width: int, least: float) -> tuple[float | None, float | None]:
    """The middle of the region of connected cells with the largest bounding box.

    Every cell takes the smallest label around it, then labels of labels, until none changes.
    """
    on = (cells >= least).reshape(-1, width)
    ys, xs = np.nonzero(on)
    if not len(ys):
        return None, None
    place = np.full((on.shape[0] + 2, width + 2), -1)
    place[ys + 1, xs + 1] = np.arange(len(ys))
    near = np.stack([place[ys + 1 + dy, xs + 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    near = np.where(near < 0, np.arange(len(ys)), near)
    label = np.arange(len(ys))
    while True:
        least_near = label[near].min(0)
        np.minimum.at(least_near, label, least_near.copy())
        least_near = least_near[least_near]
        if np.array_equal(least_near, label):
            break
        label = least_near
    first, of = np.unique(label, return_inverse=True)
    low = np.full((2, len(first)), np.iinfo(np.int64).max)
    high = np.full((2, len(first)), -1)
    for axis, v in enumerate((xs, ys)):
        np.minimum.at(low[axis], of, v)
        np.maximum.at(high[axis], of, v)
    best = int(np.argmax(np.prod(high - low + 1, axis=0)))
    return tuple(((low[:, best] + high[:, best] + 1) / 2).tolist())
