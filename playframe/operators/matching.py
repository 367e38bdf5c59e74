"""One-to-one matching of two sets of boxes within a frame: greedy by score, and optimal assignment.

A frame holds at most a few hundred boxes, so each frame's rows are one small
group; frames are independent and spread over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = ["x1", "y1", "x2", "y2"]


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    both = np.clip(w, 0, None) * np.clip(h, 0, None)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost, by shortest augmenting paths with potentials."""
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assignment(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # the last column is where a row starts its search
    for row in range(n):
        owner[m], at = row, m
        least, came, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            done[at] = True
            i = owner[at]
            slack = cost[i] - u[i] - v[:m]
            better = ~done[:m] & (slack < least)
            least[better], came[better] = slack[better], at
            step_to = int(np.argmin(np.where(done[:m], np.inf, least)))
            step = least[step_to]
            for j in np.flatnonzero(done):
                u[owner[j]] += step
                v[j] -= step
            least[~done[:m]] -= step
            at = step_to
        while at != m:
            owner[at] = owner[came[at]]
            at = came[at]
        owner[m] = -1
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0)


def _in_frames(predictions: DataFrame, truths: DataFrame, frame: str, func, schema: str) -> DataFrame:
    names = predictions.columns, truths.columns

    def whole(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:  # a frame that one side lacks comes without columns
        return func(p.reindex(columns=names[0]), t.reindex(columns=names[1]))

    # Both sides may come from one table; under a projection Spark then mixes up their equal attributes unless one side has new ones.
    own = truths.select(*[F.col(c).alias(c) for c in truths.columns])
    return predictions.groupBy(frame).cogroup(own.groupBy(frame)).applyInPandas(whole, schema)


def greedy_match(predictions: DataFrame, truths: DataFrame, frame: str, threshold: float) -> DataFrame:
    """Outcome of every box: predictions by falling score (then id) take the free truth of highest IoU at or over ``threshold``.

    Both sides have ``frame``, ``id``, x1, y1, x2, y2; predictions also ``score``.
    Returns ``frame``, ``outcome`` (tp, fp or fn), ``prediction_id``, ``truth_id`` and ``iou``.
    """
    kind = dict(predictions.dtypes)[frame]

    def match(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        p, t = p.sort_values(["score", "id"], ascending=[False, True], kind="stable"), t.sort_values("id", kind="stable")
        key = (p if len(p) else t)[frame].iloc[0]
        iou = iou_matrix(p[BOX].to_numpy(float), t[BOX].to_numpy(float))
        free, rows = np.ones(len(t), bool), []
        for i, own in enumerate(p["id"]):
            able = np.where(free & (iou[i] >= threshold), iou[i], -1.0)
            j = int(np.argmax(able)) if len(able) else -1
            if j >= 0 and able[j] >= 0:
                free[j] = False
                rows.append((key, "tp", own, t["id"].iloc[j], float(able[j])))
            else:
                rows.append((key, "fp", own, None, None))
        rows += [(key, "fn", None, t["id"].iloc[j], None) for j in np.flatnonzero(free)]
        return pd.DataFrame(rows, columns=[frame, "outcome", "prediction_id", "truth_id", "iou"]).astype({"prediction_id": "Int64", "truth_id": "Int64"})

    return _in_frames(predictions, truths, frame, match, f"{frame} {kind}, outcome string, prediction_id long, truth_id long, iou double")


def optimal_match(predictions: DataFrame, truths: DataFrame, frame: str, threshold: float) -> DataFrame:
    """Pairs at or over ``threshold`` with the most pairs and then the highest total IoU: ``frame``, ``prediction_id``, ``truth_id``, ``iou``."""
    kind = dict(predictions.dtypes)[frame]

    def match(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        p, t = p.sort_values("id", kind="stable"), t.sort_values("id", kind="stable")
        rows = []
        if len(p) and len(t):
            iou = iou_matrix(p[BOX].to_numpy(float), t[BOX].to_numpy(float))
            able = iou >= threshold
            gain = able * (1 + iou / (min(iou.shape) + 1))
            rows = [(p[frame].iloc[0], p["id"].iloc[i], t["id"].iloc[j], float(iou[i, j])) for i, j in assignment(-gain) if able[i, j]]
        return pd.DataFrame(rows, columns=[frame, "prediction_id", "truth_id", "iou"])

    return _in_frames(predictions, truths, frame, match, f"{frame} {kind}, prediction_id long, truth_id long, iou double")
