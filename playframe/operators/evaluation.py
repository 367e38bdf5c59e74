"""Measures of detectors, ball localisers and trackers against reviewed truth.

Matching runs frame by frame in grouped tasks, because a match decides what the next
prediction may take; a frame holds at most some hundred boxes. Counting, ranking and
averaging are relational.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playframe.functions.tracking import run_keys
from playframe.operators.matching import BOX, _in_frames, iou_matrix
from playframe.operators.sequence import beside, order_blocks

#: Area ranges in source pixels, both ends inside.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
RECALLS = 101


def usable_predictions(predictions: DataFrame, frame: str, width: float, height: float, floor: float = 0.001, most: int = 100) -> DataFrame:
    """Predictions clipped to the image, at or over the score floor and not empty; the ``most`` best of a frame, ties by id."""
    clip = lambda c, top: F.greatest(F.lit(0.0), F.least(F.col(c), F.lit(float(top)))).alias(c)
    rows = predictions.select(*[c for c in predictions.columns if c not in BOX], clip("x1", width), clip("y1", height), clip("x2", width), clip("y2", height))
    rows = rows.where((F.col("score") >= floor) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(frame).orderBy(F.desc("score"), "id"))).where(F.col("_k") <= most).drop("_k")


def match_events(predictions: DataFrame, truths: DataFrame, frame: str, thresholds: list[float], area: tuple[float, float] = AREAS["all"]) -> DataFrame:
    """Outcomes at every IoU threshold: ``frame, iou_threshold, outcome, prediction_id, truth_id, iou, score``.

    Predictions by falling score (then id) take a free truth at or over the threshold,
    one inside the area range first, then the highest IoU, then the first. Truths
    outside the range are ignored: what takes them counts as nothing. An unmatched
    prediction is a false positive only if its own area is in the range.
    """
    kind = dict(predictions.dtypes)[frame]
    low, high = area
    columns = [frame, "iou_threshold", "outcome", "prediction_id", "truth_id", "iou", "score"]

    def sized(boxes: np.ndarray) -> np.ndarray:
        return (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])

    def match(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        p, t = p.sort_values(["score", "id"], ascending=[False, True], kind="stable"), t.sort_values("id", kind="stable")
        key = (p if len(p) else t)[frame].iloc[0]
        a, b = p[BOX].to_numpy(float), t[BOX].to_numpy(float)
        iou = iou_matrix(a, b)
        counts, wanted = (sized(x) for x in (a, b))
        counts, wanted = (counts >= low) & (counts <= high), (wanted >= low) & (wanted <= high)
        rows = []
        for limit in thresholds:
            free = np.ones(len(t), bool)
            for i, (own, score) in enumerate(zip(p["id"], p["score"], strict=True)):
                able = free & (iou[i] >= limit)
                if able.any():
                    preferred = able & wanted if (able & wanted).any() else able
                    j = int(np.argmax(np.where(preferred, iou[i], -1.0)))
                    free[j] = False
                    if wanted[j]:
                        rows.append((key, limit, "tp", own, t["id"].iloc[j], float(iou[i, j]), score))
                elif counts[i]:
                    rows.append((key, limit, "fp", own, None, None, score))
            rows += [(key, limit, "fn", None, t["id"].iloc[j], None, None) for j in np.flatnonzero(free & wanted)]
        return pd.DataFrame(rows, columns=columns).astype({"prediction_id": "Int64", "truth_id": "Int64", "iou": "Float64", "score": "Float64"})

    return _in_frames(predictions, truths, frame, match, f"{frame} {kind}, iou_threshold double, outcome string, prediction_id long, truth_id long, iou double, score double")


def ratios(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp and fn; null where nothing was predicted, or nothing was there."""
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    share = lambda a, b, there: F.when(there > 0, a / b)
    return counts.withColumns({"precision": share(tp, tp + fp, tp + fp), "recall": share(tp, tp + fn, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn, tp + fn)})


def outcome_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(o)
    return ratios(events.groupBy(*keys).agg(n("tp"), n("fp"), n("fn")))


def precision_curve(events: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """Per key, IoU threshold and prediction in the order of scores: ``tp_so_far``, ``seen``, ``recall`` and ``precision``.

    Equal scores go by frame and id. Predictions are cut into blocks in this order; each
    is a window of its own and goes on from the counts of the blocks before it.
    """
    support = events.where("outcome in ('tp', 'fn')").groupBy(*keys, "iou_threshold").agg(F.count(F.lit(1)).alias("support"))
    rows = events.where("outcome in ('tp', 'fp')")
    falling = F.when(F.isnan("score"), float("-inf")).otherwise(-F.col("score"))  # as a descending order has it: no number first, nulls last
    of, fall = [*keys, "iou_threshold"], [F.col("score").isNull(), falling, F.col(frame), F.col("prediction_id")]
    rows = rows.withColumn("_block", order_blocks(rows, [*map(F.col, of), *fall]))
    tp = F.sum((F.col("outcome") == "tp").cast("long"))
    counts = rows.groupBy(*of, "_block").agg(tp.alias("_tp"), F.count(F.lit(1)).alias("_n"))
    before = lambda c: F.coalesce(F.sum(c).over(W.partitionBy(*of).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*of, "_block", before("_tp").alias("_tp"), before("_n").alias("_n"))
    w = W.partitionBy(*of, "_block").orderBy(*fall)
    rows = beside(rows.withColumn("_own_tp", tp.over(w)).withColumn("_own_n", F.row_number().over(w)), counts, [*of, "_block"])
    rows = rows.withColumn("tp_so_far", F.col("_tp") + F.col("_own_tp")).withColumn("seen", F.col("_n") + F.col("_own_n")).drop("_block", "_tp", "_n", "_own_tp", "_own_n")
    rows = rows.join(support, of)
    return rows.withColumn("recall", F.col("tp_so_far") / F.col("support")).withColumn("precision", F.col("tp_so_far") / F.col("seen"))


def average_precision(events: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """Per key and IoU threshold ``ap`` over 101 recall points and ``support``; null without truths.

    A recall point has the best precision at that recall or beyond, and 0 where no
    prediction reaches it.
    """
    support = events.groupBy(*keys, "iou_threshold").agg(F.count(F.when(F.col("outcome").isin("tp", "fn"), 1)).alias("support"))
    # Predictions by the last recall point they reach: at most 101 rows a key, from which on the best precision is a running maximum.
    reached = F.floor(F.col("tp_so_far") * (RECALLS - 1) / F.col("support") + 1e-9).alias("_point")
    steps = precision_curve(events, keys, frame).where("tp_so_far > 0").groupBy(*keys, "iou_threshold", reached).agg(F.max("precision").alias("_p"))
    w = W.partitionBy(*keys, "iou_threshold")
    steps = steps.withColumn("_best", F.max("_p").over(w.orderBy(F.desc("_point")))).withColumn("_points", F.col("_point") - F.coalesce(F.lag("_point").over(w.orderBy("_point")), F.lit(-1)))
    sums = steps.groupBy(*keys, "iou_threshold").agg(F.sum(F.col("_points") * F.col("_best")).alias("_sum"))
    out = support.join(sums, [*keys, "iou_threshold"], "left")
    return out.select(*keys, "iou_threshold", "support", F.when(F.col("support") > 0, F.coalesce("_sum", F.lit(0.0)) / RECALLS).alias("ap"))


def ap_summary(by_threshold: DataFrame, keys: list[str]) -> DataFrame:
    """``ap50`` and ``ap50_95`` (mean over the thresholds .50 to .95) per key."""
    near = F.abs(F.col("iou_threshold") - 0.5) < 1e-9
    return by_threshold.groupBy(*keys).agg(F.max(F.when(near, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap50_95"), F.max("support").alias("support"))


def cohort_report(events: DataFrame, frames: DataFrame, frame: str, cohorts: list[str], overlapping: str | None = None) -> DataFrame:
    """Counts and ratios over all frames and per value of each cohort column: ``cohort, value, tp, fp, fn, precision, recall, f1``.

    Null values are the cohort ``unknown``. ``overlapping`` is an array column: a frame
    counts in every cohort that it lists.
    """
    rows = events.join(frames, frame)
    names = [F.struct(F.lit("all").alias("cohort"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("cohort"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in cohorts]]
    every = F.array(*names)
    if overlapping:
        every = F.concat(every, F.transform(overlapping, lambda v: F.struct(F.lit(overlapping).alias("cohort"), v.cast("string").alias("value"))))
    return outcome_counts(rows.withColumn("_c", F.explode(every)).select("_c.*", "outcome"), ["cohort", "value"])


def score_sweep(predicted: DataFrame, n_truths: int, thresholds: list[float]) -> DataFrame:
    """Counts at each score threshold from the outcomes (``outcome`` tp or fp, ``score``) matched without one.

    Greedy matching by falling score gives a prediction the same truth whatever comes
    after it, so one matching serves all thresholds. Scores are counted per band first.
    """
    steps = sorted(set(thresholds))
    bands = F.array(*map(F.lit, steps))
    band = F.size(F.filter(bands, lambda t: F.col("score") >= t))
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    counts = predicted.groupBy("score", "outcome").agg(F.count(F.lit(1)).alias("_n")).withColumn("_band", band)
    counts = counts.groupBy("_band").agg(F.sum(F.when(F.col("outcome") == "tp", F.col("_n"))).alias("_tp"), F.sum(F.when(F.col("outcome") == "fp", F.col("_n"))).alias("_fp"))
    table = predicted.sparkSession.createDataFrame([(float(t), i + 1) for i, t in enumerate(steps)], "threshold double, _least int")
    above = F.col("_band") >= F.col("_least")
    total = lambda c: F.coalesce(F.sum(F.when(above, F.col(c))), F.lit(0)).cast("long")
    out = table.join(counts, above, "left").groupBy("threshold").agg(total("_tp").alias("tp"), total("_fp").alias("fp"))
    return ratios(out.withColumn("fn", F.lit(n_truths) - F.col("tp")))


def rank_runs(runs: DataFrame, protocol: str, metrics: list[str]) -> DataFrame:
    """Dense rank of runs within their protocol, by falling metrics."""
    return runs.withColumn("rank", F.dense_rank().over(W.partitionBy(protocol).orderBy(*[F.col(m).desc_nulls_last() for m in metrics])))


def best_checkpoint(runs: DataFrame, run: str, metric: str, step: str) -> DataFrame:
    """Per run the row of the highest metric, the earliest of equals, and ``tied``: whether there are several."""
    w = W.partitionBy(run)
    rows = runs.where(F.col(metric).isNotNull()).withColumn("_k", F.row_number().over(w.orderBy(F.desc(metric), step))).withColumn("_top", F.max(metric).over(w))
    rows = rows.withColumn("tied", F.sum((F.col(metric) == F.col("_top")).cast("int")).over(w) > 1)
    return rows.where("_k = 1").drop("_k", "_top")


def paired(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Two reports side by side on their keys, their other columns marked by side."""
    mark = lambda df, side: df.withColumnsRenamed({c: f"{c}_{side}" for c in df.columns if c not in keys})
    return mark(first, "a").join(mark(second, "b"), keys)


def paired_policies(reads: DataFrame, key: str, policy: str, number: str, first: str, second: str) -> DataFrame:
    """Of samples read under two policies: how many each accepts, both accept, and both accept with different numbers."""
    side = lambda p: F.max(F.when(F.col(policy) == p, F.col(number)))
    has = lambda p: F.max((F.col(policy) == p).cast("int"))
    rows = reads.groupBy(key).agg(side(first).alias("_a"), side(second).alias("_b"), has(first).alias("_in_a"), has(second).alias("_in_b")).where("_in_a = 1 and _in_b = 1")
    n = lambda c: F.count(F.when(c, 1))
    a, b = F.col("_a"), F.col("_b")
    return rows.agg(F.count(F.lit(1)).alias("eligible"), F.count("_a").alias("accepted_a"), F.count("_b").alias("accepted_b"), n(a.isNotNull() & b.isNotNull()).alias("both"), n(a != b).alias("changed"))


def ball_outcomes(frames: DataFrame, tolerance: float | Column = 15.0, ignore_unknown: bool = True) -> DataFrame:
    """Adds ``error`` and ``outcome`` to frames (windows, status, excluded, tx, ty: truth, px, py: prediction).

    No window: uncovered. Excluded, or unknown position where these are ignored:
    ignored. Without a truth a point is fp, none tn. With one, no point is fn, a point
    within the tolerance tp, else displaced.
    """
    t, p = F.col("tx").isNotNull() & F.col("ty").isNotNull(), F.col("px").isNotNull() & F.col("py").isNotNull()
    error = F.when(t & p, F.sqrt((F.col("px") - F.col("tx")) * (F.col("px") - F.col("tx")) + (F.col("py") - F.col("ty")) * (F.col("py") - F.col("ty"))))
    skip = F.col("excluded") | (F.lit(ignore_unknown) & (F.col("status") == "unknown_position"))
    limit = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    outcome = F.when(F.coalesce("windows", F.lit(0)) == 0, "uncovered").when(skip, "ignored").when(~t, F.when(p, "fp").otherwise("tn"))
    outcome = outcome.when(~p, "fn").when(error <= limit, "tp").otherwise("displaced")
    return frames.withColumn("error", error).withColumn("outcome", outcome)


def ball_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, coverage, precision, recall, f1 and errors of ``ball_outcomes`` per key; a displaced point is a false positive and a miss."""
    n = lambda c: F.count(F.when(c, 1))
    is_ = lambda *o: F.col("outcome").isin(*o)
    known = F.col("tx").isNotNull() & F.col("ty").isNotNull()
    near = F.when(is_("tp", "displaced"), F.col("error"))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), n(is_("uncovered")).alias("uncovered"), n(is_("ignored")).alias("ignored"), n(known).alias("known"), n(known & ~is_("uncovered")).alias("known_covered"),
        n(is_("tp")).alias("tp"), n(is_("tn")).alias("tn"), n(is_("fp", "displaced")).alias("fp"), n(is_("fn", "displaced")).alias("fn"), n(is_("displaced")).alias("displaced"),
        F.avg(near).alias("error_mean"), F.percentile(near, 0.5).alias("error_median"), F.percentile(near, 0.95).alias("error_p95"),
    )
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    share = lambda a, b: F.when(b > 0, a / b)
    out = out.withColumn("coverage", (F.col("frames") - F.col("uncovered")) / F.col("frames")).withColumn("known_coverage", share(F.col("known_covered"), F.col("known")))
    return out.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)}).withColumn("coverage_adjusted_f1", F.col("f1") * F.coalesce("known_coverage", F.lit(0.0)))


def ball_report(rows: DataFrame, keys: list[str], statuses: list[str]) -> DataFrame:
    """The summary over all frames, per value of each key, and per status, those without frames included: ``cohort, value, ...``."""
    names = [F.struct(F.lit("all").alias("cohort"), F.lit("all").alias("value")), *[F.struct(F.lit(k).alias("cohort"), F.col(k).cast("string").alias("value")) for k in (*keys, "status")]]
    found = ball_summary(rows.withColumn("_c", F.explode(F.array(*names))).select("*", "_c.*"), ["cohort", "value"])
    every = rows.sparkSession.createDataFrame([("status", s) for s in statuses], "cohort string, value string")
    counts = [c for c in ("frames", "uncovered", "ignored", "known", "known_covered", "tp", "tn", "fp", "fn", "displaced")]
    return every.join(found, ["cohort", "value"], "full").fillna(0, counts)


def tolerance_sensitivity(frames: DataFrame, tolerances: list[float]) -> DataFrame:
    """The summary at each tolerance: every frame is judged once per tolerance of a fixed, short list."""
    rows = frames.withColumn("tolerance", F.explode(F.array(*[F.lit(float(t)) for t in tolerances])))
    return ball_summary(ball_outcomes(rows, F.col("tolerance")), ["tolerance"])


def averaged_maps(windows: DataFrame, keys: list[str], cells: str = "cells") -> DataFrame:
    """Per frame the mean of its overlapping windows' maps, the place of the largest cell and its value; maps are arrays of one length.

    Means that agree to nine places are equal, as their last digits depend on the order of the sum; of equal cells the first counts.
    """
    rows = windows.select(*keys, F.posexplode(cells).alias("cell", "_v")).groupBy(*keys, "cell").agg(F.avg("_v").alias("value"), F.count(F.lit(1)).alias("windows"))
    return rows.groupBy(*keys).agg(F.max(F.struct(F.round("value", 9).alias("_v"), (-F.col("cell")).alias("_c"))).alias("_m"), F.max("value").alias("value"), F.max("windows").alias("windows")).select(*keys, (-F.col("_m._c")).alias("cell"), "value", "windows")


def mask_agreement(overlap: Column, a: Column, b: Column) -> dict[str, Column]:
    """IoU, Dice and the share of the first mask that is kept, from three pixel counts; null without pixels."""
    share = lambda x, y: F.when(y > 0, x / y)
    return {"iou": share(overlap, a + b - overlap), "dice": share(2 * overlap, a + b), "retention": share(overlap, a)}


def mask_overlaps(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Common pixels of two masks per key, each side (``key``, ``runs``) with runs from ``geometry.mask_runs``; runs meet on their row of the image."""
    of = lambda df, s: df.select(key, F.explode("runs").alias("_r")).select(key, F.col("_r.row").alias("row"), F.col("_r.first").alias(f"_f{s}"), F.col("_r.end").alias(f"_e{s}"))
    both = of(first, "a").join(of(second, "b"), [key, "row"])
    common = F.greatest(F.lit(0), F.least("_ea", "_eb") - F.greatest("_fa", "_fb"))
    return both.groupBy(key).agg(F.sum(common).alias("overlap"))


def track_states(truths: DataFrame, matches: DataFrame) -> DataFrame:
    """Truths with their match, and flags of identity switches and fragmentations.

    Truths are rows (segment_id, frame_index, person_id), matches (frame_index,
    person_id, track: the matched predicted track). Both flags need the person in the
    frame right before: a switch is another track than the last one matched, a
    fragmentation a match after a miss of one matched before.
    """
    runs = run_keys(truths)
    w = W.partitionBy(*runs, "segment_id", "person_id").orderBy("frame_index")
    rows = truths.join(matches, [*runs, "frame_index", "person_id"], "left")
    consecutive = F.coalesce(F.lag("frame_index").over(w) == F.col("frame_index") - 1, F.lit(False))
    last = F.last("track", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    matched = F.col("track").isNotNull()
    return rows.withColumns({
        "switched": F.coalesce(matched & consecutive & (last != F.col("track")), F.lit(False)),
        "fragmented": F.coalesce(matched & consecutive & last.isNotNull() & F.lag("track").over(w).isNull(), F.lit(False)),
    })


def identity_overlap(pairs: DataFrame) -> int:
    """IDTP: the most truth-prediction frames that a one-to-one assignment of persons to tracks explains; pairs are (person, track, frames).

    Persons and tracks of reviewed clips are some dozens; the matrix of their counts is
    aggregated in Spark and is all that the driver sees.
    """
    from playframe.operators.matching import assignment

    local = pairs.groupBy("person", "track").agg(F.sum("frames").alias("frames")).toPandas()
    if not len(local):
        return 0
    counts = local.pivot(index="person", columns="track", values="frames").fillna(0).to_numpy(float)
    return int(sum(counts[i, j] for i, j in assignment(-counts)))


def tracking_report(states: DataFrame, n_truths: int, n_predictions: int, idtp: int) -> DataFrame:
    """One row: idtp, idfn, idfp, idf1, switches and fragmentations."""
    sums = states.agg(F.sum(F.col("switched").cast("long")).alias("id_switches"), F.sum(F.col("fragmented").cast("long")).alias("fragmentations"))
    both = n_truths + n_predictions
    return sums.select(F.lit(idtp).alias("idtp"), F.lit(n_truths - idtp).alias("idfn"), F.lit(n_predictions - idtp).alias("idfp"), F.lit(2 * idtp / both if both else None).cast("double").alias("idf1"), "id_switches", "fragmentations")


def acceptance(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Of truths with their accepted identity (``known``, ``accepted``, ``correct``, ``matched``; unmatched predictions as rows without a truth): precision and coverages."""
    n = lambda c: F.count(F.when(c, 1))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    known, accepted, there = F.col("known"), F.col("accepted"), F.col("truth")
    out = rows.groupBy(*keys).agg(
        n(there & known).alias("known_truths"), n(there & known & F.col("matched")).alias("matched_known"), n(there & known & accepted).alias("accepted_known"),
        n(accepted & (~there | known)).alias("evaluable"), n(there & known & accepted & F.col("correct")).alias("correct_identities"),
    )
    return out.withColumns({"precision": share("correct_identities", "evaluable"), "correct_coverage": share("correct_identities", "known_truths"), "accepted_coverage": share("accepted_known", "known_truths")})
