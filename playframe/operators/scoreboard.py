"""Scoreboard readings: validity, confirmation by neighbours, lookup with a hold, changes and periods."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOLD = 1.51


def valid_reading(period: Column, clock: Column, scores: Column, teams: Column) -> Column:
    """Period 1 to 20; a clock, if any, within 720 s (overtime 300); scores, if any, of exactly the two teams, 0 to 250."""
    clock_ok = clock.isNull() | ((clock >= 0) & (clock <= F.when(period <= 4, 720).otherwise(300)))
    same = F.array_sort(F.map_keys(scores)) == F.array_sort(teams)
    scores_ok = scores.isNull() | (same & F.forall(F.map_values(scores), lambda v: v.between(0, 250)))
    return F.coalesce(period.between(1, 20) & clock_ok & scores_ok, F.lit(False))


def confirmed(raw: DataFrame, keys: list[str], teams: Column, sample: float = 0.5) -> DataFrame:
    """Readings (``time_s, period, clock_s, scores``) that a neighbour confirms, one row per input row; what isn't confirmed is null.

    A neighbour is the row before or after within 1.51 samples. It confirms the period
    if its own is equal, the clock if it differs by at most a sample and 1.1 s, the
    scores if they are equal. A period below an accepted one and a score below an
    accepted one are not taken. These two rules need the order of acceptance: rows of
    one key, a game, are folded in one task.
    """
    w = W.partitionBy(*keys).orderBy("time_s")
    row = F.struct("time_s", "period", "clock_s", "scores")
    rows = raw.withColumn("_ok", valid_reading(F.col("period"), F.col("clock_s"), F.col("scores"), teams))
    for name, beside in (("_b", F.lag), ("_a", F.lead)):
        other = beside(F.when(F.col("_ok"), row)).over(w)
        near = F.abs(beside("time_s").over(w) - F.col("time_s")) <= sample * HOLD
        rows = rows.withColumn(name, F.when(near, other))
    agrees = lambda n: F.coalesce(F.col(f"{n}.period") == F.col("period"), F.lit(False))
    flat = lambda m: F.array_sort(F.map_entries(m))
    clock = lambda n: agrees(n) & F.coalesce(F.abs(F.col(f"{n}.clock_s") - F.col("clock_s")) <= sample + 1.1, F.lit(False))
    score = lambda n: agrees(n) & F.coalesce(flat(F.col(f"{n}.scores")) == flat(F.col("scores")), F.lit(False))
    rows = rows.withColumns({"_period": F.col("_ok") & (agrees("_b") | agrees("_a")), "_clock": clock("_b") | clock("_a"), "_score": score("_b") | score("_a")})
    rows = rows.select(*keys, "time_s", "period", "clock_s", "scores", "_period", "_clock", "_score")
    out_schema = rows.drop("_period", "_clock", "_score").schema

    def accept(game: pd.DataFrame) -> pd.DataFrame:
        game = game.sort_values("time_s", kind="stable")
        period, scores, kept = None, None, []
        for own_period, clock, own, by_period, by_clock, by_score in zip(*(game[c] for c in ("period", "clock_s", "scores", "_period", "_clock", "_score")), strict=True):
            if not by_period or period is not None and own_period < period:
                kept.append((None, None, None))
                continue
            period = int(own_period)
            own = dict(own) if own is not None and by_score else None
            rising = own is not None and (scores is None or all(own[t] >= scores[t] for t in own))
            scores = own if rising else scores
            kept.append((period, clock if by_clock else None, own if rising else None))
        out = game[[*keys, "time_s"]].copy()
        for name, values in zip(("period", "clock_s", "scores"), zip(*kept, strict=True), strict=True):
            out[name] = pd.Series(values, index=out.index, dtype={"period": "Int32", "clock_s": "Float64"}.get(name, "object"))
        return out

    return rows.groupBy(*keys).applyInPandas(accept, out_schema)


def hold(sample: float) -> float:
    """How long a reading stands."""
    return min(2.5, HOLD * sample)


def changes(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Readings with scores that differ in score or period from the last ones with scores; the first counts."""
    w = W.partitionBy(*keys).orderBy("time_s")
    rows = readings.where("scores is not null").withColumn("_k", F.to_json(F.struct("period", F.array_sort(F.map_entries("scores")))))
    return rows.withColumn("_new", F.coalesce(F.col("_k") != F.lag("_k").over(w), F.lit(True))).where("_new").drop("_k", "_new")


def period_spans(readings: DataFrame, keys: list[str], sample: float) -> DataFrame:
    """``period, start_s, end_s``: each reading stands until the next one or for the hold, and spans of one period that meet are one."""
    from playframe.operators.sequence import merge_spans

    w = W.partitionBy(*keys).orderBy("time_s")
    until = F.least(F.col("time_s") + hold(sample), F.coalesce(F.lead("time_s").over(w), F.lit(float("inf"))))
    spans = readings.withColumn("end_s", until).where("period is not null").select(*keys, "period", F.col("time_s").alias("start_s"), "end_s")
    return merge_spans(spans, keys, "start_s", "end_s", ["period"]).drop("n_spans")


def document_faults(samples: DataFrame, teams: list[str], labels: list[str], run_teams: list[str], sample: float, source_matches: bool) -> DataFrame:
    """The reasons for which a whole document is refused: one row a rule broken, none for a sound one."""
    spark = samples.sparkSession
    whole = {
        "source_mismatch": not source_matches, "team_mismatch": len(set(teams)) != 2 or set(teams) != set(run_teams),
        "invalid_teams": any(not 1 <= len(x or "") <= 12 for x in labels), "invalid_sampling": not 0.1 <= sample <= 2,
    }
    w = W.orderBy("time_s") if "_pos" not in samples.columns else W.orderBy("_pos")
    time = F.col("time_s").isNull() | (F.col("time_s") < 0) | F.coalesce(F.col("time_s") <= F.lag("time_s").over(w), F.lit(False))
    empty = F.col("period").isNull() & (F.col("scores").isNotNull() | F.col("clock_s").isNotNull())
    bad = F.col("period").isNotNull() & ~valid_reading(F.col("period"), F.col("clock_s"), F.col("scores"), F.array(*map(F.lit, teams)))
    rows = samples.select(F.array_compact(F.array(F.when(time, F.lit("invalid_times")), F.when(empty | bad, F.lit("invalid_reading")))).alias("_r")).select(F.explode("_r").alias("reason"))
    return spark.createDataFrame([(k,) for k, v in whole.items() if v], "reason string").union(rows).distinct()


def audit(expected: DataFrame, readings: DataFrame, key: str, field: str) -> DataFrame:
    """How reviewed values compare with readings: agree, wrong, unavailable (no reading) and expected_missing (nothing to read)."""
    own = readings.select(key, F.col(field).alias("_read"))
    rows = expected.select(key, F.col(field).alias("_want")).join(own, key, "left")
    n = lambda c: F.count(F.when(c, 1))
    want, read = F.col("_want"), F.col("_read")
    return rows.agg(n(want == read).alias("agree"), n(read.isNotNull() & ~want.eqNullSafe(read)).alias("wrong"), n(want.isNotNull() & read.isNull()).alias("unavailable"), n(want.isNull() & read.isNull()).alias("expected_missing"))
