"""Streaming forms: sessions by gap, late rows told apart, and distance increments that equal the batch result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(stream: DataFrame, key: str, time: str, gap: str, watermark: str) -> DataFrame:
    """Islands of events per key: a session ends after ``gap`` without one.

    Rows later than ``watermark`` are not counted here; put ``split_late`` before it to
    keep them, or read ``late_rows`` for their number.
    """
    window = F.session_window(time, gap)
    found = stream.withWatermark(time, watermark).groupBy(key, window.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("closes"), "n")


def late_rows(query: StreamingQuery) -> int:
    """How many rows a query's state operators have dropped as late in the batches it still reports."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def split_late(time: str, delay_s: float, marks: str, accept: Callable[[DataFrame, int], None], reject: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gives rows more than ``delay_s`` behind the largest time of earlier batches to ``reject``, the rest to ``accept``.

    The largest time of each batch is kept in the folder ``marks``, one small file a
    batch, so a batch that runs again after a failure is split in the same way. Rows
    without a time are rejected.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            top = batch.agg(F.max(time).cast("timestamp").alias("top"))
            top.withColumn("batch", F.lit(number)).coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch={number}")
            known = spark.read.schema("top timestamp, batch long").parquet(marks).where(F.col("batch") < number).agg(F.max("top")).first()[0]
            late = F.col(time).isNull() if known is None else F.coalesce(F.col(time) < F.lit(known) - F.make_interval(secs=F.lit(delay_s)), F.lit(True))
            accept(batch.where(~late), number)
            reject(batch.where(late), number)
        finally:
            batch.unpersist()

    return each


def distance_increments(stream: DataFrame, key: str, seconds: str, x: str, y: str, max_gap: float, max_speed: float, forget_ms: int = 3_600_000) -> DataFrame:
    """Per row its distance from the key's row before and the reason for none; rows that come late are told so, not dropped silently.

    State per key is its last row only, and goes ``forget_ms`` after the key's last batch:
    a key that comes back later begins a new interval. Within a micro-batch rows are put
    in order of time; a row older than the state has reason ``late``.
    """
    kind = dict(stream.dtypes)[key]

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(seconds, kind="stable")
        out = []
        for t, px, py in zip(rows[seconds], rows[x], rows[y], strict=True):
            distance = None
            if last is None:
                reason = "interval_start"
            elif t <= last[0]:
                out.append((own[0], t, None, "late"))
                continue
            else:
                dt, moved = t - last[0], ((px - last[1]) ** 2 + (py - last[2]) ** 2) ** 0.5
                reason = "timestamp_gap" if dt > max_gap else "missing_point" if moved != moved else "implausible_speed" if moved > max_speed * dt else None
                distance = moved if reason is None else None
            last = (float(t), float(px), float(py))
            out.append((own[0], t, distance, reason))
        state.update(last)
        state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=[key, seconds, "distance", "reason"])

    rows = stream.select(key, F.col(seconds).cast("double"), F.col(x).cast("double"), F.col(y).cast("double"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {seconds} double, distance double, reason string", "t double, x double, y double", "append", GroupStateTimeout.ProcessingTimeTimeout)
