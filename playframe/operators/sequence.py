"""Operators over ordered rows: islands, spans, windows, fills and folds.

All take key columns and an order column and partition by the keys only, so each
key is sorted once. Order columns are numbers (time in microseconds or frame
index); rows with a null order sort first and never continue an island.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = list[str]

#: Order values of one block where a key may hold a whole table.
BLOCK = 1 << 16


def islands(df: DataFrame, keys: Keys, order: str, gap: float, breaks: Column | None = None) -> DataFrame:
    """Adds ``island``, from 0: a new one starts where the step from the row before exceeds ``gap`` or ``breaks`` holds."""
    w = W.partitionBy(*keys).orderBy(order)
    new = F.coalesce(F.col(order) - F.lag(order).over(w) > gap, F.lit(True))
    if breaks is not None:
        new = new | F.coalesce(breaks, F.lit(False))
    marked = df.withColumn("_new", new.cast("int"))
    return marked.withColumn("island", F.sum("_new").over(w) - 1).drop("_new")


def long_islands(df: DataFrame, keys: Keys, order: str, gap: float) -> DataFrame:
    """``islands`` of keys too long for one window, with ``first``, the order value their island begins at.

    Each block of ``BLOCK`` order values is a window of its own; one row a block says
    where its first island begins and how many there are before it. Rows without an
    order are left out.
    """
    rows = df.where(F.col(order).isNotNull()).withColumn("_block", F.floor(F.col(order) / BLOCK))
    w = W.partitionBy(*keys, "_block").orderBy(order)
    rows = rows.withColumn("_new", (F.col(order) - F.lag(order).over(w) > gap).cast("long"))
    began = F.when(F.col("_new") == 1, F.col(order))
    blocks = rows.groupBy(*keys, "_block").agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.coalesce(F.sum("_new"), F.lit(0)).alias("_n"), F.max(began).alias("_last"))
    over = W.partitionBy(*keys).orderBy("_block")
    blocks = blocks.withColumn("_head", F.coalesce(F.col("_lo") - F.lag("_hi").over(over) > gap, F.lit(True)))
    blocks = blocks.withColumn("_open", F.max(F.when(F.col("_head"), F.col("_lo"))).over(over)).withColumn("_open", F.greatest("_open", F.max("_last").over(over.rowsBetween(W.unboundedPreceding, -1))))
    blocks = blocks.withColumn("_at", F.sum(F.col("_n") + F.col("_head").cast("long")).over(over) - F.col("_n") - 1)
    rows = beside(rows, blocks.select(*keys, "_block", "_open", "_at"), [*keys, "_block"])
    so_far = lambda c, f: f(c).over(w)
    rows = rows.withColumn("island", F.col("_at") + F.coalesce(so_far("_new", F.sum), F.lit(0))).withColumn("first", F.coalesce(so_far(began, F.max), F.col("_open")))
    return rows.drop("_block", "_new", "_open", "_at")


def beside(rows: DataFrame, facts: DataFrame, keys: Keys) -> DataFrame:
    """``facts``, one row a key, beside every row of the key, null keys too."""
    same = facts.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(same, on).drop(*[f"_of_{k}" for k in keys])


def order_blocks(rows: DataFrame, by: list[Column], blocks: int = 256) -> Column:
    """The block of a row: rows are cut, in the order of ``by``, at up to ``blocks`` bounds drawn evenly from them.

    The bounds are values of rows with the smallest hashes, literals from here on, so a
    row has the same block wherever it is computed. They decide about sizes only. ``by``
    should tell rows apart: what is equal lies in one block.
    """
    at = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(by)])
    drawn = rows.select(at.alias("at")).orderBy(F.xxhash64("at")).limit(8 * blocks)
    bounds = [r.at for r in drawn.orderBy("at").collect()][4::8]
    if not bounds:
        return F.lit(0)
    kind = rows.select(at.alias("at")).schema["at"].dataType
    known = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kind, strict=True)]) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)])
    find = lambda own: F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(known, n + step - 1) <= own, n + step).otherwise(n))
    return F.transform(F.array(at), find)[0]  # so a row's struct is made once


def island_ranges(df: DataFrame, keys: Keys, order: str, gap: float, breaks: Column | None = None) -> DataFrame:
    """One row per island: its first and last order value and its number of rows."""
    found = islands(df, keys, order, gap, breaks).groupBy(*keys, "island")
    return found.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def merge_spans(df: DataFrame, keys: Keys, start: str, end: str, attributes: Keys, tolerance: float = 1e-6) -> DataFrame:
    """Spans that touch (within ``tolerance``) and agree in their attributes become one."""
    w = W.partitionBy(*keys).orderBy(start, end)
    same = F.abs(F.col(start) - F.lag(end).over(w)) <= tolerance
    for a in attributes:
        same = same & F.col(a).eqNullSafe(F.lag(a).over(w))
    marked = df.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int"))
    marked = marked.withColumn("_span", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_span", *attributes).agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_spans")).drop("_span")


def contiguous_windows(df: DataFrame, keys: Keys, order: str, value: str, n: int) -> DataFrame:
    """Per row that ends ``n`` consecutive order values: the values of these rows, oldest first, as ``window``.

    A key is cut into blocks of ``BLOCK`` order values; the last ``n - 1`` of a block are
    in the next one too, so every window lies in the block of its last row.
    """
    block = lambda back: F.floor((F.col(order) + back) / max(BLOCK, n)).alias("_block")
    rows = df.withColumn("_block", F.explode(F.array_distinct(F.array(block(0), block(n - 1)))))
    w = W.partitionBy(*keys, "_block").orderBy(order)
    back = rows.withColumn("_from", F.lag(order, n - 1).over(w)).withColumn("window", F.collect_list(value).over(w.rowsBetween(1 - n, 0)))
    return back.where((F.col("_from") == F.col(order) - (n - 1)) & (F.col("_block") == block(0))).drop("_from", "_block")


def smooth_fill(df: DataFrame, keys: Keys, order: str, value: str, both: float, one: float) -> DataFrame:
    """Adds ``filled``: a null takes the value before and after it if they agree within ``both``, or the only side's within ``one``."""
    w = W.partitionBy(*keys).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(order).alias("t")))
    sides = df.withColumn("_b", F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    sides = sides.withColumn("_a", F.first(known, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))
    before, after = F.col(order) - F.col("_b.t"), F.col("_a.t") - F.col(order)
    guess = (
        F.when((before <= both) & (after <= both), F.when(F.col("_b.v") == F.col("_a.v"), F.col("_b.v")))
        .when((before <= one) & F.coalesce(after > both, F.lit(True)), F.col("_b.v"))
        .when((after <= one) & F.coalesce(before > both, F.lit(True)), F.col("_a.v"))
    )
    return sides.withColumn("filled", F.coalesce(F.col(value), guess)).drop("_a", "_b")


def cumulative(df: DataFrame, keys: Keys, order: str, value: str) -> DataFrame:
    """Adds ``total`` so far and ``measured``, whether any value was there so far."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("total", F.sum(value).over(w)).withColumn("measured", F.max(F.col(value).isNotNull()).over(w))


def missing_ranges(df: DataFrame, value: str, bucket: int = 1 << 20) -> DataFrame:
    """Ranges of integers between the smallest and largest value that no row has.

    Values are dealt into buckets of ``bucket`` integers; gaps inside a bucket come
    from its own window, gaps across buckets from one row per bucket.
    """
    values = df.select(F.col(value).cast("long").alias("v")).where("v is not null").distinct().withColumn("b", F.expr(f"v div {bucket} - int(v < 0 and v % {bucket} <> 0)"))
    inside = values.withColumn("p", F.lag("v").over(W.partitionBy("b").orderBy("v"))).select("p", "v")
    ends = values.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    between = ends.select(F.lag("hi").over(W.orderBy("b")).alias("p"), F.col("lo").alias("v"))
    gaps = inside.unionByName(between).where("v - p > 1")
    return gaps.select((F.col("p") + 1).alias("first"), (F.col("v") - 1).alias("last"), (F.col("v") - F.col("p") - 1).alias("n"))


def until_confirmed(df: DataFrame, keys: Keys, order: str, value: str, votes: int, share: float, tie: str | None = None) -> DataFrame:
    """Rows up to the first at which one value has ``votes`` votes and ``share`` of all so far; adds ``attempt`` and ``confirmed``.

    Rows of one ``order`` go by ``tie``; without it their order is not determined.
    """
    by = [order, tie] if tie else [order]
    w = W.partitionBy(*keys).orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    own = W.partitionBy(*keys, value).orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    counted = df.withColumn("attempt", F.count(value).over(w)).withColumn("_own", F.count(value).over(own))
    counted = counted.withColumn("confirmed", F.coalesce((F.col("_own") >= votes) & (F.col("_own") >= share * F.col("attempt")), F.lit(False)))
    done = F.coalesce(F.max("confirmed").over(W.partitionBy(*keys).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    return counted.withColumn("_done", done).where("not _done").drop("_done", "_own")


def smoothed(df: DataFrame, keys: Keys, order: str, value: str, tau: float) -> DataFrame:
    """Per key the time-aware exponential average of its values in order: ``smoothed`` (last) and ``n``.

    The average is a weighted sum: what a step adds, 1 - exp(-dt / tau) of its value,
    decays by exp(-age / tau) until the last row. So rows are summed in parts before
    they move, and no key's history is held. Null values are skipped; of rows at one
    time the later ones add nothing.
    """
    w = W.partitionBy(*keys).orderBy("_t", "_v")
    rows = df.where(F.col(value).isNotNull() & F.col(order).isNotNull()).select(*keys, F.col(order).cast("double").alias("_t"), F.col(value).cast("double").alias("_v"))
    step = F.col("_t") - F.lag("_t").over(w)
    rows = rows.withColumn("_add", F.coalesce(1 - F.exp(-step / tau), F.lit(1.0)) * F.col("_v"))
    rows = rows.withColumn("_age", F.max("_t").over(W.partitionBy(*keys)) - F.col("_t"))
    return rows.groupBy(*keys).agg(F.sum(F.col("_add") * F.exp(-F.col("_age") / tau)).alias("smoothed"), F.count(F.lit(1)).alias("n"))


def smoothed_rows(df: DataFrame, keys: Keys, order: str, values: list[str], tau: float) -> DataFrame:
    """Adds ``smooth_<value>`` to every row: the time-aware exponential average of its key's values up to it.

    What a row adds, 1 - exp(-dt / tau) of its value (the first all of it), decays by
    exp(-age / tau). A key is cut into blocks of twenty tau; within a block this is a
    running sum in units of the block's start, and from earlier blocks the totals of the
    last three that have rows are carried on, as what lies before has decayed below the
    precision of a double. So no history is held and a long key is many small windows.
    Rows without a time or without one of the values are left out; of rows at one time
    the later ones add nothing.
    """
    span = 20.0 * tau
    rows = df.where(F.col(order).isNotNull())
    for v in values:
        rows = rows.where(F.col(v).isNotNull())
    rows = rows.withColumn("_t", F.col(order).cast("double")).withColumn("_block", F.floor(F.col("_t") / span))
    start = F.col("_block") * span
    step = F.col("_t") - F.lag("_t").over(W.partitionBy(*keys).orderBy("_t", *values))
    rows = rows.withColumn("_share", F.coalesce(1 - F.exp(-step / tau), F.lit(1.0)) * F.exp((F.col("_t") - start) / tau))
    own = W.partitionBy(*keys, "_block").orderBy("_t", *values).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"_own_{v}": F.sum(F.col(v) * F.col("_share")).over(own) for v in values})
    blocks = rows.groupBy(*keys, "_block").agg(*[F.sum(F.col(v) * F.col("_share")).alias(f"_all_{v}") for v in values])
    w = W.partitionBy(*keys).orderBy("_block")
    age = lambda k: (F.col("_block") - F.lag("_block", k).over(w)) * span / tau
    carried = lambda v: sum((F.coalesce(F.lag(f"_all_{v}", k).over(w) * F.exp(-age(k)), F.lit(0.0)) for k in (1, 2, 3)), F.lit(0.0))
    blocks = blocks.select(*keys, "_block", *[carried(v).alias(f"_before_{v}") for v in values])
    rows = rows.join(blocks, [*keys, "_block"])
    decay = F.exp(-(F.col("_t") - start) / tau)
    out = rows.withColumns({f"smooth_{v}": (F.col(f"_own_{v}") + F.col(f"_before_{v}")) * decay for v in values})
    return out.drop("_t", "_block", "_share", *[f"_{k}_{v}" for k in ("own", "before") for v in values])


def switches(df: DataFrame, keys: Keys, order: str, value: str, ahead: int = 5, support: int = 3, gap: float | None = None) -> DataFrame:
    """Sustained switches of a label: adds ``episode``, from 0.

    A known label that differs from the current one starts an episode if among this
    and the next ``ahead - 1`` rows, gaps or not, it has ``support`` votes and the
    current one has none. The first current label is the first known one ahead. A step
    of more than ``gap`` starts an episode too, and the current label anew. Whether a
    row switches depends on the labels accepted before it, so a key is one fold, linear
    in its rows.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], f"{order} {kinds[order]}", f"{value} {kinds[value]}", "episode int"])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([order, value], kind="stable", na_position="first")
        labels = [None if pd.isna(v) else v for v in rows[value]]
        times = rows[order].tolist()
        known_ahead, first = [None] * len(labels), None
        for i in range(len(labels) - 1, -1, -1):
            first = known_ahead[i] = labels[i] if labels[i] is not None else first
        now, episode, out = known_ahead[0] if labels else None, 0, []
        for i, label in enumerate(labels):
            if gap is not None and i and times[i] - times[i - 1] > gap:
                episode, now = episode + 1, known_ahead[i]
            elif label is not None and now is not None and label != now:
                near = labels[i : i + ahead]
                if near.count(label) >= support and now not in near:
                    episode, now = episode + 1, label
            elif now is None:
                now = label
            out.append(episode)
        return rows.assign(episode=pd.array(out, "Int32"))[[*keys, order, value, "episode"]]

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(fold, schema)


def dealt(df: DataFrame, keys: Keys, least: int = 128) -> DataFrame:
    """Rows by their keys in as many parts as ``spark.sql.shuffle.partitions`` says, ``least`` at least. Adaptive execution doesn't join these, so what a chain of windows sorts in a task stays small."""
    parts = max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def spaced(df: DataFrame, keys: list[str], time: str, least: float, order: str | None = None, always: Column | None = None) -> DataFrame:
    """The rows of a key that are at least ``least`` after the last one kept, the first on, and those that ``always`` names; in ``order``, by default ``time``.

    What is kept depends on what was kept before, but a row after a longer pause is kept
    whatever came before. So rows pass in order of keys, and only the time of the last
    one kept is held.
    """
    w = W.partitionBy(*keys).orderBy(order or time)
    free = F.coalesce(F.col(time) - F.lag(time).over(w) >= least, F.lit(True))
    rows = df.withColumn("_free", free if always is None else free | F.coalesce(always, F.lit(False)))

    def keep(batches):
        last = float("-inf")
        for batch in batches:
            stay = []
            for t, whatever in zip(batch.column(time).to_pylist(), batch.column("_free").to_pylist(), strict=True):
                stay.append(whatever or t - last >= least)
                last = t if stay[-1] else last
            yield batch.filter(pa.array(stay, pa.bool_()))

    return rows.sortWithinPartitions(*keys, order or time).mapInArrow(keep, rows.schema).drop("_free")
