"""Votes, durations, grids, fits and quality measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = list[str]


def majority(df: DataFrame, keys: Keys, value: str, order: str, min_votes: int = 1, min_share: float = 0.5, strict: bool = True) -> DataFrame:
    """Per key: ``winner`` (null if too few votes or too small a share), ``share`` and ``votes``. Ties go to the value seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    best = counts.groupBy(*keys).agg(F.sum("_n").alias("votes"), F.min(F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("f"), F.col(value).alias("v"))).alias("_b"))
    share = -F.col("_b.n") / F.col("votes")
    wins = (F.col("votes") >= min_votes) & (share >= min_share)
    if strict:
        wins = wins & (share > 0.5)
    return best.select(*keys, F.when(wins, F.col("_b.v")).alias("winner"), F.when(F.col("votes") >= min_votes, share).otherwise(F.lit(0.0)).alias("share"), "votes")


def union_duration(df: DataFrame, keys: Keys, start: str, end: str) -> DataFrame:
    """Per key the length of the union of its spans: each span adds what lies beyond the largest end so far."""
    w = W.partitionBy(*keys).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumn("_to", F.max(end).over(w))
    added = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce("_to", F.col(start))), F.lit(0))
    return rows.groupBy(*keys).agg(F.sum(added).alias("duration"))


def clipped_durations(df: DataFrame, keys: Keys, start: str, end: str, lo: float, hi: float) -> DataFrame:
    """Per key the summed time of its spans within [lo, hi)."""
    return df.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.least(F.col(end), F.lit(hi)) - F.greatest(F.col(start), F.lit(lo)))).alias("duration"))


def window_votes(df: DataFrame, keys: Keys, time: str, is_vote: Column, half_width: int) -> DataFrame:
    """Adds ``votes`` and ``share``: rows that vote within ``half_width`` of the row's time, and their share of the rows there."""
    w = W.partitionBy(*keys).orderBy(time).rangeBetween(-half_width, half_width)
    return df.withColumn("votes", F.sum(is_vote.cast("long")).over(w)).withColumn("share", F.col("votes") / F.count(F.lit(1)).over(w))


def cell(value: Column, extent: float, n: int) -> Column:
    """The cell of a coordinate: floor(value / extent * n), the upper edge in the last cell."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(value / extent * n))).cast("int")


def segment_samples(df: DataFrame, start: tuple[str, str], end: tuple[str, str], weight: str, spacing: float) -> DataFrame:
    """Each segment as ceil(length / spacing) midpoints (one at least) that share its weight: ``x``, ``y``, ``w``."""
    (ax, ay), (bx, by) = start, end
    length = F.sqrt((F.col(bx) - F.col(ax)) * (F.col(bx) - F.col(ax)) + (F.col(by) - F.col(ay)) * (F.col(by) - F.col(ay)))
    rows = df.withColumn("_n", F.greatest(F.lit(1), F.ceil(length / spacing)).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = (F.col("_i") + 0.5) / F.col("_n")
    return rows.select(*[c for c in df.columns if c not in ("x", "y", "w")], (F.col(ax) + (F.col(bx) - F.col(ax)) * at).alias("x"), (F.col(ay) + (F.col(by) - F.col(ay)) * at).alias("y"), (F.col(weight) / F.col("_n")).alias("w"))


def grid_mass(df: DataFrame, keys: Keys, x: str, y: str, weight: str, extent: tuple[float, float], cells: tuple[int, int]) -> DataFrame:
    """Summed weight per grid cell with any; the mass of all cells is that of all rows with a point."""
    placed = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    placed = placed.select(*keys, cell(F.col(x), extent[0], cells[0]).alias("cell_x"), cell(F.col(y), extent[1], cells[1]).alias("cell_y"), weight)
    return placed.groupBy(*keys, "cell_x", "cell_y").agg(F.sum(weight).alias("mass"))


def density(grid: DataFrame, keys: Keys, cells: tuple[int, int], sigma: float) -> DataFrame:
    """The grid under a Gaussian kernel, with each source cell's kernel normalised over the grid so that mass is kept."""
    spark = grid.sparkSession
    axis = lambda n, a, b: spark.range(n).select(F.col("id").cast("int").alias(a)).crossJoin(spark.range(n).select(F.col("id").cast("int").alias(b)))

    def kernel(n: int, a: str, b: str, k: str) -> DataFrame:
        raw = axis(n, a, b).withColumn("_k", F.exp(-(F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) / (2 * sigma * sigma)))
        return raw.withColumn(k, F.col("_k") / F.sum("_k").over(W.partitionBy(a))).drop("_k")

    spread = grid.join(F.broadcast(kernel(cells[0], "cell_x", "to_x", "kx")), "cell_x").groupBy(*keys, "to_x", "cell_y").agg(F.sum(F.col("mass") * F.col("kx")).alias("mass"))
    spread = spread.join(F.broadcast(kernel(cells[1], "cell_y", "to_y", "ky")), "cell_y").groupBy(*keys, "to_x", "to_y").agg(F.sum(F.col("mass") * F.col("ky")).alias("density"))
    return spread.withColumnsRenamed({"to_x": "cell_x", "to_y": "cell_y"})


def share_difference(grid: DataFrame, side: str, first: str, second: str) -> DataFrame:
    """Per cell the share of the first side's mass less that of the second's."""
    total = grid.groupBy(side).agg(F.sum("mass").alias("_total"))
    shares = grid.join(total, side).withColumn("_share", F.try_divide("mass", F.when(F.col("_total") != 0, F.col("_total"))))
    of = lambda s: F.coalesce(F.sum(F.when(F.col(side) == s, F.col("_share"))), F.lit(0.0))
    return shares.groupBy("cell_x", "cell_y").agg((of(first) - of(second)).alias("difference"))


def quadratic_fit(df: DataFrame, keys: Keys, t: str, y: str, min_points: int = 4) -> DataFrame:
    """Per key the least-squares a t^2 + b t + c from power sums, null where singular or short, and the number of points."""
    p = {f"s{k}": F.sum(F.pow(F.col(t), k)) for k in range(1, 5)}
    q = {f"y{k}": F.sum(F.pow(F.col(t), k) * F.col(y)) for k in range(3)}
    s = df.where(F.col(t).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[e.alias(k) for k, e in (p | q).items()])
    det = F.expr("s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2)")
    top = {
        "a": "y2 * (s2 * n - s1 * s1) - s3 * (y1 * n - s1 * y0) + s2 * (y1 * s1 - s2 * y0)",
        "b": "s4 * (y1 * n - s1 * y0) - y2 * (s3 * n - s1 * s2) + s2 * (s3 * y0 - y1 * s2)",
        "c": "s4 * (s2 * y0 - s1 * y1) - s3 * (s3 * y0 - y1 * s2) + y2 * (s3 * s1 - s2 * s2)",
    }
    solvable = (F.col("n") >= min_points) & (F.abs("_det") > 1e-9)
    s = s.withColumn("_det", det)
    return s.select(*keys, "n", *[F.when(solvable, F.expr(e) / F.when(F.col("_det") != 0, F.col("_det"))).alias(k) for k, e in top.items()])


def precision_recall(df: DataFrame, keys: Keys, truth: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 per key; an empty denominator gives null, not zero."""
    n = lambda c: F.count(F.when(c, 1))
    counts = df.groupBy(*keys).agg(n(truth & predicted).alias("tp"), n(~truth & predicted).alias("fp"), n(truth & ~predicted).alias("fn"))
    ratio = lambda a, b: F.when(b != 0, a / b)
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return counts.select(*keys, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def threshold_sweep(df: DataFrame, truth: Column, score: Column, thresholds: list[float]) -> DataFrame:
    """precision_recall at every threshold. Rows are counted once per score band, then summed over the bands above each threshold."""
    steps = sorted(thresholds)
    band = sum((F.when(score >= t, 1).otherwise(0) for t in steps), F.lit(0))
    n = lambda c: F.count(F.when(c, 1))
    bands = df.groupBy(band.alias("_band")).agg(n(truth).alias("_p"), n(~truth).alias("_n"))
    table = df.sparkSession.createDataFrame([(float(t), i + 1) for i, t in enumerate(steps)], "threshold double, _least int")
    joined = bands.crossJoin(F.broadcast(table))
    above = F.col("_band") >= F.col("_least")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = joined.groupBy("threshold").agg(total(F.when(above, F.col("_p"))).alias("tp"), total(F.when(above, F.col("_n"))).alias("fp"), total(F.when(~above, F.col("_p"))).alias("fn"))
    ratio = lambda a, b: F.when(b != 0, a / b)
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return out.select("threshold", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))


def latency(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Median and 95th percentile (linear interpolation), mean and number per key."""
    return df.groupBy(*keys).agg(F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile({value}, 0.95)").alias("p95"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def prototypes(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    """Per label and value: the lower median and the lower median of absolute deviations."""
    long = df.select(label, F.expr(f"stack({len(values)}, " + ", ".join(f"'{v}', cast({v} as double)" for v in values) + ") as (name, x)")).where("x is not null")
    centre = long.groupBy(label, "name").agg(F.expr("percentile_disc(0.5) within group (order by x)").alias("centre"))
    away = long.join(centre, [label, "name"]).withColumn("_d", F.abs(F.col("x") - F.col("centre")))
    return away.groupBy(label, "name", "centre").agg(F.expr("percentile_disc(0.5) within group (order by _d)").alias("spread"), F.count(F.lit(1)).alias("n"))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes x1, y1, x2, y2; 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def homography(x: Column, y: Column, m: list[float | Column]) -> tuple[Column, Column]:
    """The point under a 3 x 3 matrix, row by row, of numbers or of columns; null where it goes to infinity."""
    w = m[6] * x + m[7] * y + m[8]
    safe = F.when(F.abs(w) > 1e-9, w)
    return (m[0] * x + m[1] * y + m[2]) / safe, (m[3] * x + m[4] * y + m[5]) / safe


def first_per_key(df: DataFrame, keys: Keys, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in an order, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def even_sample(df: DataFrame, keys: Keys, order: list[Column], k: int) -> DataFrame:
    """``k`` evenly spaced rows per key: positions round(i (n - 1) / (k - 1)), halves to even; all rows where there are no more than ``k``."""
    w = W.partitionBy(*keys)
    rows = df.withColumn("position", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    near = F.floor(F.col("position") * (k - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = [F.bround((near + d) * (F.col("_n") - 1) / F.lit(float(k - 1))) == F.col("position") for d in (0, 1)]
    inside = [near + d <= k - 1 for d in (0, 1)]
    return rows.where((F.col("_n") <= k) | (hit[0] & inside[0]) | (hit[1] & inside[1])).drop("_n")


def gate(metrics: DataFrame, policy: DataFrame, name: str = "metric", value: str = "value", baseline: str = "baseline") -> DataFrame:
    """Per policy rule whether the metric passes; a missing or NaN metric fails, and so does a ratio to a baseline that isn't positive.

    Rules: min, max, max_drop (baseline less value, with 1e-12 to spare) and max_ratio.
    """
    rows = policy.join(metrics, name, "left")
    v, b, limit = F.col(value), F.col(baseline), F.col("limit")
    passed = (
        F.when(F.col("rule") == "min", v >= limit)
        .when(F.col("rule") == "max", v <= limit)
        .when(F.col("rule") == "max_drop", b - v <= limit + 1e-12)
        .when(F.col("rule") == "max_ratio", (b > 0) & (v <= limit * b))
    )
    return rows.withColumn("passed", F.coalesce(passed & ~F.isnan(v), F.lit(False)))
