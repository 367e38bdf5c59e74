"""Cameras from court homographies: focal length, the axes of the court in the image, and places above the floor.

A homography shows the images of two directions on the floor and of an origin. With
square pixels and the principal point in the middle of the image, that the directions
are at right angles and equally long gives the focal length; their cross product is the
third direction, so points above the floor have an image too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playframe.operators.sequence import smoothed_rows

#: Height of a rim and its distance from the baseline in metres; what a plausible camera may be.
RIM_HEIGHT, RIM_FROM_BASELINE = 3.048, 1.6002
FOCAL, STRETCH, SKEW, MARGIN = (0.4, 8.0), 1.3, 0.2, 0.1


def _dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]


def with_camera(rows: DataFrame, matrix: str, width: Column, height: Column) -> DataFrame:
    """Adds ``focal`` (null where the matrix shows no plausible camera) and ``up``, the image of a metre upwards in homogeneous coordinates of the matrix.

    ``matrix`` takes the court to the image, as nine numbers by rows. Its sign and scale don't matter.
    """
    m = lambda i, j: F.col(matrix)[3 * i + j]
    cx, cy = width / 2, height / 2
    # Directions seen from the principal point: columns of the matrix, centred.
    rows = rows.withColumns({f"_{name}": F.array(m(0, j) - cx * m(2, j), m(1, j) - cy * m(2, j), m(2, j)) for j, name in ((0, "a"), (1, "b"))})
    a, b = ([F.col(f"_{n}")[i] for i in range(3)] for n in "ab")
    # Both conditions are linear in 1 / focal^2: right angle and equal length.
    rows = rows.withColumns({"_p": F.array(_dot(a[:2], b[:2]), _dot(a[:2], a[:2]) - _dot(b[:2], b[:2])), "_q": F.array(a[2] * b[2], a[2] * a[2] - b[2] * b[2])})
    p, q = ([F.col(f"_{n}")[i] for i in range(2)] for n in "pq")
    inverse_square = -_dot(p, q) / F.nullif(_dot(p, p), F.lit(0.0))
    focal = F.when(inverse_square > 0, 1 / F.sqrt(inverse_square))
    rows = rows.withColumn("_f", F.when(focal.between(FOCAL[0] * width, FOCAL[1] * width), focal))
    axis = lambda v: F.array(v[0] / F.col("_f"), v[1] / F.col("_f"), v[2])
    rows = rows.withColumns({"_u": axis(a), "_v": axis(b)})
    u, v = ([F.col(f"_{n}")[i] for i in range(3)] for n in "uv")
    rows = rows.withColumns({"_nu": F.sqrt(_dot(u, u)), "_nv": F.sqrt(_dot(v, v))})
    sound = (F.least("_nu", "_nv") > 0) & (F.greatest("_nu", "_nv") <= STRETCH * F.least("_nu", "_nv")) & (F.abs(_dot(u, v)) <= SKEW * F.col("_nu") * F.col("_nv"))
    rows = rows.withColumn("focal", F.when(sound, F.col("_f"))).withColumn("_w", F.array(*[x * 2 / (F.col("_nu") + F.col("_nv")) for x in _cross(u, v)]))
    w = [F.col("_w")[i] for i in range(3)]
    up = F.array(F.col("_f") * w[0] + cx * w[2], F.col("_f") * w[1] + cy * w[2], w[2])
    return rows.withColumn("up", F.when(F.col("focal").isNotNull(), up)).drop("_a", "_b", "_p", "_q", "_f", "_u", "_v", "_nu", "_nv", "_w")


def rim_anchors(rows: DataFrame, matrix: str, width: Column, height: Column, court_length: float, court_width: float) -> DataFrame:
    """Adds ``rims``, the image points [x, y] of the rims that a plausible camera shows, left one first; empty where there are none.

    Of the two places at a rim's height over its spot, above and below in the matrix's
    own terms, the one higher in the image counts; a rim behind the camera or far
    outside the image is left out.
    """
    rows = with_camera(rows, matrix, width, height)
    m = lambda i, j: F.col(matrix)[3 * i + j]

    def spot(x: float) -> Column:
        base = [m(i, 0) * x + m(i, 1) * (court_width / 2) + m(i, 2) for i in range(3)]
        raised = [F.array(*[base[i] + sign * RIM_HEIGHT * F.col("up")[i] for i in range(3)]) for sign in (-1.0, 1.0)]
        seen = F.filter(F.array(*raised), lambda p: (p[2] * base[2] > 0) & (F.abs(p[2]) > 1e-9))
        return F.array_min(F.transform(seen, lambda p: F.struct((p[1] / p[2]).alias("y"), (p[0] / p[2]).alias("x"))))

    rows = rows.withColumns({"_left": spot(RIM_FROM_BASELINE), "_right": spot(court_length - RIM_FROM_BASELINE)})
    shown = lambda c: F.when(F.col(f"{c}.x").between(-MARGIN * width, (1 + MARGIN) * width) & F.col(f"{c}.y").between(0, height), F.array(f"{c}.x", f"{c}.y"))
    rims = F.when(F.col("focal").isNotNull(), F.array_compact(F.array(shown("_left"), shown("_right"))))
    return rows.withColumn("rims", F.coalesce(rims, F.array().cast("array<array<double>>"))).drop("up", "_left", "_right")


# --- fits over time

#: Seconds of smoothing, pixels of a jump that begins anew, and the longest pause between fits.
TAU, JUMP, PAUSE = 0.5, 40.0, 0.5


def corner_columns(rows: DataFrame, matrix: str, court_length: float, court_width: float) -> DataFrame:
    """Adds ``corner`` columns x0, y0 .. x3, y3: the court's corners in the image by ``matrix`` (nine numbers); null where one is at infinity."""
    m = lambda i, j: F.col(matrix)[3 * i + j]
    spots = ((0.0, 0.0), (court_length, 0.0), (court_length, court_width), (0.0, court_width))
    at = lambda i, p: m(i, 0) * p[0] + m(i, 1) * p[1] + m(i, 2)
    depth = lambda p: F.when(F.abs(at(2, p)) > 1e-9, at(2, p))
    return rows.withColumns({f"{axis}{k}": at(i, p) / depth(p) for k, p in enumerate(spots) for i, axis in enumerate("xy")})


def stabilised(fits: DataFrame, keys: list[str], matrix: str, court_length: float, court_width: float, tau: float = TAU) -> DataFrame:
    """Adds ``smooth_x0`` .. ``smooth_y3`` to fits (frame_index, timestamp_s, scene_cut, matrix): the corners smoothed over time, and ``stretch``, the unbroken series they belong to.

    A series ends at a cut, a pause of more than half a second, and where a corner jumps
    by more than 40 pixels from the fit before, as that is another view and no jitter.
    Smoothing is on image points, on which an average means something; on matrix
    entries it wouldn't.
    """
    corners = [f"{a}{k}" for k in range(4) for a in "xy"]
    rows = corner_columns(fits, matrix, court_length, court_width).where(" and ".join(f"{c} is not null" for c in corners))
    w = W.partitionBy(*keys).orderBy("frame_index")
    back = lambda c: F.lag(c).over(w)
    moved = F.greatest(*[F.sqrt((F.col(f"x{k}") - back(f"x{k}")) ** 2 + (F.col(f"y{k}") - back(f"y{k}")) ** 2) for k in range(4)])
    joined = ~F.coalesce("scene_cut", F.lit(False)) & (F.col("timestamp_s") - back("timestamp_s") <= PAUSE) & (moved <= JUMP)
    rows = rows.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("stretch", F.sum("_new").over(w) - 1).drop("_new")
    return smoothed_rows(rows, [*keys, "stretch"], "timestamp_s", corners, tau)


def jitter_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, of ``stabilised`` fits: how far corners move from fit to fit, raw and smoothed, in mean and 95th percentile, how far smoothing takes them from the raw ones, and the steps compared.

    Both sides are compared on the same steps, those within a series.
    """
    w = W.partitionBy(*keys, "stretch").orderBy("frame_index")

    def steps(prefix: str) -> Column:
        d = [F.sqrt((F.col(f"{prefix}x{k}") - F.lag(f"{prefix}x{k}").over(w)) ** 2 + (F.col(f"{prefix}y{k}") - F.lag(f"{prefix}y{k}").over(w)) ** 2) for k in range(4)]
        return sum(d[1:], d[0]) / 4

    off = [F.sqrt((F.col(f"x{k}") - F.col(f"smooth_x{k}")) ** 2 + (F.col(f"y{k}") - F.col(f"smooth_y{k}")) ** 2) for k in range(4)]
    found = rows.withColumns({"_raw": steps(""), "_smooth": steps("smooth_"), "_off": sum(off[1:], off[0]) / 4}).where("_raw is not null")
    tail = lambda c: F.percentile(c, F.lit(0.95))
    out = found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"), F.avg("_raw").alias("raw_mean"), F.avg("_smooth").alias("smooth_mean"), tail("_raw").alias("raw_p95"), tail("_smooth").alias("smooth_p95"), F.avg("_off").alias("offset_mean"),
    )
    return out.withColumn("ratio", F.try_divide("smooth_mean", F.nullif("raw_mean", F.lit(0.0))))
