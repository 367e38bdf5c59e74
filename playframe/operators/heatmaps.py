"""Heat maps: intervals of players between frames, their phase, and mass on a grid.

Mass is conserved: an interval clipped to the query's range, turned to one basket and
cut at the half line gives exactly the part of its time (or distance) that is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playframe.functions.geometry import distance
from playframe.functions.tracking import run_keys, same_keys
from playframe.operators.aggregates import union_duration

SPACING = 0.20


def plans(frames: DataFrame) -> DataFrame:
    """Adds ``plan``, from 0: a new camera plan begins at a cut and where the segment changes. Partitioned by ``run_id`` where there is one."""
    keys = run_keys(frames)
    w = W.partitionBy(*keys).orderBy("frame_index")
    new = F.coalesce(F.col("scene_cut"), F.lit(False)) | F.coalesce(F.col("segment_id") != F.lag("segment_id").over(w), F.lit(True))
    return frames.withColumn("plan", F.sum(new.cast("int")).over(w) - 1)


def intervals(persons: DataFrame, max_gap: float = 0.2, max_speed: float = 12.0) -> DataFrame:
    """Per tracked player and pair of frames: ``start``, ``end``, team, subject and both points.

    Persons are rows (frame_index, timestamp_s, plan, included, track_id, role, team,
    subject, x, y, ground_point_method); a point counts if it is on the court. Rows
    whose track or subject stands twice in a frame, or that have no team, make no
    interval. Both frames must be included, consecutive, of one plan and close in time.
    Points are void across another ground method and where the step is too fast.
    """
    rows = persons.where((F.col("role") == "player") & F.col("track_id").isNotNull())
    runs = run_keys(persons)
    n = lambda *keys: F.count(F.lit(1)).over(W.partitionBy(*runs, "frame_index", *keys))
    rows = rows.where(F.col("frame_index").isNotNull()).withColumn("_tracks", n("track_id")).withColumn("_subjects", n("subject"))
    rows = rows.where((F.col("_tracks") == 1) & (F.col("subject").isNull() | (F.col("_subjects") == 1)) & F.col("team").isNotNull()).drop("_tracks", "_subjects")
    w = W.partitionBy(*runs, "plan", "track_id").orderBy("frame_index")
    rows = rows.withColumn("_p", F.lag(F.struct("frame_index", "timestamp_s", "included", "team", "subject", "x", "y", "ground_point_method")).over(w))
    dt = F.col("timestamp_s") - F.col("_p.timestamp_s")
    pair = (F.col("_p.frame_index") == F.col("frame_index") - 1) & F.col("included") & F.col("_p.included") & (dt > 0) & (dt <= max_gap + 1e-9)
    pair = pair & (F.col("team") == F.col("_p.team")) & F.col("subject").eqNullSafe(F.col("_p.subject"))
    step = distance(F.col("x"), F.col("y"), F.col("_p.x"), F.col("_p.y"))
    sound = step.isNotNull() & F.col("ground_point_method").eqNullSafe(F.col("_p.ground_point_method")) & (step / dt <= max_speed)
    point = lambda c: F.when(sound, F.col(c))
    return rows.where(pair).select(
        *runs, "plan", "track_id", "frame_index", "team", "subject", F.col("_p.timestamp_s").alias("start"), F.col("timestamp_s").alias("end"),
        point("_p.x").alias("x1"), point("_p.y").alias("y1"), point("x").alias("x2"), point("y").alias("y2"), *([c for c in ("segment_id",) if c in rows.columns]),
    )


def with_distance(found: DataFrame, contributions: DataFrame) -> DataFrame:
    """Adds ``distance`` of the contribution that measures the same interval: equal track, frame and subject, start and length within 1e-6."""
    runs = run_keys(found)
    own = contributions.select(
        *[F.col(c).alias(f"_{c}") for c in runs],
        F.col("segment_id").alias("_s"), F.col("track_id").alias("_t"), F.col("frame_index").alias("_f"), F.col("subject").alias("_who"),
        F.col("distance").alias("_d"), F.col("interval_start").alias("_from"), F.col("measured").alias("_m"), F.col("reason").alias("_r"),
    )
    rows = found.join(own, same_keys(runs) & (F.col("segment_id") == F.col("_s")) & (F.col("track_id") == F.col("_t")) & (F.col("frame_index") == F.col("_f")), "left")
    same = F.col("x1").isNotNull() & F.col("x2").isNotNull() & F.col("_r").isNull() & (F.col("_d") >= 0) & (F.abs(F.col("_from") - F.col("start")) <= 1e-6)
    same = same & (F.abs(F.col("_m") - (F.col("end") - F.col("start"))) <= 1e-6) & (F.col("subject").isNull() | (F.col("subject") == F.col("_who")))
    return rows.withColumn("distance", F.when(same, F.col("_d"))).drop(*[f"_{c}" for c in runs], "_s", "_t", "_f", "_who", "_d", "_from", "_m", "_r")


def with_phases(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``owner``, ``direction`` and ``episode`` of the phase span that ends at the interval's frame, as both are made of the same pairs of frames."""
    runs = run_keys(found)
    own = spans.select(*[F.col(c).alias(f"_{c}") for c in runs], F.col("plan").alias("_p"), F.col("frame_index").alias("_f"), "owner", "direction", "episode")
    return found.join(own, same_keys(runs) & (F.col("plan") == F.col("_p")) & (F.col("frame_index") == F.col("_f")), "left").drop(*[f"_{c}" for c in runs], "_p", "_f")


def clipped(found: DataFrame, start: float, end: float, length: float, width: float, half: bool) -> DataFrame:
    """Intervals cut to [start, end): ``seconds``, ``localized`` and ``kept`` (of these inside the half), the kept path (ax, ay) to (bx, by) and its times.

    With ``half`` an interval of direction -1 is turned by 180 degrees, and only the
    right half counts, its line moved to 0; an interval without direction has no path.
    A place on the way is a share of the interval, so a cut is a range of shares: the
    query's range, less what lies before or behind the half line. The steps are bound
    one by one as functions of a struct, so that generated code stays small.
    """
    rows = found.withColumn("_a", F.greatest("start", F.lit(start))).withColumn("_b", F.least("end", F.lit(end))).where("_b > _a")
    line = length / 2 if half else 0.0
    on_court = F.col("x1").isNotNull() & F.col("x2").isNotNull() & (F.col("direction").isNotNull() if half else F.lit(True))
    turned = F.coalesce(F.col("direction") == -1, F.lit(False)) if half else F.lit(False)
    given = F.struct("start", (F.col("end") - F.col("start")).alias("span"), "_a", "_b", "x1", "y1", "x2", "y2", on_court.alias("ok"), turned.alias("turned"))

    def placed(r: Column) -> Column:
        """The way from (x, y) by (dx, dy), turned and from the line on, and the shares that the range leaves."""
        at = lambda c, extent, off: F.when(r["turned"], extent - r[c]).otherwise(r[c]) - off
        away = lambda c: F.when(r["turned"], r[f"{c}1"] - r[f"{c}2"]).otherwise(r[f"{c}2"] - r[f"{c}1"])
        share = lambda c: (r[c] - r["start"]) / r["span"]
        return F.struct(r["start"].alias("start"), r["span"].alias("span"), r["ok"].alias("ok"), at("x1", length, line).alias("x"), at("y1", width, 0.0).alias("y"), away("x").alias("dx"), away("y").alias("dy"), share("_a").alias("lo"), share("_b").alias("hi"))

    def halved(r: Column) -> Column:
        """The shares on the right of the line; none where the way stays on its left."""
        if not half:
            return r
        cross = -r["x"] / F.nullif(r["dx"], F.lit(0.0))
        low, high = F.when(r["dx"] > 0, F.greatest(r["lo"], cross)).otherwise(r["lo"]), F.when(r["dx"] < 0, F.least(r["hi"], cross)).when((r["dx"] == 0) & (r["x"] < 0), None).otherwise(r["hi"])
        return F.struct(*[r[c].alias(c) for c in ("start", "span", "ok", "x", "y", "dx", "dy")], low.alias("lo"), high.alias("hi"))

    def kept(r: Column) -> Column:
        there = lambda v: F.when(r["ok"] & (r["hi"] >= r["lo"]), v)
        point = lambda c, share: there(r[c] + r[share] * r[f"d{c}"])
        return F.struct(
            F.coalesce(there((r["hi"] - r["lo"]) * r["span"]), F.lit(0.0)).alias("kept"), there(r["start"] + r["lo"] * r["span"]).alias("_from"), there(r["start"] + r["hi"] * r["span"]).alias("_to"),
            point("x", "lo").alias("ax"), point("y", "lo").alias("ay"), point("x", "hi").alias("bx"), point("y", "hi").alias("by"),
        )

    cut = F.get(F.transform(F.transform(F.transform(F.array(given), placed), halved), kept), F.lit(0))
    seconds = F.col("_b") - F.col("_a")
    rows = rows.withColumns({"seconds": seconds, "localized": F.when(on_court, seconds).otherwise(0.0), "_cut": cut})
    return rows.select(*[c for c in rows.columns if c != "_cut"], "_cut.*")


def cells(rows: DataFrame, keys: list[str], weight: Column, length: float, width: float, nx: int, ny: int) -> DataFrame:
    """Mass per grid cell: each kept path as ceil(length / 0.2) points in the middle of its parts, which share its weight."""
    path = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    rows = rows.select(*keys, "ax", "ay", "bx", "by", weight.alias("_w"), F.greatest(F.lit(1), F.ceil(path / SPACING)).cast("int").alias("_n")).where("ax is not null and _w > 0")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    share = (F.col("_i") + 0.5) / F.col("_n")
    spot = lambda a, b, extent, n: F.least(F.lit(n - 1), F.floor((F.col(a) + share * (F.col(b) - F.col(a))) / extent * n)).cast("int")
    placed = rows.select(*keys, spot("ax", "bx", length, nx).alias("cell_x"), spot("ay", "by", width, ny).alias("cell_y"), (F.col("_w") / F.col("_n")).alias("_m"))
    return placed.groupBy(*keys, "cell_x", "cell_y").agg(F.sum("_m").alias("mass"))


def of_phase(found: DataFrame, team: str, phase: str | None, episode: int | None = None) -> DataFrame:
    """Intervals of one phase seen from a team: offense, defense or unknown; of one episode where given."""
    rows = found if episode is None else found.where(F.col("episode") == episode)
    if phase == "offense":
        return rows.where(F.col("owner") == team)
    if phase == "defense":
        return rows.where(F.col("owner").isNotNull() & (F.col("owner") != team))
    return rows.where(F.col("owner").isNull()) if phase == "unknown" else rows


def heatmap(found: DataFrame, keys: list[str], start: float, end: float, length: float, width: float, metric: str = "presence", half: bool = False, zones: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per ``keys`` (a team or a subject) the grid and the totals of [start, end).

    ``metric`` presence weighs by seconds, movement by measured metres. The grid has
    cells of about a metre, or 3 x 3 ``zones``. Totals are seconds observed, localized,
    in the half, measured, and the coverage; ``video`` is the time of the union of the
    localized spans, which several players share.
    """
    if metric not in ("presence", "movement") or end <= start:
        raise ValueError("a heat map needs the metric presence or movement and a range that isn't empty")
    rows = clipped(found, start, end, length, width, half)
    weight, counted = F.col("kept"), F.col("kept")
    if metric == "movement":
        weight = F.col("distance") * F.col("kept") / (F.col("end") - F.col("start"))
        counted = F.when(F.col("distance").isNotNull(), F.col("kept")).otherwise(0.0)
    extent = length / 2 if half else length
    nx, ny = (3, 3) if zones else (-(-int(extent * 1e9) // 10**9), -(-int(width * 1e9) // 10**9))
    grid = cells(rows, keys, weight, extent, width, nx, ny)
    totals = rows.groupBy(*keys).agg(F.sum("seconds").alias("observed"), F.sum("localized").alias("localized"), F.sum("kept").alias("in_half"), F.sum(counted).alias("measured"))
    totals = totals.withColumn("coverage", F.try_divide("localized", F.nullif("observed", F.lit(0.0))))
    video = union_duration(rows.where("localized > 0").select(*keys, F.col("_a").alias("start"), F.col("_b").alias("end")), keys, "start", "end").withColumnRenamed("duration", "video")
    return grid, totals.join(video, keys, "left")


def comparison(grid: DataFrame, side: str, first: str, second: str) -> DataFrame:
    """Per cell the first side's share of its mass less the second's."""
    from playframe.operators.aggregates import share_difference

    return share_difference(grid, side, first, second)


def phase_durations(spans: DataFrame, team: Column, start: float, end: float, keys: list[str] = ()) -> DataFrame:
    """Seconds of [start, end) in offense, defense and unknown, how many of the known come from settled play, court or contacts, and without direction."""
    seconds = F.greatest(F.lit(0.0), F.least("end", F.lit(end)) - F.greatest("start", F.lit(start)))
    owned = F.col("owner").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("_s"))), F.lit(0.0))
    rows = spans.withColumn("_s", seconds)
    out = rows.groupBy(*keys).agg(
        total(F.col("owner") == team).alias("offense"), total(owned & (F.col("owner") != team)).alias("defense"),
        total(owned & (F.col("method") == "settled")).alias("settled"), total(owned & (F.col("method") == "court")).alias("court_context"),
        total(owned & ~F.col("method").isin("settled", "court")).alias("contacts"), total(owned & F.col("direction").isNull()).alias("no_direction"),
    )
    return out.withColumn("unknown", F.greatest(F.lit(0.0), F.lit(end - start) - F.col("offense") - F.col("defense")))


def density_field(grid: DataFrame, keys: list[str], length: float, width: float, cells: tuple[int, int], sigma: float = 0.85, per_metre: int = 8) -> DataFrame:
    """Mass per square metre on ``per_metre`` samples a metre: every cell's mass spread by a Gaussian of ``sigma`` metres that is normalised over the court.

    The kernel is separable: one join with a fixed table an axis, and sums between.
    Returns ``keys, sample_x, sample_y, density``; samples are cell middles of the fine grid.
    """
    spark = grid.sparkSession

    def spread(rows: DataFrame, axis: str, n: int, extent: float, group: list[str]) -> DataFrame:
        fine = round(extent * per_metre)
        table = spark.range(n).select(F.col("id").cast("int").alias(f"cell_{axis}")).crossJoin(spark.range(fine).select(F.col("id").cast("int").alias(f"sample_{axis}")))
        away = (F.col(f"cell_{axis}") + 0.5) * (extent / n) - (F.col(f"sample_{axis}") + 0.5) * (extent / fine)
        table = table.withColumn("_k", F.exp(-away * away / (2 * sigma * sigma)))
        table = table.withColumn("_k", F.col("_k") / F.sum("_k").over(W.partitionBy(f"cell_{axis}")))
        return rows.join(F.broadcast(table), f"cell_{axis}").groupBy(*group, f"sample_{axis}").agg(F.sum(F.col("mass") * F.col("_k")).alias("mass"))

    rows = spread(grid, "x", cells[0], length, [*keys, "cell_y"])
    rows = spread(rows, "y", cells[1], width, [*keys, "sample_x"])
    return rows.select(*keys, "sample_x", "sample_y", (F.col("mass") * per_metre * per_metre).alias("density"))


def sampled(field: DataFrame, points: DataFrame, keys: list[str], per_metre: int = 8) -> DataFrame:
    """Adds ``density`` at points ``x``, ``y`` in metres: bilinear between the four samples around, the edge's own beyond it."""
    rows = points.withColumn("_id", F.monotonically_increasing_id())
    at = {c: F.col(c) * per_metre - 0.5 for c in ("x", "y")}
    corners = F.explode(F.array(*[F.struct((F.floor(at["x"]) + i).cast("int").alias("sample_x"), (F.floor(at["y"]) + j).cast("int").alias("sample_y"), ((at["x"] - F.floor(at["x"]) if i else 1 - at["x"] + F.floor(at["x"])) * (at["y"] - F.floor(at["y"]) if j else 1 - at["y"] + F.floor(at["y"]))).alias("share")) for i in (0, 1) for j in (0, 1)]))
    near = rows.withColumn("_c", corners).select(*rows.columns, "_c.*")
    got = near.join(field, [*keys, "sample_x", "sample_y"]).groupBy("_id").agg((F.sum(F.col("density") * F.col("share")) / F.nullif(F.sum("share"), F.lit(0.0))).alias("density"))
    return rows.join(got, "_id", "left").drop("_id")


def bands(field: DataFrame, keys: list[str], n: int = 7) -> DataFrame:
    """Adds ``band`` 0 to n - 1: the density as a share of its key's largest, in equal steps; 0 is nothing."""
    share = F.col("density") / F.nullif(F.max("density").over(W.partitionBy(*keys)), F.lit(0.0))
    return field.withColumn("band", F.coalesce(F.least(F.lit(n - 1), F.ceil(share * (n - 1))), F.lit(0)).cast("int"))
