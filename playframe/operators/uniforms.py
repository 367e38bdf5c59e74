"""Teams by uniform colours: robust prototypes per body region, a threshold chosen on held-out tracks, classes with a margin, and guarded replacement.

Samples are rows with ``features``: per body region the colour channels (0 to 255);
labelled ones also ``label`` (the team, known from something else than colour) and
``group`` (the track). Every fifth group is held out as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playframe.operators.contracts import changed_rows

#: Deviations per median deviation, bounds of a scale, the threshold grid and what it must reach on held-out tracks.
PER_MAD, SCALES = 1.4826, (8.0, 55.0)
MARGINS, LIMITS = (1.0, 2.0, 3.0, 4.0, 6.0), (4.0, 6.0, 9.0)
HELD_EVERY, LEAST_ACCEPTED, LEAST_PRECISION = 5, 20, 0.98


def held_out(group: Column) -> Column:
    return F.pmod(group, F.lit(HELD_EVERY)) == 0


def prototypes(samples: DataFrame) -> DataFrame:
    """Per label ``centers`` and ``scales``, arrays like ``features``: the lower median of each channel and its median absolute deviation, scaled and bounded.

    Learned from groups that aren't held out. Channels are 8-bit, so the medians' counts
    are bounded by 256 values.
    """
    known = samples.where(F.col("label").isNotNull() & ~held_out(F.col("group")))
    cells = known.select("label", F.posexplode("features").alias("region", "_channels")).select("label", "region", F.posexplode("_channels").alias("channel", "value")).where("value is not null")
    key = ["label", "region", "channel"]
    centers = cells.groupBy(*key).agg(F.expr("percentile_disc(0.5) within group (order by value)").cast("double").alias("center"))
    away = cells.join(centers, key).withColumn("_d", F.abs(F.col("value") - F.col("center")))
    spread = away.groupBy(*key, "center").agg(F.expr("percentile_disc(0.5) within group (order by _d)").cast("double").alias("_mad"))
    scaled = spread.withColumn("scale", F.least(F.greatest(F.col("_mad") * PER_MAD, F.lit(SCALES[0])), F.lit(SCALES[1])))
    nested = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("region", F.col(f"_{c}").alias("v")))), lambda r: r["v"])
    inner = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("channel", F.col(c).alias("v")))), lambda r: r["v"])
    regions = scaled.groupBy("label", "region").agg(inner("center").alias("_centers"), inner("scale").alias("_scales"))
    return regions.groupBy("label").agg(nested("centers").alias("centers"), nested("scales").alias("scales"))


def measured(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Adds per region ``winner`` (the nearest label, the first of equal ones), ``nearest`` and ``separation`` (to the second nearest).

    The distance is the mean squared deviation over a region's channels in units of
    their scales. The model is a row a team and goes to every task.
    """
    teams = F.broadcast(model.agg(F.array_sort(F.collect_list(F.struct("label", "centers", "scales"))).alias("_teams")))
    away = lambda x, c, s: F.aggregate(F.zip_with(F.zip_with(x, c, lambda v, m: v - m), s, lambda d, k: (d / k) * (d / k)), F.lit(0.0), lambda a, b: a + b) / F.size(x)
    order = lambda x, r: F.array_sort(F.transform("_teams", lambda t: F.struct(away(x, t["centers"][r], t["scales"][r]).alias("d"), t["label"].alias("label"))))
    found = rows.crossJoin(teams).withColumn("_by", F.transform("features", order))
    return found.withColumns({
        "winner": F.transform("_by", lambda o: o[0]["label"]), "nearest": F.transform("_by", lambda o: o[0]["d"]), "separation": F.transform("_by", lambda o: F.get(o, F.lit(1))["d"] - o[0]["d"]),
    }).drop("_by", "_teams")


def _accepted(margin: Column, limit: Column) -> Column:
    one = F.size(F.array_distinct("winner")) == 1
    return one & F.coalesce(F.array_max("nearest") <= limit, F.lit(False)) & F.coalesce(F.array_min("separation") >= margin, F.lit(False))


def threshold_grid(samples: DataFrame, model: DataFrame) -> DataFrame:
    """Per margin, limit and predicted label how many held-out samples are ``accepted``, and how many of these are ``correct``."""
    rows = measured(samples.where(F.col("label").isNotNull() & held_out(F.col("group"))), model)
    grid = F.array(*[F.struct(F.lit(m).alias("margin"), F.lit(x).alias("limit")) for m in MARGINS for x in LIMITS])
    cells = rows.select("label", "winner", F.explode(F.filter(grid, lambda g: _accepted(g["margin"], g["limit"]))).alias("g")).withColumn("predicted", F.col("winner")[0])
    return cells.groupBy("g.margin", "g.limit", "predicted").agg(F.count(F.lit(1)).alias("accepted"), F.count(F.when(F.col("predicted") == F.col("label"), 1)).alias("correct"))


def chosen_threshold(grid: DataFrame, labels: int = 2) -> DataFrame:
    """The (margin, limit) that accepts most held-out samples among those where each of ``labels`` labels has 20 accepted and 98 % of them correct; no row if there is none. Of equals the smaller margin, then limit."""
    fine = F.min(((F.col("accepted") >= LEAST_ACCEPTED) & (F.col("correct") >= LEAST_PRECISION * F.col("accepted"))).cast("int"))
    cells = grid.groupBy("margin", "limit").agg(F.sum("accepted").alias("accepted"), F.sum("correct").alias("correct"), fine.alias("_fine"), F.count(F.lit(1)).alias("_labels")).where((F.col("_fine") == 1) & (F.col("_labels") == labels))
    return cells.select("margin", "limit", "accepted", "correct").orderBy(F.col("accepted").desc(), "margin", "limit").limit(1)


def classified(rows: DataFrame, model: DataFrame, margin: float, limit: float) -> DataFrame:
    """Adds ``team`` and ``separation``: the label that all regions have nearest, within the limit and clear of the second by the margin; else null."""
    found = measured(rows, model)
    team = F.when(_accepted(F.lit(margin), F.lit(limit)), F.col("winner")[0])
    return found.withColumn("team", team).withColumn("separation", F.array_min("separation")).drop("winner", "nearest")


def replaced(rows: DataFrame, teams: DataFrame, keys: list[str], column: str = "team") -> DataFrame:
    """``rows`` with ``column`` from ``teams`` (keys, team), the row's own where that has none; an error if anything else would change."""
    new = teams.select(*keys, F.col("team").alias("_team"))
    out = rows.join(new, keys, "left").withColumn(column, F.coalesce("_team", column)).select(*rows.columns)
    if changed_rows(rows, out, keys, [c for c in rows.columns if c not in (*keys, column)]).limit(1).count():
        raise ValueError("a replacement of teams must not change anything else, nor repeat or lose a row")
    return out
