"""A scripted run of 180 frames: six players, two camera segments, fifteen frames without calibration. Its totals are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the script: the court in metres, and where the players of each layout stand in pixels.
LENGTH, WIDTH = 28.6512, 15.24
FIRST, SECOND = ((400, 380, 430), (500, 540, 565)), ((65, 105, 140), (220, 195, 255))
ROWS = (150, 100, 215)
NUMBERS = {"blue": ("7", "8", "9"), "pink": ("12", "13", "14")}


def demo_persons(spark: SparkSession) -> DataFrame:
    """One row per frame and player, in the columns that ``operators.observed`` reads, with their pixel boxes."""
    players = [(team, t, p, number, 1 + 3 * t + p, float(FIRST[t][p]), float(SECOND[t][p]), float(ROWS[p])) for t, (team, numbers) in enumerate(NUMBERS.items()) for p, number in enumerate(numbers)]
    roster = spark.createDataFrame(players, "team string, t int, p int, number string, track_id int, first double, second double, top double")
    i = F.col("frame_index")
    x = F.when(i % 90 < 55, F.col("first")).otherwise(F.col("second")) + (i % 45) * 0.08
    rows = spark.range(180).withColumnRenamed("id", "frame_index").crossJoin(F.broadcast(roster)).withColumn("_x", x)
    turned = i >= 90
    rows = rows.withColumn("_x", F.when(turned, F.lit(640) - (F.col("_x") + 13) - 13).otherwise(F.col("_x"))).withColumn("_y", F.when(turned, F.lit(400) - (F.col("top") + 55) - 55).otherwise(F.col("top")))
    available = ~i.between(60, 74)
    at = lambda c: F.when(available, c)
    return rows.select(
        "frame_index", (i / 30).alias("timestamp_s"), F.floor(i / 90).cast("int").alias("segment_id"), (i == 90).alias("scene_cut"), F.lit(True).alias("included"), "track_id", F.lit("player").alias("role"),
        at((F.col("_x") + 13 - 20) / 600 * LENGTH).alias("x"), at((F.col("_y") + 55 - 60) / 280 * WIDTH).alias("y"), F.when(available, "projected").otherwise("calibration_unavailable").alias("position_status"),
        F.lit("scripted").alias("ground_point_method"), F.struct("team", "number").alias("named"), "team", available.alias("court_ok"), F.array("_x", "_y", F.col("_x") + 26, F.col("_y") + 55).alias("box"),
    )
