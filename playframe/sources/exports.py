"""Data sets written from annotations: text labels per image, COCO documents, triplets of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def label_lines(boxes: DataFrame, image: str, digits: int | None = None) -> DataFrame:
    """Per image its lines ``class cx cy w h``, relative to ``width`` and ``height``; in the order of ``n``.

    ``digits`` fixes the decimals; without it numbers are the shortest that read back
    as the same double.
    """
    number = lambda c: F.format_string(f"%.{digits}f", c) if digits is not None else c.cast("string")
    rel = [(F.col("x1") + F.col("x2")) / 2 / F.col("width"), (F.col("y1") + F.col("y2")) / 2 / F.col("height"), (F.col("x2") - F.col("x1")) / F.col("width"), (F.col("y2") - F.col("y1")) / F.col("height")]
    line = F.concat_ws(" ", F.col("class_id").cast("string"), *map(number, rel))
    rows = boxes.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("_l"))
    return rows.select(image, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))


def write_labels(lines: DataFrame, images: DataFrame, image: str, split: str, folder: str) -> None:
    """Label texts by split, one row per image, images without boxes included with an empty text."""
    images.select(image, split).join(lines, image, "left").fillna("", ["text"]).write.mode("errorifexists").partitionBy(split).parquet(folder)


def dense_ids(rows: DataFrame, keys: list[str], order: list[str], name: str, parts: int = 256) -> DataFrame:
    """Adds ids from 1 in ``order`` within ``keys`` without sorting a key in one task: rows are cut into blocks by order, counted, and numbered in each."""
    from playframe.operators.sequence import beside, order_blocks

    block = [*keys, "_part"]
    dealt = rows.withColumn("_part", order_blocks(rows, [F.col(c) for c in [*keys, *order]], parts))
    counts = dealt.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*block, (F.sum("_n").over(W.partitionBy(*keys).orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy(*block).orderBy(*order))
    return beside(dealt.withColumn("_own", own), before, block).withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_before")


def coco(images: DataFrame, boxes: DataFrame, image: str, split: str, per_split: bool = True) -> DataFrame:
    """COCO rows per split: ``kind`` image or annotation, and ``record``, its JSON. Ids are dense from 1, categories class + 1.

    Image ids restart in every split, or count over all where ``per_split`` is off.
    """
    ids = dense_ids(images, [split] if per_split else [], [image], "_id")
    meta = F.to_json(F.struct(F.col("_id").alias("id"), F.col(image).alias("file_name"), "width", "height"))
    own = boxes.join(ids.select(image, split, "_id"), image)
    own = dense_ids(own, [split], [image, "n"], "_a")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    record = F.to_json(F.struct(F.col("_a").alias("id"), F.col("_id").alias("image_id"), (F.col("class_id") + 1).alias("category_id"), F.array("x1", "y1", w, h).alias("bbox"), (w * h).alias("area"), F.lit(0).alias("iscrowd")))
    return ids.select(split, F.lit("image").alias("kind"), meta.alias("record")).unionByName(own.select(split, F.lit("annotation").alias("kind"), record.alias("record")))


def keypoint_visibility(occluded: Column) -> Column:
    """COCO visibility of a labelled point: 1 hidden, 2 seen."""
    return F.when(F.coalesce(occluded, F.lit(False)), 1).otherwise(2)


def triplets(frames: DataFrame, keys: list[str], image: str, target: str) -> DataFrame:
    """Three consecutive frames and the target of the last: ``image1, image2, image3, target``; none across a missing frame."""
    from playframe.operators.sequence import contiguous_windows

    rows = contiguous_windows(frames, keys, "frame_index", image, 3)
    return rows.select(*keys, "frame_index", *[F.col("window")[i].alias(f"image{i + 1}") for i in range(3)], F.col(target).alias("target"))


def rallies(frames: DataFrame, keys: list[str], visible: Column, x: str, y: str) -> DataFrame:
    """Per unbroken run of frames its rows ``Frame, Visibility, X, Y``, numbered from 0; a ball out of sight is at 0, 0."""
    from playframe.operators.sequence import long_islands

    rows = long_islands(frames, keys, "frame_index", 1)
    at = lambda c: F.when(visible, F.col(c)).otherwise(0.0)
    return rows.select(*keys, "island", (F.col("frame_index") - F.col("first")).alias("Frame"), visible.cast("int").alias("Visibility"), at(x).alias("X"), at(y).alias("Y"))


def export_differences(expected: DataFrame, exported: DataFrame) -> DataFrame:
    """Records that an export lacks or has too many of, with ``side``; none where it holds exactly what its sources give."""
    cols = expected.columns
    missing = expected.exceptAll(exported.select(*cols)).withColumn("side", F.lit("missing"))
    return missing.unionByName(exported.select(*cols).exceptAll(expected).withColumn("side", F.lit("extra")))


def split_leaks(samples: DataFrame, split: str, groups: list[str]) -> DataFrame:
    """Values of each group column (match, venue, content hash, ...) that more than one split has."""
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("by"), F.col(g).cast("string").alias("value")) for g in groups]))
    rows = samples.select(pairs.alias("_g"), F.col(split).alias("_split")).where("_g.value is not null").groupBy("_g", "_split").agg(F.count(F.lit(1)).alias("_n"))
    return rows.groupBy("_g").agg(F.count(F.lit(1)).alias("splits"), F.sum("_n").alias("rows")).where("splits > 1").select("_g.*", "splits", "rows")
