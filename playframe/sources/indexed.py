"""JSON Lines read by a byte index: a range of frames opens only the bytes of its lines.

The index is a table (file, frame_index, first_byte, end_byte), made once by a pass over
the file. The data source plans a partition for each stretch of the index and turns a
filter on ``frame_index`` into byte ranges, so a page of a long match reads a page.
File and index are read where the driver and the tasks run: their folder must be
mounted there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Bytes of one partition, and of the gap between two lines that are read together.
PART_BYTES, GAP_BYTES = 8 << 20, 1 << 12
FORMAT = "indexed_frames"


def byte_index(spark: SparkSession, path: str) -> DataFrame:
    """(frame_index, first_byte, end_byte) of every line of a JSON Lines file, in tasks over blocks of it.

    A block takes the lines that begin in it: it skips to the first line break before
    its start and reads beyond its end to finish the last one.
    """
    import os

    size = os.path.getsize(path)
    blocks = spark.range(max(1, -(-size // PART_BYTES))).select((F.col("id") * PART_BYTES).alias("start")).repartition(max(1, min(200, -(-size // PART_BYTES))))

    def lines(parts):
        import pandas as pd

        for part in parts:
            out = []
            for start in part["start"]:
                with open(path, "rb") as f:
                    at = 0
                    if start:
                        f.seek(int(start) - 1)
                        f.readline()
                        at = f.tell()
                    while at < start + PART_BYTES and (line := f.readline()):
                        if line.strip():
                            out.append((json.loads(line)["frame_index"], at, at + len(line)))
                        at += len(line)
            yield pd.DataFrame(out, columns=["frame_index", "first_byte", "end_byte"])

    return blocks.mapInPandas(lines, "frame_index long, first_byte long, end_byte long")


@dataclass
class Stretch(InputPartition):
    """Lines of neighbouring frames: the bytes to read, and the lines' places in them."""

    low: int
    high: int
    lines: list[tuple[int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.index, self.schema = options["path"], options["index"], schema
        self.low, self.high = None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("frame_index",) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            v = int(f.value)
            if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                v_low = v + isinstance(f, GreaterThan)
                self.low = v_low if self.low is None else max(self.low, v_low)
            if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                v_high = v - isinstance(f, LessThan)
                self.high = v_high if self.high is None else min(self.high, v_high)

    def partitions(self) -> list[Stretch]:
        """Stretches of at most ``PART_BYTES``; the index's own row-group statistics leave out what the range can't hold."""
        import pyarrow.dataset as ds

        keep = None
        for bound, op in ((self.low, "__ge__"), (self.high, "__le__")):
            if bound is not None:
                own = getattr(ds.field("frame_index"), op)(bound)
                keep = own if keep is None else keep & own
        rows = ds.dataset(self.index, format="parquet").to_table(columns=["first_byte", "end_byte", "frame_index"], filter=keep).sort_by("first_byte")
        out: list[Stretch] = []
        for a, b, frame in zip(*(rows.column(c).to_pylist() for c in ("first_byte", "end_byte", "frame_index")), strict=True):
            if out and a - out[-1].high <= GAP_BYTES and b - out[-1].low <= PART_BYTES:
                out[-1].high = b
                out[-1].lines.append((frame, a, b))
            else:
                out.append(Stretch(a, b, [(frame, a, b)]))
        return out or [Stretch(0, 0, [])]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if not partition.lines:
            return
        with open(self.path, "rb") as f:
            f.seek(partition.low)
            held = f.read(partition.high - partition.low)
        names = self.schema.fieldNames()
        for frame, a, b in partition.lines:
            text = held[a - partition.low : b - partition.low].decode()
            yield tuple({"frame_index": frame, "line": text.rstrip("\n"), "first_byte": a, "end_byte": b}[c] for c in names)


class IndexedFrames(DataSource):
    """Options ``path`` (the file) and ``index`` (a Parquet file or folder from ``write_index``); columns frame_index, line, first_byte, end_byte."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "frame_index long, line string, first_byte long, end_byte long"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, schema)


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """The byte index as Parquet sorted by frame, in small row groups so that a range reads few of them."""
    byte_index(spark, path).orderBy("frame_index").write.mode("errorifexists").option("parquet.block.size", 1 << 20).parquet(index)


def read_frames(spark: SparkSession, path: str, index: str, schema: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Frames ``low`` to ``high`` as parsed records, with ``frame_index`` and the bytes they came from; only those bytes are opened."""
    spark.dataSource.register(IndexedFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format(FORMAT).option("path", path).option("index", index).load()
    if low is not None:
        rows = rows.where(F.col("frame_index") >= low)
    if high is not None:
        rows = rows.where(F.col("frame_index") <= high)
    return rows.select("frame_index", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("record"), "first_byte", "end_byte")
