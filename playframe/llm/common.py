"""What the corpus operators share: written intermediate tables and text expressions."""

from __future__ import annotations

import atexit
import string
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_OWN_DIR: dict[str, str] = {}
_WRITTEN: dict[str, tuple[SparkSession, list[str]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _OWN_DIR.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="playframe-"))
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and a lost executor costs no rerun.

    Remove it with ``drop`` once nothing reads it; what is left goes when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/playframe/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[path] = (spark, [path])
    back._playframe_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Remove tables made by ``written``."""
    for table in tables:
        _remove(table._playframe_path)


def drop_later(table: DataFrame, folder: str) -> None:
    """Let ``folder``, what a table made by ``written`` refers to, go with it."""
    spark, paths = _WRITTEN[table._playframe_path]
    _WRITTEN[table._playframe_path] = (spark, [*paths, folder])


def _remove(path: str) -> None:
    spark, paths = _WRITTEN.pop(path)
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        for one in paths:
            where = jvm.org.apache.hadoop.fs.Path(one)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_WRITTEN):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001  the session may be gone already; the folder's owner cleans what is left
            _WRITTEN.pop(path, None)


def worker_state(owner: str) -> dict:
    """What a Python worker keeps from task to task for one operator, ``owner``; what it kept for another is dropped.

    Functions pickled by value get new globals in each task; this is one a process.
    Workers outlive a stage, so without the drop each operator of a pipeline would
    add its own tables to those of the operators before.
    """
    kept = sys.modules.setdefault("_playframe_worker", types.ModuleType("_playframe_worker"))
    if getattr(kept, "owner", None) != owner:
        kept.owner, kept.state = owner, {}
    return kept.state


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: what a task makes of a batch, and sends back at once, stays small beside it."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
    pa.default_memory_pool().release_unused()


def whole_row(df: DataFrame) -> Column:
    """All columns of a row, whatever their names, as the struct ``_row``."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def normalised(text: str) -> Column:
    """The text with each run of ASCII white space replaced by one space; null counts as empty.

    The pattern passes over single spaces, which need no change.
    """
    return F.regexp_replace(text_or_empty(text), rf"{SPACE}{{2,}}|[\x09-\x0D]", " ")


def word_count(text: str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else; texts of ASCII alone take the quicker of two equal ways."""
    slower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slower)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
