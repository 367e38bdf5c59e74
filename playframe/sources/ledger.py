"""Work that is done once: stages with receipts by the fingerprint of what went in, and references that move only from where they are expected.

Both rest on one primitive, a file that only one writer can create (``claim``). Nothing
here holds data: stages write tables, the ledger says which ones count.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.parse
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from playframe.sources.runs import document


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with ``text``; false if it is there already. Of racing writers one succeeds.

    On a local path the file appears whole, by linking a finished one; elsewhere the
    store's own create-if-absent decides, which distributed file systems have.
    """
    parts = urllib.parse.urlsplit(path)
    if parts.scheme in ("", "file"):
        os.makedirs(os.path.dirname(parts.path), exist_ok=True)
        draft = f"{parts.path}.{uuid.uuid4().hex}"
        with open(draft, "x") as f:
            f.write(text)
        try:
            os.link(draft, parts.path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    store, where = _store(spark, path)
    if store.exists(where):
        return False
    try:
        out = store.create(where, False)
    except Exception:  # noqa: BLE001  each store has its own error for a file that is there
        if store.exists(where):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _read(spark: SparkSession, path: str) -> dict | None:
    """A control document; None if there is none."""
    store, where = _store(spark, path)
    if not store.exists(where):
        return None
    return document("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def _names(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    store, where = _store(spark, folder)
    return sorted(n for s in store.listStatus(where) if (n := s.getPath().getName()).endswith(suffix)) if store.exists(where) else []


def fingerprint(**what) -> str:
    """SHA-256 of a canonical text of settings and input fingerprints."""
    return hashlib.sha256(json.dumps(what, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def table_fingerprint(df: DataFrame) -> str:
    """A fingerprint of a table's rows in any order: their number and the sums of two hashes of them, and its columns."""
    from pyspark.sql import functions as F

    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    text = F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)
    half = lambda i: F.sum(F.conv(F.substring(text, i, 15), 16, 10).cast("decimal(38,0)"))
    n, a, b = df.agg(F.count(F.lit(1)), half(1), half(16)).first()
    return fingerprint(columns=[list(x) for x in df.dtypes], rows=n, a=str(a), b=str(b))


# --- stages


def stage(spark: SparkSession, folder: str, name: str, settings: dict, inputs: dict[str, str], run: Callable[[], dict[str, DataFrame]]) -> tuple[dict[str, DataFrame], bool]:
    """The tables of a stage and whether they were reused: written once for each fingerprint of settings and inputs (name to fingerprint).

    An attempt writes to a folder of its own and counts when its receipt is claimed; one
    that was interrupted leaves no receipt and is made again. Of two attempts at the same
    time the first receipt counts, and both return its tables. A receipt whose tables are
    gone or have another number of rows doesn't count: the stage is made again beside it.
    """
    key = fingerprint(name=name, settings=settings, inputs=inputs)
    for n in range(1_000_000):
        path = f"{folder}/{name}/{key}.{n}.receipt"
        receipt = _read(spark, path)
        if receipt is None:
            break
        tables = _whole(spark, receipt)
        if tables is not None:
            return tables, True
    attempt = f"{folder}/{name}/attempt-{uuid.uuid4().hex}"
    written = {}
    for table, df in run().items():
        df.write.parquet(f"{attempt}/{table}")
        written[table] = {"path": f"{attempt}/{table}", "rows": spark.read.parquet(f"{attempt}/{table}").count(), "schema": df.schema.jsonValue()}
    own = {"stage": name, "fingerprint": key, "settings": settings, "inputs": inputs, "tables": written, "finished": time.time()}
    claim(spark, path, json.dumps(own))
    tables = _whole(spark, _read(spark, path))
    if tables is None:
        raise ValueError(f"the tables of stage {name} are incomplete right after they were written")
    return tables, False


def _whole(spark: SparkSession, receipt: dict) -> dict[str, DataFrame] | None:
    from pyspark.sql.types import StructType

    out = {}
    for table, facts in receipt["tables"].items():
        store, where = _store(spark, f"{facts['path']}/_SUCCESS")
        if not store.exists(where):
            return None
        out[table] = spark.read.schema(StructType.fromJson(facts["schema"])).parquet(facts["path"])
        if out[table].count() != facts["rows"]:
            return None
    return out


# --- references


def current(spark: SparkSession, folder: str, name: str) -> dict | None:
    """What a reference names now: ``version``, ``previous``, ``reason``, ``number`` of the move; None if it has never been set."""
    found = _names(spark, f"{folder}/{name}", ".json")
    return _read(spark, f"{folder}/{name}/{found[-1]}") if found else None


def move(spark: SparkSession, folder: str, name: str, expected: str | None, version: str, reason: str, accepted: bool = True) -> dict:
    """Move a reference from ``expected`` to ``version``; an error if it is elsewhere, also if another writer moves it at the same time.

    Each move is a file of the next number, and only one writer can create that one; all
    moves stay as history. ``accepted`` is the decision of a quality gate. Moving to
    where it is already changes nothing.
    """
    if not reason.strip():
        raise ValueError("a move needs a reason")
    if not accepted:
        raise ValueError(f"{version} was not accepted")
    now = current(spark, folder, name)
    at = now["version"] if now else None
    if at != expected:
        raise ValueError(f"{name} has moved: expected {expected}, found {at}")
    if at == version:
        return now
    number = (now["number"] if now else 0) + 1
    own = {"name": name, "version": version, "previous": at, "reason": reason, "number": number, "time": time.time()}
    if not claim(spark, f"{folder}/{name}/{number:09d}.json", json.dumps(own)):
        raise ValueError(f"{name} was moved by another writer")
    return own


def roll_back(spark: SparkSession, folder: str, name: str, expected: str, reason: str) -> dict:
    """Move a reference back to the version before the one it names."""
    now = current(spark, folder, name)
    if now is None or now["previous"] is None:
        raise ValueError(f"{name} has no earlier version")
    return move(spark, folder, name, expected, now["previous"], reason)


def history(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All moves of a reference in order."""
    files = [f"{folder}/{name}/{n}" for n in _names(spark, f"{folder}/{name}", ".json")]
    return spark.read.schema("number long, version string, previous string, reason string, time double").json(files).orderBy("number")
