"""Runs on disk: manifests, documents, inventories with hashes, CSV, and publication by generation."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run_id string, status string, frames long, segments int, source struct<path: string, sha256: string, nominal_fps: double, width: int, height: int>, artifacts map<string, struct<sha256: string>>, capabilities map<string, string>"
MAX_DOCUMENT = 1 << 20


def runs(spark: SparkSession, folder: str, status: str = "completed") -> DataFrame:
    """The runs below a folder by their ``run.json``, of one status, in the order of their names."""
    found = spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "run.json").json(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)/run\.json$", 1)
    return found.withColumn("name", name).where(F.col("status") == status).orderBy("name")


def document(text: str, most: int = MAX_DOCUMENT) -> dict:
    """A small control document: repeated keys, numbers that aren't finite and oversized texts are errors."""
    if len(text.encode()) > most:
        raise ValueError("the document is too large")

    def once(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key is repeated")
        return dict(pairs)

    def number(text: str) -> float:
        if not math.isfinite(value := float(text)):
            raise ValueError("a number isn't finite")
        return value

    return json.loads(text, object_pairs_hook=once, parse_constant=number, parse_float=number)


def roster(spark: SparkSession, payload: dict) -> DataFrame:
    """The roster document as rows: ``team, team_name, number, name, eligible``, texts trimmed."""
    rows = [(t["team_id"].strip(), t["name"].strip(), p["number"].strip(), p["name"].strip(), p.get("eligible", True)) for t in payload["teams"] for p in t["players"]]
    return spark.createDataFrame(rows, "team string, team_name string, number string, name string, eligible boolean")


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files below a folder: ``path`` relative to it, ``bytes`` and ``sha256``; each file is hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    base = folder.rstrip("/").split("://", 1)[-1]
    path = F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", "")
    return files.select(F.substr(path, F.instr(path, base) + len(base) + 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def artifact_mismatches(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Artifacts of a manifest whose file is missing or has another hash."""
    wanted = manifest.select(F.explode("artifacts").alias("path", "_a")).select("path", F.col("_a.sha256").alias("expected"))
    return wanted.join(found.select("path", "sha256"), "path", "left").where(~F.col("expected").eqNullSafe(F.col("sha256")))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and a declared schema; a row that doesn't fit fails the read."""
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def publish(tables: dict[str, DataFrame], folder: str) -> str:
    """Write several tables as one generation and point to it last: readers see all of the old or all of the new.

    Each generation has a folder of its own, and ``current`` names one. The pointer is
    replaced by a rename where the file system has atomic ones; without, a reader may
    for a moment find none, never a mixture.
    """
    spark = next(iter(tables.values())).sparkSession
    name = f"generation-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{name}/{table}")
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    store = path(folder).getFileSystem(conf)
    new = path(f"{folder}/{name}.pointer")
    out = store.create(new, False)
    out.write(bytearray(name.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(new), context.makeQualified(path(f"{folder}/current")), options)
    return name


def published(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the generation that ``current`` names."""
    name = spark.read.text(f"{folder}/current").first()[0]
    return spark.read.parquet(f"{folder}/{name}/{table}")


def in_batches(df: DataFrame, rows: int, f, schema: str) -> DataFrame:
    """Apply ``f`` to pandas frames of at most ``rows`` rows, in tasks; what a batched scan of a file does."""

    def task(parts):
        for part in parts:
            for lo in range(0, len(part), rows):
                yield f(part.iloc[lo : lo + rows])

    return df.mapInPandas(task, schema)


def moved_reference(references: DataFrame, name: str, expected: str | None, new: str) -> DataFrame:
    """References (``name``, ``version``, ``previous``) with one moved to ``new``; an error if it isn't at ``expected`` now."""
    now = references.where(F.col("name") == name).select("version").collect()
    if (now[0][0] if now else None) != expected:
        raise ValueError(f"{name} has moved: expected {expected}")
    moved = references.sparkSession.createDataFrame([(name, new, expected)], "name string, version string, previous string")
    return references.where(F.col("name") != name).unionByName(moved)
