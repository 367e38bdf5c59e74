"""Stages made once, references that move by compare-and-swap, and frames read by their bytes."""

import json
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from playframe.sources import indexed, ledger


def test_a_stage_is_made_once_for_what_goes_in(spark, tmp_path):
    made = []

    def run():
        made.append(1)
        return {"numbers": spark.range(5), "names": spark.createDataFrame([("a", None)], "x string, y int")}

    do = lambda settings, inputs: ledger.stage(spark, str(tmp_path), "count", settings, inputs, run)
    tables, reused = do({"n": 5}, {"in": "f1"})
    assert not reused and tables["numbers"].count() == 5 and tables["names"].schema.simpleString() == "struct<x:string,y:int>"
    assert do({"n": 5}, {"in": "f1"})[1] and len(made) == 1
    assert not do({"n": 5}, {"in": "f2"})[1] and not do({"n": 6}, {"in": "f1"})[1] and len(made) == 3


def test_an_interrupted_stage_is_made_again_and_a_lost_table_too(spark, tmp_path):
    def broken():
        spark.range(3).write.parquet(str(tmp_path / "s" / "attempt-x" / "t"))
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        ledger.stage(spark, str(tmp_path), "s", {}, {}, broken)
    whole = lambda: {"t": spark.range(4)}
    tables, reused = ledger.stage(spark, str(tmp_path), "s", {}, {}, whole)
    assert not reused and tables["t"].count() == 4
    (receipt,) = (tmp_path / "s").glob("*.receipt")
    for f in (tmp_path / "s").rglob("_SUCCESS"):
        if json.loads(receipt.read_text())["tables"]["t"]["path"] in str(f):
            f.unlink()
    tables, reused = ledger.stage(spark, str(tmp_path), "s", {}, {}, whole)
    assert not reused and tables["t"].count() == 4 and ledger.stage(spark, str(tmp_path), "s", {}, {}, whole)[1]


def test_table_fingerprints_do_not_depend_on_order(spark):
    rows = spark.range(100).withColumn("x", F.when(F.col("id") % 3 > 0, F.col("id") * 2))
    same = ledger.table_fingerprint(rows.repartition(7).orderBy(F.desc("id")))
    assert ledger.table_fingerprint(rows) == same
    assert ledger.table_fingerprint(rows.where("id <> 5")) != same and ledger.table_fingerprint(rows.withColumnRenamed("x", "y")) != same
    assert ledger.table_fingerprint(rows.withColumn("x", F.when(F.col("id") != 7, F.col("x")))) != same


def test_references_move_only_from_where_they_are(spark, tmp_path):
    folder = str(tmp_path)
    assert ledger.current(spark, folder, "champion") is None
    ledger.move(spark, folder, "champion", None, "1", "first")
    assert ledger.move(spark, folder, "champion", "1", "2", "better")["previous"] == "1"
    with pytest.raises(ValueError, match="expected 1, found 2"):
        ledger.move(spark, folder, "champion", "1", "3", "late")
    with pytest.raises(ValueError, match="not accepted"):
        ledger.move(spark, folder, "champion", "2", "3", "worse", accepted=False)
    assert ledger.roll_back(spark, folder, "champion", "2", "it failed")["version"] == "1"
    assert [(r.number, r.version, r.previous) for r in ledger.history(spark, folder, "champion").collect()] == [(1, "1", None), (2, "2", "1"), (3, "1", "2")]


def test_of_racing_writers_one_moves_the_reference(spark, tmp_path):
    folder = str(tmp_path)
    ledger.move(spark, folder, "champion", None, "0", "start")
    won, lost, gate = [], [], threading.Barrier(8)
    original = ledger.claim

    def together(*a):
        gate.wait()
        return original(*a)

    def race(i):
        try:
            won.append(ledger.move(spark, folder, "champion", "0", str(i), "race")["version"])
        except ValueError:
            lost.append(i)

    ledger.claim = together
    try:
        threads = [threading.Thread(target=race, args=(i,)) for i in range(1, 9)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    finally:
        ledger.claim = original
    assert len(won) == 1 and len(lost) == 7 and ledger.current(spark, folder, "champion")["version"] == won[0]


def test_a_page_of_frames_opens_its_bytes_only(spark, tmp_path, monkeypatch):
    path, index = tmp_path / "frames.jsonl", str(tmp_path / "index")
    lines = [json.dumps({"frame_index": i, "note": "é" * (i % 50), "persons": list(range(i % 20))}, ensure_ascii=False) for i in range(20_000)]
    path.write_text("\n".join(lines) + "\n")
    ends, at = [], 0
    for line in lines:
        at += len(line.encode()) + 1
        ends.append(at)
    monkeypatch.setattr(indexed, "PART_BYTES", 1 << 17)
    indexed.write_index(spark, str(path), index)
    every = spark.read.parquet(index).orderBy("frame_index").collect()
    assert [(r.first_byte, r.end_byte) for r in every] == list(zip([0, *ends], ends, strict=False))
    got = indexed.read_frames(spark, str(path), index, "frame_index long, note string, persons array<long>", 7000, 7059)
    rows = got.orderBy("frame_index").collect()
    assert [r.frame_index for r in rows] == list(range(7000, 7060)) and all(r.record.frame_index == r.frame_index and len(r.record.persons) == r.frame_index % 20 for r in rows)
    reader = indexed._Reader({"path": str(path), "index": index}, StructType())
    left = list(reader.pushFilters([indexed.GreaterThanOrEqual(("frame_index",), 7000), indexed.LessThanOrEqual(("frame_index",), 7059), indexed.EqualTo(("line",), "x")]))
    assert [f.attribute for f in left] == [("line",)]
    parts = reader.partitions()
    assert sum(p.high - p.low for p in parts) == ends[7059] - ends[6999] and sum(len(p.lines) for p in parts) == 60
    assert "7000" not in got._jdf.queryExecution().optimizedPlan().toString()  # the range is the source's work, no filter is left
    assert indexed.read_frames(spark, str(path), index, "frame_index long", 50_000, 50_010).count() == 0
