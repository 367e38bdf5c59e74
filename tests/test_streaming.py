import datetime

from pyspark.sql import functions as F

from playframe.operators import distance as dist
from playframe.streaming import sessions

SCHEMA = "k long, ts timestamp, x double, y double"


def written(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(seconds=s), float(s % 7 + k), 0.0) for k in (1, 2) for s in (0, 1, 2, 5, 6, 20, 21) if not (k == 2 and s == 6)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("t", F.unix_micros("ts") / 1e6)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in"))


def drained(query_df, name, mode):
    query = query_df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query_df.sparkSession.table(name)


def test_stream_distance_equals_batch(spark, tmp_path):
    batch = written(spark, tmp_path)
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = drained(sessions.distance_increments(stream, "k", "t", "x", "y", 2.0, 3.0), "increments", "append")
    want = dist.distance_pairs(batch, ["k"], "t", ("x", "y"), 2.0, 3.0)
    pick = lambda df: sorted(map(tuple, df.select("k", "t", "distance", "reason").collect()), key=str)
    assert pick(got) == pick(want)


def test_sessions(spark, tmp_path):
    batch = written(spark, tmp_path)
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = drained(sessions.sessions(stream, "k", "ts", "2 seconds", "1 second"), "found_sessions", "complete")
    assert sorted((r.k, r.n) for r in got.collect()) == [(1, 2), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]


def test_late_rows_are_kept_apart(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    for n, seconds in enumerate(((0, 60), (5, 55, 61, None))):
        rows = [(1, None if x is None else start + datetime.timedelta(seconds=x), 0.0, 0.0) for x in seconds]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        put = lambda to: lambda df, i: df.write.mode("append").parquet(str(tmp_path / to))
        each = sessions.split_late("ts", 10.0, str(tmp_path / "marks"), put("fine"), put("late"))
        query = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    of = lambda name: sorted((r.ts - start).seconds if r.ts else -1 for r in spark.read.parquet(str(tmp_path / name)).collect())
    assert of("fine") == [0, 55, 60, 61] and of("late") == [-1, 5]
