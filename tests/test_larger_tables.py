"""Queries on tables that the small ones don't stand for: keys beyond a million, near ties, and blocks of long keys."""

import duckdb
import pytest

from playframe.plans import bindings, fields, quality, scenes, tracking  # noqa: F401  each registers its queries
from tests.test_queries import canonical

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
LINES = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string"


@pytest.fixture
def held(spark, tmp_path):
    """Holds a query against its SQL on given rows of one table."""

    def check(query, table, rows, schema):
        path = str(tmp_path / f"{table}.parquet")
        spark.createDataFrame(rows, schema).write.parquet(path)
        con = duckdb.connect()
        con.sql(f"create view {table} as select * from '{path}/*.parquet'")
        got = canonical(bindings.QUERIES[query](spark, str(tmp_path)).toPandas())
        assert got == canonical(con.sql(bindings.ORACLE_SQL[query]).df())
        return got[1]

    return check


def line(key, number, quantity, price=1.0, discount=0.0, flag="A"):
    return key, number, float(quantity), float(price), discount, flag, "O"


def test_equal_means_of_maps_take_the_first_cell(held):
    # 0.07 * 50 is 3.5000000000000004, which beats the mean 3.5 of the first cells only in its last digit.
    rows = held("q_averaged_maps", "lineitem", [line(3, 1, 3, discount=0.07), line(4, 1, 4, discount=0.07)], LINES)
    assert rows == [(0.0, 1.0, 3.5, 2.0)]


def test_extra_records_beyond_a_million_keys(held):
    # 93 is missing, and 93 + 1000000 is a key of the table that is missing too while the export adds it.
    rows = held("q_export_differences", "orders", [(5, 86, "O", 1.0), (1000005, 93, "O", 1.0), (7, 1, "O", 1.0)], ORDERS)
    assert rows == [(1000005.0, "extra"), (1000005.0, "missing")]


def test_spaced_rows_in_order_of_frames_with_rows_that_always_stay(spark):
    from pyspark.sql import functions as F

    from playframe.operators import sequence

    rows = [(k, f, float(t), f < 2) for k in (1, 2) for f, t in enumerate((0, 1, 2, 4, 5, 9))]
    df = sequence.dealt(spark.createDataFrame(rows, "k long, f long, t double, first boolean"), ["k"], 3)
    assert df.rdd.getNumPartitions() >= 3
    kept = sequence.spaced(df, ["k"], "t", 3.0, "f", F.col("first"))
    # 0 and 1 stay in any case; 4 is three after 1, 9 four after 5.
    assert sorted((r.k, r.f) for r in kept.collect()) == [(k, f) for k in (1, 2) for f in (0, 1, 3, 5)]
    assert "FlatMapGroupsInPandas" not in kept._jdf.queryExecution().toString()


def test_rallies_go_on_from_block_to_block(held):
    # 57 is the only gap; frames are cut at 65,536 and again behind 131,072, where a missing frame ends the rally.
    keys = [*range(50, 57), *range(58, 60), *range(65530, 65545), *range(131060, 131072), 131073, 196608]
    held("q_rallies", "orders", [(k, k, "O", float(k)) for k in keys], ORDERS)


def test_triplets_across_blocks(held):
    rows = held("q_triplets", "orders", [(k, k, "O", float(k)) for k in [*range(65530, 65545), *range(131065, 131079)]], ORDERS)
    assert (65536.0, 65534.0, 65535.0, 65536.0, 65536.0) in rows


@pytest.mark.parametrize(("query", "table"), [("q_rallies", "orders"), ("q_triplets", "orders"), ("q_average_precision", "lineitem"), ("q_coco_annotations", "lineitem")])
def test_no_window_gets_all_rows_of_a_key(spark, tmp_path, query, table):
    """Windows are over blocks of rows, or in order of blocks (one row each) or of recall points."""
    rows = [(k, k, "O", float(k)) for k in range(150)] if table == "orders" else [line(5 * k, 1, k % 50, price=k * 7 % 1009) for k in range(300)]
    spark.createDataFrame(rows, ORDERS if table == "orders" else LINES).write.parquet(str(tmp_path / f"{table}.parquet"))
    plan = bindings.QUERIES[query](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    windows = [w for w in plan.splitlines() if w.lstrip("+- :").startswith("Window ")]
    assert windows
    assert all(any(name in w for name in ("_block", "_part", "_point")) for w in windows), windows


def test_segments_count_over_the_whole_table(held):
    # Frames 170 and 420 of run 0, 1170 of run 1 and, beyond the first block of frames, 65670 of run 65 are cuts.
    rows = held("q_segments", "orders", [(8 * f, 1, "O", 1.0) for f in (0, 170, 171, 420, 1000, 1170, 65530, 65540, 65670)], ORDERS)
    assert [r[-1] for r in sorted(rows)] == [0.0, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0, 3.0, 4.0]


def test_pieces_of_a_mask_are_sorted_once(spark):
    """Within lambdas an expression is computed for each element: the sorted pieces may stand in the plan only once."""
    from pyspark.sql import functions as F

    from playframe.functions import geometry as geo

    rows = spark.range(1).select(*[F.array(*[F.lit(v).cast("long") for v in a]).alias(n) for n, a in (("roi", (0, 0, 5, 4)), ("counts", (3, 9, 8)), ("inner", (2, 1, 5, 3)))])
    got = rows.select(geo.mask_crop(F.col("roi"), F.col("counts"), F.col("inner")).alias("runs"))
    assert got._jdf.queryExecution().analyzed().toString().count("array_sort(") == 1
    assert got.first().runs == [0, 3, 3]
