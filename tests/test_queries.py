import glob
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from playframe.plans import bindings, fields, quality, scenes, tracking  # noqa: F401  each registers its queries

SF = "/root/testdata/sf0.001"


def canonical(df):
    def value(x):
        if not isinstance(x, (list, dict)) and pd.isna(x):
            return None
        return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(value, r)) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(bindings.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert canonical(bindings.QUERIES[name](spark, SF).toPandas()) == canonical(duck.sql(bindings.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_is_read_without_a_session():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"
    assert subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, timeout=120).stdout.strip() == "True"
