"""Every query against its oracle on the smallest tables, and the entry point without the training-data subpackage."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from prismgrid import plans

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v.item() if hasattr(v, "item") and not isinstance(v, float) else v


def table_of(df):
    columns = sorted(df.columns)
    return columns, sorted(repr([plain(plain(v)) for v in r]) for r in df[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{small_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, small_dir, name):
    assert table_of(QUERIES[name](spark, small_dir).toPandas()) == table_of(duck.sql(ORACLES[name]).df())


def test_entry_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/prismgrid", tmp_path / "prismgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) + 1; assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, check=True)


def test_other_queries_run(spark, small_dir):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, small_dir).count() > 0
