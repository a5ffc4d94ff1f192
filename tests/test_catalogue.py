"""Every registered query of the library over the smallest tables, against its SQL in DuckDB."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from spindrift.catalogue import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain(df):
    def text(x):
        return "null" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(text, row)) for row in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    db = duckdb.connect()
    for file in os.listdir(SF_DIR):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    assert plain(got) == plain(db.execute(ORACLES[name]).df())


def test_doubles_print_as_in_python(spark):
    rows = QUERIES["prompt_doubles"](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/events.parquet"), "event_id").collect()
    assert all(r.printed == str(r.value) for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_entry_without_extras(tmp_path):
    """A copy of the repository without the optional folders has all other queries, their SQL and the flagship query."""
    copy = tmp_path / "copy"
    shutil.copytree(Path(__file__).resolve().parent.parent, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
from spindrift.catalogue import ORACLES, QUERIES
assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLES)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
