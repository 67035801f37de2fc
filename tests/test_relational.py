import subprocess
import sys

import duckdb
import pytest

from quarry.plans import ORACLES, QUERIES
from quarry.sources import TABLES, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted(map(str, (tuple(r) for r in got.select(cols).collect())))
    b = sorted(map(str, want.select(*cols).fetchall()))
    assert a == b


def test_unknown_table(spark):
    with pytest.raises(ValueError):
        table(spark, SF, "nope")


def test_entry_imports():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("lost", ["zstandard", "tiktoken", "quarry.llm"])
def test_entry_without_a_library(lost):
    """What can't be imported costs the training-data queries only, and says so."""
    code = f"""
import sys, warnings
sys.modules[{lost!r}] = None
warnings.simplefilter("always")
import __spark_entry__ as e
from quarry.plans import QUERIES
assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
print(len(e.queries()))
"""
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    assert int(ran.stdout) == len(QUERIES) or lost == "tiktoken"  # which is imported by tasks only
    assert "NOT registered" in ran.stderr or lost == "tiktoken"
