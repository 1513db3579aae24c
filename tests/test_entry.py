import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.oracle_check import canon
from veilscore.plans.oracle import SQL
from veilscore.plans.registry import QUERIES
from veilscore.sources.tables import TABLES

# Queries whose result legitimately has no SQL oracle (fitted models, timings).
ROWS_ONLY = {"lr_embeddings", "rf_embeddings", "gbt_embeddings", "search_results", "randomized_search",
             "train_run", "validation_report"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["vec_id", "score"] and df.count() > 0


def test_every_query_has_oracle_or_is_rows_only():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) - set(SQL) == ROWS_ONLY and set(SQL) <= set(QUERIES)


def test_library_works_without_the_corpus_subpackage():
    """Neither the entry nor any other module needs `veilscore.llm` or `corpus_pipeline`."""
    code = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "veilscore.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as E
from veilscore.plans.registry import QUERIES
assert set(E.queries()) == set(QUERIES) and E.oracle_sql()
print("STANDS-ALONE")
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=root)
    assert "STANDS-ALONE" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only_query_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.columns and df.count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, rows) == canon(ocols, cur.fetchall())
