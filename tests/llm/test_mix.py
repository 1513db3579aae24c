import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_ORACLE
from tools.oracle_check import canon
from veilscore.llm import mix as M
from veilscore.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, QUERIES, SQL, mix_levels

SCHEMA = "doc_id long, text string, lang string, source string, epoch string"


def same_as_sql(spark, df, con):
    got = M.mixed(df, mix_levels(), MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    cur = con.execute(SQL["op4_mix_sources"])
    assert canon(got.columns, [tuple(r) for r in got.collect()]) == canon(
        [c[0] for c in cur.description], cur.fetchall())
    return got


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_ORACLE}/documents.parquet')")
    got = QUERIES["op4_mix_sources"](spark, SF_ORACLE)
    cur = con.execute(SQL["op4_mix_sources"])
    assert canon(got.columns, [tuple(r) for r in got.collect()]) == canon(
        [c[0] for c in cur.description], cur.fetchall())


def rows():
    out = [(i, "w " * (i % 7), ["en", "de", None][i % 3], f"src{i % 5}", "e") for i in range(120)]
    out += [(7, "same id other text", "en", "src0", "e")] * 3 + [(None, "a b c", None, None, None)] * 2
    out += [(500, None, "en", "src1", "e"), (501, "", "fr", "nodigits", "e"), (502, " \n", "fr", "nodigits", "e"),
            (503, "long " * 30_000, "es", "src2", "e")]
    return out


def test_nulls_ties_and_repeats_match_sql(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([dict(zip(df.columns, r)) for r in rows()]))
    same_as_sql(spark, df, con)


def test_budgets_are_met_and_shortages_go_to_siblings_first(spark):
    leaves = [("a", "x", 100), ("a", "y", 10), ("b", "x", 100), ("b", "y", 100)]
    df = spark.createDataFrame(leaves, "top string, leaf string, tokens long")
    budget = {(r.top, r.leaf): r.budget
              for r in M.budgets(df, ["top", "leaf"], [{}, {}], 200, 1).collect()}
    # a: 100 of which y can use 10, its sibling x takes the other 90; b is untouched.
    assert budget == {("a", "x"): 90, ("a", "y"): 10, ("b", "x"): 50, ("b", "y"): 50}
    short = {(r.top, r.leaf): r.budget
             for r in M.budgets(df, ["top", "leaf"], [{"a": 3}, {}], 240, 1).collect()}
    # a could use 180 but has 110: the shortage of 70 goes to the other branch.
    assert short == {("a", "x"): 100, ("a", "y"): 10, ("b", "x"): 65, ("b", "y"): 65}
    odd = {(r.top, r.leaf): r.budget for r in M.budgets(df, ["top", "leaf"], [{}, {}], 101, 2).collect()}
    assert sum(odd.values()) == 101
    assert all(v == 0 for v in (r.budget for r in M.budgets(df, ["top", "leaf"], [{}, {}], 0, 2).collect()))


def test_tokens_taken_equal_the_budget(spark):
    df = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    got = M.mixed(df, mix_levels(), MIX_WEIGHTS, total=50_000, max_epochs=3, seed=1)
    assert got.agg(F.sum("taken")).first()[0] == 50_000
    assert got.filter("taken > tokens or taken < 0").count() == 0
    again = M.mixed(df.repartition(5), mix_levels(), MIX_WEIGHTS, total=50_000, max_epochs=3, seed=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    other = M.mixed(df, mix_levels(), MIX_WEIGHTS, total=50_000, max_epochs=3, seed=2)
    assert sorted(map(tuple, got.collect())) != sorted(map(tuple, other.collect()))


def test_documents_keep_their_columns(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    table = M.mixed(df, mix_levels(), MIX_WEIGHTS, seed=3)
    out = M.mixed_documents(df, mix_levels(), MIX_WEIGHTS, seed=3)
    assert out.columns == df.columns
    key = lambda r: repr((r.doc_id, r.tokens))
    assert sorted(map(key, out.withColumn("tokens", M.word_count("text")).collect())) == sorted(
        map(key, table.collect()))


@pytest.mark.parametrize("make", [M.mixed, M.mixed_documents])
def test_empty_table(spark, make):
    assert make(spark.createDataFrame([], SCHEMA), mix_levels(), MIX_WEIGHTS).count() == 0


@pytest.mark.parametrize("most", [1, 4])
def test_ends_are_found_digit_by_digit(spark, monkeypatch, most):
    """One leaf with all rows, few of which may be sorted: rounds go on, also to the
    last digit where many rows share one id."""
    monkeypatch.setattr(M, "SORTED_ROWS", most)
    many = [(i if i < 200 else 7, "w w w", "en", "src1", "e") for i in range(300)]
    df = spark.createDataFrame(many, SCHEMA)
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([dict(zip(df.columns, r)) for r in many]))
    same_as_sql(spark, df, con)
    levels = {"lang": F.col("lang")}
    got = M.mixed(df, levels, [{}], total=301, max_epochs=2, seed=3).agg(F.sum("taken")).first()[0]
    assert got == 301
