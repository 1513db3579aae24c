from tests.conftest import SF_ORACLE
from veilscore.llm import shard as S
from veilscore.llm.queries import QUERIES


def test_rounds_are_planned_once(spark):
    """A place is computed once a row: its rounds and its walk, not a copy for every use of a half."""
    rows = QUERIES["op2_feistel_sharding"](spark, SF_ORACLE)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") <= 12 and plan.count("sequence(") <= 1


def test_short_walks(spark):
    """Tables of which many places lie beyond the last row: every walk ends inside."""
    for n in (3, 7, 13, 31):
        rows = S.sharded(spark.range(n).selectExpr("id", "cast(null as string) as text"), 4, seed=9).collect()
        assert sorted(r.slot * 4 + r.shard for r in rows) == list(range(n))
