import duckdb
import pyarrow as pa

from tests.conftest import SF_ORACLE
from tools.oracle_check import canon
from veilscore.llm import quotes as Q
from veilscore.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
MAIL = [
    (1, 0, "u", "Hello there my friend.\nHow are you today?"),
    (1, 1, "a", "> How are you today?\n\nI am fine.\n> Hello there\nyes"),
    (1, 2, "u", ">> How are YOU today?\n> I am fine.\nGood to hear"),
    (1, 3, "a", "unrelated"), (1, 4, "u", "> unrelated\nso?"), (1, 5, "u", "> > How are you today\nlate"),
    (1, 6, "u", ">unrelated\r\n\r\n> good to hear !\r\nboth"), (2, 0, "u", None), (2, 1, "u", "> nothing"),
    (None, 1, "u", "> q"), (2, None, "u", "z"), (2, 1, "u", "> nothing"), (2, 2, "u", "> nothing\nok"),
    (3, 0, "u", ""), (3, 1, "u", " > > >\n>"), (4, 9, "u", "> same\nown"), (4, 1, "u", "same"), (4, 2, "u", "same"),
]


def both(spark, rows):
    got = Q.linked(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    con = duckdb.connect()
    con.register("conversations", pa.table({
        "conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()),
        "role": pa.array([r[2] for r in rows], pa.string()), "text": pa.array([r[3] for r in rows], pa.string())}))
    cur = con.execute(SQL["op8_quotation_threads"])
    return (canon(got.columns, [tuple(r) for r in got.collect()]),
            canon([c[0] for c in cur.description], cur.fetchall()))


def test_linking_matches_sql(spark):
    a, b = both(spark, MAIL)
    assert a == b


def test_parents_and_order(spark):
    got = {(r.conv_id, r.turn): r for r in Q.linked(spark.createDataFrame([(*r, "x") for r in MAIL], SCHEMA)).collect()}
    assert [got[1, t].parent_turn for t in range(7)] == [None, 0, 1, None, 3, 0, 2]
    assert got[1, 2].text == "Good to hear" and got[1, 1].text == "I am fine.\nyes"
    assert got[1, 6].depth == 3 and got[1, 6].root_turn == 0
    assert got[4, 9].parent_turn == 1                      # first of two equal sources
    order = sorted((r for r in got.values() if r.conv_id == 1), key=lambda r: r.position)
    seen = set()
    for r in order:
        assert r.parent_turn is None or r.parent_turn in seen
        seen.add(r.turn)
    assert all(not x.startswith(">") for r in got.values() for x in (r.text or "").split("\n"))


def test_long_chain_in_one_conversation(spark):
    rows = [(7, 0, "u", "message number zero")]
    rows += [(7, i, "u", f"> message number {'zero' if i == 1 else i - 1}\nmessage number {i}") for i in range(1, 90)]
    got = {r.turn: r for r in Q.linked(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert all(got[i].depth == i and got[i].root_turn == 0 and got[i].position == i for i in range(90))


def test_query_matches_sql_and_empty(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF_ORACLE}/conversations.parquet')")
    got = QUERIES["op8_quotation_threads"](spark, SF_ORACLE)
    cur = con.execute(SQL["op8_quotation_threads"])
    assert canon(got.columns, [tuple(r) for r in got.collect()]) == canon(
        [c[0] for c in cur.description], cur.fetchall())
    assert Q.linked(spark.createDataFrame([], SCHEMA)).count() == 0
