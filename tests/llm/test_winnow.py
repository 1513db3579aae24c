import hashlib
import random
import re

import duckdb

from tests.conftest import SF_ORACLE
from tools.oracle_check import canon
from veilscore.llm import winnow as W
from veilscore.llm.queries import QUERIES, SQL

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    spans = []
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        spans += [(i, w[k:k + n]) for k in range(len(w) - n + 1)] if n else []
    out = []
    for d, t in docs:
        w, hit, seen = words(t), set(), set()
        for i, s in spans:
            for k in range(len(w) - len(s) + 1):
                if w[k:k + len(s)] == s:
                    hit |= set(range(k, k + len(s)))
                    if i is not None:
                        seen.add(str(i))
        out.append((d, len(w), len(hit), sorted(seen)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row int, hits string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in W.contamination(d, b).collect()), key=repr)


def test_random_texts_with_few_words(spark):
    rng = random.Random(7)
    text = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(i, text(rng.randint(0, 25), 4)) for i in range(12)] + [(99, "é à"), (None, "q r"), (1, None)]
    docs = [(i, text(rng.randint(0, 200), 5)) for i in range(25)]
    docs += [(50, None), (51, ""), (52, "É, À é... à"), (53, "é à"), (53, "q r"), (53, "q r"), (None, "é à"),
             (54, "z" * 5000 + " q-R")]
    assert run(spark, docs, items) == brute(docs, items)


def test_long_text_and_hot_passage(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(500)]
    item = " ".join(rng.choice(vocab) for _ in range(40))
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(50)) + " " + item) for i in range(60)]
    docs.append((100, " ".join(rng.choice(vocab) for _ in range(60_000)) + " " + " ".join(item.split()[7:20])))
    items = [(1, item), (2, item), (3, " ".join(item.split()[:9]))]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [])]


def test_stage_drops_only_hit_rows(spark):
    docs = [(1, "clean text here"), (1, "the secret answer"), (2, None), (3, "xx the SECRET, answer yy")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame([(7, "the secret answer")], "item_id long, text string")
    left = W.decontaminated(d, b)
    assert left.columns == d.columns
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [(1, "clean text here"), (2, "")]


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    got = QUERIES["op6_winnow_decontamination"](spark, SF_ORACLE)
    cur = con.execute(SQL["op6_winnow_decontamination"])
    assert canon(got.columns, [tuple(r) for r in got.collect()]) == canon(
        [c[0] for c in cur.description], cur.fetchall())
    assert got.filter("contaminated").count() > 0
    assert got.filter("n_items = 0").first().items_sha256 == hashlib.sha256(b"").hexdigest()


def test_shared_passage_of_many_items_and_documents(spark):
    n = 400
    passage = "the terms of use apply to every page shown here"
    items = [(i, f"item{i} before{i} {passage} after{i} end{i}") for i in range(n)]
    docs = [(i, f"doc{i} " + passage + f" tail{i}") for i in range(n)] + [(n, f"x before7 {passage} after7 y")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows, hits, classes = W._found(d, b, "doc_id", "text", "item_id", "text")
    assert hits.count() <= 8 * n and classes.count() <= n + 1
    everyone = sorted(str(i) for i in range(n))
    got = {r.doc_id: r for r in W.contamination(d, b).collect()}
    assert all(list(r["items"]) == everyone for r in got.values())
    assert [got[0].n_hit, got[n].n_hit] == [10, 12]


def test_clashing_names(spark):
    names = ["row", "window", "met", "class", "items", "digest", "hits", "a.b"]
    d = spark.createDataFrame([(1, "the secret answer", *names), (2, "clean", *names)],
                              "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    b = spark.createDataFrame([(7, "the secret answer", "x")], "item_id long, text string, window string")
    assert sorted((r.doc_id, r.n_hit) for r in W.contamination(d, b).collect()) == [(1, 3), (2, 0)]
    left = W.decontaminated(d, b)
    assert left.columns == d.columns and [tuple(r) for r in left.collect()] == [(2, "clean", *names)]
