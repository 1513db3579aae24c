import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from veilscore.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    total = sum(1 for _, b in bags if b)
    length = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            if bag:
                m = 100 - 25 + 25 * sum(bag.values()) * total // length
                s = sum(w[t] * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
                if s > 0:
                    scores.append((-s, i is None, i, s))
        scores.sort(key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))
        out += [(item, rank, x[2], x[3]) for rank, x in enumerate(scores[:top], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, kind="long", **more):
    d = spark.createDataFrame(docs, f"doc_id {kind}, text string")
    q = spark.createDataFrame(items, "item_id string, text string")
    return sorted((tuple(r) for r in search.ranked(d, q, **more).collect()), key=repr)


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(r.choices(words, weights, k=r.choice([1, 3, 10, 40, 200])))) for i in range(n)]


def test_matches_brute_force(spark, monkeypatch):
    """Small leaves and trees, so that bounds, cuts and merges all take part."""
    monkeypatch.setattr(search, "LEAF", 3)
    monkeypatch.setattr(search, "TREE_CELLS", 4000)
    docs = corpus(700, 1) + [(1000 + i, "w3 w9 w9 rare") for i in range(50)]       # a group of copies: ties
    items = [(f"i{k}", text) for k, (_, text) in enumerate(corpus(25, 2))] + [("ties", "w9 rare rare"), ("none", "zzz")]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs, items, top=3, block_bytes=300) == brute(docs, items, 3)


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "..,"), (None, "alpha beta"), (4, "ALPHA beta"), (4, "alpha beta"),
            (5, "é" * 70_000 + " alpha " + "x " * 300_000), (6, "gamma É"), (7, "alpha-beta Ünï 12")]
    items = [("a", "Alpha alpha"), ("a", "beta"), (None, "gamma"), ("b", None), ("c", ""), ("long", "é" * 70_000), ("d", "12 ünï")]
    want = brute(docs, items)
    assert got(spark, docs, items) == want and len({x[0] for x in want}) >= 4
    assert got(spark, docs, items[:0]) == [] and got(spark, docs[:0], items) == []
    as_text = [(None if i is None else f"k{i}", t) for i, t in docs]
    assert len(got(spark, as_text, items, "string")) == len(want)


def test_extra_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "alpha", 5, 6, 7)], "doc_id int, text string, `a.b` int, rank int, item int")
    items = spark.createDataFrame([(9, "alpha", 1)], "item_id int, text string, score int")
    docs = docs.unionByName(docs.selectExpr("2 AS doc_id", "'beta' AS text", "`a.b`", "rank", "item"))
    rows = search.ranked(docs, items).collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in rows] == [(9, 1, 1)]


@pytest.mark.parametrize("shape", ["random", "chain", "equal"])
def test_tree_bounds_hold_and_nodes_stay_few(shape):
    r = np.random.default_rng(3)
    n, n_terms = 4000, 50
    if shape == "random":
        rows = sorted(tuple(sorted(r.choice(n_terms, r.integers(1, 12), replace=False))) for _ in range(n))
    elif shape == "chain":
        rows = sorted(tuple(range(k)) for k in range(1, 50) for _ in range(80))[:n]
    else:
        rows = [(1, 2, 3)] * n
    first = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    term, tf, m = np.concatenate(rows), r.integers(1, 9, first[-1]), r.integers(75, 400, len(rows))
    tree = search.Tree(term, tf, first, m, n_terms)
    assert len(tree.low) <= 9 * 2 * len(rows) // search.LEAF + 1
    for node, (lo, hi) in enumerate(zip(tree.low, tree.high)):
        for t in range(0, n_terms, 7):
            cells = slice(first[lo], first[hi])
            mine = tree.gain[cells][term[cells] == t]
            assert tree.bound[node, t] >= mine.max(initial=0)
        kids = tree.children[node]
        assert not kids or (tree.low[kids[0]], tree.high[kids[-1]]) == (lo, hi)


def test_words_of_equal_hash_are_told_apart():
    vocab = search.vocabulary([b"alpha", b"beta"])
    data = np.frombuffer(b"alphaalphabeta", np.uint8)
    starts, ends = np.array([0, 5, 10]), np.array([5, 10, 14])
    assert vocab.find(data, starts, ends).tolist()[0] >= 0
    vocab.data = np.frombuffer(vocab.data.tobytes().replace(b"alpha", b"alphx"), np.uint8)   # same hash, other bytes
    assert vocab.find(data, starts, ends).tolist()[:2] == [-1, -1]
