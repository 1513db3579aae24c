import itertools
import random
import zlib
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from veilscore.llm import variants
from veilscore.llm.term_queries import _misspelt


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def brute(counts, ratio=10):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n, len(near[w]), counts[form[w]] if form[w] else -1) for w, n in counts.items())


def got(words, **more):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"])
                  for r in variants.variants(words, **more).collect())


@contextmanager
def cut_small(spark, batch):
    """Many partitions and tiny batches, so that words meet their neighbours across borders."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false",
             "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_matches_brute_force(spark, batch):
    r = random.Random(batch)
    counts = {"".join(r.choices("aab", k=r.randint(1, 7))): r.choice([1, 2, 9, 30, 400]) for _ in range(400)}
    counts |= {"".join(r.choices("xyzé\U0001F600", k=r.randint(5, 9))): r.randint(1, 50) for _ in range(150)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    with cut_small(spark, batch):
        assert got(words) == brute(counts)
        assert got(words, ratio=2) == brute(counts, 2)


def test_every_word_of_a_small_language(spark):
    """Pairs with as many words as the alphabet allows; equal n everywhere."""
    counts = {"".join(w): 5 for k in range(1, 5) for w in itertools.product("abcd", repeat=k)}
    assert got(spark.createDataFrame(list(counts.items()), "word string, n long")) == brute(counts)


def test_edge_cases(spark):
    long = "a" * 30_000
    counts = {long: 40, long[:-1]: 4, long[:15_000] + "b" + long[15_001:]: 3, "z": 2}
    words = spark.createDataFrame([*counts.items(), (None, 7), ("", 9)], "word string, n long")
    assert got(words) == brute(counts)
    assert got(words.limit(0)) == []
    more = words.select("word", "n", F.lit(1).alias("id"), F.lit(2).alias("key"), F.lit(3).alias("part"))
    assert got(more) == brute(counts)
    with pytest.raises(ValueError):
        variants.variants(words, ratio=1)


def test_runs_and_misspellings(spark):
    texts = [(1, "Straßenbahn, straßenbahn ÄHNLICH7 short ×÷ÿÿÿÿÿ"), (1, "Straßenbahn, straßenbahn"), (None, "Something something"),
             (2, None), (3, ""), (4, "b" * 50_000), (5, " ".join(f"{a}letters{b}" for a in "abcdefgh" for b in "klmnopqr"))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = {}
    for i, text in texts:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        runs = "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in lower).split(" ")
        for w in runs:
            if w:
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                w = w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w
                want[w] = want.get(w, 0) + 1
    made = variants.word_counts(variants.letter_runs(docs), _misspelt(), min_count=1)
    assert {r["word"]: r["n"] for r in made.collect()} == {w: n for w, n in want.items() if len(w) >= 7}
    assert variants.word_counts(variants.letter_runs(docs.limit(0)), _misspelt()).count() == 0
