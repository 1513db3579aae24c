"""Secret sharing (E1–E3) and linear tags."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilscore.operators import seal as E
from veilscore.operators import shares as H
from veilscore.operators import tags as G
from veilscore.sources.model import LinearModel

MODEL = LinearModel((3, -7, 0, 75, 1, -1), -2)


def table(spark, n=200, seed=1):
    r = random.Random(seed)
    rows = [(i, [r.randint(-1000, 1000) for _ in range(6)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x array<long>")


def plain(x):
    return sum(a * b for a, b in zip(x, MODEL.weights)) + MODEL.bias


def test_shares_add_up_without_key_or_weights(spark):
    rows, df = table(spark)
    first, second = H.split_shares(df, E.new_keyring(spark, ["a", "b"]), "id", model=MODEL)
    a, b = H.score_share(first, MODEL, "id", True), H.score_share(second, MODEL, "id", False)
    got = {r["id"]: (r["score"], r["copies"]) for r in H.open_shares(a, b, "id").collect()}
    assert got == {i: (plain(x), 1) for i, x in rows}


def test_one_share_alone_is_uniform(spark):
    """Equal rows of many ids: each table's low digit and high digit are spread evenly."""
    df = spark.range(3000).select("id", F.array(*[F.lit(5).cast("long")] * 6).alias("x"))
    for share in H.split_shares(df, E.new_keyring(spark), "id", width=6):
        cells = [c for r in share.collect() for c in r["c"]]
        for digit in (Counter(c % 16 for c in cells), Counter(c >> 44 for c in cells)):
            expected = len(cells) / 16
            assert len(digit) == 16 and sum((k - expected) ** 2 / expected for k in digit.values()) < 45
        assert len(set(cells)) == len(cells)


def test_ids_may_repeat_and_parties_must_agree(spark):
    rows = [(1, [1, 2, 3, 4, 5, 6]), (1, [1, 2, 3, 4, 5, 7]), (2, [0] * 6), (2, [0] * 6), (None, [9] * 6), (3, [None, 1, 1, 1, 1, 1])]
    df = spark.createDataFrame(rows, "id long, x array<long>")
    first, second = H.split_shares(df, E.new_keyring(spark), "id", model=MODEL)
    a, b = H.score_share(first, MODEL, "id", True), H.score_share(second, MODEL, "id", False)
    got = Counter((r["id"], r["score"], r["copies"]) for r in H.open_shares(a, b, "id").collect())
    assert got == Counter({(1, plain(rows[0][1]), 1): 1, (1, plain(rows[1][1]), 1): 1, (2, -2, 2): 1,
                           (None, plain([9] * 6), 1): 1, (3, plain([0, 1, 1, 1, 1, 1]), 1): 1})
    with pytest.raises(Exception, match="do not match"):
        H.open_shares(a, b.where("id <> 1"), "id").collect()
    assert H.open_shares(a.limit(0), b.limit(0), "id").count() == 0
    with pytest.raises(ValueError):
        H.split_shares(df, E.new_keyring(spark), "id")


def tagged(spark, df, model=MODEL):
    """Sealed, tagged rows as written once by the client, and the keyring."""
    ring = E.new_keyring(spark)
    sealed = E.seal(df, ring, "id", model=model)
    return G.tag(sealed, ring, "id", model.feature_count).checkpoint(), ring


def test_honest_scores_pass(spark):
    rows, df = table(spark)
    t, ring = tagged(spark, df)
    got = {r["id"]: (r["score"], r["status"]) for r in G.open_tagged(G.score_tagged(t, MODEL, "id"), ring, MODEL, "id").collect()}
    assert got == {i: (plain(x), "PASS") for i, x in rows}


@pytest.mark.parametrize("name", ["score", "score by a prime", "score by both primes", "cell", "weight", "bias", "tag", "id", "salt", "no tag"])
def test_tampering_fails(spark, name):
    _, df = table(spark, 40)
    t, ring = tagged(spark, df)
    model, p, q = MODEL, *G.PRIMES
    if name == "cell":
        t = t.withColumn("c", F.transform("c", lambda v, i: F.when(i == 3, v + 1).otherwise(v)))
    if name == "weight":
        model = LinearModel((3, -7, 1, 75, 1, -1), -2)
    if name == "bias":
        model = LinearModel(MODEL.weights, -3)
    s = G.score_tagged(t, model, "id")
    change = {"score": {"sealed_sum": F.col("sealed_sum") + 1}, "score by a prime": {"sealed_sum": F.col("sealed_sum") + p},
              "score by both primes": {"sealed_sum": F.col("sealed_sum") + p * q}, "tag": {"tag1": F.pmod(F.col("tag1") + 1, F.lit(p))},
              "id": {"id": F.col("id") + 1}, "salt": {"salt": F.lit("x")}, "no tag": {"tag2": F.lit(None).cast("long")}}
    got = G.open_tagged(s.withColumns(change.get(name, {})), ring, MODEL, "id").collect()
    assert len(got) == 40 and {(r["status"], r["score"]) for r in got} == {("FAIL", None)}


def test_model_has_to_fit_the_tags():
    with pytest.raises(ValueError):
        G.check_model(LinearModel((2 ** 13, 2 ** 13), 0))
    G.check_model(LinearModel((67,) * 93, -2))               # the size of a 433-feature model
