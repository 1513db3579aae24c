"""S8 versions, E4 key change and key register, E6/S9 appended batches."""

import pytest
from pyspark.sql import functions as F

from veilscore.operators import seal as E
from veilscore.operators import score as S
from veilscore.sources import publish as P
from veilscore.sources.model import LinearModel

MODEL = LinearModel((3, -2, 5), 7)


def _rows(spark, n=50, start=0):
    return spark.range(start, start + n).select("id", F.array(F.col("id"), -F.col("id"), F.lit(4).cast("long")).alias("x"))


def test_a_stopped_run_leaves_the_old_version(spark, tmp_out):
    P.publish({"a": spark.range(3), "b": spark.range(4)}, tmp_out, spark)
    broken = spark.range(5).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        P.publish({"a": spark.range(9), "b": broken}, tmp_out, spark)
    at = P.latest(spark, tmp_out)
    assert spark.read.parquet(at["a"]).count() == 3 and spark.read.parquet(at["b"]).count() == 4
    assert len(P.sweep(spark, tmp_out)) == 1 and P.sweep(spark, tmp_out) == []
    P.publish({"a": spark.range(9)}, tmp_out, spark)
    at = P.latest(spark, tmp_out)
    assert list(at) == ["a"] and spark.read.parquet(at["a"]).count() == 9


def test_nothing_published(spark, tmp_out):
    with pytest.raises(FileNotFoundError):
        P.latest(spark, f"{tmp_out}/none")


def test_key_change_without_opening(spark):
    rows, old, new = _rows(spark), E.new_keyring(spark, ("a", "b")), E.new_keyring(spark, ("n0", "n1", "n2"))
    sealed = E.seal(rows, old, "id", model=MODEL).cache()
    moved = E.rekey(sealed, old, new, "id", 3).cache()
    want = {r["id"]: r["score"] for r in S.score_array(rows, MODEL, keep=["id"]).collect()}
    scored = E.score_sealed(moved, MODEL, "id")
    assert {r["id"]: r["score"] for r in E.open_scores(scored, new, MODEL, "id").collect()} == want
    # The old key opens nothing: not by its own names, and not under the new ones.
    assert E.open_scores(scored, old, MODEL, "id").count() == 0
    named = old.withColumn("key_id", F.element_at(F.array(F.lit("n0"), F.lit("n1")), F.col("key_slot") + 1))
    wrong = {r["id"]: r["score"] for r in E.open_scores(scored, named, MODEL, "id").collect()}
    assert wrong and all(want[i] != s for i, s in wrong.items())
    both = sealed.join(moved.select("id", F.col("c").alias("d"), F.col("salt").alias("s")), "id")
    assert both.where("c = d or salt = s").count() == 0
    sealed.unpersist(), moved.unpersist()


def test_key_change_needs_the_old_key(spark):
    old, other, new = (E.new_keyring(spark, (k,)) for k in "abc")
    with pytest.raises(Exception, match="not in the old keyring"):
        E.rekey(E.seal(_rows(spark), old, "id", width=3), other, new, "id", 3).collect()


def test_a_nonce_is_registered_once(spark, tmp_out):
    path = f"{tmp_out}/register"
    ring = E.new_keyring(spark, ("a", "b"))
    E.register_keys(ring, path)
    with pytest.raises(ValueError, match="before"):
        E.register_keys(ring.where("key_id = 'b'"), path)
    with pytest.raises(ValueError, match="before"):
        E.register_keys(E.new_keyring(spark, ("c",)).unionByName(ring.where("key_id = 'a'")), path)
    assert spark.read.parquet(path).count() == 2
    E.register_keys(ring.withColumn("nonce", F.concat("nonce", F.lit("0"))), path)
    twice = E.new_keyring(spark, ("x",))
    with pytest.raises(ValueError, match="before"):
        E.register_keys(twice.unionByName(twice), path)
    assert spark.read.parquet(path).count() == 4


def test_appended_batches_and_replays(spark, tmp_out):
    ring = E.new_keyring(spark)
    assert E.append_sealed_batches(_rows(spark, 25), ring, "id", 10, 3, tmp_out, 0) == 3
    assert E.append_sealed_batches(_rows(spark, 25), ring, "id", 10, 3, tmp_out, 0) == 0
    assert E.append_sealed_batches(_rows(spark, 0), ring, "id", 10, 3, tmp_out, 1) == 0
    # An epoch that stops after its rows, before its manifest row, does not count.
    bad = _rows(spark, 5, 100).withColumn("x", F.when(F.col("id") == 104, F.array(F.lit(1).cast("long"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="cannot be sealed"):
        E.append_sealed_batches(bad, ring, "id", 10, 3, tmp_out, 2)
    assert E.append_sealed_batches(_rows(spark, 12, 100), ring, "id", 10, 3, tmp_out, 2) == 2
    table = E.read_appended_batches(spark, tmp_out)
    got = {r["batch_id"]: r["n"] for r in table.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {1: 10, 2: 10, 3: 5, 4: 10, 5: 2}
    opened = E.unseal_features(table, ring, "id", 3)
    assert {r["id"] for r in opened.collect()} == {*range(25), *range(100, 112)}


def test_appended_stream_goes_on_after_a_restart(spark, tmp_out):
    from veilscore.streaming.scoring import append_sealed_stream
    ring, source = E.new_keyring(spark), f"{tmp_out}/in"
    for start, n in ((0, 15), (100, 7)):
        _rows(spark, n, start).coalesce(1).write.mode("append").parquet(source)
        append_sealed_stream(spark, source, spark.read.parquet(source).schema, ring, lambda d: d, "id", 3, 10,
                             f"{tmp_out}/out", f"{tmp_out}/ckpt").awaitTermination()
    table = E.read_appended_batches(spark, f"{tmp_out}/out")
    got = {r["batch_id"]: r["n"] for r in table.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {1: 10, 2: 5, 3: 7}
