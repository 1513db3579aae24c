import pytest
from pyspark.sql import functions as F

from veilscore.operators import score as S
from veilscore.operators import seal as E
from veilscore.sources.model import LinearModel
from veilscore.sources.synthetic import as_array, synthetic_features


def _features(spark, n=200, k=17):
    return as_array(synthetic_features(spark, n, k, with_id=True))


def test_open_score_seal_equals_plain(spark):
    m = LinearModel(tuple(range(-8, 9)), bias=-2)
    x = _features(spark)
    ring = E.new_keyring(spark)
    sealed = E.seal(x, ring, "id", width=m.feature_count)
    opened = E.open_scores(E.score_sealed(sealed, m, "id"), ring, m, "id", out="got")
    plain = S.score_array(x, m, keep=["id"], out="exp")
    j = opened.join(plain, "id")
    assert j.count() == 200 and j.where("got = exp").count() == 200


def test_sealed_values_differ_and_roundtrip(spark):
    x = _features(spark, 50, 12)
    ring = E.new_keyring(spark)
    sealed = E.seal(x, ring, "id", width=12)
    j = sealed.join(x, "id")
    same = j.select(F.size(F.array_intersect("c", "x")).alias("n")).agg(F.sum("n")).first()[0]
    assert same <= 1
    back = E.unseal_features(sealed, ring, "id", 12).join(x.withColumnRenamed("x", "x0"), "id")
    assert back.where("x = x0").count() == 50


def test_secret_not_in_plan(spark):
    secret = b"very-secret-key-material-123456"
    ring = E.new_keyring(spark, secret=secret)
    x = _features(spark, 5, 3)
    sealed = E.seal(x, ring, "id", width=3)
    plan = sealed._jdf.queryExecution().toString()
    ipad_hex = bytes(b ^ 0x36 for b in secret.ljust(64, b"\0")).hex()
    assert ipad_hex not in plan.lower() and "very-secret" not in plan


def test_scoring_job_needs_no_key(spark):
    m = LinearModel((1, 2, 3), bias=4)
    x = _features(spark, 10, 3)
    ring = E.new_keyring(spark)
    sealed = E.seal(x, ring, "id", width=3)
    scored = E.score_sealed(sealed, m, "id")
    assert "k_ipad" not in scored.columns and "k_opad" not in scored.columns


def test_keys_differ_per_run(spark):
    x = _features(spark, 5, 3)
    a = E.seal(x, E.new_keyring(spark), "id", width=3).orderBy("id").collect()
    b = E.seal(x, E.new_keyring(spark), "id", width=3).orderBy("id").collect()
    assert [r["c"] for r in a] != [r["c"] for r in b]


def test_batches(spark, tmp_out):
    x = _features(spark, 23, 4)
    ring = E.new_keyring(spark)
    sb = E.sealed_batches(x, ring, "id", 10, 4)
    E.write_sealed_batches(sb, f"{tmp_out}/b")
    got = {r["batch_id"]: r["count"] for r in spark.read.parquet(f"{tmp_out}/b").groupBy("batch_id").count().collect()}
    assert got == {1: 10, 2: 10, 3: 3}
    many = x.crossJoin(spark.range(1000).withColumnRenamed("id", "k")).selectExpr("id * 1000 + k as id", "x")
    E.write_sealed_batches(E.sealed_batches(many, ring, "id", 2, 4), f"{tmp_out}/c")
    read = spark.read.parquet(f"{tmp_out}/c")
    import glob
    assert len(glob.glob(f"{tmp_out}/c/batch_group=*")) == 12 and read.count() == 23_000
    assert read.selectExpr("max(batch_id)", "max(batch_group)").first()[:] == (11_500, 11)


def test_commitment_detects_tampering_and_loss(spark):
    from veilscore.operators.validate import verify_counts
    m = LinearModel((2, -1, 3), bias=5)
    x = _features(spark, 30, 3)
    ring = E.new_keyring(spark)
    sealed = E.seal(x, ring, "id", width=3, commit_to=m)
    scored = E.score_sealed(sealed, m, "id", keep=["commit"])
    ok = verify_counts(x, E.open_and_verify(scored, ring, m, "id")).first()
    assert (ok["n_rows"], ok["n_match"], ok["status"]) == (30, 30, "PASS")
    tampered = scored.withColumn("sealed_score", F.when(F.col("id") == 3, F.col("sealed_score") + 1)
                                 .otherwise(F.col("sealed_score")))
    bad = verify_counts(x, E.open_and_verify(tampered, ring, m, "id")).first()
    assert (bad["n_match"], bad["status"]) == (29, "FAIL")
    lost = verify_counts(x, E.open_and_verify(scored.where("id <> 7"), ring, m, "id")).first()
    assert (lost["n_rows"], lost["n_match"], lost["status"]) == (30, 29, "FAIL")


def test_width_is_required_and_checked(spark):
    x = _features(spark, 6, 100)
    ring = E.new_keyring(spark)
    with pytest.raises(ValueError):
        E.seal(x, ring, "id")
    assert {len(r["c"]) for r in E.seal(x, ring, "id", width=100).collect()} == {100}
    with pytest.raises(Exception, match="cannot be sealed"):
        E.seal(x, ring, "id", width=64).collect()
    assert {len(r["c"]) for r in E.seal(x, ring, "id", width=64, truncate=True).collect()} == {64}
    m = LinearModel(tuple(range(99)))
    with pytest.raises(Exception):
        E.score_sealed(E.seal(x, ring, "id", width=100), m, "id").collect()


def test_scores_that_could_wrap_are_errors(spark):
    ring = E.new_keyring(spark)
    x = spark.createDataFrame([(1, [2 ** 46, 2 ** 46])], "id long, x array<bigint>")
    with pytest.raises(Exception, match="cannot be sealed"):
        E.seal(x, ring, "id", model=LinearModel((3, 3))).collect()
    big = spark.createDataFrame([(1, [2 ** 47, 0])], "id long, x array<bigint>")
    with pytest.raises(Exception, match="cannot be sealed"):
        E.seal(big, ring, "id", width=2).collect()
    m = LinearModel((1, 0), bias=-5)
    edge = spark.createDataFrame([(1, [2 ** 46, None]), (2, [-(2 ** 46), 7])], "id long, x array<bigint>")
    got = E.open_scores(E.score_sealed(E.seal(edge, ring, "id", model=m), m, "id"), ring, m, "id")
    assert {r["id"]: r["score"] for r in got.collect()} == {1: 2 ** 46 - 5, 2: -(2 ** 46) - 5}


def test_equal_ids_share_no_mask(spark):
    ring = E.new_keyring(spark)
    x = spark.createDataFrame([(1, [5]), (1, [9])], "id long, x array<bigint>")
    sealed = E.seal(x, ring, "id", width=1)
    a, b = (r["c"][0] for r in sealed.collect())
    assert abs(a - b) != 4
    m = LinearModel((2,), bias=1)
    opened = E.open_scores(E.score_sealed(E.seal(x, ring, "id", width=1), m, "id"), ring, m, "id")
    assert sorted(r["score"] for r in opened.collect()) == [11, 19]
