from pyspark.sql import functions as F

from veilscore.operators import score as S
from veilscore.sources.model import LinearModel
from veilscore.sources.synthetic import as_array, synthetic_features


def test_array_wide_tall_agree(spark):
    m = LinearModel(tuple(((i * 5) % 9) - 4 for i in range(40)), bias=3)
    wide = synthetic_features(spark, 300, 40, with_id=True)
    arr = as_array(wide)
    a = S.score_array(arr, m, keep=["id"], out="a")
    w = S.score_columns(wide, m, [f"feature_{i}" for i in range(40)], keep=["id"], out="w")
    t = S.score_tall(S.to_tall(arr, "id"), m, out="t")
    j = a.join(w, "id").join(t, "id")
    assert j.count() == 300 and j.where("a = w AND w = t").count() == 300


def test_wide_guard_counts_only_int64(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id long, a long, b int")
    df = df.withColumn("c", F.lit(4.5))
    m = LinearModel((10, 10, 10), bias=1)
    # columns (a: int64 -> 2, b: int32 -> 0, c: double -> 0)
    got = S.score_columns(df, m, ["a", "b", "c"], keep=["id"]).first()["score"]
    assert got == 21


def test_tall_rows_with_only_zero_weight_features_get_bias(spark):
    m = LinearModel((0, 5), bias=-3)
    tall = spark.createDataFrame([(1, 0, 9), (2, 1, 2)], "id long, feature_idx int, x long")
    got = {r["id"]: r["score"] for r in S.score_tall(tall, m).collect()}
    assert got == {1: -3, 2: 7}


def test_probability_and_flag(spark):
    m = LinearModel((1,), bias=0, scale_factor=1, feature_scale=1.0)
    df = spark.createDataFrame([(1, 0), (2, 3), (3, -3)], "id long, score long")
    p = S.flag_at_threshold(S.with_probability(df, m), 0.5).orderBy("id").collect()
    assert [r["flag"] for r in p] == [1, 1, 0] and p[0]["prob"] == 0.5
