import hashlib

import pytest
from pyspark.sql import functions as F

from veilscore.operators import models as ML
from veilscore.operators import split as T
from veilscore.plans import train as P
from veilscore.plans.prepare import prepare


def table(spark, n=240):
    rows = [(i, float(i % 7) * 10.0, float((i * 3) % 11), int(i % 6 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, amt double, b double, y int")


def test_join_is_read_once(spark, tmp_out):
    """The prepared rows come from the stored join, not from both tables again."""
    spark.range(60).selectExpr("id", "id % 5 AS k", "if(id % 9 = 0, null, id * 1.5D) AS x",
                               "cast(id % 2 AS int) AS y").write.parquet(f"{tmp_out}/tx")
    spark.range(4).selectExpr("id AS k", "concat('s', id) AS s").write.parquet(f"{tmp_out}/who")
    tx, who = spark.read.parquet(f"{tmp_out}/tx"), spark.read.parquet(f"{tmp_out}/who")
    out, _ = prepare(tx, who, "k", "y", id_col="id")
    assert out.count() == 60
    assert not [f for f in out.inputFiles() if tmp_out in f]


def test_parts_are_shared(spark, monkeypatch):
    df, made = table(spark), []
    monkeypatch.setattr(P, "stratified_split", lambda *a: made.append(1) or T.stratified_split(*a))
    parts = P.split_parts(df, "id", "y", 2)
    cands = [{"C": 1.0, "class_weight": "balanced", "max_iter": 50}, {"C": 0.1, "class_weight": None, "max_iter": 50}]
    kinds = {"lr": cands, "xgb": [{"n_estimators": 2, "max_depth": 2}]}
    shared = {k: P.train(df, k, "coarse", "id", "y", candidates=c, n_folds=2, parts=parts) for k, c in kinds.items()}
    assert len(made) == 1
    alone = P.train(df, "lr", "coarse", "id", "y", candidates=cands, n_folds=2)
    a, b = (r.summary.drop("run_id", "training_seconds").first() for r in (shared["lr"], alone))
    assert a == b and shared["xgb"].scored.count() == 48
    with pytest.raises(ValueError):
        P.train(df, "lr", "coarse", "id", "y", candidates=cands, n_folds=3, parts=parts)


@pytest.mark.parametrize("weight", ["balanced", None, {0: 1, 1: 10}])
def test_weights_from_counts(spark, weight):
    df, params = table(spark).withColumn("fold", (F.col("id") % 3).cast("int")), {"class_weight": weight}
    name = f"_w_{ML._cw_key(weight)}"
    got, total = ML.weighted(df, "y", params, ML.fold_counts(df, "fold", "y"))
    want = ML.with_weight_columns(df, "y", [params])
    assert got.select("id", name).orderBy("id").collect() == want.select("id", name).orderBy("id").collect()
    assert total == pytest.approx(ML._weight_sum(want, params))


def test_fold_key_is_hashed_once(spark):
    """The seeded key is bound outside the filter over the bounds; folds as in plain Python."""
    df = table(spark)
    folded = T.stratified_folds(df, "y", "id", 4)
    plan = folded._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.split("\n") if "filter(_bounds" in x)
    assert "md5(" in line and "md5(" not in line[line.index("filter(_bounds"):]
    want = {}
    for lab, per_fold in T.fold_allocation([(0, 200), (1, 40)], 4).items():
        ids = sorted((i for i in range(240) if int(i % 6 == 0) == lab),
                     key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
        for fold, n in enumerate(per_fold):
            want |= dict.fromkeys(ids[:n], fold)
            ids = ids[n:]
    assert {r.id: r.fold for r in folded.collect()} == want
