"""Trees fitted one per task: equal to Spark ML where no random number is drawn, and each
candidate's score the one it has by itself."""
import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilscore.operators import metrics as M
from veilscore.operators import models as ML
from veilscore.operators import split as T
from veilscore.operators import task_trees as TT
from veilscore.plans import registry as R
from veilscore.plans import train as P


def table(spark, n=400, seed=0):
    """Three columns of few values and a label that follows two of them."""
    r = np.random.default_rng(seed)
    a, b, c = r.integers(0, 20, n), r.integers(0, 7, n), r.integers(0, 11, n)
    y = (r.random(n) < 1 / (1 + np.exp(-(a / 4 - 3 + (b == 2))))).astype(int)
    rows = [(i, float(a[i]) * 10, float(b[i]), float(c[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int").repartition(3)


def arrays(n=300, seed=1):
    r = np.random.default_rng(seed)
    x = r.integers(0, 32, (4, n)).astype(np.uint8)
    y = (r.random(n) < x[0] / 40).astype(np.uint8)
    return x, y, np.ones(n, np.int64), np.arange(n) % 2 == 0


def folded(spark, n=400, k=2):
    return T.stratified_folds(table(spark, n), "y", "id", k)


PLAIN = {"xgb": {"n_estimators": 12, "max_depth": 3, "learning_rate": 0.2},
         "rf": {"n_estimators": 1, "max_depth": 4, "max_features": "all", "bootstrap": False, "min_samples_leaf": 3,
                "class_weight": {0: 1, 1: 10}}}


@pytest.mark.parametrize("model", ["xgb", "rf"])
def test_equal_to_spark_without_chance(spark, model):
    df, cols, params = folded(spark), ["a", "b", "c"], PLAIN[model]
    counts = ML.fold_counts(df, "fold", "y")
    fits = [ML.fit_best(df, model, params, cols, "y", "fold", "a", counts, mode) for mode in (True, False)]
    got, want, told = (x.select("id", "prob").orderBy("id").toPandas()["prob"].to_numpy() for x in (
        *(ML.positive_probability(m.transform(df)) for m in (fits[0].pipeline(), fits[1])), fits[0].scored(df, "id", "y")))
    assert told == pytest.approx(got, abs=1e-12)
    assert len(set(got.round(6))) > 4
    assert got == pytest.approx(want, abs=1e-9)
    tables = [ML.cross_validate(df, model, [params], cols, "y", scale_col="a", in_tasks=mode).first() for mode in (True, False)]
    for f in range(2):
        assert tables[0][f"split{f}_score"] == pytest.approx(tables[1][f"split{f}_score"], abs=1e-9)


def test_candidates_share_fits_without_changing_scores():
    x, y, size, held = arrays()
    forest = TT.Fit(False, 20, 7, 0.8, 2, 1, True, (1.0, 10.0))
    fits = [dataclasses.replace(forest, trees=t, depth=d) for t in (8, 20) for d in (3, 7)]
    alone = [TT.scored(x, y, size, held, [f])[0] for f in fits]
    assert TT.scored(x, y, size, held, fits) == alone and len(set(alone)) == 4
    boosts = [TT.Fit(True, t, 4, 0.8, 3) for t in (5, 15)]
    alone = [TT.scored(x, y, size, held, [f])[0] for f in boosts]
    assert TT.scored(x, y, size, held, boosts) == alone and alone[0] != alone[1]
    assert fits[0].group() == fits[3].group() != dataclasses.replace(forest, rate=1.0).group()
    assert boosts[0].group() != dataclasses.replace(boosts[0], depth=5).group()


def test_batches_do_not_change_a_forest(monkeypatch):
    x, y, size, held = arrays()
    fit = TT.Fit(False, 9, 6, 1.0, 2)
    want = TT.scored(x, y, size, held, [fit])
    monkeypatch.setattr(TT, "BATCH_ROWS", 1)
    assert TT.scored(x, y, size, held, [fit]) == want


def test_leaves_draws_and_subsets():
    x, y, size, _ = arrays(2000)
    fit = TT.Fit(False, 30, 5, 0.8, 2, 9)
    nodes = [n for n in TT.forest(x, y.astype(float), size, fit)]
    leaf = np.concatenate([n.count[n.feature < 0] for n in nodes])
    assert leaf.min() >= 9
    roots = np.concatenate([n.count[:len(np.unique(n.tree))] for n in nodes])
    assert roots.mean() == pytest.approx(0.8 * 2000, rel=0.02) and roots.std() == pytest.approx(40, rel=0.4)
    first = {int(f) for n in nodes for f in n.feature[:len(np.unique(n.tree))]}
    assert len(first) > 1                                     # the best feature is not always looked at
    rows = [n.count[0] for n, _ in TT.boosted(x, y.astype(float), size, 2000, TT.Fit(True, 10, 2, 0.5, 4))]
    assert np.mean(rows) == pytest.approx(1000, rel=0.05) and max(rows) <= 2000


def test_saved_forest_is_the_one_scored(spark, tmp_out):
    """The loaded Spark ML model gives the mean of the trees in memory, before and after a save."""
    from pyspark.ml import PipelineModel
    df, cols = folded(spark), ["a", "b", "c"]
    params = {"n_estimators": 7, "max_depth": 5, "max_features": 0.5, "max_samples": 0.8, "class_weight": "balanced"}
    counts = ML.fold_counts(df, "fold", "y")
    fitted = ML.fit_best(df, "rf", params, cols, "y", "fold", "a", counts, True)
    told = {r["id"]: r["prob"] for r in fitted.scored(df, "id", "y").collect()}
    assert fitted.model is None                               # nothing is loaded for the scores
    model = fitted.pipeline()
    assert told == pytest.approx({r["id"]: r["prediction"] for r in model.transform(df).collect()}, abs=1e-12)
    assert model.stages[-1].getNumTrees == 7 and model.stages[-1].getOrDefault("maxDepth") == 5
    fit = ML.tree_settings("rf", params, 3, ML.training_weights(counts, None, "balanced"))
    b = TT.binned(df, cols, "y", "fold", "a", None)
    total = np.zeros(len(b.y))
    for nodes in TT.forest(b.x, b.y.astype(float), b.size, fit):
        *_, at = TT._levels(b.x, nodes, 7, 5)
        total += nodes.value()[at].sum(axis=0)
    got = model.transform(df).toPandas()["prediction"].to_numpy()
    assert np.sort(got) == pytest.approx(np.sort(np.repeat(total / 7, b.size)))
    model.write().save(f"{tmp_out}/m")
    again = PipelineModel.load(f"{tmp_out}/m").transform(df).toPandas()["prediction"].to_numpy()
    assert np.sort(again) == pytest.approx(np.sort(got))


def test_average_precision_of_rows_in_memory(spark):
    r = np.random.default_rng(3)
    y, p = r.integers(0, 2, 200), r.integers(0, 30, 200) / 30.0
    df = spark.createDataFrame([(0, int(a), float(b)) for a, b in zip(y, p)], "fold int, label int, prob double")
    want = M.average_precision_by(df, "fold", "label", "prob").first()["average_precision"]
    assert TT.average_precision(y, p, np.ones(200)) == pytest.approx(want, abs=1e-12)
    pairs, size = np.unique(np.c_[y, p], axis=0, return_counts=True)
    assert TT.average_precision(pairs[:, 0], pairs[:, 1], size) == pytest.approx(want, abs=1e-12)
    assert TT.average_precision(np.zeros(5), np.ones(5), np.ones(5)) is None


def test_thresholds_of_many_values(spark):
    df = spark.range(6400).selectExpr("cast(id AS double) AS a", "1D AS b", "cast(id % 3 AS double) AS c")
    a, b, c = TT.thresholds(df, ["a", "b", "c"])
    assert len(a) == 31 and np.abs(np.diff(a) - 200).max() <= 20 and len(b) == 0 and c.tolist() == [0.5, 1.5]


def test_equal_rows_are_one_cell(spark, monkeypatch):
    """Cells change no fit that draws nothing; draws of a cell are those of its rows together."""
    df = folded(spark).select("y", "fold", *[F.expr(f"{c} % 30").alias(c) for c in ("a", "b")])
    b = TT.binned(df, ["a", "b"], "y", "fold", None, 0)
    assert len(b.y) < 150 and b.size.sum() == 400 and len({(*c, y, f) for c, y, f in zip(b.x.T.tolist(), b.y, b.fold)}) == len(b.y)
    rows = [np.repeat(a, b.size, axis=-1) for a in (b.x, b.y, np.ones(len(b.y), np.int64), b.fold == 0)]
    for fit in (TT.Fit(True, 8, 3, 1.0, 2), TT.Fit(False, 1, 4, 1.0, 2, 3, False, (1.0, 10.0))):
        assert TT.scored(b.x, b.y, b.size, b.fold == 0, [fit]) == pytest.approx(TT.scored(*rows, [fit]), abs=1e-9)
    size, n = np.array([1, 5, 400]), 3000
    for bootstrap, spread in ((True, 0.8), (False, 0.16)):
        drawn = np.array([TT._drawn(size, TT.Fit(False, n, 3, 0.8, 2), t, bootstrap) for t in range(n)])
        assert drawn.mean(axis=0) == pytest.approx(0.8 * size, rel=0.05)
        assert drawn.var(axis=0) == pytest.approx(spread * size, rel=0.15)


def test_sums_in_one_double():
    """Counts of both labels added at once or apart give the same forest."""
    x, y, size, _ = arrays()
    fit = TT.Fit(False, 2, 6, 1.0, 2, 1, False, (0.7, 3.0))
    packed, apart = ([n.gain for n in TT.forest(x, y.astype(float), size * k, fit)] for k in (1, 2 ** 20))
    assert all(np.allclose(a, b) for a, b in zip(packed, apart, strict=True)) and len(packed[0]) > 20


@pytest.mark.parametrize("value", [None, float("nan"), float("inf")])
def test_missing_values_are_an_error(spark, value):
    df = folded(spark, 60).withColumn("b", F.when(F.col("id") != 3, F.col("b")).otherwise(F.lit(value).cast("double")))
    with pytest.raises(Exception, match="missing or infinite"):
        ML.cross_validate(df, "xgb", [{"n_estimators": 2}], ["a", "b"], "y", in_tasks=True)


def test_large_tables_go_to_spark(spark, monkeypatch):
    df, cols = folded(spark, 120), ["a", "b", "c"]
    cands = [{"n_estimators": 2, "max_depth": 2}, {"n_estimators": 3, "max_depth": 2}]
    want = ML.cross_validate(df, "xgb", cands, cols, "y").collect()
    fits = []
    real = ML.make_pipeline
    monkeypatch.setattr(ML, "make_pipeline", lambda *a, **k: fits.append(1) or real(*a, **k))
    ML.cross_validate(df, "xgb", cands, cols, "y", in_tasks=True).collect()
    assert not fits
    monkeypatch.setattr(TT, "LOCAL_BYTES", 0)
    assert ML.cross_validate(df, "xgb", cands, cols, "y", in_tasks=True).collect() == want and len(fits) == 4


def test_search_in_tasks_goes_on(spark, tmp_out, monkeypatch):
    df, cols = folded(spark, 120), ["a", "b", "c"]
    cands = [{"n_estimators": n, "max_depth": 2, "max_samples": s} for n in (2, 4) for s in (0.8, 1.0)]
    want = ML.cross_validate(df, "rf", cands, cols, "y", in_tasks=True).collect()
    state = ML.SearchState(spark, f"{tmp_out}/state", "t")
    ML.cross_validate(df, "rf", cands[:2], cols, "y", in_tasks=True, state=state)
    assert len(state.done()) == 4
    assert ML.cross_validate(df, "rf", cands, cols, "y", in_tasks=True, state=state).collect() == want
    assert len(state.done()) == 8
    monkeypatch.setattr(TT, "scored", None)
    assert ML.cross_validate(df, "rf", cands, cols, "y", in_tasks=True, state=state).collect() == want


def test_refolded_parts_equal_new_ones(spark):
    df = table(spark, 150)
    a, b = P.refolded(P.split_parts(df, "id", "y", 3), 2), P.split_parts(df, "id", "y", 2)
    assert a.made_of == b.made_of and a.counts == b.counts
    assert sorted(map(tuple, a.folded.select("id", "fold").collect())) == sorted(map(tuple, b.folded.select("id", "fold").collect()))


def test_run_in_tasks_saves_its_model(spark, tmp_out):
    import glob
    from pyspark.ml import PipelineModel
    cands = [{"n_estimators": n, "max_depth": 2} for n in (2, 3)]
    res = P.train(table(spark, 150), "xgb", "coarse", "id", "y", scale_col="a", candidates=cands, out_dir=tmp_out, in_tasks=True)
    saved = PipelineModel.load(glob.glob(f"{tmp_out}/XGB/coarse/*/best_model")[0])
    test = table(spark, 150).join(res.scored.select("id", "prob"), "id")
    got = ML.positive_probability(saved.transform(test), "again").select("prob", "again").collect()
    assert len(got) == 30 and all(abs(r["prob"] - r["again"]) < 1e-6 for r in got)


def test_every_kind_runs_its_whole_search(spark, tmp_out, monkeypatch):
    """`train_all_models` fits every candidate of the coarse spaces with all its trees."""
    spark.range(300).selectExpr(
        "id AS o_orderkey", "id % 30 AS o_custkey", "id * 7.5D % 91 AS o_totalprice", "concat(id % 5, '-P') AS o_orderpriority",
        "if(id % 3 = 0 OR id % 7 = 0, 'F', 'O') AS o_orderstatus").write.parquet(f"{tmp_out}/orders.parquet")
    spark.range(30).selectExpr(
        "id AS c_custkey", "cast(id % 4 AS int) AS c_nationkey", "id * 3.25D % 17 AS c_acctbal",
        "concat('S', id % 3) AS c_mktsegment").write.parquet(f"{tmp_out}/customer.parquet")
    searched, models = [], []
    search, train = TT.search, P.train

    def seen(df, fits, *a, **k):
        searched.append(list(fits.values()))
        return search(df, fits, *a, **k)

    def trained(*a, **k):
        models.append(train(*a, **k))
        return models[-1]

    monkeypatch.setattr(TT, "search", seen)
    monkeypatch.setattr(P, "train", trained)
    got = {r["model"]: r for r in R.train_all_models(spark, tmp_out).collect()}
    assert {m: (r["n_candidates"], r["n_folds"]) for m, r in got.items()} == {"lr": (10, 3), "rf": (30, 2), "xgb": (30, 2)}
    assert all(r["metrics_match"] and r["best_is_used"] and r["n_test"] == 60 and r["n_train"] == 240 for r in got.values())
    (rf, xgb), of = searched, lambda fits, name: {getattr(f, name) for f in fits}
    assert len(rf) == len(xgb) == 60
    assert (of(rf, "trees"), of(rf, "depth"), of(rf, "leaf")) == ({300, 600}, {8, 12}, {1, 3})
    assert (of(xgb, "trees"), of(xgb, "depth"), of(xgb, "step")) == ({200, 400}, {3, 5, 7}, {0.05, 0.1})
    for res, kind in zip(models, ("lr", "rf", "xgb")):
        best = ML.sample_candidates(ML.SEARCH_SPACES[kind]["coarse"][2], 30 if kind != "lr" else 10)[ML.best_candidate(res.results)]
        assert kind == "lr" or res.model.stages[-1].getNumTrees == best["n_estimators"]
