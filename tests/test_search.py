"""Shared-pass regressions and resumable searches."""
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilscore.operators import models as ML
from veilscore.operators import shared_lr as LR
from veilscore.operators import split as T


def data(spark, n=400, seed=0, wide=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2 + wide))
    x[:, 0] = x[:, 0] * 30 + 100
    y = (r.random(n) < 1 / (1 + np.exp(-(0.03 * (x[:, 0] - 100) - x[:, 1] - 0.5)))).astype(int)
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(n)],
                               "id long, " + ", ".join(f"{c} double" for c in names) + ", y int").repartition(3)
    return T.stratified_folds(df, "y", "id", 3), names, x, y


def newton(x, y, w, c):
    a = np.c_[x, np.ones(len(x))]
    b = np.zeros(a.shape[1])
    ridge = np.append(np.full(x.shape[1], 1 / c), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ b))
        b = b - np.linalg.solve((a.T * (w * p * (1 - p))) @ a + np.diag(ridge), a.T @ (w * (p - y)) + ridge * b)
    return b


def test_shared_fits_equal_single_fits(spark, monkeypatch):
    monkeypatch.setattr(LR, "BLOCK", 7)               # sums travel in several blocks
    folded, names, x, y = data(spark)
    fold = {r["id"]: r["fold"] for r in folded.select("id", "fold").collect()}
    fold = np.array([fold[i] for i in range(len(y))])
    counts = ML.fold_counts(folded, "fold", "y")
    kinds = [(f, c, cw) for f in range(3) for c in (0.01, 1.0, 50.0) for cw in ("balanced", None, {0: 1, 1: 10})]
    tasks = []
    for f, c, cw in kinds:
        by = ML.training_weights(counts, f, cw)
        tasks.append(LR.Task(f, c, (by[0], by[1])))
    LR.fit(folded, tasks, names, "y", "fold", "x0", counts)
    for (f, c, cw), t in zip(kinds, tasks):
        part = fold != f
        xs = x[part].copy()
        xs[:, 0] = (xs[:, 0] - xs[:, 0].mean()) / xs[:, 0].std()
        n1 = y[part].sum()
        w1, w0 = {"balanced": (part.sum() / (2 * n1), part.sum() / (2 * (part.sum() - n1)))}.get(
            cw if isinstance(cw, str) else "", (10.0, 1.0) if cw else (1.0, 1.0))
        assert np.allclose(t.beta, newton(xs, y[part], np.where(y[part] > 0, w1, w0), c), atol=1e-6), (f, c, cw)


def test_shared_search_equals_spark_fits(spark):
    """The same scores as one Spark ML pipeline per candidate and fold."""
    folded, names, _, _ = data(spark, 300, 1)
    candidates = [{"C": 0.05, "class_weight": "balanced", "max_iter": 500}, {"C": 2.0, "class_weight": None, "max_iter": 1000}]
    got = ML.cross_validate(folded, "lr", candidates, names, "y", scale_col="x0").orderBy("candidate").collect()
    for i, cand in enumerate(candidates):
        for f in range(3):
            train = ML.with_weight_columns(folded.where(F.col("fold") != f), "y", [cand])
            model = ML.make_pipeline("lr", cand, names, "y", "x0", ML._weight_sum(train, cand)).fit(train)
            want = ML.AveragePrecisionEvaluator("y").evaluate(model.transform(folded.where(F.col("fold") == f)))
            assert got[i][f"split{f}_score"] == pytest.approx(want, abs=2e-3)


def test_one_class_and_missing_values(spark):
    rows = [(i, float(i), int(i % 2 == 0 and i >= 10), i // 10) for i in range(20)]     # fold 0 has no positives
    df = spark.createDataFrame(rows, "id long, a double, y int, fold int")
    got = ML.cross_validate(df, "lr", [{"C": 1.0}], ["a"], "y").first()
    assert np.isnan(got["split0_score"]) and got["split1_score"] == pytest.approx(0.5)   # trained on one class: all alike
    with pytest.raises(Exception, match="missing"):
        ML.cross_validate(df.withColumn("a", F.when(F.col("id") != 3, F.col("a"))), "lr", [{"C": 1.0}], ["a"], "y")
    with pytest.raises(ValueError, match="penalty"):
        ML.cross_validate(df, "lr", [{"C": 1.0, "penalty": "l1"}], ["a"], "y")


def test_killed_search_goes_on(spark, tmp_out, monkeypatch):
    """A search that dies after some fits ends with the table of one that did not; no
    fit is repeated and never more than `parallelism` models are held."""
    folded, names, _, _ = data(spark, 120, 2)
    candidates = [dict(c, n_estimators=2, max_depth=2) for c in ML.sample_candidates(ML.SEARCH_SPACES["rf"]["coarse"][2], 5)]
    want = ML.cross_validate(folded, "rf", candidates, names, "y", parallelism=3).collect()
    real, lock, fits, held, most = ML.make_pipeline, threading.Lock(), [0], [0], [0]
    score = ML.M.average_precision_by

    def counted(*args, **kwargs):
        with lock:
            fits[0] += 1
            held[0] += 1
            most[0] = max(most[0], held[0])
        return real(*args, **kwargs)

    def scored(*args, **kwargs):
        out = score(*args, **kwargs)
        with lock:
            held[0] -= 1
            if fits[0] > limit[0]:
                raise RuntimeError("killed")
        return out

    monkeypatch.setattr(ML, "make_pipeline", counted)
    monkeypatch.setattr(ML.M, "average_precision_by", scored)
    state = ML.SearchState(spark, f"{tmp_out}/state", "test")
    limit = [6]
    with pytest.raises(RuntimeError):
        ML.cross_validate(folded, "rf", candidates, names, "y", parallelism=2, state=state)
    kept = len(state.done())
    assert 0 < kept < 15
    fits[0] = 0
    limit = [10 ** 6]
    again = ML.cross_validate(folded, "rf", candidates, names, "y", parallelism=2, state=state).collect()
    assert again == want and most[0] <= 2 and fits[0] == len(set(map(lambda c: ML.effective("rf", c), candidates))) * 3 - kept
    assert ML.SearchState(spark, f"{tmp_out}/state", "other").done() == {}


def test_equal_candidates_are_fitted_once():
    forests = [{"n_estimators": 5, "min_samples_split": s} for s in (2, 4, 6)]
    assert len({ML.effective("rf", c) for c in forests}) == 1
    assert len({ML.effective("lr", {"C": c, "max_iter": m}) for c in (0.1, 1) for m in (500, 1000)}) == 2
    assert len({ML.effective("xgb", {"n_estimators": n}) for n in (200, 400)}) == 2
