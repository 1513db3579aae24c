import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilscore.operators import metrics as M


def _np_reference(y, s):
    """Step AP, trapezoid PR area, ROC AUC and the threshold rules, with NumPy."""
    order = np.argsort(-s, kind="mergesort")
    y, s = y[order], s[order]
    distinct = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tps = np.cumsum(y)[distinct]
    fps = (1 + distinct) - tps
    thr = s[distinct]
    prec = tps / (tps + fps)
    rec = tps / tps[-1]
    # increasing-threshold order + final (1, 0) point
    P = np.r_[prec[::-1], 1.0]
    R = np.r_[rec[::-1], 0.0]
    T = thr[::-1]
    ap = -np.sum(np.diff(R) * P[:-1])
    trap = abs(np.trapezoid(P, R)) if hasattr(np, "trapezoid") else abs(np.trapz(P, R))
    fpr = np.r_[0, fps / fps[-1]]
    tpr = np.r_[0, tps / tps[-1]]
    roc = np.trapezoid(tpr, fpr) if hasattr(np, "trapezoid") else np.trapz(tpr, fpr)
    idx = np.where(P[:-1] >= 0.95)[0]
    if idx.size == 0:
        t95 = (0.5, 0.0, 0.0)
    else:
        b = idx[np.argmax(R[idx])]
        t95 = (T[b], P[b], R[b])
    v = np.where(P >= 0.95)[0]
    i = v[0]
    smoke = (T[i] if i < len(T) else 1.0, P[i], R[i])
    return ap, trap, roc, t95, smoke


@pytest.mark.parametrize("seed,ties", [(1, False), (2, True)])
def test_areas_match_numpy(spark, seed, ties):
    rng = np.random.default_rng(seed)
    n = 2000
    y = (rng.random(n) < 0.1).astype(int)
    s = rng.random(n) + 0.3 * y
    if ties:
        s = np.round(s, 2)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    pts = M.curve_points(df, "label", "score")
    a = M.areas(pts).first()
    ap, trap, roc, t95, smoke = _np_reference(y, s)
    assert a["average_precision"] == pytest.approx(ap, rel=1e-9)
    assert a["pr_auc_trapezoid"] == pytest.approx(trap, rel=1e-9)
    assert a["roc_auc"] == pytest.approx(roc, rel=1e-9)
    t = M.threshold_at_precision(pts).first()
    assert (t["thr"], t["prec_at_thr"], t["rec_at_thr"]) == pytest.approx(t95)
    t2 = M.threshold_smoke(pts).first()
    assert (t2["thr"], t2["prec_at_thr"], t2["rec_at_thr"]) == pytest.approx(smoke)


def test_ties_give_half_credit(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    a = M.areas(M.curve_points(df)).first()
    assert a["roc_auc"] == 0.5
    assert M.pr_curve(M.curve_points(df)).count() == 2   # one point + final


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.7)], "label int, score double")
    a = M.areas(M.curve_points(df)).first()
    assert a["average_precision"] is None and a["roc_auc"] is None


def test_no_threshold_defaults(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.8), (0, 0.7), (1, 0.1)], "label int, score double")
    pts = M.curve_points(df)
    t = M.threshold_at_precision(pts).first()
    assert (t["thr"], t["prec_at_thr"], t["rec_at_thr"]) == (0.5, 0.0, 0.0)
    s = M.threshold_smoke(pts).first()
    assert (s["thr"], s["prec_at_thr"], s["rec_at_thr"]) == (1.0, 1.0, 0.0)


def test_empty_input(spark):
    df = spark.createDataFrame([], "label int, score double")
    a = M.areas(M.curve_points(df)).first()
    assert a["average_precision"] is None and a["n_pos"] == 0


def test_merged_states_equal_the_union(spark, tmp_out):
    """Parts with shared scores, an empty part, a part put twice and one replaced."""
    from veilscore.operators import metric_state
    rows = [(i, i % 13 / 13, int(i * 7 % 5 == 0), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, score double, label int, part int")
    path = f"{tmp_out}/state"
    metric_state.put(df.limit(50), path, "p0")
    for part in (0, 1, 2, 1):
        metric_state.put(df.where(F.col("part") == part), path, f"p{part}")
    metric_state.put(df.limit(0), path, "none")
    got = M.metric_summary(metric_state.curve_points(spark, path)).first()
    assert got == M.metric_summary(M.curve_points(df)).first()
    with pytest.raises(ValueError):
        metric_state.put(df, path, "../x")
