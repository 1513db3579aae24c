"""Property: running totals equal a plain-Python cumulative count/sum for any
grouping, duplicate order keys (broken by a unique id here), null values and
partition count."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from veilscore.operators.ranking import running_totals

rows = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 30),
                          st.one_of(st.none(), st.integers(-5, 5))),
                min_size=0, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, parts=st.integers(1, 7))
def test_running_totals_property(spark, data, parts):
    records = [(g, k, v, uid) for uid, (g, k, v) in enumerate(data)]
    df = spark.createDataFrame(records, "g string, k long, v long, uid long")
    got = {r["uid"]: (r["rn"], r["cv"]) for r in
           running_totals(df, ["k", "uid"], ["g"], {"cv": "v"}, count_col="rn",
                          num_partitions=parts).collect()}
    expected = {}
    for g in {r[0] for r in records}:
        rn, acc, seen = 0, 0, False
        for _, _, v, uid in sorted((r for r in records if r[0] == g), key=lambda r: (r[1], r[3])):
            rn += 1
            if v is not None:
                acc += v
                seen = True
            expected[uid] = (rn, acc if seen else None)     # Spark's sum skips nulls
    assert got == expected


keyed = st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 6)), min_size=1, max_size=80)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=keyed, counted=st.booleans(), picks=st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_keys_at_ranks_property(spark, data, counted, picks):
    from pyspark.sql import functions as F
    from veilscore.operators.ranking import keys_at_ranks
    records = [(g, h, uid) for uid, (g, h) in enumerate(data)]
    sizes = {}
    for g, _, _ in records:
        sizes[g] = sizes.get(g, 0) + 1
    ranks = {g: sorted({max(1, min(n, int(round(p * n)) or 1)) for p in picks}) for g, n in sizes.items()}
    df = spark.createDataFrame(records, "g string, h long, uid long")
    got = {(r["g"], r["rank"]): r["key"]["uid"] for r in
           keys_at_ranks(df, "g", [F.col("h"), F.col("uid")], ranks,
                         F.col("h") if counted else None).collect()}
    expected = {}
    for g, rs in ranks.items():
        ordered = sorted((r for r in records if r[0] == g), key=lambda r: (r[1], r[2]))
        for r in rs:
            expected[(g, r)] = ordered[r - 1][2]
    assert got == expected


values = st.lists(st.tuples(st.sampled_from(["f", "g"]),
                            st.one_of(st.none(), st.integers(-3, 3).map(float),
                                      st.floats(-100, 100, allow_nan=False))),
                  min_size=0, max_size=80)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=values, bins=st.sampled_from([2, 16, 4096]))
def test_exact_median_property(spark, data, bins):
    import statistics
    from veilscore.operators.ranking import exact_medians
    df = spark.createDataFrame(data, "feature string, value double")
    got = {r["feature"]: r["median"] for r in exact_medians(df, bins=bins).collect()}
    groups = {}
    for f, v in data:
        if v is not None:
            groups.setdefault(f, []).append(v)
    assert got == {f: statistics.median(vs) for f, vs in groups.items()}


scored = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20).map(lambda v: v / 20.0)),
                  min_size=1, max_size=80)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=scored)
def test_metrics_property(spark, data):
    import numpy as np
    import pytest
    from tests.test_metrics import _np_reference
    from veilscore.operators import metrics as M
    y = np.array([d[0] for d in data])
    s = np.array([d[1] for d in data])
    df = spark.createDataFrame(data, "label int, score double")
    pts = M.curve_points(df)
    a = M.areas(pts).first()
    if y.min() == y.max():                       # one class: areas undefined
        assert a["roc_auc"] is None
        return
    ap, trap, roc, t95, smoke = _np_reference(y, s)
    assert a["average_precision"] == pytest.approx(ap, rel=1e-9)
    assert a["pr_auc_trapezoid"] == pytest.approx(trap, rel=1e-9)
    assert a["roc_auc"] == pytest.approx(roc, rel=1e-9)
    t = M.threshold_at_precision(pts).first()
    assert (t["thr"], t["prec_at_thr"], t["rec_at_thr"]) == pytest.approx(t95)
    t2 = M.threshold_smoke(pts).first()
    assert (t2["thr"], t2["prec_at_thr"], t2["rec_at_thr"]) == pytest.approx(smoke)
