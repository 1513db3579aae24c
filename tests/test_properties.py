"""Properties from the test strategy: metrics do not depend on row order or
partitioning; a prepared table has no missing values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from veilscore.operators import metrics as M


def test_metrics_invariant_to_row_order_and_partitioning(spark):
    rng = np.random.default_rng(4)
    n = 3000
    pdf = pd.DataFrame({"label": (rng.random(n) < 0.2).astype(int), "score": np.round(rng.random(n), 3)})
    df = spark.createDataFrame(pdf)
    ref = M.metric_summary(M.curve_points(df)).first()
    shuffled = spark.createDataFrame(pdf.sample(frac=1.0, random_state=1)).repartition(13, "score")
    other = M.metric_summary(M.curve_points(shuffled)).first()
    for k in ("average_precision", "pr_auc_trapezoid", "roc_auc", "thr", "prec_at_thr", "rec_at_thr"):
        assert other[k] == pytest.approx(ref[k], rel=1e-12, abs=1e-12)


def test_prepared_table_has_no_missing_values(spark):
    from veilscore.plans.registry import _prepared_orders
    prepared, fit = _prepared_orders(spark, SF_SMALL)
    nulls = prepared.select([F.sum(F.col(c).isNull().cast("int")).alias(c) for c in prepared.columns]).first()
    assert all(v == 0 for v in nulls)
    doubles = [c for c, t in prepared.dtypes if t == "double"]
    nans = prepared.select([F.sum(F.isnan(c).cast("int")).alias(c) for c in doubles]).first()
    assert all(v == 0 for v in nans)
    assert prepared.count() == spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
