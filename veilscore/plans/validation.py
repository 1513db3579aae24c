"""V5 — the staged validation run: for each stage take the first ``rows`` rows
(id order) and the first ``features`` features, then seal → score (no key) →
open → verify against the plain score, timed; report time, rows/s, cost and
PASS/FAIL.  Stages wider than the model are skipped (R12)."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import seal as E
from ..operators.project import first_n
from ..operators.validate import cost_columns, verify_counts
from ..sources.model import LinearModel

# The stage categories and descriptions of the reference's
# validation run; features=None means "all model features".
STAGES = (
    ("SANITY", "I/O Pipeline Check", 5, 5),
    ("CRYPTO", "Noise Budget Check", None, 1),
    ("SATURATION", "1:1 Core Mapping", None, 16),
)


def sealed_check(x: DataFrame, model: LinearModel, id_col: str, keyring: DataFrame) -> DataFrame:
    """seal (with a commitment to the plain score) → score (no key) → open and
    compare with the commitment → ``(n_rows, n_match, status)``.

    No join back to the plain table: every row carries its own check, and
    ``n_rows`` counts the input rows, so a row lost on the way is a mismatch."""
    sealed = E.seal(x, keyring, id_col, commit_to=model)
    scored = E.score_sealed(sealed, model, id_col, keep=["commit"])
    return verify_counts(x, E.open_and_verify(scored, keyring, model, id_col))


def run_pyramid(spark: SparkSession, features: DataFrame, model: LinearModel, id_col: str,
                stages: Sequence[tuple] = STAGES, keyring: DataFrame | None = None) -> DataFrame:
    keyring = keyring if keyring is not None else E.new_keyring(spark)
    rows = []
    for category, description, n_feat, n_rows in stages:
        k = model.feature_count if n_feat is None else int(n_feat)
        if k > model.feature_count:
            continue  # R12
        m = model.truncated(k)
        x = features.select(id_col, F.slice("x", 1, k).alias("x"))
        if n_rows is not None:
            x = first_n(x, int(n_rows), [id_col])
        t0 = time.perf_counter()
        r = sealed_check(x, m, id_col, keyring).collect()[0]
        seconds = time.perf_counter() - t0
        rows.append((category, description, k, int(r["n_rows"]), int(r["n_match"]), r["status"],
                     float(seconds)))
    report = spark.createDataFrame(
        rows, "category string, description string, features bigint, rows bigint, "
              "matches bigint, status string, seconds double")
    return cost_columns(report, "seconds", "rows")
