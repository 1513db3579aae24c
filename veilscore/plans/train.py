"""T13 — a training run end to end: drop → narrow → stratified hold-out →
stratified folds on the training part → search (sampled candidates × folds) →
refit the best on all training rows → probabilities on the hold-out →
threshold at precision, average precision, ROC-AUC → summary (+ optional sinks).
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intcols import narrow
from ..operators import metrics as M
from ..operators import models as ML
from ..operators.ranking import written
from ..operators.split import stratified_folds, stratified_split
from ..operators.task_trees import Fitted
from ..sources import sinks


@dataclass
class TrainResult:
    summary: DataFrame       # one row: metrics, threshold triple, best params, run id
    results: DataFrame       # search results table
    fitted: PipelineModel | Fitted      # refitted best pipeline
    scored: DataFrame        # hold-out (id, label, prob)

    @property
    def model(self) -> PipelineModel:
        return self.fitted.pipeline() if isinstance(self.fitted, Fitted) else self.fitted


@dataclass
class Parts:
    """Both parts of a training table, written once for every fit and score on them."""
    folded: DataFrame                       # training part with its fold
    test: DataFrame                         # hold-out
    features: list[str]
    n_folds: int
    counts: dict[int, dict[int, int]]       # rows by fold and label
    made_of: tuple                          # the settings they depend on


def split_parts(df: DataFrame, id_col: str, label_col: str, n_folds: int, drop: Sequence[str] = (),
                shuffle_folds: bool = True, seed: int = ML.SEED, id_as_feature: bool = False) -> Parts:
    """Narrowed table, hold-out and folds of :func:`train`.  Each is written before the
    next step reads it several times (class counts, boundary keys, folds, fits), so that
    no pass repeats the joins before it; searches of several model kinds can share them."""
    keep_wide = () if id_as_feature else (id_col,)
    base = written(narrow(df.drop(*drop), exclude=keep_wide)
                   .withColumn(label_col, F.col(label_col).cast("int")), "train-base")
    features = [c for c in base.columns if c != label_col and (id_as_feature or c != id_col)]
    split = written(stratified_split(base, label_col, id_col, 0.2, seed), "train-split")
    train_part = split.where(~F.col("is_test")).drop("is_test")
    folded = written(stratified_folds(train_part, label_col, id_col, n_folds, shuffle_folds, seed), "train-folds")
    return Parts(folded, split.where(F.col("is_test")).drop("is_test"), features, n_folds,
                 ML.fold_counts(folded, "fold", label_col),
                 (id_col, label_col, n_folds, tuple(drop), shuffle_folds, seed, id_as_feature))


def refolded(parts: Parts, n_folds: int) -> Parts:
    """The same hold-out with another number of folds, as :func:`split_parts` makes them."""
    id_col, label_col, k, drop, shuffle_folds, seed, id_as_feature = parts.made_of
    if n_folds == k:
        return parts
    folded = written(stratified_folds(parts.folded.drop("fold"), label_col, id_col, n_folds, shuffle_folds, seed), "train-folds")
    return Parts(folded, parts.test, parts.features, n_folds, ML.fold_counts(folded, "fold", label_col),
                 (id_col, label_col, n_folds, drop, shuffle_folds, seed, id_as_feature))


def train(df: DataFrame, model: str, mode: str, id_col: str, label_col: str,
          drop: Sequence[str] = (), scale_col: str | None = None,
          candidates: Sequence[dict] | None = None, n_folds: int | None = None,
          shuffle_folds: bool = True, target_precision: float = M.TARGET_PRECISION,
          out_dir: str | None = None, seed: int = ML.SEED,
          id_as_feature: bool = False, parallelism: int = 1, state_path: str | None = None,
          parts: Parts | None = None, in_tasks: bool = False) -> TrainResult:
    """``id_as_feature=True`` reproduces the reference's training input, which
    keeps the transaction id among the features (R1 compat); by default the id
    is only a key.

    ``state_path`` names a table that keeps every score of the search
    (:class:`veilscore.operators.models.SearchState`); a run that was killed goes on
    with it.  Splits and folds depend on ids and ``seed`` alone, so they come out the
    same; a table of other rows needs a state of its own.

    ``parts`` are those of :func:`split_parts` for ``df`` and the same settings, if an
    earlier run has made them.  With ``in_tasks`` forests and boosted trees are fitted one
    per task (:mod:`veilscore.operators.task_trees`) where the table allows it."""
    spark = df.sparkSession
    n_iter, folds_default, grid = ML.SEARCH_SPACES[model][mode] if model in ML.SEARCH_SPACES else (1, 2, {})
    cands = list(candidates) if candidates is not None else ML.sample_candidates(grid, n_iter, seed)
    k = int(n_folds or folds_default)
    made_of = (id_col, label_col, k, tuple(drop), shuffle_folds, seed, id_as_feature)
    if parts is None:
        parts = split_parts(df, *made_of)
    elif parts.made_of != made_of:
        raise ValueError(f"parts were made with {parts.made_of}, not {made_of}")
    folded, test_part, features = parts.folded, parts.test, parts.features
    t_search = time.perf_counter()
    run = json.dumps([model, k, shuffle_folds, seed, scale_col, label_col, features])
    state = ML.SearchState(spark, state_path, run) if state_path else None
    results = ML.cross_validate(folded, model, cands, features, label_col, "fold", scale_col,
                                parallelism, state, parts.counts, in_tasks)
    best_i = ML.best_candidate(results)
    best = cands[best_i]
    fitted = ML.fit_best(folded, model, best, features, label_col, "fold", scale_col, parts.counts, in_tasks)
    training_seconds = time.perf_counter() - t_search
    if isinstance(fitted, Fitted):
        scored = fitted.scored(test_part, id_col, label_col)
    else:
        scored = ML.positive_probability(fitted.transform(test_part)).select(id_col, label_col, "prob")
    scored = written(scored, "scored")
    pts = M.curve_points(scored, label_col, "prob")
    summary = M.metric_summary(pts, target_precision)
    result = TrainResult(summary, results, fitted, scored)
    rid = sinks.run_id(spark)
    summary = summary.select(
        F.lit(mode).alias("mode"), F.lit(rid).alias("run_id"),
        F.lit(ML.MODEL_LABELS.get(model, model)).alias("model"),
        F.col("average_precision").alias("pr_auc"), "roc_auc", "thr", "prec_at_thr", "rec_at_thr",
        F.lit(str(best)).alias("best_params"),
        F.lit(round(training_seconds, 3)).alias("training_seconds"))
    if out_dir:
        label = ML.MODEL_LABELS.get(model, model)
        run_dir = f"{out_dir.rstrip('/')}/{label}/{mode}/{rid}"
        sinks.write_csv(results, f"{run_dir}/cv_results")
        sinks.write_json(summary, f"{run_dir}/metrics")
        result.model.write().overwrite().save(f"{run_dir}/best_model")
        ap = summary.first()["pr_auc"]
        sinks.append_run_log(spark, f"{out_dir.rstrip('/')}/{label}/run_log", model, mode, rid, ap)
    result.summary = summary
    return result
