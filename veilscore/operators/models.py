"""Classifiers, candidate spaces, cross-validated search, results table.

Spark ML does the fitting (every fit is a distributed job); this module maps the
reference's estimator settings onto Spark ML parameters:

* logistic regression: ``min C·Σ w_i·loss_i + ½‖β‖²`` equals Spark's objective
  with ``regParam = 1 / (C·Σ w_i)`` (Σ over the *training fold*),
  ``elasticNetParam = 0`` and ``standardization = False``;
* random forest: a regression forest on the 0/1 label (variance and Gini choose
  the same binary splits), so leaves keep their rates: Spark's classifier merges
  sibling leaves of one predicted class.  n_estimators→numTrees, max_depth→maxDepth,
  min_samples_leaf→minInstancesPerNode, max_features→featureSubsetStrategy,
  max_samples→subsamplingRate; min_samples_split has no counterpart, candidates
  that differ in it alone are fitted once;
* boosted trees: n_estimators→maxIter, learning_rate→stepSize,
  subsample→subsamplingRate, colsample_bytree→featureSubsetStrategy (Spark
  samples per node, not per tree);
* :mod:`.task_trees` fits the same trees one per task for searches that ask for it;
* class_weight → a per-row weight column (T4), from the rows a model is fitted on.

Cross-validation runs the folds of a ``fold`` column (T2/T3); the evaluator is
the exact distributed average precision (M3).  Spark's
``BinaryClassificationEvaluator("areaUnderPR")`` is a different area.
"""

from __future__ import annotations

import itertools
import json
import random
import threading
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists
from . import metrics as M
from . import shared_lr, task_trees
from .scale import ScalePassthrough
from .split import class_weight_column

SEED = 42

# The reference's search spaces, model → mode →
# (n_iter, cv_folds, grid).  Class weights {0: 1, 1: w} are written as dicts.
SEARCH_SPACES = {
    "rf": {
        "coarse": (30, 2, {
            "n_estimators": [300, 600], "max_depth": [8, 12], "min_samples_leaf": [1, 3],
            "max_features": ["sqrt", 0.5], "class_weight": ["balanced", {0: 1, 1: 10}],
            "max_samples": [0.8, 1.0]}),
        "fine": (60, 5, {
            "n_estimators": [250, 300, 350, 400], "max_depth": [10, 12, 14],
            "min_samples_leaf": [1, 2], "min_samples_split": [2, 4, 6], "max_features": ["sqrt"],
            "class_weight": [{0: 1, 1: 8}, {0: 1, 1: 10}, {0: 1, 1: 12}], "max_samples": [0.9, 1.0]}),
        "final": (1, 10, {
            "n_estimators": [300], "max_depth": [12], "min_samples_leaf": [1],
            "min_samples_split": [2], "max_features": ["sqrt"], "class_weight": [{0: 1, 1: 10}],
            "max_samples": [1.0]}),
    },
    "xgb": {
        "coarse": (30, 2, {
            "n_estimators": [200, 400], "max_depth": [3, 5, 7], "learning_rate": [0.05, 0.1],
            "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0]}),
        "fine": (60, 5, {
            "n_estimators": [300, 400, 500], "max_depth": [4, 6, 8], "learning_rate": [0.05, 0.1],
            "subsample": [0.9, 1.0], "colsample_bytree": [0.9, 1.0]}),
        "final": (1, 5, {
            "n_estimators": [400], "max_depth": [6], "learning_rate": [0.05], "subsample": [1.0],
            "colsample_bytree": [1.0]}),
    },
    "lr": {
        "coarse": (10, 3, {
            "C": [0.01, 0.1, 1.0, 10], "penalty": ["l2"], "solver": ["lbfgs"],
            "class_weight": ["balanced", None], "max_iter": [500, 1000]}),
        "fine": (20, 5, {
            "C": [0.05, 0.1, 0.5, 1.0], "penalty": ["l2"], "solver": ["lbfgs"],
            "class_weight": ["balanced", None], "max_iter": [1000]}),
        "final": (1, 5, {
            "C": [0.1], "penalty": ["l2"], "solver": ["lbfgs"], "class_weight": ["balanced"],
            "max_iter": [1000]}),
    },
}
# The smoke run's grid (random forest, 2 unshuffled folds, class weight {0:1, 1:10}).
SMOKE_GRID = {"n_estimators": [10], "max_depth": [2], "max_features": [0.4, 0.5, 0.6],
              "min_samples_leaf": [1, 2]}
SMOKE_FIXED = {"class_weight": {0: 1, 1: 10}}
MODEL_LABELS = {"rf": "RandomForest", "xgb": "XGB", "lr": "LR"}


# ----------------------------------------------------------------- candidates
def expand_grid(grid: Mapping[str, Sequence]) -> list[dict]:
    """All combinations, keys in sorted order (the reference's grid order)."""
    keys = sorted(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def sample_candidates(grid: Mapping[str, Sequence], n_iter: int, seed: int = SEED) -> list[dict]:
    """``n_iter`` candidates drawn without replacement (all if fewer)."""
    full = expand_grid(grid)
    if len(full) <= n_iter:
        return full
    idx = random.Random(seed).sample(range(len(full)), n_iter)
    return [full[i] for i in idx]


def search_space_sizes() -> list[tuple[str, str, int, int, int, int]]:
    """(model, mode, grid size, sampled, folds, fits before refit)."""
    out = []
    for model, modes in SEARCH_SPACES.items():
        for mode, (n_iter, folds, grid) in modes.items():
            size = len(expand_grid(grid))
            sampled = min(size, n_iter)
            out.append((model, mode, size, sampled, folds, sampled * folds))
    return out


def _cw_key(cw) -> str:
    if cw is None:
        return "none"
    if cw == "balanced":
        return "balanced"
    return "map_" + "_".join(f"{k}x{v}" for k, v in sorted(dict(cw).items()))


def with_weight_columns(df: DataFrame, label_col: str, candidates: Sequence[Mapping]) -> DataFrame:
    """One weight column per distinct class_weight among the candidates (T4)."""
    out = df
    seen = set()
    for c in candidates:
        cw = c.get("class_weight")
        name = f"_w_{_cw_key(cw)}"
        if name not in seen:
            seen.add(name)
            out = out.withColumn(name, class_weight_column(df, label_col, cw))
    return out


# ----------------------------------------------------------------- estimators
def _subset(v) -> str:
    if v in ("sqrt", "log2", "all", "auto", "onethird"):
        return v
    f = float(v)
    return "all" if f >= 1.0 else repr(f)


def make_classifier(model: str, params: Mapping, weight_sum: float | None = None,
                    features_col: str = "features", label_col: str = "label", seed: int = SEED):
    """Spark ML classifier for one candidate (see the module docstring)."""
    wcol = f"_w_{_cw_key(params.get('class_weight'))}"
    if model == "lr":
        c = float(params.get("C", 1.0))
        reg = 1.0 / (c * float(weight_sum)) if weight_sum else 0.0
        return LogisticRegression(featuresCol=features_col, labelCol=label_col, weightCol=wcol,
                                  regParam=reg, elasticNetParam=0.0, standardization=False,
                                  maxIter=int(params.get("max_iter", 100)), tol=1e-6)
    if model == "rf":
        return RandomForestRegressor(
            featuresCol=features_col, labelCol=label_col, weightCol=wcol, seed=seed,
            numTrees=int(params.get("n_estimators", 100)), maxDepth=int(params.get("max_depth", 5)),
            minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
            featureSubsetStrategy=_subset(params.get("max_features", "sqrt")),
            subsamplingRate=float(params.get("max_samples", 1.0) or 1.0),
            bootstrap=bool(params.get("bootstrap", True)))
    if model in ("xgb", "gbt"):
        return GBTClassifier(
            featuresCol=features_col, labelCol=label_col, seed=seed,
            maxIter=int(params.get("n_estimators", 100)), maxDepth=int(params.get("max_depth", 3)),
            stepSize=float(params.get("learning_rate", 0.1)),
            subsamplingRate=float(params.get("subsample", 1.0)),
            featureSubsetStrategy=_subset(params.get("colsample_bytree", 1.0)))
    raise ValueError(f"unknown model {model!r}")


def make_pipeline(model: str, params: Mapping, feature_cols: Sequence[str], label_col: str,
                  scale_col: str | None = None, weight_sum: float | None = None) -> Pipeline:
    """F5 + F6: scale one column (refit per fold), assemble (scaled column first,
    then the rest), classifier."""
    stages = []
    cols = list(feature_cols)
    if scale_col:
        stages.append(ScalePassthrough(inputCol=scale_col))
        cols = [scale_col] + [c for c in cols if c != scale_col]
    stages.append(VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"))
    stages.append(make_classifier(model, params, weight_sum, "features", label_col))
    return Pipeline(stages=stages)


def positive_probability(df: DataFrame, out: str = "prob") -> DataFrame:
    """P4 for a fitted model: P(class 1); the prediction of a forest on the 0/1 label."""
    if "probability" not in df.columns:
        return df.withColumn(out, F.col("prediction"))
    return df.withColumn(out, vector_to_array(F.col("probability")).getItem(1))


class AveragePrecisionEvaluator(Evaluator):
    """M3 as a Spark ML evaluator (exact, distributed)."""

    def __init__(self, label_col: str = "label", prob_col: str = "prob"):
        super().__init__()
        self.label_col, self.prob_col = label_col, prob_col

    def _evaluate(self, dataset: DataFrame) -> float:
        if self.prob_col not in dataset.columns:
            dataset = positive_probability(dataset, self.prob_col)
        pts = M.curve_points(dataset.select(self.label_col, self.prob_col), self.label_col,
                             self.prob_col)
        v = M.areas(pts).collect()[0]["average_precision"]
        return float(v) if v is not None else float("nan")

    def isLargerBetter(self) -> bool:
        return True


# --------------------------------------------------------------------- search
def _weight_sum(df: DataFrame, params: Mapping) -> float:
    wcol = f"_w_{_cw_key(params.get('class_weight'))}"
    return float(df.agg(F.sum(wcol)).collect()[0][0] or 0.0)


#: Settings that do not change a fitted model: Spark's forests have no
#: ``min_samples_split``, and shared-pass regressions run until they settle.
_WITHOUT_EFFECT = {"rf": {"min_samples_split"}, "lr": {"max_iter", "solver", "penalty"}}


def effective(model: str, params: Mapping) -> str:
    """Candidates with equal keys fit the same model."""
    ignored = _WITHOUT_EFFECT.get(model, set())
    return json.dumps({k: v for k, v in params.items() if k not in ignored}, sort_keys=True, default=str)


class SearchState:
    """Scores of a search that outlive the driver: a Parquet table
    ``(run, candidate, fold, score)`` that is appended to after every fit.

    ``run`` names the search (model kind, table, folds); ``candidate`` is the key of
    :func:`effective`.  A search that finds scores of its run here does not fit those
    again, so a killed run goes on where it ended."""

    _SCHEMA = "run string, candidate string, fold int, score double"

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path, run
        self._one = threading.Lock()                # appends of one driver take turns

    def table(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], self._SCHEMA)
        return self.spark.read.schema(self._SCHEMA).parquet(self.path)

    def done(self) -> dict[tuple[str, int], float | None]:
        """Scores of this run so far (as many as the search has fits)."""
        rows = self.table().where(F.col("run") == self.run).groupBy("candidate", "fold").agg(F.max("score").alias("score"))
        return {(r["candidate"], r["fold"]): r["score"] for r in rows.collect()}

    def add(self, scores: Mapping[tuple[str, int], float | None]) -> None:
        rows = [(self.run, c, int(f), s) for (c, f), s in scores.items()]
        with self._one:
            self.spark.createDataFrame(rows, self._SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def fold_counts(df: DataFrame, fold_col: str, label_col: str) -> dict[int, dict[int, int]]:
    """Rows per fold and label: one small aggregate for all fits of a search."""
    out: dict[int, dict[int, int]] = {}
    for r in df.groupBy(F.col(fold_col).alias("f"), F.col(label_col).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect():
        out.setdefault(int(r["f"]), {})[int(r["y"])] = int(r["n"])
    return out


def training_weights(counts: Mapping, fold: int | None, class_weight) -> dict[int, float]:
    """T4 weights per label from the rows outside a fold (None: all rows)."""
    n: dict[int, int] = {}
    for f, by in counts.items():
        for y, k in by.items():
            n[y] = n.get(y, 0) + (k if f != fold else 0)
    n = {y: k for y, k in n.items() if k}
    if class_weight == "balanced":
        return {y: sum(n.values()) / (len(n) * k) for y, k in n.items()}
    given = dict(class_weight or {})
    return {y: float(given.get(y, 1.0)) for y in n}


def weighted(df: DataFrame, label_col: str, params: Mapping, counts: Mapping) -> tuple[DataFrame, float]:
    """``df`` with the weight column of one candidate (T4) and the sum of its weights, both
    from the rows per fold and label that are known already."""
    weights = training_weights(counts, None, params.get("class_weight"))
    out = df.withColumn(f"_w_{_cw_key(params.get('class_weight'))}", class_weight_column(df, label_col, weights))
    return out, sum(n * weights[y] for by in counts.values() for y, n in by.items() if n)


def cross_validate(df: DataFrame, model: str, candidates: Sequence[Mapping],
                   feature_cols: Sequence[str], label_col: str, fold_col: str = "fold",
                   scale_col: str | None = None, parallelism: int = 1,
                   state: SearchState | None = None, counts: Mapping | None = None,
                   in_tasks: bool = False) -> DataFrame:
    """Every candidate on every fold; the results table has
    ``candidate, params, split<i>_score…, mean_score, std_score (population), rank``.
    Class weights come from each training part.

    Logistic regressions of all candidates and folds are fitted in shared passes
    (:mod:`.shared_lr`) and scored in one.  Of other models every fit is a distributed
    job; ``parallelism`` > 1 submits that many from driver threads (as
    ``CrossValidator.parallelism`` does).  A model is scored as soon as it is fitted
    and then dropped, so at most ``parallelism`` are held.  With ``in_tasks`` forests and
    boosted trees are fitted one per task (:mod:`.task_trees`) as long as the table allows it.

    With ``state`` scores are kept as they come and known ones are not fitted again.
    ``counts`` are those of :func:`fold_counts`, if known."""
    if counts is None:
        counts = fold_counts(df, fold_col, label_col)
    folds = sorted(counts)
    keys = [effective(model, c) for c in candidates]
    first = {key: dict(c) for key, c in reversed(list(zip(keys, candidates)))}
    known = state.done() if state else {}
    todo = [(key, f) for key in dict.fromkeys(keys) for f in folds if (key, f) not in known]
    args = (df, first, todo, counts, feature_cols, label_col, fold_col, scale_col)
    if todo:
        if model == "lr":
            new = _search_lr(*args, state)
        else:
            new = _search_tasks(model, *args, state) if in_tasks else None
            new = _search_fits(model, *args, parallelism, state) if new is None else new
        known |= new
    value = lambda s: float("nan") if s is None else float(s)
    scores = {i: [value(known[key, f]) for f in folds] for i, key in enumerate(keys)}
    return results_table(df.sparkSession, candidates, scores, len(folds))


def _search_lr(df, first, todo, counts, feature_cols, label_col, fold_col, scale_col, state) -> dict:
    tasks = []
    for key, f in todo:
        if first[key].get("penalty", "l2") != "l2":
            raise ValueError("logistic regression has an l2 penalty only")
        by = training_weights(counts, f, first[key].get("class_weight"))
        tasks.append(shared_lr.Task(f, float(first[key].get("C", 1.0)), (by.get(0, 1.0), by.get(1, 1.0))))
    shared_lr.fit(df, tasks, feature_cols, label_col, fold_col, scale_col, counts)
    scored = shared_lr.scores(df, tasks, feature_cols, label_col, fold_col, scale_col)
    got = {r["model"]: r["average_precision"] for r in M.average_precision_by(scored, "model", "label", "prob").collect()}
    scores = {task: got.get(i) for i, task in enumerate(todo)}
    if state:
        state.add(scores)
    return scores


def _search_fits(model, df, first, todo, counts, feature_cols, label_col, fold_col, scale_col, parallelism, state) -> dict:
    def fit_and_score(task):
        key, f = task
        params = first[key]
        weights = training_weights(counts, f, params.get("class_weight"))
        train = df.where(F.col(fold_col) != f).withColumn(
            f"_w_{_cw_key(params.get('class_weight'))}", class_weight_column(df, label_col, weights))
        fitted = make_pipeline(model, params, feature_cols, label_col, scale_col).fit(train)
        held_out = positive_probability(fitted.transform(df.where(F.col(fold_col) == f)))
        score = M.average_precision_by(held_out.select(F.lit(f).alias("fold"), label_col, "prob"), "fold", label_col, "prob").first()
        score = score["average_precision"] if score else None
        if state:
            state.add({task: score})
        return task, score

    with ThreadPoolExecutor(max_workers=max(1, int(parallelism))) as pool:
        return dict(pool.map(fit_and_score, todo))


def tree_settings(model: str, params: Mapping, width: int, weights: Mapping[int, float], seed: int = SEED) -> task_trees.Fit:
    """The settings of :func:`make_classifier` for a fit within a task."""
    if model == "rf":
        trees = int(params.get("n_estimators", 100))
        return task_trees.Fit(
            False, trees, int(params.get("max_depth", 5)), float(params.get("max_samples", 1.0) or 1.0),
            task_trees.features_picked(_subset(params.get("max_features", "sqrt")), width, trees),
            int(params.get("min_samples_leaf", 1)), bool(params.get("bootstrap", True)),
            (weights.get(0, 1.0), weights.get(1, 1.0)), seed=seed)
    if model in ("xgb", "gbt"):
        return task_trees.Fit(
            True, int(params.get("n_estimators", 100)), int(params.get("max_depth", 3)), float(params.get("subsample", 1.0)),
            task_trees.features_picked(_subset(params.get("colsample_bytree", 1.0)), width, 1),
            step=float(params.get("learning_rate", 0.1)), seed=seed)
    raise ValueError(f"unknown model {model!r}")


def _search_tasks(model, df, first, todo, counts, feature_cols, label_col, fold_col, scale_col, state) -> dict | None:
    fits = {(key, f): tree_settings(model, first[key], len(feature_cols),
                                    training_weights(counts, f, first[key].get("class_weight"))) for key, f in todo}
    return task_trees.search(df, fits, feature_cols, label_col, fold_col, scale_col, state.add if state else None)


def fit_best(df: DataFrame, model: str, params: Mapping, feature_cols: Sequence[str], label_col: str, fold_col: str,
             scale_col: str | None, counts: Mapping, in_tasks: bool = False):
    """The pipeline of one candidate fitted on all rows (T11); of trees in tasks a
    :class:`.task_trees.Fitted`."""
    if in_tasks and model != "lr":
        fit = tree_settings(model, params, len(feature_cols), training_weights(counts, None, params.get("class_weight")))
        fitted = task_trees.fit_all(df, fit, make_classifier(model, params, None, "features", label_col),
                                    feature_cols, label_col, fold_col, scale_col)
        if fitted is not None:
            return fitted
    tr, ws = weighted(df.drop(fold_col), label_col, params, counts)     # weights of the training rows
    return make_pipeline(model, params, feature_cols, label_col, scale_col, ws if model == "lr" else None).fit(tr)


def results_table(spark: SparkSession, candidates: Sequence[Mapping], scores: Mapping[int, list],
                  n_folds: int) -> DataFrame:
    rows = []
    for i, params in enumerate(candidates):
        s = scores[i]
        rows.append((i, json.dumps(params, sort_keys=True, default=str), *[float(v) for v in s]))
    split_cols = [f"split{j}_score" for j in range(n_folds)]
    schema = "candidate int, params string, " + ", ".join(f"{c} double" for c in split_cols)
    t = spark.createDataFrame(rows, schema)
    arr = F.array(*[F.col(c) for c in split_cols])
    mean = F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / F.lit(float(n_folds))
    t = t.withColumn("mean_score", mean)
    var = F.aggregate(arr, F.lit(0.0), lambda a, v: a + (v - F.col("mean_score")) ** 2) / F.lit(float(n_folds))
    t = t.withColumn("std_score", F.sqrt(var))
    from pyspark.sql import Window
    # The candidate table has one row per candidate (bounded by the search size).
    w = Window.orderBy(F.col("mean_score").desc_nulls_last())
    return t.withColumn("rank", F.rank().over(w))


def best_candidate(results: DataFrame) -> int:
    """Index of the highest mean score, first candidate on ties."""
    r = results.orderBy(F.col("mean_score").desc_nulls_last(), F.col("candidate")).limit(1).collect()[0]
    return int(r["candidate"])
