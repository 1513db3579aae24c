"""Logistic regressions of many candidates and folds in shared passes.

Every model minimises ``sum w_i loss_i + 1/(2C) |b|^2`` (intercept not penalised)
over the rows outside its fold.  All models take Newton steps together: one job per
iteration scans the rows once, every task adds up loss, gradient and Hessian of all
models in Arrow batches, the partial sums are added per (model, block) after one
small shuffle, and the driver solves one system per model.  A model that has
settled drops out of the scan.

The driver and a task hold ``models x width^2`` numbers, so models are taken in
groups of at most ``STATE_BYTES``; the rows are never gathered.  Models run until
they settle, whatever a candidate's iteration limit; an unsettled model is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of Hessians that are summed at a time, and numbers in a shuffled block.
STATE_BYTES = 64 << 20
BLOCK = 1 << 15
MAX_STEPS = 200
_TOLERANCE = 1e-13


@dataclass
class Task:
    """One model: trained on all folds but ``fold``, tested on ``fold``."""
    fold: int
    c: float
    weights: tuple[float, float]         # of label 0 and 1
    mean: float = 0.0                    # of the scaled column in the training part
    std: float = 1.0
    beta: np.ndarray | None = None       # coefficients, then the intercept


def _design(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folds, labels, features with a last column of ones)."""
    columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
    x = np.column_stack([*columns[2:], np.ones(batch.num_rows)]).astype(np.float64)
    if not np.isfinite(x).all():
        raise ValueError("features hold missing or infinite values")
    return columns[0], columns[1].astype(np.float64), x


def _scaled(x: np.ndarray, at: int | None, task: Task) -> np.ndarray:
    if at is None:
        return x
    x = x.copy()
    x[:, at] = (x[:, at] - task.mean) / task.std
    return x


def _sums(tasks: Sequence[Task], at: int | None):
    """mapInArrow function: loss, gradient and Hessian of every model, in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, y, x = _design(batch)
            if total is None:
                total = [np.zeros(1 + x.shape[1] * (x.shape[1] + 1)) for _ in tasks]
            for out in sorted({t.fold for t in tasks}):
                rows = fold != out
                mine = [(i, t) for i, t in enumerate(tasks) if t.fold == out]
                part, label = _scaled(x[rows], at, mine[0][1]), y[rows]
                for i, t in mine:
                    z = part @ t.beta
                    p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                    w = np.where(label > 0, t.weights[1], t.weights[0])
                    total[i][0] += np.sum(w * (np.logaddexp(0.0, z) - label * z))
                    d = len(t.beta)
                    total[i][1:1 + d] += part.T @ (w * (p - label))
                    total[i][1 + d:] += ((part * (w * p * (1 - p))[:, None]).T @ part).ravel()
        for i, sums in enumerate(total or []):
            for b in range(0, len(sums), BLOCK):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([b], pa.int32()), pa.array([sums[b:b + BLOCK].tobytes()], pa.binary())],
                    ["model", "block", "sums"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for model, block, sums in zip(*(c.to_pylist() for c in batch.columns)):
            part = np.frombuffer(sums)
            total[model, block] = total[model, block] + part if (model, block) in total else part
    for (model, block), sums in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([model], pa.int32()), pa.array([block], pa.int32()), pa.array([sums.tobytes()], pa.binary())],
            ["model", "block", "sums"])


def _scan(rows: DataFrame, tasks: Sequence[Task], at: int | None) -> list[np.ndarray]:
    schema = "model int, block int, sums binary"
    parts: dict[int, dict[int, bytes]] = {i: {} for i in range(len(tasks))}
    for r in (rows.mapInArrow(_sums(tasks, at), schema).repartition("model", "block")
              .mapInArrow(_added, schema).collect()):          # at most STATE_BYTES
        parts[r["model"]][r["block"]] = r["sums"]
    return [np.frombuffer(b"".join(p[b] for b in sorted(p))) for p in parts.values()]


def _newton(rows: DataFrame, tasks: list[Task], at: int | None, width: int) -> None:
    """Newton steps with halving, all open models in one scan per step."""
    d = width + 1
    last: dict[int, tuple[float, np.ndarray]] = {}
    open_ = list(range(len(tasks)))
    for _ in range(MAX_STEPS):
        if not open_:
            return
        still = []
        for i, sums in zip(open_, _scan(rows, [tasks[i] for i in open_], at)):
            t = tasks[i]
            slopes = np.append(np.full(width, 1.0 / t.c), 0.0)
            loss = sums[0] + 0.5 * float(slopes @ t.beta ** 2)
            if i in last and loss > last[i][0] + 1e-12 * (1 + abs(last[i][0])):
                t.beta = (last[i][1] + t.beta) / 2
                still.append(i)
                continue
            gradient = sums[1:1 + d] + slopes * t.beta
            hessian = sums[1 + d:].reshape(d, d) + np.diag(slopes)
            step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            last[i] = (loss, t.beta)
            t.beta = t.beta - step
            if gradient @ step > _TOLERANCE * (1 + abs(loss)):
                still.append(i)
        open_ = still
    raise RuntimeError(f"{len(open_)} logistic regressions have not settled after {MAX_STEPS} steps")


def fit(df: DataFrame, tasks: list[Task], feature_cols: Sequence[str], label_col: str, fold_col: str,
        scale_col: str | None, counts: dict) -> list[Task]:
    """``tasks`` with ``beta``.  ``counts``: fold -> label -> rows.  A training part of
    one class only gives its label with certainty."""
    cols = list(feature_cols)
    rows = df.select(F.col(fold_col).cast("int"), F.col(label_col).cast("double"), *[F.col(c).cast("double") for c in cols])
    at = cols.index(scale_col) if scale_col else None
    if scale_col:
        _fold_scalers(df, tasks, scale_col, fold_col)
    ready = []
    for t in tasks:
        seen = {lab for f, by in counts.items() if f != t.fold for lab, n in by.items() if n}
        t.beta = np.zeros(len(cols) + 1)
        if len(seen) < 2:
            t.beta[-1] = np.inf if seen == {1} else -np.inf
        else:
            ready.append(t)
    size = max(1, STATE_BYTES // (8 * (len(cols) + 1) * (len(cols) + 2)))
    for first in range(0, len(ready), size):
        _newton(rows, ready[first:first + size], at, len(cols))
    return tasks


def _fold_scalers(df: DataFrame, tasks: list[Task], scale_col: str, fold_col: str) -> None:
    """Mean and population deviation outside every fold, from one aggregate per fold."""
    x = F.col(scale_col).cast("double")
    by = {r["fold"]: (r["n"], r["mean"], r["var"] * r["n"]) for r in df.groupBy(F.col(fold_col).alias("fold")).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var")).collect() if r["n"]}
    for t in tasks:
        n, mean, m2 = 0, 0.0, 0.0
        for f, (k, other, more) in sorted(by.items()):
            if f != t.fold:
                gap = other - mean
                m2 += more + gap * gap * n * k / (n + k)
                mean += gap * k / (n + k)
                n += k
        std = (m2 / n) ** 0.5 if n else 0.0
        t.mean, t.std = mean, std if std != 0.0 else 1.0


def scores(df: DataFrame, tasks: Sequence[Task], feature_cols: Sequence[str], label_col: str, fold_col: str,
           scale_col: str | None) -> DataFrame:
    """``(model, label, prob)``: every row under every model that was not trained on it."""
    cols = list(feature_cols)
    at = cols.index(scale_col) if scale_col else None
    rows = df.select(F.col(fold_col).cast("int"), F.col(label_col).cast("double"), *[F.col(c).cast("double") for c in cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, y, x = _design(batch)
            for i, t in enumerate(tasks):
                own = fold == t.fold
                z = _scaled(x[own], at, t) @ t.beta
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(p), i, np.int32)), pa.array(y[own].astype(np.int32)), pa.array(p)],
                    ["model", "label", "prob"])

    return rows.mapInArrow(run, "model int, label int, prob double")
