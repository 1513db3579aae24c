"""Exact stratified hold-out, stratified k-fold (shuffled or in id
order) and class weights.

Class counts (one row per class) are the only values that reach the driver;
per-class quotas follow the allocation rules of the reference's splitter:

* hold-out: ``n_test = ceil(test_size·n)``; the training quota per class is the
  floor of its proportional share, the remaining rows go to the classes with
  the largest fractional parts (ties → lower class value); test = the rest;
* k-fold: the class-sorted row positions are dealt round-robin to folds, which
  fixes how many rows of each class every fold gets.

Which rows fill the quotas is decided by the seeded order ``(md5(seed:id), id)``
(or by id for the unshuffled variant): the keys at the quota ranks are exact
order statistics (:func:`keys_at_ranks`: the md5 key is uniform, so its digits are
counted per class, a few at a time, until few rows share the digits of a quota rank;
ids are ranked by their own order, whatever their type), and every
row is then assigned by comparing its key with them — one pass, no ranking of
whole classes and no copy of the table.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import keys_at_ranks, written

SEED = 42


def shuffle_key(id_col: str, seed: int = SEED) -> Column:
    """Seeded pseudo-random order key (same value in Spark and DuckDB)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


#: Most classes a label may have (class counts are held on the driver).
MAX_CLASSES = 10_000


def class_counts(df: DataFrame, label_col: str) -> list[tuple]:
    """(class, n) sorted by class, null first — a one-row-per-class aggregate; a
    missing label is a class like any other."""
    rows = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label_col} has more than {MAX_CLASSES} classes")
    return sorted(((r[label_col], int(r["n"])) for r in rows), key=lambda t: (t[0] is not None, t[0] if t[0] is not None else 0))


def holdout_quotas(counts: list[tuple], test_size: float = 0.2) -> dict:
    """Per-class test counts (see module docstring)."""
    n = sum(c for _, c in counts)
    if n == 0:
        return {}
    n_test = math.ceil(test_size * n) if isinstance(test_size, float) else int(test_size)
    n_train = n - n_test
    shares = [(lab, c, c * n_train / n) for lab, c in counts]
    train = {lab: math.floor(s) for lab, _, s in shares}
    left = n_train - sum(train.values())
    by_frac = sorted(shares, key=lambda t: (-(t[2] - math.floor(t[2])), counts.index((t[0], t[1]))))
    for lab, _, _ in by_frac[:left]:
        train[lab] += 1
    return {lab: c - train[lab] for lab, c in counts}


def fold_allocation(counts: list[tuple], k: int) -> dict:
    """Per-class rows in each of ``k`` folds (round-robin over class-sorted rows)."""
    out, start = {}, 0
    for lab, c in counts:
        def upto(x, i):  # positions p < x with p ≡ i (mod k)
            return (x - i + k - 1) // k if x > i else 0
        out[lab] = [upto(start + c, i) - upto(start, i) for i in range(k)]
        start += c
    return out


def _order(id_col: str, seed: int | None) -> list[Column]:
    if seed is None:
        return [F.col(id_col)]
    return [shuffle_key(id_col, seed).alias("k"), F.col(id_col).alias("id")]


def _boundaries(df: DataFrame, label_col: str, id_col: str, seed: int | None,
                ranks: dict) -> DataFrame:
    """Per class: array of the row keys at the requested ranks (≤ k per class)."""
    prefix = None if seed is None else shuffle_key(id_col, seed)
    th = keys_at_ranks(df, label_col, _order(id_col, seed), ranks, prefix)
    bounds = th.groupBy(label_col).agg(F.collect_list("key").alias("_bounds"))
    return written(bounds.withColumnRenamed(label_col, "_class"), "split-bounds")


def stratified_split(df: DataFrame, label_col: str, id_col: str, test_size: float = 0.2,
                     seed: int = SEED, out: str = "is_test") -> DataFrame:
    """Adds ``is_test`` (boolean); exact per-class sizes, seeded.

    A row is in the test part iff its key ``(md5(seed:id), id)`` is at most the
    key at rank ``n_test`` of its class — one exact order statistic per class."""
    counts = class_counts(df, label_col)
    quotas = holdout_quotas(counts, test_size)
    b = _boundaries(df, label_col, id_col, seed, {g: [q] for g, q in quotas.items() if q > 0})
    key = F.struct(*_order(id_col, seed))
    j = df.join(b, df[label_col].eqNullSafe(b["_class"]), "left").drop("_class")
    is_test = F.coalesce(F.exists(F.col("_bounds"), lambda t: key <= t), F.lit(False))
    return j.withColumn(out, is_test).drop("_bounds")


def stratified_folds(df: DataFrame, label_col: str, id_col: str, k: int, shuffle: bool = True,
                     seed: int = SEED, out: str = "fold") -> DataFrame:
    """T2 (shuffled) / T3 (``shuffle=False``: rows in id order): fold 0..k−1.

    The class-wise fold sizes fix k−1 boundary ranks per class; a row's fold is
    the number of boundary keys below its key."""
    counts = class_counts(df, label_col)
    alloc = fold_allocation(counts, k)
    ranks, zero = {}, {}
    for lab, per_fold in alloc.items():
        cum, acc = [], 0
        for a in per_fold[:-1]:
            acc += a
            cum.append(acc)
        ranks[lab] = [r for r in cum if r > 0]
        zero[lab] = sum(1 for r in cum if r == 0)        # empty leading folds
    use_seed = seed if shuffle else None
    b = _boundaries(df, label_col, id_col, use_seed, ranks)
    key = F.struct(*_order(id_col, use_seed))
    j = df.join(b, df[label_col].eqNullSafe(b["_class"]), "left").drop("_class")
    offset = F.lit(0)
    for lab, z in zero.items():
        if z:
            offset = F.when(F.col(label_col).eqNullSafe(F.lit(lab)), F.lit(z)).otherwise(offset)
    # The key is bound to a variable: named inside the filter it would be hashed once per bound.
    below = F.coalesce(F.transform(F.array(key), lambda own: F.size(F.filter(F.col("_bounds"), lambda t: t < own)))[0],
                       F.lit(0))
    return j.withColumn(out, (below + offset).cast("int")).drop("_bounds")


def class_weight_column(df: DataFrame, label_col: str,
                        class_weight: str | Mapping | None = "balanced") -> Column:
    """T4: ``"balanced"`` → n / (k · n_c); a mapping → its value (1.0 if absent);
    None → 1.0."""
    if class_weight is None:
        return F.lit(1.0)
    if class_weight == "balanced":
        counts = class_counts(df, label_col)
        n, k = sum(c for _, c in counts), len(counts)
        weights = {lab: n / (k * c) for lab, c in counts}
    else:
        weights = {lab: float(w) for lab, w in dict(class_weight).items()}
    expr = F.lit(1.0)
    for lab, w in weights.items():
        expr = F.when(F.col(label_col).eqNullSafe(F.lit(lab)), F.lit(float(w))).otherwise(expr)
    return expr
