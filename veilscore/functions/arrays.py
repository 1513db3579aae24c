"""Positional dot products over array columns (P1, P1w, P2, R7, R13).

The model is a parameter of the plan (a handful of integers per feature), so
weights are written into the expression; only *non-zero* weights are visited
(zero-weight skipping), and a row that is shorter than the model contributes
only its first ``size(x)`` features (positional zip, shorter side wins).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intcols import DEC64, DEC128, TWO_64, dec_lit, wrap_to_int64


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _weights_array(weights: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(w)).cast("long") for w in weights]) if weights else \
        F.array().cast("array<bigint>")


def width_guard(x: Column | str, width: int, strict: bool) -> Column:
    """Strict mode: raise unless every row has exactly ``width`` features."""
    x = _col(x)
    if not strict:
        return x
    return F.when(F.size(x) == F.lit(width), x).otherwise(
        F.raise_error(F.concat(F.lit("feature width mismatch: row has "),
                               F.size(x).cast("string"),
                               F.lit(f" features, model has {width}"))))


# Array arguments of zip_with/aggregate are evaluated once per row; a column
# referenced *inside* a lambda body would be re-evaluated for every element once
# Catalyst inlines its producing expression (e.g. a quantization or a sealing
# transform).  All dot products below therefore pass the row array as an
# argument and never reference it from a lambda.
def dot(x: Column | str, weights: Sequence[int], bias: int = 0, strict: bool = False) -> Column:
    """Σ x[i]·w[i] + bias in int64; null cells count as 0; positional zip
    where the shorter side wins (R13); ANSI raises on overflow."""
    x = width_guard(x, len(weights), strict)
    terms = F.zip_with(x, _weights_array(weights),
                       lambda a, b: F.coalesce(a * b, F.lit(0).cast("long")))
    return F.aggregate(terms, F.lit(int(bias)).cast("long"), lambda acc, t: acc + t)


def dot_wrapping(x: Column | str, weights: Sequence[int], bias: int = 0) -> Column:
    """P1w: the same score in two's-complement int64 arithmetic (wraps mod 2^64)."""
    acc = _dot_mod(x, weights, F.pmod(F.lit(int(bias)).cast(DEC64), dec_lit(TWO_64)))
    return wrap_to_int64(acc)


def dot_unsigned(x: Column | str, weights: Sequence[int]) -> Column:
    """Unsigned dot product mod 2^64, no bias; result decimal(20,0) in [0, 2^64).
    ``x`` holds int64 values that are reinterpreted as uint64 (R6)."""
    return _dot_mod(x, weights, F.lit(0).cast(DEC64))


def _dot_mod(x: Column | str, weights: Sequence[int], start: Column) -> Column:
    m128 = dec_lit(TWO_64, DEC128)
    zero = F.lit(0).cast(DEC128)
    terms = F.zip_with(_col(x), _weights_array(weights), lambda a, b: F.coalesce(
        F.pmod(a.cast(DEC64).cast(DEC128) * b.cast(DEC64).cast(DEC128), m128), zero))
    return F.aggregate(terms, start.cast(DEC64),
                       lambda acc, t: F.pmod((acc.cast(DEC128) + t).cast(DEC128), m128).cast(DEC64))


def prefix(x: Column | str, k: int) -> Column:
    """The first ``k`` features of each row (positional)."""
    return F.slice(_col(x), 1, k)


def sigmoid_of_score(score: Column | str, scale: float) -> Column:
    """P4 for an integer model: 1 / (1 + exp(-score / scale))."""
    s = _col(score).cast("double") / F.lit(float(scale))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-s))


def balanced_sum(cols: Sequence[Column]) -> Column:
    """Sum of many columns as a balanced tree (a left-deep chain of hundreds of
    ``+`` overflows the analyzer's stack)."""
    cols = list(cols)
    if not cols:
        return F.lit(0).cast("long")
    while len(cols) > 1:
        nxt = [cols[i] + cols[i + 1] for i in range(0, len(cols) - 1, 2)]
        if len(cols) % 2:
            nxt.append(cols[-1])
        cols = nxt
    return cols[0]
