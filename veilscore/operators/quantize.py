"""Q1/Q2: quantization of features and of a fitted linear model.

Q1 is the column rule ``round-half-up(x · s_x)`` (see
:func:`veilscore.functions.intcols.quantize`).  Q2 turns float coefficients into
an integer model: ``w_i = round(coef_i · s_w)`` and, since the score adds the
bias to Σ(x·s_x)(w·s_w), ``bias = round(intercept · s_w · s_x)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.intcols import quantize, quantize_array
from ..sources.model import LinearModel

__all__ = ["quantize", "quantize_array", "quantize_columns", "quantize_model",
           "quantize_coefficients"]


def quantize_columns(df: DataFrame, cols: Sequence[str], scale: float,
                     keep: Sequence[str] = ()) -> DataFrame:
    """Q1 on wide columns → int64 columns of the same names."""
    return df.select(*keep, *[quantize(c, scale).alias(c) for c in cols])


def quantize_coefficients(coef: DataFrame, scale: float, coef_col: str = "coef",
                          out: str = "w") -> DataFrame:
    """Q2 over a ``(feature_idx, coef)`` frame."""
    return coef.withColumn(out, quantize(coef_col, scale))


def _half_up(v: float) -> int:
    from decimal import ROUND_HALF_UP, Decimal
    return int(Decimal(repr(v)).quantize(Decimal(1), rounding=ROUND_HALF_UP))


def quantize_model(coefficients: Sequence[float], intercept: float, weight_scale: int = 1000,
                   feature_scale: float = 1.0, feature_names: Sequence[str] | None = None,
                   model_type: str = "LogisticRegression") -> LinearModel:
    """Q2 for a fitted model held by the driver (its width, not the data)."""
    w = tuple(_half_up(float(c) * weight_scale) for c in coefficients)
    b = _half_up(float(intercept) * weight_scale * feature_scale)
    return LinearModel(w, b, int(weight_scale), model_type,
                       tuple(feature_names) if feature_names else None, float(feature_scale))
