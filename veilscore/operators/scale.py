"""F4 standard scaling with the *population* standard deviation; F5 scale one
column and pass the rest through, as a Spark ML Estimator so that
cross-validation refits it inside every fold.

``pyspark.ml.feature.StandardScaler`` divides by the sample std — not used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class StandardScalerFit:
    stats: dict[str, tuple[float, float]]      # column → (mean, population std)

    def columns(self, cols: Sequence[str] | None = None) -> list[Column]:
        out = []
        for c in (cols or list(self.stats)):
            mean, std = self.stats[c]
            div = std if std not in (0.0, None) else 1.0
            out.append(((F.col(c).cast("double") - F.lit(mean)) / F.lit(div)).alias(c))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [F.col(c) for c in df.columns if c not in self.stats]
        return df.select(*keep, *self.columns())

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c, m, s) for c, (m, s) in self.stats.items()],
                                     "feature string, mean double, std double")


def fit_standard_scaler(df: DataFrame, cols: Sequence[str]) -> StandardScalerFit:
    """One aggregate pass (mean and population std of every column)."""
    cols = list(cols)
    if not cols:
        return StandardScalerFit({})
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m{i}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}")]
    r = df.agg(*aggs).collect()[0]
    return StandardScalerFit({c: (r[f"m{i}"], r[f"s{i}"] if r[f"s{i}"] is not None else 0.0)
                              for i, c in enumerate(cols)})


class ScalePassthrough(Estimator, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """z-score ``inputCol`` (population std), leave every other column as is."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "ScalePassthroughModel":
        c = self.getInputCol()
        fit = fit_standard_scaler(dataset, [c])
        mean, std = fit.stats[c]
        return ScalePassthroughModel(inputCol=c, mean=float(mean or 0.0), std=float(std or 0.0))


class ScalePassthroughModel(Model, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    mean = Param(Params._dummy(), "mean", "fitted mean", typeConverter=TypeConverters.toFloat)
    std = Param(Params._dummy(), "std", "fitted population std", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, mean: float = 0.0, std: float = 1.0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        c = self.getInputCol()
        std = self.getOrDefault(self.std)
        div = std if std != 0.0 else 1.0
        return dataset.withColumn(
            c, (F.col(c).cast("double") - F.lit(self.getOrDefault(self.mean))) / F.lit(div))
