"""F7 — end-to-end preparation: join → label → roles → fit (median; mean/std
on imputed values; categories) → one projection + per-feature code joins.

The join is written once; three fit jobs, each a single shuffle; the apply is lazy.  Fitted parameters
are small frames (one row per feature / category) that can be written next to
the data (S8).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import OrdinalEncoder, fit_ordinal_encoder
from ..operators.impute import MedianImputer, fit_median_imputer, impute_constant
from ..operators.join import left_join
from ..operators.project import column_roles, label_int
from ..operators.ranking import written
from ..operators.scale import StandardScalerFit, fit_standard_scaler
from ..sources.publish import latest, publish


@dataclass
class FittedPrep:
    id_col: str
    label_col: str
    numeric: list[str]
    categorical: list[str]
    imputer: MedianImputer
    scaler: StandardScalerFit
    encoder: OrdinalEncoder
    fill: str

    @property
    def dropped(self) -> list[str]:
        return list(self.imputer.dropped)

    def transform(self, joined: DataFrame) -> DataFrame:
        """Apply to a joined frame: id, scaled numerics, codes and, if the frame has
        it, the label (R10 order)."""
        labelled = self.label_col in joined.columns
        nums = [c for c in self.numeric if c not in self.imputer.dropped]
        imputed = joined.select(
            F.col(self.id_col), *self.imputer.columns(joined, nums),
            *impute_constant(self.categorical, self.fill),
            *([label_int(self.label_col, joined).alias(self.label_col)] if labelled else []))
        scaled = imputed.select(F.col(self.id_col), *self.scaler.columns(nums),
                                *[F.col(c) for c in self.categorical],
                                *([F.col(self.label_col)] if labelled else []))
        return self.encoder.transform(scaled)

    def metadata(self, spark: SparkSession, prepared: DataFrame) -> DataFrame:
        """One-row metadata frame; the row count is a distributed count."""
        cols = len(prepared.columns)
        return prepared.agg(F.count(F.lit(1)).alias("n_rows")).select(
            "n_rows", F.lit(cols).cast("long").alias("n_columns"),
            F.lit(",".join(c for c in self.numeric if c not in self.dropped)).alias("numeric_cols"),
            F.lit(",".join(self.categorical)).alias("categorical_cols"),
            F.lit(",".join(self.dropped)).alias("dropped_cols"))

    def parameter_frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """Fitted parameters as tables."""
        return {"imputer": self.imputer.frame(spark), "scaler": self.scaler.frame(spark),
                "encoder": self.encoder.codes}

    def save(self, spark: SparkSession, path: str) -> None:
        """Parameter tables and a one-row spec, published as one version below
        ``path``: a save that stops half-way leaves the earlier version in place."""
        spec = spark.createDataFrame(
            [(self.id_col, self.label_col, self.numeric, self.categorical, self.fill)],
            "id_col string, label_col string, numeric array<string>, "
            "categorical array<string>, fill string")
        publish({**self.parameter_frames(spark), "spec": spec}, path, spark)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedPrep":
        """Read the newest version that :meth:`save` finished; parameters are one row per
        feature or category (the code table stays a DataFrame)."""
        at = latest(spark, path)
        spec = spark.read.parquet(at["spec"]).first()
        imp_rows = spark.read.parquet(at["imputer"]).collect()
        imputer = MedianImputer({r["feature"]: r["value"] for r in imp_rows if r["kind"] == "median"},
                                [r["feature"] for r in imp_rows if r["kind"] == "dropped"])
        scaler = StandardScalerFit({r["feature"]: (r["mean"], r["std"])
                                    for r in spark.read.parquet(at["scaler"]).collect()})
        encoder = OrdinalEncoder(spark.read.parquet(at["encoder"]), list(spec["categorical"]))
        return cls(spec["id_col"], spec["label_col"], list(spec["numeric"]), list(spec["categorical"]),
                   imputer, scaler, encoder, spec["fill"])


def prepare(tx: DataFrame, identity: DataFrame | None, key: str | Sequence[str], label_col: str,
            id_col: str | None = None, fill: str = "MISSING", null_safe: bool = False,
            exclude: Sequence[str] = ()) -> tuple[DataFrame, FittedPrep]:
    keys = [key] if isinstance(key, str) else list(key)
    joined = left_join(tx, identity, keys, null_safe=null_safe) if identity is not None else tx
    id_col = id_col or keys[0]
    excluded = {id_col, label_col, *keys, *exclude}
    numeric, categorical = column_roles(joined, excluded)
    if identity is not None:
        # Five passes read the joined rows (medians: two, moments, categories, result): they are joined once.
        used = [c for c in joined.columns if c in {id_col, label_col, *numeric, *categorical}]
        joined = written(joined.select(*used), "joined")
    imputer = fit_median_imputer(joined, numeric)
    kept = [c for c in numeric if c not in imputer.dropped]
    scaler = fit_standard_scaler(joined.select(*imputer.columns(joined, kept)), kept)
    encoder = fit_ordinal_encoder(joined.select(*impute_constant(categorical, fill)), categorical)
    fit = FittedPrep(id_col, label_col, numeric, categorical, imputer, scaler, encoder, fill)
    return fit.transform(joined), fit
