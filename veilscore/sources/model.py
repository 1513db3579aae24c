"""S3 — integer linear model files.

A model is a parameter of the scoring plan (one integer per feature), so it is
read once as a one-row frame and held on the driver as a small value object.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MODEL_SCHEMA = T.StructType([
    T.StructField("model_type", T.StringType()),
    T.StructField("scale_factor", T.LongType()),
    T.StructField("bias", T.LongType()),
    T.StructField("weights", T.ArrayType(T.LongType())),
    T.StructField("feature_count", T.LongType()),
    T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("feature_scale", T.DoubleType()),
])

# Test model for the 64-wide `embeddings` table: weights of either sign from a rule.
TEST_MODEL_WEIGHTS_64 = tuple(((i * 37) % 143) - 71 for i in range(64))
TEST_MODEL_BIAS = -2
TEST_MODEL_SCALE = 1000
# Feature quantization scale used with the test model (Q1).
TEST_FEATURE_SCALE = 1000


@dataclass(frozen=True)
class LinearModel:
    """Integer linear model: score = Σ x_i·w_i + bias (positional)."""

    weights: tuple[int, ...]
    bias: int = 0
    scale_factor: int = 1
    model_type: str = "LogisticRegression"
    feature_names: tuple[str, ...] | None = None
    feature_scale: float = 1.0
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def feature_count(self) -> int:
        return len(self.weights)

    @property
    def probability_scale(self) -> float:
        """Divisor that turns an integer score back into the logit (s_w · s_x)."""
        return float(self.scale_factor) * float(self.feature_scale)

    def truncated(self, k: int) -> "LinearModel":
        """The model restricted to its first ``k`` features."""
        names = self.feature_names[:k] if self.feature_names else None
        return LinearModel(tuple(self.weights[:k]), self.bias, self.scale_factor,
                           self.model_type, names, self.feature_scale)

    def to_json(self) -> str:
        body = {"model_type": self.model_type, "scale_factor": self.scale_factor,
                "bias": self.bias, "weights": list(self.weights),
                "feature_count": self.feature_count}
        if self.feature_names:
            body["feature_names"] = list(self.feature_names)
        if self.feature_scale != 1.0:
            body["feature_scale"] = self.feature_scale
        return json.dumps(body)


def sample_model() -> LinearModel:
    return LinearModel(TEST_MODEL_WEIGHTS_64, TEST_MODEL_BIAS, TEST_MODEL_SCALE,
                       feature_scale=TEST_FEATURE_SCALE)


def model_frame(spark: SparkSession, path: str) -> DataFrame:
    """The model file as a one-row frame (extra keys ignored)."""
    return spark.read.schema(MODEL_SCHEMA).option("multiLine", "true").json(path)


def load_model(spark: SparkSession, path: str) -> LinearModel:
    """S3: read a model file; a missing file or missing bias/weights is an error
    that names the path."""
    try:
        rows = model_frame(spark, path).take(2)
    except Exception as exc:  # noqa: BLE001
        raise FileNotFoundError(f"failed to open model weights at {path}: {exc}") from exc
    if len(rows) != 1:
        raise ValueError(f"model file {path} must hold exactly one JSON object")
    r = rows[0]
    if r["bias"] is None or r["weights"] is None or any(w is None for w in r["weights"]):
        raise ValueError(f"model file {path} lacks an integer 'bias' or 'weights'")
    names = tuple(r["feature_names"]) if r["feature_names"] else None
    return LinearModel(tuple(int(w) for w in r["weights"]), int(r["bias"]),
                       int(r["scale_factor"] or 1), r["model_type"] or "LogisticRegression",
                       names, float(r["feature_scale"] or 1.0))


def save_model(spark: SparkSession, model: LinearModel, path: str) -> None:
    """Write a model as a one-object JSON text table with Spark (any file system
    the cluster sees; overwrites)."""
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)
