"""Contract checks, score verification, stage status and the
time/cost columns of the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Hourly machine price used for the cost column (USD per hour).
HOURLY_COST_USD = 0.78

_INT = r"^-?[0-9]+$"


def verify(df: DataFrame, got: str = "got", expected: str = "expected") -> DataFrame:
    """V2/V3: ``(n_rows, n_match, status)``; PASS iff every row matches exactly
    (``<=>``: a missing score on either side is a mismatch)."""
    match = (F.col(got).eqNullSafe(F.col(expected)) & F.col(got).isNotNull()).cast("long")
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(match), F.lit(0)).alias("n_match"))
    return agg.withColumn("status", F.when(F.col("n_match") == F.col("n_rows"), "PASS")
                          .otherwise("FAIL"))


def verify_counts(inputs: DataFrame, checked: DataFrame, match_col: str = "match") -> DataFrame:
    """V2/V3 without a join: ``n_rows`` = rows of ``inputs``, ``n_match`` = rows
    of ``checked`` whose ``match_col`` is true; PASS iff equal (a row lost on the
    way is a failure).  One aggregation over the union of both."""
    a = inputs.select(F.lit(1).alias("_in"), F.lit(0).alias("_ok"))
    b = checked.select(F.lit(0).alias("_in"),
                       F.coalesce(F.col(match_col), F.lit(False)).cast("int").alias("_ok"))
    agg = a.unionByName(b).agg(F.coalesce(F.sum("_in"), F.lit(0)).cast("long").alias("n_rows"),
                               F.coalesce(F.sum("_ok"), F.lit(0)).cast("long").alias("n_match"))
    return agg.withColumn("status", F.when(F.col("n_match") == F.col("n_rows"), "PASS")
                          .otherwise("FAIL"))


def cost_columns(df: DataFrame, seconds: str = "seconds", rows: str = "rows") -> DataFrame:
    """V4/V6: rows per second and machine cost of each timed stage (2 and 6 dp)."""
    s = F.col(seconds)
    return df.withColumn("rows_per_sec", F.round(F.when(s > 0, F.col(rows) / s), 2)) \
        .withColumn("cost_usd", F.round(F.lit(HOURLY_COST_USD / 3600.0) * s, 6)) \
        .withColumn(seconds, F.round(s, 2))


def model_contract(spark: SparkSession, path: str, max_abs_feature: int = 2 ** 20) -> DataFrame:
    """V1: ``(check, ok, detail)`` rows for a model file: exists, parses, has
    integer ``bias`` and a list of integer ``weights``, ``feature_count`` (if
    present) equals the number of weights, and scores of features up to
    ``max_abs_feature`` stay below 2^47 (what sealed scoring can open)."""
    from pyspark.errors import AnalysisException

    try:
        text = spark.read.text(path, wholetext=True)
        rows = text.take(1)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        rows = []
    if not rows:
        return spark.createDataFrame([("exists", False, f"file not found: {path}")],
                                     "check string, ok boolean, detail string")
    v = F.col("value")
    raw = F.from_json(v, "map<string,string>")
    weights = F.from_json(raw["weights"], "array<string>")
    checks = text.select(
        F.lit(True).alias("exists"),
        raw.isNotNull().alias("parses"),
        raw["bias"].isNotNull().alias("has_bias"),
        raw["weights"].isNotNull().alias("has_weights"),
        F.coalesce(raw["bias"].rlike(_INT), F.lit(False)).alias("bias_int"),
        F.coalesce(F.forall(weights, lambda x: x.rlike(_INT)), F.lit(False)).alias("weights_int"),
        F.size(weights).alias("n_weights"),
        F.aggregate(F.transform(weights, lambda x: F.abs(x.try_cast("double"))),
                    F.abs(raw["bias"].try_cast("double")),
                    lambda a, w: a + w * F.lit(float(max_abs_feature))).alias("reach"),
        raw["feature_count"].alias("feature_count"))
    return checks.select(F.explode(F.array(
        *[F.struct(F.lit(n).alias("check"), F.col(n).alias("ok"),
                   F.lit(d).alias("detail")) for n, d in [
            ("exists", path), ("parses", "valid JSON object"), ("has_bias", "key 'bias'"),
            ("has_weights", "key 'weights'"), ("bias_int", "bias is an integer"),
            ("weights_int", "weights is a list of integers")]],
        F.struct(F.lit("feature_count").alias("check"),
                 (F.col("parses") & (F.col("feature_count").isNull() | F.coalesce(
                     F.col("feature_count").try_cast("long") == F.col("n_weights"), F.lit(False)))).alias("ok"),
                 F.concat(F.lit("weights: "), F.col("n_weights").cast("string")).alias("detail")),
        F.struct(F.lit("headroom").alias("check"),
                 F.coalesce(F.col("reach") < F.lit(2.0 ** 47), F.lit(False)).alias("ok"),
                 F.concat(F.lit("largest score: "), F.col("reach").cast("string")).alias("detail"))
    )).alias("c")).select("c.*")
