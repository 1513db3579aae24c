"""Run by test_fault_tolerance: ranking, median and split under task retries.

Every first attempt of an even-numbered task fails (before and after the range
exchange); results must equal a clean reference computed with pandas."""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


def flaky(batches):
    ctx = TaskContext.get()
    if ctx.attemptNumber() == 0 and ctx.partitionId() % 2 == 0:
        raise RuntimeError("injected task failure")
    yield from batches


def main():
    spark = (SparkSession.builder.master("local[4,3]").appName("fault-injection")
             .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "6")
             .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veil-fi-"))
    from veilscore.operators.ranking import exact_medians, row_index
    from veilscore.operators.split import stratified_split

    rng = np.random.default_rng(5)
    n = 6000
    pdf = pd.DataFrame({"id": np.arange(n, dtype="int64"),
                        "g": rng.choice(["a", "b"], n, p=[0.8, 0.2]),
                        "v": rng.integers(0, 50, n).astype("float64"),
                        "y": (rng.random(n) < 0.1).astype("int32")})
    df = spark.createDataFrame(pdf).repartition(8).mapInPandas(flaky, "id long, g string, v double, y int")

    ranked = row_index(df, ["id"], ["g"], out="rn").mapInPandas(
        flaky, "id long, g string, v double, y int, rn long").toPandas()
    exp = pdf.sort_values(["g", "id"]).assign(rn=lambda d: d.groupby("g").cumcount() + 1)
    m = ranked.merge(exp, on=["g", "id"], suffixes=("", "_e"))
    assert len(m) == n and (m["rn"] == m["rn_e"]).all(), "ranks differ"

    long = df.selectExpr("g AS feature", "v AS value")
    med = {r["feature"]: r["median"] for r in exact_medians(long).collect()}
    assert med == {k: float(np.median(v)) for k, v in pdf.groupby("g")["v"]}, "medians differ"

    s = stratified_split(df, "y", "id", 0.2).toPandas()
    assert len(s) == n and s["id"].is_unique, "split lost or duplicated rows"
    print("FAULT-INJECTION-OK")


if __name__ == "__main__":
    main()
