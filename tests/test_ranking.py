import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilscore.operators.ranking import exact_medians, row_index, running_totals


def test_running_totals_matches_pandas(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]),
                        "k": rng.permutation(n).astype("int64"),
                        "v": rng.integers(0, 10, n).astype("int64")})
    df = spark.createDataFrame(pdf)
    got = running_totals(df, ["k"], ["g"], {"cv": "v"}, count_col="rn", num_partitions=7).toPandas()
    exp = pdf.sort_values(["g", "k"]).copy()
    exp["rn"] = exp.groupby("g").cumcount() + 1
    exp["cv"] = exp.groupby("g")["v"].cumsum()
    m = got.merge(exp, on=["g", "k"], suffixes=("", "_e"))
    assert len(m) == n
    assert (m["rn"] == m["rn_e"]).all() and (m["cv"] == m["cv_e"]).all()


def test_row_index_descending_no_groups(spark):
    df = spark.range(100).withColumn("s", F.col("id") * 3)
    got = {r["id"]: r["rn"] for r in row_index(df, [F.col("s").desc()]).collect()}
    assert got[99] == 1 and got[0] == 100


def test_exact_medians_fixtures(spark):
    # median_even: 1, 2, 10, 20, null -> 6.0 ; median_nan: 1, 2, NaN -> 1.5
    rows = [("even", v) for v in (1.0, 2.0, 10.0, 20.0, None)] + \
           [("nan", v) for v in (1.0, 2.0, float("nan"))] + [("odd", v) for v in (3.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "feature string, value double")
    got = {r["feature"]: r["median"] for r in exact_medians(df).collect()}
    assert got == {"even": 6.0, "nan": 1.5, "odd": 2.0}


def test_exact_median_heavy_duplicates_matches_numpy(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([np.full(4000, 5.0), rng.normal(size=2001)])
    df = spark.createDataFrame(pd.DataFrame({"feature": "f", "value": vals}))
    got = exact_medians(df).first()["median"]
    assert got == float(np.median(vals))


def test_hot_order_key_is_split_and_exact(spark):
    # a third of the rows share one order key in one group
    n = 3000
    rows = [("g", 7 if i % 3 == 0 else i, 1, i) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, v long, id long")
    got = running_totals(df, ["k"], ["g"], {"cv": "v"}, count_col="rn", num_partitions=6)
    r = got.select("rn", "cv").collect()
    assert sorted(x["rn"] for x in r) == list(range(1, n + 1))
    assert all(x["rn"] == x["cv"] for x in r)
    # the hot key's rows are spread over several range partitions
    from pyspark.sql import functions as F
    parts = (df.withColumn("_tb", F.xxhash64("g", "k", "v", "id"))
             .repartitionByRange(6, "g", "k", "_tb").where("k = 7")
             .select(F.spark_partition_id().alias("p")).distinct().count())
    assert parts >= 2


def test_median_with_any_number_of_bins(spark):
    rng = np.random.default_rng(11)
    parts = []
    for g, (n, kind) in enumerate([(1001, "normal"), (1000, "ties"), (7, "small"), (2, "two"), (600, "skew")]):
        if kind == "normal":
            v = rng.normal(size=n)
        elif kind == "ties":
            v = rng.integers(0, 3, n).astype(float)
        elif kind == "skew":
            v = np.concatenate([np.zeros(n // 3 * 2), rng.exponential(size=n - n // 3 * 2)])
        else:
            v = rng.normal(size=n)
        parts.append(pd.DataFrame({"feature": f"g{g}", "value": v}))
    pdf = pd.concat(parts)
    df = spark.createDataFrame(pdf)
    expected = {k: float(np.median(v)) for k, v in pdf.groupby("feature")["value"]}
    for bins in (2, 16, 4096):
        got = {r["feature"]: r["median"] for r in exact_medians(df, bins=bins).collect()}
        assert got == expected, bins


def test_median_of_extreme_values(spark):
    inf = float("inf")
    rows = [("wide", v) for v in (-1.7e308, 1.7e308, 5.0, 1e-300, 7.0)] + \
           [("inf", v) for v in (-inf, inf, 1.0, 2.0, 3.0)] + [("zero", v) for v in (-0.0, 0.0, 0.0)] + \
           [("two", v) for v in (4.0, 4.0)]
    got = {r["feature"]: r["median"] for r in exact_medians(
        spark.createDataFrame(rows, "feature string, value double"), bins=8).collect()}
    assert got == {"wide": 5.0, "inf": 2.0, "zero": 0.0, "two": 4.0}


def test_median_of_many_columns(spark):
    from veilscore.operators.impute import fit_median_imputer
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(400, 433)), columns=[f"c{i}" for i in range(433)])
    got = fit_median_imputer(spark.createDataFrame(pdf), list(pdf.columns)).medians
    assert got == {c: float(np.median(pdf[c])) for c in pdf.columns}


def _keys_reference(pdf, ranks):
    out = {}
    for g, sub in pdf.sort_values(["g", "h", "id"]).groupby("g"):
        ids = sub["id"].tolist()
        out[g] = [ids[r - 1] for r in ranks[g]]
    return out


def test_keys_at_ranks_exact(spark):
    from veilscore.operators.ranking import keys_at_ranks
    rng = np.random.default_rng(2)
    n = 20000
    pdf = pd.DataFrame({"id": np.arange(n), "g": rng.choice(["a", "b", "c"], n, p=[0.7, 0.25, 0.05]),
                        "h": rng.integers(0, 500, n).astype(float)})     # heavy ties in h
    sizes = pdf.groupby("g").size().to_dict()
    ranks = {g: [1, max(1, s // 3), s // 2, s] for g, s in sizes.items()}
    df = spark.createDataFrame(pdf)
    exp = _keys_reference(pdf, ranks)
    for prefix in (None, F.floor(F.col("h") / 50), F.lit(0)):
        by = {}
        for r in keys_at_ranks(df, "g", [F.col("h"), F.col("id")], ranks, prefix).collect():
            by.setdefault(r["g"], {})[r["j"]] = r["key"]["id"]
        assert {g: [by[g][j] for j in range(len(ranks[g]))] for g in by} == exp


def test_keys_at_ranks_with_null_keys_and_groups(spark):
    from veilscore.operators.ranking import keys_at_ranks
    rows = [(None, None if i < 5 else float(i), f"id{i:02d}") for i in range(40)]
    df = spark.createDataFrame(rows, "g string, h double, id string")
    for prefix in (None, F.col("h")):
        got = keys_at_ranks(df, "g", [F.col("h"), F.col("id")], {None: [3, 6, 40]}, prefix)
        by = {r["j"]: (r["key"]["h"], r["key"]["id"]) for r in got.collect()}
        # Spark order: the five null-h rows first (by id), then h = 5..39
        assert by == {0: (None, "id02"), 1: (5.0, "id05"), 2: (39.0, "id39")}


def test_split_with_null_labels_and_string_ids(spark):
    from veilscore.operators.split import class_weight_column, stratified_folds, stratified_split
    df = spark.createDataFrame([(f"x{i:03d}", None if i % 4 == 0 else i % 2) for i in range(100)],
                               "id string, y int")
    split = stratified_split(df, "y", "id", 0.2).groupBy("y", "is_test").count().collect()
    assert {(r["y"], r["is_test"]): r["count"] for r in split} == {
        (None, True): 5, (None, False): 20, (0, True): 5, (0, False): 20, (1, True): 10, (1, False): 40}
    for shuffle in (True, False):
        folds = stratified_folds(df, "y", "id", 5, shuffle).groupBy("y", "fold").count().collect()
        assert {r["count"] for r in folds if r["y"] is None} == {5} and len(folds) == 15
    in_order = [r["fold"] for r in stratified_folds(df, "y", "id", 5, False).where("y is null").orderBy("id").collect()]
    assert in_order == sorted(in_order)
    w = df.select(class_weight_column(df, "y").alias("w")).where("w = 1.0").count()
    assert w == 0


@pytest.mark.parametrize("limit", [1, 5, 60])
def test_keys_at_ranks_narrows_digit_by_digit(spark, monkeypatch, limit):
    """Rounds go on until few rows share the digits; copies of one key, however many,
    and a class with all rows give the same keys as sorting everything."""
    import hashlib
    from veilscore.operators import ranking as R
    monkeypatch.setattr(R, "BUCKET_ROWS", limit)
    rows = [(0, i % 150 if i < 700 else 7, None) for i in range(900)]
    rows = [(g, i, hashlib.md5(str(i).encode()).hexdigest()) for g, i, _ in rows] + [(None, 1, None), (None, 2, "00")]
    df = spark.createDataFrame(rows, "g int, id long, h string")
    ranks = {0: [1, 2, 450, 451, 600, 899, 900], None: [1, 2]}
    got = {(r["g"], r["rank"]): (r["key"]["h"], r["key"]["id"]) for r in R.keys_at_ranks(
        df, "g", [F.col("h"), F.col("id")], ranks, F.col("h")).collect()}
    for g, wanted in ranks.items():
        own = sorted(((h, i) for x, i, h in rows if x == g), key=lambda k: (k[0] is not None, k[0] or "", k[1]))
        assert [got[g, r] for r in wanted] == [own[r - 1] for r in wanted]


def test_column_medians_match_numpy(spark):
    from veilscore.operators.impute import fit_median_imputer
    from veilscore.operators.ranking import column_medians
    rng = np.random.default_rng(5)
    n = 20_000
    cols = {"u": rng.random(n), "ties": rng.integers(0, 3, n).astype(float), "one": np.full(n, 7.0),
            "heavy": np.where(rng.random(n) < 0.4, 1.0, rng.normal(size=n)), "tail": np.exp(rng.normal(size=n) * 20)}
    pdf = pd.DataFrame(cols)
    pdf["inf"] = np.where(np.arange(n) % 2 == 0, np.inf, 1.0)
    pdf.loc[::3, "u"] = np.nan
    pdf["none"] = np.nan
    df = spark.createDataFrame(pdf).repartition(8)
    names = list(pdf.columns)
    want = {c: float(np.median(pdf[c].dropna())) for c in names if c != "none"}
    assert column_medians(df, names) == (want, [])
    # A bracket that misses (here to one side) is found out and counted bin by bin.
    got, missed = column_medians(df, names, margin=-200)
    assert "u" in missed and all(got[c] == want[c] for c in got)
    fit = fit_median_imputer(df, names)
    assert fit.medians == want and fit.dropped == ["none"]


def test_column_medians_small_and_empty(spark):
    from veilscore.operators.ranking import column_medians
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (float("nan"), None)], "`a.b` double, c double")
    assert column_medians(df, ["a.b", "c"]) == ({"a.b": 1.5, "c": 5.0}, [])
    assert column_medians(df.where("false"), ["a.b", "c"]) == ({}, [])
