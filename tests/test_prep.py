import math

import pytest
from pyspark.sql import functions as F

from veilscore.operators.encode import fit_ordinal_encoder
from veilscore.operators.impute import fit_median_imputer, impute_constant
from veilscore.operators.join import left_join
from veilscore.operators.project import batch_slices, column_roles, label_int, table_shape
from veilscore.operators.scale import ScalePassthrough, fit_standard_scaler
from veilscore.plans.prepare import prepare
from veilscore.sources.csv import NA_TOKENS, read_csv_na


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,)], "v double")
    fit = fit_standard_scaler(df, ["v"])
    assert math.isclose(fit.stats["v"][1], 7.628073, rel_tol=1e-6)     # population, not 8.808
    const = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    out = fit_standard_scaler(const, ["v"]).transform(const).collect()
    assert [r[0] for r in out] == [0.0, 0.0]


def test_scale_passthrough_stage(spark):
    df = spark.createDataFrame([(1.0, 7), (3.0, 8)], "amt double, other int")
    m = ScalePassthrough(inputCol="amt").fit(df)
    assert [r["amt"] for r in m.transform(df).collect()] == [-1.0, 1.0]


def test_ordinal_codes_order_and_unknown(spark):
    fit_df = spark.createDataFrame([("b",), ("a",), ("nan",), ("MISSING",)], "c string")
    enc = fit_ordinal_encoder(fit_df, ["c"])
    codes = {r["category"]: r["code"] for r in enc.codes.collect()}
    assert codes == {"MISSING": 0.0, "a": 1.0, "b": 2.0, "nan": 3.0}
    app = spark.createDataFrame([(1, "zzz"), (2, "a"), (3, None)], "i int, c string")
    got = {r["i"]: r["c"] for r in enc.transform(app).collect()}
    assert got == {1: -1.0, 2: 1.0, 3: -1.0}


def test_impute_constant_and_fill_nan(spark):
    df = spark.createDataFrame([("x",), (None,)], "c string")
    assert [r[0] for r in df.select(*impute_constant(["c"])).collect()] == ["x", "MISSING"]
    assert [r[0] for r in df.select(*impute_constant(["c"], "nan")).collect()] == ["x", "nan"]


def test_null_keys_and_duplicates(spark):
    left = spark.createDataFrame([(None, 1), (7, 2)], "k int, a int")
    right = spark.createDataFrame([(None, 10), (7, 20), (7, 21)], "k int, a int")
    plain = left_join(left, right, "k").collect()
    assert sorted((r["a_x"], r["a_y"]) for r in plain) == [(1, None), (2, 20), (2, 21)]
    safe = left_join(left, right, "k", null_safe=True).collect()
    assert sorted((r["a_x"], r["a_y"]) for r in safe) == [(1, 10), (2, 20), (2, 21)]


def test_all_null_column_dropped_and_recorded(spark):
    df = spark.createDataFrame([(1, None, 1.0, 0), (2, None, 3.0, 1)], "id int, z double, v double, y int")
    out, fit = prepare(df, None, "id", "y")
    assert fit.dropped == ["z"] and "z" not in out.columns
    assert out.columns == ["id", "v", "y"]


def test_label_missing_raises(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "y double")
    with pytest.raises(Exception):
        df.select(label_int("y", df)).collect()


def test_roles_and_shape(spark):
    df = spark.createDataFrame([(1, "a", True, 2.0, 0)], "id int, c string, b boolean, d double, y int")
    assert column_roles(df, ["id", "y"]) == (["b", "d"], ["c"])
    r = table_shape(df).first()
    assert (r["n_rows"], r["n_columns"]) == (1, 5)


def test_batch_slices_short_last_and_empty(spark):
    df = spark.range(10)
    got = {r["batch_id"]: r["n"] for r in batch_slices(df, 4, ["id"]).groupBy("batch_id")
           .agg(F.count("*").alias("n")).collect()}
    assert got == {1: 4, 2: 4, 3: 2}
    assert batch_slices(spark.range(0), 4, ["id"]).count() == 0


def test_csv_na_tokens_keep_numeric(spark, tmp_out):
    path = f"{tmp_out}/na.csv"
    with open(path, "w") as fh:
        fh.write("id,v,s\n")
        for i, tok in enumerate(NA_TOKENS):
            fh.write(f"{i},{tok},{'x' if i % 2 else tok}\n")
        fh.write("99,2.5,y\n")
    df = read_csv_na(spark, path)
    types = dict(df.dtypes)
    assert types["id"] == "bigint" and types["v"] == "double" and types["s"] == "string"
    assert df.where(F.col("v").isNull()).count() == len(NA_TOKENS)


def test_median_imputer_exact(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,), (None,)], "v double")
    imp = fit_median_imputer(df, ["v"])
    assert imp.medians == {"v": 6.0}
    assert [r[0] for r in imp.transform(df).collect()][-1] == 6.0


def test_ordinal_codes_are_positions_in_code_point_order(spark):
    import veilscore.operators.encode as ENC
    df = spark.createDataFrame([(f"c{i % 37}é", f"d{i % 5}") for i in range(300)], "a string, b string")
    got = {(r["feature"], r["category"]): r["code"] for r in ENC.fit_ordinal_encoder(df, ["a", "b"]).codes.collect()}
    want = {("a", c): float(i) for i, c in enumerate(sorted(f"c{i}é" for i in range(37)))}
    want |= {("b", c): float(i) for i, c in enumerate(sorted(f"d{i}" for i in range(5)))}
    assert got == want


def test_csv_quotes_and_line_breaks(spark, tmp_out):
    from veilscore.sources.csv import read_csv_na
    from veilscore.sources.sinks import write_csv
    rows = [(1, 'a "q" b'), (2, "line\nbreak, comma"), (3, " outer blanks "), (4, None), (5, '"')]
    write_csv(spark.createDataFrame(rows, "id long, t string"), f"{tmp_out}/q")
    got = read_csv_na(spark, f"{tmp_out}/q")
    assert dict(got.dtypes) == {"id": "bigint", "t": "string"}
    assert sorted(tuple(r) for r in got.collect()) == rows


def test_transform_without_label(spark):
    tx = spark.createDataFrame([(1, 10.0, "a", 0), (2, None, "b", 1)], "id long, v double, c string, y int")
    _, fit = prepare(tx, None, "id", "y")
    assert fit.transform(tx.drop("y")).columns == ["id", "v", "c"]


def test_fitted_prep_save_load_roundtrip(spark, tmp_out):
    from veilscore.plans.prepare import FittedPrep
    tx = spark.createDataFrame([(1, 10.0, "a", 0), (2, None, "b", 1), (3, 30.0, None, 0), (4, 5.0, "a", 1)],
                               "id long, v double, c string, y int")
    out, fit = prepare(tx, None, "id", "y")
    fit.save(spark, f"{tmp_out}/prep")
    again = FittedPrep.load(spark, f"{tmp_out}/prep")
    new = spark.createDataFrame([(9, None, "zzz", 1), (10, 7.0, "b", 0)], "id long, v double, c string, y int")
    a = sorted(tuple(r) for r in fit.transform(new).collect())
    b = sorted(tuple(r) for r in again.transform(new).collect())
    assert a == b and a[0][2] == -1.0          # unseen category → −1
    assert sorted(tuple(r) for r in again.transform(tx).collect()) == sorted(tuple(r) for r in out.collect())
