import pytest
from pyspark.sql import functions as F

from veilscore.functions.arrays import dot, dot_unsigned, dot_wrapping, balanced_sum
from veilscore.functions.intcols import int_or_zero, narrow, quantize, uint64_reinterpret

I64_MAX = 2 ** 63 - 1
I64_MIN = -(2 ** 63)


def test_quantize_half_up_and_nan(spark):
    df = spark.createDataFrame([(0.0125,), (-0.0125,), (0.0124,), (float("nan"),), (None,)], "v double")
    got = [r[0] for r in df.select(quantize("v", 100)).collect()]
    assert got == [1, -1, 1, None, None]


def test_int_or_zero_by_dtype(spark):
    df = spark.createDataFrame([(5, 6, 7.5, "x"), (None, 1, 1.0, "y")],
                               "a bigint, b int, c double, d string")
    rows = df.select(*[int_or_zero(df, c).alias(c) for c in df.columns]).collect()
    assert [tuple(r) for r in rows] == [(5, 0, 0, 0), (0, 0, 0, 0)]


def test_uint64_reinterpret(spark):
    df = spark.createDataFrame([(-1, -1), (5, 3)], "a bigint, b int")
    rows = df.select(uint64_reinterpret(df, "a").cast("string"), uint64_reinterpret(df, "b").cast("string")).collect()
    assert rows[0][0] == str(2 ** 64 - 1) and rows[0][1] == str(2 ** 64 - 1)
    assert rows[1][0] == "5"


def test_overflow_raises_under_ansi_and_wraps_in_wrapping_mode(spark):
    # fixture `overflow`: (2^63-1)*3, (-2^63)*5, -7*4
    df = spark.createDataFrame([([I64_MAX],), ([I64_MIN],), ([-7],)], "x array<bigint>")
    wrapped = [r[0] for r in df.select(dot_wrapping("x", [3])).collect()]
    assert wrapped[0] == I64_MAX - 2       # 2^63 - 3 as signed: (2^63-1)*3 mod 2^64
    assert wrapped[1] == I64_MIN
    wrapped2 = [r[0] for r in df.select(dot_wrapping("x", [5])).collect()]
    assert wrapped2[1] == I64_MIN
    assert [r[0] for r in df.select(dot_wrapping("x", [4])).collect()][2] == -28
    with pytest.raises(Exception):
        df.select(dot("x", [3])).collect()


def test_dot_truncates_and_strict_width(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],)], "x array<bigint>")
    assert df.select(dot("x", [1, 1, 1], bias=10)).first()[0] == 16   # shorter side wins
    assert df.select(dot("x", [1, 0, 0, 0, 5])).first()[0] == 1
    with pytest.raises(Exception):
        df.select(dot("x", [1, 1, 1], strict=True)).collect()


def test_unsigned_dot(spark):
    df = spark.createDataFrame([([-1, 2],)], "x array<bigint>")
    got = df.select(dot_unsigned("x", [2, 3]).cast("string")).first()[0]
    assert int(got) == ((2 ** 64 - 1) * 2 + 6) % 2 ** 64


def test_balanced_sum_many_columns(spark):
    df = spark.range(3)
    cols = [F.col("id") * F.lit(1) for _ in range(500)]
    assert [r[0] for r in df.select(balanced_sum(cols)).collect()] == [0, 500, 1000]


def test_narrow(spark):
    df = spark.createDataFrame([(1, 1.5, "a")], "a bigint, b double, c string")
    out = narrow(df)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["int", "float", "string"]


def test_synthetic_array_equals_wide(spark):
    from veilscore.sources.synthetic import as_array, synthetic_array, synthetic_features
    a = synthetic_array(spark, 20, 7).orderBy("id").collect()
    b = as_array(synthetic_features(spark, 20, 7, with_id=True)).orderBy("id").collect()
    assert [r["x"] for r in a] == [r["x"] for r in b]
    assert all(-100 <= v < 100 for r in a for v in r["x"])
