"""Integer column guards, quantization and two's-complement arithmetic.

All helpers return ``Column`` expressions evaluated inside whole-stage codegen.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TWO_64 = 2 ** 64
TWO_63 = 2 ** 63
# decimal(20,0) holds every int64 and every uint64 value exactly.
DEC64 = T.DecimalType(20, 0)
# decimal(38,0) holds any product of two int64 values (|x*y| <= 2^126 < 10^38).
DEC128 = T.DecimalType(38, 0)


def dec_lit(value: int, dtype: T.DecimalType = DEC64) -> Column:
    """Exact decimal literal (``lit`` of a Python int beyond int64 fails)."""
    return F.lit(Decimal(int(value))).cast(dtype)


def int_or_zero(df: DataFrame, column: str) -> Column:
    """A cell counts only if the column is 64-bit integer; nulls and every
    other type (int32, double, string…) become 0."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.LongType):
        return F.coalesce(F.col(column), F.lit(0).cast("long"))
    return F.lit(0).cast("long")


def uint64_reinterpret(df: DataFrame, column: str) -> Column:
    """64/32-bit integers reinterpreted as unsigned 64-bit (negatives wrap
    modulo 2^64); every other type becomes 0.  Result type decimal(20,0)."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.pmod(F.coalesce(F.col(column), F.lit(0)).cast(DEC64),
                      dec_lit(TWO_64)).cast(DEC64)
    return F.lit(0).cast(DEC64)


def quantize(col: Column | str, scale: float | int) -> Column:
    """Q1: float → int64 as round-half-up(x · scale).

    The value is widened to double before the multiply (float·int stays float in
    Spark and would lose digits).  Under ANSI mode an out-of-range result raises.
    NaN and null become null (R5 turns them into 0 at scoring time).
    """
    c = F.col(col) if isinstance(col, str) else col
    d = c.cast("double")
    d = F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)
    return F.round(d * F.lit(float(scale)), 0).cast("long")


def quantize_array(col: Column | str, scale: float | int) -> Column:
    """Q1 over an ``array<float|double>`` column → ``array<bigint>``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c, lambda v: quantize(v, scale))


def narrow(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Floating columns → float32, integral columns → int32 (``exclude``
    keeps e.g. 64-bit ids and the label as they are).

    Spark's ANSI cast raises where the reference would silently wrap an int32
    overflow (deliberately stricter)."""
    out = []
    for f in df.schema.fields:
        if f.name in exclude:
            out.append(F.col(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.col(f.name).cast("float").alias(f.name))
        elif isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            out.append(F.col(f.name).cast("int").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def wrap_to_int64(dec: Column) -> Column:
    """Recentre a residue in [0, 2^64) (decimal) to a signed int64."""
    return F.when(dec >= dec_lit(TWO_63), dec - dec_lit(TWO_64)) \
        .otherwise(dec).cast("long")
