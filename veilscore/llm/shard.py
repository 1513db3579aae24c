"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered by the hash of their content, so the numbers depend on the rows
alone, not on files, partitions or executors.  A keyed Feistel network on
``a x b >= n`` places (a is the square root of n, rounded up) permutes the
numbers; cycle walking brings the few places beyond n back.  Place p goes to
shard ``p mod shards`` and slot ``p div shards``: shard sizes differ by one row at
most, slots have no gaps, and ``place`` computes both from a row number without a
table.

Numbering needs one shuffle: the hash is uniform, so its leading bits are range
buckets without sampling, and their counts (one row per bucket) give the offsets.
Rows that are equal in every numbered column share a hash; where such a hash is
hot its rows are dealt over salted pieces, counted the same way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

ROUNDS = 6
#: Rows per range bucket aimed at, and the least number of buckets.
BUCKET_ROWS = 1 << 15
MIN_BUCKETS = 1 << 8
#: Pieces that a hot hash is dealt over.
SALTS = 256
#: Cycle-walking steps; each one fails with a probability of about 1/sqrt(n).
WALKS = 64

def _domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, computed once however often the body names it: written out
    again at every use, six rounds and the walk grow to hundreds of hashes a row and to
    code that takes the compiler much memory."""
    return F.transform(F.array(value), body)[0]


def _rounds(x: Column, n: int, seed: int) -> Column:
    a, b = _domain(n)

    def halves(x: Column) -> Column:                      # exact below 2^53 rows
        return F.struct(((x - x % F.lit(b)) / F.lit(b)).cast("long").alias("left"), (x % F.lit(b)).cast("long").alias("right"))

    def two(state: Column, key: Column) -> Column:
        left = F.pmod(state["left"] + F.pmod(F.xxhash64(key, state["right"]), F.lit(a)), F.lit(a))
        return _bound(left.cast("long"), lambda new: F.struct(new.alias("left"), F.pmod(
            state["right"] + F.pmod(F.xxhash64(key + F.lit(1).cast("long"), new), F.lit(b)), F.lit(b)).cast("long").alias("right")))

    keys = F.array(*[F.lit(seed * 64 + j).cast("long") for j in range(0, ROUNDS, 2)])
    return F.aggregate(keys, halves(x), two, lambda state: state["left"] * F.lit(b).cast("long") + state["right"])


def permuted(number: Column, n: int, seed: int = 0) -> Column:
    """Place of row ``number`` (0 to n - 1) under the seeded permutation."""
    def walked(first: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first,
                           lambda p, _: F.when(p < n, p).otherwise(_rounds(p, n, seed)))

    def ended(p: Column) -> Column:
        return F.when(p < n, p).otherwise(
            F.raise_error(F.lit("cycle walking did not end; use another seed")).cast("long"))

    return _bound(_rounds(number.cast("long"), n, seed),
                  lambda first: F.when(first < n, first).otherwise(_bound(walked(first), ended)))


def _dealt(p: Column, shards: int) -> tuple[Column, Column]:
    """(shard, slot) of a place."""
    return (p % shards).cast("int"), F.floor((p - p % shards) / shards).cast("long")


def place(number: Column, n: int, shards: int, seed: int = 0) -> tuple[Column, Column]:
    """(shard, slot) of a row number."""
    p = permuted(number, n, seed)
    return _dealt(p, shards)[0], _bound(p, lambda one: _dealt(one, shards)[1])


def numbered(df: DataFrame, by: list[str], n: int, name: str = "row_number") -> DataFrame:
    """``df`` (n rows) with a gapless number from 0 in column ``name``.

    Order: the leading bits of a hash over the columns ``by``, then hot hashes
    last, then the hash; rows equal in all of ``by`` are interchangeable (whether a
    hash is hot depends on the data, so the numbers do too; the law holds anyway).  ``df``
    is read twice and must give the same rows in the same places (a table or a
    checkpoint does).
    """
    bits = max(MIN_BUCKETS, -(-n // BUCKET_ROWS))
    bits = (bits - 1).bit_length()
    values = [_comparable(df, c) for c in by]
    # The turn is taken where rows are read, so that it is the same in every pass.
    keyed = df.withColumn("__feistel_hash", F.xxhash64(*values)).withColumn(
        "__feistel_bucket", F.shiftrightunsigned("__feistel_hash", 64 - bits)).withColumn(
        "__feistel_turn", F.monotonically_increasing_id() % SALTS)
    limit = 8 * max(BUCKET_ROWS // 64, -(-n // (1 << bits)))
    # Hot hashes, looked for in crowded buckets only; a table, however many there are.
    crowded = keyed.groupBy("__feistel_bucket").count().where(F.col("count") > limit).select("__feistel_bucket")
    hot = stored(keyed.select("__feistel_bucket", "__feistel_hash").join(crowded, "__feistel_bucket", "left_semi")
                 .groupBy("__feistel_hash").count().where(F.col("count") > limit)
                 .select(F.col("__feistel_hash").alias("__feistel_hot")), "shard-hot")
    keyed = (keyed.join(hot, F.col("__feistel_hash") == F.col("__feistel_hot"), "left")
             .withColumn("__feistel_salt", F.when(F.col("__feistel_hot").isNotNull(), F.col("__feistel_turn"))
                         .otherwise(F.lit(0))))
    piece = ["__feistel_bucket", "__feistel_hot", "__feistel_salt"]
    sizes = stored(keyed.groupBy(*piece).agg(F.count(F.lit(1)).alias("rows"))
                   .withColumn("part", F.shiftright("__feistel_bucket", bits // 2)), "shard-sizes")
    # Offsets in two levels: of the leading bits (at most 2 to half the bits rows), then within them.
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("rows").alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(upto.orderBy("part")), F.lit(0)).alias("start"))
    before = upto.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in piece])
    offsets = sizes.join(parts, "part").select(
        *[F.col(c).alias(f"{c}_of") for c in piece],
        (F.col("start") + F.coalesce(F.sum("rows").over(before), F.lit(0))).alias("__feistel_offset"))
    offsets = stored(offsets, "shard-offsets")
    match = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in piece]
    within = F.row_number().over(Window.partitionBy(*piece).orderBy("__feistel_hash", *values))
    return (keyed.withColumn("__feistel_within", within)
            .join(offsets, match[0] & match[1] & match[2])
            .select(*[F.col(f"`{c}`") for c in df.columns if c != name],
                    (F.col("__feistel_offset") + F.col("__feistel_within") - 1).cast("long").alias(name)))


def _comparable(df: DataFrame, name: str) -> Column:
    """A column that can be hashed and ordered; one that holds maps by its JSON text."""
    column = F.col(f"`{name}`")
    return F.to_json(F.struct(column)) if "map<" in df.schema[name].dataType.simpleString() else column


def sharded(df: DataFrame, shards: int, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (int, 0 to shards - 1) and ``slot`` (long, gapless from
    0 in each shard); columns of these names are replaced.

    Nulls hash like any value; null and empty texts, ties and repeated rows each
    get a place of their own; an empty table stays empty.
    """
    df = df.drop("shard", "slot")
    n = df.count()
    rows = numbered(df, by or df.columns, n, "__feistel_number")
    rows = rows.withColumn("__feistel_place", permuted(F.col("__feistel_number"), max(n, 1), seed))
    shard, slot = _dealt(F.col("__feistel_place"), shards)
    return rows.withColumn("shard", shard).withColumn("slot", slot).drop("__feistel_number", "__feistel_place")
