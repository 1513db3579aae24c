import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF_ORACLE
from veilscore.llm import shard as S
from veilscore.llm.queries import QUERIES, SHARDS


def check_law(rows, shards):
    sizes = [0] * shards
    for r in rows:
        sizes[r.shard] += 1
    assert max(sizes) - min(sizes) <= 1
    for k in range(shards):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 101, 1000, 4096, 20_011])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(S.permuted(F.col("id"), n, 5).alias("p")).collect()]
    assert sorted(got) == list(range(n))


def test_seed_changes_the_shuffle(spark):
    one, two = (spark.range(500).select(S.permuted(F.col("id"), 500, s).alias("p")).collect() for s in (1, 2))
    assert one != two and one != sorted(one)


def test_query(spark):
    got = QUERIES["op2_feistel_sharding"](spark, SF_ORACLE).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").collect()}
    assert len(got) == len(text)
    check_law(got, SHARDS)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        assert r.law == "rows" and r.grown_shard is None


def test_places_do_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "lang", "source")
    a = S.sharded(df.coalesce(1), 8).select("doc_id", "shard", "slot").orderBy("doc_id").collect()
    b = S.sharded(df.repartition(13), 8).select("doc_id", "shard", "slot").orderBy("doc_id").collect()
    assert a == b


def test_nulls_ties_repeats_and_clashing_names(spark):
    # A third of the rows is one and the same row: its hash is hot and gets salted.
    df = spark.range(40_000).selectExpr("if(id % 3 = 0, null, id) as doc_id",
                                        "if(id % 3 = 0, null, cast(id as string)) as text",
                                        "'old' as shard", "1 as row_number")
    got = S.sharded(df, 16)
    assert sorted(got.columns) == sorted(["doc_id", "text", "row_number", "shard", "slot"])
    check_law(got.select("shard", "slot").collect(), 16)
    assert got.filter("doc_id is null").count() == df.filter("doc_id is null").count()
    assert S.sharded(df.limit(0), 16).count() == 0
    one = S.sharded(df.limit(1), 16).collect()
    assert one[0].slot == 0


def feistel(x, n, seed):
    """The permutation in plain Python."""
    a, b = S._domain(n)

    def code(key, value):
        h = 42
        for v in (key, value):
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), h)
        return h - (1 << 64) if h >> 63 else h
    while True:
        left, right = divmod(x, b)
        for j in range(S.ROUNDS):
            key = seed * 64 + j
            if j % 2:
                right = (right + code(key, left) % b) % b
            else:
                left = (left + code(key, right) % a) % a
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 7, 100, 3001])
def test_every_place_as_in_plain_python(spark, n):
    shard, slot = S.place(F.col("id"), n, 16, 2024)
    for r in spark.range(n).select("id", shard.alias("shard"), slot.alias("slot")).collect():
        p = feistel(r.id, n, 2024)
        assert (r.shard, r.slot) == (p % 16, p // 16)


def test_dotted_names_maps_and_long_texts(spark):
    df = spark.range(300).selectExpr("id % 7 AS `a.b`", "map('k', id % 3, 'l', id) AS m", "array(map(1, id)) AS n",
                                     "if(id = 5, repeat('x', 3000000), cast(id AS string)) AS text")
    got = S.sharded(df, 4)
    assert got.columns == ["a.b", "m", "n", "text", "shard", "slot"]
    check_law(got.select("shard", "slot").collect(), 4)
    assert got.selectExpr("max(length(text)) AS n").first().n == 3_000_000


def test_every_row_hot(spark):
    """Many hot hashes: rows of ten kinds only."""
    got = S.sharded(spark.range(60_000).selectExpr("id % 10 AS kind"), 16)
    check_law(got.collect(), 16)
    assert {r["count"] for r in got.groupBy("kind").count().collect()} == {6000}
