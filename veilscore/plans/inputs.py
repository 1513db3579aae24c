"""Feature frames built from the driver tables (the role mapping of FIXTURES §B).

* ``embeddings``  — 64-wide float vectors → integer feature matrix (A4 analogue);
* ``lineitem``    — 4 numeric columns, the large scoring table (no unique key);
* ``orders ⟕ customer`` — keyed rows for sealing, splitting and preparation;
* ``documents ⟕ labels`` — the sparse left join (A1 ⟕ A2 analogue).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intcols import quantize, quantize_array
from ..sources.model import LinearModel, TEST_FEATURE_SCALE, sample_model
from ..sources.tables import read_table

# The 4-feature model used for the `lineitem` / `orders` scoring
# tables (own test model, not from the reference): weights for
# (quantity, extended price, discount, tax) after ×100 quantization, bias, scale.
LINEITEM_WEIGHTS = (3, 1, -250, 120)
LINEITEM_BIAS = -7
LINEITEM_FEATURE_SCALE = 100
LINEITEM_MODEL_SCALE = 1_000_000
# (total price, account balance, order priority digit) for keyed `orders` rows.
ORDERS_WEIGHTS = (2, -3, 40)
ORDERS_BIAS = 11
ORDERS_FEATURE_SCALE = 100


def embedding_model() -> LinearModel:
    return sample_model()


def lineitem_model() -> LinearModel:
    return LinearModel(LINEITEM_WEIGHTS, LINEITEM_BIAS, LINEITEM_MODEL_SCALE,
                       feature_scale=LINEITEM_FEATURE_SCALE,
                       feature_names=("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


def orders_model() -> LinearModel:
    return LinearModel(ORDERS_WEIGHTS, ORDERS_BIAS, 1000, feature_scale=ORDERS_FEATURE_SCALE,
                       feature_names=("o_totalprice", "c_acctbal", "o_priority"))


def embedding_features(spark: SparkSession, sf_dir: str,
                       scale: float = TEST_FEATURE_SCALE) -> DataFrame:
    """(vec_id, x array<bigint>, label) — Q1 over the embedding vectors."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select("vec_id", quantize_array("embedding", scale).alias("x"), "label")


def lineitem_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, x, label) with label = return flag 'R'."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    s = LINEITEM_FEATURE_SCALE
    x = F.array(quantize("l_quantity", s), quantize("l_extendedprice", s),
                quantize("l_discount", s), quantize("l_tax", s))
    return li.select("l_orderkey", "l_linenumber", x.alias("x"),
                     (F.col("l_returnflag") == "R").cast("int").alias("label"))


def orders_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⟕ customer (left join on the customer key; every order is kept)."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                   "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal",
                   "c_mktsegment")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").drop("c_custkey")


def orders_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, x, label) keyed integer rows; label = order status 'F'."""
    oc = orders_customer(spark, sf_dir)
    s = ORDERS_FEATURE_SCALE
    x = F.array(quantize("o_totalprice", s), quantize("c_acctbal", s),
                F.substring("o_orderpriority", 1, 1).cast("long"))
    return oc.select("o_orderkey", x.alias("x"),
                     (F.col("o_orderstatus") == "F").cast("int").alias("label"))


def documents_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⟕ labels on doc_id (the text column is never read)."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    lab = read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left")
