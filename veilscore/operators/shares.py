"""E1–E3 by additive secret sharing: the opener needs neither weights nor a key.

Every feature is split into two numbers that add up to it mod 2^48; each share alone
is uniform.  Two parties hold one share table each and score it with the plain
weights (one of them adds the bias); the two part scores of a row add up to its
score.  Neither party, nor both tables' file names or plans, hold a key.

The first share comes from a keyed pseudo-random function, the second is the rest, so
both tables are computed from the plain rows alone, by any number of tasks and any
number of times, with equal results.  The masks of a row depend on its id *and* its
features (a synthetic nonce), so rows that differ share no mask; only full copies of
a row look alike.  The key is used here once and can be thrown away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import width_guard
from ..sources.model import LinearModel
from .seal import MODULUS, _centre, _checked, _hmac_hex, _masks, _with_keys, check_model


def split_shares(df: DataFrame, keyring: DataFrame, id_col: str, x_col: str = "x", width: int | None = None,
                 model: LinearModel | None = None, truncate: bool = False) -> tuple[DataFrame, DataFrame]:
    """The two share tables ``(id, row, c)``; ``row`` tells rows of one id apart.

    ``width``, ``model`` and ``truncate`` as in :func:`veilscore.operators.seal.seal`:
    a row of another width, a cell of 2^47 or more and a reachable score of 2^47 or
    more are errors; null cells are 0."""
    if width is None and model is None:
        raise ValueError("sharing needs a width or a model")
    w = int(width if width is not None else model.feature_count)
    rows = _with_keys(df, keyring, id_col, None).withColumn("_x", _checked(F.col(x_col), w, truncate, model))
    known = F.concat_ws("|", F.lit("share"), F.col("nonce"), F.col(id_col).cast("string"),
                        F.array_join(F.col("_x").cast("array<string>"), ","))
    rows = rows.withColumn("salt", F.substring(_hmac_hex(F.col("k_ipad"), F.col("k_opad"), known), 1, 32))
    masks = F.slice(_masks(F.col(id_col), w, "share"), 1, w)
    rest = F.zip_with(F.col("_x"), masks, lambda v, r: F.pmod(v - r, F.lit(MODULUS)))
    row = F.unhex("salt").alias("row")
    return rows.select(id_col, row, masks.alias("c")), rows.select(id_col, row, rest.alias("c"))


def score_share(share: DataFrame, model: LinearModel, id_col: str, with_bias: bool) -> DataFrame:
    """``(id, row, part)``: the part score of one share table; one of the two parties
    adds the bias."""
    check_model(model)
    w = F.array(*[F.lit(int(v)).cast("long") for v in model.weights])
    terms = F.zip_with(width_guard("c", model.feature_count, True), w, lambda c, b: c * b)
    start = F.pmod(F.lit(int(model.bias) if with_bias else 0).cast("long"), F.lit(MODULUS))
    part = F.aggregate(terms, start, lambda acc, t: F.pmod(acc + t, F.lit(MODULUS)))
    return share.select(id_col, "row", part.alias("part"))


def open_shares(first: DataFrame, second: DataFrame, id_col: str) -> DataFrame:
    """``(id, score, copies)`` from the part scores of both parties, added by row.

    Full copies of a row have equal shares: they are one result with their number in
    ``copies``.  A row that one party lost, or scored in two ways, is an error."""
    both = first.select(id_col, "row", F.lit(1).alias("_party"), "part").unionByName(
        second.select(id_col, "row", F.lit(2).alias("_party"), "part"))
    of = lambda p, c: F.when(F.col("_party") == p, c)
    sums = both.groupBy(id_col, "row").agg(*[f.alias(f"_{name}{p}") for p in (1, 2) for name, f in (
        ("low", F.min(of(p, F.col("part")))), ("high", F.max(of(p, F.col("part")))), ("n", F.count(of(p, F.col("row")))))])
    whole = ((F.col("_n1") == F.col("_n2")) & F.col("_low1").eqNullSafe(F.col("_high1"))
             & F.col("_low2").eqNullSafe(F.col("_high2")))
    score = _centre(F.pmod(F.col("_low1") + F.col("_low2"), F.lit(MODULUS)))
    wrong = F.raise_error(F.lit("the two parties' part scores do not match row by row")).cast("long")
    return sums.select(id_col, F.when(whole, score).otherwise(wrong).alias("score"), F.col("_n1").alias("copies"))
