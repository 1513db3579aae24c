"""Linear authentication tags, a check of sealed scores without the score.

To every sealed cell ``c`` the sealer adds ``t = (alpha * c + rho) mod p`` for two
primes p near 2^31; ``alpha`` is secret per key, ``rho`` a pseudo-random number per
(key, id, salt, cell).  Tags are linear, so the scorer combines them with the same
weights as the cells, without a key.  The opener recomputes
``alpha * (sum - bias) + sum w_i rho_i`` and accepts a score only if both tags agree:
a changed score, cell, weight, id, salt or tag is found, except with a chance of
about 2^-31 per attempt.

The scorer returns the sum as a whole number, not reduced mod 2^48.  Accepted sums
lie within half of the product of the primes, so two different ones cannot agree
modulo both.  This is checked of the model: ``sum |w| * 2^48 + |bias|`` has to stay
below it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import width_guard
from ..sources.model import LinearModel
from .seal import KEY_COLUMNS, MODULUS, _centre, _hmac_hex, _masks, _sized

PRIMES = (2 ** 31 - 1, 2 ** 31 - 19)
#: Sums of this size or more are never accepted.
LIMIT = PRIMES[0] * PRIMES[1] // 2


def check_model(model: LinearModel) -> None:
    if sum(abs(w) for w in model.weights) * MODULUS + abs(model.bias) >= LIMIT:
        raise ValueError("the weights are too large for tagged scores")


def _alpha(j: int) -> Column:
    """Secret factor of a key, 1 to p - 1."""
    digest = _hmac_hex(F.col("k_ipad"), F.col("k_opad"), F.concat_ws("|", F.lit(f"alpha{j}"), F.col("nonce")))
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    return number % (PRIMES[j] - 1) + 1


def _weights(model: LinearModel) -> Column:
    return F.array(*[F.lit(int(w)).cast("long") for w in model.weights])


def _combined(cells: Column, model: LinearModel, p: int) -> Column:
    """Weighted sum mod p of numbers below 2^48."""
    parts = F.zip_with(cells, _weights(model), lambda t, w: F.pmod(F.pmod(t, F.lit(p)) * F.pmod(w, F.lit(p)), F.lit(p)))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, t: F.pmod(acc + F.coalesce(t, F.lit(0).cast("long")), F.lit(p)))


def _tags(id_col: str, width: int, j: int, p: int) -> Column:
    scaled = F.zip_with(F.col("c"), F.array_repeat(_alpha(j), width), lambda c, a: F.pmod(F.pmod(c, F.lit(p)) * a, F.lit(p)))
    rho = F.slice(_masks(F.col(id_col), width, f"tag{j}"), 1, width)
    return F.zip_with(scaled, rho, lambda s, r: F.pmod(s + r, F.lit(p)).cast("int"))


def tag(sealed: DataFrame, keyring: DataFrame, id_col: str, width: int) -> DataFrame:
    """Sealed rows with their tags ``t1`` and ``t2`` (arrays of int, one per cell)."""
    rows = sealed.join(_sized(keyring.select(*KEY_COLUMNS))[0], "key_id")
    tags = [_tags(id_col, width, j, p).alias(f"t{j + 1}") for j, p in enumerate(PRIMES)]
    return rows.select(*[F.col(f"`{c}`") for c in sealed.columns], *tags)


def score_tagged(tagged: DataFrame, model: LinearModel, id_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """E2 on tagged rows, no key: ``(id, key_id, salt, sealed_sum, tag1, tag2)``."""
    check_model(model)
    cells = F.zip_with(width_guard("c", model.feature_count, True), _weights(model), lambda c, w: c * w)
    total = F.aggregate(cells, F.lit(int(model.bias)).cast("long"), lambda acc, t: acc + t)
    tags = [_combined(F.col(f"t{j + 1}").cast("array<long>"), model, p).alias(f"tag{j + 1}") for j, p in enumerate(PRIMES)]
    return tagged.select(id_col, "key_id", "salt", *keep, total.alias("sealed_sum"), *tags)


def open_tagged(scored: DataFrame, keyring: DataFrame, model: LinearModel, id_col: str,
                keep: Sequence[str] = ()) -> DataFrame:
    """E3 with V2: ``(id, score, status)``; ``score`` is null and ``status`` FAIL where
    a tag does not agree (or is missing), else PASS."""
    check_model(model)
    rows = scored.join(_sized(keyring.select(*KEY_COLUMNS))[0], "key_id")
    total = F.col("sealed_sum")
    good = (total < F.lit(LIMIT)) & (total > F.lit(-LIMIT))
    for j, p in enumerate(PRIMES):
        rho = _combined(F.slice(_masks(F.col(id_col), model.feature_count, f"tag{j}"), 1, model.feature_count), model, p)
        plain = F.pmod(F.pmod(total, F.lit(p)) - F.lit(model.bias % p), F.lit(p))
        good = good & (F.pmod(F.pmod(_alpha(j) * plain, F.lit(p)) + rho, F.lit(p)) == F.col(f"tag{j + 1}"))
    good = F.coalesce(good, F.lit(False))
    score = _centre(F.pmod(F.pmod(total, F.lit(MODULUS)) - _mask_sum(id_col, model), F.lit(MODULUS)))
    return rows.select(id_col, *keep, F.when(good, score).alias("score"),
                       F.when(good, "PASS").otherwise("FAIL").alias("status"))


def _mask_sum(id_col: str, model: LinearModel) -> Column:
    parts = F.zip_with(F.slice(_masks(F.col(id_col), model.feature_count), 1, model.feature_count), _weights(model),
                       lambda r, w: F.pmod(r * w, F.lit(MODULUS)))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, t: F.pmod(acc + t, F.lit(MODULUS)))
