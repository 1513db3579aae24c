"""Sealed (privacy-preserving) linear scoring with an additive mask scheme.

Scoring only adds features multiplied by *plain* weights, so an additively
homomorphic scheme suffices.  The ``mask`` scheme is additive stream masking
(Castelluccia–Mykletun–Tsudik, 2005) over Z_M, M = 2^48:

    seal:   c_i = (x_i + r_i) mod M,   r_i = PRF(key, nonce, id, i)
    score:  s'  = (Σ w_i·c_i + bias) mod M            (no key, no plain values)
    open:   s   = centre((s' − Σ w_i·r_i) mod M)       ∈ (−M/2, M/2)

PRF: a per-row key k_row = HMAC-SHA256(key, nonce|id|salt) (RFC 2104, nested
``sha2``), expanded in counter mode, block_b = SHA-256(k_row ‖ b); one digest
gives five 48-bit masks, so a row of k features costs 2 + ceil(k/5) hashes.
The salt is a random value per sealed row, stored beside the ciphertext, so equal
ids (or the same id sealed twice) never share a mask.  All of it is native column
expressions — no Python in the data path.

Key material lives in a *keyring* table ``(key_id, k_ipad, k_opad, nonce)``,
joined to the rows by ``key_id`` (broadcast; its size is checked).  The
secret is never a literal in a query plan; the scoring job needs only the
sealed table and the weights.  Checked, with an error instead of a wrong score:
``max|w|·M < 2^62`` (no int64 overflow while accumulating); the width of every
row; ``|x_i| < 2^47``; and, when the model is given at sealing time,
``Σ|w_i·x_i| + |bias| < 2^47``, so the opened score cannot wrap.
This is *not* fully homomorphic and gives no integrity protection.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import width_guard
from ..session import path_exists
from ..sources.model import LinearModel
from ..sources.publish import begin, commit, manifest
from .project import batch_slices

MASK_BITS = 48
MODULUS = 2 ** MASK_BITS
MASKS_PER_DIGEST = 5
_HEX_PER_MASK = MASK_BITS // 4
KEY_COLUMNS = ("key_id", "k_ipad", "k_opad", "nonce")
HALF = MODULUS // 2
#: Most keys in a keyring (about 200 bytes each, so at most 20 MB are broadcast).
KEYRING_LIMIT = 100_000


def new_keyring(spark: SparkSession, key_ids: Sequence[str] = ("k0",),
                secret: bytes | None = None) -> DataFrame:
    """Fresh key material per run.  ``secret`` (tests only) fixes the key;
    by default 32 random bytes per key id.  Nonces are random per key."""
    rows = []
    for slot, kid in enumerate(key_ids):
        key = secret if secret is not None else secrets.token_bytes(32)
        if len(key) > 64:
            key = hashlib.sha256(key).digest()
        key = key.ljust(64, b"\0")
        rows.append((slot, kid, bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key),
                     secrets.token_hex(8) if secret is None else "0" * 16))
    return spark.createDataFrame(
        rows, "key_slot int, key_id string, k_ipad binary, k_opad binary, nonce string")


def _hmac_hex(k_ipad: Column, k_opad: Column, message: Column) -> Column:
    inner = F.sha2(F.concat(k_ipad, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(k_opad, F.unhex(inner)), 256)


def _masks(id_col: Column, width: int, label: str = "row") -> Column:
    """array<bigint> of ``ceil(width/5)·5`` 48-bit masks for one row; every ``label``
    gives masks of its own.

    The row key and the digests are higher-order-function *arguments*, so each
    is computed once per row; every digest is split into five 12-hex-digit
    numbers."""
    n_blocks = max(1, -(-width // MASKS_PER_DIGEST))
    row_key = F.unhex(_hmac_hex(F.col("k_ipad"), F.col("k_opad"),
                                F.concat_ws("|", F.lit(label), F.col("nonce"), id_col.cast("string"),
                                            F.col("salt"))))
    digests = F.zip_with(
        F.sequence(F.lit(0), F.lit(n_blocks - 1)), F.array_repeat(row_key, n_blocks),
        lambda b, k: F.sha2(F.concat(k, F.encode(b.cast("string"), "UTF-8")), 256))
    slots = F.sequence(F.lit(0), F.lit(MASKS_PER_DIGEST - 1))
    return F.flatten(F.transform(digests, lambda h: F.transform(
        slots, lambda j: F.conv(F.substr(h, j * _HEX_PER_MASK + 1, F.lit(_HEX_PER_MASK)), 16, 10)
        .cast("long"))))


def _with_keys(df: DataFrame, keyring: DataFrame, id_col: str,
               key_col: Column | str | None) -> DataFrame:
    """Attach key material by an equi-join with the broadcast keyring: on
    ``key_col`` if given, else on the key slot ``pmod(xxhash64(id), #keys)`` —
    keys spread over rows, one key per row."""
    ring, n_keys = _sized(keyring.select("key_slot", *KEY_COLUMNS))
    if key_col is not None:
        kc = F.col(key_col) if isinstance(key_col, str) else key_col
        return df.withColumn("key_id", kc).join(ring, "key_id").drop("key_slot")
    slot = F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_keys)).cast("int")
    return df.withColumn("key_slot", slot).join(ring, "key_slot").drop("key_slot")


def _sized(ring: DataFrame) -> tuple[DataFrame, int]:
    """The keyring for a broadcast join, and its number of keys (checked)."""
    n_keys = ring.count()
    if not 0 < n_keys <= KEYRING_LIMIT:
        raise ValueError(f"a keyring holds 1 to {KEYRING_LIMIT} keys, not {n_keys}")
    return F.broadcast(ring), n_keys


def _checked(x: Column, width: int, truncate: bool, model: LinearModel | None) -> Column:
    """``x`` with nulls as 0, or an error for rows that cannot be sealed safely."""
    zero = F.lit(0).cast("long")
    cells = F.transform(F.slice(x, 1, width) if truncate else x, lambda v: F.coalesce(v, zero))
    fits = F.forall(cells, lambda v: (v < F.lit(HALF)) & (v > F.lit(-HALF)))
    if not truncate:
        fits = fits & (F.size(x) == width)
    if model is not None:
        sizes = F.array(*[F.lit(float(abs(int(w)))) for w in model.weights[:width]])
        reach = F.aggregate(F.zip_with(cells, sizes, lambda v, w: F.coalesce(F.abs(v) * w, F.lit(0.0))),
                            F.lit(float(abs(model.bias))), lambda a, v: a + v)
        fits = fits & (reach < F.lit(HALF * (1.0 - 1e-9)))
    return F.when(fits, cells).otherwise(F.raise_error(F.lit(
        f"row cannot be sealed: it needs {width} features, each and the score they can reach below 2^47")))


def _commitment(id_col: Column, score: Column) -> Column:
    """Keyed commitment to a score: HMAC(key, "commit|nonce|id|score")."""
    msg = F.concat_ws("|", F.lit("commit"), F.col("nonce"), id_col.cast("string"), score.cast("string"))
    return _hmac_hex(F.col("k_ipad"), F.col("k_opad"), msg)


def seal(df: DataFrame, keyring: DataFrame, id_col: str, x_col: str = "x", width: int | None = None,
         key_col: Column | str | None = None, keep: Sequence[str] = (),
         commit_to: LinearModel | None = None, model: LinearModel | None = None,
         truncate: bool = False) -> DataFrame:
    """``(id, key_id, salt, c array<bigint>)`` with ``c_i = (x_i + r_i) mod 2^48``.

    ``width`` is the number of features of every row (default: the model's); a
    row of another width is an error, unless ``truncate=True`` asks for the first
    ``width`` features of each row.  ``model`` is the model that will score the
    rows: with it, a row whose score could leave (−2^47, 2^47) is an error too.

    ``commit_to=model`` adds ``commit``: a keyed commitment to the plain score
    the model should produce for this row.  The scorer carries it along without
    learning anything from it; the opener checks the opened score against it
    (:func:`open_and_verify`) — verification without joining back to the
    plain table."""
    from ..functions.arrays import dot
    model = model or commit_to
    if width is None and model is None:
        raise ValueError("seal needs a width or a model")
    w = int(width if width is not None else model.feature_count)
    salted = df.withColumn("salt", F.expr("uuid()"))
    j = _with_keys(salted, keyring, id_col, key_col)
    x = _checked(F.col(x_col), w, truncate, model)
    sealed = F.zip_with(x, _masks(F.col(id_col), w), lambda v, r: F.pmod(v + r, F.lit(MODULUS)))
    size = F.least(F.size(F.col(x_col)), F.lit(w))
    extra = []
    if commit_to is not None:
        expected = dot(F.slice(F.col(x_col), 1, w) if truncate else F.col(x_col),
                       commit_to.weights, commit_to.bias)
        extra.append(_commitment(F.col(id_col), expected).alias("commit"))
    # zip_with pads x (shorter than the mask array) with nulls: cut back to size(x).
    return j.select(id_col, "key_id", "salt", *keep, F.slice(sealed, 1, size).alias("c"), *extra)


def check_model(model: LinearModel) -> None:
    """Headroom: every product w·c (c < 2^48) and the running sum stay inside
    int64.  The bias is only added (reduced mod M first), so it is not bounded."""
    biggest = max([abs(w) for w in model.weights] + [1])
    if biggest * MODULUS >= 2 ** 62:
        raise ValueError(f"|weight| {biggest} too large for the 2^{MASK_BITS} mask modulus")


def score_sealed(sealed: DataFrame, model: LinearModel, id_col: str, c_col: str = "c",
                 keep: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """(Σ w_i·c_i + bias) mod M on sealed rows — no key material involved.
    A row of another width than the model is an error; with ``strict=False`` the
    shorter side wins."""
    check_model(model)
    w = F.array(*[F.lit(int(v)).cast("long") for v in model.weights])
    terms = F.zip_with(width_guard(c_col, model.feature_count, strict), w, lambda c, b: F.coalesce(c * b, F.lit(0).cast("long")))
    start = F.pmod(F.lit(int(model.bias)).cast("long"), F.lit(MODULUS))
    s = F.aggregate(terms, start, lambda acc, t: F.pmod(acc + t, F.lit(MODULUS)))
    return sealed.select(id_col, "key_id", "salt", *keep, s.alias("sealed_score"))


def _centre(v: Column) -> Column:
    return F.when(v >= F.lit(MODULUS // 2), v - F.lit(MODULUS)).otherwise(v)


def open_scores(scored: DataFrame, keyring: DataFrame, model: LinearModel, id_col: str,
                keep: Sequence[str] = (), out: str = "score") -> DataFrame:
    """Subtract Σ w_i·r_i (recomputed from the key), reduce mod M, recentre."""
    return _open(scored, keyring, model, id_col, keep, out, verify=False)


def open_and_verify(scored: DataFrame, keyring: DataFrame, model: LinearModel, id_col: str,
                    keep: Sequence[str] = (), out: str = "score") -> DataFrame:
    """E3 + V2 per row: opened score and ``match`` = the opened score equals the
    score committed to at sealing time (rows sealed with ``commit_to``)."""
    return _open(scored, keyring, model, id_col, keep, out, verify=True)


def _open(scored: DataFrame, keyring: DataFrame, model: LinearModel, id_col: str,
          keep: Sequence[str], out: str, verify: bool) -> DataFrame:
    j = scored.join(_sized(keyring.select(*KEY_COLUMNS))[0], "key_id")
    w = F.array(*[F.lit(int(v)).cast("long") for v in model.weights])
    masked = F.zip_with(_masks(F.col(id_col), model.feature_count), w,
                        lambda r, b: F.coalesce(F.pmod(r * b, F.lit(MODULUS)), F.lit(0).cast("long")))
    mask_sum = F.aggregate(masked, F.lit(0).cast("long"),
                           lambda acc, t: F.pmod(acc + t, F.lit(MODULUS)))
    opened = _centre(F.pmod(F.col("sealed_score") - mask_sum, F.lit(MODULUS)))
    if not verify:
        return j.select(id_col, *keep, opened.alias(out))
    o = j.select(id_col, *keep, "commit", "k_ipad", "k_opad", "nonce", opened.alias(out))
    match = F.coalesce(_commitment(F.col(id_col), F.col(out)) == F.col("commit"), F.lit(False))
    return o.select(id_col, *keep, out, match.alias("match"))


def unseal_features(sealed: DataFrame, keyring: DataFrame, id_col: str, width: int,
                    c_col: str = "c", out: str = "x") -> DataFrame:
    """E5 helper: element-wise opening ``x_i = centre((c_i − r_i) mod M)``."""
    j = sealed.join(_sized(keyring.select(*KEY_COLUMNS))[0], "key_id")
    c = F.col(c_col)
    x = F.zip_with(c, _masks(F.col(id_col), width),
                   lambda ci, r: _centre(F.pmod(ci - r, F.lit(MODULUS))))
    return j.select(id_col, F.slice(x, 1, F.size(c)).alias(out))


def sealed_batches(df: DataFrame, keyring: DataFrame, id_col: str, batch_size: int,
                   width: int, x_col: str = "x") -> DataFrame:
    """R9 batch ids (1-based, in id order) + E1 sealing; one key per run."""
    b = batch_slices(df, batch_size, [id_col])
    return seal(b, keyring, id_col, x_col, width, keep=["batch_id"])


def rekey(sealed: DataFrame, old: DataFrame, new: DataFrame, id_col: str, width: int,
          keep: Sequence[str] = (), c_col: str = "c", key_col: Column | str | None = None) -> DataFrame:
    """Sealed rows moved to another keyring in one pass, without opening them:
    ``c' = (c + (r_new - r_old)) mod 2^48`` under a new salt.  The difference of the two
    masks is taken first, so no plain value is ever formed.  Neither keyring alone opens
    both versions.  A commitment or tag is bound to its key: seal or tag again for those.
    Rows whose key is not in ``old`` are an error."""
    ring = old.select(*KEY_COLUMNS)
    j = sealed.select(id_col, "key_id", "salt", *keep, F.col(c_col).alias("c")).join(_sized(ring)[0], "key_id", "left")
    known = F.when(F.col("k_ipad").isNotNull(), _masks(F.col(id_col), width)).otherwise(
        F.raise_error(F.lit("a sealed row has a key that is not in the old keyring")))
    marked = j.select(id_col, *keep, "c", known.alias("_gone")).withColumn("salt", F.expr("uuid()"))
    k = _with_keys(marked, new, id_col, key_col)
    move = F.zip_with(_masks(F.col(id_col), width), "_gone", lambda a, b: a - b)
    moved = F.zip_with("c", move, lambda c, m: F.pmod(c + m, F.lit(MODULUS)))
    return k.select(id_col, "key_id", "salt", *keep, F.slice(moved, 1, F.size("c")).alias("c"))


def register_keys(keyring: DataFrame, path: str) -> None:
    """Enter every (key, nonce) of a keyring into the register at ``path`` (hashes only);
    a pair that is there already, or twice in the keyring, is an error and enters nothing.
    Call it before sealing, one writer at a time."""
    spark = keyring.sparkSession
    mark = F.sha2(F.concat(F.col("k_ipad"), F.encode(F.concat(F.lit("|"), F.col("nonce")), "UTF-8")), 256)
    marks = _sized(keyring.select("key_id", mark.alias("mark")))[0]
    known = marks.select("key_id", "mark")
    again = known.groupBy("mark").agg(F.min("key_id").alias("key_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    if path_exists(spark, path):
        again = again.select("key_id").unionByName(known.join(spark.read.parquet(path).select("mark"), "mark", "left_semi").select("key_id"))
    bad = again.select("key_id").first()
    if bad is not None:
        raise ValueError(f"key {bad[0]} has been used with this nonce before")
    marks.select("mark").write.mode("append").parquet(path)


#: Batches per directory of the sealed layout.
BATCHES_PER_GROUP = 1024


def write_sealed_batches(sealed: DataFrame, path: str) -> int:
    """Sealed batches as Parquet (overwrite); returns the number of batches.

    One layout at every size: a directory ``batch_group=g`` per 1,024 batches
    (``g = batch_id div 1024``), rows range-clustered and sorted by ``batch_id``,
    which stays a data column; a reader's ``batch_id = i`` filter is answered from
    Parquet row-group statistics."""
    grouped = sealed.withColumn("batch_group", F.expr(f"batch_id div {BATCHES_PER_GROUP}"))
    grouped.repartitionByRange("batch_group", "batch_id").sortWithinPartitions("batch_group", "batch_id") \
        .write.mode("overwrite").partitionBy("batch_group").parquet(path)
    written = sealed.sparkSession.read.schema(grouped.schema).parquet(path)
    return int(written.agg(F.max("batch_id")).first()[0] or 0)


def append_sealed_batches(df: DataFrame, keyring: DataFrame, id_col: str, batch_size: int, width: int,
                          path: str, epoch: int | str, x_col: str = "x") -> int:
    """Seal new rows and append them to the sealed set at ``path``; their batch
    ids go on where the last epoch ended (its last batch stays as it is, even if short).
    Returns the number of batches added.

    The epoch's rows are written first; they count once a manifest row with the epoch,
    its first batch and its number of batches is written.  An epoch that counts already
    adds nothing, and one that stopped half-way is written anew, so a replay is harmless.
    One writer at a time."""
    spark, key = df.sparkSession, str(epoch)
    rows = manifest(spark, path)
    if rows.where(F.col("key") == key).limit(1).count():
        return 0
    done = int(rows.agg(F.max(F.col("first") + F.col("size"))).first()[0] or 1)
    sealed = sealed_batches(df, keyring, id_col, batch_size, width, x_col)
    version, folder = begin(spark, path)
    shifted = sealed.withColumn("batch_id", F.col("batch_id") + (done - 1))
    last = write_sealed_batches(shifted, f"{path.rstrip('/')}/{folder}/batches")
    added = max(last - (done - 1), 0)
    commit(spark, path, version, folder, ["batches"], key, done, added)
    return added


def read_appended_batches(spark: SparkSession, path: str) -> DataFrame:
    """The sealed rows of every epoch that counts, with their ``batch_id``."""
    folders = [r[0] for r in manifest(spark, path).where("size > 0").select("folder").collect()]
    if not folders:
        raise FileNotFoundError(f"no sealed batches below {path}")
    parts = [f"{path.rstrip('/')}/{f}/batches" for f in folders]
    return spark.read.parquet(*[f"{part}/batch_group=*" for part in parts])
