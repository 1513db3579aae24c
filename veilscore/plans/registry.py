"""Registered queries: (spark, sf_dir) -> DataFrame, one per SURVEY §2 operator.

Every query reads the driver tables (or frames Spark derives from them) in full.
Computed doubles are rounded to 6 places so the DuckDB oracle can compare them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import prefix
from ..functions.intcols import int_or_zero, narrow, quantize_array, uint64_reinterpret
from ..operators import metrics as M
from ..operators import score as S
from ..operators import seal as E
from ..operators import split as T
from ..operators.encode import fit_ordinal_encoder
from ..operators.impute import fit_median_imputer, impute_constant
from ..operators.join import left_join
from ..operators.project import (batch_slices, column_roles_frame, drop_columns, first_n,
                                 label_int, table_shape)
from ..operators.scale import ScalePassthrough, fit_standard_scaler
from ..session import scratch_path
from ..sources.tables import read_table
from . import inputs as I
from .prepare import prepare

R6 = 6


def _r(c, digits=R6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---------------------------------------------------------------- scans, sinks
def scan_parquet(spark, sf):
    """Full scan of a table (all columns)."""
    return read_table(spark, sf, "customer")


def parquet_roundtrip(spark, sf):
    """Write a projection of `orders` as Parquet (overwrite), scan it back."""
    path = scratch_path(spark, "orders_roundtrip")
    read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice",
               "o_orderpriority").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def csv_roundtrip(spark, sf):
    """Write documents (whole quoted, multi-line texts) ⟕ labels as CSV (nulls
    → empty cells), read it back with NA-token handling and numeric type inference."""
    from ..sources.csv import read_csv_na
    from ..sources.sinks import write_csv
    path = scratch_path(spark, "docs_csv")
    d = read_table(spark, sf, "documents", "doc_id", "lang", "source", "n_chars", "text")
    quoted = F.concat(F.lit('"'), F.col("text"), F.lit('" said'))
    lab = read_table(spark, sf, "labels", "doc_id", "quality", "toxic")
    write_csv(left_join(d.withColumn("text", quoted), lab, "doc_id"), path)
    return read_csv_na(spark, path)


def table_shape_q(spark, sf):
    """Rows and columns of `lineitem`."""
    return table_shape(read_table(spark, sf, "lineitem"))


def column_roles_q(spark, sf):
    """Roles by dtype (id and label excluded) with non-null counts."""
    return column_roles_frame(I.documents_labels(spark, sf), exclude=["doc_id", "toxic"])


# ------------------------------------------------------- projections and casts
def drop_cols(spark, sf):
    """Drop the label and the time column from orders ⟕ customer."""
    return drop_columns(I.orders_customer(spark, sf), ["o_orderstatus", "o_orderdate"])


def label_cast(spark, sf):
    """R2: label as int, missing labels raise."""
    lab = read_table(spark, sf, "labels", "doc_id", "toxic")
    return lab.select("doc_id", label_int("toxic", lab).alias("label"))


def narrow_types(spark, sf):
    """float64 → float32, integers → int32 (ANSI raises on overflow)."""
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return narrow(li)


def int_or_zero_q(spark, sf):
    """Only int64 cells pass; int32, double and string cells read as 0."""
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity",
                    "l_returnflag")
    return li.select(*[int_or_zero(li, c).alias(f"g_{c[2:]}") for c in li.columns])


def uint64_reinterpret_q(spark, sf):
    """Signed → unsigned 64-bit reinterpretation (negatives wrap)."""
    c = read_table(spark, sf, "customer", "c_custkey", "c_nationkey")
    c = c.select("c_custkey", (F.col("c_custkey") - F.lit(750)).alias("k"),
                 (F.col("c_nationkey") - F.lit(12)).alias("nk"))
    return c.select("c_custkey", uint64_reinterpret(c, "k").cast("string").alias("u_key"),
                    uint64_reinterpret(c, "nk").cast("string").alias("u_nation"))


def quantize_features(spark, sf):
    """Q1: embeddings × 1000, round half up, int64; tall output."""
    return S.to_tall(I.embedding_features(spark, sf), "vec_id")


def quantize_model_q(spark, sf):
    """Q2: float coefficients → integer weights (round(coef·1000)); coefficients
    are the class-mean difference direction of the embeddings (label 0 vs rest)."""
    e = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    tall = e.select("label", F.posexplode("embedding").alias("feature_idx", "v"))
    coef = tall.groupBy("feature_idx").agg(
        (F.avg(F.when(F.col("label") == 0, F.col("v").cast("double")))
         - F.avg(F.when(F.col("label") != 0, F.col("v").cast("double")))).alias("coef"))
    from ..operators.quantize import quantize_coefficients
    return quantize_coefficients(coef, 1000).select("feature_idx", "w")


def prefix_features(spark, sf):
    """SANITY-style score over the first 5 features and weights."""
    m = I.embedding_model().truncated(5)
    x = I.embedding_features(spark, sf).select("vec_id", prefix("x", 5).alias("x"))
    return S.score_array(x, m, keep=["vec_id"])


def zip_truncate(spark, sf):
    """Rows cut to 40 features meet the 64-weight model; shorter side wins."""
    x = I.embedding_features(spark, sf).select("vec_id", F.slice("x", 1, 40).alias("x"))
    return S.score_array(x, I.embedding_model(), keep=["vec_id"], strict=False)


def first_n_rows(spark, sf):
    """First 5 rows by id (min(n, available))."""
    scored = S.score_array(I.embedding_features(spark, sf), I.embedding_model(), keep=["vec_id"])
    return first_n(scored, 5, ["vec_id"])


def batch_slices_q(spark, sf):
    """Batches of 64 orders in key order; rows per batch."""
    o = read_table(spark, sf, "orders", "o_orderkey")
    return batch_slices(o, 64, ["o_orderkey"]).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"))


# ------------------------------------------------------------------------ join
def left_join_identity(spark, sf):
    """Documents ⟕ labels (sparse identity side)."""
    d = read_table(spark, sf, "documents", "doc_id", "lang", "source", "n_chars")
    lab = read_table(spark, sf, "labels", "doc_id", "quality", "toxic")
    return left_join(d, lab, "doc_id")


def left_join_nullsafe(spark, sf):
    """J1 with missing keys matching each other: documents (quality may be
    missing) ⟕ per-quality document counts, on quality <=> quality."""
    dl = I.documents_labels(spark, sf).select("doc_id", "quality")
    stats = dl.groupBy("quality").agg(F.count(F.lit(1)).alias("n_in_quality"))
    return left_join(dl, stats, "quality", null_safe=True)


# ------------------------------------------------------- fitting / transforming
def impute_median(spark, sf):
    """exact median imputation of the numeric columns of documents ⟕ labels."""
    dl = I.documents_labels(spark, sf)
    imp = fit_median_imputer(dl, ["n_chars", "quality"])
    return dl.select("doc_id", *imp.columns(dl))


def impute_constant_q(spark, sf):
    """categorical cells as strings, missing → 'MISSING'."""
    dl = I.documents_labels(spark, sf).withColumn("quality_tag", F.col("quality").cast("string"))
    return dl.select("doc_id", *impute_constant(["lang", "source", "quality_tag"]))


def ordinal_encode(spark, sf):
    """codes in code-point order, 0..n−1, as double."""
    d = read_table(spark, sf, "documents", "doc_id", "lang", "source")
    return fit_ordinal_encoder(d, ["lang", "source"]).transform(d)


def ordinal_encode_unknown(spark, sf):
    """fit on toxic-labelled documents only, apply to all; unseen → −1."""
    d = read_table(spark, sf, "documents", "doc_id", "lang", "source")
    lab = read_table(spark, sf, "labels", "doc_id", "toxic").where(F.col("toxic") == 1)
    fit_rows = d.join(lab, "doc_id", "left_semi")
    return fit_ordinal_encoder(fit_rows, ["lang", "source"]).transform(d)


def standard_scale(spark, sf):
    """population z-scores of two numeric columns."""
    oc = I.orders_customer(spark, sf).select("o_orderkey", "o_totalprice", "c_acctbal")
    fit = fit_standard_scaler(oc, ["o_totalprice", "c_acctbal"])
    return M.round_all(fit.transform(oc))


def scale_passthrough(spark, sf):
    """scale one column (fitted as an ML stage), pass the others through."""
    oc = I.orders_customer(spark, sf).select("o_orderkey", "o_totalprice", "c_acctbal")
    model = ScalePassthrough(inputCol="o_totalprice").fit(oc)
    return M.round_all(model.transform(oc).select("o_totalprice", "o_orderkey", "c_acctbal"))


def _prepared_orders(spark, sf):
    o = read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice",
                   "o_orderpriority", "o_orderstatus")
    o = o.withColumn("is_f", (F.col("o_orderstatus") == "F").cast("int")).drop("o_orderstatus")
    c = read_table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment") \
        .withColumnRenamed("c_custkey", "o_custkey")
    return prepare(o, c, "o_custkey", "is_f", id_col="o_orderkey")


def prepare_e2e(spark, sf):
    """join → impute → scale → encode → (id, features…, label)."""
    out, _ = _prepared_orders(spark, sf)
    return M.round_all(out)


def dataset_metadata(spark, sf):
    """Preprocessing metadata as a one-row frame."""
    out, fit = _prepared_orders(spark, sf)
    return fit.metadata(spark, out)


# --------------------------------------------------------------------- scoring
def linear_score(spark, sf):
    """Quantized embeddings × 64-weight model + bias."""
    return S.score_array(I.embedding_features(spark, sf), I.embedding_model(), keep=["vec_id"])


def linear_score_wrapping(spark, sf):
    """P1w: features quantized by 2^52 so that scores overflow; wraps mod 2^64."""
    e = read_table(spark, sf, "embeddings", "vec_id", "embedding")
    x = e.select("vec_id", quantize_array("embedding", float(2 ** 52)).alias("x"))
    return S.score_array_wrapping(x, I.embedding_model(), keep=["vec_id"])


def dot_product_unsigned(spark, sf):
    """Unsigned 64-bit dot product (no bias) of the quantized embeddings."""
    d = S.dot_product_unsigned(I.embedding_features(spark, sf), I.embedding_model().weights,
                               keep=["vec_id"])
    return d.select("vec_id", F.col("dot").cast("string").alias("dot"))


def score_table(spark, sf):
    """Batch scoring of the whole `lineitem` table (4 features)."""
    return S.score_array(I.lineitem_features(spark, sf), I.lineitem_model(),
                         keep=["l_orderkey", "l_linenumber"])


def score_probability(spark, sf):
    """sigmoid(score / (s_w·s_x))."""
    m = I.embedding_model()
    s = S.with_probability(S.score_array(I.embedding_features(spark, sf), m, keep=["vec_id"]), m)
    return s.select("vec_id", _r("prob").alias("prob"))


def flag_fraud(spark, sf):
    """P5: decision prob ≥ 0.5."""
    m = I.embedding_model()
    s = S.with_probability(S.score_array(I.embedding_features(spark, sf), m, keep=["vec_id"]), m)
    return S.flag_at_threshold(s, 0.5).select("vec_id", "flag")


# ---------------------------------------------------------------------- sealed
def _sealed_embeddings(spark, sf):
    m = I.embedding_model()
    ring = E.new_keyring(spark)
    x = I.embedding_features(spark, sf)
    return m, ring, x, E.seal(x, ring, "vec_id", model=m)


def sealed_differs_from_plain(spark, sf):
    """Per row, how many sealed cells equal the plain value (≈ 0); the plain
    array is carried along in this diagnostic, so no join is needed."""
    m = I.embedding_model()
    sealed = E.seal(I.embedding_features(spark, sf), E.new_keyring(spark), "vec_id",
                    model=m, keep=["x"])
    same = F.aggregate(F.zip_with("c", "x", lambda a, b: (a == b).cast("int")), F.lit(0),
                       lambda acc, v: acc + v)
    return sealed.select("vec_id", same.alias("n_equal"))


def sealed_score(spark, sf):
    """Scores computed on sealed rows: residues mod 2^48 that differ from the
    plain score (equal by chance once in 2^48)."""
    m = I.embedding_model()
    plain = S.score_array(I.embedding_features(spark, sf), m, keep=["vec_id", "x"], out="plain")
    sealed = E.seal(plain, E.new_keyring(spark), "vec_id", model=m, keep=["plain"])
    scored = E.score_sealed(sealed, m, "vec_id", keep=["plain"])
    return scored.select("vec_id", F.col("sealed_score").between(0, E.MODULUS - 1).alias("is_residue"),
                         (F.col("sealed_score") != F.pmod("plain", F.lit(E.MODULUS))).alias("differs"))


def sealed_score_opened(spark, sf):
    """E1→E2→E3: seal, score without the key, open; equals the plain score."""
    m, ring, _, sealed = _sealed_embeddings(spark, sf)
    return E.open_scores(E.score_sealed(sealed, m, "vec_id"), ring, m, "vec_id")


def shared_score_opened(spark, sf):
    """E1→E2→E3 by secret sharing: two share tables, each scored by a job of its own,
    added up without weights or key; equals the plain score."""
    from ..operators import shares
    m = I.embedding_model()
    tables = shares.split_shares(I.embedding_features(spark, sf).select("vec_id", "x"), E.new_keyring(spark), "vec_id", model=m)
    scored = []
    for i, table in enumerate(tables):
        path = scratch_path(spark, f"share{i}")
        table.write.parquet(path)
        scored.append(shares.score_share(spark.read.parquet(path), m, "vec_id", with_bias=i == 0))
    return shares.open_shares(*scored, "vec_id").select("vec_id", "score")


def tampered_rows(spark, sf):
    """Tagged rows, some changed by the scorer: score, ciphertext, weights or
    tag.  The opener names them from the tags alone."""
    from ..operators import tags
    m, ring, _, sealed = _sealed_embeddings(spark, sf)
    kind = F.pmod(F.col("vec_id"), F.lit(7))
    path = scratch_path(spark, "tagged")
    tags.tag(sealed, ring, "vec_id", m.feature_count).write.parquet(path)
    table = spark.read.parquet(path)
    at = next(i for i, w in enumerate(m.weights) if w)
    changed = F.when(kind == 2, F.transform("c", lambda v, i: F.when(i == at, v + 1).otherwise(v))).otherwise(F.col("c"))
    honest = tags.score_tagged(table.withColumn("c", changed).where(kind != 3), m, "vec_id")
    other = m.__class__((m.weights[0] + 1, *m.weights[1:]), m.bias)
    scored = honest.unionByName(tags.score_tagged(table.where(kind == 3), other, "vec_id"))
    scored = scored.withColumn("sealed_sum", F.col("sealed_sum") + F.when(kind == 1, 5).otherwise(0)) \
        .withColumn("tag2", F.when(kind == 4, F.pmod(F.col("tag2") + 1, F.lit(tags.PRIMES[1]))).otherwise(F.col("tag2")))
    return tags.open_tagged(scored, ring, m, "vec_id")


def seal_roundtrip(spark, sf):
    """E5: open(seal(x)) element-wise = x (whole table)."""
    m, ring, _, sealed = _sealed_embeddings(spark, sf)
    return S.to_tall(E.unseal_features(sealed, ring, "vec_id", m.feature_count), "vec_id")


def quantized_lr_verify(spark, sf):
    """Q2 chain: fit L2 logistic regression on the prepared orders, quantize it
    (s_w = 1000, s_x = 1000), score every order sealed, open and verify."""
    from .deploy import fit_quantized_lr, sealed_decisions
    prepared, _ = _prepared_orders(spark, sf)
    feats = [c for c in prepared.columns if c not in ("o_orderkey", "is_f")]
    model = fit_quantized_lr(prepared, feats, "is_f")
    return sealed_decisions(prepared, model, "o_orderkey", "is_f").verified


def _write_derived_model(spark, sf) -> str:
    """The Q2 model derived from the embeddings, written as a JSON model file."""
    coef = quantize_model_q(spark, sf)
    model = coef.agg(F.sort_array(F.collect_list(F.struct("feature_idx", "w"))).alias("p")).select(
        F.lit("LogisticRegression").alias("model_type"), F.lit(1000).alias("scale_factor"),
        F.lit(0).cast("long").alias("bias"), F.transform("p", lambda t: t["w"]).alias("weights"),
        F.size("p").alias("feature_count"))
    path = scratch_path(spark, "model_json")
    model.coalesce(1).write.mode("overwrite").json(path)
    return path


def model_roundtrip(spark, sf):
    """S3: load the model file written from the tables; weights as (feature_idx, w)."""
    from ..sources.model import load_model
    m = load_model(spark, _write_derived_model(spark, sf))
    return spark.createDataFrame(list(enumerate(m.weights)), "feature_idx int, w bigint")


def model_contract_q(spark, sf):
    """V1: contract checks of a model file produced from the tables (Q2 over the
    class-mean direction of the embeddings), written and read back as text."""
    from ..operators.validate import model_contract
    return model_contract(spark, _write_derived_model(spark, sf)).select("check", "ok")


def model_contract_broken(spark, sf):
    """V1 on broken copies of the derived model file: which checks fail."""
    from ..operators.validate import model_contract
    text = spark.read.text(_write_derived_model(spark, sf))
    v = F.col("value")
    copies = {"float weight": F.regexp_replace(v, r'"weights":\[', '"weights":[1.5,'),
              "no bias": F.regexp_replace(v, '"bias":0,', ""),
              "text bias": F.regexp_replace(v, '"bias":0,', '"bias":"x",'),
              "broken JSON": F.substring(v, 1, 60),
              "too large": F.regexp_replace(v, r'"weights":\[-?[0-9]+,', '"weights":[999999999999,')}
    out = None
    for name, value in copies.items():
        path = scratch_path(spark, "broken_model")
        text.select(value.alias("value")).coalesce(1).write.text(path)
        failed = model_contract(spark, path).where(~F.col("ok")).select(F.lit(name).alias("model"), "check")
        out = failed if out is None else out.unionByName(failed)
    return out


def run_log(spark, sf):
    """Two runs appended to a run log (average precision of the `lineitem` model)
    and read back."""
    from ..sources.sinks import append_run_log
    path = scratch_path(spark, "run_log")
    ap = average_precision(spark, sf).first()[0]
    append_run_log(spark, path, "lr", "coarse", "r1", ap)
    append_run_log(spark, path, "rf", "final", "r2", None)
    return spark.read.parquet(path).select("model", "mode", "run_id", F.col("PRAUC").alias("prauc"))


def encrypted_batches(spark, sf):
    """E6 + S9: seal orders in batches of 256, written in the grouped layout; rows
    per batch read back from storage."""
    ring = E.new_keyring(spark)
    sealed = E.sealed_batches(I.orders_features(spark, sf), ring, "o_orderkey", 256, 3)
    path = scratch_path(spark, "sealed_batches")
    E.write_sealed_batches(sealed, path)
    return spark.read.parquet(path).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"))


def appended_batches(spark, sf):
    """Orders sealed in three runs by key, the second one twice (a replay); batch
    ids go on from run to run; rows per batch read back from storage."""
    ring = E.new_keyring(spark)
    rows = I.orders_features(spark, sf)
    path = scratch_path(spark, "appended")
    for part in (0, 1, 1, 2):
        mine = rows.where(F.pmod(F.col("o_orderkey"), F.lit(3)) == part)
        E.append_sealed_batches(mine, ring, "o_orderkey", 256, 3, path, part)
    return E.read_appended_batches(spark, path).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"))


def rekeyed_score_opened(spark, sf):
    """Embeddings sealed, moved to a fresh keyring without opening, scored and opened
    with the new keys; equals the plain score.  Both keyrings go through the register."""
    m, ring, _, sealed = _sealed_embeddings(spark, sf)
    fresh = E.new_keyring(spark, ("n0", "n1", "n2"))
    register = scratch_path(spark, "key-register")
    for keys in (ring, fresh):
        E.register_keys(keys, register)
    moved = E.rekey(sealed, ring, fresh, "vec_id", m.feature_count)
    return E.open_scores(E.score_sealed(moved, m, "vec_id"), fresh, m, "vec_id")


def verify_scores(spark, sf):
    """V2/V3: every opened sealed score vs the plain formula (via the keyed
    commitment made at sealing time); PASS iff all rows match."""
    from .validation import sealed_check
    return sealed_check(I.embedding_features(spark, sf), I.embedding_model(), "vec_id",
                        E.new_keyring(spark))


def validation_report(spark, sf):
    """V4/V6: the staged run with time, rows/s and machine-cost columns."""
    from .validation import run_pyramid
    return run_pyramid(spark, I.embedding_features(spark, sf), I.embedding_model(), "vec_id")


def validation_pyramid(spark, sf):
    """SANITY 5×5, CRYPTO all×1, SATURATION all×16 on the embeddings
    (time columns left out of the comparison)."""
    from .validation import STAGES, run_pyramid
    stages = (*STAGES, ("TOO WIDE", "skipped: wider than the model", 10_000, 1))
    report = run_pyramid(spark, I.embedding_features(spark, sf), I.embedding_model(), "vec_id", stages)
    return report.drop("seconds", "rows_per_sec", "cost_usd")


# --------------------------------------------------------------------- metrics
def _lineitem_points(spark, sf):
    m = I.lineitem_model()
    s = S.with_probability(S.score_array(I.lineitem_features(spark, sf), m,
                                         keep=["label"]), m)
    return M.curve_points(s, "label", "score", threshold_col="prob")


def pr_curve(spark, sf):
    """M1: one point per distinct score + final (1, 0) point."""
    return M.pr_curve(_lineitem_points(spark, sf))


def average_precision(spark, sf):
    """M3: step-wise average precision."""
    return M.round_all(M.areas(_lineitem_points(spark, sf)).select("average_precision"))


def pr_auc_trapezoid(spark, sf):
    """M4: trapezoid area under the PR curve incl. the (recall 0, precision 1) point."""
    return M.round_all(M.areas(_lineitem_points(spark, sf)).select("pr_auc_trapezoid"))


def roc_auc(spark, sf):
    """M5: tie-aware ROC-AUC."""
    return M.round_all(M.areas(_lineitem_points(spark, sf)).select("roc_auc"))


def threshold_at_precision(spark, sf):
    """M2: threshold with the highest recall at precision ≥ 0.95."""
    return M.round_all(M.threshold_at_precision(_lineitem_points(spark, sf)))


def threshold_smoke(spark, sf):
    """Lowest threshold with precision ≥ 0.95, final point included."""
    return M.round_all(M.threshold_smoke(_lineitem_points(spark, sf)))


def metric_summary(spark, sf):
    """M6: every metric in one row."""
    return M.round_all(M.metric_summary(_lineitem_points(spark, sf)))


def merged_metrics(spark, sf):
    """M6 from states: `lineitem` scored and stored part by part (line numbers), one
    part put twice; the metrics of the merged states are those of the whole table."""
    from ..operators import metric_state
    m = I.lineitem_model()
    s = S.with_probability(S.score_array(I.lineitem_features(spark, sf), m, keep=["label", "l_linenumber"]), m)
    path = scratch_path(spark, "metric-state")
    parts = sorted(r[0] for r in s.select("l_linenumber").distinct().collect())
    for part in [*parts, parts[0]]:
        metric_state.put(s.where(F.col("l_linenumber") == part), path, f"line{part}", threshold_col="prob")
    return M.round_all(M.metric_summary(metric_state.curve_points(spark, path, "long")))


def _direction_points(spark, sf):
    """Curve points of the class-mean-direction model (Q2 weights, fitted on the
    embeddings) scored on the same rows; label = (label = 0)."""
    from ..sources.model import LinearModel
    w = sorted((r["feature_idx"], r["w"]) for r in quantize_model_q(spark, sf).collect())
    model = LinearModel(tuple(int(v) for _, v in w), 0)
    x = I.embedding_features(spark, sf).withColumn("y", (F.col("label") == 0).cast("int"))
    scored = S.score_array(x, model, keep=["y"])
    return M.curve_points(scored, "y", "score", threshold_col=F.col("score").cast("double"))


def threshold_qualifying(spark, sf):
    """M2 where some point reaches precision 0.95: the in-sample class-mean model."""
    return M.round_all(M.threshold_at_precision(_direction_points(spark, sf)))


def average_precision_direction(spark, sf):
    """M3/M5 of the class-mean model (an informative score)."""
    return M.round_all(M.areas(_direction_points(spark, sf)))


# ---------------------------------------------------------------------- splits
def _labels(spark, sf):
    return read_table(spark, sf, "labels", "doc_id", "toxic")


def stratified_split(spark, sf):
    """20 % stratified hold-out, exact per-class sizes, seeded."""
    return T.stratified_split(_labels(spark, sf), "toxic", "doc_id", 0.2)


def stratified_split_counts(spark, sf):
    """Class × split counts."""
    s = T.stratified_split(_labels(spark, sf), "toxic", "doc_id", 0.2)
    return s.groupBy("toxic", "is_test").agg(F.count(F.lit(1)).alias("n"))


def stratified_folds(spark, sf):
    """5 shuffled stratified folds."""
    return T.stratified_folds(_labels(spark, sf), "toxic", "doc_id", 5, shuffle=True)


def stratified_folds_counts(spark, sf):
    """Class × fold counts."""
    f = T.stratified_folds(_labels(spark, sf), "toxic", "doc_id", 5, shuffle=True)
    return f.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n"))


def folds_by_order(spark, sf):
    """2 unshuffled stratified folds (rows in id order)."""
    return T.stratified_folds(_labels(spark, sf), "toxic", "doc_id", 2, shuffle=False)


def class_weights(spark, sf):
    """T4: balanced class weights n / (k·n_c)."""
    lab = _labels(spark, sf)
    return lab.select("doc_id", "toxic",
                      _r(T.class_weight_column(lab, "toxic", "balanced")).alias("weight"))


# ---------------------------------------------------------------------- models
def _embedding_table(spark, sf):
    e = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    size = F.size("embedding")
    low, high = e.agg(F.min(size), F.max(size)).first()
    if low != high:
        raise ValueError(f"embeddings of {low} to {high} dimensions")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i:02d}")
                                for i in range(high or 0)],
                    (F.col("label") == 0).cast("int").alias("is_zero"))


def _fit_predict(spark, sf, model, params):
    from ..operators import models as ML
    data = _embedding_table(spark, sf)
    split = T.stratified_split(data, "is_zero", "vec_id", 0.2)
    feats = [c for c in data.columns if c.startswith("e")]
    train = ML.with_weight_columns(split.where(~F.col("is_test")), "is_zero", [params])
    test = split.where(F.col("is_test"))
    ws = ML._weight_sum(train, params) if model == "lr" else None
    fitted = ML.make_pipeline(model, params, feats, "is_zero", None, ws).fit(train)
    return ML.positive_probability(fitted.transform(test)).select("vec_id", _r("prob").alias("prob"))


def lr_embeddings(spark, sf):
    """T5: L2 logistic regression (C=0.1, balanced) on the embeddings, hold-out probabilities."""
    return _fit_predict(spark, sf, "lr", {"C": 0.1, "class_weight": "balanced", "max_iter": 1000})


def rf_embeddings(spark, sf):
    """Random forest (20 trees, depth 4, sqrt features, weights {0:1, 1:10})."""
    return _fit_predict(spark, sf, "rf", {"n_estimators": 20, "max_depth": 4, "max_features": "sqrt",
                                          "min_samples_leaf": 1, "class_weight": {0: 1, 1: 10}})


def gbt_embeddings(spark, sf):
    """Gradient-boosted trees (20 rounds, depth 3, learning rate 0.1)."""
    return _fit_predict(spark, sf, "xgb", {"n_estimators": 20, "max_depth": 3, "learning_rate": 0.1,
                                           "subsample": 1.0, "colsample_bytree": 1.0})


def _fit_on_urgency(spark, sf, model, params, digits):
    """A model of one yes/no feature (urgent order) on all orders; label: status F."""
    from ..operators import models as ML
    o = read_table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").select(
        "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_f"))
    data = ML.with_weight_columns(o, "is_f", [params])
    ws = ML._weight_sum(data, params) if model == "lr" else None
    fitted = ML.make_pipeline(model, params, ["urgent"], "is_f", None, ws).fit(data)
    return ML.positive_probability(fitted.transform(o)).select("o_orderkey", _r("prob", digits).alias("prob"))


def lr_fit_predict(spark, sf):
    """T5: balanced logistic regression on one yes/no feature with hardly any
    penalty: the weighted rate of each group."""
    return _fit_on_urgency(spark, sf, "lr", {"C": 1e9, "class_weight": "balanced", "max_iter": 1000}, 3)


def rf_fit_predict(spark, sf):
    """One tree of depth 1 on all rows, weights {0:1, 1:10}: the weighted leaf rates."""
    return _fit_on_urgency(spark, sf, "rf", {"n_estimators": 1, "max_depth": 1, "max_features": "all",
                                             "bootstrap": False, "class_weight": {0: 1, 1: 10}}, 6)


def gbt_fit_predict(spark, sf):
    """One boosting round of depth 1: 1 / (1 + exp(-2 (2 rate - 1))) per leaf."""
    return _fit_on_urgency(spark, sf, "xgb", {"n_estimators": 1, "max_depth": 1}, 6)


def search_rank(spark, sf):
    """Three integer models scored on three folds of the embeddings: average
    precision per fold, mean, population deviation and rank."""
    from ..operators import models as ML
    from ..sources.model import LinearModel
    m = I.embedding_model()
    half = tuple(w if i < 32 else 0 for i, w in enumerate(m.weights))
    models = [m, LinearModel(half, m.bias), LinearModel(tuple(-w for w in m.weights), m.bias)]
    x = I.embedding_features(spark, sf).select(
        "x", (F.col("label") == 0).cast("int").alias("label"), (F.col("vec_id") % 3).cast("int").alias("fold"))
    parts = [S.score_array(x, one, keep=["label", "fold"]).withColumn("fold", F.col("fold") + 3 * i)
             for i, one in enumerate(models)]
    got = {r["fold"]: r["average_precision"] for r in M.average_precision_by(
        parts[0].unionByName(parts[1]).unionByName(parts[2]), "fold").collect()}
    scores = {i: [got[3 * i + f] for f in range(3)] for i in range(3)}
    return M.round_all(ML.results_table(spark, [{"model": i} for i in range(3)], scores, 3)).drop("params")


def search_best(spark, sf):
    """The candidate of :func:`search_rank` with the highest mean."""
    from ..operators import models as ML
    return spark.createDataFrame([(ML.best_candidate(search_rank(spark, sf)),)], "candidate int")


def _urgent_folds(spark, sf):
    o = read_table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").select(
        "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_f"))
    return T.stratified_folds(o, "is_f", "o_orderkey", 3)


def search_closed_form(spark, sf):
    """Regressions on one yes/no feature, four candidates on three folds in
    shared passes: the held-out order is that of the training rates.  The search is
    begun with one candidate and goes on from its kept scores."""
    from ..operators import models as ML
    folded = _urgent_folds(spark, sf)
    candidates = ML.expand_grid({"C": [0.1, 1e6], "class_weight": ["balanced", None]})
    state = ML.SearchState(spark, scratch_path(spark, "search-state"), "urgent")
    ML.cross_validate(folded, "lr", candidates[:1], ["urgent"], "is_f", state=state)
    table = ML.cross_validate(folded, "lr", candidates, ["urgent"], "is_f", state=state)
    return M.round_all(table).drop("params").withColumn("fits", F.lit(state.table().count()).cast("long"))


def search_coefficients(spark, sf):
    """The shared-pass regressions of every fold, hardly penalised: log odds of
    the training rates, weighted or not."""
    from ..operators import models as ML
    from ..operators import shared_lr as LR
    folded = _urgent_folds(spark, sf)
    counts = ML.fold_counts(folded, "fold", "is_f")
    kinds = [(f, w) for f in sorted(counts) for w in ("balanced", None)]
    by = [ML.training_weights(counts, f, w) for f, w in kinds]
    tasks = LR.fit(folded, [LR.Task(f, 1e12, (w[0], w[1])) for (f, _), w in zip(kinds, by)], ["urgent"], "is_f", "fold",
                   None, counts)
    rows = [(f, w or "none", round(float(t.beta[1]), 5), round(float(t.beta[0]), 5)) for (f, w), t in zip(kinds, tasks)]
    return spark.createDataFrame(rows, "fold int, weights string, intercept double, slope double")


def train_all_models(spark, sf):
    """T13 for every model kind on the prepared orders, each with the whole search of its
    'coarse' mode: rows of the parts, candidates and folds run, and whether the summary
    equals metrics recomputed from the scores.  All kinds share one hold-out."""
    from ..operators import models as ML
    from .train import refolded, split_parts, train
    prepared, _ = _prepared_orders(spark, sf)
    n, rows, parts = prepared.count(), [], None
    for kind in ("lr", "rf", "xgb"):
        n_iter, k, grid = ML.SEARCH_SPACES[kind]["coarse"]
        parts = refolded(parts, k) if parts else split_parts(prepared, "o_orderkey", "is_f", k)
        res = train(prepared, kind, "coarse", "o_orderkey", "is_f", scale_col="o_totalprice",
                    parallelism=4, parts=parts, in_tasks=True)
        candidates = ML.sample_candidates(grid, n_iter)
        again = M.metric_summary(M.curve_points(res.scored, "is_f", "prob")).first()
        told = res.summary.first()
        n_test = res.scored.count()
        same = all(abs(told[a] - again[b]) < 1e-9 for a, b in (
            ("pr_auc", "average_precision"), ("roc_auc", "roc_auc"), ("thr", "thr"), ("rec_at_thr", "rec_at_thr")))
        table = res.results.collect()
        best = max(table, key=lambda r: (r["mean_score"], -r["candidate"]))
        rows.append((kind, n - n_test, n_test, len(table), len([c for c in res.results.columns if c.startswith("split")]),
                     same, told["best_params"] == str(candidates[best["candidate"]])))
    return spark.createDataFrame(rows, "model string, n_train long, n_test long, n_candidates long, n_folds long, "
                                       "metrics_match boolean, best_is_used boolean")


def artifact_roundtrip(spark, sf):
    """Fitted preparation saved, loaded and applied to the joined table again."""
    from .prepare import FittedPrep
    _, fit = _prepared_orders(spark, sf)
    path = scratch_path(spark, "prep")
    fit.save(spark, path)
    joined = I.orders_customer(spark, sf).withColumn("is_f", (F.col("o_orderstatus") == "F").cast("int"))
    return M.round_all(FittedPrep.load(spark, path).transform(joined))


def metadata_json(spark, sf):
    """The metadata row written as JSON and read back."""
    from ..sources.sinks import write_json
    frame = dataset_metadata(spark, sf)
    path = scratch_path(spark, "metadata")
    write_json(frame, path)
    return spark.read.schema(frame.schema).json(path)


def cost_report(spark, sf):
    """V4/V6: rate and machine cost of every event, its value taken as seconds (and
    3 ms, which keeps costs off the halves where rounding rules differ)."""
    from ..operators.validate import cost_columns
    e = read_table(spark, sf, "events", "event_id", "value").select(
        "event_id", (F.col("value") + 0.003).alias("seconds"), F.lit(3600).alias("rows"))
    return cost_columns(e).drop("rows")


def search_results(spark, sf):
    """The smoke grid (6 forest candidates × 2 unshuffled folds), scored
    by average precision; results table with rank."""
    from ..operators import models as ML
    data = _embedding_table(spark, sf)
    folded = T.stratified_folds(data, "is_zero", "vec_id", 2, shuffle=False)
    cands = [dict(c, **ML.SMOKE_FIXED) for c in ML.expand_grid(ML.SMOKE_GRID)]
    feats = [c for c in data.columns if c.startswith("e")]
    return M.round_all(ML.cross_validate(folded, "rf", cands, feats, "is_zero", parallelism=4))


def randomized_search(spark, sf):
    """The logistic-regression 'coarse' space (10 of 16 candidates, seeded
    draw without replacement) × 3 shuffled stratified folds, average precision."""
    from ..operators import models as ML
    data = _embedding_table(spark, sf)
    n_iter, k, grid = ML.SEARCH_SPACES["lr"]["coarse"]
    folded = T.stratified_folds(data, "is_zero", "vec_id", k, shuffle=True)
    feats = [c for c in data.columns if c.startswith("e")]
    cands = ML.sample_candidates(grid, n_iter)
    return M.round_all(ML.cross_validate(folded, "lr", cands, feats, "is_zero", parallelism=4))


def train_run(spark, sf):
    """Logistic regression 'final' run on the prepared orders table
    (scale o_totalprice inside the folds, 5 folds, hold-out metrics)."""
    from .train import train
    prepared, _ = _prepared_orders(spark, sf)
    res = train(prepared, "lr", "final", "o_orderkey", "is_f", scale_col="o_totalprice",
                parallelism=5)
    return M.round_all(res.summary.drop("run_id"))


QUERIES = {
    "scan_parquet": scan_parquet,
    "parquet_roundtrip": parquet_roundtrip,
    "csv_roundtrip": csv_roundtrip,
    "table_shape": table_shape_q,
    "column_roles": column_roles_q,
    "drop_cols": drop_cols,
    "label_cast": label_cast,
    "narrow_types": narrow_types,
    "int_or_zero": int_or_zero_q,
    "uint64_reinterpret": uint64_reinterpret_q,
    "quantize_features": quantize_features,
    "quantize_model": quantize_model_q,
    "prefix_features": prefix_features,
    "zip_truncate": zip_truncate,
    "first_n_rows": first_n_rows,
    "batch_slices": batch_slices_q,
    "left_join_identity": left_join_identity,
    "left_join_nullsafe": left_join_nullsafe,
    "impute_median": impute_median,
    "impute_constant": impute_constant_q,
    "ordinal_encode": ordinal_encode,
    "ordinal_encode_unknown": ordinal_encode_unknown,
    "standard_scale": standard_scale,
    "scale_passthrough": scale_passthrough,
    "prepare_e2e": prepare_e2e,
    "dataset_metadata": dataset_metadata,
    "linear_score": linear_score,
    "linear_score_wrapping": linear_score_wrapping,
    "dot_product_unsigned": dot_product_unsigned,
    "score_table": score_table,
    "score_probability": score_probability,
    "flag_fraud": flag_fraud,
    "sealed_differs_from_plain": sealed_differs_from_plain,
    "sealed_score": sealed_score,
    "sealed_score_opened": sealed_score_opened,
    "shared_score_opened": shared_score_opened,
    "tampered_rows": tampered_rows,
    "seal_roundtrip": seal_roundtrip,
    "quantized_lr_verify": quantized_lr_verify,
    "model_contract": model_contract_q,
    "model_contract_broken": model_contract_broken,
    "model_roundtrip": model_roundtrip,
    "run_log": run_log,
    "encrypted_batches": encrypted_batches,
    "appended_batches": appended_batches,
    "rekeyed_score_opened": rekeyed_score_opened,
    "verify_scores": verify_scores,
    "validation_pyramid": validation_pyramid,
    "validation_report": validation_report,
    "pr_curve": pr_curve,
    "average_precision": average_precision,
    "pr_auc_trapezoid": pr_auc_trapezoid,
    "roc_auc": roc_auc,
    "threshold_at_precision": threshold_at_precision,
    "threshold_smoke": threshold_smoke,
    "metric_summary": metric_summary,
    "merged_metrics": merged_metrics,
    "threshold_qualifying": threshold_qualifying,
    "average_precision_direction": average_precision_direction,
    "stratified_split": stratified_split,
    "stratified_split_counts": stratified_split_counts,
    "stratified_folds": stratified_folds,
    "stratified_folds_counts": stratified_folds_counts,
    "folds_by_order": folds_by_order,
    "class_weights": class_weights,
    "lr_fit_predict": lr_fit_predict,
    "rf_fit_predict": rf_fit_predict,
    "gbt_fit_predict": gbt_fit_predict,
    "lr_embeddings": lr_embeddings,
    "rf_embeddings": rf_embeddings,
    "gbt_embeddings": gbt_embeddings,
    "search_rank": search_rank,
    "search_best": search_best,
    "search_closed_form": search_closed_form,
    "search_coefficients": search_coefficients,
    "train_all_models": train_all_models,
    "artifact_roundtrip": artifact_roundtrip,
    "metadata_json": metadata_json,
    "cost_report": cost_report,
    "search_results": search_results,
    "randomized_search": randomized_search,
    "train_run": train_run,
}
