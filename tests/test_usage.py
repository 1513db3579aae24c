"""The README usage example, on the driver tables (orders as transactions,
customer as identity)."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_readme_workflow(spark, tmp_out):
    from veilscore.operators import seal as E
    from veilscore.operators.validate import verify_counts
    from veilscore.plans.deploy import fit_quantized_lr
    from veilscore.plans.prepare import prepare
    from veilscore.plans.train import train
    from veilscore.sources.model import load_model, save_model

    tx = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
        (F.col("o_orderstatus") == "F").cast("int").alias("is_f"))
    identity = spark.read.parquet(f"{SF_SMALL}/customer.parquet").select(
        F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    prepared, fitted = prepare(tx, identity, key="o_custkey", label_col="is_f", id_col="o_orderkey")
    assert fitted.categorical == ["o_orderpriority", "c_mktsegment"]

    run = train(prepared, "lr", "final", id_col="o_orderkey", label_col="is_f",
                scale_col="o_totalprice", n_folds=2, parallelism=2)
    assert run.summary.count() == 1

    feats = [c for c in prepared.columns if c not in ("o_orderkey", "is_f")]
    path = f"{tmp_out}/model.json"
    save_model(spark, fit_quantized_lr(prepared, feats, "is_f"), path)
    model = load_model(spark, path)
    from veilscore.functions.intcols import quantize
    features = prepared.select(F.col("o_orderkey").alias("id"),
                               F.array(*[quantize(c, model.feature_scale) for c in feats]).alias("x"))
    ring = E.new_keyring(spark, ["k0", "k1", "k2"])            # rows spread over three keys
    sealed = E.seal(features, ring, "id", width=model.feature_count, commit_to=model)
    scored = E.score_sealed(sealed, model, "id", keep=["commit"])
    checked = E.open_and_verify(scored, ring, model, "id")
    v = verify_counts(features, checked).first()
    assert v["status"] == "PASS" and v["n_rows"] == tx.count()
    assert sealed.select("key_id").distinct().count() == 3
