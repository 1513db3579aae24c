import json

from veilscore.operators import seal as E
from veilscore.operators.validate import cost_columns, model_contract
from veilscore.plans import inputs as I
from veilscore.plans.validation import run_pyramid
from veilscore.sources.model import LinearModel, load_model, save_model, sample_model
from veilscore.streaming.scoring import score_stream, sealed_score_stream
from tests.conftest import SF_SMALL


def _write(path, text):
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_model_contract(spark, tmp_out):
    good = _write(f"{tmp_out}/good.json", json.dumps({"bias": -2, "weights": [1, 2], "feature_count": 2}))
    ok = {r["check"]: r["ok"] for r in model_contract(spark, good).collect()}
    assert all(ok.values())
    bad_float = _write(f"{tmp_out}/f.json", json.dumps({"bias": -2, "weights": [1, 2.5]}))
    assert {r["check"]: r["ok"] for r in model_contract(spark, bad_float).collect()}["weights_int"] is False
    bad_bias = _write(f"{tmp_out}/b.json", json.dumps({"bias": "x", "weights": [1]}))
    assert {r["check"]: r["ok"] for r in model_contract(spark, bad_bias).collect()}["bias_int"] is False
    missing = _write(f"{tmp_out}/m.json", json.dumps({"weights": [1]}))
    assert {r["check"]: r["ok"] for r in model_contract(spark, missing).collect()}["has_bias"] is False
    broken = _write(f"{tmp_out}/x.json", "{not json")
    assert {r["check"]: r["ok"] for r in model_contract(spark, broken).collect()}["parses"] is False
    none = {r["check"]: r["ok"] for r in model_contract(spark, f"{tmp_out}/nope.json").collect()}
    assert none == {"exists": False}


def test_model_save_load(spark, tmp_out):
    p = f"{tmp_out}/model.json"
    save_model(spark, sample_model(), p)
    m = load_model(spark, p)
    assert m.weights == sample_model().weights and m.bias == -2 and m.scale_factor == 1000


def test_cost_columns(spark):
    df = spark.createDataFrame([(3600.0, 10)], "seconds double, rows long")
    r = cost_columns(df).first()
    assert r["cost_usd"] == 0.78 and r["rows_per_sec"] == round(10 / 3600, 2)


def test_pyramid_skips_wide_stage_and_passes(spark):
    m = LinearModel(tuple(range(1, 4)), bias=1)
    x = I.embedding_features(spark, SF_SMALL)
    stages = (("SANITY", "I/O", 2, 5), ("TOO_WIDE", "skip", 10, 1), ("ALL", "all", None, None))
    rep = {r["category"]: r for r in run_pyramid(spark, x, m, "vec_id", stages).collect()}
    assert set(rep) == {"SANITY", "ALL"}
    assert rep["SANITY"]["rows"] == 5 and rep["SANITY"]["status"] == "PASS"
    assert rep["ALL"]["status"] == "PASS" and rep["ALL"]["rows"] == x.count()


def test_streaming_scores_equal_batch(spark, tmp_out):
    src = f"{tmp_out}/src"
    raw = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    raw.write.parquet(src)
    m = I.embedding_model()
    q = score_stream(spark, src, raw.schema, m,
                     lambda df: df.select("vec_id", __import__("veilscore.functions.intcols", fromlist=["x"])
                                          .quantize_array("embedding", 1000).alias("x")),
                     "vec_id", f"{tmp_out}/out", f"{tmp_out}/ckpt")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_out}/out")
    from veilscore.plans.registry import linear_score
    exp = linear_score(spark, SF_SMALL)
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_sealed_stream(spark, tmp_out):
    m = I.embedding_model()
    ring = E.new_keyring(spark)
    sealed = E.seal(I.embedding_features(spark, SF_SMALL), ring, "vec_id", width=64)
    sealed.write.parquet(f"{tmp_out}/sealed")
    q = sealed_score_stream(spark, f"{tmp_out}/sealed", sealed.schema, m, "vec_id",
                            f"{tmp_out}/sout", f"{tmp_out}/sckpt")
    q.awaitTermination(120)
    opened = E.open_scores(spark.read.parquet(f"{tmp_out}/sout"), ring, m, "vec_id", out="got")
    from veilscore.plans.registry import linear_score
    j = opened.join(linear_score(spark, SF_SMALL), "vec_id")
    assert j.where("got = score").count() == j.count() > 0


def test_quantized_chain_decisions(spark):
    from pyspark.sql import functions as F
    from veilscore.plans.deploy import fit_quantized_lr, sealed_decisions
    rows = [(i, float(i % 13) / 13, float((i * 7) % 5) / 5, int(i % 13 > 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    model = fit_quantized_lr(df, ["a", "b"], "y")
    assert model.scale_factor == 1000 and len(model.weights) == 2
    run = sealed_decisions(df, model, "id", "y")
    assert run.verified.first()["status"] == "PASS"
    d = run.decisions()
    assert d.count() == 300 and set(r[0] for r in d.select("flag").distinct().collect()) <= {0, 1}
    assert run.threshold.first()["prec_at_thr"] >= 0.95 or run.threshold.first()["thr"] == 0.5


def test_sinks_and_run_id(spark, tmp_out):
    import re
    from veilscore.sources import sinks
    rid = sinks.run_id(spark)
    assert re.fullmatch(r"\d{8}-\d{6}", rid)
    sinks.append_run_log(spark, f"{tmp_out}/log", "lr", "final", rid, 0.123456)
    sinks.append_run_log(spark, f"{tmp_out}/log", "lr", "final", rid, 0.5)
    log = spark.read.parquet(f"{tmp_out}/log")
    assert log.count() == 2 and sorted(r["PRAUC"] for r in log.collect()) == [0.1235, 0.5]
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    paths = sinks.save_artifacts({"codes": df}, f"{tmp_out}/art")
    assert spark.read.parquet(paths["codes"]).count() == 1
    sinks.write_csv(df, f"{tmp_out}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_out}/csv").columns == ["x", "y"]


def test_synthetic_unsigned_range(spark):
    from veilscore.sources.synthetic import synthetic_unsigned
    df = synthetic_unsigned(spark, 50, 5)
    vals = [v for r in df.collect() for v in r]
    assert df.columns == [f"feat_{i}" for i in range(5)] and min(vals) >= 0 and max(vals) < 10


def test_seal_stream_then_open(spark, tmp_out):
    from veilscore.functions.intcols import quantize_array
    from veilscore.streaming.scoring import seal_stream
    from veilscore.plans.registry import linear_score
    src = f"{tmp_out}/src"
    raw = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    raw.write.parquet(src)
    m = I.embedding_model()
    ring = E.new_keyring(spark)
    q = seal_stream(spark, src, raw.schema, ring,
                    lambda df: df.select("vec_id", quantize_array("embedding", 1000).alias("x")),
                    "vec_id", 64, f"{tmp_out}/sealed", f"{tmp_out}/ck")
    q.awaitTermination(120)
    sealed = spark.read.parquet(f"{tmp_out}/sealed")
    opened = E.open_scores(E.score_sealed(sealed, m, "vec_id"), ring, m, "vec_id", out="got")
    j = opened.join(linear_score(spark, SF_SMALL), "vec_id")
    assert j.count() == raw.count() and j.where("got = score").count() == j.count()
