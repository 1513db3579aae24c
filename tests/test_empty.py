"""FIXTURES `empty`: every operator returns an empty or null result, no error."""

from veilscore.operators import metrics as M
from veilscore.operators import score as S
from veilscore.operators import seal as E
from veilscore.operators import split as T
from veilscore.operators.encode import fit_ordinal_encoder
from veilscore.operators.impute import fit_median_imputer
from veilscore.operators.join import left_join
from veilscore.operators.project import batch_slices, table_shape
from veilscore.operators.ranking import exact_medians, row_index
from veilscore.operators.scale import fit_standard_scaler
from veilscore.operators.validate import verify_counts
from veilscore.sources.model import LinearModel


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "id long, y int, v double, c string")
    assert row_index(df, ["id"]).count() == 0
    assert exact_medians(df.selectExpr("'v' AS feature", "v AS value")).count() == 0
    imp = fit_median_imputer(df, ["v"])
    assert imp.medians == {} and imp.dropped == ["v"]
    assert fit_standard_scaler(df, ["v"]).transform(df).count() == 0
    assert fit_ordinal_encoder(df, ["c"]).transform(df).count() == 0
    assert left_join(df, df.select("id", "c"), "id").count() == 0
    assert table_shape(df).first()["n_rows"] == 0
    assert batch_slices(df, 10, ["id"]).count() == 0
    assert T.stratified_split(df, "y", "id").count() == 0
    assert T.stratified_folds(df, "y", "id", 3).count() == 0
    a = M.areas(M.curve_points(df.selectExpr("y AS label", "v AS score"))).first()
    assert a["average_precision"] is None and a["roc_auc"] is None
    x = spark.createDataFrame([], "id long, x array<bigint>")
    m = LinearModel((1, 2), bias=3)
    assert S.score_array(x, m, keep=["id"]).count() == 0
    ring = E.new_keyring(spark)
    sealed = E.seal(x, ring, "id", width=2, commit_to=m)
    checked = E.open_and_verify(E.score_sealed(sealed, m, "id", keep=["commit"]), ring, m, "id")
    v = verify_counts(x, checked).first()
    assert (v["n_rows"], v["n_match"], v["status"]) == (0, 0, "PASS")
