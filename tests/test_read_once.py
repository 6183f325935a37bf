"""Steps that a file or a text goes through once."""

from conftest import SF001
from tabtext.operators import features as FE
from tabtext.plans import fixtures as X
from tabtext.plans import jobs as J
from tabtext.sources import csv as SC


def test_attributions_infer_the_class_only(spark, tmp_path, monkeypatch):
    path = tmp_path / "shap.csv"
    path.write_text("sample,token,class,shap_value\n1,12,0,0.5\n2.0,NA,1,-1\n,7,1,NA\n")
    seen, infer = [], SC.infer_types
    monkeypatch.setattr(SC, "infer_types", lambda d: seen.append(d.columns) or infer(d))
    got = SC.read_attributions(spark, str(path))
    assert seen == [["class"]]
    assert got.dtypes == [("sample", "bigint"), ("token", "string"), ("class", "bigint"), ("shap_value", "double")]
    assert [tuple(r) for r in got.collect()] == [(1, "12", 0, 0.5), (2, None, 1, -1.0), (None, "7", 1, None)]


def test_types_of_odd_numbers(spark):
    rows = [("1e3", "Infinity", " -7 ", "x", "true"), ("-.5", "nan_", "8", "1", "False"), ("3d", "1", None, "2", None)]
    d = SC.infer_types(spark.createDataFrame(rows, "a string, b string, c string, d string, e string"))
    assert d.dtypes == [("a", "double"), ("b", "string"), ("c", "double"), ("d", "string"), ("e", "boolean")]


def test_a_fitted_vocabulary_is_not_counted_again(spark, monkeypatch):
    calls, vocabulary = [], FE.vocabulary
    monkeypatch.setattr(FE, "vocabulary", lambda *a, **k: calls.append(1) or vocabulary(*a, **k))
    out = J.text_model_leave_one_out(X.fx_text_reg(spark, SF001).drop("lang"), classifier=False, profile="fast", vocab_size=50)
    assert len(calls) == 1
    assert out.filter("shap_value <> 0").count() > 0
