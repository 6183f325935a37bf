"""Closed-form leave-one-out attributions equal rescoring without the term."""

import math

import pytest
from pyspark.sql import functions as F

from tabtext.operators.attributions import linear_leave_one_out

DOCS = {1: {"aa": 2.0, "bb": 1.5, "cc": 0.5}, 2: {"aa": 1.0}, 3: {"bb": 3.0, "dd": 0.25}}
W = {"aa": [0.5, -1.0, 0.1], "bb": [-0.25, 2.0, 0.0], "cc": [1.0, 1.0, -3.0], "dd": [0.0, 0.3, 0.7]}
BIAS = [0.1, -0.2, 0.3]


def outputs(doc, k, link):
    norm = math.sqrt(sum(v * v for v in doc.values()))
    z = [sum(v * W[t][i] for t, v in doc.items()) / norm + BIAS[i] if doc else BIAS[i] for i in range(k)]
    if link == "identity":
        return z
    e = [math.exp(x) for x in z]
    return [math.log(x / (sum(e) - x)) for x in e]


@pytest.mark.parametrize("k, link", [(1, "identity"), (3, "identity"), (2, "softmax_logit"), (3, "softmax_logit")])
def test_equals_rescoring(spark, k, link):
    rows = [(d, t, v, W[t][:k]) for d, doc in DOCS.items() for t, v in doc.items()]
    got = linear_leave_one_out(spark.createDataFrame(rows, "key int, term string, raw double, w array<double>"), BIAS[:k], link=link)
    want = {}
    for d, doc in DOCS.items():
        for t in doc:
            rest = {x: v for x, v in doc.items() if x != t}
            for c, (f, r) in enumerate(zip(outputs(doc, k, link), outputs(rest, k, link))):
                want[d, t, c] = f - r
    got = {(r["sample"], r["token"], r["class"]): r["shap_value"] for r in got.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_model_attributions_equal_the_models_own_scores(spark):
    """The classifier's logits of a document equal the sum that the closed form starts from."""
    from conftest import SF001
    from tabtext.plans import fixtures as X
    from tabtext.plans import jobs as J
    df = X.fx_text_class(spark, SF001).drop("n_chars")
    loo = J.text_model_leave_one_out(df, profile="fast", vocab_size=200)
    scorer = J.scorer_occlusion_attributions(df, num=3, profile="fast", vocab_size=200)
    keys = [r[0] for r in scorer.select("sample").distinct().collect()]
    a = {(r["sample"], r["token"], r["class"]): r["shap_value"] for r in loo.filter(F.col("sample").isin(keys)).collect()}
    once = scorer.groupBy("sample", "token", "class").agg(F.count(F.lit(1)).alias("n"), F.first("shap_value").alias("v")).filter("n = 1")
    checked = 0
    for r in once.collect():
        if (r["sample"], r["token"], r["class"]) in a:
            assert abs(a[r["sample"], r["token"], r["class"]] - r["v"]) < 1e-6
            checked += 1
    assert checked > 20


def test_tokens_outside_the_vocabulary_have_rows(spark):
    """Every (document, token) cell has one row per class; without a vocabulary entry the value is 0."""
    from tabtext.operators import features as FE
    from tabtext.plans import jobs as J
    rows = [(1, "train", "good fine good", 1), (2, "train", "bad poor bad", 0), (3, "train", "good bad", 1), (4, "valid", "good rare", 1),
            (5, "valid", "unseen unheard", 0), (6, "valid", "bad good odd", 0)]
    df = spark.createDataFrame(rows, "key int, split string, sentence string, label int")
    want = {(r["key"], r["term"]) for r in FE.doc_terms(df.filter("split = 'valid'")).collect()}
    assert len(want) == 7
    for out, classes in [(J.text_linear_leave_one_out(df, vocab_size=2), 1), (J.text_model_leave_one_out(df, vocab_size=2), 2),
                         (J.text_model_leave_one_out(df, classifier=False, vocab_size=2), 1)]:
        got = {(r["sample"], r["token"], r["class"]): r["shap_value"] for r in out.collect()}
        assert got.keys() == {(k, t, c) for k, t in want for c in range(classes)}
        assert all((v == 0.0) == (t not in ("good", "bad")) for (_, t, _), v in got.items())
