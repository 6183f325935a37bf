"""Partition explainer: Owen values by brute force over orders, sums, bounds, and a fitted model as the scorer."""

import itertools
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import SF001
from tabtext.operators.owen import partition_attributions
from tabtext.plans import fixtures as X
from tabtext.plans import jobs as J

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the scorer below runs in the tasks

WEIGHT = {"good": 2.0, "bad": -3.0, "very": 0.5, "not": -1.0, "film": 0.25, "plot": 1.5}


def value(words):
    """A game with interactions: weights, pairs of neighbours that are both shown, and the square of the sum."""
    s = sum(WEIGHT[w] for w in words)
    pairs = sum(1.7 for a, b in zip(words, words[1:]) if (a, b) in (("not", "good"), ("very", "bad")))
    return [s + pairs, 0.1 * s * s - pairs * len(words)]


def scorer(spark):
    from pyspark.sql.types import ArrayType, DoubleType
    f = F.udf(lambda t: [float(x) for x in value([w for w in t.split(" ") if w in WEIGHT])], ArrayType(DoubleType()))
    return lambda d: d.withColumn("scores", f("sentence"))


def orders(lo, hi):
    """All orders of the tokens that keep every span of the halving tree together."""
    if hi - lo <= 1:
        return [list(range(lo, hi))]
    m = (lo + hi) // 2
    return [a + b for l, r in itertools.product(orders(lo, m), orders(m, hi)) for a, b in ((l, r), (r, l))]


def brute(words):
    """Owen values: each token's mean contribution over the orders."""
    out, every = [[0.0, 0.0] for _ in words], orders(0, len(words))
    for o in every:
        for k, i in enumerate(o):
            a, b = (value([words[j] for j in sorted(s)]) for s in (o[:k], o[:k + 1]))
            for c in range(2):
                out[i][c] += (b[c] - a[c]) / len(every)
    return out


DOCS = ["good", "not good", "not good film", "very bad plot film", "not good very bad plot film not", "good good good good good"]


def test_exact_values_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)) + [(6, ""), (7, None), (5, DOCS[2])], "key long, sentence string")
    got = partition_attributions(df, scorer(spark), evaluations=None).collect()
    seen = sorted((r["sample"], r["position"], r["token"], r["class"]) for r in got)
    assert seen == sorted((i, p, w, c) for i, t in [*enumerate(DOCS), (5, DOCS[2])] for p, w in enumerate(t.split()) for c in range(2))
    for i, t in list(enumerate(DOCS))[:5]:
        want = brute(t.split())
        for r in got:
            if r["sample"] == i:
                assert r["shap_value"] == pytest.approx(want[r["position"]][r["class"]], abs=1e-9)


@pytest.mark.parametrize("evaluations", [2, 4, 12, 44])
def test_bounded_work_keeps_the_sum(spark, evaluations):
    words = ("not good very bad plot film " * 4).split()
    seen = []

    def counted(d):
        seen.append(d.groupBy("key").count())
        return scorer(spark)(d)
    df = spark.createDataFrame([(1, " ".join(words)), (2, "good film")], "key long, sentence string")
    got = partition_attributions(df, counted, evaluations=evaluations).collect()
    full, none = value(words), value([])
    for c in range(2):
        assert sum(r["shap_value"] for r in got if r["sample"] == 1 and r["class"] == c) == pytest.approx(full[c] - none[c])
    used = sum(r["count"] for d in seen for r in d.collect() if r["key"] == 1)
    assert used <= evaluations
    spans = {r["shap_value"] for r in got if r["sample"] == 1 and r["class"] == 0}
    assert len(spans) <= {2: 1, 4: 2, 12: 4, 44: 8}[evaluations]


def test_mask_token(spark):
    df = spark.createDataFrame([(1, "good plot")], "key long, sentence string")
    got = {r["token"]: r["shap_value"] for r in partition_attributions(df, scorer(spark), mask="<hidden>", evaluations=None).collect() if r["class"] == 0}
    assert got == pytest.approx({"good": 2.0, "plot": 1.5})


def test_fitted_model_as_scorer(spark):
    df = X.fx_text_class(spark, SF001).drop("n_chars")
    got = J.scorer_partition_attributions(df, num=5, evaluations=12, vocab_size=500)
    assert got.columns == ["sample", "position", "token", "class", "shap_value"]
    rows = got.collect()
    assert {r["class"] for r in rows} == {0, 1} and len({r["sample"] for r in rows}) == 5
    one = [r for r in rows if r["sample"] == rows[0]["sample"]]
    assert sum(r["shap_value"] for r in one) == pytest.approx(0, abs=1e-9)  # two logits mirror each other


def test_empty_table(spark):
    df = spark.createDataFrame([], "key long, sentence string")
    assert partition_attributions(df, scorer(spark)).count() == 0


def test_levels_hold_spans_not_texts(spark, monkeypatch):
    """A document's tokens are written once, not with every span in every context."""
    from tabtext.operators import owen
    written, real = {}, owen.written_table
    monkeypatch.setattr(owen, "written_table", lambda df, name: written.setdefault(name, []).append(df.columns) or real(df, name))
    df = spark.createDataFrame([(1, " ".join(DOCS)), (2, "good film")], "key long, sentence string")
    assert partition_attributions(df, scorer(spark), evaluations=12).count() == 2 * (sum(len(t.split()) for t in DOCS) + 2)
    assert [n for n, every in written.items() if any("tokens" in c for c in every)] == ["owen-documents"]
