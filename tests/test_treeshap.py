"""TreeSHAP: brute-force Shapley values on a random tree, additivity on Spark
fits (forest classifier in probability space, boosted regressor in margin
space, one-vs-rest boosted classifier)."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF001
from tabtext.operators.treeshap import (ensemble_expected_value, expected_value, extract_trees, predict,
                                        tree_attributions, tree_shap)
from tabtext.plans import fixtures as X
from tabtext.plans import jobs as J


def _random_tree(rng, depth, n_features, n_out):
    left, right, feat, thr, cover, value = [], [], [], [], [], []

    def mk(d, cov):
        i = len(left)
        left.append(-1); right.append(-1); feat.append(-1); thr.append(0.0)  # noqa: E702
        cover.append(cov); value.append(rng.normal(size=n_out))  # noqa: E702
        if d > 0:
            feat[i] = int(rng.integers(0, n_features))
            thr[i] = float(rng.normal())
            a = float(rng.uniform(0.2, 0.8))
            left[i] = mk(d - 1, cov * a)
            right[i] = mk(d - 1, cov * (1 - a))
        return i
    mk(depth, 100.0)
    return dict(left=np.array(left), right=np.array(right), feature=np.array(feat), threshold=np.array(thr),
                cover=np.array(cover), value=np.array(value))


def _cond_exp(x, tree, S, node=0):
    if tree["left"][node] < 0:
        return tree["value"][node]
    f, lft, rgt = tree["feature"][node], tree["left"][node], tree["right"][node]
    if f in S:
        return _cond_exp(x, tree, S, lft if x[f] <= tree["threshold"][node] else rgt)
    return (tree["cover"][lft] * _cond_exp(x, tree, S, lft)
            + tree["cover"][rgt] * _cond_exp(x, tree, S, rgt)) / tree["cover"][node]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_brute_force(seed):
    rng = np.random.default_rng(seed)
    m = 4
    tree = _random_tree(rng, 5, m, 2)
    X_ = rng.normal(size=(5, m))
    phi = np.zeros((5, m, 2))
    tree_shap(X_, tree, phi)
    for r in range(5):
        bf = np.zeros((m, 2))
        for i in range(m):
            others = [j for j in range(m) if j != i]
            for k in range(m):
                for S in itertools.combinations(others, k):
                    w = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                    bf[i] += w * (_cond_exp(X_[r], tree, set(S) | {i}) - _cond_exp(X_[r], tree, set(S)))
        assert np.allclose(bf, phi[r])
        assert np.allclose(phi[r].sum(0) + expected_value(tree), predict(X_[r:r + 1], tree)[0])


def test_additivity_forest_classifier(spark):
    df = X.fx_num_class(spark, SF001).drop("p_type")
    _, model, _ = J.run_numeric_classifier(df, algo="rf", return_model=True, profile="fast")
    va = df.filter("split = 'valid'").drop("target")
    scored = model.transform(va)
    attr = tree_attributions(model, scored, ["p_size", "p_retailprice"])
    e = ensemble_expected_value(extract_trees(spark, model.stages[-1]))
    s = attr.groupBy("sample", "class").agg(F.sum("shap_value").alias("s"))
    prob = scored.select(F.col("key").alias("sample"), F.posexplode(vector_to_array("probability"))
                         .alias("class", "p"))
    j = prob.join(s, ["sample", "class"], "left").toPandas().fillna(0.0)
    err = (j["s"] + e[j["class"].to_numpy()] - j["p"]).abs().max()
    assert err < 1e-9


def test_additivity_boosted_regressor(spark):
    df = X.fx_num_reg(spark, SF001)
    _, model = J.run_numeric_regressor(df, algo="gbt_depth", return_model=True, profile="fast")
    va = df.filter("split = 'valid'")
    scored = model.transform(va)
    attr = tree_attributions(model, scored, ["c_acctbal", "days"])
    e = ensemble_expected_value(extract_trees(spark, model.stages[-1]))
    s = attr.groupBy("sample").agg(F.sum("shap_value").alias("s"))
    j = scored.select(F.col("key").alias("sample"), "prediction").join(s, "sample", "left").toPandas().fillna(0.0)
    assert (j["s"] + e[0] - j["prediction"]).abs().max() < 1e-6 * max(1.0, j["prediction"].abs().max())


def test_one_vs_rest_attributions_cover_classes(spark):
    df = X.fx_num_class(spark, SF001).drop("p_type")
    attr = J.numeric_tree_attributions(df, algo="gbt_depth", profile="fast")
    classes = {r["class"] for r in attr.select("class").distinct().collect()}
    assert classes <= set(range(6)) and len(classes) >= 2
