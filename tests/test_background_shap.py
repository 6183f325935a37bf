"""Interventional TreeSHAP: brute force over all feature subsets and background rows, and Spark jobs against it."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tabtext.operators import background_shap as B
from tabtext.operators.treeshap import predict, tree_attributions
from tabtext.plans import fixtures as X
from tabtext.plans import jobs as J
from test_treeshap import _random_tree


def shares(z, tree):
    return {leaf: (m, n / len(z)) for t, leaf, m, n in B.mask_counts(z, [tree])}


def brute(x, z, f, m):
    """Shapley values of the game v(S) = mean of f(x on S, background elsewhere)."""
    def v(s):
        rows = z.copy()
        rows[:, list(s)] = x[list(s)]
        return f(rows).mean(0)
    out = []
    for i in range(m):
        others = [j for j in range(m) if j != i]
        out.append(sum(math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (v([*s, i]) - v(s))
                       for k in range(m) for s in itertools.combinations(others, k)))
    return np.array(out)


@pytest.mark.parametrize("seed", range(4))
def test_brute_force_over_subsets(seed):
    rng = np.random.default_rng(seed)
    m, depth = 4, [2, 4, 6, 7][seed]
    tree = _random_tree(rng, depth, m, 3)
    x, z = rng.normal(size=(6, m)), rng.normal(size=(11, m))
    z[3] = z[4]
    x[0] = z[0]
    phi = np.zeros((6, m, 3))
    B.background_shap(x, tree, shares(z, tree), phi)
    for r in range(6):
        assert np.allclose(phi[r], brute(x[r], z, lambda q: predict(q, tree), m))
        assert np.allclose(phi[r].sum(0), predict(x[r:r + 1], tree)[0] - predict(z, tree).mean(0))


def test_categories_and_missing_values():
    tree = dict(left=np.array([1, -1, 3, -1, -1]), right=np.array([2, -1, 4, -1, -1]), feature=np.array([0, -1, 1, -1, -1]),
                threshold=np.array([0.5, 0, 0, 0, 0]), value=np.array([[0.0], [1.0], [0.0], [5.0], [-2.0]]), cats={2: np.array([1.0, 3.0])},
                missing_left=np.array([True, False, False, False, False]))
    x = np.array([[np.nan, 1.0], [1.0, 3.0], [1.0, 2.0]])
    z = np.array([[0.0, 1.0], [2.0, 2.0], [np.nan, 3.0]])

    def f(q):
        return np.array([[1.0] if np.isnan(a) or a <= 0.5 else [5.0] if b in (1, 3) else [-2.0] for a, b in q])
    phi = np.zeros((3, 2, 1))
    B.background_shap(x, tree, shares(z, tree), phi)
    for r in range(3):
        assert np.allclose(phi[r], brute(x[r], z, f, 2))


def test_stump_and_single_leaf():
    leaf = dict(left=np.array([-1]), right=np.array([-1]), feature=np.array([-1]), threshold=np.array([0.0]), value=np.array([[7.0]]))
    phi = np.zeros((2, 1, 1))
    z = np.zeros((3, 1))
    B.background_shap(np.ones((2, 1)), leaf, shares(z, leaf), phi)
    assert not phi.any() and B.background_value(leaf, shares(z, leaf), {0: 0})[0] == 7.0


def test_spark_job_equals_brute_force(spark):
    """A fitted forest against all train rows: rows, features and classes."""
    df = X.fx_num_class(spark, SF001).drop("p_type").filter("key < 60")
    _, model, _ = J.run_numeric_classifier(df, algo="rf", return_model=True, profile="fast")
    feats = ["p_size", "p_retailprice"]
    tr, va = (df.filter(f"split = '{s}'").select("key", *feats) for s in ("train", "valid"))
    got = {(r["sample"], r["feature"], r["class"]): r["shap_value"] for r in
           tree_attributions(model, model.transform(va).repartition(3), feats, background=model.transform(tr).repartition(5)).collect()}

    def f(q):
        d = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(q)], "key long, p_size int, p_retailprice double")
        return np.array([r["probability"].toArray() for r in model.transform(d).orderBy("key").collect()])
    z = np.array([[r[c] for c in feats] for r in tr.collect()], float)
    for r in va.limit(2).collect():
        want = brute(np.array([r[c] for c in feats], float), z, f, 2)
        for j, name in enumerate(feats):
            for c in range(want.shape[1]):
                assert abs(got.get((r["key"], name, c), 0.0) - want[j, c]) < 1e-9


def test_background_rows_and_bound(spark, monkeypatch):
    df = X.fx_num_class(spark, SF001).drop("p_type").filter("key < 200")
    few = J.numeric_background_attributions(df, profile="fast", background_rows=3)
    every = J.numeric_background_attributions(df, profile="fast")
    assert few.count() and every.count() and few.columns == ["sample", "feature", "class", "shap_value"]
    assert few.agg(F.sum(F.abs("shap_value"))).first()[0] != every.agg(F.sum(F.abs("shap_value"))).first()[0]
    monkeypatch.setattr(B, "MAX_MASKS", 5)
    with pytest.raises(ValueError, match="too deep"):
        J.numeric_background_attributions(df, profile="fast")


def test_rows_of_one_cell_are_walked_once(spark):
    """Cells stand for their rows at every leaf, and rows of a cell, also with a null key, each get its values."""
    rng = np.random.default_rng(3)
    trees = [_random_tree(rng, 4, 3, 2) for _ in range(3)]
    trees.append(dict(left=np.array([1, -1, -1]), right=np.array([2, -1, -1]), feature=np.array([3, -1, -1]), threshold=np.zeros(3),
                      value=np.array([[0.0, 0.0], [1.0, 2.0], [4.0, 3.0]]), cats={0: np.array([2.0])}))
    x = np.c_[rng.normal(size=(300, 3)), rng.integers(0, 4, 300)]
    x[::7, 1] = np.nan
    cuts = B.thresholds(trees, 4)
    assert cuts[3] is None and all(len(c) for c in cuts[:3] if len(c))
    own = B.cells(x, cuts)
    for t in trees:
        for (a, s, m), (b, r, n) in zip(B.leaf_masks(x, t), B.leaf_masks(own, B.over_cells(t, cuts))):
            assert a == b and s == r and (m == n).all()
    values = [-1.0, 0.25, 2.0]
    stump = dict(left=np.array([1, -1, -1]), right=np.array([2, -1, -1]), feature=np.array([0, -1, -1]), threshold=np.array([0.5, 0, 0]),
                 value=np.array([[0.0], [1.0], [5.0]]))
    df = spark.createDataFrame([(None if i % 5 == 0 else i, [values[i % 3] + i * 1e-6]) for i in range(60)], "key long, features array<double>")
    out, base = B.background_attributions([(0, {"trees": [stump], "weights": [1.0]})], df, df, ["a"])
    got = out.collect()
    assert len(got) == 60 and sum(r["sample"] is None for r in got) == 12
    assert np.allclose(base[0], 7 / 3)
    assert all(abs(r["shap_value"] - ((5.0 if r["sample"] % 3 == 2 else 1.0) - 7 / 3)) < 1e-9 for r in got if r["sample"] is not None)
