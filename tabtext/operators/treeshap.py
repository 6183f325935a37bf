"""Tree attributions (XPL-1, XPL-2): path-dependent TreeSHAP.

Algorithm: Lundberg, Erion and Lee, "Consistent Individualized Feature
Attribution for Tree Ensembles" (2018), Algorithm 2, written here
vectorised over a batch of rows: the path's features and zero fractions
depend only on the tree, the one fractions and path weights are arrays over
the rows, so each tree is walked once per Arrow batch, not once per row.

Spark side: the fitted forest is saved (shared checkpoint folder) and its node
table read back with ``spark.read.parquet``; the node arrays (bounded by
trees x 2^(depth+1)) are broadcast; the rows go through ``mapInPandas`` and
only non-zero attributions come out, in the long form
``(sample, feature, class, shap_value)``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Nodes of one fitted ensemble that may be gathered and broadcast: the
# reference's largest forest (100 trees, depth 10) has at most 100 x 2,047
# nodes; one million nodes of a few numbers each stay near 100 MB.
MAX_NODES = 1_000_000
# Upper bound on the attribution buffer (rows x used features x outputs) held
# at once inside a Python worker; batches are cut into row chunks below it.
MAX_PHI_CELLS = 20_000_000

# The Python workers run the numpy core below; ship this module by value with
# the task closure so executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cp
    import sys as _sys
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with --py-files
    pass


# ---------------------------------------------------------------- numpy core

def _extend(pd_, pz, po, pw, z, o, d, n):
    l = len(pd_)
    pd_ = pd_ + [d]
    pz = pz + [z]
    po = po + [o]
    pw = [w.copy() for w in pw] + [np.ones(n) if l == 0 else np.zeros(n)]
    for i in range(l - 1, -1, -1):
        pw[i + 1] = pw[i + 1] + o * pw[i] * ((i + 1) / (l + 1))
        pw[i] = z * pw[i] * ((l - i) / (l + 1))
    return pd_, pz, po, pw


def _unwind(pd_, pz, po, pw, k):
    """Remove path element ``k``; one fractions are 0/1 arrays over rows."""
    l = len(pd_) - 1
    o, z = po[k], pz[k]
    on = o != 0
    safe_o = np.where(on, o, 1.0)
    pw = [w.copy() for w in pw]
    nxt = pw[l].copy()
    for i in range(l - 1, -1, -1):
        tmp = pw[i]
        w_on = nxt * (l + 1) / ((i + 1) * safe_o)
        w_off = (tmp * (l + 1) / (z * (l - i))) if z != 0 else np.zeros_like(tmp)
        new = np.where(on, w_on, w_off)
        nxt = np.where(on, tmp - new * z * (l - i) / (l + 1), nxt)
        pw[i] = new
    pd_ = pd_[:k] + pd_[k + 1:]
    pz = pz[:k] + pz[k + 1:]
    po = po[:k] + po[k + 1:]
    return pd_, pz, po, pw[:l]


def _unwound_sum(pz, po, pw, k):
    l = len(pz) - 1
    o, z = po[k], pz[k]
    on = o != 0
    safe_o = np.where(on, o, 1.0)
    total_on = np.zeros_like(pw[0])
    total_off = np.zeros_like(pw[0])
    nxt = pw[l]
    for i in range(l - 1, -1, -1):
        tmp = nxt * (l + 1) / ((i + 1) * safe_o)
        total_on = total_on + tmp
        nxt = pw[i] - tmp * z * (l - i) / (l + 1)
        if z != 0:
            total_off = total_off + pw[i] * (l + 1) / (z * (l - i))
    return np.where(on, total_on, total_off)


def tree_shap(X: np.ndarray, tree: dict, phi: np.ndarray, weight: float = 1.0) -> None:
    """Add ``weight`` x SHAP values of one tree for rows ``X`` (n, d) into ``phi``
    (n, d, n_out).  ``tree``: arrays ``left, right, feature, threshold, cover``
    and ``value`` (nodes x n_out); leaves have ``left == -1``; a row goes left
    when ``x[feature] <= threshold`` (categorical: ``cats[node]`` holds the left
    categories)."""
    n = X.shape[0]
    left, right, feat, thr = tree["left"], tree["right"], tree["feature"], tree["threshold"]
    cover, value, cats = tree["cover"], tree["value"], tree.get("cats", {})

    def recurse(node, pd_, pz, po, pw, z, o, d):
        pd_, pz, po, pw = _extend(pd_, pz, po, pw, z, o, d, n)
        if left[node] < 0:
            v = value[node] * weight
            for i in range(1, len(pd_)):
                w = _unwound_sum(pz, po, pw, i)
                phi[:, pd_[i], :] += ((w * (po[i] - pz[i]))[:, None]) * v[None, :]
            return
        f = feat[node]
        x = X[:, f]
        if node in cats:
            go_left = np.isin(x, cats[node])
        else:
            go_left = x <= thr[node]
        iz, io = 1.0, np.ones(n)
        k = next((i for i in range(len(pd_)) if pd_[i] == f), None)
        if k is not None:
            iz, io = pz[k], po[k]
            pd_, pz, po, pw = _unwind(pd_, pz, po, pw, k)
        c = cover[node] if cover[node] > 0 else 1.0
        recurse(left[node], pd_, pz, po, pw, iz * cover[left[node]] / c, io * go_left, f)
        recurse(right[node], pd_, pz, po, pw, iz * cover[right[node]] / c, io * ~go_left, f)

    recurse(0, [], [], [], [], 1.0, np.ones(n), -1)


def expected_value(tree: dict) -> np.ndarray:
    leaves = tree["left"] < 0
    return (tree["value"][leaves] * tree["cover"][leaves][:, None]).sum(axis=0) / tree["cover"][0]


def predict(X: np.ndarray, tree: dict) -> np.ndarray:
    node = np.zeros(X.shape[0], dtype=int)
    for _ in range(64):
        inner = tree["left"][node] >= 0
        if not inner.any():
            break
        f = tree["feature"][node]
        x = X[np.arange(X.shape[0]), np.maximum(f, 0)]
        go_left = x <= tree["threshold"][node]
        node = np.where(inner, np.where(go_left, tree["left"][node], tree["right"][node]), node)
    return tree["value"][node]


# ---------------------------------------------------------------- Spark side

def _tree_model(model):
    """Last tree ensemble of a PipelineModel (or the model itself)."""
    stages = getattr(model, "stages", None)
    return stages[-1] if stages else model


def _ensemble_kind(m) -> str:
    name = type(m).__name__
    if name == "RandomForestClassificationModel":
        return "rf_class"
    if name == "RandomForestRegressionModel":
        return "rf_reg"
    if name in ("GBTClassificationModel", "GBTRegressionModel"):
        return "gbt"
    if name in ("DecisionTreeClassificationModel",):
        return "rf_class"
    if name in ("DecisionTreeRegressionModel",):
        return "rf_reg"
    raise ValueError(f"not a tree ensemble: {name}")


def extract_trees(spark, ensemble) -> dict:
    """Node arrays of a fitted tree ensemble, read from its saved form."""
    kind = _ensemble_kind(ensemble)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    ensemble.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "treeID" not in nodes.columns:  # a single decision tree
        nodes = nodes.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    n_nodes = nodes.count()
    if n_nodes > MAX_NODES:
        raise ValueError(f"{n_nodes} nodes exceed the broadcast bound {MAX_NODES}")
    rows = nodes.select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats",
                        "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
                        "nodeData.split.leftCategoriesOrThreshold", "nodeData.split.numCategories").toPandas()
    weights = list(getattr(ensemble, "treeWeights", [1.0]))
    n_trees = len(weights)
    trees = []
    for t in range(n_trees):
        r = rows[rows["treeID"] == t].sort_values("id")
        ids = r["id"].to_numpy()
        pos = {int(i): j for j, i in enumerate(ids)}
        left = np.array([pos.get(int(c), -1) if c >= 0 else -1 for c in r["leftChild"]])
        right = np.array([pos.get(int(c), -1) if c >= 0 else -1 for c in r["rightChild"]])
        stats = [np.asarray(s, dtype=float) for s in r["impurityStats"]]
        if kind == "rf_class":
            cover = np.array([s.sum() for s in stats])
            value = np.array([s / s.sum() if s.sum() > 0 else s for s in stats])
        else:
            cover = np.array([s[0] for s in stats])
            value = r["prediction"].to_numpy(dtype=float)[:, None]
        thr = np.array([float(a[0]) if (nc is None or nc < 0) and len(a) else 0.0
                        for a, nc in zip(r["leftCategoriesOrThreshold"], r["numCategories"])])
        cats = {j: np.asarray(a, dtype=float) for j, (a, nc) in
                enumerate(zip(r["leftCategoriesOrThreshold"], r["numCategories"])) if nc is not None and nc >= 0}
        trees.append(dict(left=left, right=right, feature=r["featureIndex"].to_numpy(dtype=int),
                          threshold=thr, cover=cover, value=value, cats=cats))
    if kind.startswith("rf"):
        weights = [1.0 / n_trees] * n_trees
    return {"kind": kind, "trees": trees, "weights": weights}


def _remap(spec: dict, used: list[int]) -> dict:
    idx = {f: j for j, f in enumerate(used)}
    for t in spec["trees"]:
        t["feature"] = np.array([idx.get(int(f), -1) if f >= 0 else -1 for f in t["feature"]])
    return spec


def ensemble_expected_value(spec: dict) -> np.ndarray:
    return sum(w * expected_value(t) for t, w in zip(spec["trees"], spec["weights"]))


def tree_attributions(model, df: DataFrame, feature_names: Sequence[str], key: str = "key",
                      features_col: str = "features", classes: Sequence | None = None,
                      binary_positive_only: bool = True, background: DataFrame | None = None) -> DataFrame:
    """XPL-1/2: ``(sample, feature, class, shap_value)`` for every row of ``df``
    (which must hold ``features_col``).  ``OneVsRest`` models are attributed
    per class model (margin space); forest classifiers in probability space,
    boosted trees in margin space, regressors on one output (class 0).  Binary
    forest classifiers keep class 1 only, as the reference does.

    ``background``: rows with ``features_col``; attributions are then interventional, against the mean over all of
    these rows (``background_shap``), instead of path-dependent."""
    spark = df.sparkSession
    m = _tree_model(model)
    specs = []
    if type(m).__name__ == "OneVsRestModel":
        for c, sub in enumerate(m.models):
            specs.append((c, extract_trees(spark, sub)))
    else:
        specs.append((None, extract_trees(spark, m)))
    if background is not None:
        from .background_shap import background_attributions
        return background_attributions(specs, df, background, feature_names, key, features_col, classes, binary_positive_only)[0]
    used = sorted({int(f) for _, s in specs for t in s["trees"] for f in t["feature"] if f >= 0})
    specs = [(c, _remap(s, used)) for c, s in specs]
    names = [feature_names[i] for i in used]
    bc = spark.sparkContext.broadcast({"specs": specs, "names": names, "classes": list(classes or []),
                                       "binary_positive_only": binary_positive_only})
    x = vector_to_array(F.col(features_col))
    sub = df.select(F.col(key).alias("sample"),
                    F.array(*[x[i] for i in used]).alias("x") if used else F.array().cast("array<double>").alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = bc.value
        for pdf in batches:
            if len(pdf) == 0 or not b["names"]:
                continue
            X_all = np.stack(pdf["x"].to_numpy()).astype(float)
            samples = pdf["sample"].to_numpy()
            for c, spec in b["specs"]:
                n_out = spec["trees"][0]["value"].shape[1]
                step = max(1, MAX_PHI_CELLS // max(1, X_all.shape[1] * n_out))
                for lo in range(0, X_all.shape[0], step):
                    X = X_all[lo:lo + step]
                    phi = np.zeros((X.shape[0], X.shape[1], n_out))
                    for t, w in zip(spec["trees"], spec["weights"]):
                        tree_shap(X, t, phi, w)
                    outs = range(n_out)
                    if c is None and n_out == 2 and b["binary_positive_only"]:
                        outs = [1]
                    parts = []
                    for o in outs:
                        cls = c if c is not None else o
                        label = b["classes"][cls] if b["classes"] else cls
                        s_idx, f_idx = np.nonzero(phi[:, :, o])
                        parts.append(pd.DataFrame({
                            "sample": samples[lo:lo + step][s_idx],
                            "feature": np.asarray(b["names"], dtype=object)[f_idx],
                            "class": np.full(len(s_idx), int(label), dtype=np.int32),
                            "shap_value": phi[s_idx, f_idx, o]}))
                    if parts:
                        yield pd.concat(parts, ignore_index=True)

    return sub.mapInPandas(run, "sample bigint, feature string, class int, shap_value double")
