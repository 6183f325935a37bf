"""Histogram boosting: the same trees as a plain best-first build, probabilities, nulls, sparse vectors, stages."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabtext.operators import boosting as B
from tabtext.plans import jobs as J


def plain_tree(codes, g, h, s):
    """Best-first (or depth-wise) growth over whole arrays: nested tuples (feature, bin, missing_left, left, right) and leaf values."""
    def best(rows):
        top = None
        G, H = g[rows].sum(), h[rows].sum()
        for f in range(codes.shape[1]):
            c = codes[rows, f]
            for b in range(c.max() + 1):
                if not (c == b).any():
                    continue
                for ml in (False, True):
                    if ml and (c >= 0).all():
                        continue
                    left = np.where(c < 0, ml, c <= b)
                    gl, hl, nl = g[rows][left].sum(), h[rows][left].sum(), left.sum()
                    if min(nl, len(rows) - nl) < max(1, s.min_rows) or min(hl, H - hl) < s.min_hessian:
                        continue
                    gain = gl * gl / (hl + s.reg_lambda) + (G - gl) ** 2 / (H - hl + s.reg_lambda) - G * G / (H + s.reg_lambda)
                    order = (round(np.log2(gain), 9) if gain > 1e-12 else -99, -f, -b, not ml)
                    if gain > 1e-12 and (top is None or order > top[0]):
                        top = (order, f, b, ml, rows[left], rows[~left])
        return top

    root = {"rows": np.arange(len(g)), "path": "", "best": best(np.arange(len(g)))}
    leaves = [root]
    while True:
        open_ = [x for x in leaves if x["best"] and (not s.max_depth or len(x["path"]) < s.max_depth)]
        if not open_ or (s.growth == "leaf" and len(leaves) >= s.num_leaves):
            break
        x = max(open_, key=lambda x: (x["best"][0][0], [-ord(c) for c in x["path"]]))
        _, f, b, ml, lr, rr = x.pop("best")
        x["split"] = (f, b, ml, *({"rows": r, "path": x["path"] + p, "best": best(r)} for r, p in ((lr, "l"), (rr, "r"))))
        leaves = [v for v in leaves if v is not x] + list(x["split"][3:])

    out = np.zeros(len(g))

    def shape(x):
        if "split" in x:
            f, b, ml, left, right = x["split"]
            return f, b, ml, shape(left), shape(right)
        out[x["rows"]] = -g[x["rows"]].sum() / (h[x["rows"]].sum() + s.reg_lambda) * s.learning_rate
        return len(x["rows"])
    return shape(root), out


def nested(t, i=0):
    return t.rows[i] if t.left[i] < 0 else (t.feature[i], t.bin[i], t.missing_left[i], nested(t, t.left[i]), nested(t, t.right[i]))


def data(n, seed=0, classes=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    y = (x[:, 0] + (x[:, 1] > 0.3) * 1.5 + rng.normal(size=n) * 0.4 > 0.4).astype(int) + (x[:, 2] > 0.8) * (classes - 2)
    x[rng.random((n, 3)) < 0.15] = np.nan
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "key long, a double, b double, c double, y double")


@pytest.mark.parametrize("make,more", [(B.leaf, {"num_leaves": 7, "min_rows": 8}), (B.depth, {"max_depth": 3, "min_rows": 5})])
def test_same_trees_as_a_plain_build(spark, make, more):
    x, y = data(260)
    s = make("softmax", rounds=2, max_bins=16, **more)
    m = B.fit(frame(spark, x, y), ["a", "b", "c"], "y", s, 3)
    codes = np.stack([np.where(np.isnan(x[:, f]), -1, np.searchsorted(m.edges[f], np.nan_to_num(x[:, f]), "left")) for f in range(3)], 1)
    scores = np.tile(m.start, (260, 1))
    assert np.allclose(np.exp(m.start), np.bincount(y, minlength=3) / 260)
    for trees in m.rounds:
        g, h = B.gradients("softmax", scores, y)
        for k, t in enumerate(trees):
            want, step = plain_tree(codes, g[:, k], h[:, k], s)
            assert nested(t) == want
            scores[:, k] += step
    got = sorted(m.scores(frame(spark, x, y).repartition(3)).collect(), key=lambda r: r["key"])
    assert np.allclose([r["f"] for r in got], scores)


def test_expanding_ahead_changes_passes_only(spark, monkeypatch):
    x, y = data(200, 3)
    s = B.leaf("squared", rounds=1, num_leaves=6, min_rows=5, max_bins=8)
    table, _, _ = B.training_table(frame(spark, x, y), ["a", "b", "c"], "y", "key", s, 1)
    ahead = B.grow_round(table, s, [], 1)[0]
    monkeypatch.setattr(B.heapq, "nsmallest", lambda n, q: sorted(q)[:1])
    assert nested(B.grow_round(table, s, [], 1)[0]) == nested(ahead)


def test_softmax_against_one_vs_rest(spark):
    """Held-out log loss: at most that of one binary booster per class, at the same rounds, rate and depth."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.feature import VectorAssembler
    x, y = data(600, 1)
    x = np.nan_to_num(x)
    df = frame(spark, x, y)
    tr, va = df.filter("key % 3 <> 0"), df.filter("key % 3 = 0")
    m = B.fit(tr, ["a", "b", "c"], "y", B.leaf("softmax", rounds=4, learning_rate=0.3, num_leaves=8, min_rows=10), 3)
    p = {r["key"]: r["p"] for r in m.predictions(m.scores(va)).collect()}
    assert all(abs(sum(v) - 1) < 1e-12 and len(v) == 3 for v in p.values())
    label = {r["key"]: int(r["y"]) for r in va.collect()}
    loss = -np.mean([np.log(p[i][c]) for i, c in label.items()])
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")
    ovr = OneVsRest(classifier=GBTClassifier(labelCol="y", maxIter=4, stepSize=0.3, maxDepth=3, seed=1), labelCol="y").fit(vec.transform(tr))
    raw = {r["key"]: r["rawPrediction"].toArray() for r in ovr.transform(vec.transform(va)).collect()}
    one = {i: 1 / (1 + np.exp(-2 * v)) for i, v in raw.items()}
    assert loss <= -np.mean([np.log(one[i][c] / one[i].sum()) for i, c in label.items()]) + 1e-9
    first = -np.mean([np.log(np.exp(m.start[c])) for c in label.values()])
    assert loss < first / 2


def test_sparse_vectors_have_absent_zeros(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        v = {int(f): float(np.round(rng.random() + 0.1, 1)) for f in rng.choice(50, 6, replace=False)}
        rows.append((i, Vectors.sparse(60, dict(sorted(v.items()))), 3.0 if 7 in v else 1.0 if 9 in v else 0.0))
    df = spark.createDataFrame(rows, ["key", "features", "y"])
    m = B.fit(df, "features", "y", B.leaf("squared", rounds=3, learning_rate=0.9, min_rows=3))
    t = m.rounds[0][0]
    assert t.feature[0] == 7 and t.rows[t.left[0]] + t.rows[t.right[0]] == 300
    got = {r["key"]: r["prediction"] for r in m.predictions(m.scores(df)).collect()}
    assert max(abs(got[i] - y) for i, _, y in rows) < 0.1


def test_unseen_values_nulls_and_empty(spark):
    x, y = data(120, 5)
    m = B.fit(frame(spark, x, y), ["a", "b", "c"], "y", B.leaf("squared", rounds=1, min_rows=5))
    far = spark.createDataFrame([(1, None, None, None), (2, 1e9, -1e9, float("nan"))], "key long, a double, b double, c double")
    assert all(np.isfinite(r["prediction"]) for r in m.predictions(m.scores(far)).collect())
    assert m.scores(far.limit(0)).count() == 0
    flat = B.fit(frame(spark, x, np.ones(120)), ["a", "b", "c"], "y", B.leaf("squared", rounds=3))
    assert flat.rounds == [] and [r["f"] for r in flat.scores(far).collect()] == [[1.0], [1.0]]
    none = B.fit(frame(spark, x, y).limit(0), ["a", "b", "c"], "y", B.leaf("squared", rounds=2))
    assert none.rounds == [] and none.start == [0.0]


def test_staged_metrics_equal_shorter_fits(spark):
    x, y = data(300, 6)
    df = frame(spark, x, y)
    s = lambda r: B.depth("squared", rounds=r, max_depth=2)
    staged = {(r["key"], r["round"]): r["f"][0] for r in B.fit(df, ["a", "b", "c"], "y", s(3)).staged_scores(df).collect()}
    assert len(staged) == 300 * 4
    for r in (2,):
        short = B.fit(df, ["a", "b", "c"], "y", s(r))
        assert all(abs(staged[q["key"], r] - q["f"][0]) < 1e-12 for q in short.scores(df).collect())


def test_best_round_and_scores_are_cut(spark, monkeypatch):
    monkeypatch.setattr(B, "CUT_ROUNDS", 2)
    x, y = data(300, 7)
    df = frame(spark, x, y).withColumn("split", F.when(F.col("key") % 3 == 0, "valid").otherwise("train")).withColumn("y", F.col("y").cast("int"))
    got = sorted(J.best_round(df, ["a", "b", "c"], "y", "depth", 3).collect(), key=lambda r: r["round"])
    assert [r["round"] for r in got] == [0, 1, 2, 3] and sum(r["best"] for r in got) == 1
    assert next(r["metric"] for r in got if r["best"]) == max(r["metric"] for r in got) > got[0]["metric"]
    reg = J.best_round(df.withColumn("y", F.col("y").cast("double")), ["a", "b", "c"], "y", "leaf", 3, classifier=False).collect()
    assert max(reg, key=lambda r: r["metric"])["best"]


def test_booster_is_explained_against_background(spark):
    """Interventional attributions of the booster's trees, nulls included, add up."""
    from tabtext.operators.background_shap import background_attributions
    x, y = data(90, 8)
    df = frame(spark, x, y)
    m = B.fit(df, ["a", "b", "c"], "y", B.depth("squared", rounds=2, max_depth=3))
    arr = df.select("key", F.transform(F.array("a", "b", "c"), lambda v: F.coalesce(v, F.lit(float("nan")))).alias("features"))
    attr, base = background_attributions(m.specs(), arr, arr, ["a", "b", "c"])
    total = {r["sample"]: r["s"] for r in attr.groupBy("sample").agg(F.sum("shap_value").alias("s")).collect()}
    got = {r["key"]: r["f"][0] for r in m.scores(df).collect()}
    assert all(abs(got[i] - m.start[0] - base[0][0] - total.get(i, 0.0)) < 1e-9 for i in got)


def test_batches_are_summed_before_cells_are_handed_over(spark):
    """A task of 400 rows in 40 batches hands over each cell once, and the sums are those of all rows."""
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        x, y = data(400, 9)
        s = B.leaf("squared", max_bins=8)
        table, _, _ = B.training_table(frame(spark, x, y), ["a", "b", "c"], "y", "key", s, 1)
        rows = table.coalesce(1)
        seen = spark.sparkContext.accumulator(0)
        batches = rows.select("codes").mapInArrow(lambda it: (b for b in it if seen.add(1) is None), "codes array<int>").count()
        assert batches == 400 and seen.value >= 40
        hist = B.histograms(rows, s, [], [B.Tree()], [{0: None}])
        cells = {r["code"]: r for r in hist.collect()}
        assert cells[B.TOTAL]["n"] == 400 and len(cells) == 1 + table.selectExpr("explode(codes) c").distinct().count()
        whole = pa.concat_arrays([b.column("codes") for b in table.select("codes").toArrow().to_batches()])
        parts = [pa.RecordBatch.from_arrays([whole[i:i + 10]], names=["codes"]) for i in range(0, 400, 10)]
        assert [b.num_rows for b in B.joined(iter(parts), "codes", 1 << 22)] == [400]
        assert sum(b.num_rows for b in B.joined(iter(parts), "codes", 50)) == 400 and len(list(B.joined(iter(parts), "codes", 50))) > 10
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_vector_entries_without_filling_up(spark):
    v = [Vectors.sparse(2_000_000, {3: 1.0, 7: 0.0, 1_999_999: -2.0}), Vectors.dense([0.0, 5.0, float("nan")]), Vectors.sparse(4, {}), None]
    df = spark.createDataFrame(list(enumerate(v)), ["key", "features"])
    got = {r["key"]: [tuple(p) for p in r["has"]] if r["has"] is not None else None for r in B.sparse_rows(df, "features", "key", None).collect()}
    assert got[0] == [(3, 1.0), (1_999_999, -2.0)] and got[1] == [(1, 5.0)] and got[2] == []


def test_a_tree_takes_about_a_pass_a_level(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3))
    y = np.sin(3 * x[:, 0]) + x[:, 1] ** 2 + x[:, 2] * x[:, 0]
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "key long, a double, b double, c double, y double")
    passes, real = [], B.histograms
    monkeypatch.setattr(B, "histograms", lambda *a: passes.append(1) or real(*a))
    B.fit(df, ["a", "b", "c"], "y", B.depth("squared", rounds=1, max_depth=4))
    assert len(passes) == 5
    del passes[:]
    t = B.fit(df, ["a", "b", "c"], "y", B.leaf("squared", rounds=1, num_leaves=15)).rounds[0][0]
    level = {0: 0}
    for j in range(len(t.left)):
        if t.left[j] >= 0:
            level[t.left[j]] = level[t.right[j]] = level[j] + 1
    assert sum(v < 0 for v in t.left) == 15 and len(passes) <= max(level.values()) + 2
