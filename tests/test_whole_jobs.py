"""Registered queries run their jobs at the jobs' own strength; the ways to grow a booster's trees agree, and the explainer's one job
gives the values of the definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tabtext.operators import boosting as B
from tabtext.operators import owen
from tabtext.plans import jobs as J
from tabtext.plans.queries import QUERIES


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["mod_12_boost_leaf_text_reg", "mod_5_boost_leaf_text_class", "top_7_best_round_reg"])
def test_boosters_run_a_hundred_rounds(spark, monkeypatch, name):
    def fit(df, features, label, settings, *more, **named):
        raise Seen(settings.rounds)
    monkeypatch.setattr(B, "fit", fit)
    with pytest.raises(Seen) as e:
        QUERIES[name](spark, SF001)
    assert e.value.args == (100,)


def shapes(model):
    return [[(t.left, t.right, t.feature, t.bin, t.missing_left, t.rows) for t in r] for r in model.rounds]


@pytest.mark.parametrize("settings, k", [(B.leaf("softmax", rounds=3, num_leaves=6, min_rows=5, max_bins=8), 3), (B.depth("squared", rounds=3, max_depth=3, max_bins=16), 1)])
def test_rounds_grown_in_a_task_by_the_driver_and_by_spark(spark, monkeypatch, settings, k):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)).round(2)
    y = np.digitize(x[:, 0] + x[:, 1] ** 2, [0.2, 1.2])
    x[rng.random((300, 3)) < 0.15] = np.nan
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "key long, a double, b double, c double, y double")
    passes, real = [], B.histograms
    monkeypatch.setattr(B, "histograms", lambda *a: passes.append(len(a)) or real(*a))
    fits = []
    for codes, cells in ((B.CODES_AT_ONCE, B.CELLS_ON_DRIVER), (0, B.CELLS_ON_DRIVER), (0, 0)):
        monkeypatch.setattr(B, "CODES_AT_ONCE", codes)
        monkeypatch.setattr(B, "CELLS_ON_DRIVER", cells)
        fits.append((B.fit(df, ["a", "b", "c"], "y", settings, k), passes[:]))
        del passes[:]
    assert not fits[0][1] and set(fits[1][1]) == {5} and set(fits[2][1]) == {6} and len(fits[1][1]) == len(fits[2][1])
    assert shapes(fits[0][0]) == shapes(fits[1][0]) == shapes(fits[2][0])
    for m, _ in fits[1:]:
        for a, b in zip((t for r in fits[0][0].rounds for t in r), (t for r in m.rounds for t in r)):
            assert a.value == pytest.approx(b.value, abs=1e-9) and a.gain == pytest.approx(b.gain, rel=1e-6)


def test_rows_without_a_split_and_no_rows(spark):
    df = spark.createDataFrame([(i, float(i % 3), 1.0) for i in range(60)], "key long, a double, y double")
    assert B.fit(df, ["a"], "y", B.leaf("squared", rounds=4)).rounds == []
    assert B.fit(df.limit(0), ["a"], "y", B.leaf("squared", rounds=4)).rounds == []


@pytest.mark.parametrize("name", ["xpl_3_partition_additivity", "xpl_3_partition_attributions"])
def test_documents_are_explained_with_the_usual_number_of_texts(spark, monkeypatch, name):
    """A document of 16 and more tokens costs 172 texts: the next level would pass 500."""
    seen = []

    def score(d):
        seen.append(d)
        return d.withColumn("scores", F.array(F.length("sentence") * 1.0, F.length("sentence") * -1.0))
    monkeypatch.setattr(J, "run_text_classifier", lambda *a, **named: (None,) * 5)
    monkeypatch.setattr(J, "model_scorer", lambda *a: score)
    QUERIES[name](spark, SF001)
    assert max(r["count"] for d in seen for r in d.groupBy("key").count().collect()) == 172


def test_texts_of_a_document_are_dealt_and_scored_in_one_job(spark, monkeypatch):
    """Values of a game with interactions, by the definition: a token's mean contribution over the contexts of its spans."""
    calls, written, real = [], [], owen.written_table
    monkeypatch.setattr(owen, "TEXTS_AT_ONCE", 3)
    monkeypatch.setattr(owen, "BATCH_CHARS", 20)
    monkeypatch.setattr(owen, "written_table", lambda df, name: written.append(name) or real(df, name))
    game = lambda words: len(words) + 2.0 * ("aa" in words and "ee" in words) - 3.0 * ("bb" in words and "cc" in words and "dd" in words)

    def score(d):
        calls.append(1)
        w = F.split("text", " ")
        has = lambda *some: F.forall(F.array(*map(F.lit, some)), lambda t: F.array_contains(w, t)).cast("double")
        n = F.size(F.filter(w, lambda t: t != "")).cast("double")
        return d.withColumn("scores", F.array(n + 2 * has("aa", "ee") - 3 * has("bb", "cc", "dd")))
    df = spark.createDataFrame([("x", "aa bb cc dd ee"), ("y", "ee"), ("z", "")], "id string, text string")
    got = {(r["sample"], r["position"]): r for r in owen.partition_attributions(df, score, "id", "text", evaluations=None).collect()}

    def contributions(words, lo, hi, contexts):
        if hi - lo == 1:
            yield lo, sum(game(c + [words[lo]]) - game(c) for c in contexts) / len(contexts)
            return
        mid = (lo + hi) // 2
        yield from contributions(words, lo, mid, [c + more for c in contexts for more in ([], words[mid:hi])])
        yield from contributions(words, mid, hi, [c + more for c in contexts for more in ([], words[lo:mid])])
    words = "aa bb cc dd ee".split()
    want = {("x", i): v for i, v in contributions(words, 0, 5, [[]])} | {("y", 0): 1.0}
    assert {k: r["shap_value"] for k, r in got.items()} == pytest.approx(want, abs=1e-12)
    assert [got["x", i]["token"] for i in range(5)] == words and len(calls) == 1 and written == ["owen-documents"]
