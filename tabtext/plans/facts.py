"""Deterministic facts about the fitted models, each with a SQL twin.

A forest's or a booster's predictions have no SQL twin, and these facts do not prove that they equal another
library's.  What follows from the definition of a job is checked over all rows: which rows a job scores and with which
labels, that attributions add up to the prediction, that a saved model scores as the fitted one, that seeded fits agree,
that importances are shares, that the best candidate is the best, that nulls are imputed with train means, and that the linear
regressor solves the normal equations.  The fits of the ``*_facts`` queries are small (profile ``fast``): their results
do not depend on the fit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WORD_PATTERN
from ..operators import features as FE
from ..operators import models as M
from . import fixtures as X
from . import jobs as J
from .fixture_sql import SPLIT
from .fixture_sql import with_fixtures as W

FACTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FACT_SQL: dict[str, str] = {}
FAST = {"profile": "fast"}
WORDS = {"profile": "fast", "vocab_size": 500}


TOKENS = f"regexp_extract_all(lower(sentence), '{WORD_PATTERN}')"


def fact(name: str, sql: str):
    def deco(fn):
        FACTS[name] = fn
        FACT_SQL[name] = sql
        return fn
    return deco


def _scored_class(pred: DataFrame, train: DataFrame, target: str) -> DataFrame:
    """``key, label, known``: each scored row with whether its predicted label occurs in train."""
    seen = train.select(F.col(target).alias("predicted_label")).distinct().withColumn("known", F.lit(True))
    return pred.select("key", "label", "predicted_label").join(seen, "predicted_label", "left").select(
        "key", "label", F.coalesce("known", F.lit(False)).alias("known"))


def _scored_reg(pred: DataFrame) -> DataFrame:
    finite = F.col("predicted_label").isNotNull() & ~F.isnan("predicted_label") & (F.abs("predicted_label") < 1e300)
    return pred.select("key", F.col("label").cast("double").alias("label"), finite.alias("known"))


def _num_class(spark, sf):
    return X.fx_num_class(spark, sf).drop("p_type")


def _text_class(spark, sf):
    return X.fx_text_class(spark, sf).drop("n_chars")


def _text_reg(spark, sf):
    return X.fx_text_reg(spark, sf).drop("lang")


NUM_CLASS_SQL = W("SELECT key, target AS label, true AS known FROM fx_num_class WHERE split = 'valid'", "fx_num_class")
TEXT_CLASS_SQL = W("SELECT key, label, true AS known FROM fx_text_class WHERE split = 'valid'", "fx_text_class")
NUM_REG_SQL = W("SELECT key, CAST(target AS DOUBLE) AS label, true AS known FROM fx_num_reg WHERE split = 'valid'", "fx_num_reg")
TEXT_REG_SQL = W("SELECT key, CAST(label AS DOUBLE) AS label, true AS known FROM fx_text_reg WHERE split = 'valid'", "fx_text_reg")

for _n, _algo in ((1, "rf"), (2, "gbt_leaf"), (3, "gbt_depth")):
    @fact(f"mod_{_n}_facts", NUM_CLASS_SQL)
    def _num_class_facts(spark, sf, algo=_algo):
        df = _num_class(spark, sf)
        return _scored_class(J.run_numeric_classifier(df, algo=algo, **FAST), df.filter("split = 'train'"), "target")

for _n, _algo in ((4, "rf"), (5, "gbt_leaf"), (6, "gbt_depth"), (15, "linear")):
    @fact(f"mod_{_n}_facts", TEXT_CLASS_SQL)
    def _text_class_facts(spark, sf, algo=_algo):
        df = _text_class(spark, sf)
        return _scored_class(J.run_text_classifier(df, algo=algo, **WORDS), df.filter("split = 'train'"), "label")

for _n, _algo in ((8, "rf"), (9, "gbt_leaf"), (10, "gbt_depth")):
    @fact(f"mod_{_n}_facts", NUM_REG_SQL)
    def _num_reg_facts(spark, sf, algo=_algo):
        return _scored_reg(J.run_numeric_regressor(X.fx_num_reg(spark, sf), algo=algo, **FAST))

for _n, _algo in ((11, "rf"), (12, "gbt_leaf"), (13, "gbt_depth")):
    @fact(f"mod_{_n}_facts", TEXT_REG_SQL)
    def _text_reg_facts(spark, sf, algo=_algo):
        return _scored_reg(J.run_text_regressor(_text_reg(spark, sf), algo=algo, **WORDS))


@fact("mod_7_facts", W("SELECT key, target AS label, true AS known FROM fx_cat WHERE split = 'valid'", "fx_cat"))
def mod_7_facts(spark, sf):
    df = FE.dummies(X.fx_cat(spark, sf), ["o_orderstatus", "o_orderpriority", "o_month"])
    return _scored_class(J.run_numeric_classifier(df, **FAST), df.filter("split = 'train'"), "target")


@fact("mod_15_first_gradient", W("""SELECT label, (SELECT count(*) FROM fx_text_class WHERE split = 'train') AS n,
    round((SELECT count(*) FROM fx_text_class WHERE split = 'train') / count(DISTINCT label) OVER () - n_label, 4) AS bias_gradient,
    round(ln(count(DISTINCT label) OVER ()), 6) AS loss
    FROM (SELECT label, count(*) AS n_label FROM fx_text_class WHERE split = 'train' GROUP BY label)""", "fx_text_class"))
def mod_15_first_gradient(spark, sf):
    """At zero weights every class is equally likely: a class's bias gradient is the rows' share less its own rows."""
    from ..operators import epochs as EP
    t = EP.Training()
    tr = _text_class(spark, sf).filter("split = 'train'")
    m = FE.label_mapping(tr, "label")
    rows = FE.encode_labels(tr.withColumn("ids", EP.gram_ids(F.col("sentence"), t.buckets)), "label", m, out="y")
    grads, loss, n = EP.gradient_pass(rows, EP.new_head(m.count(), t), True)
    got = spark.createDataFrame([(k, n, round(float(g), 4), round(loss / n, 6)) for k, g in enumerate(grads[2])],
                                "code int, n long, bias_gradient double, loss double")
    return m.join(got, "code").select(F.col("value").alias("label"), "n", "bias_gradient", "loss")


@fact("mod_14_facts", W("""SELECT m.model, count(*) AS n FROM fx_text_reg, (SELECT unnest(['rf', 'gbt_depth', 'gbt_leaf']) AS model) m
    WHERE split = 'valid' GROUP BY m.model""", "fx_text_reg"))
def mod_14_facts(spark, sf):
    return J.compare_text_regressors(_text_reg(spark, sf), **WORDS).select("model", "n")


@fact("mod_16_facts", W("SELECT key, round(label, 6) AS label, true AS known FROM fx_text_reg WHERE split = 'valid'", "fx_text_reg"))
def mod_16_facts(spark, sf):
    """Labels come back from the scaled target on their own scale."""
    out = _scored_reg(J.run_text_regressor(_text_reg(spark, sf), algo="linear", scale_target=True, **WORDS))
    return out.withColumn("label", F.round("label", 6))


@fact("mod_17_facts", W("""SELECT key, target AS label, 6 AS n_scores, true AS known FROM fx_num_class
    WHERE split = 'valid'""", "fx_num_class"))
def mod_17_facts(spark, sf):
    """A class absent from train has a score, too: six scores that sum to 1."""
    df = X.fx_missing(spark, sf).drop("p_type")
    _, model, mapping = J.run_numeric_classifier(df, impute_missing=True, return_model=True, **FAST)
    s = M.class_scores(model.transform(df.filter("split = 'valid'")))
    out = model.transform(df.filter("split = 'valid'")).select("key", F.col("target").alias("label"), s.alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return out.select("key", "label", F.size("s").alias("n_scores"), (F.abs(total - 1) < 1e-9).alias("known"))


@fact("mod_18_saved_model_facts", W("SELECT count(*) AS n, 0 AS n_different FROM fx_num_class WHERE split = 'valid'", "fx_num_class"))
def mod_18_facts(spark, sf):
    """SNK-3, MOD-18: the saved and loaded model scores every row as the fitted one does."""
    df = _num_class(spark, sf)
    fitted = J.run_numeric_classifier(df, **FAST).select("key", F.col("predicted_label").alias("a"))
    saved = J.score_with_saved_model(df, **FAST).select("key", F.col("predicted_label").alias("b"))
    both = fitted.join(saved, "key", "full_outer")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("a").eqNullSafe(F.col("b")), 1)).cast("int").alias("n_different"))


@fact("fea_11_seeded_fits", " UNION ALL ".join(
    f"SELECT '{a}' AS algo, count(*) AS n, 0 AS n_different FROM orders WHERE {SPLIT.format(k='o_orderkey')} = 'valid'"
    for a in ("rf", "gbt_depth", "gbt_leaf")))
def fea_11_facts(spark, sf):
    """FEA-11: two fits with the seed give the same predictions for every row."""
    df = X.fx_num_reg(spark, sf)
    out = None
    for algo in ("rf", "gbt_depth", "gbt_leaf"):
        a, b = (J.run_numeric_regressor(df, algo=algo, **FAST).select("key", F.col("predicted_label").alias(c)) for c in "ab")
        one = a.join(b, "key", "full_outer").agg(
            F.lit(algo).alias("algo"), F.count(F.lit(1)).alias("n"),
            F.count(F.when(~F.col("a").eqNullSafe(F.col("b")), 1)).cast("int").alias("n_different"))
        out = one if out is None else out.unionByName(one)
    return out


def _additivity(spark, df, model, feats, classifier: bool) -> DataFrame:
    """``key, class, residual``: prediction minus base value minus the sum of the attributions."""
    from ..operators.treeshap import _tree_model, ensemble_expected_value, extract_trees, tree_attributions
    scored = model.transform(df)
    base = [float(x) for x in ensemble_expected_value(extract_trees(spark, _tree_model(model)))]
    value = M.class_scores(scored) if classifier else F.array(F.col("prediction"))
    p = scored.select("key", F.posexplode(value).alias("class", "p")).withColumn("base", F.array(*map(F.lit, base))[F.col("class")])
    a = tree_attributions(model, scored, feats, "key").groupBy(F.col("sample").alias("key"), "class").agg(F.sum("shap_value").alias("s"))
    return p.join(a, ["key", "class"], "left").select("key", "class", (
        F.round(F.col("p") - F.col("base") - F.coalesce("s", F.lit(0.0)), 6) + F.lit(0.0)).alias("residual"))


@fact("xpl_1_additivity", W("""SELECT v.key, c.class, 0.0::DOUBLE AS residual FROM fx_num_class v,
    (SELECT DISTINCT target AS class FROM fx_num_class) c WHERE v.split = 'valid'""", "fx_num_class"))
def xpl_1_facts(spark, sf):
    df = _num_class(spark, sf)
    _, model, _ = J.run_numeric_classifier(df, return_model=True, **FAST)
    return _additivity(spark, df.filter("split = 'valid'").drop("target"), model, ["p_size", "p_retailprice"], True)


@fact("xpl_2_additivity", W("SELECT key, 0 AS class, 0.0::DOUBLE AS residual FROM fx_num_reg WHERE split = 'valid'", "fx_num_reg"))
def xpl_2_facts(spark, sf):
    df = X.fx_num_reg(spark, sf)
    _, model = J.run_numeric_regressor(df, algo="rf", return_model=True, **FAST)
    return _additivity(spark, df.filter("split = 'valid'"), model, ["c_acctbal", "days"], False)


def _background_additivity(spark, df, model, feats, classifier: bool) -> DataFrame:
    """``key, class, residual``: prediction minus the mean prediction over all train rows minus the sum of the
    attributions against these rows.  The mean is Spark's, over the model's own predictions."""
    from ..operators.treeshap import tree_attributions
    scored = model.transform(df.select("key", "split", *feats))
    value = M.class_scores(scored) if classifier else F.array(F.col("prediction"))
    p = scored.select("key", "split", F.posexplode(value).alias("class", "p"))
    mean = p.filter("split = 'train'").groupBy("class").agg(F.avg("p").alias("base"))
    tr, va = scored.filter("split = 'train'"), scored.filter("split = 'valid'")
    a = tree_attributions(model, va, feats, "key", background=tr).groupBy(F.col("sample").alias("key"), "class").agg(F.sum("shap_value").alias("s"))
    valid = p.filter("split = 'valid'").drop("split").join(mean, "class")
    return valid.join(a, ["key", "class"], "left").select("key", "class", (
        F.round(F.col("p") - F.col("base") - F.coalesce("s", F.lit(0.0)), 6) + F.lit(0.0)).alias("residual"))


@fact("xpl_1_background_additivity", W("""SELECT v.key, c.class, 0.0::DOUBLE AS residual FROM fx_num_class v,
    (SELECT DISTINCT target AS class FROM fx_num_class) c WHERE v.split = 'valid'""", "fx_num_class"))
def xpl_1_background_facts(spark, sf):
    """The forest of ``xpl_1_background_attributions_class``, at its own strength."""
    df = _num_class(spark, sf)
    _, model, _ = J.run_numeric_classifier(df, return_model=True)
    return _background_additivity(spark, df, model, ["p_size", "p_retailprice"], True)


@fact("xpl_2_background_additivity", W("SELECT key, 0 AS class, 0.0::DOUBLE AS residual FROM fx_num_reg WHERE split = 'valid'", "fx_num_reg"))
def xpl_2_background_facts(spark, sf):
    df = X.fx_num_reg(spark, sf)
    _, model = J.run_numeric_regressor(df, algo="gbt_depth", return_model=True, **FAST)
    return _background_additivity(spark, df, model, ["c_acctbal", "days"], False)


@fact("xpl_3_partition_additivity", W(f"""SELECT key, class, 0.0::DOUBLE AS residual, CAST(len({TOKENS}) AS BIGINT) AS n_tokens
    FROM fx_text_class, (SELECT unnest([0, 1]) AS class) c WHERE split = 'valid' AND len({TOKENS}) > 0""", "fx_text_class"))
def xpl_3_partition_facts(spark, sf):
    """Span values of a scorer add up to the score of the whole text minus that of the empty text, for every token
    position of every document with tokens.  The scorer is the fitted linear classifier's logits."""
    from ..operators.owen import partition_attributions
    df = _text_class(spark, sf)
    _, model, tfidf, _, _ = J.run_text_classifier(df, "linear", return_model=True)
    score = J.model_scorer(tfidf, model)
    va = df.filter("split = 'valid'").select("key", "sentence")
    own = score(va).select("key", F.posexplode("scores").alias("class", "score"))
    empty = score(spark.createDataFrame([(-1, "")], "key long, sentence string")).select(F.posexplode("scores").alias("class", "empty"))
    a = partition_attributions(va, score).groupBy(F.col("sample").alias("key"), "class").agg(
        F.sum("shap_value").alias("s"), F.count(F.lit(1)).alias("n_tokens"))
    return a.join(own, ["key", "class"]).join(empty, "class").select("key", "class", (
        F.round(F.col("score") - F.col("empty") - F.col("s"), 6) + F.lit(0.0)).alias("residual"), "n_tokens")


@fact("xpl_6_importance_facts", "SELECT 2::BIGINT AS n, 1.0::DOUBLE AS total")
def xpl_6_facts(spark, sf):
    _, model, _ = J.run_numeric_classifier(_num_class(spark, sf), return_model=True, **FAST)
    imp = J.model_feature_importance(model, ["p_size", "p_retailprice"])
    return imp.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("importance"), 9).alias("total"))


@fact("top_7_candidate_facts", "SELECT 3::BIGINT AS n_runs, 1::BIGINT AS n_best, true AS best_is_highest")
def top_7_facts(spark, sf):
    runs = J.select_best_candidate(_text_class(spark, sf), {f"trees-{n}": {"numTrees": n} for n in (2, 5, 10)}, **WORDS)
    return runs.agg(F.count(F.lit(1)).alias("n_runs"), F.count(F.when(F.col("best"), 1)).alias("n_best"),
                    (F.max(F.when(F.col("best"), F.col("f1"))) == F.max("f1")).alias("best_is_highest"))


HOLES = {"p_size": 7, "p_retailprice": 11}


@fact("fea_9_imputed_features", W(f"""
    , h AS (SELECT key, split, {", ".join(f"CASE WHEN key % {m} <> 0 THEN CAST({c} AS DOUBLE) END AS {c}" for c, m in HOLES.items())}
            FROM fx_num_class),
    a AS (SELECT {", ".join(f"avg({c}) AS m_{c}" for c in HOLES)} FROM h WHERE split = 'train')
    SELECT key, {", ".join(f"round(COALESCE({c}, m_{c}), 6) AS {c}" for c in HOLES)} FROM h, a WHERE split = 'valid'""",
                               "fx_num_class").replace("\n    , h AS", ", h AS", 1))
def fea_9_facts(spark, sf):
    """FEA-9: null features become train means before they are assembled."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    f = X.fx_num_class(spark, sf)
    f = f.withColumns({c: F.when(F.col("key") % m != 0, F.col(c).cast("double")) for c, m in HOLES.items()})
    model = Pipeline(stages=FE.assemble_stages(list(HOLES))).fit(f.filter("split = 'train'"))
    v = model.transform(f.filter("split = 'valid'")).select("key", vector_to_array("features").alias("v"))
    return v.select("key", *[F.round(F.col("v")[i], 6).alias(c) for i, c in enumerate(HOLES)])


OFF = 1.3e-7  # keeps exact sums away from the middle between two rounded values


@fact("mod_2_first_histogram", W("""
    , tr AS (SELECT target, p_size FROM fx_num_class WHERE split = 'train'),
    prior AS (SELECT target AS k, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM tr) AS p FROM tr GROUP BY target)
    SELECT k AS class, p_size AS upto, count(*) AS n, round(sum(p - CASE WHEN target = k THEN 1 ELSE 0 END) + 1.3e-7, 6) + 0.0 AS gradient,
           round(sum(p * (1 - p)) + 1.3e-7, 6) AS hessian FROM tr, prior GROUP BY k, p_size""", "fx_num_class").replace("\n    , tr AS", ", tr AS", 1))
def mod_2_first_histogram(spark, sf):
    """The booster's root histogram of ``p_size`` in round one: gradient and hessian sums of each class and bin."""
    from ..operators import boosting as B
    tr = _num_class(spark, sf).filter("split = 'train'")
    k = tr.select("target").distinct().count()
    s = B.leaf("softmax")
    rows, edges, _ = B.training_table(tr, ["p_size"], "target", "key", s, k)
    hist = B.histograms(rows, s, [], [B.Tree() for _ in range(k)], [{0: None} for _ in range(k)]).filter(F.col("code") != B.TOTAL)
    upto = F.array(*[F.lit(int(e)) for e in edges[0]])
    return hist.select(F.col("k").alias("class"), F.element_at(upto, F.col("code") + 1).alias("upto"), "n",
                       (F.round(F.col("g") + OFF, 6) + F.lit(0.0)).alias("gradient"), F.round(F.col("h") + OFF, 6).alias("hessian"))


@fact("mod_9_missing_directions", W("""
    , t AS (SELECT CASE WHEN key % 7 <> 0 THEN p_size END AS x, CAST(p_retailprice AS DOUBLE) AS y FROM fx_num_class WHERE split = 'train'),
    m AS (SELECT avg(y) AS m, count(*) AS n, count(*) - count(x) AS n_miss, sum(CASE WHEN x IS NULL THEN y ELSE 0 END) AS y_miss, sum(y) AS y_all FROM t),
    b AS (SELECT x, count(*) AS n, sum(y) AS y FROM t WHERE x IS NOT NULL GROUP BY x),
    c AS (SELECT x, sum(n) OVER (ORDER BY x) AS n, sum(y) OVER (ORDER BY x) AS y FROM b),
    d AS (SELECT x, left_too, c.n + CASE WHEN left_too THEN n_miss ELSE 0 END AS nl, c.y + CASE WHEN left_too THEN y_miss ELSE 0 END AS yl, m.n, m, y_all
          FROM c, m, (SELECT unnest([false, true]) AS left_too) w)
    SELECT x AS upto, left_too AS missing_left, round((nl * m - yl) * (nl * m - yl) / nl
           + ((n - nl) * m - (y_all - yl)) * ((n - nl) * m - (y_all - yl)) / (n - nl), 3) + 0.0 AS gain, CAST(nl AS BIGINT) AS n_left
    FROM d WHERE nl >= 20 AND n - nl >= 20""", "fx_num_class").replace("\n    , t AS", ", t AS", 1))
def mod_9_missing_directions(spark, sf):
    """Gains of every root split of a feature with nulls, the rows without it on the right and on the left."""
    from ..operators import boosting as B
    f = _num_class(spark, sf).filter("split = 'train'")
    f = f.select("key", F.when(F.col("key") % 7 != 0, F.col("p_size")).alias("x"), F.col("p_retailprice").cast("double").alias("y"))
    s = B.leaf("squared")
    rows, edges, _ = B.training_table(f, ["x"], "y", "key", s, 1)
    gains = B.split_gains(B.histograms(rows, s, [], [B.Tree()], [{0: None}]), s)
    upto = F.array(*[F.lit(int(e)) for e in edges[0]])
    return gains.select(F.element_at(upto, F.col("bin") + 1).alias("upto"), "missing_left", (F.round("gain", 3) + F.lit(0.0)).alias("gain"), "n_left")


@fact("mod_2_boosted_probabilities", W("SELECT key, target AS label, true AS known, true AS sums_to_one FROM fx_num_class WHERE split = 'valid'", "fx_num_class"))
def mod_2_boosted_probabilities(spark, sf):
    """The class probabilities of the booster sum to 1, and the predicted label is the most probable class of train."""
    df = _num_class(spark, sf)
    out = J.run_boosted(df, ["p_size", "p_retailprice"], "target", "depth", 1)
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    seen = df.filter("split = 'train'").select(F.col("target").alias("predicted_label")).distinct().withColumn("known", F.lit(True))
    return out.join(seen, "predicted_label", "left").select("key", "label", F.coalesce("known", F.lit(False)).alias("known"),
                                                            (F.abs(total - 1) < 1e-12).alias("sums_to_one"))


@fact("top_7_first_stage", W("""
    , m AS (SELECT avg(target) AS m FROM fx_num_reg WHERE split = 'train')
    SELECT round(avg((target - m) * (target - m)) / 1e6, 6) AS mse_of_the_start, 2 AS n_rounds, 1 AS n_best
    FROM fx_num_reg, m WHERE split = 'valid'""", "fx_num_reg").replace("\n    , m AS", ", m AS", 1))
def top_7_first_stage(spark, sf):
    """The staged metric starts at 1 / MSE of the train mean, and one round is the best."""
    r = J.best_round(X.fx_num_reg(spark, sf), ["c_acctbal", "days"], "target", "depth", 1, classifier=False)
    return r.agg(F.round(F.max(F.when(F.col("round") == 0, 1 / F.col("metric"))) / 1e6, 6).alias("mse_of_the_start"),
                 F.count(F.lit(1)).cast("int").alias("n_rounds"), F.count(F.when(F.col("best"), 1)).cast("int").alias("n_best"))


@fact("mod_16_normal_equations", W("""
    , m AS (SELECT var_pop(c_acctbal) AS xx, var_pop(days) AS yy, covar_pop(c_acctbal, days) AS xy, covar_pop(c_acctbal, target) AS xz,
                   covar_pop(days, target) AS yz, avg(c_acctbal) AS mx, avg(days) AS my, avg(target) AS mz
            FROM fx_num_reg WHERE split = 'train'),
    b AS (SELECT (xz * yy - yz * xy) / (xx * yy - xy * xy) AS b1, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b2, mx, my, mz FROM m)
    SELECT key, target AS label, round(mz + b1 * (c_acctbal - mx) + b2 * (days - my), 2) AS predicted_label
    FROM fx_num_reg, b WHERE split = 'valid'""", "fx_num_reg").replace("\n    , m AS", ", m AS", 1))
def mod_16_normal_equations(spark, sf):
    """The linear regressor on two features is ordinary least squares."""
    p = J.run_numeric_regressor(X.fx_num_reg(spark, sf), algo="linear", **FAST)
    return p.select("key", "label", F.round("predicted_label", 2).alias("predicted_label"))
