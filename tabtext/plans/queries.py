"""

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole source tables.  Double outputs are rounded to a fixed number of places
(chosen per magnitude) so the DuckDB oracle in ``oracle.py`` produces
bit-identical values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions import scalars as S
from ..functions import text as T
from ..operators import attributions as A
from ..operators import checks as C
from ..operators import evaluate as E
from ..operators import features as FE
from ..operators import joins as J
from ..operators import topk as K
from ..operators.common import scalars, split_col
from ..sources.tables import table
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rd(c, places: int) -> Column:
    """Round a double column (fixed places, same rule on the oracle side); adding
    0.0 turns a negative zero into zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.select(*[rd(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


P9 = 9  # probabilities, shares, normalised weights

# ------------------------------------------------------------------ projections


@query("prj_1_split_xy")
def prj_1(spark, sf):
    feats, df = FE.split_xy(X.fx_num_class(spark, sf).drop("p_type"), "target")
    return df


def _majority_by_size(spark, sf) -> DataFrame:
    """Fixed predictions for FX-NUM-CLASS: the most frequent train type per
    ``p_size`` (ties: smaller code) -> ``(key, label, predicted_label, ...)`` codes."""
    f = X.fx_num_class(spark, sf)
    tr, va = FE.resplit(f)
    votes = tr.groupBy("p_size", "target").agg(F.count(F.lit(1)).alias("n"))
    best = K.top_n_per_group(votes, ["p_size"], [F.col("n").desc(), F.col("target").asc()], 1)
    best = best.select("p_size", F.col("target").alias("predicted_code"))
    return va.join(best, "p_size", "left")


@query("prj_2_predictions_class_num")
def prj_2(spark, sf):
    p = _majority_by_size(spark, sf)
    m = FE.label_mapping(X.fx_num_class(spark, sf), "p_type")
    d = FE.decode_labels(p, "predicted_code", m, "predicted_label")
    return d.select("key", F.col("p_type").alias("label"), "predicted_label", "p_size", "p_retailprice")


@query("prj_3_predictions_class_text")
def prj_3(spark, sf):
    t = X.fx_text_class(spark, sf)
    return t.select("key", "label", (F.col("n_chars") >= 1000).cast("int").alias("predicted_label"),
                    "sentence")


@query("prj_4_predictions_reg_num")
def prj_4(spark, sf):
    p = X.fx_pred_reg(spark, sf, carry=("o_orderpriority",))
    return rounded(p.select("key", F.col("label").alias("actual_target"),
                            F.col("predicted_label").alias("predicted_target"), "o_orderpriority"),
                   {"predicted_target": 6})


def _text_reg_pred(spark, sf) -> DataFrame:
    """Fixed predictions for FX-TEXT-REG valid rows: train mean label per language."""
    f = X.fx_text_reg(spark, sf)
    tr, va = FE.resplit(f)
    means = tr.groupBy("lang").agg(F.avg("label").alias("predicted_label"), F.count(F.lit(1)).alias("n"))
    # A language holds a large share of the rows: hot-key lookup.
    return J.hot_key_join(va, means, "lang", "n", how="left")


@query("prj_5_predictions_reg_text")
def prj_5(spark, sf):
    p = _text_reg_pred(spark, sf)
    return rounded(p.select("key", F.col("label").alias("actual_label"), "predicted_label", "sentence"),
                   {"predicted_label": 6})


@query("prj_6_resplit")
def prj_6(spark, sf):
    tr, _ = FE.resplit(X.fx_text_class(spark, sf))
    return tr.select("key", "label")


@query("prj_7_encode")
def prj_7(spark, sf):
    return FE.encode(X.fx_text_class(spark, sf), lambda d: {
        "n_tokens": T.n_tokens(T.tokens("sentence")), "label_value": S.as_double("label")})


@query("prj_8_head")
def prj_8(spark, sf):
    _, va = FE.resplit(X.fx_text_class(spark, sf))
    return K.head(va.select("key", "label", "sentence"), 20, "key")


# ------------------------------------------------------------------ filters


def _attr(spark, sf) -> DataFrame:
    return X.fx_attr(spark, sf)


@query("fil_1_exclude_tokens")
def fil_1(spark, sf):
    a = A.clean_tokens(_attr(spark, sf), A.CLASSIFICATION_EXCLUDE)
    return rounded(a, {"shap_value": 6})


@query("fil_2_class_groups")
def fil_2(spark, sf):
    a = _attr(spark, sf)
    return a.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("token").alias("n_tokens"),
                                  rd(F.sum("shap_value"), 3).alias("total"))


@query("fil_3_having_min")
def fil_3(spark, sf):
    s = A.having_min(A.token_stats(A.clean_tokens(_attr(spark, sf))), 3)
    return rounded(s, {"mean": 6, "std": 6})


@query("fil_6_is_integer")
def fil_6(spark, sf):
    p = table(spark, sf, "part")
    e = table(spark, sf, "embeddings")
    en = e.withColumn("label", F.when(F.col("label") != 3, F.col("label")))
    parts = [C.is_integer(p, "p_size").select(F.lit("p_size").alias("case"), "is_integer"),
             C.is_integer(p, "p_retailprice").select(F.lit("p_retailprice").alias("case"), "is_integer"),
             C.is_integer(e, "label").select(F.lit("label").alias("case"), "is_integer"),
             C.is_integer(en, "label").select(F.lit("label_with_null").alias("case"), "is_integer")]
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


# ------------------------------------------------------------------ sets


@query("set_1_union_splits")
def set_1(spark, sf):
    tr, va = FE.resplit(X.fx_text_class(spark, sf).select("key", "split", "label"))
    return FE.union_splits(tr.drop("split"), va.drop("split"))


def _doc_split(spark, sf):
    d = table(spark, sf, "documents").withColumn("split", split_col("doc_id"))
    return FE.resplit(d)


@query("set_2_class_difference")
def set_2(spark, sf):
    tr, va = _doc_split(spark, sf)
    return C.class_difference(tr, va, "source")


@query("set_3_label_universe")
def set_3(spark, sf):
    return E.label_universe(X.fx_pred_zero(spark, sf))


@query("set_4_missing_codes")
def set_4(spark, sf):
    e = table(spark, sf, "embeddings").filter(F.col("label") != 3)
    return C.missing_codes(e, "label")


@query("set_5_missing_labels")
def set_5(spark, sf):
    out = None
    for name, removed in (("promo", ("PROMO",)), ("promo_small", ("PROMO", "SMALL"))):
        tr, va = FE.resplit(X.fx_missing(spark, sf, removed))
        m = FE.missing_labels(tr, va, "target").select(F.lit(name).alias("variant"), "target")
        out = m if out is None else out.unionByName(m)
    return out


@query("set_6_unique_labels")
def set_6(spark, sf):
    return K.unique_labels(X.fx_num_class(spark, sf), "target")


# ------------------------------------------------------------------ joins


@query("jon_1_semi")
def jon_1(spark, sf):
    attr = _attr(spark, sf)
    a = A.clean_tokens(attr, A.CLASSIFICATION_EXCLUDE)
    top = A.top_token_table(attr, 3, 10, A.CLASSIFICATION_EXCLUDE)
    return rounded(J.semi(a, top, ["class", "token"]), {"shap_value": 6})


@query("jon_2_anti")
def jon_2(spark, sf):
    t = X.fx_text_class(spark, sf)
    toks = t.select("key", F.explode(T.tokens("sentence")).alias("token"))
    stop = spark.createDataFrame([(w,) for w in T.ENGLISH_STOP_WORDS], "token string")
    kept = J.anti(toks, stop, ["token"], bound=len(T.ENGLISH_STOP_WORDS))
    return kept.groupBy("key").agg(F.count(F.lit(1)).alias("n_kept"))


@query("jon_3_lookup")
def jon_3(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    m = FE.label_mapping(p, "p_type")
    return J.lookup(p, m, "p_type", "value").select(
        F.col("p_partkey").alias("key"), "p_type", "code")


@query("jon_5_cross_mean_rows")
def jon_5(spark, sf):
    tr, va = FE.resplit(X.fx_missing(spark, sf, ("PROMO", "SMALL")))
    feats = ["p_size", "p_retailprice"]
    miss = FE.missing_labels(tr, va, "target")
    means = scalars(FE.column_means(tr, feats))
    return rounded(miss.select("target", *[means[c].alias(c) for c in feats]),
                   {"p_size": 9, "p_retailprice": 6})


@query("jon_6_label_grid")
def jon_6(spark, sf):
    return E.confusion(X.fx_pred_zero(spark, sf))


# ------------------------------------------------------------------ aggregates


@query("agg_1_label_distribution")
def agg_1(spark, sf):
    return C.label_distribution(table(spark, sf, "embeddings"), "label")


@query("agg_2_token_length_histogram")
def agg_2(spark, sf):
    return C.token_length_histogram(table(spark, sf, "documents"), "text")


@query("agg_3_label_share")
def agg_3(spark, sf):
    return rounded(E.label_share(X.fx_pred_multi(spark, sf)), {"share": P9})


@query("agg_4_min_max")
def agg_4(spark, sf):
    p = table(spark, sf, "part")
    one = lambda c: C.min_max(p, c).select(F.lit(c).alias("column"), F.col("min_value").cast("double"),
                                           F.col("max_value").cast("double"))
    return one("p_size").unionByName(one("p_retailprice"))


@query("agg_5_column_means")
def agg_5(spark, sf):
    tr, _ = FE.resplit(X.fx_num_class(spark, sf))
    return rounded(FE.column_means(tr, ["p_size", "p_retailprice"]), {"p_size": 9, "p_retailprice": 6})


@query("agg_6_token_stats")
def agg_6(spark, sf):
    return rounded(A.token_stats(_attr(spark, sf)), {"mean": 6, "std": 6})


@query("agg_7_cross_count")
def agg_7(spark, sf):
    return E.pair_counts(X.fx_pred_multi(spark, sf))


@query("agg_8_num_labels")
def agg_8(spark, sf):
    return C.num_labels(table(spark, sf, "embeddings"), "label")


@query("agg_9_random_accuracy")
def agg_9(spark, sf):
    return rounded(E.baseline(X.fx_pred_multi(spark, sf)),
                   {"accuracy": P9, "macro_precision": P9, "macro_recall": P9})


# ------------------------------------------------------------------ top-k


@query("top_1_top_tokens")
def top_1(spark, sf):
    return rounded(A.top_token_table(_attr(spark, sf), 3, 10, A.CLASSIFICATION_EXCLUDE),
                   {"mean": 6, "std": 6})


@query("top_2_token_rank")
def top_2(spark, sf):
    return A.top_token_table(_attr(spark, sf), 3, 10, A.CLASSIFICATION_EXCLUDE).select(
        "class", "token", "token_rank")


@query("top_3_vocabulary")
def top_3(spark, sf):
    t = X.fx_text_class(spark, sf)
    return FE.vocabulary(FE.doc_terms(t), 10000)


@query("top_4_argmax")
def top_4(spark, sf):
    return X.fx_logits(spark, sf).select("key", S.argmax("logits").alias("predicted_label"))


@query("top_5_feature_importance")
def top_5(spark, sf):
    return rounded(K.feature_importance(_attr(spark, sf), 20), {"mean_abs": 6})


@query("top_6_sorted_labels")
def top_6(spark, sf):
    return K.unique_labels(table(spark, sf, "documents"), "lang")


def _runs(spark, sf) -> DataFrame:
    """FX-RUNS: candidates ``checkpoint-<t>`` predicting ``n_chars >= t``, with
    their macro F1, evaluated in one pass (``by=run``)."""
    t = X.fx_text_class(spark, sf)
    cand = t.select("label", "n_chars", F.explode(F.array(F.lit(500), F.lit(1000), F.lit(2000))).alias("t"))
    pred = cand.select(F.concat(F.lit("checkpoint-"), F.col("t").cast("string")).alias("run"), "label",
                       (F.col("n_chars") >= F.col("t")).cast("int").alias("predicted_label"))
    return E.summary(pred, by=("run",)).select("run", rd("macro_f1", P9).alias("f1"))


@query("top_7_select_best")
def top_7(spark, sf):
    runs = _runs(spark, sf)
    best = K.select_best(runs, "f1").select(F.lit("best").alias("kind"), "run")
    latest = K.latest_run(runs).select(F.lit("latest").alias("kind"), "run")
    return best.unionByName(latest).join(runs, "run").select("kind", "run", "f1")


# ------------------------------------------------------------------ features


@query("fea_1_tokens")
def fea_1(spark, sf):
    d = table(spark, sf, "documents")
    t = T.tokens("text")
    return d.select(F.col("doc_id").alias("key"), T.n_tokens(t).alias("n_tokens"),
                    T.join_tokens(t).alias("tokens"))


@query("fea_1_char_ngrams")
def fea_1b(spark, sf):
    c = table(spark, sf, "conversations")
    g = T.tokens("text", mode="char_ngram", n=2)
    return c.select("conv_id", "turn", T.n_tokens(g).alias("n_bigrams"),
                    F.size(F.array_distinct(g)).alias("n_distinct"))


@query("fea_2_remove_stop")
def fea_2(spark, sf):
    d = table(spark, sf, "documents")
    t = T.remove_stop(T.tokens("text"))
    return d.select(F.col("doc_id").alias("key"), T.n_tokens(t).alias("n_kept"), T.join_tokens(t).alias("tokens"))


@query("fea_3_tfidf")
def fea_3(spark, sf):
    t = X.fx_text_class(spark, sf)
    return rounded(FE.tfidf_long(t, vocab_size=10000), {"weight": P9})


@query("fea_4_dummies")
def fea_4(spark, sf):
    return FE.dummies(X.fx_cat(spark, sf), ["o_orderstatus", "o_orderpriority", "o_month"])


@query("fea_4_sparse_dummies")
def fea_4_sparse(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "source", "lang", "n_chars")
    rows, layout = FE.sparse_dummies(d, ["source", "lang", "n_chars"])
    return rows.select("key", "active", F.lit(sum(w for _, w in layout.values())).cast("long").alias("n_features"))


@query("fea_5_label_encoder")
def fea_5(spark, sf):
    return X.fx_num_class(spark, sf).select("key", "p_type", "target")


@query("fea_6_decode")
def fea_6(spark, sf):
    f = X.fx_num_class(spark, sf)
    m = FE.label_mapping(f, "p_type")
    return FE.decode_labels(f.select("key", "target"), "target", m, "decoded")


@query("fea_7_impute_missing_classes")
def fea_7(spark, sf):
    tr, va = FE.resplit(X.fx_missing(spark, sf, ("PROMO", "SMALL")).drop("p_type"))
    out = FE.impute_missing_classes(tr, va, "target", ["p_size", "p_retailprice"])
    return rounded(out, {"p_size": 9, "p_retailprice": 6})


@query("fea_8_minmax")
def fea_8(spark, sf):
    f = X.fx_text_reg(spark, sf)
    tr, va = FE.resplit(f)
    stats = FE.minmax_fit(tr, "label")
    s = FE.minmax_transform(va.select("key", "label"), "label", stats, "scaled")
    back = FE.minmax_inverse(s.withColumn("restored", F.col("scaled")), ["restored"], stats)
    return rounded(back, {"scaled": P9, "restored": 6})


@query("fea_10_encode_ids")
def fea_10(spark, sf):
    t = X.fx_text_class(spark, sf)
    return _encoded(t, 128)


def _encoded(t: DataFrame, max_len: int) -> DataFrame:
    vocab = FE.vocabulary(FE.doc_terms(t, stop_words=None), 10_000)
    e = FE.encode_ids(t, vocab, max_len=max_len, vocab_bound=10_000)
    return e.select("key", F.array_join("ids", ",").alias("ids"),
                    F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_known"))


@query("fea_10_encode_ids_fit")
def fea_10b(spark, sf):
    """The fit-time length."""
    return _encoded(X.fx_text_class(spark, sf), 512)


# ------------------------------------------------------------------ scalar functions


def _probs(spark, sf) -> DataFrame:
    f = X.fx_logits(spark, sf)
    return f.select("key", F.posexplode(S.softmax("logits")).alias("pos", "p"))


@query("fun_1_softmax")
def fun_1(spark, sf):
    return rounded(_probs(spark, sf), {"p": 12})


@query("fun_2_logit")
def fun_2(spark, sf):
    return _probs(spark, sf).select("key", "pos", rd(S.logit("p"), 9).alias("logit"))


@query("fun_3_sign")
def fun_3(spark, sf):
    return X.fx_num_class(spark, sf).select("key", "target", S.sign("target").alias("sign"))


@query("fun_4_abs")
def fun_4(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", S.absolute("c_acctbal").alias("abs_acctbal"))


@query("fun_5_sqrt")
def fun_5(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", rd(S.square_root(F.abs("c_acctbal")), 9).alias("sqrt_abs_acctbal"))


@query("fun_6_reciprocal")
def fun_6(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", rd(S.reciprocal(F.col("p_size") - 1), 12).alias("inv"))


@query("fun_7_strip_blanks")
def fun_7(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.strip_blanks("text").alias("stripped"))


@query("fun_8_join_tokens")
def fun_8(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", T.join_tokens(T.tokens("text")).alias("joined"))


@query("fun_9_int_range")
def fun_9(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).select(
        F.explode(S.int_range("lo", "hi")).alias("code"))


@query("fun_10_squared_error")
def fun_10(spark, sf):
    return rounded(E.residuals(X.fx_pred_reg(spark, sf)).select("key", "squared_error"),
                   {"squared_error": 2})


@query("fun_11_float_cast")
def fun_11(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("key"), S.as_double("n_chars").alias("label"))


@query("fun_12_run_step")
def fun_12(spark, sf):
    return _runs(spark, sf).select("run", S.run_step("run").alias("step"))


@query("fun_13_array_length")
def fun_13(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.n_tokens(T.tokens("text")).alias("n_tokens"))


# ------------------------------------------------------------------ evaluation

METRIC_PLACES = {c: P9 for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1",
                                 "weighted_precision", "weighted_recall", "weighted_f1",
                                 "precision", "recall", "share")}


@query("eva_1_confusion")
def eva_1(spark, sf):
    return E.confusion(X.fx_pred_bin(spark, sf))


@query("eva_2_accuracy")
def eva_2(spark, sf):
    return rounded(E.accuracy(X.fx_pred_bin(spark, sf)), METRIC_PLACES)


@query("eva_3_macro")
def eva_3(spark, sf):
    s = E.summary(X.fx_pred_zero(spark, sf))
    return rounded(s.select("accuracy", "macro_precision", "macro_recall", "macro_f1", "n_labels"),
                   METRIC_PLACES)


@query("eva_4_weighted")
def eva_4(spark, sf):
    s = E.summary(X.fx_pred_multi(spark, sf))
    return rounded(s.select("weighted_precision", "weighted_recall", "weighted_f1", "n_rows"),
                   METRIC_PLACES)


@query("eva_5_per_class")
def eva_5(spark, sf):
    return rounded(E.per_class(X.fx_pred_zero(spark, sf)), METRIC_PLACES)


@query("eva_6_baseline")
def eva_6(spark, sf):
    return rounded(E.baseline(X.fx_pred_bin(spark, sf)), METRIC_PLACES)


@query("eva_7_collapsed")
def eva_7(spark, sf):
    return rounded(E.collapsed_summary(X.fx_pred_multi(spark, sf)), METRIC_PLACES)


#: Columns of a written metric report.
T_REPORT = StructType([StructField(c, StringType()) for c in ("method", "class")]
                      + [StructField(c, DoubleType()) for c in ("accuracy", "precision", "recall")])

REG_PLACES = {"mse": 2, "mae": 6, "rmse": 6, "r2": P9}


@query("eva_8_regression")
def eva_8(spark, sf):
    m = E.regression_metrics(X.fx_pred_reg(spark, sf))
    return rounded(m.select("n", "mse", "mae", "rmse"), REG_PLACES)


@query("eva_9_r2")
def eva_9(spark, sf):
    m = E.regression_metrics(X.fx_pred_reg(spark, sf))
    return m.select(rd("r2", P9).alias("r2"), rd(F.col("inv_mse") * F.lit(1e12), 6).alias("inv_mse_e12"))


@query("eva_10_inverse_scaled")
def eva_10(spark, sf):
    f = X.fx_text_reg(spark, sf)
    tr, va = FE.resplit(f)
    stats = FE.minmax_fit(tr, "label")
    trs = FE.minmax_transform(tr, "label", stats)
    vas = FE.minmax_transform(va, "label", stats)
    means = trs.groupBy("lang").agg(F.avg("label").alias("predicted_label"), F.count(F.lit(1)).alias("n"))
    pred = J.hot_key_join(vas, means, "lang", "n", how="left")
    back = FE.minmax_inverse(pred, ["label", "predicted_label"], stats)
    m = E.regression_metrics(back)
    return rounded(m.select("n", "mse", "mae", "rmse", "r2"), {"mse": 3, "mae": 6, "rmse": 6, "r2": P9})


@query("eva_11_heatmap_cells")
def eva_11(spark, sf):
    return E.confusion(X.fx_pred_multi(spark, sf))


@query("eva_12_metric_report")
def eva_12(spark, sf):
    return rounded(E.metric_report(X.fx_pred_bin(spark, sf)), METRIC_PLACES)


@query("snk_4_metric_report_multi")
def snk_4(spark, sf):
    from ..sources import csv as SC
    from ..sources import sinks as SK
    path = f"{_files(spark, 'report')}/metrics.csv"
    SK.write_report(X.fx_pred_zero(spark, sf), path, "argmax3")
    return rounded(SC.read_csv(spark, path, T_REPORT, multi_line=False), METRIC_PLACES)


# ------------------------------------------------------------------ attributions


@query("xpl_3_token_attributions")
def xpl_3(spark, sf):
    return rounded(_attr(spark, sf), {"shap_value": 6})


@query("xpl_4_attributions_long")
def xpl_4(spark, sf):
    a = _attr(spark, sf)
    # Cube form per (sample, token): the class values in class order; then the
    # tokens of a sample in token order.  Both collects are bounded: two classes,
    # and the distinct tokens of one document.
    per_tok = a.groupBy("sample", "token").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("class", "shap_value"))),
                    lambda s: s["shap_value"]).alias("v"))
    cube = per_tok.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("token", "v"))).alias("tv"))
    cube = cube.select("sample", F.transform("tv", lambda s: s["token"]).alias("tokens"),
                       F.transform("tv", lambda s: s["v"]).alias("values"))
    return rounded(A.attributions_long(cube, classes=[0, 1]), {"shap_value": 6})


@query("xpl_5_token_summary")
def xpl_5(spark, sf):
    return rounded(A.token_summary(_attr(spark, sf), 3, 10, A.CLASSIFICATION_EXCLUDE), {"shap_value": 6})


@query("xpl_6_global_importance")
def xpl_6(spark, sf):
    a = _attr(spark, sf).withColumn("class", F.lit(0))
    return rounded(K.feature_importance(a, 20), {"mean_abs": 6})


@query("xpl_7_error_bars")
def xpl_7(spark, sf):
    t = A.top_token_table(_attr(spark, sf), 3, 10)
    return rounded(t.select("class", "token", "mean", "std", "token_rank"), {"mean": 6, "std": 6})


# ------------------------------------------------------------------ validation / UDF surface


@query("val_1_classes_consistent")
def val_1(spark, sf):
    tr, va = _doc_split(spark, sf)
    a = C.classes_consistent(tr, va, "lang").select(F.lit("lang").alias("column"), "*")
    b = C.classes_consistent(tr, va, "source").select(F.lit("source").alias("column"), "*")
    return a.unionByName(b)


@query("val_2_validate_target")
def val_2(spark, sf):
    e = table(spark, sf, "embeddings")
    p = table(spark, sf, "part")
    cases = [("labels_ok", e, "label"), ("p_size", p, "p_size"), ("p_retailprice", p, "p_retailprice"),
             ("label_gap", e.filter(F.col("label") != 3), "label"),
             ("label_null", e.withColumn("label", F.when(F.col("label") != 3, F.col("label"))), "label"),
             ("no_column", e, "target")]
    out = None
    for name, df, col in cases:
        v = C.validate_target(df, col).select(F.lit(name).alias("case"), "*")
        out = v if out is None else out.unionByName(v)
    return out


@query("val_3_label_table")
def val_3(spark, sf):
    return C.label_distribution(table(spark, sf, "labels"), "quality")


@query("udf_1_map_columns")
def udf_1(spark, sf):
    d = table(spark, sf, "documents")
    return FE.encode(d.withColumnRenamed("doc_id", "key"), lambda df: {
        "lang_upper": F.upper("lang"), "words": T.n_tokens(T.tokens("text")),
        "chars_per_word": rd(F.try_divide(F.col("n_chars").cast("double"),
                                          T.n_tokens(T.tokens("text"))), 9)})


@query("udf_2_metric_callbacks")
def udf_2(spark, sf):
    p = X.fx_pred_reg(spark, sf)
    err = F.col("predicted_label") - F.col("label")
    m = E.custom_metrics(p, {
        "max_abs_error": lambda d: F.max(F.abs(err)),
        "n_over": lambda d: F.count(F.when(err > 0, 1)),
        "mean_error": lambda d: F.avg(err)})
    return rounded(m, {"max_abs_error": 6, "mean_error": 6})


# ------------------------------------------------------------------ end-to-end


@query("run_text_linear_report")
def run_text_linear_report(spark, sf):
    from .jobs import text_linear_report
    return rounded(text_linear_report(X.fx_text_class(spark, sf)),
                   {"accuracy": P9, "precision": P9, "recall": P9})


@query("run_text_linear_scores")
def run_text_linear_scores(spark, sf):
    from .jobs import text_linear_scores
    return text_linear_scores(X.fx_text_class(spark, sf))


# ------------------------------------------------------------------ models (rows-only: fits have no SQL twin)
# The numeric, linear and text forest classifier queries run the jobs' defaults: profile
# ``reference``, vocabulary 10,000.  Boosters and forest regressors over text, and the queries that walk
# every tree (TreeSHAP) or fit many models, take minutes there on one machine (README: "Model fits") and run ``LIGHT``.
LIGHT = {"profile": "fast"}
LIGHT_TEXT = {"profile": "fast", "vocab_size": 1000}


def _jobs():
    from . import jobs
    return jobs


def _num_class(spark, sf):
    return X.fx_num_class(spark, sf).drop("p_type")


@query("mod_1_rf_num_class")
def mod_1(spark, sf):
    return _jobs().run_numeric_classifier(_num_class(spark, sf), algo="rf")


@query("mod_2_gbt_leaf_num_class")
def mod_2(spark, sf):
    return _jobs().run_numeric_classifier(_num_class(spark, sf), algo="gbt_leaf")


@query("mod_3_gbt_depth_num_class")
def mod_3(spark, sf):
    return _jobs().run_numeric_classifier(_num_class(spark, sf), algo="gbt_depth")


def _text_class(spark, sf):
    return X.fx_text_class(spark, sf).drop("n_chars")


@query("mod_4_rf_text_class")
def mod_4(spark, sf):
    return _jobs().run_text_classifier(_text_class(spark, sf), algo="rf")


@query("mod_5_gbt_leaf_text_class")
def mod_5(spark, sf):
    return _jobs().run_text_classifier(_text_class(spark, sf), algo="gbt_leaf", **LIGHT_TEXT)


@query("mod_6_gbt_depth_text_class")
def mod_6(spark, sf):
    return _jobs().run_text_classifier(_text_class(spark, sf), algo="gbt_depth", **LIGHT_TEXT)


@query("mod_7_rf_dummies")
def mod_7(spark, sf):
    return _jobs().run_dummy_classifier(X.fx_cat(spark, sf), ["o_orderstatus", "o_orderpriority", "o_month"])


@query("mod_15_epochs_text_class")
def mod_15_epochs(spark, sf):
    return _jobs().train_text_head(_text_class(spark, sf))[0]


@query("mod_16_epochs_text_reg")
def mod_16_epochs(spark, sf):
    return _jobs().train_text_head(_text_reg(spark, sf), classifier=False)[1]


@query("mod_7_rf_sparse_dummies")
def mod_7_sparse(spark, sf):
    return _jobs().run_dummy_classifier(X.fx_cat(spark, sf), ["o_orderstatus", "o_orderpriority", "o_month"], sparse=True)


@query("mod_8_rf_num_reg")
def mod_8(spark, sf):
    return _jobs().run_numeric_regressor(X.fx_num_reg(spark, sf), algo="rf")


@query("mod_9_gbt_leaf_num_reg")
def mod_9(spark, sf):
    return _jobs().run_numeric_regressor(X.fx_num_reg(spark, sf), algo="gbt_leaf")


@query("mod_10_gbt_depth_num_reg")
def mod_10(spark, sf):
    return _jobs().run_numeric_regressor(X.fx_num_reg(spark, sf), algo="gbt_depth")


def _text_reg(spark, sf):
    return X.fx_text_reg(spark, sf).drop("lang")


@query("mod_11_rf_text_reg")
def mod_11(spark, sf):
    return _jobs().run_text_regressor(_text_reg(spark, sf), algo="rf", **LIGHT_TEXT)


@query("mod_12_gbt_leaf_text_reg")
def mod_12(spark, sf):
    return _jobs().run_text_regressor(_text_reg(spark, sf), algo="gbt_leaf", **LIGHT_TEXT)


@query("mod_13_gbt_depth_text_reg")
def mod_13(spark, sf):
    return _jobs().run_text_regressor(_text_reg(spark, sf), algo="gbt_depth", **LIGHT_TEXT)


@query("mod_14_compare_text_regressors")
def mod_14(spark, sf):
    return _jobs().compare_text_regressors(_text_reg(spark, sf), **LIGHT_TEXT)


@query("mod_15_linear_text_class")
def mod_15(spark, sf):
    return _jobs().run_text_classifier(_text_class(spark, sf), algo="linear")


@query("mod_16_linear_text_reg_scaled")
def mod_16(spark, sf):
    return _jobs().run_text_regressor(_text_reg(spark, sf), algo="linear", scale_target=True)


@query("mod_17_predict_proba_missing_classes")
def mod_17(spark, sf):
    return _jobs().run_numeric_classifier(X.fx_missing(spark, sf).drop("p_type"), algo="rf",
                                          impute_missing=True)


@query("mod_18_batch_scoring_saved_model")
def mod_18(spark, sf):
    return _jobs().score_with_saved_model(_num_class(spark, sf))


# ------------------------------------------------------------------ histogram boosters
# The text boosters and the regressor's best round run the jobs' default, 100 rounds, over all rows and all 10,000 terms (README:
# "Histogram booster").  The boosters of the numeric classes run two.
ROUNDS = 2


@query("mod_2_boost_leaf_num_class")
def mod_2b(spark, sf):
    return _jobs().run_boosted(_num_class(spark, sf), ["p_size", "p_retailprice"], "target", "leaf", ROUNDS)


@query("mod_3_boost_depth_num_class")
def mod_3b(spark, sf):
    return _jobs().run_boosted(_num_class(spark, sf), ["p_size", "p_retailprice"], "target", "depth", ROUNDS)


@query("mod_5_boost_leaf_text_class")
def mod_5b(spark, sf):
    return _jobs().run_boosted(_jobs().text_vectors(_text_class(spark, sf), "label"), "features", "label", "leaf")


@query("mod_12_boost_leaf_text_reg")
def mod_12b(spark, sf):
    return _jobs().run_boosted(_jobs().text_vectors(_text_reg(spark, sf), "label"), "features", "label", "leaf", classifier=False)


@query("top_7_best_round_class")
def top_7c(spark, sf):
    return _jobs().best_round(_num_class(spark, sf), ["p_size", "p_retailprice"], "target", "depth", ROUNDS)


@query("top_7_best_round_reg")
def top_7d(spark, sf):
    return _jobs().best_round(X.fx_num_reg(spark, sf), ["c_acctbal", "days"], "target", "depth", classifier=False)


# ------------------------------------------------------------------ tree attributions (rows-only + additivity tests)


@query("xpl_1_tree_attributions_class")
def xpl_1(spark, sf):
    return _jobs().numeric_tree_attributions(_num_class(spark, sf), algo="rf", **LIGHT)


@query("xpl_1_tree_attributions_text")
def xpl_1b(spark, sf):
    return _jobs().text_tree_attributions(_text_class(spark, sf), algo="rf", **LIGHT_TEXT)


@query("xpl_2_tree_attributions_reg")
def xpl_2(spark, sf):
    return _jobs().numeric_tree_attributions(X.fx_num_reg(spark, sf), algo="gbt_depth", classifier=False, **LIGHT)


@query("xpl_1_background_attributions_class")
def xpl_1c(spark, sf):
    return _jobs().numeric_background_attributions(_num_class(spark, sf), algo="rf")


@query("xpl_1_background_attributions_boosted")
def xpl_1d(spark, sf):
    return _jobs().numeric_background_attributions(_num_class(spark, sf), algo="gbt_leaf", **LIGHT)


@query("xpl_2_background_attributions_reg")
def xpl_2b(spark, sf):
    return _jobs().numeric_background_attributions(X.fx_num_reg(spark, sf), algo="gbt_depth", classifier=False, **LIGHT)


@query("xpl_3_occlusion_attributions")
def xpl_3b(spark, sf):
    return rounded(_jobs().text_linear_leave_one_out(_text_class(spark, sf)), {"shap_value": P9})


@query("xpl_3_occlusion_model_class")
def xpl_3c(spark, sf):
    return _jobs().text_model_leave_one_out(_text_class(spark, sf))


@query("xpl_3_occlusion_model_reg")
def xpl_3d(spark, sf):
    return _jobs().text_model_leave_one_out(_text_reg(spark, sf), classifier=False)


@query("xpl_3_partition_attributions")
def xpl_3e(spark, sf):
    """UDF-3: the fitted classifier as a scorer of whole validation documents, at the explainer's usual 500 texts each."""
    return _jobs().scorer_partition_attributions(_text_class(spark, sf))


@query("jon_4_key_zip")
def jon_4(spark, sf):
    p = X.fx_pred_bin(spark, sf)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "lang", "source")
    return p.join(d, "key")


@query("jon_4_positional_zip")
def jon_4b(spark, sf):
    """Two keyless files, texts and predictions in one order, zipped row by row."""
    from ..sources import csv as SC
    from ..sources import csv_split as SS
    from ..sources import sinks as SK
    base = _files(spark, "zip")
    rows = X.fx_text_class(spark, sf).orderBy("key")
    SK.write_table(rows.select("sentence", "label"), f"{base}/rows.csv")
    SK.write_table(rows.select((F.col("n_chars") >= 1000).cast("int").alias("predicted_label")), f"{base}/predictions.csv")
    left, right = (SS.read_numbered(spark, f"{base}/{n}.csv") for n in ("rows", "predictions"))
    na = [F.when(F.col("sentence").isin(list(SC.NA_VALUES)), F.lit(None)).otherwise(F.col("sentence")).alias("sentence")]
    return SS.zip_by_position(left, right).select("number", *na, *[F.col(c).cast("int").alias(c) for c in ("label", "predicted_label")])


@query("mod_15_linear_embeddings")
def mod_15b(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("key"), split_col("vec_id").alias("split"),
        "embedding", "label")
    return _jobs().run_embedding_classifier(e)


@query("xpl_6_model_importances")
def xpl_6b(spark, sf):
    df = _num_class(spark, sf)
    _, model, _ = _jobs().run_numeric_classifier(df, algo="rf", return_model=True)
    return _jobs().model_feature_importance(model, ["p_size", "p_retailprice"])


@query("top_7_best_candidate_model")
def top_7b(spark, sf):
    return _jobs().select_best_candidate(_text_class(spark, sf), {
        "trees-5": {"numTrees": 5}, "trees-10": {"numTrees": 10}, "trees-20": {"numTrees": 20}}, **LIGHT_TEXT)


# ------------------------------------------------------------------ sources and sinks
# The reference hands data between its scripts as CSV files.  These queries
# write tables derived from the driver's parquet inputs with the sinks into
# the shared checkpoint folder, then read them back with the sources, so each
# file step runs over the whole table and is checked against DuckDB.


def _files(spark, name: str) -> str:
    from ..session import scratch_path
    return scratch_path(spark, name)


@query("src_1_read_pair")
def src_1(spark, sf):
    from ..sources import csv as SC
    from ..sources import sinks as SK
    t = X.fx_text_class(spark, sf)
    base = _files(spark, "pair")
    SK.write_table(t.filter(F.col("split") == "train").select("sentence", "label"), f"{base}/train.csv")
    SK.write_table(t.filter(F.col("split") == "valid").select("sentence", "label"), f"{base}/valid.csv")
    return SC.read_pair(spark, f"{base}/train.csv", f"{base}/valid.csv").drop("key")


@query("src_2_read_confusion")
def src_2(spark, sf):
    from ..plans.entrypoints import vis
    from ..sources import sinks as SK
    base = _files(spark, "confusion")
    pred = X.fx_pred_multi(spark, sf)
    SK.write_confusion(pred, f"{base}/cm.csv")
    SK.write_predictions(pred, f"{base}/results.csv")
    cells, _ = vis(spark, f"{base}/cm.csv", f"{base}/results.csv")
    return cells


@query("src_3_read_predictions")
def src_3(spark, sf):
    from ..plans.entrypoints import vis
    from ..sources import sinks as SK
    base = _files(spark, "predictions")
    pred = X.fx_pred_bin(spark, sf)
    SK.write_confusion(pred, f"{base}/cm.csv")
    SK.write_predictions(pred, f"{base}/results.csv", drop=("key",))
    _, report = vis(spark, f"{base}/cm.csv", f"{base}/results.csv", "proposed")
    return rounded(report, METRIC_PLACES)


@query("src_4_read_attributions")
def src_4(spark, sf):
    from ..sources import csv as SC
    from ..sources import sinks as SK
    path = f"{_files(spark, 'attributions')}/shap.csv"
    SK.write_table(_attr(spark, sf), path)
    return rounded(SC.read_attributions(spark, path), {"shap_value": 6})


@query("src_5_visualize_labels")
def src_5(spark, sf):
    from ..plans.entrypoints import visualize_labels
    from ..sources import sinks as SK
    path = f"{_files(spark, 'labels')}/labels.csv"
    SK.write_table(table(spark, sf, "labels"), path)
    ok, why, dist = visualize_labels(spark, path, "quality")
    if not ok:
        raise RuntimeError(why)
    return dist


@query("snk_1_write_predictions")
def snk_1(spark, sf):
    from ..sources import csv as SC
    from ..sources import sinks as SK
    path = f"{_files(spark, 'regression')}/results.csv"
    SK.write_predictions(X.fx_pred_reg(spark, sf), path,
                         rename={"label": "actual_target", "predicted_label": "predicted_target"})
    return rounded(SC.read_predictions(spark, path, multi_line=False), {"predicted_target": 6})


@query("snk_2_write_confusion")
def snk_2(spark, sf):
    from ..sources import csv as SC
    from ..sources import sinks as SK
    path = f"{_files(spark, 'matrix')}/cm.csv"
    SK.write_confusion(X.fx_pred_multi(spark, sf), path)
    return SC.read_csv(spark, path, multi_line=False)


from .facts import FACTS  # noqa: E402

QUERIES.update(FACTS)
