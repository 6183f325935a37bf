"""Evaluation on golden inputs (committed matrices), the five-row example and
properties."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tabtext.operators import evaluate as E
from tabtext.sources.csv import expand_confusion, read_confusion

# The reference's committed confusion matrices (true label rows,
# accuracy, macro P, macro R, macro F1, weighted P, random baseline.
GOLDEN = {
    "cm_llm": ([[395, 256], [202, 461]], (0.6514, 0.6523, 0.6510, 0.6506, 0.6522, 0.5000)),
    "confusion_matrix": ([[397, 254], [220, 443]], (0.6393, 0.6395, 0.6390, 0.6388, 0.6395, 0.5000)),
    "confusion_matrix_lgb": ([[391, 260], [285, 378]], (0.5852, 0.5854, 0.5854, 0.5852, 0.5855, 0.5000)),
    "confusion_matrix_llm": ([[393, 258], [202, 461]], (0.6499, 0.6508, 0.6495, 0.6490, 0.6507, 0.5000)),
    "confusion_matrix_num": ([[417, 234], [244, 419]], (0.6362, 0.6363, 0.6363, 0.6362, 0.6363, 0.5000)),
    "confusion_matrix_num_xgb": ([[71, 20, 27], [17, 26, 6], [9, 5, 9]],
                                 (0.5579, 0.4853, 0.5079, 0.4858, 0.6120, 0.4669)),
    "confusion_matrix_rf": ([[393, 258], [272, 391]], (0.5967, 0.5967, 0.5967, 0.5967, 0.5968, 0.5000)),
    "confusion_matrix_text_rf": ([[403, 248], [273, 390]], (0.6035, 0.6037, 0.6036, 0.6035, 0.6038, 0.5000)),
    "confusion_matrix_text_xgb": ([[396, 255], [267, 396]], (0.6027, 0.6028, 0.6028, 0.6027, 0.6028, 0.5000)),
    "confusion_matrix_xgb": ([[391, 260], [269, 394]], (0.5974, 0.5974, 0.5974, 0.5974, 0.5975, 0.5000)),
}


def _pred_from_matrix(spark, m, labels=None):
    labels = labels or list(range(len(m)))
    cells = [(labels[i], labels[j], m[i][j]) for i in range(len(m)) for j in range(len(m))]
    df = spark.createDataFrame(cells, "label int, predicted_label int, n bigint")
    return expand_confusion(df)


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden_matrix_metrics(spark, name):
    m, want = GOLDEN[name]
    pred = _pred_from_matrix(spark, m)
    s = E.summary(pred).first()
    b = E.baseline(pred).first()
    got = (s["accuracy"], s["macro_precision"], s["macro_recall"], s["macro_f1"], s["weighted_precision"],
           b["accuracy"])
    assert got == pytest.approx(want, abs=6e-5)
    assert s["weighted_recall"] == pytest.approx(s["accuracy"])
    assert s["n_rows"] == sum(map(sum, m))


def test_five_row_example(spark):
    pred = spark.createDataFrame(list(zip([0, 1, 2, 2, 1], [0, 0, 2, 2, 1])), "label int, predicted_label int")
    s = E.summary(pred).first()
    assert s["accuracy"] == pytest.approx(0.8)
    assert s["macro_precision"] == pytest.approx(2.5 / 3)
    assert s["macro_recall"] == pytest.approx(2.5 / 3)
    cells = {(r["label"], r["predicted_label"]): r["n"] for r in E.confusion(pred).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 5 and cells[(1, 0)] == 1 and cells[(2, 2)] == 2
    b = E.baseline(pred).first()
    assert b["macro_precision"] == pytest.approx(1 / 3)
    assert b["accuracy"] == pytest.approx((0.2 ** 2) + (0.4 ** 2) + (0.4 ** 2))


def test_zero_denominators_and_union_universe(spark):
    # label 3 never predicted, predicted 9 never true
    pred = spark.createDataFrame([(3, 1), (1, 1), (1, 9)], "label int, predicted_label int")
    pl = {r["label"]: r for r in E.per_label(pred).collect()}
    assert set(pl) == {1, 3, 9}
    assert pl[3]["precision"] == 0.0 and pl[9]["recall"] == 0.0
    pc = {r["label"] for r in E.per_class(pred).collect()}
    assert pc == {1, 3}


def test_string_and_double_labels(spark):
    p1 = spark.createDataFrame([("a", "a"), ("b", "a")], "label string, predicted_label string")
    assert E.accuracy(p1).first()[0] == pytest.approx(0.5)
    p2 = spark.createDataFrame([(0.0, 0.0), (2.0, 1.0)], "label double, predicted_label double")
    assert E.summary(p2).first()["n_labels"] == 3


def test_regression_metrics(spark):
    pred = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "label double, predicted_label double")
    m = E.regression_metrics(pred).first()
    assert m["mse"] == pytest.approx(2 / 3)
    assert m["mae"] == pytest.approx(2 / 3)
    assert m["r2"] == pytest.approx(1 - 2 / 8)
    const = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, predicted_label double")
    assert E.regression_metrics(const).first()["r2"] == 1.0
    assert E.regression_metrics(const).first()["inv_mse"] is None


def test_metric_report_shape(spark):
    pred = _pred_from_matrix(spark, GOLDEN["confusion_matrix_num_xgb"][0])
    rows = E.metric_report(pred, "proposed").collect()
    assert len(rows) == 2 * (1 + 3)
    assert all(r["accuracy"] is None for r in rows if r["class"] != "all")


def test_confusion_round_trip_through_csv(spark):
    pred = _pred_from_matrix(spark, GOLDEN["confusion_matrix_text_rf"][0])
    from tabtext.sources.sinks import write_confusion
    path = os.path.join(tempfile.mkdtemp(prefix="tabtext-test-"), "cm")
    write_confusion(pred, path)
    back = read_confusion(spark, path)
    got = {(r["label"], r["predicted_label"]): r["n"] for r in back.collect()}
    assert got == {("0", "0"): 403, ("0", "1"): 248, ("1", "0"): 273, ("1", "1"): 390}


def test_collapsed_metrics(spark):
    pred = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (1, 1)], "label int, predicted_label int")
    s = E.collapsed_summary(pred).first()
    assert s["accuracy"] == pytest.approx(0.75)  # predicted 2 -> 1: matches label 1, never label 2


def test_custom_metric_callbacks(spark):
    pred = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "label double, predicted_label double")
    r = E.custom_metrics(pred, {"max_err": lambda d: F.max(F.abs(F.col("predicted_label") - F.col("label")))})
    assert r.first()["max_err"] == 1.0


def test_weighted_matches_spark_evaluator(spark):
    """EVA-4 cross-check with Spark ML's own evaluator."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    pred = _pred_from_matrix(spark, GOLDEN["confusion_matrix_num_xgb"][0])
    d = pred.select(pred["label"].cast("double").alias("label"),
                    pred["predicted_label"].cast("double").alias("prediction"))
    s = E.summary(pred).first()
    for metric, col in (("weightedPrecision", "weighted_precision"), ("weightedRecall", "weighted_recall"),
                        ("accuracy", "accuracy"), ("weightedFMeasure", "weighted_f1")):
        ev = MulticlassClassificationEvaluator(metricName=metric)
        assert ev.evaluate(d) == pytest.approx(s[col])
