"""The reference's public entry points over files, as Spark jobs.

Each returns DataFrames (the tables behind the reference's prints and plots)
and reports unreadable inputs instead of raising (SRC-5).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attributions as A
from ..operators import checks as C
from ..operators import evaluate as E
from ..sources import csv as S


def visualize_text_length(df: DataFrame, text: str = "sentence") -> DataFrame:
    """``(n_tokens, n_docs)``: FEA-1, FUN-13, AGG-2."""
    return C.token_length_histogram(df, text)


def visualize_labels(spark: SparkSession, path: str, column: str):
    """``(ok, reason, table)``; table = ``(label, label_name, n)`` (SRC-5, FIL-5, AGG-1)."""
    ok, why = S.check_source(spark, path, column)
    if not ok:
        return False, why, None
    return True, "ok", C.label_distribution(S.read_csv(spark, path), column)


def check_class_difference(spark: SparkSession, train_csv: str, valid_csv: str, column: str):
    """``(consistent, differences)`` with differences ``(value, side)`` (SRC-1, SET-2, VAL-1)."""
    pair = S.read_pair(spark, train_csv, valid_csv)
    tr, va = pair.filter(F.col("split") == "train"), pair.filter(F.col("split") == "valid")
    diff = C.class_difference(tr, va, column)
    return diff.isEmpty(), diff


def validate_target_column(spark: SparkSession, path: str, column: str = "target") -> DataFrame:
    """One row ``(ok, rule, min_value, max_value, n_missing)``; an unreadable file
    gives rule ``source`` (SRC-5, FIL-5/6, AGG-4, SET-4, VAL-2)."""
    ok, why = S.check_source(spark, path)
    if not ok:
        return spark.createDataFrame([(False, "source", None, None, None)],
                                     "ok boolean, rule string, min_value double, max_value double, n_missing bigint")
    return C.validate_target(S.read_csv(spark, path), column)


def vis(spark: SparkSession, confusion_path: str, results_path: str, method: str = "proposed"):
    """``(cells, report)``: the saved matrix as heat-map cells (SRC-2, EVA-11) and the
    long metric report of the predictions file (SRC-3, EVA-2..6, EVA-12)."""
    cells = S.read_confusion(spark, confusion_path)
    pred = S.read_predictions(spark, results_path)
    return cells, E.metric_report(pred, method)


def plot_shap(spark: SparkSession, shap_file: str, num_appear: int = 3, top_n: int = 10,
              exclude: Sequence[str] = A.CLASSIFICATION_EXCLUDE):
    """``(points, error_bars)``: the scatter points of each class's top tokens and
    their mean/std table (SRC-4, FUN-7, FIL-1, AGG-6, FIL-3, TOP-1/2, JON-1, XPL-5/7).
    The regression variant passes ``exclude=()``."""
    attr = S.read_attributions(spark, shap_file)
    return (A.token_summary(attr, num_appear, top_n, exclude),
            A.top_token_table(attr, num_appear, top_n, exclude))
