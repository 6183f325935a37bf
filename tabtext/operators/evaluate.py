"""Relational evaluation of predictions (EVA-1..12, AGG-3/7/9, SET-3, UDF-2).

Input: a predictions DataFrame with a true-label and a predicted-label column
(int, double or string).  The only pass over the predictions is one
``groupBy(label, predicted).count()``: map-side partial aggregation reduces
every partition to at most k*k rows, so the shuffle is k*k per partition no
matter how many rows are scored.  All metrics are then computed on that k*k
table (a few hundred rows at most), which is why it is safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sign
from ..session import written_table
from .common import scalars


def pair_counts(pred: DataFrame, label: str = "label", predicted: str = "predicted_label",
                by: tuple[str, ...] = ()) -> DataFrame:
    """AGG-7: ``(*by, label, predicted_label, n)`` for observed pairs (null labels
    dropped).  ``by`` evaluates several runs/models in the same pass."""
    return (pred.select(*by, F.col(label).alias("label"), F.col(predicted).alias("predicted_label"))
            .filter(F.col("label").isNotNull() & F.col("predicted_label").isNotNull())
            .groupBy(*by, "label", "predicted_label").agg(F.count(F.lit(1)).alias("n")))


def label_universe(pred: DataFrame, label: str = "label", predicted: str = "predicted_label",
                   counts: DataFrame | None = None) -> DataFrame:
    """SET-3: sorted union of true and predicted labels, one column ``label``."""
    c = counts if counts is not None else pair_counts(pred, label, predicted)
    u = c.select("label").union(c.select(F.col("predicted_label").alias("label"))).distinct()
    return u.orderBy("label")


def confusion(pred: DataFrame, label: str = "label", predicted: str = "predicted_label",
              counts: DataFrame | None = None) -> DataFrame:
    """EVA-1 (long form) / EVA-11 heat-map cells: every (true, predicted) pair of
    the label universe with its count, zeros included.  The grid is a distributed
    range of k*k numbers (the size of the matrix itself), decoded by two lookups
    of the label codes; no task holds all labels."""
    from .features import label_mapping
    c = counts if counts is not None else pair_counts(pred, label, predicted)
    c = written_table(c, "pair-counts")
    u = c.select("label").union(c.select(F.col("predicted_label").alias("label")))
    codes = label_mapping(u, "label")
    k = codes.count()
    cells = pred.sparkSession.range(k * k).select(F.floor(F.col("id") / F.lit(max(1, k))).cast("int").alias("i"),
                                                  (F.col("id") % F.lit(max(1, k))).cast("int").alias("j"))
    grid = (cells.join(codes.select(F.col("code").alias("i"), F.col("value").alias("label")), "i")
            .join(codes.select(F.col("code").alias("j"), F.col("value").alias("predicted_label")), "j"))
    return (grid.join(c, ["label", "predicted_label"], "left")
            .select("label", "predicted_label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


MAX_PIVOT_LABELS = 10_000  # Spark's own default limit for pivot values


def confusion_wide(pred: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """EVA-1 pivot form: rows = true label, one column per predicted label."""
    cells = confusion(pred, label, predicted)
    # The labels become column names, so they come to the driver: at most
    # MAX_PIVOT_LABELS + 1 rows are fetched, and more labels are refused.
    labels = [r[0] for r in label_universe(pred, label, predicted).limit(MAX_PIVOT_LABELS + 1).collect()]
    if len(labels) > MAX_PIVOT_LABELS:
        raise ValueError(f"more than {MAX_PIVOT_LABELS} labels: use the long form (confusion)")
    return (cells.groupBy("label").pivot("predicted_label", labels).agg(F.sum("n"))
            .orderBy("label"))


def per_label(pred: DataFrame, label: str = "label", predicted: str = "predicted_label",
              counts: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, label, tp, support, n_pred, precision, recall, f1)`` over the label
    universe; an absent denominator gives 0 (the scikit-learn ``zero_division``
    default)."""
    c = counts if counts is not None else pair_counts(pred, label, predicted, by)
    true_side = c.groupBy(*by, "label").agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("label") == F.col("predicted_label"), F.col("n")).otherwise(0)).alias("tp"))
    pred_side = c.groupBy(*by, F.col("predicted_label").alias("label")).agg(F.sum("n").alias("n_pred"))
    t = (true_side.join(pred_side, [*by, "label"], "full_outer")
         .select(*by, "label", F.coalesce("tp", F.lit(0)).cast("bigint").alias("tp"),
                 F.coalesce("support", F.lit(0)).cast("bigint").alias("support"),
                 F.coalesce("n_pred", F.lit(0)).cast("bigint").alias("n_pred")))
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    t = t.withColumn("precision", p).withColumn("recall", r)
    return t.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall")
                                     / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))


def accuracy(pred: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """EVA-2: one row ``accuracy``."""
    return pred.agg(F.avg((F.col(label) == F.col(predicted)).cast("int").cast("double")).alias("accuracy"))


def summary(pred: DataFrame, label: str = "label", predicted: str = "predicted_label",
            by: tuple[str, ...] = ()) -> DataFrame:
    """EVA-2/3/4 fused: one row (per ``by`` group) of accuracy, macro P/R/F1 over the
    label universe and weighted P/R/F1 (support weights; weighted recall equals
    accuracy)."""
    t = per_label(pred, label, predicted, by=by)
    total = F.sum("support")
    return t.groupBy(*by).agg(
        (F.sum("tp") / total).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"),
        F.count(F.lit(1)).alias("n_labels"),
        total.cast("bigint").alias("n_rows"))


def per_class(pred: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """EVA-5: precision and recall for each label that occurs as a *true* label."""
    return (per_label(pred, label, predicted).filter(F.col("support") > 0)
            .select("label", "precision", "recall", "support"))


def label_share(pred: DataFrame, label: str = "label") -> DataFrame:
    """AGG-3: ``(label, n, share)``; the total is a scalar subquery, not an
    unpartitioned window."""
    counts = pred.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    total = scalars(counts.agg(F.sum("n").alias("total")))["total"]
    return counts.select("label", "n", (F.col("n") / total).alias("share"))


def baseline(pred: DataFrame, label: str = "label") -> DataFrame:
    """EVA-6 / AGG-9: random-guess baseline by class frequency: per class precision =
    recall = share; accuracy = sum(share^2); macro = mean share (= 1/k)."""
    s = label_share(pred, label)
    return s.agg(F.sum(F.col("share") * F.col("share")).alias("accuracy"),
                 F.avg("share").alias("macro_precision"), F.avg("share").alias("macro_recall"))


def collapsed_summary(pred: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """EVA-7: predictions collapsed by sign (codes >= 1 -> 1), compared with the
    uncollapsed labels."""
    c = pred.select(F.col(label).alias("label"), sign(F.col(predicted)).alias("predicted_label"))
    return summary(c).select("accuracy", "macro_precision", "macro_recall", "macro_f1")


def regression_metrics(pred: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """EVA-8/9: MSE, MAE, RMSE, R^2 and 1/MSE in one pass.

    ``R^2 = 1 - SS_res / SS_tot``; ``SS_tot`` is ``n`` times the population variance,
    which Spark merges as centred moments, so large targets lose no digits.  A
    constant label gives 1 if the fit is perfect else 0."""
    return _regression(pred, [], label, predicted)


def regression_metrics_by(pred: DataFrame, by: str, label: str = "label",
                          predicted: str = "predicted_label") -> DataFrame:
    """EVA-8/9 per group (one row per model / run)."""
    return _regression(pred, [by], label, predicted)


def _regression(pred: DataFrame, by: list[str], label: str, predicted: str) -> DataFrame:
    y = F.col(label).cast("double")
    p = F.col(predicted).cast("double")
    a = pred.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum((p - y) * (p - y)).alias("ss_res"),
        F.sum(F.abs(p - y)).alias("sae"), F.var_pop(y).alias("var"))
    ss_tot = F.col("var") * F.col("n")
    mse = F.col("ss_res") / F.col("n")
    return a.select(
        *by, F.col("n").cast("bigint").alias("n"), mse.alias("mse"), (F.col("sae") / F.col("n")).alias("mae"),
        F.sqrt(mse).alias("rmse"),
        F.when(ss_tot > 0, F.lit(1.0) - F.col("ss_res") / ss_tot)
         .otherwise(F.when(F.col("ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("r2"),
        F.try_divide(F.lit(1.0), mse).alias("inv_mse"))


def residuals(pred: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """FUN-10 exposed: per-row squared error."""
    d = F.col(predicted).cast("double") - F.col(label).cast("double")
    return pred.withColumn("squared_error", d * d)


def metric_report(pred: DataFrame, method: str = "proposed", label: str = "label",
                  predicted: str = "predicted_label") -> DataFrame:
    """EVA-12 / SNK-4: long report ``(method, class, accuracy, precision, recall)``:
    the model (``method``) and the frequency baseline, for ``all`` and each true
    class; per-class accuracy is NULL.  Classes are rendered as strings.

    The predictions are aggregated once (``pair_counts``); all four parts of the
    report derive from that k*k table, whose exchange Spark reuses."""
    pl = per_label(pred, label, predicted).filter(F.col("support") > 0).select(
        "label", "tp", "support", "precision", "recall")
    # every true label has support > 0, so the union of classes is irrelevant for
    # shares; macro precision/recall of the model need the full universe:
    full = per_label(pred, label, predicted)
    total = scalars(pl.agg(F.sum("support").alias("total")))["total"]
    sh = pl.select("label", (F.col("support") / total).alias("share"))
    cls = lambda c: c.cast("string")
    rows = [
        full.agg(F.lit(method).alias("method"), F.lit("all").alias("class"),
                 (F.sum("tp") / F.sum("support")).alias("accuracy"),
                 F.avg("precision").alias("precision"), F.avg("recall").alias("recall")),
        pl.select(F.lit(method).alias("method"), cls(F.col("label")).alias("class"),
                  F.lit(None).cast("double").alias("accuracy"), "precision", "recall"),
        sh.agg(F.lit("baseline").alias("method"), F.lit("all").alias("class"),
               F.sum(F.col("share") * F.col("share")).alias("accuracy"),
               F.avg("share").alias("precision"), F.avg("share").alias("recall")),
        sh.select(F.lit("baseline").alias("method"), cls(F.col("label")).alias("class"),
                  F.lit(None).cast("double").alias("accuracy"), F.col("share").alias("precision"),
                  F.col("share").alias("recall")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def custom_metrics(pred: DataFrame, metrics: dict[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """UDF-2: user metric callbacks, each returning an aggregate ``Column``; all fused
    into a single ``agg`` pass."""
    return pred.agg(*[fn(pred).alias(name) for name, fn in metrics.items()])
