"""Models: fit and batch scoring (MOD-1..18, SNK-3).

Forests, boosted trees and linear heads are Spark ML estimators; the
reference's LightGBM (leaf-wise) and XGBoost (depth-wise) boosters are
re-aimed as ``GBT*`` with their learning rate and depth; multi-class boosting
goes through ``OneVsRest`` (Spark GBT is binary).

Profiles: ``reference``, the default of every job, mirrors the reference's settings (100 trees or
rounds) with forests of depth 10; ``deep`` lets forests grow to depth 30, Spark's own limit, as
the reference leaves the depth open; ``fast`` (20 trees, 10 rounds, depth <= 5) is for tests and for
facts that do not depend on the fit.  ``seed=42`` everywhere (FEA-11).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import argmax
from .features import assemble_stages, decode_labels, encode_labels, label_mapping, tfidf_model, tokens_column

SEED = 42

# Estimator settings per profile.
PROFILES = {
    "reference": {
        "rf": dict(numTrees=100, maxDepth=10),
        "gbt_leaf": dict(stepSize=0.1, maxIter=100, maxDepth=5, minInstancesPerNode=20),
        "gbt_depth": dict(stepSize=0.3, maxIter=100, maxDepth=6),
        "linear": dict(maxIter=100),
    },
    "deep": {
        "rf": dict(numTrees=100, maxDepth=30),
        "gbt_leaf": dict(stepSize=0.1, maxIter=100, maxDepth=5, minInstancesPerNode=20),
        "gbt_depth": dict(stepSize=0.3, maxIter=100, maxDepth=6),
        "linear": dict(maxIter=100),
    },
    "fast": {
        "rf": dict(numTrees=20, maxDepth=5),
        "gbt_leaf": dict(stepSize=0.1, maxIter=10, maxDepth=5, minInstancesPerNode=20),
        "gbt_depth": dict(stepSize=0.3, maxIter=10, maxDepth=5),
        "linear": dict(maxIter=50),
    },
}
ALGOS = ("rf", "gbt_leaf", "gbt_depth", "linear")


def classifier(algo: str, num_classes: int, profile: str = "reference", features: str = "features",
               label: str = "code"):
    """MOD-1..7, 15: an unfitted classifier for ``num_classes`` classes."""
    p = PROFILES[profile][algo]
    if algo == "rf":
        return RandomForestClassifier(featuresCol=features, labelCol=label, seed=SEED,
                                      featureSubsetStrategy="sqrt", **p)
    if algo in ("gbt_leaf", "gbt_depth"):
        gbt = GBTClassifier(featuresCol=features, labelCol=label, seed=SEED, **p)
        if num_classes > 2:
            # The binary boosters do not depend on each other: fit several at a time.
            return OneVsRest(classifier=gbt, featuresCol=features, labelCol=label, parallelism=min(num_classes, 8))
        return gbt
    if algo == "linear":
        return LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", **p)
    raise ValueError(f"unknown algorithm {algo!r}")


def regressor(algo: str, profile: str = "reference", features: str = "features", label: str = "label"):
    """MOD-8..13, 16: an unfitted regressor."""
    p = dict(PROFILES[profile][algo])
    if algo == "rf":
        return RandomForestRegressor(featuresCol=features, labelCol=label, seed=SEED,
                                     featureSubsetStrategy="all", **p)
    if algo in ("gbt_leaf", "gbt_depth"):
        return GBTRegressor(featuresCol=features, labelCol=label, seed=SEED, **p)
    if algo == "linear":
        return LinearRegression(featuresCol=features, labelCol=label, **p)
    raise ValueError(f"unknown algorithm {algo!r}")


def class_scores(scored: DataFrame) -> "F.Column":
    """Per-class scores of a fitted classifier's output: ``probability`` when the
    model has it, else ``rawPrediction`` (``OneVsRest``)."""
    col = "probability" if "probability" in scored.columns else "rawPrediction"
    return vector_to_array(F.col(col))


def predict_codes(model, df: DataFrame, out: str = "predicted_code") -> DataFrame:
    """MOD-17/18: scores -> argmax (first max wins) as an integer code."""
    scored = model.transform(df)
    return scored.withColumn(out, argmax(class_scores(scored)))


def fit_text_features(df: DataFrame, vocab_size: int = 10000, key: str = "key", text: str = "sentence"):
    """FEA-1/2/3 vector stage fitted on all rows (train + validation, as the
    reference does): returns the fitted TF-IDF ``PipelineModel`` and vocabulary."""
    return tfidf_model(df, key, text, vocab_size)


def with_tokens(df: DataFrame, text: str = "sentence") -> DataFrame:
    return df.withColumn("tokens", tokens_column(text))


def save_model(model, path: str) -> str:
    """SNK-3: persist a fitted model (overwrite)."""
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def encode_target(df: DataFrame, target: str, fit_on: DataFrame | None = None, unseen: str = "error"):
    """FEA-5: mapping + encoded ``code`` (double, as Spark ML wants)."""
    m = label_mapping(df, target, fit_on)
    e = encode_labels(df, target, m, out="code", unseen=unseen).withColumn("code", F.col("code").cast("double"))
    return e, m


def decode_target(df: DataFrame, mapping: DataFrame, code: str = "predicted_code",
                  out: str = "predicted_label") -> DataFrame:
    """FEA-6."""
    return decode_labels(df, code, mapping, out)


def numeric_pipeline(features: Sequence[str], estimator) -> Pipeline:
    """FEA-9 + estimator."""
    return Pipeline(stages=[*assemble_stages(features), estimator])
