"""Data checks (VAL-1..3, SET-2, SET-4, FIL-5, FIL-6, AGG-1, AGG-2, AGG-4, AGG-8).

Each check is one aggregate job whose result is a small DataFrame; a caller
that wants a Python value takes ``.first()`` of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.text import n_tokens, tokens

# Fixed value: display prefix of a label id in the label distribution ("label").
LABEL_NAME_PREFIX = "ラベル"


def has_column(df: DataFrame, col: str) -> bool:
    """FIL-5: analysis-time check, no job."""
    return col in df.columns


def is_integer_type(df: DataFrame, col: str) -> bool:
    """Schema half of FIL-6."""
    return isinstance(df.schema[col].dataType, IntegralType)


def is_integer(df: DataFrame, col: str) -> DataFrame:
    """FIL-6: one row ``is_integer``: integral type and no null (a null turns an
    integer column into floats when a CSV is read by pandas)."""
    if not is_integer_type(df, col):
        return df.sparkSession.range(1).select(F.lit(False).alias("is_integer"))
    return df.agg((F.count(F.lit(1)) == F.count(col)).alias("is_integer"))


def label_distribution(df: DataFrame, col: str) -> DataFrame:
    """AGG-1 / VAL-3: ``(label, label_name, n)``, sorted by label."""
    return (df.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
            .select("label", F.concat(F.lit(LABEL_NAME_PREFIX), F.col("label").cast("string"))
                    .alias("label_name"), "n")
            .orderBy("label"))


def token_length_histogram(df: DataFrame, text: str = "sentence", mode: str = "word") -> DataFrame:
    """AGG-2 / VAL-3: ``(n_tokens, n_docs)``."""
    return (df.select(n_tokens(tokens(F.col(text), mode)).alias("n_tokens"))
            .groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).orderBy("n_tokens"))


def min_max(df: DataFrame, col: str) -> DataFrame:
    """AGG-4."""
    return df.agg(F.min(col).alias("min_value"), F.max(col).alias("max_value"))


def num_labels(df: DataFrame, col: str = "label") -> DataFrame:
    """AGG-8: number of classes = max label + 1."""
    return df.agg((F.max(col) + 1).cast("int").alias("num_labels"))


def class_difference(tr: DataFrame, va: DataFrame, col: str) -> DataFrame:
    """SET-2: ``(value, side)`` for values only in train (``train_only``) or only in
    validation (``valid_only``); empty when the splits agree.  Null is a value
    (null-safe join), as in a pandas ``unique``."""
    t = tr.select(F.col(col).alias("value")).distinct().withColumn("__t", F.lit(True))
    v = va.select(F.col(col).alias("value")).distinct().withColumn("__v", F.lit(True))
    j = t.join(v, t["value"].eqNullSafe(v["value"]), "full_outer")
    return (j.select(F.coalesce(t["value"], v["value"]).alias("value"),
                     F.when(F.col("__v").isNull(), F.lit("train_only"))
                     .when(F.col("__t").isNull(), F.lit("valid_only")).alias("side"))
            .filter(F.col("side").isNotNull()))


def classes_consistent(tr: DataFrame, va: DataFrame, col: str) -> DataFrame:
    """VAL-1: one row ``(consistent, n_train_only, n_valid_only)``."""
    d = class_difference(tr, va, col)
    return d.agg(
        (F.count(F.lit(1)) == 0).alias("consistent"),
        F.count(F.when(F.col("side") == "train_only", 1)).alias("n_train_only"),
        F.count(F.when(F.col("side") == "valid_only", 1)).alias("n_valid_only"))


def missing_codes(df: DataFrame, col: str) -> DataFrame:
    """SET-4: integers in ``[min, max]`` that never occur (``code``).  The range is
    generated with ``spark.range`` (distributed), then anti-joined with the
    distinct values, so neither side is gathered in one place."""
    spark = df.sparkSession
    mm = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if mm["lo"] is None:
        return spark.range(0).select(F.col("id").alias("code"))
    codes = spark.range(int(mm["lo"]), int(mm["hi"]) + 1).select(F.col("id").alias("code"))
    present = df.select(F.col(col).cast("bigint").alias("code")).distinct()
    return codes.join(present, "code", "left_anti")


def target_stats(df: DataFrame, col: str) -> DataFrame:
    """One aggregate pass: count, nulls, min, max, distinct count."""
    return df.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(col)).alias("n_null"),
                  F.min(col).alias("min_value"), F.max(col).alias("max_value"),
                  F.count_distinct(col).alias("n_distinct"))


def validate_target(df: DataFrame, col: str = "target") -> DataFrame:
    """VAL-2: one row ``(ok, rule, min_value, max_value, n_missing)``; the extreme values as text, as
    the column's type holds them (a double would round integers above 2**53).

    Rules in order, the first failing one is reported: ``exists`` (column
    present), ``integer`` (integral type, no null), ``min`` (min = 0), ``gap``
    (every integer between min and max occurs; ``n_missing`` of them do not).
    ``missing_codes`` lists them."""
    spark = df.sparkSession
    if not has_column(df, col):
        return spark.range(1).select(F.lit(False).alias("ok"), F.lit("exists").alias("rule"),
                                     F.lit(None).cast("string").alias("min_value"),
                                     F.lit(None).cast("string").alias("max_value"),
                                     F.lit(None).cast("bigint").alias("n_missing"))
    integral = is_integer_type(df, col)
    s = target_stats(df, col)
    # Exact for every integer type: the span of a bigint column needs more than 64 bits.
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    n_missing = (wide("max_value") - wide("min_value") + 1 - wide("n_distinct")).try_cast("bigint")
    rule = (F.when(~F.lit(integral) | (F.col("n_null") > 0), F.lit("integer"))
            .when(F.col("min_value") != 0, F.lit("min"))
            .when(n_missing > 0, F.lit("gap")))
    return s.select(rule.isNull().alias("ok"), F.coalesce(rule, F.lit("ok")).alias("rule"),
                    F.col("min_value").cast("string").alias("min_value"), F.col("max_value").cast("string").alias("max_value"),
                    F.when(F.lit(integral), n_missing).alias("n_missing"))
