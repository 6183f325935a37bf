"""Sorts, limits and top-k (TOP-1/2/3/5/6/7, PRJ-8, SET-6).

Top-n per group is ``row_number() <= n`` over a window; Spark plans it with a
partial ``WindowGroupLimit`` before the shuffle, so each map task only ships
its own best n rows per group (a hot group cannot flood one reducer).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import run_step
from .common import scalars


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
                    rank_col: str = "rank") -> DataFrame:
    """Keep the first ``n`` rows of each group under ``order`` (ties must be broken
    by the caller's order so the result is deterministic); ``rank_col`` 1..n."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def top_tokens(stats: DataFrame, top_n: int, group: str = "class", token: str = "token",
               value: str = "mean") -> DataFrame:
    """TOP-1/2: per class, tokens by |mean| descending (ties: token ascending), first
    ``top_n``; ``token_rank`` keeps the display order."""
    return top_n_per_group(stats, [group], [F.abs(F.col(value)).desc(), F.col(token).asc()], top_n,
                           "token_rank")


def head(df: DataFrame, num: int, key: str = "key") -> DataFrame:
    """PRJ-8: the first ``num`` rows by key (deterministic)."""
    return df.orderBy(key).limit(num)


def unique_labels(df: DataFrame, col: str) -> DataFrame:
    """SET-6 / TOP-6: sorted distinct non-null values."""
    return df.select(F.col(col).alias("label")).filter(F.col("label").isNotNull()).distinct().orderBy("label")


def feature_importance(attr: DataFrame, top_n: int = 20, group: str = "class", feature: str = "token",
                       value: str = "shap_value") -> DataFrame:
    """TOP-5 / XPL-6: mean |attribution| per (class, feature), the top ``top_n`` per
    class.  Rows without a feature's attribution count as 0, so the mean runs
    over the samples of the attribution table (``n_samples``)."""
    n = scalars(attr.agg(F.count_distinct("sample").alias("n")))["n"]
    s = (attr.groupBy(group, feature).agg(F.sum(F.abs(value)).alias("sum_abs"))
         .select(group, feature, (F.col("sum_abs") / n).alias("mean_abs")))
    return top_n_per_group(s, [group], [F.col("mean_abs").desc(), F.col(feature).asc()], top_n, "rank")


def select_best(runs: DataFrame, metric: str, run: str = "run", greater_is_better: bool = True) -> DataFrame:
    """TOP-7: the run with the best metric (ties: smallest run name)."""
    order = [F.col(metric).desc() if greater_is_better else F.col(metric).asc(), F.col(run).asc()]
    return runs.select(run, metric).orderBy(*order).limit(1)


def latest_run(runs: DataFrame, run: str = "run") -> DataFrame:
    """TOP-7: the run with the highest numeric suffix ``name-<step>``."""
    return runs.agg(F.max_by(F.col(run), run_step(F.col(run))).alias(run),
                    F.max(run_step(F.col(run))).alias("step"))
