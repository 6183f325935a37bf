"""Fixtures over the driver's tables, as Spark DataFrames (see ``FIXTURES.md``).

Every fixture is a lazy plan over the parquet scans, so each query that uses
one reads the whole source tables and grows with them.  The SQL twins live in
``fixture_sql.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import argmax
from ..operators.common import split_col
from ..operators.features import encode_labels, label_mapping
from ..session import written_table
from ..sources.tables import table


def fx_text_class(spark: SparkSession, sf: str) -> DataFrame:
    """documents joined with labels: ``key, split, sentence, label, n_chars``.
    ``labels`` grows with the data, so the join is left to the planner (AQE turns
    it into a broadcast only after measuring the labels side)."""
    d = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return (d.join(lab, "doc_id")
            .select(F.col("doc_id").alias("key"), split_col("doc_id").alias("split"),
                    F.col("text").alias("sentence"), F.col("quality").cast("int").alias("label"),
                    "n_chars"))


def fx_text_reg(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("key"), split_col("doc_id").alias("split"),
                    F.col("text").alias("sentence"), F.col("n_chars").cast("double").alias("label"), "lang")


def fx_num_class(spark: SparkSession, sf: str) -> DataFrame:
    """part: ``target`` = code of ``p_type`` (FEA-5 over the sorted distinct types)."""
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    m = label_mapping(p, "p_type")
    e = encode_labels(p, "p_type", m, out="target")
    return e.select(F.col("p_partkey").alias("key"), split_col("p_partkey").alias("split"),
                    "target", "p_size", "p_retailprice", "p_type")


def fx_missing(spark: SparkSession, sf: str, removed=("PROMO",)) -> DataFrame:
    """FX-NUM-CLASS with the ``removed`` types dropped from train only."""
    f = fx_num_class(spark, sf)
    return f.filter(~((F.col("split") == "train") & F.col("p_type").isin(list(removed))))


def fx_cat(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("key"), split_col("o_orderkey").alias("split"),
                    (F.col("o_totalprice") >= 100000).cast("int").alias("target"),
                    "o_orderstatus", "o_orderpriority", F.month("o_orderdate").cast("int").alias("o_month"))


def fx_num_reg(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.select(F.col("o_orderkey").alias("key"), split_col("o_orderkey").alias("split"),
                    F.col("o_totalprice").alias("target"), "c_acctbal",
                    F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
                    .cast("double").alias("days"))


N_LOGITS = 10


def fx_logits(spark: SparkSession, sf: str) -> DataFrame:
    """Ten logits from the whole vector: logit ``c`` is the sum of the entries whose
    position is ``c`` modulo ten, added in order."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    part = lambda c: F.aggregate(
        F.filter("v", lambda x, i: i % N_LOGITS == c), F.lit(0.0), lambda a, x: a + x)
    return e.select(F.col("vec_id").alias("key"), F.array(*[part(c) for c in range(N_LOGITS)]).alias("logits"),
                    F.col("label").cast("int").alias("label"))


def fx_pred_bin(spark: SparkSession, sf: str) -> DataFrame:
    t = fx_text_class(spark, sf)
    return t.select("key", "label", (F.col("n_chars") >= 1000).cast("int").alias("predicted_label"))


def fx_pred_multi(spark: SparkSession, sf: str) -> DataFrame:
    return fx_logits(spark, sf).select("key", "label", argmax("logits").alias("predicted_label"))


def fx_pred_zero(spark: SparkSession, sf: str) -> DataFrame:
    """Only the labels 0, 1 and 2 are predicted, so seven classes never are."""
    return fx_logits(spark, sf).select("key", "label", (argmax("logits") % 3).cast("int").alias("predicted_label"))


def fx_pred_reg(spark: SparkSession, sf: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """orders valid rows; predicted = train mean of ``o_totalprice`` per priority.
    Each priority holds a fifth of the rows, so the lookup is a hot-key join
    (the train count per priority measures it): the priorities are broadcast
    from a bounded list and no priority is gathered in one task."""
    from ..operators.joins import hot_key_join
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    tagged = o.withColumn("split", split_col("o_orderkey"))
    means = (tagged.filter(F.col("split") == "train").groupBy("o_orderpriority")
             .agg(F.avg("o_totalprice").alias("predicted_label"), F.count(F.lit(1)).alias("n")))
    va = tagged.filter(F.col("split") == "valid")
    return hot_key_join(va, means, "o_orderpriority", "n").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("label"), "predicted_label", *carry)


def fx_doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """``(key, split, label, term, tf)``: FX-TEXT-CLASS tokens (no stop words)
    counted per document."""
    from ..operators.features import doc_terms
    return doc_terms(fx_text_class(spark, sf), stop_words=None, carry=("split", "label"))


def fx_attr(spark: SparkSession, sf: str) -> DataFrame:
    """FX-ATTR: exact attributions of the log-ratio linear scorer fitted on train."""
    from ..operators.attributions import linear_token_attributions, linear_token_weights
    # The term counts are written once: the weights and the attributions read them, and the text
    # is tokenised once however often a summary uses this table.
    dt = written_table(fx_doc_tokens(spark, sf), "attribution-terms")
    w = written_table(linear_token_weights(dt, fit=F.col("split") == "train"), "attribution-weights")
    return linear_token_attributions(dt.select("key", "term", "tf"), w)
