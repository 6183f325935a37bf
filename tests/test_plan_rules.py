"""Plan rules the package keeps: no cross joins (one-row aggregates are scalar
subqueries), no ``localCheckpoint``, a mandatory vocabulary cap, and file
hand-offs under the shared checkpoint folder."""

import os
import re

import pytest

from conftest import ROOT, SF001

PKG = os.path.join(ROOT, "tabtext")


def _sources():
    for d, _, files in os.walk(PKG):
        for f in files:
            if f.endswith(".py"):
                p = os.path.join(d, f)
                yield p, open(p, encoding="utf-8").read()


@pytest.mark.parametrize("pattern", [r"\.crossJoin\(", r"localCheckpoint", r"how\s*=\s*['\"]cross['\"]"])
def test_forbidden_calls_absent(pattern):
    hits = [p for p, s in _sources() if re.search(pattern, s)]
    assert not hits, hits


def test_scalar_subquery_replaces_cross_join(spark):
    from pyspark.sql import functions as F
    from tabtext.operators.evaluate import label_share
    df = spark.createDataFrame([(0,), (0,), (1,), (2,)], "label int")
    out = label_share(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    got = {r["label"]: (r["n"], r["share"]) for r in out.collect()}
    assert got == {0: (2, 0.5), 1: (1, 0.25), 2: (1, 0.25)}
    assert out.agg(F.sum("share")).first()[0] == 1.0


def test_minmax_roundtrip_without_join(spark):
    from tabtext.operators.features import minmax_fit, minmax_inverse, minmax_transform
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "y double")
    st = minmax_fit(df, "y")
    t = minmax_transform(df, "y", st)
    assert sorted(r[0] for r in t.collect()) == [0.0, 0.5, 1.0]
    back = minmax_inverse(t, ["y"], st)
    assert sorted(r[0] for r in back.collect()) == [1.0, 3.0, 5.0]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan


def test_vocabulary_needs_a_cap(spark):
    from tabtext.operators.features import vocabulary
    terms = spark.createDataFrame([(1, "a", 2), (2, "b", 1)], "key long, term string, tf long")
    with pytest.raises(ValueError):
        vocabulary(terms, None)
    assert [r["term"] for r in vocabulary(terms, 1).collect()] == ["a"]


def test_scratch_files_live_under_checkpoint_dir(spark):
    from tabtext.session import ensure_checkpoint_dir, scratch_path
    base = ensure_checkpoint_dir(spark).rstrip("/")
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a.startswith(base + "/") and b.startswith(base + "/") and a != b


def test_round_trip_query_reads_whole_table(spark):
    """SRC-1: every labelled document survives the CSV write and read."""
    from tabtext.plans.queries import QUERIES
    out = QUERIES["src_1_read_pair"](spark, SF001)
    n = spark.read.parquet(f"{SF001}/labels.parquet").join(
        spark.read.parquet(f"{SF001}/documents.parquet"), "doc_id").count()
    assert out.count() == n


def test_hot_key_join_is_exact_and_balanced(spark):
    """One token holds a third of the rows: the hot-key join gives the plain
    join's rows, and with broadcasts off the shuffle join's partitions stay even."""
    from pyspark.sql import functions as F
    from tabtext.operators.joins import hot_key_join
    big = spark.range(30000).select(
        F.col("id").alias("doc"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("t"), (F.col("id") % 1000).cast("string"))).alias("token"))
    small = (big.groupBy("token").agg(F.count(F.lit(1)).alias("n_rows"))
             .withColumn("w", F.length("token")).filter(F.col("token") != "t7"))
    ref = big.join(small.select("token", "w"), "token")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        j = hot_key_join(big, small, "token", "n_rows", hot_n=3)
        assert j.exceptAll(ref.select(*j.columns)).count() == 0
        assert ref.select(*j.columns).exceptAll(j).count() == 0
        left = hot_key_join(big, small, "token", "n_rows", hot_n=3, how="left")
        assert left.count() == big.count()
        sizes = [r["n"] for r in j.groupBy(F.spark_partition_id().alias("p"))
                 .agg(F.count(F.lit(1)).alias("n")).collect()]
        assert max(sizes) < 2 * (sum(sizes) / len(sizes)), sizes
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_attribution_summary_tokenises_once(spark):
    """The term counts are written once: no plan of a summary tokenises or shuffles the text again."""
    from tabtext.plans.queries import QUERIES
    for name in ("xpl_3_token_attributions", "xpl_5_token_summary", "agg_6_token_stats"):
        df = QUERIES[name](spark, SF001)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "regexp_extract_all" not in final and "REPARTITION_BY_COL" not in final, name


def test_label_paths_see_no_whole_column_in_one_task(spark):
    """Label codes and missing labels come from aggregations of the values, not from joins or windows over all rows."""
    from tabtext.operators.features import label_mapping, missing_labels
    df = spark.range(5000).selectExpr("concat('v', id % 700) AS v")
    m = label_mapping(df, "v")
    got = m.collect()
    assert sorted((r["value"], r["code"]) for r in got) == [(v, i) for i, v in enumerate(sorted(f"v{k}" for k in range(700)))]
    a, b = df.filter("v <> 'v3'"), df
    miss = missing_labels(a, b, "v")
    assert [r[0] for r in miss.collect()] == ["v3"]
    assert "Join" not in miss._jdf.queryExecution().optimizedPlan().toString()


def test_term_counts_need_no_shuffle(spark):
    from tabtext.operators.features import doc_terms
    df = spark.createDataFrame([(1, "bb aa bb, cc aa bb"), (2, ""), (3, None), (4, "the The x")], "key int, sentence string")
    a, b = doc_terms(df, stop_words=None), doc_terms(df, stop_words=None, by_key=True)
    assert a.dtypes == b.dtypes
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) == [
        (1, "aa", 2), (1, "bb", 3), (1, "cc", 1), (4, "the", 2)]
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_vocabulary_shuffles_no_text(spark):
    from tabtext.plans.queries import QUERIES
    df = QUERIES["top_3_vocabulary"](spark, SF001)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "REPARTITION_BY_COL" not in final
