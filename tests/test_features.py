"""Feature engineering (FEA-*): check values of FIXTURES.md and properties."""

import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF01
from tabtext.operators import features as FE
from tabtext.plans import fixtures as X


def test_tfidf_check_values(spark):
    """FX-TEXT-CLASS, no stop words, vocabulary 1,000: 32,734 cells, weight sum
    2,448.5835, every non-empty document has unit L2 norm."""
    t = X.fx_text_class(spark, SF01)
    cells = FE.tfidf_long(t, vocab_size=1000, stop_words=None)
    agg = cells.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("s")).first()
    assert agg["n"] == 32734
    assert agg["s"] == pytest.approx(2448.5835, abs=1e-3)
    norms = cells.groupBy("key").agg(F.sum(F.col("weight") ** 2).alias("n2"))
    assert norms.agg(F.max(F.abs(F.col("n2") - 1))).first()[0] < 1e-9


def test_tfidf_vector_equals_long(spark):
    t = X.fx_text_class(spark, SF01)
    model, vocab = FE.tfidf_model(t, vocab_size=500)
    vec = model.transform(t.withColumn("tokens", FE.tokens_column()))
    arr = vec.select("key", F.posexplode(vector_to_array("tfidf")).alias("term_id", "w")).filter("w <> 0")
    cells = FE.tfidf_long(t, vocab_size=500)
    j = arr.join(cells, ["key", "term_id"], "full_outer")
    bad = j.filter(F.col("w").isNull() | F.col("weight").isNull() | (F.abs(F.col("w") - F.col("weight")) > 1e-12))
    assert bad.count() == 0
    assert len(vocab) == 500


def test_encode_ids_check_values(spark):
    """FX-SEQ: 46,443 positions before padding, 24,474 known, sum of ids 4,227,462."""
    t = X.fx_text_class(spark, SF01)
    vocab = FE.vocabulary(FE.doc_terms(t, stop_words=None), 1000)
    e = FE.encode_ids(t, vocab, max_len=128, vocab_bound=1000)
    toks = t.select(F.size(F.slice(FE.tokens(F.col("sentence")), 1, 128)).alias("n"))
    assert toks.agg(F.sum("n")).first()[0] == 46443
    s = e.select(F.explode("ids").alias("id")).agg(F.count(F.when(F.col("id") != 0, 1)).alias("known"),
                                                    F.sum("id").alias("sid")).first()
    assert s["known"] == 24474 and s["sid"] == 4227462
    assert e.filter(F.size("ids") != 128).count() == 0


def test_label_encode_decode_roundtrip(spark):
    df = spark.createDataFrame([(10,), (2,), (1,), (2,)], "y int")
    m = FE.label_mapping(df, "y")
    assert [(r["value"], r["code"]) for r in m.orderBy("code").collect()] == [(1, 0), (2, 1), (10, 2)]
    enc = FE.encode_labels(df, "y", m, "code")
    dec = FE.decode_labels(enc, "code", m, "back")
    assert all(r["y"] == r["back"] for r in dec.collect())


def test_unseen_label_raises(spark):
    tr = spark.createDataFrame([(0,), (1,)], "y int")
    va = spark.createDataFrame([(2,)], "y int")
    m = FE.label_mapping(tr, "y")
    with pytest.raises(Exception):
        FE.encode_labels(va, "y", m, "code").collect()


def test_minmax_inverse(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "y double")
    st = FE.minmax_fit(df, "y")
    s = FE.minmax_transform(df, "y", st, "s")
    back = FE.minmax_inverse(s, ["s"], st)
    assert [r["s"] for r in back.orderBy("y").collect()] == [1.0, 3.0, 5.0]
    const = spark.createDataFrame([(2.0,), (2.0,)], "y double")
    st2 = FE.minmax_fit(const, "y")
    assert {r["s"] for r in FE.minmax_transform(const, "y", st2, "s").collect()} == {0.0}


def test_dummies(spark):
    df = spark.createDataFrame([(1, "b", 3), (2, "a", 1), (3, None, 3)], "key int, c string, m int")
    d = FE.dummies(df, ["c", "m"])
    assert d.columns == ["key", "c_b", "m_3"]
    assert [tuple(r) for r in d.orderBy("key").collect()] == [(1, 1, 1), (2, 0, 0), (3, 0, 1)]


def test_impute_missing_classes(spark):
    tr = spark.createDataFrame([(0, 1.0, 10.0), (0, 3.0, 20.0)], "y int, a double, b double")
    va = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "y int, a double, b double")
    out = FE.impute_missing_classes(tr, va, "y", ["a", "b"])
    extra = sorted((r["y"], r["a"], r["b"]) for r in out.filter("y > 0").collect())
    assert extra == [(1, 2.0, 15.0), (2, 2.0, 15.0)]


def test_char_bigrams(spark):
    from tabtext.functions.text import tokens
    df = spark.createDataFrame([("ab c",), ("x",)], "t string")
    rows = df.select(tokens("t", "char_ngram", 2).alias("g")).collect()
    assert rows[0]["g"] == ["ab", "bc"] and rows[1]["g"] == []


def test_softmax_logit(spark):
    from tabtext.functions.scalars import argmax, logit, softmax
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "a array<double>")
    r = df.select(softmax("a").alias("p"), argmax("a").alias("i")).first()
    assert sum(r["p"]) == pytest.approx(1.0) and r["i"] == 1
    z = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double").select(logit("p").alias("l")).collect()
    assert [x["l"] for x in z] == [None, 0.0, None]
    assert math.isclose(spark.range(1).select(logit(F.lit(0.75))).first()[0], math.log(3))


def test_encode_ids_keeps_documents_without_tokens(spark):
    """FEA-10: a document with no tokens gives all-zero ids and mask (kept by
    ``posexplode_outer``, no join back to the documents)."""
    from tabtext.operators.features import encode_ids
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, "!! ?"), (3, "")], "key long, sentence string")
    vocab = spark.createDataFrame([("alpha", 0), ("beta", 1)], "term string, term_id int")
    got = {r["key"]: (r["ids"], r["mask"]) for r in encode_ids(docs, vocab, max_len=4).collect()}
    assert got[1] == ([1, 2, 1, 0], [1, 1, 1, 0])
    assert got[2] == ([0, 0, 0, 0], [0, 0, 0, 0])
    assert got[3] == ([0, 0, 0, 0], [0, 0, 0, 0])
    plan = encode_ids(docs, vocab, max_len=4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
