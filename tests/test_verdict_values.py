"""Values that rounding or cancellation used to spoil."""

from pyspark.sql import functions as F


def test_r2_of_large_targets(spark):
    from tabtext.operators.evaluate import regression_metrics, regression_metrics_by
    df = spark.range(100_000).select((F.lit(1e9) + F.col("id") / 100_000).alias("label"))
    df = df.withColumn("predicted_label", F.col("label") + F.when(F.rand(1) < 0.5, 0.01).otherwise(-0.01))
    r2 = regression_metrics(df).first()["r2"]
    assert abs(r2 - (1 - 1e-4 / (1 / 12))) < 1e-4
    by = regression_metrics_by(df.withColumn("run", F.lit("a")), "run").first()
    assert abs(by["r2"] - r2) < 1e-9


def test_mean_row_is_not_truncated(spark):
    from tabtext.operators.features import impute_missing_classes
    tr = spark.createDataFrame([(1, "train", 0, 1), (2, "train", 0, 2)], "key long, split string, target int, size int")
    va = spark.createDataFrame([(3, "valid", 1, 5)], tr.schema)
    out = impute_missing_classes(tr, va, "target", ["size"])
    assert sorted((r["target"], r["size"]) for r in out.collect()) == [(0, 1.0), (0, 2.0), (1, 1.5)]


def test_target_check_above_two_to_53(spark):
    from tabtext.operators.checks import validate_target
    big = 9007199254740993
    r = validate_target(spark.createDataFrame([(0,), (big,)], "target long")).first()
    assert (r["ok"], r["rule"], r["min_value"], r["max_value"], r["n_missing"]) == (False, "gap", "0", str(big), big - 1)
    r = validate_target(spark.createDataFrame([(0,), (1,), (2,)], "target int")).first()
    assert (r["ok"], r["max_value"], r["n_missing"]) == (True, "2", 0)


def test_unseen_token_has_a_zero_row(spark):
    from tabtext.operators.attributions import linear_token_attributions, linear_token_weights
    terms = spark.createDataFrame([(1, "train", 1, "a", 2), (5, "valid", 0, "zz", 3)],
                                  "key long, split string, label int, term string, tf long")
    w = linear_token_weights(terms, fit=F.col("split") == "train")
    got = linear_token_attributions(terms.select("key", "term", "tf"), w).collect()
    assert sorted((r["token"], r["class"], abs(r["shap_value"])) for r in got if r["token"] == "zz") == [("zz", 0, 0.0), ("zz", 1, 0.0)]


def test_damaged_parquet_is_an_error(spark, tmp_path):
    import pytest
    from tabtext.sources.csv import read_attributions
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "part.parquet").write_text("sample,token,class,shap_value\n1,a,0,1.0\n")
    with pytest.raises(Exception):
        read_attributions(spark, str(tmp_path / "x")).collect()


def test_stop_words_match_the_word_pattern():
    import re
    from tabtext.functions.text import ENGLISH_STOP_WORDS
    assert all(re.fullmatch(r"\w{2,}", w) for w in ENGLISH_STOP_WORDS) and {"don", "ll", "ve", "the"} <= set(ENGLISH_STOP_WORDS)
