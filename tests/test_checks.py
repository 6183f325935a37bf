"""Validation jobs (VAL-1..3, SET-2/4, FIL-6)."""

from tabtext.operators import checks as C


def test_validate_target_rules(spark):
    def v(rows, schema, col="target"):
        return C.validate_target(spark.createDataFrame(rows, schema), col).first()
    assert v([(0,), (1,), (2,)], "target int")["rule"] == "ok"
    assert v([(1,), (2,)], "target int")["rule"] == "min"
    r = v([(0,), (2,), (5,)], "target int")
    assert r["rule"] == "gap" and r["n_missing"] == 3
    assert v([(0.5,), (1.0,)], "target double")["rule"] == "integer"
    assert v([(0,), (None,)], "target int")["rule"] == "integer"
    assert v([(0,)], "other int")["rule"] == "exists"
    # first failing rule wins: non-integer before min
    assert v([(1.5,)], "target double")["rule"] == "integer"


def test_missing_codes(spark):
    df = spark.createDataFrame([(0,), (2,), (5,)], "t int")
    assert sorted(r["code"] for r in C.missing_codes(df, "t").collect()) == [1, 3, 4]


def test_class_difference(spark):
    tr = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    va = spark.createDataFrame([("b",), ("c",)], "c string")
    got = {(r["value"], r["side"]) for r in C.class_difference(tr, va, "c").collect()}
    assert got == {("a", "train_only"), (None, "train_only"), ("c", "valid_only")}
    assert C.classes_consistent(tr, tr, "c").first()["consistent"]


def test_label_distribution_and_histogram(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "dd ee"), (0, "ff")], "label int, sentence string")
    rows = C.label_distribution(df, "label").collect()
    assert [(r["label"], r["label_name"], r["n"]) for r in rows] == [(0, "ラベル0", 1), (1, "ラベル1", 2)]
    h = {r["n_tokens"]: r["n_docs"] for r in C.token_length_histogram(df).collect()}
    assert h == {0: 1, 1: 1, 2: 1}  # single letters are not tokens
