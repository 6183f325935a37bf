"""CSV sources and sinks (SRC-1..5, SNK-1)."""

import os
import tempfile

from tabtext.sources.csv import check_source, read_csv, read_pair
from tabtext.sources.sinks import write_predictions


def _write(text):
    d = tempfile.mkdtemp(prefix="tabtext-csv-")
    p = os.path.join(d, "f.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


FX_CSV = 'sentence,label\n"He said ""hi"", then\nleft",1\n"a, b",NA\n'


def test_csv_quotes_newline_comma_na(spark):
    df = read_csv(spark, _write(FX_CSV))
    rows = df.collect()
    assert len(rows) == 2
    assert rows[0]["sentence"] == 'He said "hi", then\nleft'
    assert rows[1]["sentence"] == "a, b"
    assert rows[1]["label"] is None
    # an integer column with a missing value becomes double, as pandas reads it
    assert dict(df.dtypes)["label"] == "double"


def test_read_pair_keys_and_types(spark):
    tr = _write("target,x\n0,1.5\n1,2\n")
    va = _write("target,x\n1,3\n")
    df = read_pair(spark, tr, va)
    rows = df.collect()
    assert len(rows) == 3 and len({r["key"] for r in rows}) == 3
    assert {r["split"] for r in rows} == {"train", "valid"}
    assert dict(df.dtypes)["target"] == "bigint" and dict(df.dtypes)["x"] == "double"


def test_check_source(spark):
    ok, why = check_source(spark, "/nonexistent/file.csv")
    assert not ok and why.startswith("missing")
    ok, why = check_source(spark, _write("a,b\n1,2\n"), "target")
    assert not ok and "target" in why
    assert check_source(spark, _write("a,b\n1,2\n"), "a") == (True, "ok")


def test_write_predictions_roundtrip(spark):
    df = spark.createDataFrame([(1, 0, 'x "y"')], "label int, predicted_label int, sentence string")
    out = os.path.join(tempfile.mkdtemp(prefix="tabtext-out-"), "pred")
    write_predictions(df, out, rename={"label": "actual_label"})
    back = read_csv(spark, out)
    r = back.first()
    assert r["actual_label"] == 1 and r["sentence"] == 'x "y"'
