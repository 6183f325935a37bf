"""Driver contract: entry, queries and oracle keys."""

import importlib.util
import os

from conftest import ROOT


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    m = _entry()
    df = m.entry(spark)
    rows = df.collect()
    assert len(rows) >= 2
    assert df.columns == ["method", "class", "accuracy", "precision", "recall"]
    methods = {r["method"] for r in rows}
    assert methods == {"tfidf_linear", "baseline"}


def test_oracle_keys_subset_of_queries():
    m = _entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80
