"""The registered queries on the smallest tables: DuckDB twins, shapes, and the pipeline against a plain version."""

import collections
import os
import sys

import pytest
from conftest import ROOT, SF001, SF01

sys.path.insert(0, ROOT)
import corpus_pipeline  # noqa: E402
from tabtext.llm import packing  # noqa: E402
from tabtext.llm.queries import QUERIES, SQL, tokenizer_path  # noqa: E402
from tabtext.sources.tables import table  # noqa: E402
from test_llm_operators import brute_bins, brute_components, check_layout, check_pieces, lower  # noqa: E402


@pytest.mark.parametrize("sf", [SF001, SF01])
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck01, name, sf):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    con.execute(f"CREATE VIEW o AS {SQL[name]}")
    res = con.execute("SELECT * FROM o")
    cols = [c[0] for c in res.description]
    want = res.fetchall()
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_per_operator(spark, n):
    names = [q for q in QUERIES if q.startswith(f"op{n}_")]
    assert len(names) == 1


def test_native_queries_run_no_python(spark):
    for name in ("op2_mixing", "op8_exact_dedup"):
        df = QUERIES[name](spark, SF001)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_ngram_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF001, "documents").collect()]
    got = QUERIES["op1_ngram_join"](spark, SF001).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows)


def test_packing_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF001, "documents").collect()]
    got = QUERIES["op10_best_fit_packing"](spark, SF001).collect()
    check_pieces(got, rows)
    assert check_layout(got, 2048, lambda r: r["sequence_id"]) == brute_bins([r["length"] for r in got], 2048)


def test_quality_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF01, "labels").collect()}
    got = [r for r in QUERIES["op4_quality_qda"](spark, SF01).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in got) / len(got) >= 0.95


def test_rules_keep_good_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF01, "labels").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op6_quality_rules"](spark, SF01).collect()}
    assert all(got[i]["kept"] or got[i]["base_failed"] for i, q in labels.items() if q == 1)
    assert not any(got[i]["kept"] for i, q in labels.items() if q == 0)


def test_pipeline_against_plain_version(spark):
    docs = table(spark, SF001, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "mixing", "best_fit_packing"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op4_quality_qda"](spark, SF001).collect()}
    good = [i for i in rows if scores[i] == 1]
    last = {}
    for i in good:
        t = lower(rows[i]["text"])
        last[t] = max(last.get(t, i), i)
    stay = sorted(last.values())
    comp = brute_components([(i, rows[i]["text"]) for i in stay])
    first = sorted(i for i, _, c in comp if i == c)
    stages, at = dict(corpus_pipeline.STAGES), docs
    for name, want in (("quality_classifier", good), ("exact_dedup", stay), ("ngram_jaccard_join", first)):
        at = stages[name](spark, at, SF001)
        assert at.columns == docs.columns
        assert sorted(r["doc_id"] for r in at.collect()) == sorted(want), name
    mixed = stages["mixing"](spark, at, SF001)
    assert mixed.columns == docs.columns
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= set(first) and max(copies.values()) <= 2
    out = corpus_pipeline.run(spark, SF001).collect()
    check_pieces(out, [(i, rows[i]["text"]) for i, n in copies.items() for _ in range(n)])
    assert check_layout(out, packing.CAPACITY, lambda r: r["sequence_id"]) == brute_bins([r["length"] for r in out], packing.CAPACITY)


def test_nothing_else_imports_the_subpackage():
    for d, _, files in os.walk(os.path.join(ROOT, "tabtext")):
        if os.path.basename(d) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(os.path.join(d, f), encoding="utf-8").read().replace("llm_", ""), f
