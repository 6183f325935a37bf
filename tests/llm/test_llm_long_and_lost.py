"""Very long words, lines and runs in every operator, and rows that must not be lost."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabtext.llm import common, exact_dedup, licenses, mixing, ngram_join, packing, secrets, token_matrix, warc
from tabtext.llm import textscan as ts
from tabtext.llm.queries import SQL, tokenizer_path
from test_llm_operators import DOCS, brute_components, docs, lower

MEGA = 1_200_000
LONG = [" " * MEGA + "x", "a" * MEGA, "#" * MEGA, "\n" * MEGA, "word " * (MEGA // 5)]


# -- 5 ----------------------------------------------------------------------------------------------

NOTICES = ["Copyright " + "Jane " * 200_000, "Copyright " + "Aa" * 500_000 + "(", "Copyright Jane" + " " * MEGA + "Doe,", "Copyright " + "A" * MEGA,
           "#" * MEGA + " Copyright Jane", "Copyright Jane " + "<" * MEGA, "Copyright " + "by the " * 200_000 + "Jane", "-" * MEGA, " \t" * 500_000 + "\n-"]
TELLING = ["Copyright Jane Doe\n{mit}", "(c) Jane Doe and the Example Authors\n{mit}", "Copyright the Holders of it\n{mit}", "Copyright holders are many\n{mit}",
           "Copyright The Owner's Club\n{mit}", "Copyright Jane Doe <jane d@x.org>, Inc.\n{mit}", "Copyright Jane Doe,\n{mit}", "Copyright 2020 x y z\n{mit}",
           "All rights reserved.\n{mit}", "copyright\nholders", "copyright\nowners", "sub-\nlicense it", "sub-\n  * license it", "sublicense it", "Copyright The",
           "Copyright by J. R. Doe\r\nsecond", "prose\nCopyright Jane(Doe)\nmore", "(C) ACME Corp of Élan & Sons.\n{mit}", "x\n-\ny", "// Copyright: (c) J Doe\nReleased under the MIT License."]


def test_license_scan_very_long_lines(spark):
    rows = list(enumerate(NOTICES + LONG))
    got = {r["doc_id"]: r for r in licenses.license_scan(docs(spark, rows).repartition(4)).collect()}
    plain = [licenses.hashlib.sha256(licenses.canonical_text(t).encode()).hexdigest() for _, t in rows]
    assert [got[i]["text_digest"] for i, _ in rows] == plain
    blank = licenses.hashlib.sha256(b"").hexdigest()
    assert [got[i]["text_digest"] == blank for i in (0, 1, 2, 3, 4, 5, 6, 7, 8)] == [True, False, False, False, True, False, True, True, True]


def test_license_sql_tells_notices_from_prose(spark):
    mit = licenses.KNOWN["MIT"]
    rows = [(i, t.replace("{mit}", mit)) for i, t in enumerate(TELLING)] + [(100, None), (101, "")]
    df = docs(spark, rows)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    res = con.execute(f"SELECT * FROM ({SQL['op5_license_scan']})")
    cols = [c[0] for c in res.description]
    want = sorted(res.fetchall(), key=str)
    assert sorted(map(tuple, licenses.license_scan(df).select(*cols).collect()), key=str) == want
    by = {r[cols.index("doc_id")]: r[cols.index("license_id")] for r in want}
    assert [by[i] for i in range(10)] == ["MIT", "MIT", None, None, None, "MIT", None, "MIT", "MIT", None]


# -- 3 ----------------------------------------------------------------------------------------------

def test_warc_very_long_url(spark):
    pages = spark.createDataFrame([(1, "http://a.example/" + "x" * (3 << 20), "<p>a</p>"), (2, "http://b.example/", "<p>b</p>" * 200_000)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(pages), with_payload=True).collect()}
    assert len(got[1]["url"]) == 17 + (3 << 20) and bytes(got[2]["payload"]) == b"<p>b</p>" * 200_000


def test_warc_header_without_end():
    import io
    with pytest.raises(warc.WarcError, match="no end of headers"):
        list(warc.read_records(io.BytesIO(warc.member(b"WARC/1.1\r\n" + b"x" * (2 << 20)))))


# -- 7, 10 ------------------------------------------------------------------------------------------

def test_packing_very_long_runs(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    texts = LONG + ["é" * 400_000, "1" * MEGA, " " * MEGA + "<|endoftext|>"]
    for t, ids in zip(texts, packing.encode(texts, tokenizer_path(), False)):
        assert ids.tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0]
    df = docs(spark, list(enumerate(texts)))
    got = packing.pack_documents(df, tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    want = {i: len(x) for i, x in enumerate(packing.encode(texts, tokenizer_path(), False))}
    assert {r["doc_id"]: r["n"] for r in got} == want
    rows = token_matrix.write_matrices(df, tokenizer_path(), block_ids=100_000).collect()
    total = collections.Counter()
    for r in rows:
        total[r["doc_id"]] += r["length"]
    assert dict(total) == want


def test_position_resets_are_written(spark):
    df = docs(spark, [(i, "some words here " * (i % 7)) for i in range(60)])
    rows = token_matrix.write_matrices(df, tokenizer_path(), capacity=64).collect()
    for uri in {r["file"] for r in rows}:
        with token_matrix.read_stream(uri) as s:
            data = s.read()
        n = int(np.frombuffer(data, "<i8", 8)[3])
        resets = np.frombuffer(data, "<i4")[-n:].tolist()
        assert resets == [r["offset"] for r in sorted((r for r in rows if r["file"] == uri), key=lambda r: (r["row"], r["offset"]))]
        _, cu, positions = token_matrix.read_block(uri)
        for r in rows:
            if r["file"] == uri:
                assert positions[r["row"], r["offset"]:r["offset"] + r["length"]].tolist() == list(range(r["length"]))


# -- 1, 2, 8 ----------------------------------------------------------------------------------------

def test_ngram_very_long_texts(spark):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(150_000)]
    near = base[:70_000] + ["changed"] + base[70_001:]
    rows = [(i, t) for i, t in enumerate(LONG)] + [(10, " ".join(base)), (11, " ".join(near)), (12, " ".join(base[:60_000]))]
    got = ngram_join.ngram_components(docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows)


def test_mixing_very_long_texts(spark):
    got = {r["doc_id"]: r["size"] for r in mixing.mix_digest(docs(spark, list(enumerate(LONG)))).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0, 4: MEGA // 5}


def test_keep_first_loses_no_clean_row(spark):
    rng = random.Random(6)
    a = [f"w{rng.randint(0, 5000)}" for _ in range(60)]
    b = [f"v{rng.randint(0, 5000)}" for _ in range(60)]
    near = " ".join(a[:59] + ["x"])
    rows = [(1, " ".join(a)), (2, near), (2, " ".join(b)), (None, " ".join(a[:58])), (None, " ".join(b) + " y"), (3, "short"), (3, "short"), (4, None), (None, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_first(docs(spark, rows)).collect()), key=str)
    want = [(1, " ".join(a)), (2, " ".join(b)), (3, "short"), (3, "short"), (4, None), (None, None)]
    assert got == sorted(want, key=str)


def test_null_keys_do_not_meet_in_one_task(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    groups = common.written(rows.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")), "test-groups")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = common.attach(rows, groups, "k", "n", 40_000)
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 10_000 and sum(r["count"] for r in sizes) == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("words,parts", [(16, 8), (1, 8), (1, 1 << 20)])
def test_exact_dedup_beyond_the_broadcast_bound(spark, monkeypatch, words, parts):
    """Filter in one part, in none, in many: equal results, and no text shuffles."""
    rows = [(i, f"text {i % 40 if i % 3 else i}") for i in range(400)]
    df = docs(spark, rows)
    last = {}
    for i, t in rows:
        last[lower(t)] = max(i, last.get(lower(t), i))
    if words == 1 and parts > 8:
        rows, words, parts = rows, 16, 1 << 20
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_WORDS", words)
    monkeypatch.setattr(exact_dedup, "MAX_PARTS", parts)
    kept = exact_dedup.keep_last(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(last.values())
    digest = exact_dedup.dedup_digest(df).collect()
    assert sorted(r["doc_id"] for r in digest if r["kept"]) == sorted(last.values()) and len(digest) == 400
    if not exact_dedup.fits(exact_dedup.filter_words(400)):
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and not re.search(r"Exchange hashpartitioning", plan)


# -- 9 ----------------------------------------------------------------------------------------------

def test_secret_mixed_case_candidates(spark):
    rows = [(1, "key is AbCdEfGhIjKlMnOpQrStUvWxYzabcdef here"), (2, "Authorization: Bearer abcdEFGHijklMNOPqrstUVWXyzab"), (3, "an ordinary McDonald sentence"), (4, "UPPERlowerUPPERlower"), (5, "short aBcDeF")]
    df = docs(spark, rows)
    got = {r["doc_id"]: r["candidate"] for r in secrets.candidates(df, secrets.transitions(secrets.corpus_counts(df))).collect()}
    assert got == {1: "AbCdEfGhIjKlMnOpQrStUvWxYzabcdef", 2: "abcdEFGHijklMNOPqrstUVWXyzab"}


def plain_features(word, raw, before, after, source, dictionary, pairs):
    """Every feature by its definition, in plain Python."""
    fold = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    kinds = [0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 for c in word]
    n = len(word)
    share = collections.Counter(word)
    f = fold(word)
    row = collections.Counter()
    for (a, _), c in pairs.items():
        row[a] += c
    surprise = -sum(math.log2((pairs[a, b] + 1) / (row[a] + 256)) for a, b in zip(f, f[1:])) / (n - 1)
    parts = re.findall(rb"[a-z\x80-\xff]{3,}", f)
    out = [n, -sum(c / n * math.log2(c / n) for c in share.values()), surprise, sum(len(p) for p in parts if p in dictionary) / n,
           (1 + sum(a != b for a, b in zip(kinds, kinds[1:]))) / n, sum((a == 2) != (b == 2) for a, b in zip(kinds, kinds[1:])) / n,
           float(b"=" in word), float(raw[:1] in (b'"', b"'")), secrets._hash(source.encode()) % 64, *(kinds.count(k) / n for k in range(4))]
    for text in (before.split()[-3:], after.split()[:3]):
        slot = [0.0] * secrets.CONTEXT_BUCKETS
        for w in text:
            slot[secrets._hash(w) % secrets.CONTEXT_BUCKETS] = 1.0
        out += slot
    return out


def test_secret_features_and_scanner_against_plain_versions(spark):
    rng = random.Random(4)
    vocab = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "Delta") for b in ("one", "two", "seven")]
    rows = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(20)]
        w[7] = rng.choice([f"alphaone{rng.randint(10, 99)}", f"x{rng.randint(10 ** 8, 10 ** 9)}", f"\"betatwo-{rng.randint(100, 999)}\"", f"k=Gamma{rng.randint(10, 99)}seven", "plainword"])
        rows.append((i, " ".join(w), f"src{i % 3}"))
    df = docs(spark, rows)
    counts = common.written(secrets.corpus_counts(df), "test-counts")
    found = common.written(secrets.candidates(df, secrets.transitions(counts)).withColumn("row", F.monotonically_increasing_id()), "test-found")
    got = {r["doc_id"]: r for r in secrets.covered(found, counts).collect()}
    words, pairs = collections.Counter(), collections.Counter()
    for _, t, _ in rows:
        for w in t.encode().split():
            f = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
            words[f] += 1
            pairs.update(zip(f, f[1:]))
    dictionary = {w for w, n in words.items() if n >= secrets.DICTIONARY_COUNT and n * secrets.DICTIONARY_RATE >= sum(words.values())}
    want = set()
    for i, t, s in rows:
        w = t.encode().split()
        if sum(48 <= c <= 57 for c in w[7]) < 2 or len(w[7]) < 8:
            continue
        want.add(i)
        bare = w[7].strip(secrets.STRIP.encode())
        r = got[i]
        assert r["candidate"].encode() == bare and r["start"] == t.encode().index(bare)
        assert r["x"] == pytest.approx(plain_features(bare, w[7], b" ".join(w[4:7]), b" ".join(w[8:11]), s, dictionary, pairs), abs=1e-9)
    assert set(got) == want


def test_secret_dictionary_has_no_cap(spark):
    """60,000 words that occur twice are all in the dictionary."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    every = [letters[i // 17576 % 26] + letters[i // 676 % 26] + letters[i // 26 % 26] + letters[i % 26] for i in range(60_000)]
    df = docs(spark, [(0, " ".join(every)), (1, " ".join(every)), (2, f"{every[59_999]}{rng_digits()} {every[0]}77777")])
    counts = common.written(secrets.corpus_counts(df), "test-counts")
    found = common.written(secrets.candidates(df, secrets.transitions(counts)).withColumn("row", F.monotonically_increasing_id()), "test-found")
    at = secrets.NUMBERS.index("covered")
    assert [r["x"][at] for r in secrets.covered(found, counts).collect()] == pytest.approx([4 / 9, 4 / 9])


def rng_digits():
    return "12345"
