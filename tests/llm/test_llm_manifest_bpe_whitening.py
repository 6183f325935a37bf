"""Merkle manifest, byte-level BPE and whitening against plain versions, on hard rows and on the smallest tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from conftest import SF001
from pyspark.sql import functions as F

from tabtext.llm import bpe, merkle, whitening
from tabtext.llm.queries import QUERIES, tokenizer_path
from tabtext.sources.tables import table

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# -- 11 ---------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, node string, path string, block string"


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    def spell(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(map(spell, (*r[:4], text))))

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            at = levels[-1]
            levels.append([sha("".join(at[i:i + 3])) for i in range(0, len(at), 3)])
        return levels

    def siblings(levels, i):
        out = []
        for at in levels[:-1]:
            low = i // 3 * 3
            out.append(("".join(at[low:i]), "".join(at[i + 1:low + 3])))
            i //= 3
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = up([leaf(r, r[4]) for r in groups[s]])
    top = up([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            way = siblings(trees[s], i) + siblings(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            acc = leaf(r, r[4].replace("\n", "") if bad and r[4] is not None else r[4])
            for left, right in way:
                acc = sha(left + acc + right)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], sha("".join(x + y for x, y in way)), acc, acc == top[-1][0]))
    return sorted(out, key=str)


def docs(spark, rows):
    return spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "x", "y", "z", "w") for r in rows], DOCS)


HARD = [(1, "a", "en", 3, "a\nb"), (1, "a", "en", 3, "a\nb"), (2, "a", None, None, None), (3, None, "en", 0, ""), (None, "a", "en", 1, "x\ny"),
        (4, None, "en", 5, "\n\n"), (5, "é", "de", 1, "é" * 300_000 + "\n"), (6, "", "de", 1, "-"), (7, "Z", "de", 1, "\n"), (1, "a", "en", 3, "other\n")]


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest_hard_rows(spark, levels):
    got = merkle.verify(docs(spark, HARD), levels).collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest(HARD)


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_rounds(spark, levels):
    """Blocks of 3 and 9 nodes: several rounds below and above the groups' roots."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 20 + [f"s{k}" for k in range(30)]), "en", 1, rng.choice(["a\nb", "ab", None])) for i in rng.sample(range(10 ** 6), 500)]
    got = merkle.verify(docs(spark, rows).repartition(7), levels).collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest(rows)


def test_manifest_sizes(spark):
    """Groups of 1 to 30 nodes: every shape of the last run."""
    rows = [(100 * n + i, f"s{n:02}", "en", 1, "t") for n in range(1, 31) for i in range(n)]
    got = merkle.verify(docs(spark, rows), 2).collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest(rows)


def test_manifest_empty(spark):
    assert merkle.verify(docs(spark, HARD).limit(0)).count() == 0


def test_manifest_runs_no_python_and_single_task_windows(spark):
    df = merkle.verify(docs(spark, HARD))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "SinglePartition", "NestedLoop"))


# -- 12 ---------------------------------------------------------------------------------------------

TEXTS = [None, "", " ", "\n \n", "a", "It's we'll I'd 'tis ''s 'S x's", "don't can't've 'll're 've", "tab\there  two   three\n\n\nx", "日本語のテキスト 123456", "é́ combining", "a <|endoftext|> b",
         "\x1c\x1d\x85 　x  y", "x" * 700, " " * 700 + "y", "😀😃" * 200, "ab" * 500 + " tail", "'" * 300 + "s", "end's", "end'", "end'l", "a'l l"]


def encoding():
    voc = bpe.vocabulary(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=voc.ranks, special_tokens={})


def random_texts(seed, n):
    rng = random.Random(seed)
    pools = ["abcdefgh  \n'stmrevl", "'s 't'll 're\n've 'm'd xyz", "äöüßéñ çãõ", "日本語中文 한국어", "0123456789 .,;:!?-_()[]{}<>/\\|@#$%^&*+=~`\"'", "\t\n\x0b\x0c\r \x85  ​\x1c\x1f"]
    any_char = [chr(c) for c in (rng.randrange(0x20, 0x30000) for _ in range(4000)) if not 0xD800 <= c < 0xE000]
    return ["".join(rng.choice(rng.choice(pools + [any_char])) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_bpe_pattern_is_the_given_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_bpe_split_equals_the_pattern():
    from tabtext.llm.textscan import text_runs
    import pyarrow as pa
    texts = [t or "" for t in TEXTS] + random_texts(1, 2000)
    pattern = regex.compile(bpe.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
                            .replace(r"[^\p{White_Space}", r"[^\p{White_Space}"))
    for low, data, offs in text_runs(pa.array(texts), 1 << 12):
        begin = bpe.split(data, offs)
        cut = np.split(data, begin[1:]) if len(begin) else []
        want = [m.encode() for t in texts[low:low + len(offs) - 1] for m in pattern.findall(t)]
        assert [c.tobytes() for c in cut] == want


def test_bpe_equals_tiktoken(spark):
    texts = TEXTS + random_texts(2, 1500)
    df = spark.createDataFrame([(i if i != 4 else None, t, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, value string, ids array<int>")
    enc = encoding()
    coded = bpe.bpe_encode(df, PATH)
    got = {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i if i != 4 else None] == enc.encode_ordinary(t or ""), t
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.bpe_decode(coded, PATH).collect()}
    assert all(back[i if i != 4 else None] == (t or "").encode() for i, t in enumerate(texts))


def test_bpe_every_token_encodes_to_itself():
    voc = bpe.Vocabulary(PATH)
    long_ = [t for t in voc.ranks if len(t) > 1]
    for some in (long_[:20_000], long_[20_000:40_000], long_[40_000:]):
        assert [x.tolist() for x in voc.contract(some)] == [[voc.ranks[t]] for t in some]


def test_bpe_heap_equals_recursion():
    voc = bpe.Vocabulary(PATH)
    rng = random.Random(9)
    pieces = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 200))).encode() for _ in range(300)]
    for p, want in zip(pieces, voc.contract(pieces)):
        assert bpe.heap_contract(voc.byte_id[np.frombuffer(p, np.uint8)].tolist(), voc.merges) == want.tolist()


def test_bpe_very_long_runs(spark):
    """1.2 million blanks, letters, marks and mixed letters; the reference library refuses some of these, so the round
    trip and the ids of a long prefix are checked."""
    rng = random.Random(3)
    texts = [" " * 1_200_000 + "x", "a" * 1_200_000, "-" * 1_200_000, "".join(rng.choice("abcdefghij") for _ in range(300_000)), "\n" * 1_200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.bpe_digest(df, PATH).collect():
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]]) and 0 < r["n_tokens"] <= len(texts[r["doc_id"]])
    short = [t[:20_000] for t in texts]
    got = bpe.bpe_encode(spark.createDataFrame(list(enumerate(short)), "doc_id long, text string"), PATH).collect()
    enc = encoding()
    assert all(r["ids"] == enc.encode_ordinary(short[r["doc_id"]]) for r in got)


def test_bpe_decode_of_unknown_and_null(spark):
    df = spark.createDataFrame([(1, [0, 5]), (2, [0, 50256]), (3, None), (4, []), (5, [7, None])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["bytes"] for r in bpe.bpe_decode(df, PATH).collect()}
    assert got[2] is None and got[3] is None and got[5] is None and got[4] == b"" and len(got[1]) >= 2


def test_bpe_cache_restarts(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    voc, enc = bpe.Vocabulary(PATH), encoding()
    for t in ("some words here", "other things there", "zyxwv qwert"):
        data = np.frombuffer(t.encode(), np.uint8)
        ids, ends = bpe.encode_run(voc, data, np.array([0, len(data)]))
        assert ids.tolist() == enc.encode_ordinary(t) and ends.tolist() == [0, len(ids)]


def test_bpe_query(spark):
    rows = {r["doc_id"]: r["text"] for r in table(spark, SF001, "documents").collect()}
    enc = encoding()
    got = QUERIES["op12_byte_bpe"](spark, SF001).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    for r in got:
        ids = enc.encode_ordinary(rows[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == sha(rows[r["doc_id"]] or "")
    empty = table(spark, SF001, "documents").limit(0)
    assert bpe.bpe_digest(empty, PATH).count() == 0 and bpe.bpe_encode(empty, PATH).count() == 0


# -- 13 ---------------------------------------------------------------------------------------------

EMB = "vec_id long, embedding array<float>, label int, x string, size string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], EMB)


def check_whitening(rows, got, k=4):
    """rows: the (id, vector of floats) that remain; every value against a dense eigendecomposition."""
    d = max(len(v) for _, v in rows)
    x = [[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (d - len(v)) for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    f = np.array(fit, float) - np.array(total) / n
    e, u = np.linalg.eigh(f.T @ f / n)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == len(rows) * min(k, d)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    sign = {}
    for (i, _), xi in zip(rows, x):
        for j in range(min(k, d)):
            r = by[i, j + 1][0]
            assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(xi, total))
            want = (np.array(xi) - np.array(total) / n) @ u[:, j] / math.sqrt(e[j])
            if abs(want) > 1e-6:
                sign.setdefault(j, np.sign(want * r["whitened"]))
                assert abs(r["whitened"] * sign[j] - want) < 1e-8 * max(1, abs(want))
            assert abs(r["explained"] - e[j] / e.sum()) < 1e-9
            assert r["identity_error"] < 1e-9


def test_whitening_hard_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(6)]) for i in range(60)]
    rows += [(None, rows[0][1]), (5, rows[5][1]), (70, rows[7][1][:4]), (71, []), (72, [0.0] * 6)]
    bad = [(80, None), (81, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (82, [float("nan")] * 6), (83, [float("inf")] + [0.0] * 5)]
    got = whitening.whiten(vectors(spark, rows + bad)).collect()
    assert not {r["vec_id"] for r in got} & {80, 81, 82, 83}
    check_whitening(rows, got)


@pytest.mark.parametrize("block,degree", [(6, 4), (12, 8)])
def test_whitening_filters_a_flat_spectrum(spark, block, degree):
    """64 dimensions of nearly equal variance: the filter must separate eigenvalues that differ by a hundredth."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 64)) * np.linspace(1.02, 1, 64)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(1000 + i, [float(c) for c in x[0]]) for i in range(400)]
    check_whitening(rows, whitening.whiten(vectors(spark, rows), block=block, degree=degree).collect())


def test_whitening_degenerate(spark):
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, None) for r in same)
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0, 1.0, 1.0]) for i in range(9)])).collect()
    first = [r for r in line if r["component"] == 1]
    assert len(line) == 36 and all(abs(r["explained"] - 1) < 1e-12 and r["identity_error"] < 1e-12 for r in first)
    assert all(r["whitened"] is None and r["explained"] == 0 for r in line if r["component"] > 1)
    assert whitening.whiten(vectors(spark, [])).count() == 0 and whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    ties = whitening.whiten(vectors(spark, [(i, [float(a), float(b)]) for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])])).collect()
    assert all(abs(r["explained"] - 0.5) < 1e-12 and r["identity_error"] < 1e-12 for r in ties)
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.5, 0.25])], "vec_id long, embedding array<double>")
    got = whitening.whiten(huge).collect()
    assert len(got) == 6 and all(r["deviation"] is None for r in got if r["vec_id"] < 3)


def test_whitening_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF001, "embeddings").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    check_whitening(rows, QUERIES["op13_whitening"](spark, SF001).collect())


def test_packed_vectors():
    import pyarrow as pa
    vs = [np.array(v, np.int64) for v in ([], [0, 0], [1, -128, 0], [127, 128], [-129, 5, 0, 7], [1 << 40, -1], [whitening.LOW, whitening.HIGH])]
    got = whitening.unpacked(pa.array([b"junk"] + [whitening.packed(v) for v in vs], pa.binary()).slice(1), 4)
    assert [r.tolist() for r in got] == [v.tolist() + [0] * (4 - len(v)) for v in vs]


@pytest.mark.parametrize("n", [11, 12, 13])
def test_one_query_per_new_operator(n):
    assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1
