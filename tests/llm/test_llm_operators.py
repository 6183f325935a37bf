"""Every operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tabtext.llm import (components, exact_dedup, licenses, mixing, ngram_join, packing, quality_qda, quality_rules, secrets,
                         token_matrix, warc)
from tabtext.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, __key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", "y", "z") for r in rows], DOCS)


def words(n, seed=0, vocab=5000):
    rng = random.Random(seed)
    return [f"w{rng.randint(0, vocab)}" for _ in range(n)]


HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Same Text"), (6, "same text"), (None, "same text"), (8, "é É"), (8, "é É"),
        (9, " ".join(words(40000, 1))), (10, "# " * 50), (11, "a" * 5000)]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def hard(spark):
    return docs(spark, HARD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- 8 ----------------------------------------------------------------------------------------------

def test_exact_dedup(hard, empty):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.dedup_digest(hard).collect()}
    sha = lambda t: hashlib.sha256(lower(t).encode()).hexdigest()
    groups = collections.defaultdict(list)
    for i, t in HARD:
        groups[sha(t)].append(i)
    for i, t in HARD:
        r, g = got[i, sha(t)], groups[sha(t)]
        top = max(x for x in g if x is not None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (top, len(g), i == top)
    assert exact_dedup.dedup_digest(empty).count() == 0
    full = exact_dedup.exact_dedup(hard)
    assert full.columns == [c for c in hard.columns if c != "kept"] + ["keep_id", "group_size", "kept", "text_sha256"]
    last = exact_dedup.keep_last(hard)
    assert last.columns == hard.columns
    assert sorted(r["doc_id"] for r in last.collect()) == [2, 3, 4, 6, 8, 8, 9, 10, 11]
    assert {r["kept"] for r in last.collect()} == {"x"}


def test_exact_dedup_hot_group_and_filter(spark):
    rows = [(i, "hot copy" if i % 3 == 0 else f"text {i} {i * 7}") for i in range(3000)]
    df = docs(spark, rows)
    out = exact_dedup.dedup_digest(df)
    assert out.filter("not kept").count() == 999 and out.filter("keep_id = 2997").count() == 1000
    keys = df.select(F.col("doc_id").alias("__id"), exact_dedup.text_key().alias("__key"))
    n = exact_dedup.filter_words(3000)
    bloom = exact_dedup.repeat_filter(keys, n)
    probed = exact_dedup.probe(keys, bloom, n)
    again = {r["__id"] for r in probed.filter("__again").collect()}
    assert {i for i in range(0, 3000, 3)} <= again and len(again) < 1000 + 2000 * 0.06
    plan = probed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


# -- 2 ----------------------------------------------------------------------------------------------

def brute_mix(rows, weights=(3, 1, 2), share=1.5, cap=2):
    """Iterated clamping, and a plain sort for the sample."""
    size = lambda t: len(WORD.findall(t or ""))
    sums = collections.Counter()
    for i, t, s in rows:
        sums[s] += size(t)
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, free, target = share * sum(sums.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] >= cap * sums[s]}
        if not full:
            target |= {s: level * w[s] for s in free}
            break
        for s in full:
            target[s] = float(cap * sums[s])
            left -= target[s]
        free -= full
    return sums, target


def test_mixing(spark, empty):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "c", "d", None, "é"])) for i in range(400)]
    rows += [(None, "x y z", "a"), (1000, None, "only null"), (5, rows[5][1], rows[5][2])]
    df = docs(spark, rows)
    got = mixing.mix_digest(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_digest(df.repartition(5)).collect()))
    sums, target = brute_mix(rows)
    source = {r[0]: r[2] for r in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sums[s] and abs(r["target"] - target[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    assert len(got) == len(rows)
    for s in sums:
        assert abs(taken[s] - target[s]) <= 60
    out = mixing.mix(df)
    assert out.columns == df.columns
    sizes = collections.Counter()
    for r in out.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert sizes == collections.Counter({s: n for s, n in taken.items() if n})
    assert mixing.mix_digest(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_all_empty(spark):
    got = mixing.mix_digest(docs(spark, [(1, None), (2, "  ")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


# -- 1 ----------------------------------------------------------------------------------------------

def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)].append(d)
    return sorted(((d, len(s), min(low[find(i)], default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def near(base, rng, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
    return w


def test_ngram_components(spark, empty):
    rng = random.Random(7)
    rows = [r[:2] for r in HARD if r[0] != 9]
    n = 100
    passage = words(60, 99)
    for g in range(25):
        base = words(rng.choice([6, 9, 12, 30, 64, 128, 200]), g)
        for _ in range(rng.randint(1, 12)):
            w = near(base, rng, rng.randint(0, max(1, len(base) // 18)))
            if rng.random() < 0.2:
                w = w[:int(len(w) * rng.uniform(0.75, 1))]
            if rng.random() < 0.3:
                w = w[:3] + passage + w[3:]
            rows.append((n, (" " if rng.random() < 0.5 else "\n").join(w)))
            n += 1
    hot = words(80, 1000)
    rows += [(n + i, " ".join(near(hot, rng, rng.randint(0, 4)))) for i in range(150)]
    got = ngram_join.ngram_components(docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows)
    assert ngram_join.ngram_components(empty).count() == 0


def test_ngram_signatures_cover_linked_sets():
    """Linked sets share a signature, whatever the frequencies."""
    import numpy as np
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(2, 300))
        x = rng.integers(-2**62, 2**62, n)
        drop = int(rng.integers(0, ngram_join.slack(n) + 1))
        y = np.concatenate([x[drop:], rng.integers(-2**62, 2**62, int(rng.integers(0, max(1, n // 12))))])
        both = len(set(x.tolist()) & set(y.tolist()))
        if 100 * both < 80 * len(set(x.tolist()) | set(y.tolist())):
            continue
        df = {int(g): int(v) for g, v in zip(np.concatenate([x, y]), rng.choice([2, 5, 8, 9, 50, 1000], len(x) + len(y)))}
        sigs = []
        for s in (x, y):
            s = np.array(sorted({int(g) for g in s}, key=lambda g: (df[g], g)))
            shared = np.array([g for g in s if g in set(x.tolist()) & set(y.tolist()) or rng.random() < 0.5])
            sigs.append((len(s), s, shared))
        out = [ngram_join.signatures_of(k, s, np.array([df[int(g)] for g in s])) for k, s, _ in sigs]
        assert set(out[0].tolist()) & set(out[1].tolist()) or n < 2


def test_keep_first(spark):
    base = words(100, 5)
    df = docs(spark, [(3, " ".join(base)), (1, " ".join(base[:-1])), (2, " ".join(words(50, 6))), (None, "lonely words here now ok"), (4, None)])
    out = ngram_join.keep_first(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 2, 4, None]


def test_connected_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101 + i) for i in range(50)] + [(7, 7)] + [
        (rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(70)]
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[find(a)] = find(b)
    label = {r["node"]: r["label"] for r in got.collect()}
    want = collections.defaultdict(set)
    for x in list(parent):
        want[find(x)].add(x)
    for group in want.values():
        assert len(group) == 1 or len({label[x] for x in group}) == 1
    assert len(set(label.values())) == sum(len(g) > 1 for g in want.values())


# -- 4 and 6 ----------------------------------------------------------------------------------------

def quality_tables(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(400):
        good = i % 4 != 0
        w = [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + rng.choice("abcdefgh") for _ in range(rng.randint(10, 200))]
        text = " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w)
        rows.append((i, text))
        marks.append((i, int(good), 0))
    return docs(spark, rows + [(None, None), (1000, ""), (1001, "x " * 100000)]), spark.createDataFrame(
        marks + [(5, None, None), (None, 1, 1), (7, 3, 0)], "doc_id long, quality int, toxic int")


def test_quality_qda(spark, empty):
    df, labels = quality_tables(spark)
    got = {r["doc_id"]: r for r in quality_qda.quality_scores(df, labels).collect()}
    assert len(got) == 403
    for i in range(400):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.7) == int(i % 4 != 0)
    assert got[None]["held_out"] is False and 0 <= got[1000]["score"] <= 1
    none = labels.filter("false")
    assert {r["score"] for r in quality_qda.quality_scores(df, none).collect()} == {0.5}
    kept = quality_qda.keep_good(df, labels)
    assert kept.columns == df.columns and kept.filter("doc_id < 400").count() == 300
    assert quality_qda.quality_scores(empty, labels).count() == 0 and quality_qda.keep_good(empty, labels).count() == 0


def test_quality_fit_matches_dense_formula(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    d = len(quality_qda.FEATURES)
    x = {y: rng.normal(size=(60, d)) @ rng.normal(size=(d, d)) + y for y in (0, 1)}
    rows = [(v.tolist(), y) for y in (0, 1) for v in x[y]]
    model = quality_qda.fit(spark.createDataFrame(rows, "x array<double>, label int"))
    cov = {y: np.cov(x[y].T, bias=True) for y in (0, 1)}
    pooled = (cov[0] + cov[1]) / 2
    logs = []
    probe = rng.normal(size=(5, d))
    for y in (0, 1):
        s = (1 - quality_qda.POOL) * cov[y] + quality_qda.POOL * pooled
        s = (1 - quality_qda.DIAGONAL) * s + quality_qda.DIAGONAL * np.diag(np.diag(s)) + quality_qda.RIDGE * np.eye(d)
        c = probe - x[y].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", c, np.linalg.inv(s), c) - 0.5 * np.linalg.slogdet(s)[1])
    want = 1 / (1 + np.exp(-(logs[1] - logs[0]) / quality_qda.TEMPERATURE))
    assert np.allclose(model.score(probe), want, atol=1e-9)


def test_quality_rules(spark, hard, empty):
    from test_llm_scan import brute
    rows = HARD + [(20, " ".join(words(30, 2))), (21, " ".join(words(10, 3) * 4)), (22, "\n".join(["same line here"] * 10 + words(40, 4)))]
    got = collections.defaultdict(list)
    for r in quality_rules.quality_rules(docs(spark, rows)).collect():
        got[r["doc_id"]].append(r)
    for i, t in rows:
        n, chars, symbols, dup, rep = brute(t or "")
        r = got[i].pop()
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n)
        assert not (r["base_failed"] and r["kept"])
        if i == 20:
            assert r["kept"]
    assert quality_rules.quality_rules(empty).count() == 0
    with_sample = quality_rules.quality_rules(docs(spark, rows), sample_rows=3)
    assert with_sample.filter("kept").count() == quality_rules.quality_rules(docs(spark, rows)).filter("kept").count()


# -- 10 and 7 ---------------------------------------------------------------------------------------

def brute_bins(lengths, capacity):
    """Best-fit decreasing, piece by piece: the number of bins."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms[rooms.index(min(fit))] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def check_layout(rows, capacity, bin_of):
    by = collections.defaultdict(list)
    for r in rows:
        by[bin_of(r)].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [8, 2048])
def test_best_fit_decreasing(capacity):
    rng = random.Random(capacity)
    for _ in range(40):
        lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, max(1, capacity // 9)) for _ in range(rng.randint(0, 300))]
        counts = collections.Counter(lengths)
        runs, bins = packing.best_fit_decreasing(counts, capacity)
        assert bins == brute_bins(lengths, capacity)
        rows = []
        for length, rs in runs.items():
            ranks = sorted(k for r, n, _, _ in rs for k in range(r, r + n))
            assert ranks == list(range(counts[length]))
            rows += [{"offset": o, "length": length, "b": b + k} for r, n, b, o in rs for k in range(n)]
        assert check_layout(rows, capacity, lambda r: r["b"]) == bins
        rr, oo, nn = token_matrix.pack_block(__import__("numpy").array(lengths, dtype=int), capacity)
        assert nn == bins


def hf_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_tokenizers():
    rng = random.Random(9)
    texts = [None, "", " ", "<|endoftext|>", "don't  stop\n\n now's", "Ünïcödé 漢字 🙂 ​ x y", "a" * 3000, "1234567 89"]
    pool = "ab cD\n\t'é漢🙂0# 　́"
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 200))) for _ in range(200)]
    assert [x.tolist() for x in packing.encode(texts, tokenizer_path())] == hf_ids(texts)


def test_pieces_hold_the_ids_of_added_tokens(spark):
    """The ids are those of an unmodified tokenizer with add_special_tokens=False, markers in the text included."""
    import numpy as np
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext", "no marker"]
    rows = {r["doc_id"]: r for r in packing.pack_documents(docs(spark, list(enumerate(texts))), tokenizer_path(), with_ids=True).collect()}
    for i, t in enumerate(texts):
        want = plain.encode(t, add_special_tokens=False).ids + [0]
        assert list(rows[i]["ids"]) == want and rows[i]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
    assert list(rows[0]["ids"]) == [64, 220, 50256, 275, 0]


def check_pieces(rows, source):
    import numpy as np
    ids = hf_ids([t for _, t in source])
    want = []
    for (i, _), full in zip(source, ids):
        for k, (a, n) in enumerate(packing.pieces_of(len(full), 2048)):
            want.append((str(i), k, a, n, zlib.crc32(np.array(full[a:a + n], "<u4").tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)


def test_pieces_of():
    assert packing.pieces_of(1, 4) == [(0, 1)] and packing.pieces_of(4, 4) == [(0, 4)]
    assert packing.pieces_of(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_pack_documents(spark, hard, empty):
    rows = packing.pack_documents(hard, tokenizer_path()).collect()
    check_pieces(rows, HARD)
    assert check_layout(rows, 2048, lambda r: r["sequence_id"]) == brute_bins([r["length"] for r in rows], 2048)
    many = docs(spark, [(i % 90, " ".join(words(i % 37, i))) for i in range(700)]).repartition(7)
    rows = packing.pack_documents(many, tokenizer_path(), with_ids=True).collect()
    assert len(rows) == 700 and check_layout(rows, 2048, lambda r: r["sequence_id"]) == brute_bins([r["length"] for r in rows], 2048)
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_token_matrices(spark, hard, empty):
    import numpy as np
    out = token_matrix.write_matrices(hard.repartition(3), tokenizer_path(), block_ids=3000)
    rows = out.collect()
    check_pieces(rows, HARD)
    check_layout(rows, 2048, lambda r: (r["file"], r["row"]))
    for f in {r["file"] for r in rows}:
        matrix, cu, positions = token_matrix.read_block(f)
        mine = [r for r in rows if r["file"] == f]
        for r in mine:
            a, b = r["offset"], r["offset"] + r["length"]
            assert zlib.crc32(matrix[r["row"], a:b].astype("<u4").tobytes()) == r["ids_crc32"]
            assert a in cu[r["row"]] and b in cu[r["row"]] and positions[r["row"], a:b].tolist() == list(range(r["length"]))
        assert sum(len(c) - 1 for c in cu) == len(mine)
        assert not np.any(matrix[[r for r in range(len(cu))], [min(c[-1], 2047) for c in cu]] * [c[-1] < 2048 for c in cu])
    assert token_matrix.write_matrices(empty, tokenizer_path()).count() == 0


# -- 3 ----------------------------------------------------------------------------------------------

PAGES = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://ä b\r\nX: y", None), (4, "u", ""), (5, "u", "é" * 200000),
         (6, "u", "é" * 200000), (None, "u", "<p>x</p>"), (None, "u", "only without id"), (9, "u", "a\r\n\r\nb"), (2, "u", "<p>x</p>")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first_id string")


def test_warc_round_trip(spark):
    got = warc.warc_round_trip(pages(spark, PAGES)).collect()
    low = {}
    for i, _, h in PAGES:
        if i is not None:
            low[h or ""] = min(low.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        b, first = (h or "").encode(), low.get(h or "")
        revisit = first is not None and first != i
        want.append((i, len(b), warc.b32sha1(b), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.warc_round_trip(pages(spark, [])).count() == 0


def test_warc_payloads_rolling_and_threshold(spark):
    df = pages(spark, PAGES).repartition(2)
    listed = warc.write_archives(df, min_bytes=9, archive_bytes=500)
    assert listed.count() > 2 and listed.agg(F.sum("records")).first()[0] == len(PAGES)
    back = warc.read_archives(listed, with_payload=True).collect()
    assert sorted(r["payload_bytes"] for r in back) == sorted(len((h or "").encode()) for _, _, h in PAGES)
    assert sum(r["record_type"] == "revisit" for r in back) == 1
    for r in back:
        if r["record_type"] == "response":
            assert len(r["payload"]) == r["payload_bytes"] and warc.b32sha1(r["payload"]) == r["payload_digest"]


def test_warc_reader_finds_damage():
    import gzip
    import io
    good = warc.record(1, "u", b"hello")
    assert gzip.decompress(warc.member(good)) == good
    read = lambda *parts: list(warc.read_records(io.BytesIO(b"".join(parts)), True))
    m = warc.member(good)
    assert [r["payload"] for r in read(m, warc.member(warc.record(2, None, b"")))] == [b"hello", b""]
    for bad in (m[:-9], m[:30], warc.member(good.replace(b"hello", b"hellO")), warc.member(good + b"x"), warc.member(good[:-3]),
                warc.member(b"WARC/1.1\r\n"), m + b"junk", warc.member(good.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:X"))):
        with pytest.raises(warc.WarcError):
            read(bad)


# -- 5 ----------------------------------------------------------------------------------------------

def test_license_scan(spark, hard, empty):
    mit = licenses.KNOWN["MIT"]
    changed = "Copyright (c) 2020 Somebody\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " ;").replace("\n", "\n   * ")
    rows = [(1, mit), (2, changed), (3, mit + " extra"), (4, "prose\nReleased under the MIT Licence!\nmore\nreleased under the mit license"), (5, None)]
    got = {r["doc_id"]: r for r in licenses.license_scan(docs(spark, rows)).collect()}
    assert [got[i]["license_id"] for i in range(1, 6)] == ["MIT", "MIT", None, None, None]
    assert got[1]["text_digest"] == got[2]["text_digest"] == licenses.digests()["MIT"]
    assert (got[4]["n_notices"], got[4]["notice_ids"]) == (2, "MIT-notice") and got[5]["n_notices"] == 0
    assert licenses.license_scan(hard).count() == len(HARD) and licenses.license_scan(empty).count() == 0


def rewrapped(text, width):
    import textwrap
    if width is None:
        return " ".join(text.split())
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False) for p in text.split("\n\n"))


def test_license_scan_any_wrap(spark):
    """Known texts are found however their lines break; true notice lines don't count, prose about copyright does."""
    rows, want = [], {}
    for name, text in licenses.KNOWN.items():
        for width in (None, 20, 30, 40, 60, 72, 80, 100, 117):
            want[len(rows)] = name
            rows.append((len(rows), rewrapped(text, width)))
    mit = licenses.KNOWN["MIT"]
    for notice in ("Copyright (c) 2020 Jane Doe", "Copyright 2020-2024, Example Inc.", "(c) 2019 Jane Doe", "© Jane Doe", "Copyright Jane Doe",
                   "(C) Jane Doe and the Example Authors", "Copyright (c) <year> <owner>", "All rights reserved."):
        want[len(rows)] = "MIT"
        rows.append((len(rows), f"{notice}\n\n{mit}"))
    for prose in ("Copyright holders may object to this.", "(c) You must retain, in the Source form, all notices", "Copyright Holders", "All rights reserved by law"):
        want[len(rows)] = None
        rows.append((len(rows), f"{prose}\n\n{mit}"))
    rows += [(1000, "all copyright\nholders"), (1001, "all copyright owners"), (1002, "sub-\n * license"), (1003, "sublicense")]
    got = {r["doc_id"]: r for r in licenses.license_scan(docs(spark, rows)).collect()}
    assert {i: got[i]["license_id"] for i in want} == want
    assert got[1000]["text_digest"] == got[1001]["text_digest"] and got[1002]["text_digest"] == got[1003]["text_digest"]


DEBIAN = {"Apache-2.0-text": "Apache-2.0", "GPL-2.0-text": "GPL-2", "GPL-3.0-text": "GPL-3", "LGPL-2.1-text": "LGPL-2.1",
          "LGPL-3.0-text": "LGPL-3", "MPL-2.0-text": "MPL-2.0", "CC0-1.0-text": "CC0-1.0"}


def test_license_scan_whole_texts(spark):
    """The whole texts that Debian ships are in the table, and every digest stands for one text."""
    import os
    assert len(set(licenses.digests().values())) == len(licenses.digests())
    folder = "/usr/share/common-licenses"
    found = {k: f"{folder}/{f}" for k, f in DEBIAN.items() if os.path.exists(f"{folder}/{f}")}
    if not found:
        pytest.skip("no licence texts on this machine")
    rows = [(i, open(f, encoding="utf-8").read()) for i, f in enumerate(found.values())]
    rows.append((len(rows), licenses.KNOWN["BSD-3-Clause"].upper()))
    got = {r["doc_id"]: r["license_id"] for r in licenses.license_scan(docs(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == [*found, "BSD-3-Clause"]


# -- 9 ----------------------------------------------------------------------------------------------

def test_secret_scan(spark, hard, empty):
    rng = random.Random(8)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    caps = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    rows, secret = [], set()
    for i in range(600):
        kind = i % 6
        found = [f"AKIA{caps(16)}", f"password={hexa(18)}", f'token = "{hexa(40)}"', f"name{i}.{i % 90 + 10}@mail{i % 9}.example.com",
                 f"{rng.randint(10, 99)}.{rng.randint(100, 250)}.{rng.randint(10, 99)}.{rng.randint(100, 250)}", f"{rng.randint(4 * 10**15, 5 * 10**15 - 1)}"][kind]
        if kind < 3:
            secret.add(i)
        rows.append((i, " ".join(words(20, i)) + f" {found} " + " ".join(words(20, i + 1000)), f"src{i % 4}"))
    got = secrets.secret_findings(docs(spark, rows)).collect()
    assert len(got) == 600
    for r in got:
        assert r["is_secret"] == (r["doc_id"] in secret), r
        t = dict((a, b) for a, b, _ in rows)[r["doc_id"]]
        assert WORD.match(t[r["start"]:]) and r["length"] >= 8
    assert secrets.secret_findings(hard).count() == 0 and secrets.secret_findings(empty).count() == 0


def test_secret_candidates_without_digits(spark):
    """Published formats and values after a secret's name are candidates whatever their digits."""
    found = ["password=correcthorsebattery", "secret=Summer!Rain-Gate", "pwd: Grüne-Wiese", 'token = "AbcDefGhiJkl"', 'x={"api_key":"QwErTyUiOpAs"}',
             "Password :correcthorse", "access_key =\n  lowercaseonly", "ghp_" + "aBcDeF" * 6, "client_secret=Summer!Rain", "two passwords passwd=firstvalue pwd=secondvalue"]
    want = ["password=correcthorsebattery", "secret=Summer!Rain-Gate", "Grüne-Wiese", "AbcDefGhiJkl", 'x={"api_key":"QwErTyUiOpAs', ":correcthorse",
            "lowercaseonly", "ghp_" + "aBcDeF" * 6, "client_secret=Summer!Rain", None]
    other = ["the secret of tokenizers", "password", "token:", "secret passages everywhere", "pwd=short", None]
    df = docs(spark, [(i, f"some words {t} at the end" if t else t) for i, t in enumerate(found + other)] + [(100, "password="), (101, "correcthorse battery")])
    got = collections.defaultdict(list)
    for r in secrets.candidates(df, secrets.transitions(secrets.corpus_counts(df))).collect():
        got[r["doc_id"]].append(r["candidate"])
    assert {k: sorted(v) for k, v in got.items()} == {i: [w] if w else ["passwd=firstvalue", "pwd=secondvalue"] for i, w in enumerate(want)}


def test_secret_forest_generalises(spark):
    """Labels of one half of the documents; the other half's formats are found without their rule."""
    rng = random.Random(10)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, " ".join(words(15, i)) + (f' token = "{hexa(40)}" ' if i % 2 else f" {rng.randint(10**15, 10**16)} ") + "end", "s") for i in range(400)]
    df = docs(spark, rows)
    counts = secrets.corpus_counts(df)
    found = secrets.candidates(df, secrets.transitions(counts)).withColumn("label", (F.col("doc_id") % 2).cast("int"))
    model = secrets.train(found.filter("doc_id < 200"))
    out = secrets.scored(found.filter("doc_id >= 200"), model)
    assert out.filter("(score >= 0.5) <> (label = 1)").count() <= 2
