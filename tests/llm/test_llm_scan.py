"""The vectorised scans equal plain Python on the same texts."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tabtext.llm import textscan as ts
from tabtext.llm.quality_rules import RULES, Run, cascade_order, survivors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALPHABET = st.sampled_from(["a", "B", "é", " ", "  ", "\n", "\t", "#", "ab", "\x85", " ", "€", "1", "!"])
TEXT = st.one_of(st.none(), st.lists(ALPHABET, max_size=60).map("".join))


def runs(texts, limit=1 << 20):
    return list(ts.text_runs(pa.array(texts, pa.string()), limit))


def brute(text, k=8):
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    covered = {j for i in range(len(w) - k + 1) if seen[tuple(w[i:i + k])] > 1 for j in range(i, i + k)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=8), st.sampled_from([1, 16, 1 << 20]))
def test_base_statistics(texts, limit):
    got = []
    for _, data, offs in runs(texts, limit):
        r = Run(data, offs)
        got += list(zip(*(x.tolist() for x in (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words))))
    assert got == [brute(t or "") for t in texts]


def test_repeat_windows():
    w = [f"w{i}" for i in range(30)]
    texts = [" ".join(w + w[3:14] + w), " ".join(w[:8] * 2), " ".join(w[:7] * 2), " ".join(["x"] * 40), ""]
    (_, data, offs), = runs(texts)
    assert Run(data, offs).n_repeat_words.tolist() == [brute(t)[4] for t in texts]


def test_hash_depends_on_bytes_only():
    (_, data, offs), = runs(["Abc abC é abc", "zz abc"])
    s, e, wb = ts.words(data, offs)
    exact, folded = ts.span_hashes(data, s, e), ts.span_hashes(data, s, e, ts.FOLDED)
    assert len(set(exact.tolist())) == 5 and exact[3] == exact[5]
    assert folded[0] == folded[1] == folded[3] == folded[5] and folded[2] != folded[0]
    assert wb.tolist() == [0, 4, 6]


def test_sliced_columns():
    a = pa.array(["one two", None, "three", "four five six", ""]).slice(1, 3)
    assert [np.diff(ts.words(d, o)[2]).tolist() for _, d, o in ts.text_runs(a)] == [[0, 1, 3]]


def test_cascade_gives_the_same_verdict_in_any_order():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "a|b", "X!!", "word", "###", "longer"]) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    (_, data, offs), = runs(texts)
    rules = list(RULES)
    want = np.flatnonzero(~np.any([r.rejects(Run(data, offs)) for r in rules], axis=0)).tolist()
    for _ in range(5):
        rng.shuffle(rules)
        assert survivors(Run(data, offs), rules).tolist() == want


def test_part_of_a_run_equals_a_run_of_its_documents():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "é ", "B|", " ", "\n", "ab ", "!"]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    (_, data, offs), = runs(texts)
    for keep in ([], [0], [3, 4, 9, 39], list(range(40))):
        part = Run(data, offs).rows(np.arange(40)).rows(np.array(keep, np.int64))
        got = runs([texts[i] for i in keep])
        want = Run(*got[0][1:]) if got else Run(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        for name in ("data", "offs", "wb", "starts", "ends", "hashes", "n_words", "word_chars", "n_lines", "n_symbols", "n_dup_lines",
                     "n_repeat_words"):
            assert getattr(part, name).tolist() == getattr(want, name).tolist(), (name, keep)


def test_cascade_scans_less_than_all_rules(monkeypatch):
    texts = ["word " * 30 + str(i) if i % 4 else " ".join(f"{i}w{k}" for k in range(40)) for i in range(200)]
    (_, data, offs), = runs(texts)
    scanned = []
    plain = ts.count_bytes
    monkeypatch.setattr(ts, "count_bytes", lambda d, *a: scanned.append(len(d)) or plain(d, *a))
    work = {}
    for name in ("all", "cascade"):
        run = Run(data, offs)
        run.base()
        scanned.clear()
        if name == "all":
            kept = np.flatnonzero(~np.any([r.rejects(run) for r in RULES], axis=0))
        else:
            assert survivors(run, RULES).tolist() == kept.tolist() and len(kept) == 50
        work[name] = sum(scanned)
    assert work["cascade"] * 2 < work["all"], work


def test_cascade_order_is_rejection_per_cost():
    assert cascade_order([("a", 1.0, 0.1), ("b", 0.1, 0.1), ("c", 1.0, 0.5), ("d", 1.0, 0.0)]) == ["b", "c", "a", "d"]
