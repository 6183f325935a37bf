"""Quality rules as a short-circuit cascade (operator 6).

Base statistics of every whole text come from one vectorised scan.  The rules
are then run as a cascade: each rule's cost (seconds per row, beyond the base
statistics) and selectivity (share of rows it rejects) are measured on a bounded,
seeded sample, the rules are ordered by rejection per cost, and in the full pass a
rule only sees the rows that every rule before it let through, and scans only
their bytes.  A row is kept when no rule rejects it, so the order changes the work
and never the verdict.

Defined cases: a null or empty text has no words and all counts 0, fails the
base rule and is dropped; repeated rows are judged one by one; a null id is
kept as null; further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import in_tasks

SYMBOLS = ts.lut(b"#*$%&|<>")
UPPER = ts.lut(bytes(range(65, 91)))
LOWER = ts.lut(bytes(range(97, 123)))
SHOUT = ts.lut(b"!")

MIN_WORDS = 20
MAX_REPEAT_PCT = 30
#: At most about this many rows measure cost and selectivity of the rules.
SAMPLE_ROWS = 2000
SEED = 17


class Run:
    """A run of whole texts with the scans the rules share, each computed when first asked for."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n = data, offs, len(offs) - 1
        self.starts, self.ends, self.wb = ts.words(data, offs)
        self._memo: dict[str, np.ndarray] = {}

    def _once(self, name: str, make: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self._memo:
            self._memo[name] = make()
        return self._memo[name]

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.wb)

    @property
    def hashes(self) -> np.ndarray:
        return self._once("hashes", lambda: ts.span_hashes(self.data, self.starts, self.ends))

    @property
    def word_chars(self) -> np.ndarray:
        def make():
            size = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
            return np.diff(size[self.wb]) - ts.count_bytes(self.data, self.offs, ts.CONTINUATION)
        return self._once("word_chars", make)

    @property
    def lines(self):
        return self._once("lines", lambda: ts.lines(self.data, self.offs, self.starts))

    @property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=self.n)

    @property
    def n_symbols(self) -> np.ndarray:
        return self._once("symbols", lambda: ts.count_bytes(self.data, self.offs, SYMBOLS))

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._once("dup", lambda: ts.dup_lines(self.data, *self.lines, self.n))

    @property
    def n_repeat_words(self) -> np.ndarray:
        return self._once("repeat", lambda: ts.repeat_words(self.hashes, self.wb))

    def base(self) -> list[np.ndarray]:
        """The statistics that every row returns, rejected or not."""
        return [self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words]

    def rows(self, keep: np.ndarray) -> Part:
        """The chosen documents only."""
        return Part(self, keep)


class Part(Run):
    """Some documents of a run, without scanning them again: counts and word hashes are slices of the run's, and bytes
    are copied only when a rule asks for them."""

    def __init__(self, whole: Run, keep: np.ndarray):
        self.whole, self.keep, self.n = whole, keep, len(keep)
        self._memo = {}

    def rows(self, keep: np.ndarray) -> Part:
        return Part(self.whole, self.keep[keep])

    @property
    def data(self) -> np.ndarray:
        def make():
            w = self.whole
            if self.n == w.n:
                return w.data
            parts = [w.data[a:b] for a, b in zip(w.offs[self.keep], w.offs[self.keep + 1])]
            return np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return self._once("data", make)

    @property
    def offs(self) -> np.ndarray:
        return self._once("offs", lambda: _bounds(np.diff(self.whole.offs)[self.keep]))

    @property
    def wb(self) -> np.ndarray:
        return self._once("wb", lambda: _bounds(self.n_words))

    @property
    def starts(self) -> np.ndarray:
        return self._once("spans", lambda: ts.words(self.data, self.offs))[0]

    @property
    def ends(self) -> np.ndarray:
        return self._once("spans", lambda: ts.words(self.data, self.offs))[1]

    @property
    def n_words(self) -> np.ndarray:
        return self._once("n_words", lambda: self.whole.n_words[self.keep])

    @property
    def hashes(self) -> np.ndarray:
        def make():
            inside = np.zeros(self.whole.n, bool)
            inside[self.keep] = True
            return self.whole.hashes[np.repeat(inside, self.whole.n_words)]
        return self._once("hashes", make)

    @property
    def word_chars(self) -> np.ndarray:
        return self.whole.word_chars[self.keep]

    @property
    def n_lines(self) -> np.ndarray:
        return self.whole.n_lines[self.keep]

    @property
    def n_symbols(self) -> np.ndarray:
        return self.whole.n_symbols[self.keep]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self.whole.n_dup_lines[self.keep]

    @property
    def n_repeat_words(self) -> np.ndarray:
        return self.whole.n_repeat_words[self.keep]


def _bounds(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)])


@dataclass(frozen=True)
class Rule:
    """``rejects(run)`` gives a boolean per document of the run."""

    name: str
    rejects: Callable[[Run], np.ndarray]


def _base(r: Run) -> np.ndarray:
    return (r.n_words < MIN_WORDS) | (100 * r.n_repeat_words > MAX_REPEAT_PCT * r.n_words)


def _adjacent_repeats(r: Run) -> np.ndarray:
    """More than a fifth of the words equal the word before them."""
    doc = ts.doc_of(r.wb)
    at = np.flatnonzero((r.hashes[1:] == r.hashes[:-1]) & (doc[1:] == doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    return 5 * np.bincount(doc[at], minlength=r.n) > r.n_words


def _mean_word(r: Run) -> np.ndarray:
    """Words of less than 2 or more than 25 characters on average."""
    return (r.word_chars < 2 * r.n_words) | (r.word_chars > 25 * r.n_words)


def _shouting(r: Run) -> np.ndarray:
    """More upper-case than twice the lower-case ASCII letters, or an exclamation mark for every fourth word."""
    up, low = (ts.count_bytes(r.data, r.offs, t) for t in (UPPER, LOWER))
    return (up > 2 * low) & (up > r.n_words) | (4 * ts.count_bytes(r.data, r.offs, SHOUT) > r.n_words)


RULES: tuple[Rule, ...] = (
    Rule("base", _base),
    Rule("symbols", lambda r: 10 * r.n_symbols > r.n_words),
    Rule("dup_lines", lambda r: 2 * r.n_dup_lines > r.n_lines),
    Rule("adjacent_repeats", _adjacent_repeats),
    Rule("mean_word", _mean_word),
    Rule("shouting", _shouting),
)


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, int, Run]]:
    for batch in batches:
        for first, data, offs in ts.text_runs(batch.column(column)):
            yield batch, first, Run(data, offs)


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS,
            seed: int = SEED) -> list[tuple[str, float, float]]:
    """(rule, seconds per row, share rejected) over a seeded sample of about ``rows`` rows, each rule alone.  The base
    statistics are made before: every row returns them, so a rule costs what it does beyond them."""
    total = docs.count()
    part = docs.select(text) if total <= rows else docs.select(text).sample(rows / total, seed)

    def task(batches):
        cost, hits, seen = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for _, _, run in _runs(batches, text):
            seen += run.n
            run.base()
            for k, rule in enumerate(rules):
                fresh = run.rows(np.arange(run.n))
                t = time.perf_counter()
                hits[k] += int(rule.rejects(fresh).sum())
                cost[k] += time.perf_counter() - t
        yield pa.RecordBatch.from_pydict({"k": list(range(len(rules))), "s": cost.tolist(), "hits": hits.tolist(),
                                          "n": [seen] * len(rules)},
                                         schema=pa.schema([("k", pa.int32()), ("s", pa.float64()),
                                                           ("hits", pa.int64()), ("n", pa.int64())]))

    got = (in_tasks(part, task, "k int, s double, hits long, n long").groupBy("k")
           .agg(F.sum("s").alias("s"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect())
    by = {r["k"]: r for r in got}
    return [(r.name, by[k]["s"] / max(1, by[k]["n"]), by[k]["hits"] / max(1, by[k]["n"])) if k in by
            else (r.name, 0.0, 0.0) for k, r in enumerate(rules)]


def cascade_order(measured: Sequence[tuple[str, float, float]]) -> list[str]:
    """Rules by rejection per cost, the best first; ties by name."""
    return [name for name, _, _ in sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-12), m[0]))]


def survivors(run: Run, rules: Sequence[Rule]) -> np.ndarray:
    """Document numbers of the run that no rule rejects; each rule sees the rows left by those before."""
    left, sub = np.arange(run.n), run
    for rule in rules:
        if not len(left):
            break
        ok = ~rule.rejects(sub)
        if not ok.all():
            left, sub = left[ok], sub.rows(np.flatnonzero(ok))
    return left


SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean")
ARROW = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
         ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES,
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: its id, the base statistics and the verdict of the cascade."""
    order = cascade_order(measure(docs, rules, text, sample_rows))
    by = {r.name: r for r in rules}
    ordered = [by[n] for n in order]
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def task(batches):
        for batch, first, run in _runs(batches, "text"):
            base = run.base()
            kept = np.zeros(run.n, bool)
            kept[survivors(run, ordered)] = True
            cols = [*base, _base(run), kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, run.n), *(pa.array(c, t) for c, (_, t) in zip(cols, ARROW))],
                names=["doc_id", *(n for n, _ in ARROW)])

    return in_tasks(narrow, task, f"doc_id {id_type}, {SCHEMA}")
