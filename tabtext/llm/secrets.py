"""Secret scan with a random forest that removes false positives (operator 9).

Candidates are words of 8 characters or more with two digits or more, or with 12 capitals or more and no small letter,
words of 16 or more that change between small letters and capitals four times or more,
and, whatever their digits, words of 8 or more that match a published credential format or follow a secret's name with = or :
(found vectorised in whole texts, quotes and punctuation around them stripped).  Their features: length, shares and
transitions of character classes, entropy, how surprising their neighbouring characters are in the corpus's words, how much of
them dictionary words cover, the path (``source``) they come from, and hashes of the neighbouring words.  The dictionary and
the character transitions are counted over all documents; the dictionary holds every word that occurs at least twice and in
at least one of ``DICTIONARY_RATE`` words, and the candidates' parts are looked up in it by a join, without a bound on its size.

A random forest is trained on labelled findings (``label`` 1 secret, 0 harmless).  ``rule_labels`` labels findings
by strict published formats; findings that no rule decides are only scored.  At most ``TRAIN_ROWS`` labelled
findings are used, a seeded sample whose size is a parameter; everything else covers all rows.

Defined cases: a null or empty text has no candidate; repeated rows give repeated findings; a null id stays null; a
null path is a path of its own; further columns are ignored; without labelled findings of both kinds every score is
the smoothed share of secrets among them; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import attach, in_tasks, written

MIN_LENGTH, MIN_DIGITS, MIN_CAPITALS = 8, 2, 12
#: A word of letters is a candidate if it is that long and changes between small letters and capitals that often.
MIXED_LENGTH, MIN_CHANGES = 16, 4
#: A word belongs to the dictionary if it occurs twice at least, and once in so many words of the corpus.
DICTIONARY_RATE, DICTIONARY_COUNT = 1_000_000, 2
TRAIN_ROWS = 20_000
SEED = 5
TREES, DEPTH = 40, 8
THRESHOLD = 0.5
DIGIT, CAPITAL, SMALL = ts.lut(b"0123456789"), ts.lut(bytes(range(65, 91))), ts.lut(bytes(range(97, 123)))
STRIP = "\"'`()[]{}<>,;.!?"
CONTEXT_BUCKETS = 32

# Published formats of credentials, and of harmless strings with many digits.
SECRET_FORMATS = (r"AKIA[0-9A-Z]{16}", r"(?:password|passwd|pwd|secret)[=:]\S{8,}", r"gh[pousr]_[0-9A-Za-z]{36,}",
                  r"xox[abprs]-[0-9A-Za-z-]{10,}", r"eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}", r"AIza[0-9A-Za-z_-]{35}",
                  r"sk_live_[0-9A-Za-z]{16,}")
SECRET_NAMES = r"(?:token|secret|apikey|api_key|access_key|password)"
# Where such a word may be: the formats' openings and the names; then the name with what follows it in its word.
HINT = re.compile(rb"AKIA|gh[pousr]_|xox[abprs]-|eyJ|AIza|sk_live_|(?i:password|passwd|pwd|secret|token|api_?key|access_key)")
NAMED = re.compile(rb"(?i)(?:password|passwd|pwd|secret|token|api_?key|access_key)[\"'`\])}]*(?:[=:]+(.*))?$", re.S)
FORMATS = [re.compile(p) for p in SECRET_FORMATS]
HEX_SECRET = r"[0-9a-f]{32,64}"
HARMLESS_FORMATS = (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"\d{1,3}(?:\.\d{1,3}){3}", r"\+?[\d()./-]*(?:\d[()./-]?){7,18}",
                    r"https?://\S+", r"\d{4}-\d{2}-\d{2}\S*")

KINDS = ("lower", "upper", "digit", "other")
NUMBERS = (["length", "entropy", "surprise", "covered", "runs", "alternations", "has_equals", "quoted", "path"]
           + [f"share_{k}" for k in KINDS] + [f"before{i}" for i in range(CONTEXT_BUCKETS)]
           + [f"after{i}" for i in range(CONTEXT_BUCKETS)])


def _fold(data: np.ndarray) -> np.ndarray:
    up = (data >= 65) & (data <= 90)
    return np.where(up, data + 32, data).astype(np.uint8)


def corpus_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``kind, code, n`` over all documents: how often each folded word (kind 0, code = hash) and each pair of
    neighbouring folded bytes inside a word (kind 1, code = pair) occurs."""
    narrow = docs.select(F.col(f"`{text}`").cast("string").alias("text"))

    def task(batches):
        for batch in batches:
            pairs, hashes = np.zeros(65536, np.int64), []
            for _, data, offs in ts.text_runs(batch.column("text")):
                starts, ends, _ = ts.words(data, offs)
                hashes.append(ts.span_hashes(data, starts, ends, ts.FOLDED))
                f = _fold(data).astype(np.uint16)
                inside = ts.IS_WORD[data]
                both = inside[:-1] & inside[1:]
                both[offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))] - 1] = False  # two documents
                p = (f[:-1] << 8 | f[1:])[both]
                pairs += np.bincount(p, minlength=65536)
            if not hashes:
                continue
            h, n = np.unique(np.concatenate(hashes), return_counts=True)
            at = np.flatnonzero(pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(len(h), np.int32), np.ones(len(at), np.int32)])),
                 pa.array(np.concatenate([h.view(np.int64), at])), pa.array(np.concatenate([n, pairs[at]]))],
                names=["kind", "code", "n"])

    return in_tasks(narrow, task, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def transitions(counts: DataFrame) -> np.ndarray:
    """Log probability of a byte given the one before: at most 65,536 byte pairs."""
    pairs = np.ones((256, 256))
    for r in counts.filter("kind = 1").collect():
        pairs[r["code"] >> 8, r["code"] & 255] += r["n"]
    return np.log2(pairs / pairs.sum(axis=1, keepdims=True))


def covered(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``found`` (a written table with ``parts``) with the share of each candidate that the dictionary covers in ``x``.

    The dictionary is the count table itself, and the candidates' parts are looked up in it by a join."""
    parts = found.select("row", "size", F.explode("parts").alias("part")).select("row", "size", "part.code", "part.bytes")
    need = parts.groupBy("code").agg(F.count(F.lit(1)).alias("rows"))
    words = counts.filter("kind = 0")
    total = words.agg(F.sum("n")).first()[0] or 0
    known = words.filter((F.col("n") >= DICTIONARY_COUNT) & (F.col("n") * DICTIONARY_RATE >= total)).select("code")
    known = written(need.join(known, "code"), "secret-dictionary")
    share = (attach(parts, known, "code", "rows", parts.count(), how="inner").groupBy("row")
             .agg((F.sum("bytes") / F.first("size")).alias("covered")))
    at = NUMBERS.index("covered")
    x = F.transform("x", lambda v, i: F.when(i == at, F.coalesce("covered", F.lit(0.0))).otherwise(v))
    return found.join(share, "row", "left").withColumn("x", x).drop("row", "size", "parts", "covered")


def _hash(b: bytes) -> int:
    a = np.frombuffer(b, np.uint8)
    return int(ts.span_hashes(a, np.array([0]), np.array([len(a)]), ts.FOLDED).view(np.int64)[0]) if len(a) else 0


def _parts(word: bytes) -> list[tuple[int, int]]:
    """(hash, bytes) of the runs of small letters of the folded word."""
    return [(_hash(x), len(x)) for x in re.findall(rb"[a-z\x80-\xff]{3,}", _fold(np.frombuffer(word, np.uint8)).tobytes())]


def _features(word: bytes, raw: bytes, before: bytes, after: bytes, path: str | None, logp: np.ndarray) -> list[float]:
    """The numbers of ``NUMBERS`` but for ``covered``, which is 0 here."""
    a = np.frombuffer(word, np.uint8)
    kind = np.where((a >= 97) & (a <= 122), 0, np.where((a >= 65) & (a <= 90), 1, np.where((a >= 48) & (a <= 57), 2, 3)))
    counts = np.bincount(a)
    p = counts[counts > 0] / len(a)
    folded = _fold(a)
    surprise = -float(logp[folded[:-1], folded[1:]].mean()) if len(a) > 1 else 0.0
    runs = 1 + int((kind[1:] != kind[:-1]).sum())
    mixed = int(((kind[1:] == 2) != (kind[:-1] == 2)).sum())
    near = [[0.0] * CONTEXT_BUCKETS, [0.0] * CONTEXT_BUCKETS]
    for slot, text in zip(near, (before, after)):
        for w in text.split()[-3 if slot is near[0] else 0:][:3]:
            slot[_hash(w) % CONTEXT_BUCKETS] = 1.0
    place = _hash((path or "").encode()) % 64 if path is not None else -1
    return [float(len(a)), float(-(p * np.log2(p)).sum()), surprise, 0.0, runs / len(a), mixed / len(a),
            float(b"=" in word), float(raw[:1] in (b'"', b"'")), float(place),
            *(float((kind == k).mean()) for k in range(4)), *near[0], *near[1]]


def _inside(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How many bytes of the table each word has."""
    at = np.flatnonzero(table[data])
    return np.searchsorted(at, ends) - np.searchsorted(at, starts)


def _named(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words match a published format, hold a secret's name with = or : and a value, or are the value after one."""
    out, raw = np.zeros(len(starts), bool), data.tobytes()
    at = np.fromiter((m.start() for m in HINT.finditer(raw)), np.int64)
    hinted = np.unique(np.searchsorted(starts, at, "right") - 1) if len(at) else at
    strip = STRIP.encode()
    for k in hinted[hinted >= 0].tolist():
        word = raw[starts[k]:ends[k]]
        bare = word.strip(strip)
        if any(p.fullmatch(bare.decode("utf-8", "replace")) for p in FORMATS):
            out[k] = True
        m = NAMED.search(word)
        if not m:
            continue
        value, sign = m[1], m[1] is not None
        if value and value.strip(strip):
            out[k] |= len(value.strip(strip)) >= MIN_LENGTH
            continue
        k += 1
        if not sign and k < len(starts) and doc[k] == doc[k - 1]:  # the sign opens the next word or is all of it
            word = raw[starts[k]:ends[k]]
            sign = word[:1] in (b"=", b":")
            if sign and word.strip(b"=:"):
                out[k] = True
                continue
            k += 1
        if sign and k < len(starts) and doc[k] == doc[k - 1]:
            out[k] = True
    return out


def _changes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often each word changes between small letters and capitals."""
    small, capital = SMALL[data], CAPITAL[data]
    at = np.flatnonzero(small[:-1] & capital[1:] | capital[:-1] & small[1:])
    return np.searchsorted(at, ends - 1) - np.searchsorted(at, starts)


def candidates(docs: DataFrame, logp: np.ndarray, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """``doc_id, start, candidate, before, x, parts, size``: every candidate with its byte offset, its features without the
    dictionary's, and what is to be looked up for it."""
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
                         F.col(f"`{path}`").cast("string").alias("path"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def task(batches):
        for batch in batches:
            rows, out = [], []
            paths = batch.column("path")
            for first, data, offs in ts.text_runs(batch.column("text")):
                starts, ends, wb = ts.words(data, offs)
                many = (_inside(data, starts, ends, DIGIT) >= MIN_DIGITS) | (
                    _inside(data, starts, ends, CAPITAL) >= MIN_CAPITALS) & (_inside(data, starts, ends, SMALL) == 0)
                doc = ts.doc_of(wb)
                many |= _named(data, starts, ends, doc)
                many |= (ends - starts >= MIXED_LENGTH) & (_changes(data, starts, ends) >= MIN_CHANGES)
                for k in np.flatnonzero(many & (ends - starts >= MIN_LENGTH)):
                    raw = data[starts[k]:ends[k]].tobytes()
                    word = raw.strip(STRIP.encode())
                    if len(word) < MIN_LENGTH:
                        continue
                    d = doc[k]
                    lo, hi = max(k - 3, wb[d]), min(k + 3, wb[d + 1] - 1)
                    before = data[starts[lo]:starts[k]].tobytes()
                    after = data[ends[k]:ends[hi]].tobytes()
                    rows.append(first + d)
                    out.append((int(starts[k] - offs[d]) + raw.index(word), word.decode("utf-8", "replace"),
                                before.decode("utf-8", "replace"),
                                _features(word, raw, before, after, paths[first + int(d)].as_py(), logp), _parts(word), len(word)))
            if rows:
                start, word, before, x, parts, size = zip(*out)
                parts = pa.array([[{"code": c, "bytes": n} for c, n in p] for p in parts], PARTS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), pa.array(start, pa.int64()), pa.array(word), pa.array(before),
                     pa.array(x, pa.list_(pa.float64())), parts, pa.array(size, pa.int64())],
                    names=["doc_id", "start", "candidate", "before", "x", "parts", "size"])

    return in_tasks(narrow, task, f"doc_id {id_type}, start long, candidate string, before string, x array<double>, "
                                  "parts array<struct<code:long,bytes:long>>, size long")


PARTS = pa.list_(pa.struct([("code", pa.int64()), ("bytes", pa.int64())]))


def rule_labels() -> Column:
    """1 for a published credential format, 0 for a harmless one, null where no strict rule decides."""
    c = F.col("candidate")
    full = lambda p: c.rlike(f"^(?:{p})$")
    secret = F.lit(False)
    for p in SECRET_FORMATS:
        secret = secret | full(p)
    secret = secret | full(HEX_SECRET) & F.col("before").rlike(f"(?i){SECRET_NAMES}\\s*[=:]\\s*$")
    harmless = F.lit(False)
    for p in HARMLESS_FORMATS:
        harmless = harmless | full(p)
    return F.when(secret, F.lit(1)).when(harmless, F.lit(0))


def train(findings: DataFrame, rows: int = TRAIN_ROWS, seed: int = SEED):
    """A forest fitted on findings (``x``, ``label``), or the smoothed share of label 1 if one label is missing."""
    n = {r["label"]: r["count"] for r in findings.filter("label in (0, 1)").groupBy("label").count().collect()}
    if len(n) < 2:
        return (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    part = {k: min(1.0, rows / 2 / v) for k, v in n.items()}
    sample = findings.filter("label in (0, 1)").sampleBy("label", part, seed)
    weight = F.when(F.col("label") == 1, 1.0 / n[1] / part[1]).otherwise(1.0 / n[0] / part[0]) * float(min(n.values()))
    cols = [F.col("x")[i].alias(name) for i, name in enumerate(NUMBERS)]
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="w", numTrees=TREES, maxDepth=DEPTH,
                                    seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(NUMBERS), outputCol="features"), forest]).fit(
        sample.select("label", weight.alias("w"), *cols))


def scored(findings: DataFrame, model) -> DataFrame:
    """The findings with ``score``."""
    if isinstance(model, float):
        return findings.withColumn("score", F.lit(model))
    out = model.transform(findings.select("*", *[F.col("x")[i].alias(n) for i, n in enumerate(NUMBERS)]))
    return out.withColumn("score", vector_to_array("probability")[1]).select(*findings.columns, "score")


def secret_findings(docs: DataFrame, labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text",
                    path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: ``doc_id, start, length, rule, score, is_secret`` and the masked text.

    ``labelled``: findings with ``x`` and ``label`` from elsewhere; by default the strict rules label those of ``docs``."""
    counts = written(corpus_counts(docs, text), "secret-counts")
    found = candidates(docs, transitions(counts), doc_id, text, path).withColumns({
        "label": rule_labels(), "row": F.monotonically_increasing_id()})
    found = written(covered(written(found, "secret-found"), counts), "secret-candidates")
    model = train(labelled if labelled is not None else found)
    return scored(found, model).select(
        "doc_id", "start", F.length("candidate").cast("long").alias("length"), F.col("label").alias("rule"),
        F.concat(F.substring("candidate", 1, 4), F.lit("..."), F.substring(F.sha2("candidate", 256), 1, 12)).alias("masked"),
        "score", (F.col("score") >= threshold).alias("is_secret"))
