"""Quality classifier: regularised quadratic discriminant (operator 4).

A vectorised scan turns every whole text into transformed document statistics
(written once as a narrow table).  Per class, Spark sums the statistics and
their products over *all* labelled training rows; the driver sees two rows of
sums.  Each class covariance is shrunk towards the pooled one and towards its
diagonal, factored once (Cholesky), and a document's score is the logistic of
the difference of the two log densities, ``log N(x; m1, S1) - log N(x; m0,
S0)``, whose Mahalanobis terms are triangular solves with the cached factors.

Inputs of a score are the text's statistics only: never labels, language,
source or id.

Defined cases: a null text counts as empty (all statistics 0, scored like any
other); rows without a label are scored and not learned from; null labels and
labels other than 0 and 1 are not learned from; a document with several label
rows counts once for each; repeated documents are scored one by one; if either class
has fewer than two training rows, every score is the smoothed share of class 1;
a null id is never held out; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import in_tasks, own_names, plain_names, written
from .quality_rules import LOWER, SHOUT, UPPER, Run

DIGITS = ts.lut(b"0123456789")
STOPS = ts.lut(b".?")
COMMAS = ts.lut(b",;:")

FEATURES = ("log_words", "word_length", "symbols", "upper", "shout", "digits", "stops", "commas", "repeat_words",
            "dup_lines", "words_per_line", "old_words", "neighbours")

#: Weight of the pooled covariance in each class covariance, then of the diagonal.
POOL, DIAGONAL = 0.5, 0.1
#: Added to every variance: statistics that never vary in a class stay finite.
RIDGE = 1e-2
#: Log densities of correlated statistics are over-sure; the difference is divided by this before the logistic.
TEMPERATURE = 4.0
THRESHOLD = 0.7


def statistics(r: Run) -> np.ndarray:
    """Transformed statistics, a row per document of the run."""
    n = np.maximum(r.n_words, 1).astype(float)
    lines = np.maximum(r.n_lines, 1)
    doc = ts.doc_of(r.wb)
    count = lambda t: ts.count_bytes(r.data, r.offs, t)
    up, low = count(UPPER), count(LOWER)
    folded = ts.span_hashes(r.data, r.starts, r.ends, ts.FOLDED)
    _, later = ts.repeated(folded ^ ts.mix(doc.astype(np.uint64) + np.uint64(1)))
    near = np.flatnonzero((folded[1:] == folded[:-1]) & (doc[1:] == doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    rate = lambda c: np.log1p(10.0 * c / n)
    share = lambda a, b: np.sqrt(a / np.maximum(b, 1))
    return np.stack([
        np.log1p(r.n_words),
        np.log1p(r.word_chars / n),
        rate(r.n_symbols),
        share(up, up + low),
        rate(count(SHOUT)),
        rate(count(DIGITS)),
        rate(count(STOPS)),
        rate(count(COMMAS)),
        share(r.n_repeat_words, r.n_words),
        share(r.n_dup_lines, r.n_lines),
        np.log1p(n / lines),
        np.bincount(doc[later], minlength=r.n) / n,
        share(np.bincount(doc[near], minlength=r.n), r.n_words),
    ], axis=1)


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` with the array ``x`` of transformed statistics."""
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def task(batches):
        for batch in batches:
            for first, data, offs in ts.text_runs(batch.column("text")):
                x = statistics(Run(data, offs))
                ends = pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(x)), pa.ListArray.from_arrays(ends, pa.array(x.ravel(), pa.float64()))],
                    names=["doc_id", "x"])

    return in_tasks(narrow, task, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Log prior odds; per class its mean, the inverse Cholesky factor and half the log determinant of its covariance."""

    odds: float
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    half_logdet: tuple[float, float] = (0.0, 0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), 1.0 / (1.0 + np.exp(-self.odds)))
        d = [0.5 * np.square((x - m) @ f.T).sum(axis=1) + h
             for m, f, h in zip(self.means, self.factors, self.half_logdet)]
        z = (d[0] - d[1] + self.odds) / TEMPERATURE
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit(train: DataFrame, label: str = "label", pool: float = POOL, diagonal: float = DIAGONAL,
        ridge: float = RIDGE) -> Discriminant:
    """Fit on rows (``x``, ``label`` 0 or 1): one aggregation, two rows of sums to the driver."""
    d = len(FEATURES)
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = {r["y"]: r for r in train.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("y"))
            .agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}
    n = [rows[y]["n"] if y in rows else 0 for y in (0, 1)]
    odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if min(n) < 2:
        return Discriminant(odds)
    means, scatter = [], []
    for y in (0, 1):
        m = np.array([rows[y][f"s{i}"] for i in range(d)]) / n[y]
        p = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                p[i, j] = p[j, i] = rows[y][f"p{i}_{j}"]
        means.append(m)
        scatter.append(p - n[y] * np.outer(m, m))
    pooled = (scatter[0] + scatter[1]) / sum(n)
    factors, half = [], []
    for y in (0, 1):
        s = (1 - pool) * scatter[y] / n[y] + pool * pooled
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + ridge * np.eye(d)
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        half.append(float(np.log(np.diag(low)).sum()))
    return Discriminant(odds, tuple(means), tuple(factors), tuple(half))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Discriminant]:
    """The written statistics of all documents, and the discriminant fitted on the labelled ones not held out."""
    table = written(document_statistics(docs, doc_id, text), "qda-statistics")
    marks = labels.select("doc_id", F.col("quality").alias("label")).filter("doc_id is not null")
    return table, fit(table.filter(~held_out()).join(marks, "doc_id"))


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``; learned from the labelled rows not held out."""
    table, model = learned(docs, labels, doc_id, text)

    def task(batches):
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s),
                                              pa.array(s >= threshold).cast(pa.int32())],
                                             names=["doc_id", "held_out", "score", "predicted"])

    id_type = table.schema["doc_id"].dataType.simpleString()
    return in_tasks(
        table.withColumn("held_out", held_out()).select("doc_id", "held_out", "x"), task,
        f"doc_id {id_type}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns.  The second scan judges every row by its
    own text, so no text is shuffled and rows without an id are judged as well."""
    _, model = learned(docs, labels, doc_id, text)
    inner, at = plain_names(docs)

    def task(batches):
        for batch in batches:
            for first, data, offs in ts.text_runs(batch.column("__text")):
                ok = model.score(statistics(Run(data, offs))) >= threshold
                yield batch.slice(first, len(ok)).select(list(at.values())).filter(pa.array(ok))

    return own_names(in_tasks(inner.withColumn("__text", F.col(at[text]).cast("string")), task, inner.schema), at)
