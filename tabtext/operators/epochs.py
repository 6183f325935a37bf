"""A text head trained by epochs (MOD-15, MOD-16): hashed n-gram embeddings, mini-batches, best epoch kept.

A text is the mean of the embeddings of its words and word pairs, hashed into ``buckets`` rows, and a linear layer gives
class scores (softmax) or one value (squared error).  A step is one Spark job over one mini-batch: every task sums
the gradients of its rows, Spark adds them up per bucket, and the driver, which holds the parameters (buckets x dim,
whatever the number of rows), applies Adam at a rate that rises over the first tenth of the steps and then falls to zero.
After each epoch the validation rows are scored by a Spark job, and the parameters of the best epoch stay.

Mini-batches are a hash partitioning of the rows, written once as folders, so a step reads its own rows only.  Gradients
are added as whole numbers of ``1 / UNIT``: sums do not depend on the order of tasks, and a fit repeats exactly.

Defined cases: a null or empty text has no embedding and is scored by the bias; rows without a label are not trained on;
equal rows share a mini-batch; a table without training rows is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import scratch_path
from .features import term_tasks

UNIT = 1 << 32
#: Ids whose embeddings are gathered at once inside a task.
CHUNK_IDS = 1 << 17
MAX_OUTPUTS = 10_000

try:  # the tasks run this module's functions: send them by value
    from pyspark import cloudpickle as _cp
    import sys as _sys
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with --py-files
    pass


@dataclass(frozen=True)
class Training:
    """Epochs, warm-up share and kept epoch follow the usual fine-tuning recipe."""

    epochs: int = 5
    batches: int = 8
    rate: float = 0.05
    warmup: float = 0.1
    buckets: int = 1 << 15
    dim: int = 16
    seed: int = 42
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8


@dataclass
class Head:
    """``embed`` (buckets x dim), ``weight`` (outputs x dim) and ``bias``."""

    embed: np.ndarray
    weight: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.weight, self.bias]

    def copy(self) -> Head:
        return Head(*(p.copy() for p in self.parts()))


def new_head(outputs: int, t: Training) -> Head:
    rng = np.random.default_rng(t.seed)
    return Head(rng.normal(0, 1, (t.buckets, t.dim)), np.zeros((outputs, t.dim)), np.zeros(outputs))


def gram_ids(text: Column, buckets: int) -> Column:
    """The buckets of a text's words and pairs of neighbouring words."""
    return _ids_of_words(_words(text), buckets)


def _words(text: Column) -> Column:
    return F.coalesce(tokens(text, "word"), F.array().cast("array<string>"))


def _ids_of_words(words: Column, buckets: int) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.transform(F.concat(words, pairs), lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int"))


def with_gram_ids(df: DataFrame, text: str, buckets: int, by: list[str]) -> DataFrame:
    """``df`` with ``ids``.  The rows are dealt by the columns ``by`` and the text first, as many tasks as its bytes need: one
    large file is one task's text else.  Each text is tokenised once (inside ``gram_ids`` its words stand five times)."""
    docs = df.repartition(term_tasks(df, text), *by, text)
    return docs.withColumn("__words", _words(F.col(text))).withColumn("ids", _ids_of_words(F.col("__words"), buckets)).drop("__words")


# -- inside a task --------------------------------------------------------------------------------

def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, flat ids, offsets) of runs of rows with about ``CHUNK_IDS`` ids, one row at least."""
    offs, flat, low = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False), 0
    while low < len(column):
        high = min(len(column), max(low + 1, int(np.searchsorted(offs, offs[low] + CHUNK_IDS, "right")) - 1))
        yield low, flat[offs[low]:offs[high]], offs[low:high + 1] - offs[low]
        low = high


def factor(head: Head) -> np.ndarray:
    """What a row sums over its ids (buckets x width): its scores where there are fewer outputs than dimensions, since a mean
    of embeddings times the weights is a mean of the embeddings' own scores, else its embeddings."""
    return head.embed @ head.weight.T if len(head.bias) <= head.embed.shape[1] else head.embed


def forward(head: Head, table: np.ndarray, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means of the rows' entries of ``table``, the head's ``factor``; scores).  A row's sums do not depend on other rows."""
    size = np.diff(offs)
    row = np.repeat(np.arange(len(size)), size)
    mean = np.stack([np.bincount(row, c[ids], len(size)) for c in table.T], 1) / np.maximum(1, size)[:, None]
    return mean, (mean if len(head.bias) <= head.embed.shape[1] else mean @ head.weight.T) + head.bias


def loss_and_slope(scores: np.ndarray, y: np.ndarray, classes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each row's loss and its derivative by the scores."""
    if not classes:
        off = scores[:, 0] - y
        return off ** 2, 2 * off[:, None]
    z = scores - scores.max(1, keepdims=True)
    p = np.exp(z)
    s = p.sum(1, keepdims=True)
    at = np.arange(len(y)), y.astype(np.int64)
    loss = np.log(s[:, 0]) - z[at]
    p /= s
    p[at] -= 1
    return loss, p


def gradients(head: Head, table: np.ndarray, ids: np.ndarray, offs: np.ndarray, y: np.ndarray,
              classes: bool) -> tuple[list[np.ndarray], float]:
    """Sums over the rows: the derivatives by the buckets' entries of ``table``, the gradients by weight (where ``table`` holds
    embeddings; else they follow from the first) and bias, and the loss."""
    mean, scores = forward(head, table, ids, offs)
    loss, slope = loss_and_slope(scores, y, classes)
    size = np.diff(offs)
    narrow = len(head.bias) <= head.embed.shape[1]
    back = (slope if narrow else slope @ head.weight) / np.maximum(1, size)[:, None]
    buckets = np.stack([np.bincount(ids, np.repeat(b, size), len(table)) for b in back.T], 1)
    return [buckets, np.zeros_like(head.weight) if narrow else slope.T @ mean, slope.sum(0)], float(loss.sum())


# -- passes over the rows -------------------------------------------------------------------------

def gradient_pass(rows: DataFrame, head: Head, classes: bool) -> tuple[list[np.ndarray], float, int]:
    """Sums of the gradients and of the loss over ``rows`` (ids, y), and their number."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(head.parts())  # plain arrays: executors need no copy of this package
    outputs, width, low = len(head.bias), min(len(head.bias), head.embed.shape[1]), len(head.embed)
    names = ["i", *(f"c{j}" for j in range(width))]
    below = -(-(head.weight.size + outputs + 2) // width)

    def task(batches):
        h, total, loss, n = Head(*held.value), None, 0.0, 0
        by = factor(h)
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for first, ids, offs in chunks(batch.column(0)):
                part, more = gradients(h, by, ids, offs, labels[first:first + len(offs) - 1], classes)
                total = part if total is None else [a + b for a, b in zip(total, part)]
                loss, n = loss + more, n + len(offs) - 1
        if total is None:
            return
        buckets, weight, bias = total
        if by is not h.embed:
            weight = buckets.T @ h.embed
        used = np.flatnonzero(buckets.any(1))
        # Bucket rows from 0; the weights, the bias, the loss and the row count are below, ``width`` numbers a row.
        rest = np.zeros(below * width)
        rest[:weight.size + outputs + 2] = np.concatenate([weight.ravel(), bias, [loss, n]])
        whole = np.rint(np.vstack([buckets[used], rest.reshape(below, width)]) * UNIT).astype(np.int64)
        at = np.concatenate([used, -1 - np.arange(below)])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(c) for c in whole.T)], names=names)

    schema = ", ".join(["i int", *(f"{c} long" for c in names[1:])])
    sums = (rows.select("ids", F.col("y").cast("double").alias("y")).mapInArrow(task, schema)
            .groupBy("i").agg(*[F.sum(c).alias(c) for c in names[1:]]))
    try:
        got = sums.toArrow()  # at most buckets rows and those below
    finally:
        held.destroy()
    at = got["i"].to_numpy()
    full = np.zeros((low + below, width))
    full[np.where(at >= 0, at, low - 1 - at)] = np.stack([got[c].to_numpy() for c in names[1:]], 1) / UNIT if len(at) else 0.0
    buckets, rest = full[:low], full[low:].ravel()
    weight, bias, (loss, n) = np.split(rest[:head.weight.size + outputs + 2], [head.weight.size, head.weight.size + outputs])
    embed = buckets @ head.weight if outputs <= head.embed.shape[1] else buckets
    return [embed, weight.reshape(head.weight.shape), bias], float(loss), int(round(n))


def score(rows: DataFrame, head: Head, carry: list[str], classes: bool) -> DataFrame:
    """``carry`` columns and ``output``: the class of the highest score (the first of equal ones) or the value."""
    held = rows.sparkSession.sparkContext.broadcast(head.parts())
    kept = rows.select("ids", *carry)
    schema = kept.drop("ids").withColumn("output", F.lit(0.0)).schema

    def task(batches):
        h = Head(*held.value)
        by = factor(h)
        for batch in batches:
            for low, ids, offs in chunks(batch.column(0)):
                s = forward(h, by, ids, offs)[1]
                out = s.argmax(1).astype(np.float64) if classes else s[:, 0]
                some = batch.slice(low, len(offs) - 1)
                yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(out)], names=[*carry, "output"])

    return kept.mapInArrow(task, schema)


# -- training -------------------------------------------------------------------------------------

def dealt(rows: DataFrame, key: str, t: Training) -> DataFrame:
    """``rows`` with ``batch``, as a written table with a folder per mini-batch."""
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    h = F.xxhash64(F.col(key), F.col("ids"), F.lit(t.seed))
    path = scratch_path(spark, "epochs-train")
    (rows.withColumn("batch", F.pmod(h, F.lit(t.batches)).cast("int")).withColumn("deal", F.pmod(F.shiftright(h, 20), F.lit(tasks)))
     .repartition(tasks, "batch", "deal").drop("deal").write.partitionBy("batch").parquet(path))
    return spark.read.schema(rows.withColumn("batch", F.lit(0)).schema).parquet(path)


def rate(step: int, steps: int, t: Training) -> float:
    """Linear warm-up, then linear decay."""
    warm = max(1, int(np.ceil(t.warmup * steps)))
    return t.rate * ((step + 1) / warm if step < warm else (steps - step) / max(1, steps - warm))


@dataclass
class Adam:
    t: Training
    first: list[np.ndarray] = field(default_factory=list)
    second: list[np.ndarray] = field(default_factory=list)
    steps: int = 0

    def apply(self, head: Head, grads: list[np.ndarray], lr: float) -> Head:
        if not self.steps:
            self.first = [np.zeros_like(g) for g in grads]
            self.second = [np.zeros_like(g) for g in grads]
        self.steps += 1
        out = []
        for k, (p, g) in enumerate(zip(head.parts(), grads)):
            self.first[k] = self.t.beta1 * self.first[k] + (1 - self.t.beta1) * g
            self.second[k] = self.t.beta2 * self.second[k] + (1 - self.t.beta2) * g * g
            m, v = self.first[k] / (1 - self.t.beta1 ** self.steps), self.second[k] / (1 - self.t.beta2 ** self.steps)
            out.append(p - lr * m / (np.sqrt(v) + self.t.eps))
        return Head(*out)


@dataclass
class Epoch:
    epoch: int
    loss: float  # mean over the epoch's rows, each before its step
    metric: float
    best: bool = False


def train(rows: DataFrame, key: str, outputs: int, classes: bool, metric: Callable[[Head], float],
          t: Training = Training()) -> tuple[Head, list[Epoch]]:
    """The parameters of the epoch with the highest ``metric`` (the first of equal ones), and all epochs.

    ``rows``: the key, ``ids`` and ``y`` (class code from 0, or the value) of the training rows."""
    if outputs > MAX_OUTPUTS:
        raise ValueError(f"{outputs} outputs, at most {MAX_OUTPUTS}")
    table = dealt(rows.filter(F.col("y").isNotNull()).select(key, "ids", "y"), key, t)
    some = [r["batch"] for r in table.select("batch").distinct().orderBy("batch").collect()]  # at most t.batches
    if not some:
        raise ValueError("no training rows")
    head, adam, log, best = new_head(outputs, t), Adam(t), [], None
    steps = t.epochs * len(some)
    rng = np.random.default_rng(t.seed)
    for e in range(t.epochs):
        loss, seen = 0.0, 0
        for b in rng.permutation(some):
            grads, part, n = gradient_pass(table.filter(F.col("batch") == int(b)), head, classes)
            head = adam.apply(head, [g / n for g in grads], rate(adam.steps, steps, t))
            loss, seen = loss + part, seen + n
        log.append(Epoch(e + 1, loss / seen, metric(head)))
        if best is None or log[-1].metric > log[best[0]].metric:
            best = e, head.copy()
    log[best[0]].best = True
    return best[1], log
