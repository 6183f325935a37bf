"""XPL-3, UDF-3: partition explainer of any scorer over spans of tokens.

A document's tokens are split in halves again and again, which gives a binary tree of spans.  The explainer hands the value
of a span down the tree: a span with context C (the tokens that are shown besides it) and value ``v(C + span) - v(C)`` has
halves L and R, and by the Shapley formula for two players each half receives the mean of its two contributions, before and
after the other; each half then goes on in two contexts of half the weight, without and with its sibling.  At single tokens
the received values add up to the Owen values of the tree, and over a document to ``score(all tokens) - score(no token)``.

A span of depth d has 2^d contexts: its siblings and those of the spans above it, each shown or hidden.  The texts that
show one half of a split span in one of its contexts are known beforehand, so tasks write the texts of all documents and
the scorer scores them in one job.  What is handed down is linear in the scores: with ``A(side)`` the sum of the scores that show one half
of a span over its contexts, each split above a token adds ``A(own half) - A(other half)``, and the token receives the sum
of these and of ``score(all tokens) - score(no token)``, over 2^d.  So two sums a split are kept, not its texts or contexts.
Hidden tokens are left out of the text, or replaced by ``mask``.  The exact values of n tokens need O(n^2) texts, so work is bounded
by ``evaluations`` texts a document, a documented parameter: where the next level of a document would pass it, the document stops at its
spans and a span's value is shared evenly by its tokens, which keeps the sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written_table

#: Texts a document may cost; 500 is the usual default of such explainers.
EVALUATIONS = 500
#: A task writes about so many tokens of texts, and so many texts of one document.
TOKENS_PER_TASK = 20_000_000
TEXTS_AT_ONCE = 4096
#: Characters of the texts that a task hands over together.
BATCH_CHARS = 1 << 22

try:  # the tasks run this module's functions: send them by value
    from pyspark import cloudpickle as _cp
    import sys as _sys
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with --py-files
    pass


def _levels(n: Column, evaluations: int | None) -> Column:
    """(``cost``, ``depth``) of a document of n tokens: the levels that are split, and the texts they need."""
    def level(a: Column, d: Column) -> Column:
        # A level's spans are of two sizes next to each other; each of two or more tokens needs two texts in each context.
        wide = F.call_function("shiftleft", F.lit(1).cast("long"), d)
        split = F.greatest(F.lit(0), F.least(wide, n - wide))
        cost = a["cost"] + 2 * split * wide
        more = a["more"] & (split > 0) & (F.lit(True) if evaluations is None else cost <= evaluations)
        return F.struct(F.when(more, cost).otherwise(a["cost"]).alias("cost"), F.when(more, d + 1).otherwise(a["depth"]).alias("depth"), more.alias("more"))
    start = F.struct(F.lit(2).cast("long").alias("cost"), F.lit(0).alias("depth"), F.lit(True).alias("more"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), start, level)


def _texts(tokens: Sequence[str | None], depth: int, mask: str | None) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """(node, side, shown pieces) of the texts of a document.  Node 0 is the whole document, hidden and shown; a split span has
    the halves 2 node and 2 node + 1."""
    def piece(lo: int, hi: int) -> tuple[str, ...]:
        return (" ".join(t for t in tokens[lo:hi] if t is not None),)

    def hidden(lo: int, hi: int) -> tuple[str, ...]:
        return () if mask is None else (" ".join([mask] * (hi - lo)),)

    n = len(tokens)
    yield 0, 0, hidden(0, n)
    yield 0, 1, piece(0, n)
    todo = [(1, 0, 0, n, [((), ())])]
    while todo:  # the last first: a path's contexts are held, not a level's
        node, d, lo, hi, contexts = todo.pop()
        if d == depth or hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        left, right = (hidden(lo, mid), piece(lo, mid)), (hidden(mid, hi), piece(mid, hi))
        for before, after in contexts:
            yield node, 0, (*before, *left[1], *right[0], *after)
            yield node, 1, (*before, *left[0], *right[1], *after)
        todo.append((2 * node, d + 1, lo, mid, [(b, x + a) for b, a in contexts for x in right]))
        todo.append((2 * node + 1, d + 1, mid, hi, [(b + x, a) for b, a in contexts for x in left]))


def _values(n: int, depth: int, sums: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """(tokens x classes) what each token receives."""
    out = np.zeros((n, len(sums[0, 0])))
    todo = [(1, 0, 0, n, sums[0, 1] - sums[0, 0])]
    while todo:
        node, d, lo, hi, received = todo.pop()
        if d == depth or hi - lo < 2:
            out[lo:hi] = received / (1 << d) / (hi - lo)
            continue
        mid, more = (lo + hi) // 2, sums[node, 0] - sums[node, 1]
        todo += [(2 * node, d + 1, lo, mid, received + more), (2 * node + 1, d + 1, mid, hi, received - more)]
    return out


def partition_attributions(df: DataFrame, scorer: Callable[[DataFrame], DataFrame], key: str = "key", text: str = "sentence",
                           evaluations: int | None = EVALUATIONS, mask: str | None = None,
                           tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(sample, position, token, class, shap_value)`` of every token occurrence of every document.

    ``scorer(df)`` takes rows with ``key`` and ``text`` and returns them with an ``array<double>`` column ``scores``;
    ``evaluations``: texts a document may cost (None: exact).  Scores must be finite.  A document without tokens has no row."""
    from ..functions.text import tokens as default_tokens
    docs = df.select(F.col(key).alias("doc"), (tokens or default_tokens)(F.col(text)).alias("tokens")).filter(F.size("tokens") > 0)
    docs = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("level", _levels(F.size("tokens").cast("long"), evaluations))
    docs = written_table(docs.select("doc", "row", "tokens", "level.depth", "level.cost"), "owen-documents")
    kind = dict(docs.dtypes)["doc"]
    # A document of many texts is dealt to several tasks.
    work = docs.agg(F.sum(F.col("cost") * F.size("tokens"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-work // TOKENS_PER_TASK))
    units = docs.withColumn("units", F.ceil(F.col("cost") / TEXTS_AT_ONCE).cast("int"))
    units = units.withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1))).repartition(parts, "row", "unit")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "row", "node", "side", "shown"]
        for batch in batches:
            doc = batch.column("doc")
            held, chars = [], 0

            def handed() -> pa.RecordBatch:
                at, *columns = zip(*held)
                types = (pa.int64(), pa.int64(), pa.int32(), pa.string())
                return pa.RecordBatch.from_arrays([doc.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)
            for at, (row, words, depth, units, unit) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "tokens", "depth", "units", "unit")))):
                for i, (node, side, pieces) in enumerate(_texts(words, depth, mask)):
                    if i % units == unit:
                        held.append((at, row, node, side, " ".join(p for p in pieces if p)))
                        chars += len(held[-1][-1])
                        if chars > BATCH_CHARS or len(held) == 10_000:
                            yield handed()
                            held, chars = [], 0
            if held:
                yield handed()

    texts = units.select("doc", "row", "tokens", "depth", "units", "unit").mapInArrow(write, f"doc {kind}, row long, node long, side int, shown string")
    scored = scorer(texts.select(F.col("doc").alias(key), F.struct("row", "node", "side").alias("__of"), F.col("shown").alias(text))).select("__of", "scores")
    sums = scored.select("__of.*", F.posexplode("scores").alias("class", "score")).groupBy("row", "node", "side", "class").agg(F.sum("score").alias("sum"))
    sums = sums.groupBy("row", "node", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "sum"))), lambda x: x["sum"]).alias("sums"))
    sums = sums.groupBy("row").agg(F.collect_list(F.struct("node", "side", "sums")).alias("sums"))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sample", "position", "token", "class", "shap_value"]
        for batch in batches:
            doc, words = batch.column("doc"), batch.column("tokens")
            for at, (depth, sums) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("depth", "sums")))):
                own = words[at].values
                got = _values(len(own), depth, {(s["node"], s["side"]): np.array(s["sums"]) for s in sums})
                n, k = got.shape
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(np.full(n * k, at))), pa.array(np.repeat(np.arange(n, dtype=np.int32), k)),
                                                  own.take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(k, dtype=np.int32), n)),
                                                  pa.array(got.ravel())], names=names)

    return docs.join(sums, "row").select("doc", "tokens", "depth", "sums").mapInArrow(
        share, f"sample {kind}, position int, token string, class int, shap_value double")
