"""N-gram Jaccard join with token-combination prefixes (operator 1).

A document is the set of its distinct word 5-grams (lower-cased A-Z; 64-bit hashes).  Two
documents link when ``100 * |x & y| >= 80 * |x | y|``; the result is the connected component of
every document.  Copies with equal sets are one node from the start.

1. *Screening.*  A partner of ``x`` holds all but ``tau = |x| - ceil(0.8 |x|)`` of its grams.  So of the
   first ``tau + 1 + |x| / 10`` grams of ``x`` in hash order, a partner's first grams hold a certain
   number (see ``_screened``).  Sets with fewer prefix grams in common with any other prefix have
   no link.  One aggregation of short prefixes ends the work for most documents.
2. *Signatures* of the remaining sets.  Grams are ordered by document frequency.  Rare ones (at most
   ``RARE``) are signatures by themselves; frequent ones fall into ``m`` classes by hash, and every pair of
   one class is a signature.  A prefix is extended until ``rare + sum(max(0, class - 1)) > tau``: whichever ``tau`` grams a partner
   lacks, a rare gram or two of one class are left, so linked sets share a signature.
   ``m`` depends on the size class of the longer set of a pair.
3. *Verification* by exact intersection.  The most central set of each signature's bucket (highest mean
   document frequency), its hub, is compared with the others first.  The links found so far
   give components.  Every set outside its hub's component is then compared with the sets of that hub in
   other components, where the known intersections with the hub leave a link possible: common grams lie in the hub or
   outside it, and each part is bounded by either set's.  Pairs inside a component need no comparison, as they
   cannot change it.  So a group of thousands of near copies costs a few comparisons per
   copy, and no link between components is lost.

Defined cases: a text with fewer than five words is one gram, its whole sequence; a null text or
one without words has ``n_shingles = 0`` and is its own component; repeated rows share a
component; a null id counts for no minimum (a component of null ids only has a null
``component_id``); further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import attach, in_tasks, own_names, plain_names, written
from .components import connected_components

GRAM = 5
PERCENT = 80
#: Grams in at most this many sets are signatures by themselves; the others are combined in pairs.
RARE = 8
#: Grams per class of frequent ones, on average over a whole set.
CLASS_GRAMS = 16
#: Ids up to this many are broadcast to pick their documents' texts; beyond, the texts meet them in a shuffle.
MAX_BROADCAST_IDS = 1_000_000


def slack(n):
    """Grams of a set of ``n`` that a linked partner may lack."""
    return n - (PERCENT * n + 99) // 100


def gram_sets(data: np.ndarray, offs: np.ndarray, k: int = GRAM) -> list[np.ndarray]:
    """The sorted distinct gram hashes of each document of a run."""
    starts, ends, wb = ts.words(data, offs)
    h = ts.span_hashes(data, starts, ends, ts.FOLDED)
    win = ts.window_hashes(h, k).view(np.int64)
    out = []
    for a, b in zip(wb[:-1], wb[1:]):
        if b - a >= k:
            s = np.sort(win[a:b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(ts.window_hashes(h[a:b], b - a).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def fingerprint(s: np.ndarray) -> int | None:
    """64 bits that name a set; none for the empty set."""
    if not len(s):
        return None
    u = s.view(np.uint64)
    both = np.array([ts.mix(u).sum(), np.bitwise_xor.reduce(ts.mix(u + np.uint64(len(u))))], np.uint64)
    return int(ts.window_hashes(ts.mix(both), 2).view(np.int64)[0])


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def document_sets(docs: DataFrame, doc_id: str, text: str, whole: bool) -> DataFrame:
    """``doc_id, fp, n`` and ``grams``: the whole set, or its first grams for the screening."""
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def task(batches):
        for batch in batches:
            for first, data, offs in ts.text_runs(batch.column("text")):
                sets = gram_sets(data, offs)
                n = np.array([len(s) for s in sets], np.int32)
                grams = sets if whole else [s[:slack(len(s)) + 1 + len(s) // 10] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(sets)), pa.array([fingerprint(s) for s in sets], pa.int64()),
                     pa.array(n), _lists(grams, pa.int64())], names=["doc_id", "fp", "n", "grams"])

    return in_tasks(narrow, task, f"doc_id {id_type}, fp long, n int, grams array<long>")


def _screened(prefixes: DataFrame) -> DataFrame:
    """``fp, n, first_id, copies, linkable`` for every set, from the screening table.

    Let x and y be linked and let the prefix of x end first in hash order.  Whatever x's prefix and y share
    lies in y's prefix, too, and at least ``1 + n(x) // 10`` grams of x's prefix are in y, since y lacks at most
    ``tau``.  So both x and y have that many grams in common with another prefix, and ``n(x)`` is at least
    ``ceil(0.8 n(y))``: a set with fewer shared grams than ``1 + ceil(0.8 n) // 10`` has no link."""
    sets = prefixes.filter("fp is not null").groupBy("fp").agg(
        F.first("n").alias("n"), F.first(F.size("grams")).alias("p"), F.min("doc_id").alias("first_id"),
        F.count(F.lit(1)).alias("copies"))
    alone = (prefixes.filter("fp is not null").select("fp", F.explode("grams").alias("gram")).groupBy("gram")
             .agg(F.min("fp").alias("fp"), F.max("fp").alias("other")).filter("fp = other")
             .groupBy("fp").agg(F.count(F.lit(1)).alias("alone")))
    least = F.floor(F.ceil(F.col("n") * F.lit(PERCENT) / 100) / 10) + 1
    return sets.join(alone, "fp", "left").select(
        "fp", "n", "first_id", "copies", ((F.col("p") - F.coalesce("alone", F.lit(0)) >= least) & (F.col("n") > 1)).alias("linkable"))


def _texts_of(docs: DataFrame, wanted: DataFrame, doc_id: str) -> DataFrame:
    """The documents whose id is among ``wanted.first_id`` (null matches null)."""
    ids = wanted.select(F.col("first_id").alias("__id")).distinct()
    if wanted.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")), "left_semi")


def _with_frequency(sets: DataFrame) -> DataFrame:
    """``fp, n, s, grams, dfs``: the grams that two sets or more hold, by (frequency, gram); ``s`` is their number.

    Sets that hold fewer than ``0.8 n`` shared grams have no link and are left out."""
    held = sets.select("fp", "n", F.explode("grams").alias("gram"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    df = written(held.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "ngram-frequency")
    shared = attach(held, df, "gram", "df", total, how="inner")
    return (shared.groupBy("fp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("all"))
            .select("fp", "n", F.size("all").alias("s"), F.col("all.gram").alias("grams"), F.col("all.df").alias("dfs"))
            .filter(F.lit(100) * F.col("s") >= F.lit(PERCENT) * F.col("n")))


def signatures_of(n: int, grams: np.ndarray, dfs: np.ndarray) -> np.ndarray:
    """Signatures of a set of ``n`` grams, of which ``grams`` are shared (sorted by frequency)."""
    if n < 2:
        return np.zeros(0, np.int64)
    own = n.bit_length() - 1
    out = [_signatures(n, grams, dfs, own)]
    if 100 * n >= PERCENT << (own + 1):  # the shorter of a pair whose longer set is of the next size class
        out.append(_signatures(n, grams, dfs, own + 1))
    return np.concatenate(out).view(np.int64)


def _signatures(n: int, grams: np.ndarray, dfs: np.ndarray, size_class: int) -> np.ndarray:
    need = slack(n) + 1 - (n - len(grams))  # grams that no other set holds come first in the order
    if need <= 0:
        return np.zeros(0, np.uint64)
    classes = max(1, (1 << size_class) // CLASS_GRAMS)
    u = ts.mix(grams.view(np.uint64) + ts.mix(np.array([size_class + 1], np.uint64)))
    rare = int(np.searchsorted(dfs, RARE, "right"))
    of = (u[rare:] >> np.uint64(33)) % np.uint64(classes)
    weight = np.ones(len(u), np.int64)
    weight[rare + np.unique(of, return_index=True)[1]] = 0
    reach = np.cumsum(weight)
    end = min(len(u), int(np.searchsorted(reach, need)) + 1)
    out = [u[:min(rare, end)]]
    if end > rare:
        of = of[:end - rare]
        order = np.argsort(of, kind="stable")
        of, v = of[order], u[rare:end][order]
        for d in range(1, len(v)):
            same = np.flatnonzero(of[d:] == of[:-d])
            if not len(same):
                break
            a, b = v[same], v[same + d]
            out.append(ts.mix(np.minimum(a, b) * np.uint64(3) + ts.mix(np.maximum(a, b))))
    return np.concatenate(out)


def signature_rows(sets: DataFrame) -> DataFrame:
    """``sig, fp, centre``; ``centre`` is the mean frequency of the set's grams."""
    def task(batches):
        for batch in batches:
            fp, n = batch.column("fp"), batch.column("n").to_numpy()
            grams, dfs = batch.column("grams"), batch.column("dfs")
            go, gv = np.asarray(grams.offsets), np.asarray(grams.values)
            do, dv = np.asarray(dfs.offsets), np.asarray(dfs.values)
            sigs = [np.unique(signatures_of(int(k), gv[go[i]:go[i + 1]], dv[do[i]:do[i + 1]])) for i, k in enumerate(n)]
            centre = [float(dv[do[i]:do[i + 1]].sum()) / int(k) for i, k in enumerate(n)]
            at = np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64), pa.int64()), fp.take(pa.array(at)),
                 pa.array(np.array(centre, np.float64)[at])], names=["sig", "fp", "centre"])

    return in_tasks(sets.select("fp", "n", "grams", "dfs"), task, "sig long, fp long, centre double")


def _links(shared, sizes):
    """Sets of ``sizes`` grams together link when they share ``shared``."""
    return F.lit(100 + PERCENT) * shared >= F.lit(PERCENT) * sizes


def intersections(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` with ``n_a, s_a, n_b, s_b`` and ``both``, the exact number of common grams."""
    side = lambda c: sets.select(F.col("fp").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "s", "grams")])
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .select("a", "b", "n_a", "s_a", "n_b", "s_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("both")))


def link_components(sets: DataFrame) -> DataFrame:
    """``node, label`` of the sets (a written table of ``_with_frequency``) that link with another."""
    sigs = written(signature_rows(sets), "ngram-signatures")
    buckets = written(sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("rows"), F.max_by("fp", "centre").alias("hub"))
                      .filter("rows > 1"), "ngram-buckets")
    members = attach(sigs.select("sig", "fp"), buckets, "sig", "rows", sigs.count(), how="inner")
    star = written(members.filter("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct(), "ngram-star")
    star = written(intersections(star, sets), "ngram-star")
    links = star.filter(_links(F.col("both"), F.col("n_a") + F.col("n_b"))).select("a", "b")
    first = connected_components(links)
    # What is still apart: members outside the component of their bucket's centre, here called hub.
    label = lambda c: first.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    named = (star.select(F.col("a").alias("fp"), F.col("b").alias("hub"), F.col("n_a").alias("n"), F.col("s_a").alias("s"), "both")
             .join(label("fp"), "fp", "left").join(label("hub"), "hub", "left"))
    named = named.withColumns({"label": F.coalesce("fp_label", "fp"), "hub_label": F.coalesce("hub_label", "hub")})
    named = written(named.select("hub", "fp", "label", "n", "s", "both", (F.col("label") != F.col("hub_label")).alias("apart")),
                    "ngram-named")
    side = lambda c: [F.col(x).alias(f"{x}_{c}") for x in ("fp", "label", "n", "s", "both", "apart")]
    outside, others = named.filter("apart").select("hub", *side("a")), named.select("hub", *side("b"))
    # Common grams are in the hub or outside it, and each part is bounded by either set's.
    most = (F.least("both_a", "both_b") + F.least(F.col("s_a") - F.col("both_a"), F.col("s_b") - F.col("both_b")))
    near = (F.col("label_a") != F.col("label_b")) & (~F.col("apart_b") | (F.col("fp_a") < F.col("fp_b"))) & _links(
        most, F.col("n_a") + F.col("n_b"))
    pairs = outside.join(others.withColumnRenamed("hub", "hub_b"), (F.col("hub") == F.col("hub_b")) & near)
    pairs = pairs.select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")).distinct()
    more = written(intersections(written(pairs, "ngram-near"), sets), "ngram-near")
    more = more.filter(_links(F.col("both"), F.col("n_a") + F.col("n_b"))).select("a", "b")
    return connected_components(links.unionByName(more))


def ngram_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    table = written(document_sets(docs, doc_id, text, whole=False), "ngram-prefixes")
    sets = written(_screened(table), "ngram-sets")
    wanted = sets.filter("linkable")
    whole = document_sets(_texts_of(docs, wanted, doc_id), doc_id, text, whole=True)
    whole = whole.join(F.broadcast(wanted.select("fp")) if wanted.count() <= MAX_BROADCAST_IDS else wanted.select("fp"),
                       "fp", "left_semi").dropDuplicates(["fp"]).select("fp", "n", "grams")
    shared = written(_with_frequency(written(whole, "ngram-whole")), "ngram-shared")
    labels = link_components(shared)
    named = sets.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    single = named.filter("label is null").select("fp", F.col("first_id").alias("component_id"), "copies").filter("copies > 1")
    linked = written(named.filter("label is not null"), "ngram-linked")
    lowest = written(linked.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("sets")),
                     "ngram-lowest")
    joined = attach(linked, lowest, "label", "sets", linked.count(), how="inner").select("fp", "component_id", "copies")
    ids = written(single.unionByName(joined), "ngram-components")
    out = attach(table.select("doc_id", "fp", "n"), ids, "fp", "copies", table.count())
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id (null is the largest), with its columns.

    A row is known by its id and its text: rows that share an id but not a text are decided one by one, and rows equal in
    both stay or go together."""
    inner, at = plain_names(docs)
    c = F.col(at[doc_id])
    inner = inner.withColumn("__row", F.struct(c.isNull().alias("none"), c.alias("id"), F.xxhash64(F.col(at[text]).cast("string")).alias("h")))
    out = ngram_components(inner, "__row", at[text])
    gone = written(out.filter("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "ngram-gone")
    if gone.count() <= MAX_BROADCAST_IDS:
        gone = F.broadcast(gone)
    return own_names(inner.join(gone, F.col("__row") == F.col("__gone"), "left_anti"), at)
