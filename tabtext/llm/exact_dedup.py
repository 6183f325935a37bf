"""Exact deduplication by two-pass Bloom filtering (operator 8), DataFrame operations only.

Texts are equal when they are identical after lower-casing A-Z; the key is the
SHA-256 of the normalised UTF-8 text.

* Pass 1 builds a blocked Bloom filter of what occurs *again*.  A key maps to one
  64-bit word of the filter and to two bits in it; ``(word, bit)`` pairs are counted
  with map-side aggregation, and the bits set at least twice make the filter.  A repeated key has both its
  bits in it (no false negatives); about one key in sixty that is not repeated has,
  too (``BITS_PER_ROW``).
* Pass 2 probes every row.  Rows outside the filter are certainly unique and pass
  straight through, without a shuffle.  Only the others are grouped by their key,
  which makes the result exact.

The filter has at most 16 bits a row.  It is broadcast while its row count, a power
of two fixed before it is built, stays within ``MAX_BROADCAST_WORDS`` (about 64 MB
in memory); beyond that the narrow rows (hash and flags, never the text) meet it in
a shuffle join.  Groups of copies are attached by ``common.attach``: hot groups by a
bounded broadcast, the rest by a shuffle join.

Defined cases: null counts as the empty text, and empty texts are equal to each
other; the row with the largest id stays; a null id is the smallest, and of several
rows with the same text and the same largest id all are marked as kept (they are
one document to the caller); further columns travel along; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, lower_ascii, own_names, plain_names, written

BITS_PER_ROW = 16
#: Words of one broadcast part of the filter (16 bytes each), and how many parts are broadcast at most.
MAX_BROADCAST_WORDS, MAX_PARTS = 1 << 20, 8
#: Groups of equal texts (48 bytes each) that are broadcast to rows that carry their text, beyond that filter size.
MAX_BROADCAST_GROUPS = 1 << 20


def text_key(text: str = "text") -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased; null counts as empty."""
    norm = lower_ascii(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def _long(key: Column, at: int) -> Column:
    """Seven bytes of the key as a non-negative number."""
    return F.conv(F.hex(F.substring(key, at, 7)), 16, 10).cast("long")


def filter_words(total: int) -> int:
    """Words of the filter for ``total`` rows: the power of two at or above 16 bits a row."""
    return 1 << max(0, (max(1, total) * BITS_PER_ROW - 1).bit_length() - 6)


def _bits(words: int, key: str = "__key") -> list[Column]:
    h = _long(F.col(key), 1)
    g = _long(F.col(key), 9)
    first = (g % 64).cast("int")
    step = (F.shiftright(g, 6) % 63).cast("int") + 1
    return [(h % words).alias("__word"), first.alias("__bit1"), ((first + step) % 64).alias("__bit2")]


def repeat_filter(keys: DataFrame, words: int) -> DataFrame:
    """Pass 1: (``__word``, ``__mask``) of the bits set by two rows or more."""
    spots = keys.select(*_bits(words)).select("__word", F.explode(F.array("__bit1", "__bit2")).alias("__bit"))
    twice = spots.groupBy("__word", "__bit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__mask"))


def probe(rows: DataFrame, bloom: DataFrame, words: int) -> DataFrame:
    """Pass 2: the rows with ``__again`` (possibly repeated).  No row moves while the filter fits into ``MAX_PARTS`` ranges
    of words, each broadcast; beyond that the rows, which must be narrow, are joined with it."""
    cols = rows.columns
    both = F.expr("shiftleft(1L, __bit1) | shiftleft(1L, __bit2)")
    out, masks = rows.select(*[F.col(f"`{c}`") for c in cols], *_bits(words)), []
    for low in range(0, words, MAX_BROADCAST_WORDS) if fits(words) else (0,):
        part = bloom.filter(F.col("__word").between(low, low + MAX_BROADCAST_WORDS - 1)) if fits(words) else bloom
        masks.append(f"__mask{len(masks)}")
        part = part.withColumnRenamed("__mask", masks[-1])
        out = out.join(F.broadcast(part) if fits(words) else part, "__word", "left")
    mask = F.coalesce(*masks)
    return out.select(*[F.col(f"`{c}`") for c in cols], F.coalesce(mask.bitwiseAND(both) == both, F.lit(False)).alias("__again"))


def fits(words: int) -> bool:
    return words <= MAX_BROADCAST_WORDS * MAX_PARTS


def mark_duplicates(rows: DataFrame, keys: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``rows`` (with ``__key``) plus ``keep_id, group_size, kept``.

    ``keys`` is a written table of ``__key`` and the id of the same rows, so that the two
    passes do not touch the text again."""
    total = keys.count()
    words = filter_words(total)
    bloom = written(repeat_filter(keys, words), "dedup-filter")
    groups = written(probe(keys, bloom, words).filter("__again").groupBy("__key")
                     .agg(F.max(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                     .filter("group_size > 1"), "dedup-groups")
    if not fits(words) and rows is not keys:  # rows that carry texts don't meet the filter
        grouped = rows.join(F.broadcast(groups), "__key", "left") if groups.count() <= MAX_BROADCAST_GROUPS else attach(
            rows, groups, "__key", "group_size", total)
        return _decided(grouped, doc_id)
    probed = probe(rows, bloom, words)
    alone = (probed.filter("not __again").drop("__again")
             .withColumns({"keep_id": F.col(doc_id), "group_size": F.lit(1).cast("long")}))
    return _decided(alone.unionByName(attach(probed.filter("__again").drop("__again"), groups, "__key", "group_size", total)), doc_id)


def _decided(rows: DataFrame, doc_id: str) -> DataFrame:
    """Rows without a group are their own; then ``kept``."""
    rows = rows.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col(doc_id)).otherwise(F.col("keep_id")),
                             "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return rows.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("keep_id")))


def _marked(inner: DataFrame, doc_id: str, text: str) -> DataFrame:
    keys = written(inner.select(F.col(doc_id).alias("__id"), text_key(text).alias("__key")), "dedup-keys")
    return mark_duplicates(inner.withColumns({"__key": text_key(text), "__id": F.col(doc_id)}), keys, "__id")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with their columns and ``keep_id, group_size, kept, text_sha256``; a column of the input with one of
    these four names is replaced."""
    inner, at = plain_names(docs)
    out = _marked(inner, at[doc_id], at[text])
    new = {"keep_id": F.col("keep_id"), "group_size": F.col("group_size"), "kept": F.col("kept"),
           "text_sha256": F.lower(F.hex("__key"))}
    return out.select(*[F.col(n).alias(c) for c, n in at.items() if c not in new], *[v.alias(c) for c, v in new.items()])


def dedup_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document (dropped ones too); the text is read once."""
    keys = written(docs.select(F.col(f"`{doc_id}`").alias("__id"), text_key(text).alias("__key")), "dedup-keys")
    out = mark_duplicates(keys, keys, "__id")
    return out.select(F.col("__id").alias("doc_id"), "keep_id", "group_size", "kept",
                      F.lower(F.hex("__key")).alias("text_sha256"))


def keep_last(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with their columns.  Rows with equal texts and equal ids all stay."""
    inner, at = plain_names(docs)
    return own_names(_marked(inner, at[doc_id], at[text]).filter("kept"), at)
