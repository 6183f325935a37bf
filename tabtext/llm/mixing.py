"""Mixing sources to target weights (operator 2), DataFrame operations only.

Capped water-filling: every source may be used for at most ``max_epochs`` times its
size; the requested total is dealt out by weight, sources at their cap are clamped
and their excess goes to the others by weight until none is above its cap.  The
fixed point is ``target = min(cap, level * weight)`` with one common level.  Sources
sorted by cap / weight are clamped from the front, so the level comes from running
sums over the sources (one row each), without iterating.

A source is then repeated ``target / size`` times: its whole repetitions for every
document and the fractional one for a seeded sample.  The sample takes documents in
the order of ``md5(seed:id)`` until their running size reaches the fraction of the
source, so the words taken differ from the target by half a document at most.  The
running sums are two-level: sums per (source, hash bucket), then an exact order inside
the one bucket per source in which the sample ends.  No window ever holds a whole
source, and a row's copies depend on the row and its source's plan alone.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a
source of its own, the last one; a null id ranks as the text ``null``; rows of a
source with equal ids and sizes are taken alike; further columns travel along; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, own_names, plain_names, written

WEIGHTS = (3, 1, 2)
SHARE_PCT = 150
MAX_EPOCHS = 2
SEED = 11
#: Sources beyond this many are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_SOURCES = 100_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share_pct: int = SHARE_PCT,
               max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` -> with ``target``.  One row per source goes through one ordered window."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(w) for w in weights])
    s = sources.withColumn("w", F.element_at(pattern, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    full = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumns({"wanted": F.least(F.sum("source_size").over(full) * share_pct / F.lit(100.0),
                                         F.sum("cap").over(full).cast("double")),
                       "clamped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
                       "open_w": F.sum("w").over(rest)})
    s = s.withColumn("level", (F.col("wanted") - F.col("clamped")) / F.col("open_w"))
    # A source is clamped when the level that it and the later ones would share reaches its cap.
    s = s.withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    first_open = F.min(F.when(~F.col("full"), F.struct("clamped", "open_w", "level"))).over(full)
    s = s.withColumn("share", first_open["level"] * F.col("w"))
    return s.select("source", "source_size", F.when(F.col("full") | F.col("share").isNull(), F.col("cap").cast("double"))
                    .otherwise(F.col("share")).alias("target"))


def _with_rank(df: DataFrame, doc_id: str, seed: int) -> DataFrame:
    """Adds the seeded order ``__rank`` and its first 12 bits ``__bucket``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")))
    return df.withColumn("__rank", F.md5(text.cast("binary"))).withColumn("__bucket", F.substring("__rank", 1, 3))


def mix_plan(rows: DataFrame, seed: int = SEED, weights: Sequence[int] = WEIGHTS, share_pct: int = SHARE_PCT,
             max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``doc_id, source, size`` (a written table) -> one written row per source: its size and target, the
    whole repetitions, and where in the seeded order its fractional sample ends."""
    ranked = _with_rank(rows, "doc_id", seed)
    buckets = written(ranked.groupBy("source", "__bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    plan = water_fill(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")),
                      weights, share_pct, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole.cast("long"))
    plan = written(plan.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "mix-sources")
    # The bucket in which the sample ends: the first whose running size reaches the part.
    ahead = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = buckets.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    parts = _side(plan.select(F.col("source").alias("p_source"), "part"), plan)
    ends = written(running.join(parts, F.col("source").eqNullSafe(F.col("p_source")))
                   .filter("ahead < part and part <= ahead + bucket_size")
                   .select("p_source", "part", F.col("__bucket").alias("end_bucket"), "ahead"), "mix-ends")
    # The exact end inside that bucket: a document counts when more than half of it is wanted.
    inside = (ranked.join(_side(ends, plan), F.col("source").eqNullSafe(F.col("p_source"))
                          & (F.col("__bucket") == F.col("end_bucket")))
              .groupBy("source", "part", "ahead", "__rank", "size").agg(F.sum("size").alias("step")))
    used = Window.partitionBy("source").orderBy("__rank", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = (inside.withColumn("used", F.col("ahead") + F.coalesce(F.sum("step").over(used), F.lit(0)))
            .filter("used + step / 2.0D <= part")
            .groupBy("source").agg(F.max(F.struct(F.col("__rank").alias("rank"), "size")).alias("end")))
    e = ends.join(last, F.col("p_source").eqNullSafe(F.col("source")), "left").select(
        F.col("p_source").alias("e_source"), "end_bucket", F.col("end.rank").alias("end_rank"),
        F.col("end.size").alias("end_size"))
    return written(plan.join(e, F.col("source").eqNullSafe(F.col("e_source")), "left").select(
        F.col("source").alias("p_source"), "source_size", "target", "whole", "end_bucket", "end_rank", "end_size"),
        "mix-plan")


def _side(small: DataFrame, sources: DataFrame) -> DataFrame:
    """``small`` (a few rows per source) as a join side: broadcast while the sources are few."""
    return F.broadcast(small) if sources.count() <= MAX_BROADCAST_SOURCES else small


def with_copies(df: DataFrame, plan: DataFrame, doc_id: str, source: str, size: str, seed: int = SEED) -> DataFrame:
    """``df`` with ``source_size, target, copies``; a function of the row and its source's plan row alone."""
    extra = F.when(F.col("__bucket") != F.col("end_bucket"), F.col("__bucket") < F.col("end_bucket")).otherwise(
        (F.col("__rank") < F.col("end_rank")) | (F.col("__rank") == F.col("end_rank")) & (F.col(size) <= F.col("end_size")))
    j = _with_rank(df, doc_id, seed).join(_side(plan, plan), F.col(f"`{source}`").eqNullSafe(F.col("p_source")))
    return j.withColumn("copies", F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")).drop(
        "p_source", "whole", "end_bucket", "end_rank", "end_size", "__rank", "__bucket")


def _sizes(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return written(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                               n_words(text).alias("size")), "mix-sizes")


def mix_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               seed: int = SEED, **how) -> DataFrame:
    """One narrow row per document: ``doc_id, size, source_size, target, taken``; the text is read once."""
    rows = _sizes(docs, doc_id, text, source)
    out = with_copies(rows, mix_plan(rows, seed, **how), "doc_id", "source", "size", seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED,
        **how) -> DataFrame:
    """The mixture itself: every document as many times as it is taken, with its columns.  No text is shuffled
    while the sources' plan may be broadcast."""
    plan = mix_plan(_sizes(docs, doc_id, text, source), seed, **how)
    inner, at = plain_names(docs)
    out = with_copies(inner.withColumn("__size", n_words(at[text])), plan, at[doc_id], at[source], "__size", seed)
    return own_names(out.filter("copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), at)
