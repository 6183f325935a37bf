"""Feature engineering (FEA-*, PRJ-1/6/7).

Everything is expressed with DataFrame operators.  Small fitted state (label
mappings, category lists, a min/max pair, a vocabulary) is either a
one-row/bounded DataFrame joined by broadcast, or, where a Spark ML stage
needs it, a bounded list on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, Imputer, Normalizer,
                                VectorAssembler)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ENGLISH_STOP_WORDS, remove_stop, tokens
from ..session import written_table
from .common import bounded_broadcast, scalars

META_COLS = ("key", "split")


# ---------------------------------------------------------------- projections

def split_xy(df: DataFrame, target: str = "target", exclude: Sequence[str] = META_COLS):
    """PRJ-1: feature column names = every column except target and meta columns."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not in {df.columns}")
    feats = [c for c in df.columns if c != target and c not in exclude]
    return feats, df.select(*[c for c in df.columns if c in exclude], target, *feats)


def resplit(df: DataFrame, split: str = "split"):
    """PRJ-6: the train and validation parts of a tagged union (never by position)."""
    return df.filter(F.col(split) == "train"), df.filter(F.col(split) == "valid")


def encode(df: DataFrame, fn: Callable[[DataFrame], dict[str, Column]],
           keep: Sequence[str] = ("key",)) -> DataFrame:
    """PRJ-7 / UDF-1: map a row function given as column expressions and drop the
    original columns (only ``keep`` survives)."""
    exprs = fn(df)
    return df.select(*keep, *[e.alias(n) for n, e in exprs.items()])


def union_splits(tr: DataFrame, va: DataFrame) -> DataFrame:
    """SET-1: union all of the tagged splits (duplicates kept)."""
    return (tr.withColumn("split", F.lit("train"))
            .unionByName(va.withColumn("split", F.lit("valid")), allowMissingColumns=True))


# ---------------------------------------------------------------- labels

def label_mapping(df: DataFrame, col: str, fit_on: DataFrame | None = None) -> DataFrame:
    """FEA-5: ``(value, code)`` with codes 0..k-1 in the natural sort order of the
    values (numbers numerically, text as text; nulls are not classes).

    The distinct values are range-partitioned and written once (train, validation and
    decoding all read the same table); a code is the value's rank in its range plus
    the sizes of the ranges before.  So no task sees all values, however many
    classes there are; only the list of ranges goes through one ordered window.
    """
    src = (fit_on if fit_on is not None else df).select(F.col(col).alias("value"))
    return _coded(src.filter(F.col("value").isNotNull()).distinct())


def _coded(values: DataFrame) -> DataFrame:
    """Distinct ``value`` rows with ``code``, their rank from 0; further columns stay."""
    extra = [c for c in values.columns if c != "value"]
    ranged = written_table(values.repartitionByRange("value").withColumn("__range", F.spark_partition_id()), "label-values")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy("value"))
    return written_table(ranged.withColumn("__rank", rank).join(offsets, "__range").select(
        "value", (F.col("__base") + F.col("__rank") - 1).cast("int").alias("code"), *extra), "label-codes")


def encode_labels(df: DataFrame, col: str, mapping: DataFrame, out: str = "code",
                  unseen: str = "error") -> DataFrame:
    """FEA-5 apply: join the mapping; an unseen non-null value raises (``unseen='error'``)
    or becomes NULL (``'keep'``).

    The mapping has one row per class.  The class count is data, not a
    parameter, so the join carries no broadcast hint: AQE measures the mapping
    at run time and broadcasts it when small (always, for real label sets),
    else keeps a sort-merge join whose skewed partitions it splits."""
    m = mapping.withColumnRenamed("value", "__v").withColumnRenamed("code", out)
    j = df.join(m, df[col] == m["__v"], "left").drop("__v")
    if unseen == "error":
        j = j.withColumn(out, F.when(F.col(col).isNotNull() & F.col(out).isNull(),
                                     F.raise_error(F.concat(F.lit("unseen label: "),
                                                            F.col(col).cast("string"))))
                         .otherwise(F.col(out)).cast("int"))
    return j


def decode_labels(df: DataFrame, code_col: str, mapping: DataFrame, out: str) -> DataFrame:
    """FEA-6: code -> original value."""
    m = mapping.withColumnRenamed("value", out).withColumnRenamed("code", "__c")
    return df.join(m, F.col(code_col) == m["__c"], "left").drop("__c")


def missing_labels(tr: DataFrame, va: DataFrame, col: str) -> DataFrame:
    """SET-5: labels present in the pair but absent from train."""
    # One aggregation instead of an anti join: map-side it leaves one row per class and
    # task, so no class, however frequent, sends its rows to one place.
    both = tr.select(col, F.lit(1).alias("__in_train")).unionByName(va.select(col, F.lit(0).alias("__in_train")))
    return (both.filter(F.col(col).isNotNull()).groupBy(col).agg(F.max("__in_train").alias("__in_train"))
            .filter("__in_train = 0").select(col))


def column_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG-5: one row of averages (nulls skipped)."""
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def impute_missing_classes(tr: DataFrame, va: DataFrame, target: str,
                           features: Sequence[str]) -> DataFrame:
    """FEA-7: append one row of *train* feature means for every label present in the
    pair but absent from train.  Appending a mean row leaves the means unchanged,
    so all missing labels share the same row (JON-5: the one-row means are a
    scalar subquery attached to each missing label, not a join).  Means are
    doubles, so the feature columns become doubles."""
    tr = tr.withColumns({c: F.col(c).cast("double") for c in features})
    miss = missing_labels(tr, va, target)
    means = scalars(column_means(tr, features))
    extra = miss.select(
        *[(F.col(target) if c == target else means[c]).cast(tr.schema[c].dataType).alias(c)
          if c == target or c in features else F.lit(None).cast(tr.schema[c].dataType).alias(c)
          for c in tr.columns])
    if "split" in tr.columns:
        extra = extra.withColumn("split", F.lit("train"))
    return tr.unionByName(extra)


# ---------------------------------------------------------------- dummies

MAX_LEVELS = 10_000


def categories(df: DataFrame, cols: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted distinct non-null categories per column.

    The category lists become column names, so they must live on the driver; they
    are bounded by the number of levels, not by the row count.  Two passes over
    the table whatever the number of columns: the levels are counted first
    (partial aggregation) and a column above ``max_levels`` is refused before
    anything is gathered; then one aggregate collects every column's level set
    (map-side partial sets, nulls skipped) sorted in the column's natural
    order."""
    n = df.agg(*[F.count_distinct(c).alias(c) for c in cols]).first()
    wide = {c: n[c] for c in cols if n[c] > max_levels}
    if wide:
        raise ValueError(f"too many levels for dummies: {wide} (max_levels={max_levels})")
    sets = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cols]).first()
    return {c: list(sets[c]) for c in cols}


def dummies(df: DataFrame, cols: Sequence[str], drop_first: bool = True,
            cats: dict[str, list] | None = None) -> DataFrame:
    """FEA-4: indicator columns ``{col}_{cat}`` (int 0/1) for each category but the
    first (sorted); a null category gives all zeros.  Other columns keep their
    place, the dummies come last, in column then category order."""
    cats = cats or categories(df, cols)
    others = [c for c in df.columns if c not in cols]
    new = []
    for c in cols:
        levels = cats[c][1:] if drop_first else cats[c]
        for v in levels:
            new.append(F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}"))
    return df.select(*others, *new)


def level_codes(df: DataFrame, col: str) -> DataFrame:
    """``(value, code, n)``: the non-null levels of a column in natural order and their rows."""
    return _coded(df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")))


def sparse_dummies(df: DataFrame, cols: Sequence[str], drop_first: bool = True, numeric: Sequence[str] = (),
                   out: str = "features", active: str = "active",
                   broadcast_levels: int = MAX_LEVELS) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """FEA-4 for any number of levels: one sparse vector column instead of a column per level.

    Returns the rows without ``cols``, with ``active`` (positions of the row's ones, ascending) and ``out`` (the
    ``numeric`` columns, then the dummies in the order of ``dummies``), and the layout: first position and width per
    column.  The levels stay in written tables; only their numbers reach the driver.  A column of at most
    ``broadcast_levels`` levels meets its codes by a broadcast, a wider one by ``hot_key_join``, where a level that holds a
    third of the rows does not meet in one task.  Null is no level and has no position; so is the first level if
    ``drop_first``.  ``numeric`` must not be null."""
    from pyspark.ml.feature import OneHotEncoder
    from .joins import hot_key_join
    others = [c for c in df.columns if c not in cols]
    skip, at, layout, wide = int(drop_first), len(numeric), {}, []
    coded = df
    for j, c in enumerate(cols):
        codes = level_codes(df, c)
        levels = codes.count()
        width = max(0, levels - skip)
        layout[c] = (at, width)
        if width:
            wide.append((f"__d{j}", at, width))
            codes = codes.select(F.col("value").alias(c), (F.col("code") - skip).alias(f"__d{j}"), "n")
            if levels <= broadcast_levels:
                coded = coded.join(bounded_broadcast(codes.drop("n"), levels), c, "left")
            else:
                coded = hot_key_join(coded, codes, c, "n", how="left")
        at += width
    place = [F.when(F.col(d) >= 0, F.col(d) + start) for d, start, _ in wide]
    rows = coded.select(*others, *[F.when(F.col(d) >= 0, F.col(d)).otherwise(F.lit(w)).cast("double").alias(d) for d, _, w in wide],
                        F.array_compact(F.array(*place)).cast("array<int>").alias(active))
    if wide:
        # A position beyond the width is invalid, which "keep" encodes as no position at all.
        widest = df.sparkSession.createDataFrame([tuple(float(w - 1) for _, _, w in wide)], ", ".join(f"{d} double" for d, _, _ in wide))
        enc = OneHotEncoder(inputCols=[d for d, _, _ in wide], outputCols=[f"{d}v" for d, _, _ in wide], handleInvalid="keep").fit(widest)
        rows = enc.transform(rows)
    parts = [*numeric, *[f"{d}v" for d, _, _ in wide]]
    if not parts:
        raise ValueError("no level and no numeric column")
    rows = VectorAssembler(inputCols=parts, outputCol="__x", handleInvalid="error").transform(rows)
    # Without the attributes' names: a list of all levels has no place in a schema.
    return rows.select(*[c for c in others if c != out], active, F.col("__x").alias(out, metadata={})), layout


# ---------------------------------------------------------------- scaling

def minmax_fit(df: DataFrame, col: str) -> DataFrame:
    """FEA-8: one row ``(lo, hi)`` fitted on the given (train) rows."""
    return df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))


def _range(stats_lo: Column, stats_hi: Column) -> Column:
    r = stats_hi - stats_lo
    return F.when(r == 0, F.lit(1.0)).otherwise(r)


def minmax_transform(df: DataFrame, col: str, stats: DataFrame, out: str | None = None) -> DataFrame:
    """``(x - lo) / (hi - lo)``, no clipping; a zero range divides by 1."""
    out = out or col
    s = scalars(stats)
    return df.withColumn(out, (F.col(col) - s["lo"]) / _range(s["lo"], s["hi"]))


def minmax_inverse(df: DataFrame, cols: Sequence[str], stats: DataFrame) -> DataFrame:
    """Inverse of ``minmax_transform`` for each column in ``cols``."""
    s = scalars(stats)
    return df.withColumns({c: F.col(c) * _range(s["lo"], s["hi"]) + s["lo"] for c in cols})


# ---------------------------------------------------------------- vectors

def assemble_stages(features: Sequence[str], out: str = "features") -> list:
    """FEA-9: impute numeric nulls with train means, then a vector.  Spark trees
    reject NaN inside a vector, the boosting libraries accept it; imputation keeps
    rows whole."""
    imputed = [f"__imp_{c}" for c in features]
    return [Imputer(inputCols=list(features), outputCols=imputed, strategy="mean"),
            VectorAssembler(inputCols=imputed, outputCol=out, handleInvalid="error")]


# ---------------------------------------------------------------- text

def doc_terms(df: DataFrame, key: str = "key", text: str = "sentence",
              stop_words: Sequence[str] | None = ENGLISH_STOP_WORDS,
              mode: str = "word", carry: Sequence[str] = (), by_key: bool = False) -> DataFrame:
    """``(key, *carry, term, tf)``: raw term counts per document; ``carry`` columns
    (split, label, ...) depend on the key and ride along without a join.

    A document is one row, so its counts need no shuffle: its tokens are sorted and
    run lengths read off, inside the row.  (The one-element ``explode`` keeps the sorted
    array as a column; inlined into the lambdas it would be sorted again for every element.)

    ``by_key``: hash-partition the narrow ``(key, text)`` projection by key first and count by
    aggregation.  For callers with a later per-document window or sum over the terms
    (the L2 norm of TF-IDF): it reuses that partitioning, and one shuffle of the text
    replaces one of the larger term stream.  Keys must then be unique or mean one document.
    The partitions follow the text's bytes (one pass ahead): a task holds all terms of its documents."""
    toks = tokens(F.col(text), mode)
    if stop_words:
        toks = remove_stop(toks, stop_words)
    if by_key:
        docs = df.select(key, *carry, text)
        docs = docs.repartition(term_tasks(docs, text), key)
        return (docs.select(key, *carry, F.explode(toks).alias("term"))
                .groupBy(key, *carry, "term").agg(F.count(F.lit(1)).alias("tf")))
    ordered = (df.select(key, *carry, F.explode(F.array(F.sort_array(toks))).alias("__s")).filter(F.size("__s") > 0))
    at = F.sequence(F.lit(0), F.size("__s") - 1)
    heads = F.filter(at, lambda i: (i == 0) | (F.get("__s", i) != F.get("__s", i - 1)))
    runs = ordered.select(key, *carry, "__s", F.explode(F.array(heads)).alias("__at"))
    end = lambda j: F.coalesce(F.get("__at", j + 1), F.size("__s"))
    counts = F.transform("__at", lambda i, j: F.struct(F.get("__s", i).alias("term"), (end(j) - i).cast("bigint").alias("tf")))
    return runs.select(key, *carry, F.explode(counts).alias("__t")).select(key, *carry, "__t.term", "__t.tf")


#: Bytes of text whose terms one task counts, weighs and sorts: they take some twenty times as much.
TASK_TEXT = 8 << 20


def term_tasks(docs: DataFrame, text: str) -> int:
    """One wave of tasks, more for more text."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_TEXT))


def vocabulary(terms: DataFrame, size: int = 10000, key: str = "key") -> DataFrame:
    """TOP-3: ``(term, term_id, total, df)`` for the ``size`` most frequent terms
    (total count desc, term asc); ``term_id`` from 0.  ``terms`` is ``doc_terms``
    output.  Map-side partial aggregation absorbs heavy terms; the cap makes the
    result a bounded ``TakeOrderedAndProject`` (each task ships at most ``size``
    rows), so the id window runs over at most ``size`` rows.  The cap is
    mandatory: the reference always caps the vocabulary, and an uncapped id
    assignment would need the whole term table in one ordered task."""
    if size is None or size < 1:
        raise ValueError("vocabulary size must be a positive integer")
    stats = terms.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    ordered = stats.orderBy(F.desc("total"), F.asc("term")).limit(size)
    w = Window.orderBy(F.desc("total"), F.asc("term"))
    return ordered.select("term", (F.row_number().over(w) - 1).cast("int").alias("term_id"),
                          "total", "df")


def tfidf_long(df: DataFrame, key: str = "key", text: str = "sentence", vocab_size: int = 10000,
               stop_words: Sequence[str] | None = ENGLISH_STOP_WORDS, mode: str = "word",
               terms: DataFrame | None = None) -> DataFrame:
    """FEA-3, relational form: ``(key, term, tf, weight)`` non-zero cells.

    ``idf = ln((1 + n) / (1 + df)) + 1`` with ``n`` = all documents (empty ones
    included), ``weight = tf * idf / ||tf * idf||_2`` over kept terms.
    Fitted on every row of ``df`` (train and validation together).
    """
    terms = terms if terms is not None else doc_terms(df, key, text, stop_words, mode, by_key=True)
    vocab = vocabulary(terms, vocab_size, key)
    n_docs = scalars(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    bound = vocab_size
    idf = vocab.select("term", "term_id", idf_expr(n_docs, F.col("df")).alias("idf"))
    return tfidf_cells(terms, idf, key, bound).select(key, "term", "term_id", "tf", "weight")


def idf_expr(n, df) -> Column:
    """Smoothed idf: ``ln((1 + n) / (1 + df)) + 1``."""
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) + F.lit(1.0)


def tfidf_cells(terms: DataFrame, idf: DataFrame, key: str = "key", bound: int = 10000) -> DataFrame:
    """Join term counts with a bounded ``(term, idf, ...)`` table (broadcast) and
    L2-normalise per document.  ``terms`` is hash-partitioned by key
    (``doc_terms`` with ``by_key``), so the per-document window needs no further shuffle.
    Extra columns of ``idf`` ride along."""
    cells = terms.join(bounded_broadcast(idf, bound), "term")
    raw = cells.withColumn("__raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("__raw") * F.col("__raw")).over(Window.partitionBy(key)))
    return raw.withColumn("weight", F.col("__raw") / norm).drop("__raw")


def tfidf_model(df: DataFrame, key: str = "key", text: str = "sentence", vocab_size: int = 10000,
                stop_words: Sequence[str] | None = ENGLISH_STOP_WORDS, mode: str = "word",
                tokens_col: str = "tokens", out: str = "tfidf") -> tuple[PipelineModel, list[str]]:
    """FEA-3, vector form: a fitted ``PipelineModel`` of count vector over the
    relational vocabulary (deterministic ties) -> ``ElementwiseProduct(idf + 1)``
    -> ``Normalizer(p=2)``.  Input column ``tokens_col`` must hold
    ``tokens_column(...)``.  Returns the model and its vocabulary."""
    terms = doc_terms(df, key, text, stop_words, mode)
    n = df.count()
    rows = vocabulary(terms, vocab_size, key).orderBy("term_id").collect()  # <= vocab_size rows
    vocab = [r["term"] for r in rows]
    import math
    idf = [math.log((1.0 + n) / (1.0 + r["df"])) + 1.0 for r in rows]
    cv = CountVectorizerModel.from_vocabulary(vocab, inputCol=tokens_col, outputCol="__tf")
    ep = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__tf", outputCol="__tfidf")
    nm = Normalizer(p=2.0, inputCol="__tfidf", outputCol=out)
    return PipelineModel(stages=[cv, ep, nm]), vocab


def tokens_column(text: str = "sentence", stop_words: Sequence[str] | None = ENGLISH_STOP_WORDS,
                  mode: str = "word") -> Column:
    t = tokens(F.col(text), mode)
    return remove_stop(t, stop_words) if stop_words else t


def encode_ids(df: DataFrame, vocab: DataFrame, key: str = "key", text: str = "sentence",
               max_len: int = 128, vocab_bound: int = 10000) -> DataFrame:
    """FEA-10: ``(key, ids, mask)``: token -> id (vocabulary ``term_id + 1``; 0 = pad
    or unknown), truncated to ``max_len``, padded with 0; ``mask = id <> 0``.

    Truncation happens before the explode, so each document contributes at most
    ``max_len`` rows; the regrouping by key collects at most ``max_len`` entries
    per group.  ``posexplode_outer`` keeps a document without tokens as one
    row with a NULL position, so empty documents survive the single
    ``groupBy(key)`` and no join back to the documents is needed."""
    toks = F.slice(tokens(F.col(text)), 1, max_len)
    pos = df.select(key, F.posexplode_outer(toks).alias("pos", "term"))
    ids = bounded_broadcast(vocab.select("term", (F.col("term_id") + 1).alias("id")), vocab_bound)
    j = pos.join(ids, "term", "left").select(key, "pos", F.coalesce("id", F.lit(0)).alias("id"))
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", "id"))
    seq = j.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("s"))
    arr = F.transform("s", lambda x: x["id"])
    padded = F.concat(arr, F.array_repeat(F.lit(0), F.lit(max_len) - F.size(arr)))
    return seq.select(key, padded.alias("ids")).withColumn(
        "mask", F.transform("ids", lambda x: (x != 0).cast("int")))
