"""Attribution tables and their summaries (XPL-3..7, AGG-6, FIL-1/3, JON-1, TOP-1/2).

The attribution table is long from the start:
``(sample, token, class, shap_value)``.  Summaries are group-bys on
``(class, token)`` (partial aggregation absorbs frequent tokens) and a top-n
window per class (partial ``WindowGroupLimit`` before the shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_blanks
from .joins import hot_key_join
from .topk import top_tokens

# Tokens excluded from the classification token summary.
CLASSIFICATION_EXCLUDE = ("the", "a")


def linear_token_weights(terms: DataFrame, label: str = "label", pos: int = 1, neg: int = 0,
                         fit: Column | None = None) -> DataFrame:
    """Token weights of a smoothed log-ratio (naive-Bayes-style) linear scorer:
    ``(token, w, n_rows)`` with ``w = ln((n_pos + 1) / (n_neg + 1))``, ``n_c`` the
    token's occurrences in class-``c`` documents, and ``n_rows`` the number of
    ``terms`` rows of the token (its document frequency: the hot-key measure
    of the attribution join).  One partial aggregation, no join.

    ``fit`` (e.g. ``split = 'train'``) selects the fitting rows inside the
    aggregation rather than by a filter before it: the weights then read the
    same token stream as the attributions of all documents (one shuffle of the
    text, reused), instead of a second, filtered copy.  A token that never occurs
    in a fitting row has both counts 0 and so the weight ln(1) = 0."""
    sel = fit if fit is not None else F.lit(True)
    n = lambda c: F.sum(F.when(sel & (F.col(label) == c), F.col("tf")).otherwise(0))
    return (terms.groupBy(F.col("term").alias("token"))
            .agg(F.log((n(pos) + F.lit(1.0)) / (n(neg) + F.lit(1.0))).alias("w"),
                 F.count(F.lit(1)).alias("n_rows")))


def linear_token_attributions(terms: DataFrame, weights: DataFrame, classes: Sequence[int] = (0, 1),
                              key: str = "key", hot_n: int = 10_000) -> DataFrame:
    """XPL-3 for a linear scorer in logit space, exact: with the empty text as
    background, the Shapley value of a token is its weight times its count.
    Binary: ``+w*tf`` for the positive class, ``-w*tf`` for the other.  One row
    per (document, distinct token, class); a token unseen in the fitting rows has
    weight 0 and keeps its rows.

    A stop-word-like token may occur in most documents, so the token join is a
    ``hot_key_join``: the ``hot_n`` most frequent tokens (by ``n_rows`` of the
    weights) are joined by a bounded broadcast, the others by a shuffle join in
    which no token holds more than ``1 / hot_n`` of the rows."""
    big = terms.select(key, F.col("term").alias("token"), "tf")
    if "n_rows" in weights.columns:
        j = hot_key_join(big, weights.select("token", "w", "n_rows"), "token", "n_rows", hot_n)
    else:
        j = big.join(weights.select("token", "w"), "token")
    pos = max(classes)
    cls = F.explode(F.array(*[F.lit(c) for c in classes]))
    return (j.select(F.col(key).alias("sample"), "token", cls.alias("class"), "w", "tf")
            .select("sample", "token", F.col("class").cast("int").alias("class"),
                    (F.when(F.col("class") == pos, F.lit(1.0)).otherwise(F.lit(-1.0))
                     * F.col("w") * F.col("tf")).alias("shap_value")))


def attributions_long(cube: DataFrame, sample: str = "sample", tokens: str = "tokens",
                      values: str = "values", classes: Sequence | None = None) -> DataFrame:
    """XPL-4: flatten ``(sample, tokens array<string>, values array<array<double>>)``
    (values[token][class]) to ``(sample, token, class, shap_value)``.  Native
    ``posexplode``: no driver loop.  ``classes`` maps class positions to labels
    (regression: one output, class 0)."""
    t = cube.select(sample, F.posexplode(F.arrays_zip(F.col(tokens).alias("t"),
                                                      F.col(values).alias("v"))).alias("tpos", "tv"))
    e = t.select(sample, F.col("tv.t").alias("token"),
                 F.posexplode(F.col("tv.v")).alias("cpos", "shap_value"))
    if classes is None:
        cls = F.col("cpos").cast("int")
    else:
        cls = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("cpos") + 1)
    return e.select(sample, "token", cls.alias("class"), "shap_value")


def clean_tokens(attr: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """FUN-7 + FIL-1: strip blanks inside tokens, then drop excluded tokens
    (literal list; null tokens dropped)."""
    a = attr.withColumn("token", strip_blanks(F.col("token")))
    a = a.filter(F.col("token").isNotNull())
    if exclude:
        a = a.filter(~F.col("token").isin(list(exclude)))
    return a


def token_stats(attr: DataFrame, group: str = "class", token: str = "token",
                value: str = "shap_value") -> DataFrame:
    """AGG-6: mean, sample std and count per (class, token); n = 1 gives a NULL std."""
    return attr.groupBy(group, token).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                                          F.count(value).alias("count"))


def having_min(stats: DataFrame, num_appear: int, count: str = "count") -> DataFrame:
    """FIL-3: keep groups with at least ``num_appear`` values."""
    return stats.filter(F.col(count) >= num_appear)


def top_token_table(attr: DataFrame, num_appear: int = 3, top_n: int = 10,
                    exclude: Sequence[str] = ()) -> DataFrame:
    """XPL-7: ``(class, token, mean, std, count, token_rank)`` of the top tokens: the
    error-bar table of the summary."""
    stats = having_min(token_stats(clean_tokens(attr, exclude)), num_appear)
    return top_tokens(stats, top_n)


def token_summary(attr: DataFrame, num_appear: int = 3, top_n: int = 10,
                  exclude: Sequence[str] = ()) -> DataFrame:
    """XPL-5: the points behind the summary plot: attribution rows of each class's
    top tokens, with the token's rank (JON-1: semi join with the list of ``top_n``
    x classes tokens)."""
    clean = clean_tokens(attr, exclude)
    top = top_token_table(attr, num_appear, top_n, exclude).select("class", "token", "token_rank")
    # Inner join = semi join + the rank column.  The list has top_n rows per class; how many
    # classes there are is data, so AQE measures it before it broadcasts.
    return clean.join(top, ["class", "token"])


def linear_leave_one_out(cells: DataFrame, bias: Sequence[float | Column] = (0.0,), key: str = "key",
                         term: str = "term", link: str = "identity") -> DataFrame:
    """XPL-3 of a fitted linear model over L2-normalised TF-IDF, exact and uncapped:
    ``(sample, token, class, shap_value)`` for every distinct token of every document.

    ``cells``: one row per (document, term) with ``raw`` = tf x idf before normalising (0 for a term the
    model does not know) and ``w``, an array of the term's coefficients, one per output.  With
    ``S = sum(raw * w)`` and ``N2 = sum(raw^2)`` over the document, the output is
    ``S / sqrt(N2) + bias``; without the term it is ``(S - raw * w) / sqrt(N2 - raw^2) + bias``,
    and ``bias`` alone when no known term is left; a term of raw 0 changes nothing.  The attribution is the difference.  So leaving out a term
    needs no rescoring: the work is one per-document sum, linear in the tokens.

    ``link``: ``identity`` explains the outputs themselves (a regressor, or a score);
    ``softmax_logit`` the logits of the class probabilities of a multinomial model.
    """
    k = len(bias)
    # A document's distinct terms meet in one task; cells that are dealt by document already are not dealt again.
    doc = Window.partitionBy(key)
    j = cells.withColumns({"__n": F.count(F.when(F.col("raw") != 0, 1)).over(doc), "__n2": F.sum(F.col("raw") * F.col("raw")).over(doc),
                           "__s": F.array(*[F.sum(F.col("raw") * F.col("w")[i]).over(doc) for i in range(k)])})
    left = F.col("__n2") - F.col("raw") * F.col("raw")
    b = [x if isinstance(x, Column) else F.lit(float(x)) for x in bias]
    full = [F.when(F.col("__n2") > 0, F.col("__s")[i] / F.sqrt("__n2")).otherwise(F.lit(0.0)) + b[i] for i in range(k)]
    rest = [F.when((F.col("__n") > 1) & (left > 0), (F.col("__s")[i] - F.col("raw") * F.col("w")[i]) / F.sqrt(left))
            .otherwise(F.lit(0.0)) + b[i] for i in range(k)]
    if link == "softmax_logit":
        full, rest = _logits(full), _logits(rest)
    elif link != "identity":
        raise ValueError(f"unknown link {link!r}")
    diff = F.array(*[F.when(F.col("raw") == 0, F.lit(0.0)).otherwise(f - r) for f, r in zip(full, rest)])
    return (j.select(F.col(key).alias("sample"), F.col(term).alias("token"), F.posexplode(diff).alias("class", "shap_value"))
            .select("sample", "token", F.col("class").cast("int").alias("class"), "shap_value"))


def _logits(z: list[Column]) -> list[Column]:
    """Logit of each softmax probability: ``z_i - log(sum over the others of exp(z_j))``, shifted by the largest."""
    out = []
    for i, zi in enumerate(z):
        others = [x for j, x in enumerate(z) if j != i]
        top = F.greatest(*others) if len(others) > 1 else others[0]
        total = F.lit(0.0)
        for x in others:
            total = total + F.exp(x - top)
        out.append(zi - top - F.log(total))
    return out


def occlusion_attributions(df: DataFrame, scorer, key: str = "key", text: str = "sentence",
                           max_len: int | None = None, classes: Sequence | None = None) -> DataFrame:
    """XPL-3 with any scorer (UDF-3): leave-one-token-out attribution.

    ``scorer(df)`` takes a DataFrame with ``key`` and ``text`` and returns it with
    an ``array<double>`` column ``scores`` (one entry per class, e.g. logits of
    the class probabilities).  Every variant of a document drops one token, all variants are scored in the
    same distributed job, and ``shap_value = score(full) - score(without token)``
    per class.  A document of n tokens makes n texts of n - 1 tokens; ``max_len`` limits
    the tokens of a document on request (default: none).  For linear models over TF-IDF use
    ``linear_leave_one_out``.  Output ``(sample, token, class, shap_value)``."""
    from ..functions.text import tokens as tok_fn
    toks = tok_fn(F.col(text))
    if max_len is not None:
        toks = F.slice(toks, 1, max_len)
    base = df.select(key, toks.alias("__toks"))
    full = base.select(key, F.lit(-1).alias("__pos"), F.array_join("__toks", " ").alias(text))
    variants = base.select(key, F.posexplode("__toks").alias("__pos", "__tok"), "__toks").select(
        key, "__pos",
        F.array_join(F.filter("__toks", lambda t, i: i != F.col("__pos")), " ").alias(text))
    scored = scorer(full.unionByName(variants)).select(key, "__pos", "scores")
    ref = scored.filter(F.col("__pos") == -1).select(key, F.col("scores").alias("__full"))
    drops = scored.filter(F.col("__pos") >= 0)
    toks_pos = base.select(key, F.posexplode("__toks").alias("__pos", "token"))
    j = drops.join(ref, key).join(toks_pos, [key, "__pos"])
    diff = F.transform(F.arrays_zip(F.col("__full").alias("f"), F.col("scores").alias("s")),
                       lambda z: z["f"] - z["s"])
    e = j.select(F.col(key).alias("sample"), "token", F.posexplode(diff).alias("__c", "shap_value"))
    cls = (F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("__c") + 1) if classes
           else F.col("__c").cast("int"))
    return e.select("sample", "token", cls.alias("class"), "shap_value")
