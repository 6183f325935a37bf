"""Text column functions (FEA-1, FEA-2, FUN-7, FUN-8, FUN-13).

All of them are JVM-side expressions: regex extraction, higher-order array
functions and ``size``; no Python runs per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of two or more letters, digits or underscores
# (the Unicode reading of the vectorizer's default ``\b\w\w+\b``), lower-cased.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"

# English stop words. This is Spark ML's own default English list
# (``StopWordsRemover.loadDefaultStopWords('english')``), written out so that the
# Spark jobs and the SQL oracle use the very same words.
_ENGLISH = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom this
that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll
they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't
wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
"""

# A contraction never survives the word pattern; its pieces of two characters or more do, and are the stop words.
ENGLISH_STOP_WORDS = tuple(sorted({p for w in _ENGLISH.split() for p in re.findall(r"\w{2,}", w)}))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text, mode: str = "word", n: int = 2) -> Column:
    """FEA-1: ``array<string>`` of tokens.

    ``word``: lower-cased runs of ``WORD_PATTERN``.  ``char_ngram``: character
    n-grams of the lower-cased text with blanks removed (for unspaced scripts).
    """
    t = F.lower(_col(text))
    if mode == "word":
        return F.regexp_extract_all(t, F.lit(WORD_PATTERN), 0)
    if mode == "char_ngram":
        # Characters (code points) once, then n-grams by zipping shifted slices:
        # O(length).  (``substring`` at growing offsets rescans the UTF-8 text, and
        # an array expression referenced inside a lambda is re-evaluated per element.)
        s = F.regexp_replace(t, r"[ \t\n\r\f\x0B]+", "")
        chars = F.regexp_extract_all(s, F.lit("(?s)."), 0)
        m = F.size(chars) - n + 1
        grams = F.slice(chars, 1, F.greatest(m, F.lit(1)))
        for k in range(1, n):
            grams = F.zip_with(grams, F.slice(chars, k + 1, F.greatest(m, F.lit(1))),
                               lambda a, b: F.concat(a, b))
        return F.when(F.size(chars) < n, F.array().cast("array<string>")).otherwise(grams)
    raise ValueError(f"unknown token mode {mode!r}")


def remove_stop(toks, stop_words=ENGLISH_STOP_WORDS, min_len: int = 2) -> Column:
    """FEA-2: drop stop words and short tokens, keeping order and repeats
    (``array_except`` would de-duplicate).  The word list becomes an ``InSet``
    (hash lookup) inside the lambda, not a scan of a literal array per token."""
    words = sorted(set(stop_words)) if stop_words else []

    def keep(t):
        cond = F.length(t) >= min_len
        if words:
            cond = cond & ~t.isin(words)
        return cond
    return F.filter(_col(toks), keep)


def strip_blanks(token) -> Column:
    """FUN-7: remove every blank inside a token (literal replace)."""
    return F.replace(_col(token), F.lit(" "), F.lit(""))


def join_tokens(toks, sep: str = " ") -> Column:
    """FUN-8: tokens joined with blanks."""
    return F.array_join(_col(toks), sep)


def n_tokens(toks) -> Column:
    """FUN-13: number of tokens."""
    return F.size(_col(toks))


def stop_words_sql(stop_words=ENGLISH_STOP_WORDS) -> str:
    """SQL list literal of the stop words (oracle side)."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(stop_words))) + "]"
