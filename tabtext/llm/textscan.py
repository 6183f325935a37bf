"""Vectorised scans of whole texts inside Arrow batches.

Every function works on the UTF-8 bytes of a run of documents (``data``) and
their boundaries (``offs``, one more than documents), so the per-document cost
is a few numpy passes over its bytes.  Words are ``[^\\x20\\x09-\\x0D]+``; all
separators are ASCII, so multi-byte characters always belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_M1, _M2, _GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = (h ^ (h >> U64(30))) * _M1
    h = (h ^ (h >> U64(27))) * _M2
    return h ^ (h >> U64(31))


def _byte_table(fold_case: bool) -> np.ndarray:
    t = mix((np.arange(256, dtype=U64) + U64(1)) * _GOLD)
    if fold_case:
        t[65:91] = t[97:123]
    return t


EXACT, FOLDED = _byte_table(False), _byte_table(True)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
CONTINUATION = (np.arange(256) & 0xC0) == 0x80
BASE = 0x9E6C63D0876A9A35  # odd, so that it has an inverse modulo 2**64
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, U64(b))
            p[0] = U64(1)
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def text_runs(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ob, db = column.buffers()
    offs = np.frombuffer(ob, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(db, np.uint8) if db is not None and db.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
        yield i, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) byte of every word, and each document's first word number (one more than documents)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = IS_WORD[data]
    edge = w.copy()
    edge[1:] &= ~w[:-1]
    heads = offs[:-1][offs[:-1] < n]
    edge[heads] = w[heads]
    starts = np.flatnonzero(edge)
    edge = w.copy()
    edge[:-1] &= ~w[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    edge[tails] = w[tails]
    ends = np.flatnonzero(edge) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = EXACT) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(starts):
        return np.zeros(0, U64)
    pw, inv = _powers(len(data) + 1)
    v = table[data]
    v *= pw[:len(data)]
    s = np.empty(len(data) + 1, U64)
    s[0] = 0
    np.cumsum(v, out=s[1:])
    return mix((s[ends] - s[starts]) * inv[starts] + (ends - starts).astype(U64) * _GOLD)


_COEF = mix((np.arange(64, dtype=U64) + U64(77)) * _GOLD) | U64(1)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k neighbouring word hashes (runs over document edges included)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n] * _COEF[0]
    for i in range(1, k):
        out += h[i:i + n] * _COEF[i]
    return mix(out + U64(k))


def per_doc(positions: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of the sorted positions fall into each document."""
    return np.diff(np.searchsorted(positions, offs))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more; is it a later occurrence of an earlier key."""
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        later[order[1:]] = same
        any_[order[1:]] = same
        any_[order[:-1]] |= same
    return any_, later


def doc_of(wb: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(wb) - 1), np.diff(wb))


def repeat_words(h: np.ndarray, wb: np.ndarray, k: int = 8) -> np.ndarray:
    """Per document: words in windows of k words that occur twice or more in it, the first included."""
    doc = doc_of(wb)
    win = window_hashes(h, k)
    hit = np.zeros(len(h), np.int32)
    inside = doc[:len(win)] == doc[k - 1:] if len(win) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    any_, _ = repeated(win[at] ^ mix(doc[at].astype(U64) + _GOLD))
    hit[at[any_]] = 1
    c = np.concatenate([[0], np.cumsum(hit)])
    i = np.arange(len(h))
    covered = np.flatnonzero(c[i + 1] > c[np.maximum(0, i + 1 - k)])
    return per_doc(covered, wb)


def lines(data: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of every \\n-split line that has a word."""
    nl = np.flatnonzero(data == 10)
    a = np.sort(np.concatenate([offs[:-1], nl + 1]))
    b = np.sort(np.concatenate([nl, offs[1:]]))
    has = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    a, b = a[has], b[has]
    return np.searchsorted(offs, a, "right") - 1, a, b


def dup_lines(data: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document: lines equal to an earlier line of it."""
    _, later = repeated(span_hashes(data, a, b) ^ mix(doc.astype(U64) + _GOLD))
    return np.bincount(doc[later], minlength=n_docs)


def lut(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


def count_bytes(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> np.ndarray:
    return per_doc(np.flatnonzero(table[data]), offs)
