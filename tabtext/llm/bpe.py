"""Byte-level BPE encoding and decoding by DuckDB recursive queries per partition (operator 12).

A task splits each whole text at the pattern's matches, keeps every distinct piece once, and encodes the pieces that
are no token themselves in an in-memory DuckDB: a recursive query holds each piece as its tokens, spreads them to
(piece, position) rows, joins neighbours with the merge table (every split of a token into two tokens, ranked by the
token's id), contracts each piece's leftmost pair of minimum rank, and ends when no pair is left.  A document's ids are
its pieces' ids in order.  Decoding joins (document, position, id) rows with the vocabulary and concatenates the bytes
in an ordered aggregation.  Pieces over ``RECURSIVE_BYTES`` bytes are contracted by the same rule from a heap:
the recursion would read such a piece again for every contraction, which is quadratic.

Spark only deals out the documents: nothing is shuffled.  A task holds one slice of about ``SLICE_BYTES`` (one
document at least), the vocabulary, and a cache of encoded pieces that starts anew at ``CACHE_PIECES``.

Defined cases: a null text counts as empty and has no ids; texts that spell special tokens are ordinary text; runs of
blanks or letters of any length are encoded; repeated rows are encoded one by one; a null id stays null; further
columns are ignored; an empty table gives an empty result.  Decoding a null list of ids, or one with an id outside
the vocabulary, gives null.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_tasks
from .textscan import CONTINUATION, text_runs

# Fixed value: the split pattern of the vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SLICE_BYTES = 4 << 20
RECURSIVE_BYTES = 256
#: Pieces of one recursive query.
QUERY_PIECES = 20_000
CACHE_PIECES = 1 << 19
DUCK = {"threads": 1, "memory_limit": "400MB"}

OTHER, LETTER, NUMBER, BLANK = range(4)


# -- splitting ------------------------------------------------------------------------------------

@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The pattern's class of every code point."""
    import regex
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.zeros(0x110000, np.uint8)
    for kind, of in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for run in regex.findall(of, every):
            table[np.frombuffer(run.encode("utf-32-le"), np.uint32)] = kind
    return table


def split(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """First byte of every match of ``PATTERN`` in each document of a run (UTF-8 bytes and document offsets)."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    byte_of = np.flatnonzero(~CONTINUATION[data])
    kind = _classes()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)  # of a document
    first[np.searchsorted(byte_of, offs)] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last blank before a word starts a piece, and a space takes the word in
    last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~first[1:n])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # an apostrophe that starts a piece takes in the letters of a contraction
    mark = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & ~first[1:n])
    one, two = points[mark + 1], points[np.minimum(mark + 2, n - 1)]
    two = np.where(first[np.minimum(mark + 2, n)], 0, two)
    letter = {c: ord(c) for c in "stmdrevl"}
    short = np.isin(one, [letter[c] for c in "stmd"])
    long_ = ((one == letter["r"]) | (one == letter["v"])) & (two == letter["e"]) | (one == letter["l"]) & (two == letter["l"])
    for at, size in ((mark[short], 1), (mark[long_], 2)):
        start[at + 1] = False
        after = at + 1 + size
        after = after[after < n]
        start[after[kind[after] == LETTER]] = True
    return byte_of[start]


# -- the vocabulary -------------------------------------------------------------------------------

class Vocabulary:
    """The ranks of a .tiktoken file, its merge table and a DuckDB connection that holds both."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, into = [], [], []
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    into.append(i)
        self.merges = {(a, b): i for a, b, i in zip(left, right, into)}
        self.duck = duckdb.connect(config=DUCK)
        merges = pa.table({"pair": np.array(left, np.int64) << 32 | np.array(right, np.int64), "rank": np.array(into, np.int64)})
        tokens = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "bytes": [t.decode("latin-1") for t in self.ranks]})
        for name, rows in (("merges", merges), ("tokens", tokens)):
            self.duck.register("given", rows)
            self.duck.execute(f"CREATE TABLE {name} AS SELECT * FROM given ORDER BY 1")
            self.duck.unregister("given")
        self.cache: dict[bytes, np.ndarray] = {}

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each of the distinct ``pieces``."""
        if len(self.cache) + len(pieces) > CACHE_PIECES:
            self.cache = {}
        known = self.cache
        todo = [p for p in pieces if p not in known]
        recurse = []
        for p in todo:
            if (i := self.ranks.get(p)) is not None:
                known[p] = np.array([i], "<u4")
            elif len(p) <= RECURSIVE_BYTES:
                recurse.append(p)
            else:
                known[p] = np.array(heap_contract(self.byte_id[np.frombuffer(p, np.uint8)].tolist(), self.merges), "<u4")
        for low in range(0, len(recurse), QUERY_PIECES):
            some = recurse[low:low + QUERY_PIECES]
            known.update(zip(some, self.contract(some)))
        return [known[p] for p in pieces]

    def contract(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of the pieces by the recursive query."""
        ends = np.cumsum([0, *map(len, pieces)])
        ids = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        self.duck.register("pieces", pa.table({
            "piece": pa.array(np.arange(len(pieces)), pa.int32()),
            "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))}))
        out = self.duck.sql(CONTRACT).to_arrow_table()["ids"].combine_chunks()
        self.duck.unregister("pieces")
        offs, flat = out.offsets.to_numpy(), out.values.to_numpy().astype("<u4")
        return [flat[a:b] for a, b in zip(offs[:-1], offs[1:])]

    def decode(self, doc: np.ndarray, ids: np.ndarray, n: int) -> list[bytes | None]:
        """The bytes of documents 0 to n-1; ``doc`` and ``ids`` are rows in any order within which positions count."""
        self.duck.register("rows", pa.table({"doc": pa.array(doc, pa.int32()), "pos": pa.array(np.arange(len(ids)), pa.int32()),
                                             "id": pa.array(ids, pa.int64())}))
        out = self.duck.sql(DECODE).fetchall()
        self.duck.unregister("rows")
        found: list[bytes | None] = [b""] * n
        for d, text, whole in out:
            found[d] = text.encode("latin-1") if whole else None
        return found


CONTRACT = """
WITH RECURSIVE state(piece, ids) AS (
  SELECT piece, ids FROM pieces
  UNION ALL
  SELECT s.piece, s.ids[:best.pos - 1] || [best.rank::INT] || s.ids[best.pos + 2:]
  FROM (
    SELECT piece, min(rank * 65536 + pos) >> 16 AS rank, min(rank * 65536 + pos) & 65535 AS pos
    FROM (SELECT piece, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, generate_subscripts(ids[2:], 1) AS pos FROM state) t
    JOIN merges ON pair = (t.l::BIGINT << 32) | t.r
    GROUP BY piece) best
  JOIN state s ON s.piece = best.piece)
SELECT piece, arg_min(ids, len(ids)) AS ids FROM state GROUP BY piece ORDER BY piece"""

DECODE = """
SELECT doc, string_agg(bytes, '' ORDER BY pos), count(*) = count(bytes)
FROM rows LEFT JOIN tokens USING (id) GROUP BY doc"""


def heap_contract(ids: list[int], merges: dict[tuple[int, int], int]) -> list[int]:
    """The same rule for one long piece: leftmost pair of minimum rank first, from a heap over a linked list."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := merges.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
            continue  # of tokens that are gone
        ids[i], alive[j], after[i] = rank, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := merges.get((ids[x], ids[y]))) is not None:
                heapq.heappush(heap, (r, x, ids[x], ids[y]))
    return [t for t, live in zip(ids, alive) if live]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a worker process, kept for its next tasks."""
    return Vocabulary(path)


# -- documents ------------------------------------------------------------------------------------

def encode_run(voc: Vocabulary, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets of the documents in them) of a run of texts."""
    begin = split(data, offs)
    if not len(begin):
        return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
    ends = np.append(begin, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    each = voc.encode(coded.dictionary.to_pylist())
    size = np.array([len(e) for e in each], np.int64)
    flat, at = np.concatenate(each), np.cumsum(size) - size
    code = coded.indices.to_numpy()
    n = size[code]
    stop = np.cumsum(n)
    ids = flat[np.repeat(at[code] - (stop - n), n) + np.arange(stop[-1])]
    return ids, np.concatenate([[0], stop])[np.searchsorted(begin, offs)]


def _runs(batches, path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(document ids, token ids, offsets) of runs of rows ``doc_id, text``."""
    voc = vocabulary(path)
    for batch in batches:
        for low, data, offs in text_runs(batch.column(1), SLICE_BYTES):
            ids, ends = encode_run(voc, data, offs)
            yield batch.column(0).slice(low, len(offs) - 1), ids, ends


def _narrow(docs: DataFrame, doc_id: str, other: str, kind: str) -> tuple[DataFrame, str]:
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{other}`").cast(kind).alias("value"))
    return narrow, narrow.schema["doc_id"].dataType.simpleString()


def bpe_encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, ids`` (array of int) by the ranks in the .tiktoken file at ``path``."""
    narrow, kind = _narrow(docs, doc_id, text, "string")

    def task(batches):
        for keys, ids, ends in _runs(batches, path):
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([keys, lists], names=["doc_id", "ids"])

    return in_tasks(narrow, task, f"doc_id {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per document: ``doc_id, bytes`` (binary) of the ids."""
    narrow, kind = _narrow(encoded, doc_id, ids, "array<int>")

    def task(batches):
        voc = vocabulary(path)
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            size = np.diff(lists.offsets.to_numpy())
            size[lists.is_null().to_numpy(zero_copy_only=False)] = 0
            doc = np.repeat(np.arange(len(lists)), size)
            found = voc.decode(doc, flat.fill_null(-1).to_numpy(zero_copy_only=False), len(lists))
            out = [None if not v else f for v, f in zip(lists.is_valid().to_pylist(), found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return in_tasks(narrow, task, f"doc_id {kind}, bytes binary")


def bpe_digest(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    narrow, kind = _narrow(docs, doc_id, text, "string")

    def task(batches):
        voc = vocabulary(path)
        for keys, ids, ends in _runs(batches, path):
            size = np.diff(ends)
            back = voc.decode(np.repeat(np.arange(len(size)), size), ids, len(size))
            sha = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([keys, pa.array(size, pa.int64()), pa.array(sha), pa.array(
                [hashlib.sha256(b).hexdigest() for b in back])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_tasks(narrow, task, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
