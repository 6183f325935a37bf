"""Best-fit-decreasing packing into sequences of a fixed length (operator 10).

Documents are encoded by a byte-level BPE, a separator id is appended, and documents
longer than a sequence are cut into whole sequences from the end (the first piece may be
shorter).  Packing needs the pieces' lengths only, and there are at most ``capacity``
different lengths.  So Spark counts the pieces per length, and one best-fit-decreasing
run over that bounded histogram decides for *all* pieces at once: pieces of one length
are interchangeable, and so are open bins with the same room.  Bins live in a segment
tree over remaining capacities; the tightest room that still fits is found in
logarithmic time.  The result is exactly the packing that best-fit decreasing gives on
the full list, and the plan is a short list of (length, rank range) -> (first sequence,
offset) runs whose size depends on the capacity and never on the number of documents.

A piece's rank among those of its length is its number within its task plus the counts
of the tasks before, so no length, however frequent, meets in one task.

Defined cases: a null or empty text is one piece that holds the separator only; every
row is packed on its own, repeated rows and ids included; a null id stays null; a text
that spells an added token of the vocabulary file gets its id; runs of blanks, letters or marks of any length are
encoded; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_tasks, written

CAPACITY = 2048
SEPARATOR = 0


# -- tokens ---------------------------------------------------------------------------------------

@lru_cache(maxsize=4)
def _encoder(path: str, encode_special_tokens: bool = True):
    """An encoder of the byte-level BPE vocabulary file at ``path``; ``encode_special_tokens`` is that of
    ``tokenizers``: True spells the file's added tokens out as ordinary text, False gives their ids.

    The vocabulary is read with ``tokenizers``; the merges run in ``tiktoken``, which gives the same ids
    for byte-level BPE several times faster (tests compare the two)."""
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    # Byte-level vocabularies write the bytes that are not printable as the characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte[c] for c in tok): i for tok, i in vocab.items() if all(c in byte for c in tok)}
    split = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    for t in added:
        ranks.pop(t.encode(), None)
    return tiktoken.Encoding("byte-level", pat_str=split, mergeable_ranks=ranks, special_tokens={} if encode_special_tokens else added)


@lru_cache(maxsize=4)
def _tokenizer(path: str, encode_special_tokens: bool):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = encode_special_tokens
    return tokenizer


def encode(texts: list[str | None], path: str, encode_special_tokens: bool = True) -> Iterator[np.ndarray]:
    enc = _encoder(path, encode_special_tokens)
    for t in texts:
        try:
            ids = enc.encode(t or "", allowed_special="all", disallowed_special=())
        except ValueError:  # its splitter gives up on runs of about a million blanks
            ids = _tokenizer(path, encode_special_tokens).encode(t, add_special_tokens=False).ids
        yield np.array([*ids, SEPARATOR], dtype="<u4")


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only longer ones are cut."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, part, nth`` (and ``ids``).

    ``part`` is the task and ``nth`` counts its pieces of equal length from 0; they hold for one written
    table (a repeated task may number its rows anew)."""
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def task(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            column = batch.column("text")
            for low in range(0, batch.num_rows, 256):
                rows, out, flat = [], [], []
                for i, ids in enumerate(encode(column.slice(low, 256).to_pylist(), tokenizer, False), low):
                    for k, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                        ids_of = ids[start:start + length]
                        rows.append(i)
                        out.append((k, start, length, zlib.crc32(ids_of.tobytes())))
                        if with_ids:
                            flat.append(ids_of)
                cols = [pa.array(c, pa.int64()) for c in zip(*out)]
                cols[0] = cols[0].cast(pa.int32())
                nth = []
                for _, _, length, _ in out:
                    nth.append(seen[length])
                    seen[length] += 1
                cols += [pa.array([part] * len(out), pa.int64()), pa.array(nth, pa.int64())]
                arrays = [batch.column("doc_id").take(pa.array(rows)), *cols]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(f) for f in flat])])
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                           pa.array(np.concatenate(flat).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part long, nth long" + ", ids array<int>" * with_ids
    return in_tasks(narrow, task, schema)


# -- packing --------------------------------------------------------------------------------------

class Rooms:
    """A segment tree over remaining capacities: how many open bins have each room, and the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.used = [False] * (2 * self.size)

    def set(self, room: int, open_: bool) -> None:
        i = room + self.size
        self.used[i] = open_
        while i > 1:
            i //= 2
            self.used[i] = self.used[2 * i] or self.used[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that some bin has."""
        i = need + self.size
        if self.used[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.used[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.used[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Runs of each length, and the number of bins.

    ``counts``: pieces per length.  A run ``(rank, n, bin, offset)`` puts the pieces of ranks rank..rank+n-1
    of that length at ``offset`` of the bins bin..bin+n-1.  Bins are handled as ranges of neighbouring
    numbers with the same room."""
    rooms: dict[int, list[tuple[int, int]]] = {}
    tree, runs, bins = Rooms(capacity), {}, 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, left, out = 0, counts[length], []

        def keep(room: int, first: int, n: int) -> None:
            if n and room:
                rooms.setdefault(room, []).append((first, n))
                tree.set(room, True)

        while left:
            room = tree.tightest(length)
            if room is None:  # no open bin fits: new bins take as many of this length as they hold
                each = capacity // length
                full, more = divmod(left, each)
                for k in range(each):
                    if n := full + (k < more):
                        out.append((rank, n, bins, k * length))
                        rank += n
                keep(capacity - each * length, bins, full)
                keep(capacity - more * length, bins + full, 1 if more else 0)
                bins += full + (more > 0)
                break
            first, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                tree.set(room, False)
            take = min(n, left)
            keep(room, first + take, n - take)
            out.append((rank, take, first, capacity - room))
            keep(room - length, first, take)
            rank += take
            left -= take
        runs[length] = out
    return runs, bins


def rank_pieces(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces with ``rank``, their number among the pieces of equal length, and the written (length, n) histogram.

    ``pieces`` is a written table with ``part`` and ``nth``, the number among the pieces of equal length of that part;
    the ranks add each part's offset, so no length is gathered anywhere."""
    counts = written(pieces.groupBy("part", "length").agg(F.max("nth").alias("last")), "pack-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base")
    return ranked, counts.groupBy("length").agg(F.sum(F.col("last") + 1).alias("n"))


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with ``length`` of 1 to ``capacity``, ``part`` and ``nth``) plus ``sequence_id``
    and ``offset``.  The histogram sent to the driver has at most ``capacity`` rows."""
    ranked, histogram = rank_pieces(pieces)
    runs, _ = best_fit_decreasing({r["length"]: r["n"] for r in histogram.collect()}, capacity)
    table = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in runs.items()}
    names = [c for c in pieces.columns if c not in ("part", "nth")]
    types = dict(pieces.dtypes)

    def task(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                first, _, bin_, offset = table[int(k)]
                run = np.searchsorted(first, rank[at], "right") - 1
                seq[at] = bin_[run] + rank[at] - first[run]
                off[at] = offset[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(seq), pa.array(off)],
                                             names=[*names, "sequence_id", "offset"])

    schema = ", ".join([*(f"`{n}` {types[n]}" for n in names), "sequence_id long, offset long"])
    return in_tasks(ranked.select(*names, "rank"), task, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id",
                   text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``)."""
    pieces = written(token_pieces(docs, tokenizer, capacity, doc_id, text, with_ids), "pack-pieces")
    return best_fit_pack(pieces, capacity)
