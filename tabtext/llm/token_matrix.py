"""Token ids as packed binary matrices (operator 7).

Every task encodes its documents, cuts those longer than a sequence into pieces without losing an id, and packs blocks of
pieces by best-fit decreasing: a segment tree over the open sequences' remaining room finds the tightest sequence that
still fits in logarithmic time.  A block becomes one binary file: the id matrix (rows of ``capacity`` ids), the cumulative
segment lengths of each row and the position ids' resets.  Blocks are closed at a fixed number of ids, so memory and file
size stay the same at every input size, and no id crosses the network.  The result says where each piece lies.

File layout, little-endian: eight 64-bit numbers (magic, rows, capacity, segments, bytes of an id, 0...), the matrix
(unsigned ids of 16 bits where the vocabulary fits, else of 32; free places 0), ``cu_seqlens`` (row offsets first: rows + 1
64-bit numbers, then for each row the 32-bit ends of its segments), ``resets`` (for each row the 32-bit places where its
position ids restart at 0, one a segment).

Defined cases: a null or empty text is one piece that holds the separator only; every row is packed on its own, repeated
rows included; runs of blanks, letters or marks of any length are encoded; a null id stays null; further columns are ignored; an empty table gives an empty result and no file.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_tasks, written
from .files import read_stream, shared_folder, write_bytes
from .packing import CAPACITY, encode, pieces_of

MAGIC = 0x314B434150
#: A block is closed when it holds this many ids (8 MB of 16-bit ids).
BLOCK_IDS = 4_000_000


class OpenRows:
    """A max segment tree over the rows of a block, ordered by room: the tightest row that fits, in logarithmic time.

    Leaves are rooms (0 to capacity) with the stack of rows that have them; a node knows whether a row is below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = np.zeros(2 * self.size, np.int64)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i //= 2

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the tightest row with room for ``need``; it is taken out."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and not (i % 2 == 0 and self.count[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def pack_block(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, offset) of each piece and the number of rows."""
    row, offset, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    open_rows = OpenRows(capacity)
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        found = open_rows.take(need)
        if found is None:
            found, n = (capacity, n), n + 1
        room, row[i] = found
        offset[i] = capacity - room
        if room > need:
            open_rows.put(room - need, int(row[i]))
    return row, offset, n


def id_bytes(tokenizer: str) -> int:
    """2 where every id of the vocabulary file fits into 16 bits, else 4."""
    from tokenizers import Tokenizer
    return 2 if Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def block_bytes(pieces: list[np.ndarray], row: np.ndarray, offset: np.ndarray, rows: int, capacity: int, width: int) -> list[bytes]:
    matrix = np.zeros((rows, capacity), f"<u{width}")
    for p, r, o in zip(pieces, row, offset):
        matrix[r, o:o + len(p)] = p
    order = np.lexsort((offset, row))
    ends = (offset + np.array([len(p) for p in pieces]))[order].astype("<i4")
    resets = offset[order].astype("<i4")
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype("<i8")
    head = np.array([MAGIC, rows, capacity, len(pieces), width, 0, 0, 0], "<i8")
    return [head.tobytes(), matrix.tobytes(), first.tobytes(), ends.tobytes(), resets.tobytes()]


def read_block(uri: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(id matrix, cumulative segment lengths of each row from 0, position ids that restart in each segment)."""
    with read_stream(uri) as s:
        data = s.read()
    head = np.frombuffer(data, "<i8", 8)
    if head[0] != MAGIC:
        raise ValueError(f"{uri} is not a block of packed ids")
    rows, capacity, segments, width = (int(x) for x in head[1:5])
    at = 64
    matrix = np.frombuffer(data, f"<u{width}", rows * capacity, at).reshape(rows, capacity)
    at += matrix.nbytes
    first = np.frombuffer(data, "<i8", rows + 1, at)
    ends = np.frombuffer(data, "<i4", segments, at + first.nbytes)
    resets = np.frombuffer(data, "<i4", segments, at + first.nbytes + ends.nbytes)
    cu, positions = [], np.zeros((rows, capacity), np.int64)
    for r in range(rows):
        mine = slice(first[r], first[r + 1])
        cu.append(np.concatenate([[0], ends[mine]]))
        for a, b in zip(resets[mine], ends[mine]):
            positions[r, a:b] = np.arange(b - a)
    return matrix, cu, positions


def write_matrices(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, block_ids: int = BLOCK_IDS,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files and returns one row per piece:
    ``doc_id, piece, start, length, ids_crc32, file, row, offset``."""
    folder, width = shared_folder(docs.sparkSession, "token-matrices"), id_bytes(tokenizer)
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def closed(ids: pa.Array, meta: list[tuple], pieces: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(p) for p in pieces])
        row, offset, n = pack_block(lengths, capacity)
        uri = write_bytes(folder, "block", block_bytes(pieces, row, offset, n, capacity, width))
        doc, piece, start, crc = zip(*meta)
        cols = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()),
                pa.array(crc, pa.int64()), pa.array([uri] * len(row)), pa.array(row), pa.array(offset)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), *cols],
                                          names=["doc_id", "piece", "start", "length", "ids_crc32", "file", "row", "offset"])

    def task(batches):
        known, meta, pieces, held, base = [], [], [], 0, 0
        for batch in batches:
            column = batch.column("text")
            known.append(batch.column("doc_id"))
            for low in range(0, batch.num_rows, 256):
                for i, ids in enumerate(encode(column.slice(low, 256).to_pylist(), tokenizer, False), low):
                    for k, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                        p = ids[start:start + length]
                        meta.append((base + i, k, start, zlib.crc32(p.tobytes())))
                        pieces.append(p.copy())
                        held += length
                    if held >= block_ids:
                        yield closed(pa.concat_arrays(known), meta, pieces)
                        meta, pieces, held = [], [], 0
            base += batch.num_rows
            if not meta:
                known, base = [], 0
            # Ids of earlier batches stay for the pieces that are not yet written; they are 8 bytes a document.
        if meta:
            yield closed(pa.concat_arrays(known), meta, pieces)

    schema = (f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, file string, row long, offset long")
    return written(in_tasks(narrow, task, schema), "token-manifest")
