"""Binary training output: best-fit-decreasing packing into rows of an id matrix.

Staged records (``row_id``, ``nombre_raw``) become token ids with an end id.
Records longer than a row are cut into whole rows without loss; what is left of
them and all other records are packed window by window, longest first, each into
the fullest row that still has room. A segment tree over capacities finds that row.
Windows are of bounded size, rows stay open from one window to the next up to a
bound, and no shuffle is needed.

A null or empty text is the end id alone. Repeated rows are packed each, null keys
are carried along, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.columns import release, ship
from starloom.llm.token_ids import word_tokenizer
from starloom.llm.words import slices

ROW_TOKENS = 2048
# Tokens sorted at once, and rows that may stay open after a window.
WINDOW_TOKENS = 1_000_000
OPEN_ROWS = 256
OUTPUT_ROWS = 512

Piece = tuple[int | None, int, np.ndarray]


class CapacityTree:
    """Open rows by the room they have; finds the least room that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.filled = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.leaves + room
        while node:
            self.filled[node] += 1
            node >>= 1

    def take(self, need: int) -> int | None:
        """The latest row of the least room of at least ``need``, removed; its room is ``self.found``."""
        node = self.leaves + need
        if not self.filled[node]:
            while node > 1 and (node & 1 or not self.filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.filled[2 * node] else 2 * node + 1
        self.found = node - self.leaves
        while node:
            self.filled[node] -= 1
            node >>= 1
        return self.rows[self.found].pop()


class Packer:
    """Rows under construction of one task."""

    def __init__(self, row_tokens: int):
        self.row_tokens = row_tokens
        self.tree = CapacityTree(row_tokens)
        self.open: dict[int, list[Piece]] = {}
        self.made = 0

    def pack(self, window: list[Piece], last: bool) -> Iterator[list[Piece]]:
        """Best fit of a window's pieces, longest first; rows that are done."""
        for piece in sorted(window, key=lambda p: -len(p[2])):
            row = self.tree.take(len(piece[2]))
            room = self.row_tokens
            if row is None:
                self.made += 1
                row = self.made
                self.open[row] = []
            else:
                room = self.tree.found
            self.open[row].append(piece)
            if room > len(piece[2]):
                self.tree.put(room - len(piece[2]), row)
            else:
                yield self.open.pop(row)
        need = 1
        while len(self.open) > (0 if last else OPEN_ROWS):
            yield self.open.pop(self.tree.take(need))


FIELDS = {
    "sequence_id": pa.int64(), "n_tokens": pa.int32(), "keys": pa.list_(pa.int64()), "starts": pa.list_(pa.int64()),
    "cu_seqlens": pa.list_(pa.int32()), "ids": pa.binary(), "position_ids": pa.binary(),
}


def _pack_task(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, pad_id: int, row_tokens: int) -> Iterator[pa.RecordBatch]:
    tokenizer, packer, out = word_tokenizer(vocabulary), Packer(row_tokens), []
    number = TaskContext.get().partitionId() << 32

    def finish(pieces: list[Piece]) -> None:
        nonlocal number
        lengths = np.array([len(p[2]) for p in pieces], dtype=np.int32)
        used = int(lengths.sum())
        ids = np.full(row_tokens, pad_id, dtype=tokenizer.width)
        ids[:used] = np.concatenate([p[2] for p in pieces])
        ends = np.cumsum(lengths, dtype=np.int32)
        positions = np.zeros(row_tokens, dtype="<u4" if row_tokens > 1 << 16 else "<u2")
        positions[:used] = np.arange(used) - np.repeat(ends - lengths, lengths)
        bounds = [0, *ends.tolist()]
        out.append((number, used, [p[0] for p in pieces], [p[1] for p in pieces], bounds, ids.tobytes(), positions.tobytes()))
        number += 1

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(FIELDS)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FIELDS.values(), strict=True)], list(FIELDS))

    window: list[Piece] = []
    held = 0
    for batch in batches:
        at = 0
        for texts in slices(batch.column("text")):
            keys = batch.column("key").slice(at, len(texts)).to_pylist()
            at += len(texts)
            ids, counts = tokenizer.encode(texts)
            ends = np.cumsum(counts)
            for i, key in enumerate(keys):
                whole = np.append(ids[ends[i] - counts[i] : ends[i]], np.array(end_id, dtype=ids.dtype))
                full = (len(whole) - 1) // row_tokens * row_tokens
                for start in range(0, full, row_tokens):
                    finish([(key, start, whole[start : start + row_tokens])])
                window.append((key, full, whole[full:].copy()))
                held += len(whole) - full
                if held >= WINDOW_TOKENS:
                    for row in packer.pack(window, last=False):
                        finish(row)
                    window, held = [], 0
                if len(out) >= OUTPUT_ROWS:
                    yield flush()
        release()
    for row in packer.pack(window, last=True):
        finish(row)
        if len(out) >= OUTPUT_ROWS:
            yield flush()
    yield flush()


def pack(
    df: DataFrame,
    vocabulary: str,
    key: str = "row_id",
    text: str = "nombre_raw",
    row_tokens: int = ROW_TOKENS,
    end_id: int = 49407,
    pad_id: int = 0,
) -> DataFrame:
    """One row per packed sequence.

    ``ids`` is the row of the id matrix (little-endian, as wide as the vocabulary
    needs), ``cu_seqlens`` the cumulative lengths of its segments from 0,
    ``position_ids`` the position inside the segment (0 in the padding), ``keys``
    and ``starts`` say which record a segment is of and where it starts there.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    task = partial(_pack_task, vocabulary=vocabulary, end_id=end_id, pad_id=pad_id, row_tokens=row_tokens)
    schema = (
        "sequence_id bigint, n_tokens int, keys array<bigint>, starts array<bigint>, cu_seqlens array<int>, "
        "ids binary, position_ids binary"
    )
    return rows.mapInArrow(task, schema)


def write(packed: DataFrame, path: str) -> DataFrame:
    """Write packed rows as Parquet files of binary columns, and read them back."""
    packed.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)
