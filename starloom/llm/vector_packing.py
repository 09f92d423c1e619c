"""Vector bin packing of token sequences for instruction data.

Staged records (``row_id``, ``nombre_raw``, and a prompt column if there is one)
become pieces of sequences under three limits at once: tokens, segments and
loss-bearing tokens. Tokens of the prompt, and the first of a record, bear no loss.

Packing is done inside each task over a pool of bounded size, without a shuffle:
the next piece is the one that fits with the largest dot product of its needs and
what is left, each as a share of its limit. If none fits whole, the one with the
largest product is cut, so a sequence is full unless it is the last of its task or
the segment or loss limit stops it. Every id lies in exactly one piece.

A null or empty text is the end id alone; a null prompt is an empty one. Repeated
rows are packed each. Null keys are carried along. Other columns are not read.
Sequence ids are unique: the task's partition above bit 32, a counter below.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.columns import release, ship
from starloom.llm.token_ids import word_tokenizer
from starloom.llm.words import slices, texts_of

POOL = 512
OUTPUT_BYTES = 4_000_000


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


@dataclass
class Item:
    """What is left of a record: its ids from ``start`` on, of which those from ``free`` on bear loss."""

    key: int | None
    ids: np.ndarray
    start: int
    free: int
    total: int

    def loss(self, length: int) -> int:
        return max(0, length - max(0, self.free - self.start))

    def cut(self, length: int) -> tuple[int | None, int, int, int, int, bytes]:
        """Take the first ``length`` ids off, as an output piece."""
        piece = (self.key, self.start, length, self.total, self.loss(length), self.ids[:length].astype("<u4").tobytes())
        self.ids, self.start = self.ids[length:], self.start + length
        return piece


class Packer:
    """Fills one sequence after another from a pool of items."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.most = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
        self.items: list[Item | None] = [None] * POOL
        self.needs = np.full((POOL, 3), np.inf)
        self.free = list(range(POOL))

    def _place(self, slot: int) -> None:
        item = self.items[slot]
        self.needs[slot] = (len(item.ids), 1, item.loss(len(item.ids)))

    def _drop(self, slot: int) -> None:
        self.items[slot] = None
        self.needs[slot] = np.inf
        self.free.append(slot)

    def add(self, item: Item) -> None:
        slot = self.free.pop()
        self.items[slot] = item
        self._place(slot)

    def sequence(self) -> list[tuple]:
        """The pieces of the next sequence."""
        left, pieces = self.most.copy(), []
        while len(self.free) < POOL and left[0] >= 1 and left[1] >= 1:
            weight = left / self.most
            held = np.isfinite(self.needs[:, 0])
            product = np.where(held, np.where(held[:, None], self.needs, 0.0) @ (weight / self.most), -1.0)
            fits = held & (self.needs <= left).all(axis=1)
            if fits.any():
                slot = int(np.argmax(np.where(fits, product, -1.0)))
                length = len(self.items[slot].ids)
            else:  # cut the best one to what is left
                slot = int(np.argmax(product))
                item = self.items[slot]
                length = min(len(item.ids), int(left[0]), max(0, item.free - item.start) + int(left[2]))
                if length < 1:
                    break
            item = self.items[slot]
            pieces.append(item.cut(length))
            left -= (length, 1, pieces[-1][4])
            if len(item.ids):
                self._place(slot)
            else:
                self._drop(slot)
        return pieces


def _records(batch: pa.RecordBatch, vocabulary: str, end_id: int, prompted: bool) -> Iterator[Item]:
    tokenizer = word_tokenizer(vocabulary)
    at = 0
    for texts in slices(batch.column("text")):
        part = batch.slice(at, len(texts))
        at += len(texts)
        ids, counts = tokenizer.encode(texts)
        before, before_counts = tokenizer.encode(texts_of(part.column("prompt"))) if prompted else (ids[:0], np.zeros_like(counts))
        ends, before_ends = np.cumsum(counts), np.cumsum(before_counts)
        for i, key in enumerate(part.column("key").to_pylist()):
            own = before[before_ends[i] - before_counts[i] : before_ends[i]]
            whole = np.concatenate((own, ids[ends[i] - counts[i] : ends[i]], np.array([end_id], dtype=ids.dtype)))
            yield Item(key, whole, 0, max(1, len(own)), len(whole))


FIELDS = {
    "key": pa.int64(), "start": pa.int64(), "length": pa.int64(), "record_tokens": pa.int64(), "loss_tokens": pa.int64(),
    "ids": pa.binary(), "sequence_id": pa.int64(), "offset": pa.int64(),
}


def _pack_task(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, limits: Limits, prompted: bool) -> Iterator[pa.RecordBatch]:
    packer, rows, held = Packer(limits), [], 0
    number = TaskContext.get().partitionId() << 32

    def emit(pieces: list[tuple]) -> None:
        nonlocal number, held
        offset = 0
        for piece in pieces:
            rows.append((*piece, number, offset))
            offset += piece[2]
        held += 4 * offset + 64 * len(pieces)
        number += 1

    def flush() -> pa.RecordBatch:
        nonlocal held
        columns = list(zip(*rows, strict=True)) or [[]] * len(FIELDS)
        rows.clear()
        held = 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FIELDS.values(), strict=True)], list(FIELDS))

    for batch in batches:
        for item in _records(batch, vocabulary, end_id, prompted):
            while len(item.ids) > limits.tokens and item.loss(limits.tokens) <= limits.loss_tokens:
                emit([item.cut(limits.tokens)])
            item.ids = item.ids.copy()
            packer.add(item)
            while not packer.free:
                emit(packer.sequence())
            if held >= OUTPUT_BYTES:
                yield flush()
        release()
    while len(packer.free) < POOL:
        emit(packer.sequence())
        if held >= OUTPUT_BYTES:
            yield flush()
    yield flush()


def pack(
    df: DataFrame,
    vocabulary: str,
    key: str = "row_id",
    text: str = "nombre_raw",
    prompt: str | None = None,
    limits: Limits = Limits(),
    end_id: int = 1,
) -> DataFrame:
    """One row per piece: the key, ``start``, ``length``, ``record_tokens``, ``loss_tokens``, ``ids`` (32-bit
    little-endian), ``sequence_id`` and ``offset``. ``vocabulary`` is a file of the ``tokenizers`` library.
    """
    if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
        raise ValueError("every limit must be at least 1")
    ship(df.sparkSession)
    rows = df.select(
        F.col(key).cast("bigint").alias("key"),
        F.col(text).cast("string").alias("text"),
        *([F.col(prompt).cast("string").alias("prompt")] if prompt else []),
    )
    task = partial(_pack_task, vocabulary=vocabulary, end_id=end_id, limits=limits, prompted=prompt is not None)
    schema = "key bigint, start bigint, length bigint, record_tokens bigint, loss_tokens bigint, ids binary, sequence_id bigint, offset bigint"
    return rows.mapInArrow(task, schema).withColumnRenamed("key", key)
