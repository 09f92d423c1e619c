"""Words of texts as numpy codes, the common ground of the operators on text.

A word is a run of characters other than space, tab, line feed, vertical tab,
form feed and carriage return. The words of an Arrow column are split and
numbered in C++; Python sees each distinct word of a slice once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are worked on in runs of about this many bytes, so an Arrow batch of very
# long texts never needs a multiple of its own size at once.
SLICE_BYTES = 6_000_000


def texts_of(values: pa.Array) -> pa.Array:
    """A text column with null as the empty text, copied: text kernels misread slices that start inside a buffer."""
    return pa.array([text or "" for text in values.to_pylist()], pa.large_string())


def slices(values: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts of a column in runs of about ``most`` bytes; one longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(values.cast(pa.string())), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(values):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts_of(values.slice(start, end - start))
        start = end


@dataclass(frozen=True)
class Words:
    """All words of some texts: a code for each, how many each text has, and the distinct words by code."""

    codes: np.ndarray
    counts: np.ndarray
    distinct: pa.Array

    @property
    def bounds(self) -> np.ndarray:
        return boundaries(self.counts)


def words_of(texts: pa.Array) -> Words:
    for blank in "\t\n\v\f\r":
        texts = pc.replace_substring(texts, blank, " ")
    parts = pc.split_pattern(texts, " ")
    flat, counts = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():  # white space at an end or in a row gives empty parts
        counts = group_sums(keep.astype(np.int64), counts)
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), counts, coded.dictionary)


def boundaries(counts: np.ndarray) -> np.ndarray:
    """Start of each group, and the end of the last one."""
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``start .. start + length - 1`` of every pair, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def group_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each group; groups lie one after another and may be empty."""
    out = np.zeros((len(counts), *values.shape[1:]), dtype=values.dtype)
    filled = counts > 0
    if filled.any():
        out[filled] = np.add.reduceat(values, boundaries(counts)[:-1][filled], axis=0)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every task."""
    words = words.cast(pa.large_binary())
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    within = ranges(np.zeros(len(words), dtype=np.int64), lengths).astype(np.uint64)
    spread = mixed((within << np.uint64(8)) + data + np.uint64(1))
    return mixed(group_sums(spread, lengths) + lengths.astype(np.uint64))


def combined(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` neighbours; the order of the neighbours counts."""
    size = max(0, len(hashes) - width + 1)
    out = np.zeros(size, dtype=np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + size] + np.uint64(1))
    return out
