"""Shingle sets of texts and their SuperMinHash signatures, with numpy.

The j-th round gives every element of a set the value j plus a fraction, at the
j-th place of a permutation of its own; a signature holds the smallest value per
place. Values of one element at different places are thus correlated by rank,
which lowers the variance, and the rounds stop as soon as no place holds a value
of a later round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from starloom.llm.words import boundaries, combined, word_hashes, words_of

WIDTH = 5
# Elements worked on at once; bounds the memory for their permutations.
ELEMENTS = 40_000

_WORD = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different runs of ``width`` words, ascending per text, and how many each text has.

    A-Z count as a-z. A text of fewer words has one run of all of them; a text without a word has none.
    """
    words = words_of(pc.ascii_lower(texts))
    hashes, bounds = word_hashes(words.distinct)[words.codes], words.bounds
    runs = combined(hashes, width)
    sets = []
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - start >= width:
            sets.append(np.unique(runs[start : end - width + 1]))
        else:
            sets.append(combined(hashes[start:end], end - start) if end > start else runs[:0])
    counts = np.array([len(s) for s in sets], dtype=np.int64)
    return np.concatenate(sets) if sets else runs[:0], counts


def _draw(elements: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit random numbers of each element for a round."""
    drawn = combined(elements ^ np.uint64((round_ * 0xD1B54A32D192ED03 + 0x5851F42D4C957F2D) & (2**64 - 1)), 1)
    return drawn >> _HALF, drawn & _WORD


def _signatures(elements: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """One row of ``size`` values per set; no set is empty."""
    lowest = np.full(len(counts) * size, np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = None
    for round_ in range(size):
        fraction, draw = _draw(elements, round_)
        place = round_ + ((draw * np.uint64(size - round_)) >> _HALF).astype(np.int64)
        if round_ == 0:
            taken = first = place
        else:
            if order is None:  # one swap has been made: places 0 and first
                order = np.tile(np.arange(size, dtype=np.uint16), (len(elements), 1))
                order[np.arange(len(elements)), first] = 0
                order[:, 0] = first
            rows = np.arange(len(elements))
            taken = order[rows, place].astype(np.int64)
            order[rows, place] = order[:, round_]
        np.minimum.at(lowest, owner * size + taken, (np.uint64(round_) << _HALF) | fraction)
        open_ = lowest.reshape(-1, size).max(axis=1) >= np.uint64((round_ + 1) << 32)
        keep = open_[owner]
        if not keep.any():
            break
        if not keep.all():
            elements, owner, first = elements[keep], owner[keep], first[keep]
            order = order[keep] if order is not None else None
    return lowest.reshape(-1, size)


def signatures(elements: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signatures; a row of an empty set holds the largest value everywhere."""
    out = np.full((len(counts), size), np.iinfo(np.uint64).max, dtype=np.uint64)
    bounds = boundaries(counts)
    for start, end in _chunks(bounds):
        filled = start + np.flatnonzero(counts[start:end])
        if len(filled):
            out[filled] = _signatures(elements[bounds[start] : bounds[end]], counts[filled], size)
    return out


def _chunks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(bounds) - 1:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + ELEMENTS, side="right")) - 1)
        yield start, end
        start = end


def band_keys(rows: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """A 64-bit key per signature and band."""
    keys = np.empty((len(rows), bands), dtype=np.uint64)
    for band in range(bands):
        own = rows[:, band * per_band : (band + 1) * per_band]
        named = np.concatenate((np.full((len(own), 1), band, dtype=np.uint64), own), axis=1)
        keys[:, band] = combined(named.ravel(), per_band + 1)[:: per_band + 1]
    return keys
