"""Quality classifier: hashed word n-gram logistic regression learned by follow the regularised leader.

For the project's staging tables: learns from staged texts (``nombre_raw``) with
the verdict of the cleaners (``valido``: 1 if the row was kept, 0 if rejected)
how likely an unseen text is a good one.

A text is its words, its pairs of neighbouring words, the shapes of its words (letter
case, digits, marks; a word equal to the one before is a shape of its own) and pairs
of neighbouring shapes, hashed to 2^18 weights. Null and empty texts have no word and get the score of
the bias alone. Rows without a label teach nothing; without any labelled row
every score is 0.5. Equal texts get equal scores, other columns are kept, and
columns that have the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.columns import by_slices, drawn_texts, share, struct_array, with_struct
from starloom.llm.words import boundaries, combined, group_sums, slices, word_hashes, words_of
from starloom.session import materialize

BITS = 18
ROWS_PER_LABEL = 8_000
THRESHOLD = 0.3
ROUNDS = 3
# Learners whose leaders are averaged after each round.
LEARNERS = 6

# FTRL-proximal: step size, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
# A text's features are shares of its words times this.
SCALE = 8.0


@dataclass(frozen=True)
class QualityModel:
    bias: float
    weights: np.ndarray


def _before(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value of the word before each word; the first word of a text has a mark before it."""
    out = np.concatenate((values[:1], values[:-1]))
    out[first] = np.uint64(11)
    return out


def _runs(*neighbours: np.ndarray) -> np.ndarray:
    """A hash of each word's run of neighbours."""
    return combined(np.stack(neighbours, axis=1).ravel(), len(neighbours))[:: len(neighbours)]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets, one row per kind of feature and one column per word; words per text."""
    words = words_of(texts)
    first = np.zeros(len(words.codes), dtype=bool)
    first[words.bounds[:-1][words.counts > 0]] = True
    repeated = np.zeros(len(words.codes), dtype=bool)
    repeated[1:] = (words.codes[1:] == words.codes[:-1]) & ~first[1:]
    shapes = words.distinct
    for pattern, mark in ((r"\p{Lu}+", "X"), (r"\p{Ll}+", "x"), (r"\pN+", "9")):
        shapes = pc.replace_substring_regex(shapes, pattern, mark)
    shape = np.where(repeated, np.uint64(7), word_hashes(shapes)[words.codes])
    hashes = word_hashes(words.distinct)[words.codes]
    kinds = [hashes, shape, _runs(_before(shape, first), shape), _runs(_before(hashes, first), hashes)]
    shift = np.uint64(64 - BITS)
    buckets = np.stack([(k * np.uint64(2 * i + 0x9E3779B97F4A7C15)) >> shift for i, k in enumerate(kinds)])
    return buckets.astype(np.int64), words.counts


def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that minimise the regularised sum of the losses so far."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _learn_task(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """One pass over a task's rows from the shared state; what it added to the state."""
    z0, n0 = shared.value
    z, n = z0.copy(), n0.copy()
    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held).sort_by([("h", "ascending"), ("text", "ascending")])  # the same order in a repeated task
    labels = rows.column("label").to_pylist()
    at = 0
    for chunk in rows.column("text").chunks:
        for texts in slices(chunk):
            buckets, counts = features(texts)
            bounds = boundaries(counts)
            for i in range(len(counts)):
                own, often = np.unique(buckets[:, bounds[i] : bounds[i + 1]], return_counts=True)
                own, x = np.append(own, 1 << BITS), np.append(often * (SCALE / max(1, counts[i])), 1.0)
                w = _leader(z[own], n[own])
                g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30))) - labels[at]) * x
                grown = n[own] + g * g
                z[own] += g - (np.sqrt(grown) - np.sqrt(n[own])) / ALPHA * w
                n[own] = grown
                at += 1
    changed = np.flatnonzero((z != z0) | (n != n0))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(changed.astype(np.int32)),
            pa.array((z - z0)[changed].astype(np.float32)),
            pa.array((n - n0)[changed].astype(np.float32)),
        ],
        ["bucket", "z", "n"],
    )


def fit(
    rows: DataFrame,
    verdicts: DataFrame,
    text: str = "nombre_raw",
    label: str = "valido",
    key: str = "row_id",
    rows_per_label: int = ROWS_PER_LABEL,
    rounds: int = ROUNDS,
) -> QualityModel:
    """Learn from the texts of about ``rows_per_label`` verdicts of each label, drawn by the hash of ``key``.

    Texts are scanned once and not shuffled; of rows that repeat a key one text is
    learned from. In every round each of a few tasks
    takes follow-the-leader steps over its rows from the common state, and the
    state moves by the mean of their changes; it is two numbers a bucket.
    """
    named = verdicts.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    texts = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    drawn, counts = drawn_texts(texts, named, "key", "label", "text", rows_per_label)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    if counts:
        dealt = materialize(drawn.select(F.xxhash64("key").alias("h"), "label", "text")).repartition(LEARNERS, "h")
    for _ in range(rounds if counts else 0):
        shared = share(rows.sparkSession, (z, n))
        step = dealt.mapInArrow(partial(_learn_task, shared=shared), "bucket int, z float, n float")
        moved = step.groupBy("bucket").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()
        bucket = moved.column("bucket").to_numpy()
        z[bucket] += moved.column("z").to_numpy() / LEARNERS
        n[bucket] += moved.column("n").to_numpy() / LEARNERS
        shared.destroy()
    weights = _leader(z, n)
    return QualityModel(float(weights[-1]), weights[:-1].astype(np.float32))


def _score(texts: pa.Array, shared, threshold: float) -> pa.Array:
    model: QualityModel = shared.value
    buckets, counts = features(texts)
    each = sum(model.weights[row].astype(np.float64) for row in buckets)
    margin = model.bias + group_sums(each, counts) * SCALE / np.maximum(1, counts)
    score = 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))
    return struct_array(score=pa.array(score), predicted=pa.array((score >= threshold).astype(np.int32)))


def predict(df: DataFrame, model: QualityModel, text: str = "nombre_raw", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` for every whole text."""
    shared = share(df.sparkSession, model)
    score = by_slices(partial(_score, shared=shared, threshold=threshold), "score double, predicted int", slices)
    return with_struct(df, score(F.col(text)), ["score", "predicted"])
