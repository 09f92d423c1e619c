"""Language identification: multinomial naive Bayes over hashed character n-grams.

The project stores no language. The model learns any label of a staged text: by
default the extract (``archivo_origen``) that a name (``nombre_raw``) came from.

Nulls, empty texts and texts without a letter are ``und`` with score 0. A score
is the posterior of the predicted label (ties: the first label in order). Rows
without a label, or without a letter, teach nothing; if no row teaches, every
prediction is ``und``. Equal texts get equal results, other columns are kept,
and columns that have the names of the results are replaced.
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

from starloom.llm.columns import by_slices, one_of_each, sample_by_label, share, ship, struct_array, with_struct
from starloom.llm.words import group_sums, slices

UNDETERMINED = "und"
BITS = 16
ORDERS = (1, 2, 3)
ROWS_PER_LABEL = 4_000
SMOOTHING = 0.1
RUN_BYTES = 2_000_000

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    """``table[bucket, label]`` is the log probability of an n-gram bucket under a label."""

    labels: list[str]
    prior: np.ndarray
    table: np.ndarray


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets, one row per order and position, and how many positions each text has.

    Letters are lower-cased, anything between them is one blank, and a text ends
    with two blanks. Texts without a letter have no position.
    """
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"\PL+", " ")
    plain = [t if t.strip() else "" for t in plain.to_pylist()]
    counts = np.array([len(t) for t in plain], dtype=np.int64)
    codes = np.frombuffer("".join(t + "  " for t in plain).encode("utf-32-le", "replace"), dtype=np.uint32)
    inside = np.ones(len(codes), dtype=bool)
    ends = np.cumsum(counts + 2)
    inside[ends - 1] = inside[ends - 2] = False
    starts = np.flatnonzero(inside)
    buckets = np.empty((len(ORDERS), len(starts)), dtype=np.uint16)
    for row, order in enumerate(ORDERS):
        mixed = np.full(len(starts), order, dtype=np.uint32)
        for step in range(order):
            mixed = (mixed ^ codes[starts + step]) * _FACTORS[step]
            mixed ^= mixed >> np.uint32(15)
        buckets[row] = (mixed * _FACTORS[0]) >> np.uint32(32 - BITS)
    return buckets, counts


def _count_task(batches: Iterator[pa.RecordBatch], labels: list[str]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((len(labels), 1 << BITS), dtype=np.int64)
    number = {label: i for i, label in enumerate(labels)}
    for batch in batches:
        for label in set(batch.column(0).to_pylist()):
            own = batch.filter(pc.equal(batch.column(0), label)).column(1)
            for texts in slices(own, RUN_BYTES):
                counts[number[label]] += np.bincount(grams(texts)[0].ravel(), minlength=1 << BITS)
    label, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(label.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[label, bucket])],
        ["label", "bucket", "n"],
    )


def fit(
    labelled: DataFrame,
    text: str = "nombre_raw",
    label: str = "archivo_origen",
    key: str = "row_id",
    rows_per_label: int = ROWS_PER_LABEL,
) -> LanguageModel:
    """Learn from about ``rows_per_label`` rows of each label, drawn by the hash of ``key``.

    The bound keeps the cost of learning fixed; the model is one number per bucket
    and label (at most 512 labels), whatever the size of the table.
    """
    named = labelled.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.col(key).alias("key"))
    sample, rows = sample_by_label(named, "label", "key", rows_per_label)
    labels = sorted(rows)
    ship(labelled.sparkSession)
    table = np.zeros((1 << BITS, len(labels)), dtype=np.float64)
    counted = one_of_each(sample, ["key", "label"], "text").select("label", "text").mapInArrow(
        partial(_count_task, labels=labels), "label int, bucket int, n bigint"
    )
    merged = counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    place = [merged.column(c).to_numpy() for c in ("bucket", "label")]
    table[place[0], place[1]] = merged.column("n").to_numpy()
    seen = table.sum(axis=0) > 0
    labels, table = [x for x, s in zip(labels, seen, strict=True) if s], table[:, seen] + SMOOTHING
    totals = np.array([rows[x] for x in labels], dtype=np.float64)
    return LanguageModel(labels, np.log(totals / max(1.0, totals.sum())), np.log(table / table.sum(axis=0)).astype(np.float32))


def _score(texts: pa.Array, shared) -> pa.Array:
    model: LanguageModel = shared.value
    buckets, counts = grams(texts)
    if not model.labels:
        counts = np.zeros_like(counts)
        best, posterior = counts, counts.astype(np.float64)
        evidence = posterior
    else:
        total = np.zeros((len(counts), len(model.labels)))
        for k in range(len(model.labels)):
            column = model.table[:, k]
            total[:, k] = model.prior[k] + group_sums(sum(column[row] for row in buckets).astype(np.float64), counts)
        best = total.argmax(axis=1)
        posterior = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        likelihood = total.max(axis=1) - model.prior[best]
        evidence = likelihood / np.maximum(1, counts * len(ORDERS)) + BITS * np.log(2)
    known = counts > 0
    names = np.array([*model.labels, UNDETERMINED], dtype=object)[np.where(known, best, len(model.labels))]
    return struct_array(
        lang_pred=pa.array(names, pa.string()),
        score=pa.array(np.where(known, posterior, 0.0)),
        evidence=pa.array(np.where(known, evidence, 0.0)),
    )


def predict(df: DataFrame, model: LanguageModel, text: str = "nombre_raw", evidence: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score`` for every whole text, in sparse batches with numpy.

    ``score`` is the posterior of the language. It says which language fits best, not whether one fits;
    the column ``evidence``, added on request, says that: how much likelier an n-gram of the text is in
    the language than by chance, as the mean logarithm. It is about 0 or less for letters at random, and
    0 for a text without letters.
    """
    shared = share(df.sparkSession, model)
    fields = "lang_pred string, score double, evidence double"
    score = by_slices(partial(_score, shared=shared), fields, partial(slices, most=RUN_BYTES))
    return with_struct(df, score(F.col(text)), ["lang_pred", "score", *(["evidence"] if evidence else [])])
