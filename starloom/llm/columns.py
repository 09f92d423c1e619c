"""Arrow functions as columns of a frame, and bounded samples."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import starloom
from starloom.session import materialize

MOST_LABELS = 512
# Rows per Arrow batch; texts of some kilobytes each then take a few megabytes at once.
BATCH_ROWS = 2_000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers of a session, once, and bound the batches they get."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if context.applicationId not in _shipped:
        root = Path(starloom.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="starloom-")) / "starloom_package.zip"
        with zipfile.ZipFile(archive, "w") as packed:
            for path in sorted(root.rglob("*.py")):
                packed.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def share(spark: SparkSession, value: object) -> Broadcast:
    """A value of bounded size for the Python functions of this folder."""
    return ship(spark).sparkContext.broadcast(value)


def release() -> None:
    """Give freed memory back to the system: workers wait idle beside the JVM between batches and tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def by_slices(work: Callable[[pa.Array], pa.Array], returns: str, prepare: Callable[[pa.Array], Iterator[pa.Array]]):
    """An Arrow function of one column that sees a batch in the runs that ``prepare`` makes of it."""

    @F.arrow_udf(returns)
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [work(part) for part in prepare(batch)]
            yield pa.concat_arrays(parts) if parts else work(batch.slice(0, 0))
            del parts
            release()

    return column


def struct_array(**fields: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(fields.values()), list(fields))


def unused(taken: Iterable[str], name: str) -> str:
    """A name like the given one that no column has, whatever its case."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def with_struct(df: DataFrame, made: Column, names: list[str]) -> DataFrame:
    """The frame with the fields of a struct column; columns it had under these names are replaced."""
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    held = unused(df.columns, "_made")
    return df.select(*kept, made.alias(held)).select(*kept, *[F.col(f"{held}.{n}").alias(n) for n in names])


def sample_by_label(df: DataFrame, label: str, key: str, most: int) -> tuple[DataFrame, dict]:
    """About ``most`` rows of each label at random by the hash of their key, and the rows per label.

    Labels with fewer rows keep all. There may be ``MOST_LABELS`` labels; more is
    an error, since a model's size grows with their number.
    """
    labelled = df.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(label).count().limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} different values of {label!r}")
    share = F.lit(1.0)
    for value, rows in counts.items():
        if rows > most:
            share = F.when(F.col(label) == F.lit(value), F.lit(most / rows)).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < share * (1 << 30)
    return labelled.where(drawn), counts


def one_of_each(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per key: the text with the smallest hash.

    Rows that repeat a key are reduced to one before the shuffle, so a key with very many rows
    costs a sample nothing.
    """
    return df.groupBy(*keys).agg(F.min_by(text, F.xxhash64(text)).alias(text))


def drawn_texts(texts: DataFrame, labels: DataFrame, key: str, label: str, text: str, most: int) -> tuple[DataFrame, dict]:
    """``key``, ``label`` and one text for about ``most`` keys of each label, and the keys per label.

    Repeated labels of a key count once. The drawn labels are broadcast if they are as few as
    they should be, so texts are scanned and not shuffled, and joined by shuffling otherwise.
    """
    drawn, counts = sample_by_label(labels.select(key, label).distinct(), label, key, most)
    drawn = materialize(drawn)
    few = drawn.count() <= 2 * most * max(1, len(counts))
    return one_of_each(texts.join(F.broadcast(drawn) if few else drawn, key), [key, label], text), counts
