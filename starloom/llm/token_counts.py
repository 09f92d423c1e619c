"""Token counts of documents in flat token files that have no index.

A flat file is nothing but little-endian ids with an end-of-document id after each
document. The project keeps no such files; ``flatten`` makes them from staged
records (``row_id``, ``nombre_raw``), and ``count`` works on any of up to 2 GB each.

``count`` searches each block of a file for the end id at once. What a block holds
before its first end, after its last one, and in between is stitched together by
prefix sums over the blocks of a file, so a document may span any number of blocks.
Files are independent. Ids after the last end of a file are a last document that
is not complete. An empty document is an end right after another and counts 0; a
file without ids has no document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.columns import by_slices, ship
from starloom.llm.token_ids import word_tokenizer
from starloom.llm.words import slices

# In the word vocabulary this id stands for the byte 0xC0, which is in no UTF-8
# text, so no text has it. Its two bytes are characters that a text writer can put
# between records.
END_ID = 124
BLOCK_TOKENS = 1 << 18
PARTITION_SHIFT = 33


def _ids(texts: pa.Array, vocabulary: str) -> pa.Array:
    ids, counts = word_tokenizer(vocabulary).encode(texts)
    ends = np.cumsum(counts)
    return pa.array([ids[e - n : e].astype("<u2").tobytes() for e, n in zip(ends, counts, strict=True)], pa.binary())


def flatten(df: DataFrame, vocabulary: str, path: str, key: str = "row_id", text: str = "nombre_raw", end_id: int = END_ID) -> DataFrame:
    """Write 16-bit flat token files under ``path``; which record is which document of which file.

    A null or empty text is an empty document. Returns ``key``, ``part`` (the
    number in the file's name) and ``document`` (its place in the file). ``df``
    must be read from files, since its partitions are the files.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    ids = by_slices(partial(_ids, vocabulary=vocabulary), "binary", slices)
    separator = end_id.to_bytes(2, "little").decode("ascii")
    rows.select(ids(F.col("text")).cast("string").alias("value")).write.option("lineSep", separator).text(path)
    place = F.monotonically_increasing_id()
    return rows.select(
        F.col("key").alias(key),
        F.shiftright(place, PARTITION_SHIFT).cast("int").alias("part"),
        place.bitwiseAND((1 << PARTITION_SHIFT) - 1).alias("document"),
    )


def _scan_task(batches: Iterator[pa.RecordBatch], end_id: int, width: str, block_tokens: int) -> Iterator[pa.RecordBatch]:
    """One row per block: how many ids it has, and where the ends are."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.frombuffer(content.as_buffer(), dtype=width)
            starts = range(0, len(ids), block_tokens)
            blocks = [ids[s : s + block_tokens] for s in starts]
            ends = [np.flatnonzero(b == end_id) for b in blocks]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * len(blocks), pa.string()),
                    pa.array(range(len(blocks)), pa.int64()),
                    pa.array([len(b) for b in blocks], pa.int64()),
                    pa.array(ends, pa.list_(pa.int64())),
                ],
                ["file", "block", "tokens", "ends"],
            )


def count(spark: SparkSession, path: str, end_id: int = END_ID, width: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: ``file``, ``document`` (its place there), ``first_token``, ``n_tokens`` and ``complete``.

    A file with a broken last id (a byte too many) is an error.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    task = partial(_scan_task, end_id=end_id, width=width, block_tokens=block_tokens)
    blocks = files.mapInArrow(task, "file string, block bigint, tokens bigint, ends array<bigint>")

    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    stitched = (
        blocks.withColumn("base", base)
        .withColumn("document", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
        .withColumn("last_end", F.col("base") + F.try_element_at("ends", F.lit(-1)))
        .withColumn("open", F.coalesce(F.max("last_end").over(before) + 1, F.lit(0)))
        .withColumn("last_block", F.lead("block").over(order).isNull())
    )
    inside = stitched.select("file", "base", "document", "open", "ends", F.posexplode("ends").alias("i", "end"))
    first = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.expr("try_element_at(ends, i)") + 1)
    complete = inside.select(
        "file", (F.col("document") + F.col("i")).alias("document"), first.alias("first_token"),
        (F.col("base") + F.col("end") - first).alias("n_tokens"), F.lit(True).alias("complete"),
    )
    rest = F.coalesce(F.col("last_end") + 1, F.col("open"))
    tail = stitched.where("last_block").select(
        "file", (F.col("document") + F.size("ends")).alias("document"), rest.alias("first_token"),
        (F.col("base") + F.col("tokens") - rest).alias("n_tokens"), F.lit(False).alias("complete"),
    )
    return complete.unionByName(tail.where("n_tokens > 0"))


def part_number() -> Column:
    """The number that Spark's writers put into a file's name."""
    return F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("int")
