"""What changed between two states of a table, by key and row digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INSERTED, CHANGED, DELETED, SAME = "insertada", "modificada", "eliminada", "igual"


def row_digest(columns: Sequence[str]):
    """A digest of 128 bits of some columns as text; a null differs from every text."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("", *parts).cast("binary"))


def digests(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The keys of a state with a digest of their rows; of repeated keys the digest of all rows together.

    Only keys and digests are shuffled. Rows with a null in the key are in no comparison.
    """
    rows = df.dropna(subset=list(key)).select(*key, row_digest(columns).alias("_d"))
    # Repeated rows count once, so a key that is delivered twice alike is not a change.
    return rows.groupBy(*key).agg(F.min("_d").alias("_low"), F.max("_d").alias("_high"), F.bit_xor(F.xxhash64("_d")).alias("_mixed"), F.count("*").alias("_n")).select(
        *key, F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.concat_ws("/", "_low", "_high", F.col("_mixed").cast("string"), F.col("_n").cast("string"))).alias("_digest")
    )


def snapshot_changes(before: DataFrame, after: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``key`` and ``cambio`` of every key of either state: insertada, modificada, eliminada or igual."""
    key = list(key)
    old = digests(before, key, columns).withColumnRenamed("_digest", "_before")
    new = digests(after, key, columns).withColumnRenamed("_digest", "_after")
    change = (
        F.when(F.col("_before").isNull(), INSERTED)
        .when(F.col("_after").isNull(), DELETED)
        .when(F.col("_before") != F.col("_after"), CHANGED)
        .otherwise(SAME)
    )
    return old.join(new, key, "full_outer").select(*key, change.alias("cambio"))


def change_counts(changes: DataFrame) -> DataFrame:
    """One row per kind of change with its number of keys."""
    return changes.groupBy("cambio").agg(F.count(F.lit(1)).alias("claves"))
