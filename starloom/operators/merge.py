"""Insert-ignore and partial upsert as set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.dedupe import keep_one
from starloom.operators.joins import drop_matching, keep_matching, skew_safe_join


def new_rows(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()
) -> DataFrame:
    """Incoming rows whose key is not in ``existing``; the first per key wins.

    Without a key every incoming row is new. ``existing`` is only scanned for its
    key columns and never shuffled while the incoming keys can be broadcast.
    """
    if not keys:
        return incoming
    fresh = drop_matching(incoming, keep_matching(existing.select(*keys), incoming, keys), keys)
    return keep_one(fresh, keys, order_by).select(*incoming.columns) if order_by else fresh.select(*incoming.columns)


def insert_ignore(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()
) -> DataFrame:
    """``existing`` plus the new rows. Columns the incoming rows lack become null."""
    return existing.unionByName(new_rows(existing, incoming, keys, order_by), allowMissingColumns=True)


def updated_rows(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str]
) -> DataFrame:
    """All of ``existing``, with ``update`` columns taken from the row of the same key."""
    changes = incoming.select(
        *keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in update]
    )
    joined = skew_safe_join(existing, changes, keys, "left")
    return joined.withColumns(
        {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in update}
    ).select(*existing.columns)


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    update: Sequence[str],
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Insert new keys; on a known key overwrite the ``update`` columns only.

    Columns of ``update`` that are not incoming are ignored, and with none left
    this is insert-ignore. The last incoming row per key in ``order_by`` wins;
    without it incoming keys must be unique.
    """
    update = [c for c in update if c in incoming.columns]
    if not update:
        return insert_ignore(existing, incoming, keys, order_by)
    latest = keep_one(incoming, keys, order_by, keep="last") if order_by else incoming
    inserted = new_rows(existing, latest, keys)
    return updated_rows(existing, latest, keys, update).unionByName(inserted, allowMissingColumns=True)


def upsert_counts(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: incoming keys that are new and incoming keys that are already known."""
    known = keep_matching(existing.select(*keys), incoming, keys).distinct().withColumn("_known", F.lit(True))
    marked = skew_safe_join(incoming.select(*keys).distinct(), known, keys, "left")
    return marked.agg(
        F.count_if(F.col("_known").isNull()).alias("inserted"),
        F.count_if(F.col("_known")).alias("updated"),
    )
