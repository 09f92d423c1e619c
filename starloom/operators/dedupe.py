"""Duplicate removal and duplicate-identity maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.joins import drop_matching, keep_matching, skew_safe_join

# Column names of a duplicate map.
REPEATED_ID = "id_repetido"
KEPT_ID = "id_tomado"


def keep_one(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], keep: str = "first"
) -> DataFrame:
    """One row per key: the first or last in ``order_by``. Null keys form a group.

    ``order_by`` must tell all rows of a key apart. Spark limits each key to one
    row inside every input partition before the shuffle, so a hot key sends at
    most one row per partition.
    """
    if keep not in {"first", "last"}:
        raise ValueError(f"keep is 'first' or 'last', not {keep!r}")
    order: list[Column] = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order_by]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def smallest_ids(df: DataFrame, group_by: Sequence[str], id_col: str) -> DataFrame:
    """The canonical id of every group whose values are all known."""
    return df.dropna(subset=[*group_by, id_col]).groupBy(*group_by).agg(F.min(id_col).alias(KEPT_ID))


def _shared_groups(df: DataFrame, group_by: Sequence[str], id_col: str) -> DataFrame:
    """Groups that hold more than one id, with the smallest id."""
    return (
        df.dropna(subset=[*group_by, id_col])
        .groupBy(*group_by)
        .agg(
            F.min(id_col).alias(KEPT_ID),
            F.max(id_col).alias("_largest"),
        )
        .where(F.col(KEPT_ID) != F.col("_largest"))
        .drop("_largest")
    )


def _with_kept_id(df: DataFrame, group_by: Sequence[str], id_col: str, how: str) -> DataFrame:
    return skew_safe_join(df, _shared_groups(df, group_by, id_col), group_by, how)


def duplicate_map(df: DataFrame, group_by: Sequence[str], id_col: str) -> DataFrame:
    """``(id_repetido, id_tomado)`` for every id that is not the smallest of its group.

    Rows with a null group value are never duplicates. The smallest id comes from
    an aggregate, which combines before the shuffle, instead of from a window
    over whole groups.
    """
    narrow = df.select(*group_by, id_col)
    return (
        _with_kept_id(narrow, group_by, id_col, "inner")
        .where(F.col(id_col) != F.col(KEPT_ID))
        .select(F.col(id_col).alias(REPEATED_ID), KEPT_ID)
        .distinct()
    )


def drop_duplicates_of(df: DataFrame, group_by: Sequence[str], id_col: str) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its group."""
    return (
        _with_kept_id(df, group_by, id_col, "left")
        .where(F.col(KEPT_ID).isNull() | (F.col(id_col) == F.col(KEPT_ID)))
        .select(*df.columns)
    )


def remap(df: DataFrame, id_map: DataFrame, column: str) -> DataFrame:
    """Replace ids found in the map by their canonical id; others stay. One level."""
    lookup = id_map.select(F.col(REPEATED_ID).alias(column), F.col(KEPT_ID).alias("_kept"))
    return (
        skew_safe_join(df, lookup, [column], "left")
        .withColumn(column, F.coalesce("_kept", column))
        .select(*df.columns)
    )


def count_remapped(df: DataFrame, id_map: DataFrame, column: str) -> DataFrame:
    """One row: how many rows of ``df`` a remap of ``column`` would change."""
    ids = id_map.select(F.col(REPEATED_ID).alias(column))
    return keep_matching(df.select(column), ids, [column]).agg(F.count(F.lit(1)).alias("remapped"))


def clean_map(id_map: DataFrame) -> DataFrame:
    """A usable map: whole pairs only, one canonical id per repeated id."""
    return (
        id_map.dropna(subset=[REPEATED_ID, KEPT_ID])
        .groupBy(REPEATED_ID)
        .agg(F.min(KEPT_ID).alias(KEPT_ID))
    )


def drop_mapped(df: DataFrame, id_map: DataFrame, column: str) -> DataFrame:
    """Rows whose id is not one of the repeated ids."""
    return drop_matching(df, id_map.select(F.col(REPEATED_ID).alias(column)), [column])
