"""Surrogate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.joins import skew_safe_join
from starloom.session import materialize

# monotonically_increasing_id() keeps the partition number above this bit.
_PARTITION_SHIFT = 33
_POSITION_MASK = (1 << _PARTITION_SHIFT) - 1


def _number_by_position(df: DataFrame, key: str, start: int) -> DataFrame:
    """Dense numbers in (partition, row) order, the key as first column.

    The positions are written down first, so a lost executor cannot change them
    between the count and the numbering. The running offsets are one row per
    partition and are the only thing broadcast.
    """
    placed = materialize(df.withColumn("_position", F.monotonically_increasing_id()))
    partition = F.shiftright("_position", _PARTITION_SHIFT).alias("_partition")
    sizes = placed.groupBy(partition).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_partition", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_position").bitwiseAND(_POSITION_MASK)
    return (
        placed.withColumn("_partition", partition)
        .join(F.broadcast(offsets), "_partition")
        .select((F.lit(start) + F.col("_offset") + inside).cast("bigint").alias(key), *df.columns)
    )


def assign_surrogate_keys(
    df: DataFrame, key: str, order_by: Sequence[str], start: int = 1
) -> DataFrame:
    """Number all rows ``start``, ``start + 1``, ... in ``order_by``.

    Sorting is a range shuffle over all columns of ``order_by``, never a
    single-task window. Those columns together must be unique.
    """
    return _number_by_position(
        df.repartitionByRange(*order_by).sortWithinPartitions(*order_by), key, start
    )


def assign_keys_in_place(df: DataFrame, key: str, start: int = 1) -> DataFrame:
    """Dense unique numbers without any order, hence without a shuffle (for facts)."""
    return _number_by_position(df, key, start)


def next_key(df: DataFrame, key: str) -> int:
    """One more than the largest key; 1 for an empty table."""
    largest = df.agg(F.max(key)).first()[0]
    return 1 if largest is None else int(largest) + 1


def current_key_map(dimension: DataFrame, natural: str, surrogate: str, current: str = "es_actual") -> DataFrame:
    """Natural to surrogate key of the current versions."""
    return dimension.where(F.col(current)).select(natural, surrogate)


def position_in_group(
    df: DataFrame, group: Sequence[str], order_by: Sequence[str], position: str, size: str
) -> DataFrame:
    """Add the 0-based position inside a group and the size of the group.

    Rows are numbered over the whole table and the first number of their group is
    taken off, so a group with a large share of the rows is not one task's work.
    ``group`` and ``order_by`` together must be unique.
    """
    numbered = assign_surrogate_keys(df, "_number", [*group, *order_by])
    groups = numbered.groupBy(*group).agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias(size))
    return (
        skew_safe_join(numbered, groups, group, "left")
        .withColumn(position, F.col("_number") - F.col("_first"))
        .select(*df.columns, position, size)
    )


def assign_in_turn(
    items: DataFrame, holders: DataFrame, group: Sequence[str], item_id: str, holder_id: str
) -> DataFrame:
    """Give the items of each group to its holders in turn, both in id order.

    Items of a group without holders get null. The holder's columns are added.
    """
    placed = position_in_group(holders, group, [holder_id], "_turn", "_holders")
    sizes = placed.groupBy(*group).agg(F.max("_holders").alias("_holders"))
    counted = skew_safe_join(position_in_group(items, group, [item_id], "_place", "_items"), sizes, group, "left")
    turned = counted.withColumn("_turn", F.pmod("_place", "_holders")).drop("_place", "_items", "_holders")
    return skew_safe_join(turned, placed.drop("_holders"), [*group, "_turn"], "left").drop("_turn")
