"""Column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions import digit_mask


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, nulls left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def pattern_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per digit pattern of a column."""
    masked = df.select(digit_mask(F.col(column).cast("string")).alias("pattern"))
    return value_counts(masked, "pattern")


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """The different values, or combinations of values, of columns."""
    return df.select(*columns).distinct()


def extremes(df: DataFrame, group: str, column: str) -> DataFrame:
    """Smallest and largest value of a column, and rows, per value of another."""
    return df.groupBy(group).agg(F.min(column).alias("smallest"), F.max(column).alias("largest"), F.count(F.lit(1)).alias("n"))


def group_size_histogram(df: DataFrame, column: str) -> DataFrame:
    """How many repeated values occur exactly k times, for each k above 1."""
    sizes = value_counts(df, column).where(F.col("n") > 1)
    return sizes.groupBy(F.col("n").alias("times")).agg(F.count(F.lit(1)).alias("values"))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows, non-null and null counts, smallest and largest value.

    One pass over the data: every column adds its aggregates to the same scan.
    """
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, name in enumerate(df.columns):
        aggregates += [
            F.count(F.col(name)).alias(f"_present_{i}"),
            F.min(F.col(name)).cast("string").alias(f"_min_{i}"),
            F.max(F.col(name)).cast("string").alias(f"_max_{i}"),
        ]
    row = df.agg(*aggregates)
    lines = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(df.schema[name].dataType.simpleString()).alias("type"),
            F.col("_rows").alias("rows"),
            F.col(f"_present_{i}").alias("present"),
            (F.col("_rows") - F.col(f"_present_{i}")).alias("missing"),
            F.col(f"_min_{i}").alias("smallest"),
            F.col(f"_max_{i}").alias("largest"),
        )
        for i, name in enumerate(df.columns)
    ]
    return row.select(F.inline(F.array(*lines)))
