"""Validation operators. Each returns the violating rows or one report row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.joins import drop_matching


def all_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def split_valid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected rows; an unknown verdict is a rejection."""
    verdict = F.coalesce(valid, F.lit(False))
    return df.where(verdict), df.where(~verdict)


def row_accounting(df: DataFrame, name: str, valid: Column, keys: Sequence[str]) -> DataFrame:
    """One report row: total, kept, rejected and duplicate rows of an entity.

    Kept rows are the distinct keys among the valid rows. One pass: rows first
    combine per key, then the keys are summed up.
    """
    verdict = F.coalesce(valid, F.lit(False))
    per_key = (
        df.select(*[F.when(verdict, F.col(k)).alias(k) for k in keys], verdict.alias("_valid"))
        .groupBy("_valid", *keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    counts = per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total"),
        F.count_if("_valid").alias("validos"),
        F.coalesce(F.sum(F.when(F.col("_valid"), F.col("_rows") - 1)), F.lit(0)).alias("duplicados"),
    )
    rejected = F.greatest(F.col("total") - F.col("validos") - F.col("duplicados"), F.lit(0))
    return counts.select(
        F.lit(name).alias("tabla"), "total", "validos", rejected.alias("rechazados"), "duplicados"
    )


def picked_accounting(df: DataFrame, name: str, valid: Column, picked: DataFrame) -> DataFrame:
    """``row_accounting`` where the valid rows, one per key, are written down as ``picked``: no key is shuffled again."""
    none = F.lit(0).cast("bigint")
    verdict = F.coalesce(valid, F.lit(False))
    offered = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(verdict).alias("_valid")).withColumn("validos", none)
    kept = picked.agg(F.count(F.lit(1)).alias("validos")).withColumns({"total": none, "_valid": none})
    counts = offered.unionByName(kept).agg(*[F.sum(c).alias(c) for c in ("total", "_valid", "validos")])
    return counts.select(
        F.lit(name).alias("tabla"), "total", "validos",
        (F.col("total") - F.col("_valid")).alias("rechazados"), (F.col("_valid") - F.col("validos")).alias("duplicados"),
    )


def row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """The number of rows of each named frame, as ``tabla`` and ``filas``."""
    counts = [df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(name).alias("tabla"), "filas") for name, df in frames.items()]
    return reduce(DataFrame.union, counts)


def grand_total(report: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the sum of counters over all rows of a report."""
    return report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in columns])


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose foreign key is set but has no parent."""
    parents = parent.select(F.col(key).alias(foreign_key))
    return drop_matching(child.where(F.col(foreign_key).isNotNull()), parents, [foreign_key])


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once; values with a null never clash."""
    counts = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("rows") > 1)


def bad_intervals(df: DataFrame, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    return df.where(F.col(end) < F.col(start))


def not_one_current(df: DataFrame, natural: str, current: str = "es_actual") -> DataFrame:
    """Natural keys that do not have exactly one current row."""
    counts = df.groupBy(natural).agg(F.count_if(F.col(current)).alias("current_rows"))
    return counts.where(F.col("current_rows") != 1)


def too_long(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """One row per value longer than its column allows: column, limit and length."""
    checks = [
        F.struct(F.lit(c).alias("column"), F.lit(n).alias("max_length"), F.length(c).alias("length"))
        for c, n in limits.items()
    ]
    keys = [c for c in df.columns if c not in limits]
    any_over = reduce(lambda a, b: a | b, [F.length(c) > n for c, n in limits.items()])
    exploded = df.where(any_over).select(*keys, F.explode(F.array(*checks)).alias("_check")).select(*keys, "_check.*")
    return exploded.where(F.col("length") > F.col("max_length"))
