"""Joins that hold when one key carries a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.session import materialize

# A key with more rows than this is salted where a caller asks for it: over one
# task per so many rows.
HEAVY_KEY_ROWS = 1_000_000
_ROWS = "_heavy_rows"


def heavy_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HEAVY_KEY_ROWS) -> DataFrame:
    """Keys with more than ``min_rows`` rows and their number of tasks, written down.

    Reads the key columns of ``df``, so hand it a stored table, not the result of
    joins: it is worked out here once. There are at most rows / ``min_rows`` keys.
    """
    counts = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(_ROWS)).where(F.col(_ROWS) > min_rows)
    return materialize(counts.select(*keys, F.ceil(F.col(_ROWS) / min_rows).cast("int").alias(_ROWS)))


def skew_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", heavy: DataFrame | None = None
) -> DataFrame:
    """Equi-join of a large ``left`` to a ``right`` with few rows per key.

    Each side is in the plan once. Hot keys of ``left``, and its null keys, are left
    to adaptive execution, which splits the partition they fall into. Where that is
    not wanted, ``heavy`` (from ``heavy_keys`` of the stored table behind ``left``)
    names the keys to salt, each over as many tasks as its rows ask for; the
    matching rows of ``right`` are repeated as often. The salt depends on the row
    and its input partition only, so a retried task gives the same one.
    ``how`` is inner, left, left_semi or left_anti.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"the right side is not split, so {how!r} is not possible")
    on = list(on)
    if heavy is None:
        return left.join(right, on, how)
    tasks = F.coalesce(F.col(_ROWS), F.lit(1))
    row_hash = F.xxhash64(*[F.col(c) for c in left.columns]) + F.spark_partition_id()
    salted_left = left.join(heavy, on, "left").withColumn("_salt", F.pmod(row_hash, tasks).cast("int")).drop(_ROWS)
    copies = F.explode(F.sequence(F.lit(0), tasks - 1))
    salted_right = right.join(heavy, on, "left").withColumn("_salt", copies).drop(_ROWS)
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def _key_side(keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The different key values to match against; a hot one is reduced before its shuffle."""
    return keys.select(*on).distinct()


def keep_matching(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with a match.

    With few keys, as of a delta, Spark broadcasts them: one scan of ``df`` without a
    shuffle of it, so later joins against the delta only move rows that can match.
    """
    return skew_safe_join(df, _key_side(keys, on), on, "left_semi")


def drop_matching(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a match; rows with a null key have none and stay."""
    return skew_safe_join(df, _key_side(keys, on), on, "left_anti")


def split_matching(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The two complementary parts of ``df``: with and without a match."""
    return keep_matching(df, keys, on), drop_matching(df, keys, on)


def flatten_chain(
    base: DataFrame, steps: Sequence[tuple[DataFrame, str]], how: str = "left"
) -> DataFrame:
    """Attach a chain of parent tables, each a ``(parent, key)`` pair.

    A key may come from an earlier parent of the chain. Rows without a parent are
    kept with null attributes.
    """
    return reduce(lambda df, step: skew_safe_join(df, step[0], [step[1]], how), steps, base)


def missing_references(df: DataFrame, branches: dict[str, str]) -> DataFrame:
    """One row per branch: how many rows found no parent, by a column of that parent."""
    counts = df.agg(
        *[F.count_if(F.col(column).isNull()).alias(branch) for branch, column in branches.items()]
    )
    return counts.unpivot([], list(branches), "branch", "missing_rows")
