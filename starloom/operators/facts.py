"""Fact building by surrogate-key lookup."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.joins import skew_safe_join


@dataclass(frozen=True)
class KeyLookup:
    """Where a fact column finds its surrogate key."""

    fact_column: str
    key_map: DataFrame
    natural: str
    surrogate: str


def resolve_keys(df: DataFrame, lookups: Sequence[KeyLookup]) -> DataFrame:
    """Add one surrogate key per lookup, null where the natural key is unknown."""
    for lookup in lookups:
        key_map = lookup.key_map.select(
            F.col(lookup.natural).alias(lookup.fact_column), F.col(lookup.surrogate).alias(lookup.surrogate)
        )
        df = skew_safe_join(df, key_map, [lookup.fact_column], "left")
    return df


def with_all_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose surrogate keys were all found."""
    return df.dropna(subset=list(keys))


def unresolved(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows rejected for a missing surrogate key."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    return df.where(missing)
