"""Slowly changing dimensions, types 1 and 2, applied to a whole delta at once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions import columns_changed
from starloom.operators.joins import keep_matching, skew_safe_join
from starloom.operators.keys import assign_surrogate_keys, next_key
from starloom.session import materialize

INSERT, NEW_VERSION, UPDATE, SAME = "insert", "new_version", "update", "same"
_OLD = "_old_"

NO_CHANGES = {"insertados": 0, "actualizados_scd2": 0, "actualizados_scd1": 0, "sin_cambios": 0}


@dataclass(frozen=True)
class ScdPolicy:
    """Which columns open a new version (type 2) and which are overwritten (type 1)."""

    natural: str
    surrogate: str
    type2: tuple[str, ...]
    type1: tuple[str, ...]


def classify(dimension: DataFrame, delta: DataFrame, policy: ScdPolicy) -> DataFrame:
    """``delta`` with the action each row asks for and the current surrogate key.

    ``delta`` holds one row per natural key. Only current rows with a key of the
    delta are compared.
    """
    compared = [*policy.type2, *policy.type1]
    current = keep_matching(
        dimension.where(F.col("es_actual")).select(policy.natural, policy.surrogate, *compared),
        delta,
        [policy.natural],
    ).select(
        policy.natural,
        F.col(policy.surrogate).alias(_OLD + policy.surrogate),
        *[F.col(c).alias(_OLD + c) for c in compared],
    )
    action = (
        F.when(F.col(_OLD + policy.surrogate).isNull(), F.lit(INSERT))
        .when(columns_changed(policy.type2, _OLD), F.lit(NEW_VERSION))
        .when(columns_changed(policy.type1, _OLD), F.lit(UPDATE))
        .otherwise(F.lit(SAME))
    )
    return (
        skew_safe_join(delta, current, [policy.natural], "left")
        .withColumn("_action", action)
        .select(*delta.columns, _OLD + policy.surrogate, "_action")
    )


def revise_versions(
    dimension: DataFrame, classified: DataFrame, policy: ScdPolicy, as_of: dt.date
) -> DataFrame:
    """All stored versions, with the replaced ones closed and type 1 values updated."""
    changes = classified.where(F.col("_action").isin(NEW_VERSION, UPDATE)).select(
        F.col(_OLD + policy.surrogate).alias(policy.surrogate),
        "_action",
        *[F.col(c).alias("_new_" + c) for c in policy.type1],
    )
    joined = skew_safe_join(dimension, changes, [policy.surrogate], "left")
    closes, updates = F.col("_action") == NEW_VERSION, F.col("_action") == UPDATE
    values = {c: F.when(updates, F.col("_new_" + c)).otherwise(F.col(c)) for c in policy.type1}
    values["valid_to"] = F.when(closes, F.lit(as_of)).otherwise(F.col("valid_to"))
    values["es_actual"] = F.when(closes, F.lit(False)).otherwise(F.col("es_actual"))
    return joined.withColumns(values).select(*dimension.columns)


def added_versions(
    dimension: DataFrame, classified: DataFrame, policy: ScdPolicy, order_by: Sequence[str], start: int | None = None
) -> DataFrame:
    """New rows for unknown keys and for new versions, keyed from ``start`` on (default: after the largest key)."""
    rows = classified.where(F.col("_action").isin(INSERT, NEW_VERSION)).drop(
        "_action", _OLD + policy.surrogate
    )
    start = next_key(dimension, policy.surrogate) if start is None else start
    keyed = assign_surrogate_keys(rows, policy.surrogate, order_by, start)
    return keyed.select(*dimension.columns)


def apply_scd(
    dimension: DataFrame,
    delta: DataFrame,
    policy: ScdPolicy,
    as_of: dt.date,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """The dimension after the delta, whose classified rows are written down once."""
    classified = materialize(classify(dimension, delta, policy))
    return revise_versions(dimension, classified, policy, as_of).unionByName(
        added_versions(dimension, classified, policy, order_by or [policy.natural])
    )


def scd_counts(classified: DataFrame) -> DataFrame:
    """One row of counters. ``insertados`` includes the rows of new versions."""
    action = F.col("_action")
    return classified.agg(
        F.count_if(action.isin(INSERT, NEW_VERSION)).alias("insertados"),
        F.count_if(action == NEW_VERSION).alias("actualizados_scd2"),
        F.count_if(action == UPDATE).alias("actualizados_scd1"),
        F.count_if(action == SAME).alias("sin_cambios"),
    )
