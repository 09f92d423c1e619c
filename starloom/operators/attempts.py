"""Ordered attempt rules: one attempt per day, nothing after the first pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.dedupe import KEPT_ID, REPEATED_ID, keep_one
from starloom.operators.joins import keep_matching, skew_safe_join
from starloom.session import materialize


def apply_attempt_rule(
    df: DataFrame, group: Sequence[str], date: str, tie: Sequence[str], passed: str, attempt: str
) -> DataFrame:
    """Per group in date order: first row of each date, up to the first pass, renumbered.

    The first row per (group, date) is cut down before its shuffle. After that a
    group has at most one row per calendar day, so the ordered window over a
    group stays small however many rows the group started with.
    """
    daily = keep_one(df, [*group, date], tie)
    chain = Window.partitionBy(*group).orderBy(date)
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    # The accepted rows are the start of the chain, so numbering before the
    # filter gives the same numbers and needs one pass only.
    return (
        daily.withColumn("_passed_before", F.max(F.col(passed).cast("int")).over(earlier))
        .withColumn(attempt, F.row_number().over(chain))
        .where(F.coalesce(F.col("_passed_before"), F.lit(0)) == 0)
        .drop("_passed_before")
    )


def touched_ids(id_map: DataFrame, column: str) -> DataFrame:
    """Every id on either side of a duplicate map."""
    sides = id_map.select(F.col(REPEATED_ID).alias(column)).union(id_map.select(KEPT_ID))
    return sides.distinct()


def _owners(enrollments: DataFrame, enrollment_map: DataFrame, enrollment_id: str, group: Sequence[str]) -> DataFrame:
    """The group columns of touched enrollments."""
    touched = touched_ids(enrollment_map, enrollment_id)
    owners = keep_matching(enrollments.select(enrollment_id, *group), touched, [enrollment_id])
    return owners.dropna(subset=list(group)).distinct()


def _owned_and_rest(
    exams: DataFrame,
    enrollments: DataFrame,
    enrollment_map: DataFrame,
    enrollment_id: str,
    group: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """Exams of touched enrollments with their group columns, and all other exams.

    Only the owners of touched enrollments are joined to the exams, so one join
    finds the group and tells the two kinds apart. Its result is written down, as
    both parts read it.
    """
    tagged = materialize(skew_safe_join(exams, _owners(enrollments, enrollment_map, enrollment_id, group), [enrollment_id], "left"))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in group])
    return tagged.where(known), tagged.where(~known).select(*exams.columns)


def consolidate_attempts(
    exams: DataFrame,
    enrollments: DataFrame,
    enrollment_map: DataFrame,
    *,
    enrollment_id: str,
    group: Sequence[str],
    date: str,
    tie: Sequence[str],
    passed: str,
    attempt: str,
) -> DataFrame:
    """Apply the attempt rule to exams of enrollments touched by duplicates only.

    ``passed`` is a boolean column of ``exams``. Exams whose enrollment is unknown,
    or was never merged, keep their rows and numbers.
    """
    owned, rest = _owned_and_rest(exams, enrollments, enrollment_map, enrollment_id, group)
    ruled = apply_attempt_rule(owned, group, date, tie, passed, attempt)
    number = F.col(attempt).cast(exams.schema[attempt].dataType)
    return ruled.withColumn(attempt, number).select(*exams.columns).unionByName(rest)


def consolidation_counts(
    exams: DataFrame,
    enrollments: DataFrame,
    enrollment_map: DataFrame,
    *,
    enrollment_id: str,
    group: Sequence[str],
    date: str,
    tie: Sequence[str],
    passed: str,
) -> DataFrame:
    """One row: exams and groups affected by the consolidation, and exams removed.

    Only the affected exams are written down, by the columns that the rule looks at.
    """
    owners = _owners(enrollments, enrollment_map, enrollment_id, group)
    looked_at = list(dict.fromkeys([*group, date, *tie, passed]))
    owned = materialize(skew_safe_join(exams, owners, [enrollment_id], "inner").select(*looked_at))
    kept = apply_attempt_rule(owned, group, date, tie, passed, "_number")
    sides = owned.select(*group, F.lit(1).alias("n"), F.lit(0).alias("kept")).unionByName(
        kept.select(*group, F.lit(0).alias("n"), F.lit(1).alias("kept"))
    )
    per_group = sides.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))
    return per_group.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("afectados"),
        F.count(F.lit(1)).alias("grupos"),
        F.coalesce(F.sum("n") - F.sum("kept"), F.lit(0)).alias("eliminados"),
    )


def attempt_history(fact: DataFrame, keys: Sequence[str], passed: str) -> DataFrame:
    """Attempts so far and whether one was passed, per key."""
    return fact.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("prior_attempts"), F.bool_or(passed).alias("already_passed")
    )


def filter_by_history(
    exams: DataFrame,
    fact: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    tie: Sequence[str],
    passed: str,
    attempt: str,
    max_attempts: int | None = None,
) -> DataFrame:
    """New exams that the history allows, numbered on from it.

    ``exams`` carries the surrogate keys; rows without them are dropped. A key
    already passed takes no more exams. ``max_attempts`` optionally closes a key
    after that many attempts.
    """
    resolved = exams.dropna(subset=list(keys))
    history = attempt_history(keep_matching(fact, resolved, keys), keys, passed)
    open_exams = (
        skew_safe_join(resolved, history, keys, "left")
        .where(~F.coalesce(F.col("already_passed"), F.lit(False)))
        .withColumn("_prior", F.coalesce(F.col("prior_attempts"), F.lit(0)))
    )
    ruled = apply_attempt_rule(open_exams, keys, date, tie, passed, "_position")
    numbered = ruled.withColumn(
        attempt, (F.col("_prior") + F.col("_position")).cast(exams.schema[attempt].dataType)
    )
    if max_attempts is not None:
        numbered = numbered.where(F.col(attempt) <= max_attempts)
    return numbered.select(*exams.columns)


def history_counts(offered: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row: exams that the history let in, and those it turned away, of the exams with all keys."""
    sides = offered.select(F.lit(0).alias("in")).unionByName(accepted.select(F.lit(1).alias("in")))
    accepted_rows, offered_rows = F.count_if(F.col("in") == 1), F.count_if(F.col("in") == 0)
    return sides.agg(accepted_rows.alias("aceptados"), (offered_rows - accepted_rows).alias("rechazados"))
