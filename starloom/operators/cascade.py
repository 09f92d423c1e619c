"""Duplicate identities carried through the tables that depend on them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.dedupe import KEPT_ID, clean_map, drop_mapped, duplicate_map, remap
from starloom.operators.joins import keep_matching
from starloom.session import materialize


@dataclass(frozen=True)
class CascadeColumns:
    """Column names of the three levels: people, their enrollments, their exams."""

    person: str
    identity: tuple[str, ...]
    enrollment: str
    offering: str


@dataclass(frozen=True)
class Cascade:
    """Tables after the merge, and the maps that led there."""

    people: DataFrame
    enrollments: DataFrame
    exams: DataFrame
    person_map: DataFrame
    enrollment_map: DataFrame


def enrollment_duplicates(
    enrollments: DataFrame, person_map: DataFrame, columns: CascadeColumns, scope: str = "merged"
) -> DataFrame:
    """Map of enrollments that coincide once their people are merged.

    ``enrollments`` carries canonical person ids. With scope ``merged`` only the
    people who absorbed another one are looked at; with ``all`` everyone is.
    """
    if scope not in {"merged", "all"}:
        raise ValueError(f"scope is 'merged' or 'all', not {scope!r}")
    if scope == "merged":
        merged = person_map.select(F.col(KEPT_ID).alias(columns.person))
        enrollments = keep_matching(enrollments, merged, [columns.person])
    return duplicate_map(enrollments, [columns.person, columns.offering], columns.enrollment)


def identity_maps(
    people: DataFrame, enrollments: DataFrame, columns: CascadeColumns, scope: str = "merged"
) -> tuple[DataFrame, DataFrame]:
    """Both duplicate maps, written down since every later step reads them again."""
    person_map = materialize(clean_map(duplicate_map(people, columns.identity, columns.person)))
    canonical = remap(enrollments, person_map, columns.person)
    enrollment_map = materialize(clean_map(enrollment_duplicates(canonical, person_map, columns, scope)))
    return person_map, enrollment_map


def resolve_identities(
    people: DataFrame,
    enrollments: DataFrame,
    exams: DataFrame,
    columns: CascadeColumns,
    scope: str = "merged",
) -> Cascade:
    """Drop duplicate people, then the enrollments that now coincide, and re-point the exams."""
    person_map, enrollment_map = identity_maps(people, enrollments, columns, scope)
    canonical = remap(enrollments, person_map, columns.person)
    return Cascade(
        people=drop_mapped(people, person_map, columns.person),
        enrollments=drop_mapped(canonical, enrollment_map, columns.enrollment),
        exams=remap(exams, enrollment_map, columns.enrollment),
        person_map=person_map,
        enrollment_map=enrollment_map,
    )
